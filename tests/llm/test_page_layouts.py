"""Page text on layouts that are not those of the training table: hand-written pages with hand-written texts."""

import time

import pytest

from replistat.llm import pagetext

S = ["The river rose by two metres during the night, and the lower road was closed.", "Engineers had warned of this for years.", "Nobody was hurt, the mayor said on Monday.",
     "Repairs will take until autumn, if the weather holds.", "A second dam is planned further up the valley."]
LINKS = '<ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul>'


def paras(*which):
    return "".join(f"<p>{S[i]}</p>" for i in which)


LAYOUTS = {
    "lists": (f"<html><body><nav>{LINKS}</nav><article><h1>Flood</h1>{paras(0, 1)}<ul><li>{S[2]}</li><li>{S[3]}</li></ul>{paras(4)}</article><footer>Imprint</footer></body></html>",
              f"Flood {S[0]} {S[1]} {S[2]} {S[3]} {S[4]}"),
    "table": (f"<html><body><article><h1>Flood</h1>{paras(0)}<table><tr><th>Year<th>Level<tr><td>1999<td>3 m<tr><td>2004<td>4 m</table>{paras(1)}</article><div class='ads'><p>Buy a boat today!</p></div></body></html>",
              f"Flood {S[0]} Year Level 1999 3 m 2004 4 m {S[1]}"),
    "quotes": (f"<html><body><header>Daily News</header><main><h1>Flood</h1><blockquote><p>{S[2]}</p></blockquote><h2>Background</h2>{paras(0, 1)}<pre>level 4\nflow 12</pre>{paras(3)}</main></body></html>",
               f"Flood {S[2]} Background {S[0]} {S[1]} level 4 flow 12 {S[3]}"),
    "comments_inside": (f"<html><body><article><h1>Flood</h1>{paras(0, 1, 2)}<div class='comments'><h3>2 comments</h3><p>I saw it with my own eyes, what a night it was.</p><p>Me too.</p></div></article></body></html>",
                        f"Flood {S[0]} {S[1]} {S[2]}"),
    "utility_classes": ("<html><body><div class='a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13 main'>" + "<div class='p-4 m-2 flex grid w-full h-full text-sm md:p-8 lg:p-9 xl:p-10 shadow rounded border'>" * 3
                        + f"<h1>Flood</h1>{paras(0, 1)}</div></div></div></div><div class='a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13 comments'>"
                        + "<div class='p-4 m-2 flex grid w-full h-full text-sm md:p-8 lg:p-9 xl:p-10 shadow rounded border'>" * 3 + f"<p>{S[4]}</p></div></div></div></div></body></html>", f"Flood {S[0]} {S[1]}"),
    "no_head_end": (f"<html><head><title>t</title><meta charset=utf-8><body><article><h1>Flood</h1>{paras(0, 1)}</article><footer>Imprint</footer>", f"Flood {S[0]} {S[1]}"),
    "plain_divs": (f"<html><body><div><div>{S[0]}</div><div>{S[1]}</div><div>{S[2]}</div><div>{S[3]}</div></div></body></html>", f"{S[0]} {S[1]} {S[2]} {S[3]}"),
    "post": (f"<html><body><div class='navbar menu'>{LINKS}</div><div class='post'><h1>Flood</h1>{paras(0, 1, 2, 3)}</div><aside><h3>Related</h3><p>{S[4]}</p></aside></body></html>",
             f"Flood {S[0]} {S[1]} {S[2]} {S[3]}"),
    "figure_and_terms": (f"<html><body><article><h1>Flood</h1>{paras(0)}<figure><img src=x.png><figcaption>The lower road at noon</figcaption></figure><dl><dt>Dam<dd>{S[4]}</dl>{paras(1)}</article></body></html>",
                         f"Flood {S[0]} The lower road at noon Dam {S[4]} {S[1]}"),
    "page_class_and_script": (f"<html><body class='has-sidebar no-ads'><article><h1>Flood</h1><p>Nobody <script>x()</script>was <img src=y>hurt.</p>{paras(0)}<form><label>Mail</label><textarea>you</textarea></form>{paras(1)}</article></body></html>",
                              f"Flood Nobody was hurt. {S[0]} {S[1]}"),
    "sidebar_between": (f"<html><body><main><section class='story'><h1>Flood</h1>{paras(0, 1)}<div class='newsletter'><p>Get our letter every morning, free of charge.</p></div>{paras(2, 3)}</section></main><div class='sidebar'>{paras(4)}</div></body></html>",
                        f"Flood {S[0]} {S[1]} {S[2]} {S[3]}"),
}


@pytest.fixture(scope="module")
def labeller(spark):
    return pagetext.learn(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_layouts(labeller):
    found = [pagetext.blocks(html) for html, _ in LAYOUTS.values()]
    got = [" ".join(t for (_, t, _), y in zip(page, ys) if y) for page, ys in zip(found, labeller.label(found))]
    wrong = {n: (g, text) for (n, (_, text)), g in zip(LAYOUTS.items(), got) if g != text}
    assert not wrong


def test_unclosed_tags_take_linear_time():
    start = time.process_time()
    assert len(pagetext.blocks("<div class='a'>x" * 100_000)) == 100_000
    assert len(pagetext.blocks("<li><ul>" + "<div>" * 100_000 + "<li>y</li>" * 100_000)) == 100_000
    assert time.process_time() - start < 12


def test_long_page_in_parts(labeller, monkeypatch):
    page = pagetext.blocks(f"<article>{paras(0, 1, 2) * 30}</article><div class='comments'>{paras(3, 4) * 20}</div>")
    whole = labeller.predict([pagetext.encode(page)])[0]
    monkeypatch.setattr(pagetext, "PART", 7)
    assert abs(labeller._long(page) - whole).max() < 1e-4
    assert (labeller.label([page, page[:3]])[0] == (whole > 0.5)).all()
