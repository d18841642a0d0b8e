"""The whole job where the shared tables show only a part of it: rare labels, other scripts, null ids, edited copies, long literals."""

import numpy as np
from pyspark.sql import functions as F

from replistat.llm import decontam, langid, pagetext, repeats, secrets

# pages -----------------------------------------------------------------------------------------------------------

PARTS = '<nav><a href=/>Home of it</a></nav>{}<div class="comments"><p>Nice one of them</p></div><form><label>Mail</label></form>'


def page_rows(n, marked):
    for i in range(n):
        text = f"<h1>Title {i}</h1>" + "".join(f"<p>Some words of text {i} and {k}, with a stop.</p>" for k in range(4))
        yield i, PARTS.format(f"<article>{text}</article>" if marked(i) else f'<div class="domain-main1">{text}</div>')


def test_pages_learn_from_rare_labels(spark):
    rows = list(page_rows(6000, lambda i: i % 100 == 7)) + [(10**6 + i, None) for i in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(5)
    assert set(pagetext.teaching(pages, 192)) == {h for i, h in rows if i % 100 == 7 and h}
    few = pagetext.teaching(pages, 20)
    assert len(few) == 20 and few == pagetext.teaching(pages.repartition(3), 192)[:20]
    nameless = pages.withColumn("page_id", F.lit(None).cast("long"))
    assert len(pagetext.teaching(nameless, 192)) == 60


def test_pages_without_labels_follow_the_rule(spark):
    pages = spark.createDataFrame(list(page_rows(30, lambda i: False)), "page_id long, html string")
    model = pagetext.learn(pages)
    assert not model.w
    for r in pagetext.extract(pages, model).collect():
        assert r["text"].startswith(f"Title {r['page_id']} Some words") and not any(x in r["text"] for x in ("Home", "Nice", "Mail"))


# language --------------------------------------------------------------------------------------------------------

def drawn(rng, first, letters, n_words, least, most):
    return " ".join("".join(chr(first + x) for x in rng.integers(0, letters, rng.integers(least, most))) for _ in range(n_words))


def test_language_of_unseen_words_follows_the_script():
    kinds = {"en": (97, 26, 2, 9), "fr": (97, 26, 2, 9), "ru": (0x430, 32, 2, 9), "zh": (0x4E00, 6000, 4, 14), "ja": (0x3041, 80, 3, 12), "ko": (0xAC00, 5000, 2, 6)}
    rng = np.random.default_rng(2)
    model = langid.fit([(lang, drawn(rng, first, letters, 1500, least, most)) for lang, (first, letters, least, most) in kinds.items() for _ in range(3)])
    for lang in ("ru", "zh", "ja", "ko"):
        first, letters, least, most = kinds[lang]
        texts = [drawn(rng, first, letters, n, least, most) for n in (1, 3, 40)]
        assert [(p, s) for p, s, _ in model.spans(texts)] == [(lang, 1.0)] * 3
    both = "where the words are plain " * 3 + drawn(rng, 0x4E00, 6000, 6, 4, 14)
    spans = model.spans([both])[0][2]
    assert spans[-1][2] == "zh" and both[spans[-1][0]:] == both.split("plain ")[-1]
    lone = model.spans(["ωμέγα"])[0]  # a script seen in no language rules none out
    assert lone[0] in kinds and lone[1] == 1.0


# substring repeats -----------------------------------------------------------------------------------------------

def test_repeats_of_many_null_and_equal_ids(spark):
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(24)]
    rows = []
    for i in range(1000):  # null ids, and one id with many texts; a passage at the same position in many of them
        own = [f"u{i}x{k}" for k in range(int(rng.integers(0, 60)))]
        rows.append((None if i % 2 else 5, " ".join(["same", *passage, *own] if i % 4 < 2 else [*own, *passage])))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    kept = {(r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got}
    # unique words stay, the passage stays once, in a text of the smallest id
    assert len(got) == 1000 and sum("p0 " in r["kept_text"] for r in got) == 1
    assert [r["id"] for r in got if "p0 " in r["kept_text"]] == [5]
    for i, t in rows:
        words = t.split()
        own = " ".join(w for w in words if w[0] == "u")
        before = {(i, len(words), 25, own), (i, len(words), 24, " ".join([*["same"] * (words[0] == "same"), *own.split()])), (i, len(words), 0, t)}
        assert before & kept


# leaks -----------------------------------------------------------------------------------------------------------

def test_leaks_with_one_edited_slot_or_without_capitals(spark):
    q = "In March the trader Anna Smith sold 12 crates to Anna Jones and 12 crates to Peter Brown and then Anna Lee got 12 crates from Peter Stone and 12 more from Anna King"
    item = spark.createDataFrame([(7, q)], "item_id long, text string")
    rows = [(1, q.replace("Peter Stone and 12", "Peter Stone and 13")), (2, q.replace("Anna Lee", "Carla Lee")), (3, q.lower()), (4, q.upper()),
            (5, q.replace("12", "37").replace("from Peter Stone and 37", "from Peter Stone and 38").replace("Anna", "Berta")), (6, "In May they sold 3 crates and left for good with Anna Smith")]
    docs = spark.createDataFrame([(i, f"Some words. {t} More of them.") for i, t in rows], "doc_id long, text string")
    assert {r["id"] for r in decontam.find_leaks(docs, item, F.col("doc_id")).collect()} == {1, 2, 3, 4, 5}
    assert {r["doc_id"] for r in decontam.drop_leaks(docs, item).collect()} == {6}


def test_leaks_windows_that_agree():
    w = lambda q, *z: {"q": q, "z": [{"q_slots": a, "slots": b} for a, b in z]}
    assert decontam.agreeing([w(0, ("x", "a")), w(1, ("x", "a")), w(2, ("x", "b")), w(3, ("x", "x")), w(4), w(5, ("x", "a"), ("y", "c"))]) == [0, 1, 3, 4, 5]
    assert decontam.agreeing([w(0, ("x", "b")), w(1, ("x", "x"))]) == [1]
