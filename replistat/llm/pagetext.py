"""Main text of web pages: a bidirectional LSTM in numpy labels the sequence of leaf blocks."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import table

PATH_DIMS, WORD_DIMS, HIDDEN = 512, 48, 24
#: Blocks encoded at one time; longer pages are read in parts that hand on the state.
PART = 8192
#: Fixed values of HTML: tags that stay inside a block, tags without content, tags whose content is no text.
INLINE = frozenset("""a abbr acronym area b bdi bdo big blink br cite code data del dfn em embed font i img ins kbd map mark nobr param picture q rb rp rt rtc ruby s samp
small source span strike strong sub sup time track tt u var wbr""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title iframe object svg math canvas audio video textarea".split())
HEAD = frozenset("html head title base link meta style script noscript template".split())
#: Fixed values of HTML: what an open item, or an open paragraph, cannot be closed across.
ITEMS = frozenset("li option tr td th dd dt".split())
LISTS = ("ul", "ol", "menu", "select", "table", "dl")
WALLS = ("table", "td", "th", "caption", "button", "object", "template")
#: What marks the labelled training pages. Containers of the article, and parts that are none of it.
ARTICLE = frozenset("article main articlebody".split())
OTHER = frozenset("""nav header footer aside form button select menu sidebar ad ads advert advertisement banner promo sponsored comment comments reply replies respond
responses discussion cookie consent notice alert popup modal newsletter subscribe related share social breadcrumb breadcrumbs widget toolbar pagination""".split())
#: Every page that marks its article matches this; what else matches is told apart by its blocks.
MARK = "(?i)article|main|=[^<>]*&#"
MARKED, FOREIGN = 1, 2


@lru_cache(1 << 16)
def _slot(word: str, dims: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % dims


@lru_cache(1 << 16)
def _bit(word: str) -> int:
    """Bit of a path word; the two lowest bits say that the word names an article or a part that is none of it."""
    bare = word.removeprefix("<")
    return 4 << _slot(word, PATH_DIMS - 2) | MARKED * (bare in ARTICLE) | FOREIGN * (bare in OTHER)


class Path(NamedTuple):
    """All words from the root to a block as a set of bits, whatever the depth, with the innermost tag."""

    bag: int = 0
    leaf: str = ""
    depth: int = 0

    def down(self, tag: str, words: Iterable[str] = ()) -> Path:
        bag = self.bag | _bit("<" + tag)
        for w in words:
            bag |= _bit(w) & ~FOREIGN if tag in ("html", "body") else _bit(w)  # a page that has a sidebar is no sidebar
        return Path(bag, tag, self.depth + 1)


Block = tuple[Path, str, int]


class _Blocks(HTMLParser):
    """Leaf blocks in page order: (path, text, characters inside links). Time grows with the page, whatever is left unclosed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []  # open tags outside INLINE, and whether a link was open before
        self.paths = [Path()]
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # where each tag is open in the stack
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.silent = self.linked = 0
        self.link = False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((self.paths[-1], text, self.linked))
        self.parts, self.linked = [], 0

    def deepest(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            if tag == "a":
                self.link = True
            self.parts += [" "] * (tag == "br")
            return
        if tag not in SILENT and tag not in HEAD:
            if self.at["head"]:
                self.leave("head")
            self.flush()
            if self.deepest("svg", "math") > self.deepest("foreignobject") and tag in ("p", "div", "ul", "ol", "table", "h1", "h2", "h3", "body"):
                self.leave("svg" if self.at["svg"] else "math")
            if tag in ITEMS and self.deepest(tag) > self.deepest(*LISTS):  # an open item of the same list ends here
                self.leave(tag)
            if self.deepest("p") > self.deepest(*WALLS):
                self.leave("p")
        if tag in VOID:
            return
        words: list[str] = []
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop") and value:
                words += "".join(c if c.isalnum() else " " for c in value.lower()).split()
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, self.link))
        self.paths.append(self.paths[-1].down(tag, words))
        self.silent += tag in SILENT

    def leave(self, tag: str) -> None:
        while self.stack:
            t, self.link = self.stack.pop()
            self.paths.pop()
            self.at[t].pop()
            self.silent -= t in SILENT
            if t == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in INLINE:
            return
        if tag not in SILENT:
            self.flush()
        if self.at[tag]:
            self.leave(tag)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and not data.isspace():
            self.leave("head")
        if not self.silent:
            self.parts.append(data)
            if self.link:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    p = _Blocks()
    p.feed(html or "")
    HTMLParser.close(p)
    p.flush()
    return p.found


@lru_cache(1 << 12)
def _bits(bag: int, leaf: str) -> np.ndarray:
    row = np.unpackbits(np.frombuffer(bag.to_bytes(PATH_DIMS // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
    row[:2] *= 3  # the two flags, against all hashed words
    row[2 + _slot("leaf<" + leaf, PATH_DIMS - 2)] += 1
    return row


def encode(page: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """One row per block of page[start:stop]: hashed tag path, hashed words, and a few counts."""
    own = page[start:stop]
    x = np.zeros((len(own), PATH_DIMS + WORD_DIMS + 6), np.float32)
    for i, (path, text, linked) in enumerate(own):
        x[i, :PATH_DIMS] = _bits(path.bag, path.leaf)
        words = text.split(" ")
        at = np.bincount([_slot(w, WORD_DIMS) for w in words], minlength=WORD_DIMS)
        x[i, PATH_DIMS:PATH_DIMS + WORD_DIMS] = at / np.sqrt((at * at).sum())
        marks = sum(map(text.count, ".,;:!?"))
        x[i, -6:] = (np.log1p(len(words)) / 4, linked / max(len(text), 1), marks / len(words), min(path.depth, 64) / 16, (start + i) / len(page), 1)
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Labeller:
    """Weights: per direction input, recurrent; then the output layer over both directions."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7) -> Labeller:
        rng, n = np.random.default_rng(seed), PATH_DIMS + WORD_DIMS + 6
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 1 / np.sqrt(24), (n, 4 * HIDDEN)).astype(np.float32)
            w["h" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        w["o"] = rng.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32)
        w["c"] = np.zeros((1, 1), np.float32)
        return cls(w)

    def _run(self, x: np.ndarray, d: str, keep: bool, state: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        """States (pages, steps, hidden) of one direction over padded input (pages, steps, dims), from ``state`` on."""
        pages, steps, _ = x.shape
        z = (x.reshape(pages * steps, -1) @ self.w["x" + d]).reshape(pages, steps, -1)
        h, c = state or (np.zeros((pages, HIDDEN), np.float32),) * 2
        out, tape, k = np.zeros((pages, steps, HIDDEN), np.float32), [], HIDDEN
        for t in range(steps):
            a = z[:, t] + h @ self.w["h" + d]
            gate, new = _sigmoid(a[:, :3 * k]), np.tanh(a[:, 3 * k:])
            was, past = c, h
            c = gate[:, k:2 * k] * c + gate[:, :k] * new
            bent = np.tanh(c)
            h = gate[:, 2 * k:] * bent
            out[:, t] = h
            if keep:
                tape.append((gate, new, was, past, bent))
        return out, tape, (h, c)

    def _both(self, pages: list[np.ndarray], keep: bool):
        n = np.array([len(p) for p in pages])
        x = np.zeros((len(pages), int(n.max()), pages[0].shape[1]), np.float32)
        for i, p in enumerate(pages):
            x[i, :len(p)] = p
        step = np.arange(x.shape[1])
        turn = np.where(step < n[:, None], n[:, None] - 1 - step, step)  # reverses each page in its own length
        row = np.arange(len(pages))[:, None]
        back = x[row, turn]
        hf, tf, _ = self._run(x, "f", keep)
        hb, tb, _ = self._run(back, "b", keep)
        h = np.concatenate([hf, hb[row, turn]], axis=2)
        p = _sigmoid(h @ self.w["o"] + self.w["c"])[:, :, 0]
        return p, step < n[:, None], (x, back, row, turn, h, tf, tb)

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability per block; pages of similar length run together."""
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        out = [np.zeros(0)] * len(pages)
        a = 0
        while a < len(order):
            b, least = a, len(pages[order[a]])
            while b < len(order) and len(pages[order[b]]) <= max(1.4 * least, 8) and (b - a + 1) * len(pages[order[b]]) <= PART:
                b += 1
            b = max(b, a + 1)
            p, _, _ = self._both([pages[i] for i in order[a:b]], False)
            for i, row in zip(order[a:b], p):
                out[i] = row[:len(pages[i])]
            a = b
        return out

    def _long(self, page: list[Block]) -> np.ndarray:
        """Probability per block of one page of any length, read in parts from either end; one number per block is kept."""
        z, starts = np.full(len(page), self.w["c"][0, 0], np.float32), range(0, len(page), PART)
        for d, half in (("f", self.w["o"][:HIDDEN, 0]), ("b", self.w["o"][HIDDEN:, 0])):
            way, state = (1 if d == "f" else -1), None
            for a in starts[::way]:
                h, _, state = self._run(encode(page, a, a + PART)[None, ::way], d, False, state)
                z[a:a + PART] += (h[0] @ half)[::way]
        return _sigmoid(z)

    def label(self, found: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page are main text. Untrained, by rule. Pages of similar length are read together."""
        if not self.w:
            return [by_rule(page) for page in found]
        out = [np.zeros(0, bool)] * len(found)
        order, a = sorted(range(len(found)), key=lambda i: len(found[i])), 0
        while a < len(order):
            b, held = a, 0
            while b < len(order) and (b == a or held + len(found[order[b]]) <= PART):
                held += len(found[order[b]])
                b += 1
            own = order[a:b]
            got = [self._long(found[own[0]])] if held > PART else self.predict([encode(found[i]) for i in own])
            for i, y in zip(own, got):
                out[i] = y > 0.5
            a = b
        return out

    def _gradient(self, dh: np.ndarray, x: np.ndarray, tape: list, d: str) -> dict[str, np.ndarray]:
        k, w = HIDDEN, self.w["h" + d]
        dz = np.zeros((*x.shape[:2], 4 * k), np.float32)
        gh, ch, back = np.zeros_like(w), np.zeros((x.shape[0], k), np.float32), np.zeros((x.shape[0], k), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            gate, new, was, past, bent = tape[t]
            i, f, o = gate[:, :k], gate[:, k:2 * k], gate[:, 2 * k:]
            h = dh[:, t] + back
            c = ch + h * o * (1 - bent * bent)
            a = np.concatenate([c * new * i * (1 - i), c * was * f * (1 - f), h * bent * o * (1 - o), c * i * (1 - new * new)], axis=1)
            dz[:, t] = a
            gh += past.T @ a
            back, ch = a @ w.T, c * f
        return {"x" + d: x.reshape(-1, x.shape[2]).T @ dz.reshape(-1, 4 * k), "h" + d: gh}

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 20, batch: int = 48, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the mean log loss of all blocks."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0
        for e in range(epochs):
            order = sorted(range(len(pages)), key=lambda i: len(pages[i]) + rng.random() * 6)
            groups = [order[i:i + batch] for i in range(0, len(order), batch)]
            for g in rng.permutation(len(groups)):
                own = groups[g]
                p, real, (x, back, row, turn, h, tf, tb) = self._both([pages[i] for i in own], True)
                y = np.zeros_like(p)
                for r, i in enumerate(own):
                    y[r, :len(labels[i])] = labels[i]
                dy = (np.where(real, p - y, 0) / real.sum()).astype(np.float32)[:, :, None]
                flat = h.reshape(-1, h.shape[2])
                grad = {"o": flat.T @ dy.reshape(-1, 1), "c": dy.sum().reshape(1, 1)}
                dh = dy * self.w["o"][:, 0]
                grad |= self._gradient(dh[:, :, :HIDDEN], x, tf, "f")
                grad |= self._gradient(dh[:, :, HIDDEN:][row, turn], back, tb, "b")
                step += 1
                for k, gr in grad.items():
                    gr = np.clip(gr, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * gr
                    v[k] = 0.99 * v[k] + 0.01 * gr * gr
                    fade = rate * (1 - e / (epochs + 1))
                    self.w[k] = (self.w[k] - fade * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def taught(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article: 1 inside it, 0 elsewhere and in parts that are none of it. Others teach nothing."""
    if not any(path.bag & MARKED for path, _, _ in page):
        return None
    return np.array([path.bag & MARKED and not path.bag & FOREIGN for path, _, _ in page], float)


#: What article text stands in on rebuilt pages: containers, and for a run of blocks the tags around each.
HOLDERS = ("div.content", "div.post", "section.story", "div.entry.body", "main", "article", "div.article", "div.main.text", "div.container div.page", "div", "")
FORMS = ("p", "p", "p", "div", "ul li", "ol li", "ul li p", "table tr td", "table tbody tr td", "table tr th", "blockquote p", "blockquote", "pre", "h2", "h3", "h4", "figure figcaption",
         "dl dt", "dl dd", "section p", "section h2", "div p", "details summary", "center", "address")
SHORT = frozenset("li td th dt dd h2 h3 h4 figcaption summary".split())
FOREIGN_FORMS = ("p", "p", "li", "ul li", "label", "h3", "div", "div p", "td", "blockquote", "ul li p", "div div p", "span")


def _below(path: Path, steps: str) -> Path:
    """``path`` with steps such as ``div.entry.body p`` below it."""
    for tag, *words in (s.split(".") for s in steps.split()):
        path = path.down(tag, words)
    return path


def _foreign(root: Path, pool: list[str], rng: np.random.Generator) -> Iterator[Block]:
    """Blocks of one part that is no article: named as such, or unnamed and made of links."""
    name = sorted(OTHER)[rng.integers(len(OTHER))]
    tags = ("div", "section", "ul", "aside", "ol")
    if rng.random() < 0.12:
        own, links = root.down("div", (f"w{rng.integers(99)}",)), 1.0
    elif name in ("nav", "header", "footer", "aside", "form", "menu", "button", "select") and rng.random() < 0.6:
        own, links = root.down(name), float(name in ("nav", "menu"))
    else:
        own, links = root.down(tags[rng.integers(len(tags))], (name, ("box", "list", "area", "wrap", "inner")[rng.integers(5)])[:rng.integers(1, 3)]), float(rng.random() < 0.3)
    for _ in range(rng.integers(1, 6)):
        said = pool[rng.integers(len(pool))].split(" ")
        said = " ".join(said[:rng.integers(1, 12) if links else rng.integers(2, 60)])
        yield _below(own, FOREIGN_FORMS[rng.integers(len(FOREIGN_FORMS))]), said, int(len(said) * links)


def variants(page: list[Block], labels: np.ndarray, pool: list[str], rng: np.random.Generator, rebuilt: int = 7) -> Iterator[tuple[list[Block], np.ndarray]]:
    """The page as it is, and rebuilt: other containers, article text in lists, tables, quotes and the like, foreign parts around and inside."""
    yield page, labels
    for _ in range(rebuilt):
        body = Path().down("html").down("body")
        if rng.random() < 0.4:  # wrappers with names that mean nothing
            for _ in range(rng.integers(1, 4)):
                body = body.down("div", [f"u{n}" for n in rng.integers(0, 1 << 20, rng.integers(0, 14))])
        holder = _below(body, HOLDERS[rng.integers(len(HOLDERS))])
        if rng.random() < 0.3:
            holder = holder.down("div", [f"u{n}" for n in rng.integers(0, 1 << 20, rng.integers(0, 14))])
        mixed, plain = rng.random() < 0.7, ("p", "p", "div")[rng.integers(3)]
        new: list[Block] = []
        out: list[float] = []
        left, form, kept = 0, plain, 1.0 if rng.random() < 0.5 else rng.uniform(0.2, 1)  # short articles too
        for i, ((path, text, linked), y) in enumerate(zip(page, labels)):
            edge = i in (0, len(page) - 1) or y != labels[i - 1]
            for _ in range(rng.integers(0, 3) if edge or y and rng.random() < 0.2 else 0):
                part = list(_foreign(body if not y or rng.random() < 0.4 else holder, pool, rng))
                new += part
                out += [0.0] * len(part)
            if y:
                if rng.random() > kept:
                    continue
                if not left:
                    left, form = int(rng.integers(1, 7)), FORMS[rng.integers(len(FORMS))] if mixed and rng.random() < 0.6 else plain
                left -= 1
                own = form if i == 0 or path.leaf != "h1" or rng.random() < 0.3 else "h1"
                path = _below(holder, own)
                if own.split()[-1] in SHORT and rng.random() < 0.7:
                    said = text.split(" ")
                    text = " ".join(said[:rng.integers(1, 12)])
                    linked = min(linked, len(text))
                if rng.random() < 0.05:
                    linked = len(text)
            new.append((path, text, linked))
            out.append(y)
        yield new, np.array(out)


def by_rule(page: list[Block]) -> np.ndarray:
    """Main text where no page teaches: blocks in no part named in OTHER, with less than half of their characters in links."""
    return np.array([not path.bag & FOREIGN and 2 * linked < len(text) for path, text, linked in page], bool)


def _teaching_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of pages that mark their article."""
    for rb in batches:
        found = [h for h, html in zip(rb.column("h").to_pylist(), rb.column("html")) if taught(blocks(html.as_py())) is not None]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])


def teaching(pages: DataFrame, most: int, html_col: str = "html") -> list[str]:
    """The first ``most`` different pages that mark their article, by hash of the html, out of the whole table.

    Shares of the hashes are searched, each 16 times the last, until one holds ``most`` marked pages or
    all are searched; the result does not depend on the shares. Only hashes are ranked, and only the
    chosen pages reach the driver.
    """
    rows = pages.filter(F.col(html_col).isNotNull()).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    share = 4 * most / max(pages.count(), 1)
    while True:
        own = rows.filter(F.col("h") < int(share * 2**64) - 2**63) if share < 1 else rows
        marked = own.filter(F.col("html").rlike(MARK)).mapInArrow(_teaching_rows, "h long").distinct()
        first = [r[0] for r in marked.orderBy("h").limit(most).collect()]
        if len(first) == most or share >= 1:
            break
        share *= 16
    if not first:
        return []
    return [r[1] for r in rows.filter(F.col("h").isin(first)).groupBy("h").agg(F.min("html")).orderBy("h").collect()]


def learn(pages: DataFrame, most: int = 192, html_col: str = "html", seed: int = 7) -> Labeller:
    """Train on at most ``most`` of the pages that mark their article. Without one the labeller stays untrained."""
    rng, found = np.random.default_rng(seed), []
    for html in teaching(pages, most, html_col):
        page = blocks(html)
        found.append((page, taught(page)))
    if not found:
        return Labeller({})
    pool = [text for page, _ in found for _, text, _ in page]
    made = [v for page, labels in found for v in variants(page, labels, pool, rng) if v[0]]
    model = Labeller.fresh(seed)
    model.train([encode(p) for p, _ in made], [y for _, y in made], seed=seed)
    return model


def extract(pages: DataFrame, model: Labeller, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text (blocks labelled as article, joined by spaces) and blocks (all, with labels).

    Null, empty and block-less html gives empty text. Broken markup is read as far as it goes. Null and
    repeated ids and all other columns pass through; columns named as the results are replaced. Pages
    are independent, so there is no shuffle; an Arrow batch is worked on in parts of bounded size.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "blocks")]
    src = pages.select(*rest, F.col(html_col).alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            at, size = 0, np.cumsum([len(h or "") + 1 for h in (x.as_py() for x in rb.column("__html"))]) if rb.num_rows else np.zeros(0)
            while at < rb.num_rows:
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 4_000_000)))
                own = rb.slice(at, end - at)
                found = [blocks(h) for h in own.column("__html").to_pylist()]
                chosen = shared.value.label(found)
                labelled = [[{"text": t, "main": bool(y)} for (_, t, _), y in zip(p, ys)] for p, ys in zip(found, chosen)]
                texts = [" ".join(b["text"] for b in p if b["main"]) for p in labelled]
                cols = [own.column(c) for c in rest] + [pa.array(texts, pa.string()), pa.array(labelled, kind)]
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, "text", "blocks"])
                at = end

    schema = src.drop("__html").withColumns({"text": F.lit(""), "blocks": F.from_json(F.lit("[]"), "array<struct<text:string,main:boolean>>")}).schema
    return src.mapInArrow(run, schema)


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract(pages.select("page_id", "url", "html"), learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_page_text": op2_page_text}
ORACLE: dict[str, str] = {}
