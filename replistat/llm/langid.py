"""Language identification: scripts narrow the candidates, Viterbi over word scores labels spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import chosen_ids, packed, table, written

#: First words of Unicode letter names that tell a script; every other script is "other".
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "THAI", "GEORGIAN", "HANGUL",
           "HIRAGANA", "KATAKANA", "CJK", "ETHIOPIC", "KHMER")
PIECE = 1 << 21  # code points worked on at once
MOST_CHOSEN = 200_000  # ids, a few MB


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its script (0: no letter, last: other) and its lower case, if that is one code point."""
    script = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    known = {s: i + 1 for i, s in enumerate(SCRIPTS)}
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            script[cp] = known.get(unicodedata.name(ch, "?").split(" ")[0].split("-")[0], len(SCRIPTS) + 1)
            low = ch.lower()
            if len(low) == 1:
                lower[cp] = ord(low)
    return script, lower


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(cp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of at most PIECE code points, cut where no letter is; a longer word is cut inside."""
    script, at = letters()[0], 0
    while cp.size - at > PIECE:
        gaps = np.flatnonzero(script[cp[at:at + PIECE]] == 0)
        end = at + (int(gaps[-1]) + 1 if gaps.size else PIECE)
        yield at, cp[at:end]
        at = end
    yield at, cp[at:]


def features(cp: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters, the bucket of the trigram around each, and its script."""
    script, lower = letters()
    kind = script[cp]
    low = np.where(kind > 0, lower[cp], 0).astype(np.uint32)
    around = np.concatenate([np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)])
    at = np.flatnonzero(kind)
    h = around[at] * np.uint32(0x9E3779B1) ^ around[at + 1] * np.uint32(0x85EBCA6B) ^ around[at + 2] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    return at, (h * np.uint32(0x2C1B3C6D) >> np.uint32(8)) & np.uint32(buckets - 1), kind[at]


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages
    allowed: np.ndarray  # scripts x languages
    prior: np.ndarray
    switch: float

    @property
    def out(self) -> np.float32:
        """Score of a letter for a language that its script rules out: below the lowest of any trigram by more than prior and two switches make up for."""
        return np.float32(self.logp.min() + self.prior.min() - 2 * self.switch - 1)

    def words(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and scores (words x languages) of the words of joined texts."""
        out = []
        for base, part in pieces(cp):
            at, bucket, kind = features(part, self.logp.shape[0])
            if not at.size:
                continue
            score = np.where(self.allowed[kind], self.logp[bucket], self.out)
            first = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
            last = np.concatenate([first[1:], [at.size]]) - 1
            out.append((at[first] + base, at[last] + base + 1, np.add.reduceat(score, first, axis=0)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32)
        return tuple(np.concatenate(x) for x in zip(*out))

    def paths(self, score: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Viterbi labels of all words of many documents at once (document d: count[d] words from first[d])."""
        label = np.zeros(score.shape[0], np.int16)
        order = np.argsort(count, kind="stable")
        order = order[count[order] > 0]
        a = 0
        while a < order.size:
            b = int(np.searchsorted(count[order], max(count[order[a]] * 1.4, 32), side="right"))
            docs = order[a:b]
            n, steps = count[docs], int(count[order[b - 1]])
            best = self.prior + score[first[docs]]
            jump = np.zeros((steps, docs.size, best.shape[1]), bool)
            top = np.zeros((steps, docs.size), np.int16)
            row = np.arange(docs.size)
            for t in range(1, steps):
                live = int(np.searchsorted(n, t, side="right"))  # documents are in order of length
                x = best[live:]
                top[t, live:] = x.argmax(axis=1)
                go = x[row[:x.shape[0]], top[t, live:]][:, None] - self.switch
                jump[t, live:] = go > x
                best[live:] = np.maximum(x, go) + score[first[docs[live:]] + t]
            now = best.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                live = int(np.searchsorted(n, t, side="right"))
                label[first[docs[live:]] + t] = now[live:]
                if t:
                    now[live:] = np.where(jump[t, row[live:], now[live:]], top[t, live:], now[live:])
            a = b
        return label

    def spans(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Per text: language, share of its letters, and (start, end, language) in code points."""
        parts = [codes(t or "") for t in texts]
        gap = np.zeros(1, np.uint32)
        joined = np.concatenate([x for p in parts for x in (p, gap)]) if parts else gap
        base = np.concatenate([[0], np.cumsum([p.size + 1 for p in parts])]).astype(np.int64)
        if not self.langs:
            return [("und", 0.0, [])] * len(texts)
        start, end, score = self.words(joined)
        first = np.searchsorted(start, base[:-1])
        count = np.searchsorted(start, base[1:]) - first
        label = self.paths(score, first, count)
        out = []
        for d, (f, n) in enumerate(zip(first.tolist(), count.tolist())):
            if not n:
                out.append(("und", 0.0, []))
                continue
            own, s, e = label[f:f + n], start[f:f + n] - base[d], end[f:f + n] - base[d]
            share = np.bincount(own, weights=e - s, minlength=len(self.langs))
            cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [n]])
            found = [(int(s[i]), int(e[j - 1]), self.langs[own[i]]) for i, j in zip(cut[:-1], cut[1:])]
            out.append((self.langs[int(share.argmax())], float(share.max() / share.sum()), found))
        return out


def fit(rows: list[tuple[str, str]], buckets: int = 1 << 16, switch: float = 12.0) -> Model:
    """Smoothed trigram frequencies per language of (lang, text) rows; scripts with 1 % of a language's letters are its own."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros((len(SCRIPTS) + 2, 0), bool), np.zeros(0, np.float32), switch)
    counts = np.zeros((buckets, len(langs)))
    kinds = np.zeros((len(SCRIPTS) + 2, len(langs)))
    for lang, text in rows:
        i = langs.index(lang)
        for _, part in pieces(codes(text)):
            _, bucket, kind = features(part, buckets)
            counts[:, i] += np.bincount(bucket, minlength=buckets)
            kinds[:, i] += np.bincount(kind, minlength=len(SCRIPTS) + 2)
    total = counts.sum(axis=0)
    logp = np.log((counts + 0.1) / (total + 0.1 * buckets)).astype(np.float32)
    share = np.array([sum(lang == x for x, _ in rows) for lang in langs], float)
    allowed = kinds >= np.maximum(0.01 * kinds.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script seen in no language rules none out
    return Model(langs, logp, allowed, np.log(share / max(share.sum(), 1)).astype(np.float32), switch)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, per_lang: int = 1024, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``per_lang`` labelled rows of each language, chosen by hash of the id.

    Only rows with a text, a language and an id that is not held out; of rows that repeat id and
    language one. The chosen ids are broadcast if they are at most MOST_CHOSEN, else joined by a shuffle.
    """
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    chosen = written(chosen_ids(rows, "__id", per_lang, "__lang"))
    if chosen.count() <= MOST_CHOSEN:
        chosen = F.broadcast(chosen)
    picked = rows.join(chosen, ["__id", "__lang"]).groupBy("__id", "__lang").agg(F.min("__text").alias("__text"))
    return fit(sorted((r[0], r[1]) for r in picked.select("__lang", "__text").collect()))


def tag_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, lang_pred, score and lang_spans (start, end, lang; code points).

    Without any language learned everything is ``und``. The language is the one whose spans hold most letters (first by name in a tie), the score its
    share of the letters. Null text and text without letters: ``und``, score 0, no spans. A null id is
    not held out. An empty table gives an empty result. Same-named columns are replaced, others pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lang_spans array<struct<start:int,end:int,lang:string>>")
    def label(texts: pd.Series) -> pd.DataFrame:
        out, at = [], 0
        size = texts.str.len().fillna(0).to_numpy()
        while at < len(texts):  # parts of bounded size
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), 4 * PIECE)))
            out += shared.value.spans(texts.iloc[at:end].tolist())
            at = end
        return pd.DataFrame([(p, s, [{"start": a, "end": b, "lang": x} for a, b, x in spans]) for p, s, spans in out], columns=["lang_pred", "score", "lang_spans"])

    rows = docs.drop("held_out", "lang_pred", "score", "lang_spans").withColumn("__l", label(F.col(text_col)))
    return rows.select("*", held_out(F.col(id_col)).alias("held_out"), "__l.*").drop("__l")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows whose language could be told: not ``und``, and the winner holds ``least`` of the letters.

    Where no row is labelled no language can be told; then the rows with a letter stay.
    """
    model = learn(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = tag_languages(packed(docs, "doc_id", "text"), model)
    return rows.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("__row.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return tag_languages(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
