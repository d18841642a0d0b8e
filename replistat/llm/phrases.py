"""Phrase collocations: n-grams of word ids counted in lossless counting quotient filters that merge across shards."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import table, written
from replistat.operators.scan import row_numbers

#: Fixed by the result contract: what ends a piece, and what parts words.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PARTS = b"\x20\x09"
PLAIN = bytes(0x0A if b in ENDS else 0x20 if b in PARTS else b for b in range(256))
BOUNDARY = re.compile(b"[%s]" % re.escape(ENDS + PARTS))
SLAB = 1 << 20      # bytes split into words at once


# texts to codes ---------------------------------------------------------------------------------------------------

def slabs(texts: Iterable[bytes]) -> Iterator[bytes]:
    """Texts joined by an end of piece, in parts of about SLAB bytes; a long text is cut between words."""
    held, size = [], 0
    for text in texts:
        at = 0
        while len(text) - at > SLAB and (cut := BOUNDARY.search(text, at + SLAB)):
            yield b"".join([*held, text[at:cut.start()]])
            held, size, at = [], 0, cut.start()
        held += [text[at:], b"\n"]
        size += len(text) - at + 1
        if size > SLAB:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def encode(texts: Iterable[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Distinct words, and the texts as codes: 0 ends a piece, i + 1 is word i. ``bytes.lower`` changes A-Z only."""
    index = defaultdict(count().__next__, {})
    skip, end = index[b""], index[b"\n"]
    found = []
    for slab in slabs(texts):
        tokens = slab.lower().translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
        codes = np.fromiter(map(index.__getitem__, tokens), np.int32, len(tokens))
        found.append(codes[codes != skip])
    codes = np.concatenate(found) if found else np.zeros(0, np.int32)
    ends = codes == end
    return list(index)[2:], codes[~(ends & np.roll(ends, 1))] - 1     # a run of ends says no more than one


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Texts of a language in chunks of about ``most`` bytes, each with words and counts of its own."""
    held, size, task, number = defaultdict(list), 0, TaskContext.get().partitionId(), count()

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            words, codes = encode(texts)
            if words:
                counts = np.bincount(codes, minlength=len(words) + 1)[1:]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | next(number)]), pa.array([lang], pa.string()), pa.array([words], pa.list_(pa.binary())), pa.array([counts.tolist()], pa.list_(pa.int64())),
                     pa.array([codes.tobytes()], pa.binary()), pa.array([int(counts.sum())])], names=["chunk", "lang", "words", "counts", "codes", "n"])
        held.clear()

    for rb in batches:
        for lang, text in zip(rb.column("lang"), rb.column("text")):
            text = text.as_py()
            held[lang.as_py()].append(text)
            size += len(text)
            if size >= most:
                yield from flush()
                size = 0
    yield from flush()


# counting quotient filter -----------------------------------------------------------------------------------------

class Keys:
    """Packed n-grams of ids of ``bits`` bits, permuted invertibly and cut into quotient and full remainder.

    A key has three ids (0 where the n-gram is shorter). A four-round Feistel network permutes its 3 x
    ``bits`` bits; the upper part is the quotient, which also names the shard, the lower the remainder. Both
    are kept whole, so a key comes back exactly and no two n-grams ever share a counter.
    """

    MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)

    def __init__(self, bits: int):
        self.bits, self.high = bits, 3 * bits // 2
        self.low = 3 * bits - self.high
        self.masks = np.uint64((1 << self.high) - 1), np.uint64((1 << self.low) - 1)

    @staticmethod
    def _round(x: np.ndarray, salt: int) -> np.ndarray:
        x = (x + np.uint64(salt & 0xFFFFFFFF)) * np.uint64(salt)
        x ^= x >> np.uint64(29)
        x *= np.uint64(Keys.MIX[0])
        return x ^ (x >> np.uint64(32))

    def split(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Quotients and remainders of n-grams given as three columns of ids."""
        a, b, c = (x.astype(np.uint64) for x in ids)
        bits, low = self.bits, self.low
        # the middle id lies across the cut between the parts
        over = np.uint64(low - bits)
        q, r = (a << np.uint64(self.high - bits)) | (b >> over), ((b << np.uint64(bits)) | c) & self.masks[1]
        for i in (0, 2):
            q = q ^ (self._round(r, self.MIX[i]) & self.masks[0])
            r = r ^ (self._round(q, self.MIX[i + 1]) & self.masks[1])
        return q, r

    def join(self, q: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        """The ids again."""
        for i in (2, 0):
            r = r ^ (self._round(q, self.MIX[i + 1]) & self.masks[1])
            q = q ^ (self._round(r, self.MIX[i]) & self.masks[0])
        bits, over = self.bits, self.low - self.bits
        c = r & np.uint64((1 << bits) - 1)
        b = ((q & np.uint64((1 << (bits - over)) - 1)) << np.uint64(over)) | (r >> np.uint64(bits))
        return [(q >> np.uint64(self.high - bits)).astype(np.int64), b.astype(np.int64), c.astype(np.int64)]


def merged(keys: Keys, q: np.ndarray, r: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (quotient, remainder) in order with their total counts; runs that are sorted already merge as such."""
    if not q.size:
        return q, r, np.zeros(0, np.int64)
    if keys.high + keys.low <= 64:
        key = (q << np.uint64(keys.low)) | r
        if n is None:
            key, total = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, total = key[new], np.add.reduceat(n[order], new)
        return key >> np.uint64(keys.low), key & keys.masks[1], total
    order = np.lexsort((r, q))
    q, r = q[order], r[order]
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (r[1:] != r[:-1])]))
    return q[new], r[new], np.add.reduceat(np.ones(len(q), np.int64) if n is None else n[order], new)


def _narrow(x: np.ndarray) -> bytes:
    """Width in bytes, then the numbers in that width."""
    width = next(w for w in (1, 2, 4, 8) if not x.size or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.uint64)


def pack(q: np.ndarray, r: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """A filter as bytes: steps between quotients (0 stays in the run), remainders, counts of a byte, and those of 255 and more."""
    large = n >= 255
    return _narrow(np.diff(q, prepend=np.uint64(0))), _narrow(r), np.where(large, 255, n).astype(np.uint8).tobytes(), _narrow(n[large].astype(np.uint64))


def unpack(parts: tuple[bytes, bytes, bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(parts[2], np.uint8).astype(np.int64)
    n[n == 255] = _wide(parts[3]).astype(np.int64)
    return np.cumsum(_wide(parts[0]), dtype=np.uint64), _wide(parts[1]), n


FILTER = ("shard", "steps", "rest", "small", "large")


def _filters(batches: Iterator[pa.RecordBatch], keys: Keys, shard_bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """One filter per chunk and shard of all n-grams of two to ``longest`` words whose words all have an id."""
    for rb in batches:
        for codes, at, ids in zip(rb.column("codes"), rb.column("at"), rb.column("ids")):
            codes = np.frombuffer(codes.as_py(), np.int32)
            at = at.values.to_numpy(zero_copy_only=False)
            name = np.zeros(max(int(codes.max(initial=0)), int(at.max(initial=0))) + 1, np.int64)
            name[at] = ids.values.to_numpy(zero_copy_only=False)
            word = name[codes]
            two = (word[:-1] > 0) & (word[1:] > 0)
            three = two[:-1] & two[1:]
            start = [np.flatnonzero(two), np.flatnonzero(three) if longest > 2 else np.zeros(0, np.int64)]
            both = np.concatenate(start)
            third = np.concatenate([np.zeros(len(start[0]), np.int64), word[start[1] + 2]])
            q, r, n = merged(keys, *keys.split([word[both], word[both + 1], third]))
            shard = (q >> np.uint64(keys.high - shard_bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
            rows = [(int(shard[i]), *pack(q[i:j], r[i:j], n[i:j])) for i, j in zip(cut[:-1], cut[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows))], names=list(FILTER))


def _merge(part: pa.Table, keys: Keys, least: int) -> pa.Table:
    """All filters of one shard in one: n-grams that occur ``least`` times or more, as ids again."""
    found = [unpack(x) for x in zip(*(part.column(c).to_pylist() for c in FILTER[1:]))]
    q, r, n = merged(keys, *(np.concatenate(x) for x in zip(*found)))
    often = n >= least
    return pa.table([*map(pa.array, keys.join(q[often], r[often])), pa.array(n[often])], names=["a", "b", "c", "f"])


# the job ----------------------------------------------------------------------------------------------------------

def count_phrases(docs: DataFrame, lang: Column, text: Column, longest: int = 3, least: int = 10, chunk: int = 1 << 23, per_shard: int = 1 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, grams, sizes) per ``lang`` (not null): words (id, lang, word, f) and n-grams (a, b, c, f; c is 0 for two words) that occur
    ``least`` times or more in their language, and the number of all word occurrences n per lang.

    Each partition turns its texts into chunks of codes with their own word lists. Words are counted over
    the lists; a word below ``least`` can be in no n-gram that reaches it and gets no id. Ids come back to the chunks by
    a join, each chunk's n-grams go into one small filter per shard, and a shard's filters are merged in one
    task. The shards, ranges of quotients of permuted keys, are even and their number grows with the
    input; a frequent n-gram is one counter per chunk.
    """
    given = docs.select(lang.cast("string").alias("lang"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    chunks = written(given.mapInArrow(lambda it: _chunks(it, chunk), "chunk long, lang string, words array<binary>, counts array<long>, codes binary, n long"))
    listed = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("chunk", "lang", "at", F.col("w.words").cast("string").alias("word"), "w.counts")
    words = listed.groupBy("lang", "word").agg(F.sum("counts").alias("f")).filter(F.col("f") >= least)
    words = written(row_numbers(words, [], ["lang", "word"], "id"))
    sizes = written(chunks.groupBy("lang").agg(F.sum("n").alias("n")))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], words.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    keys = Keys(max(2, int(most).bit_length()))
    shard_bits = min(keys.high, max(4, int((longest - 1) * total // per_shard).bit_length()))
    named = listed.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct((F.col("at") + 1).alias("at"), "id")).alias("w"))     # at most a chunk's words
    ready = chunks.select("chunk", "codes").join(named, "chunk").select("codes", F.col("w.at").alias("at"), F.col("w.id").alias("ids"))
    blocks = ready.mapInArrow(partial(_filters, keys=keys, shard_bits=shard_bits, longest=longest), "shard int, steps binary, rest binary, small binary, large binary")
    grams = blocks.groupBy("shard").applyInArrow(lambda part: _merge(part, keys, least), "a long, b long, c long, f long")
    return words, written(grams), sizes


#: floor(1000000 a a / (l r)), exact for counts below 10^15.
SCORE = "cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(x.l as decimal(15,0)) * cast(x.r as decimal(15,0))) as bigint)"


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, top: int = 2000, covered: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase of two to ``longest`` (2 or 3) words that occurs ``least`` times is a candidate; its score is the lowest of its
    cuts. A candidate that lies inside a longer candidate with at least ``covered`` per cent of its
    occurrences is dropped. Exact for up to 10^15 occurrences and 2^42 words.

    Null texts count as empty, null languages as ``und``. Ties go to the higher count, then to the phrase in
    byte order. Repeated rows count each time; an empty table, or one without candidates, gives no rows. Other columns are not read.
    """
    words, grams, sizes = count_phrases(docs, F.coalesce(F.col(lang_col), F.lit("und")), F.col(text_col), longest, least)
    w = {k: words.select(F.col("id").alias(k), F.col("lang"), F.col("word").alias(f"word_{k}"), F.col("f").alias(f"f_{k}")) for k in "abc"}
    two, three = grams.filter("c = 0").select("a", "b", "f"), grams.filter("c > 0")
    inner = three.select("a", "b", "f").unionByName(three.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("inside"))
    short = two.join(inner, ["a", "b"], "left").filter(F.expr(f"inside IS NULL OR 100 * inside < {covered} * f"))
    short = short.join(w["a"], "a").join(w["b"].drop("lang"), "b").select(
        "lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("a"), F.array(F.struct(F.col("f_a").alias("l"), F.col("f_b").alias("r"))).alias("cuts"))
    left, right = two.select("a", "b", F.col("f").alias("f_ab")), two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc"))
    long_ = three.join(left, ["a", "b"]).join(right, ["b", "c"]).join(w["a"], "a").join(w["b"].drop("lang"), "b").join(w["c"].drop("lang"), "c").select(
        "lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("a"),
        F.array(F.struct(F.col("f_a").alias("l"), F.col("f_bc").alias("r")), F.struct(F.col("f_ab").alias("l"), F.col("f_c").alias("r"))).alias("cuts"))
    scored = short.unionByName(long_).withColumn("best", F.expr(f"array_min(transform(cuts, (x, k) -> struct({SCORE} as score, k, x.l, x.r)))"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    ranked = row_numbers(scored, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], "rank").filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrase_collocations": op13_phrase_collocations}
ORACLE = {
    "op13_phrase_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, ws FROM (SELECT lang, regexp_split_to_array(unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+') AS ws FROM d)),
t AS (SELECT lang, piece, w, i FROM (SELECT lang, piece, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM p) WHERE w <> ''),
o AS (SELECT lang, w AS w1, lead(w) OVER v AS w2, lead(w, 2) OVER v AS w3 FROM t WINDOW v AS (PARTITION BY piece ORDER BY i)),
g1 AS (SELECT lang, w1, count(*) AS f FROM o GROUP BY ALL), n AS (SELECT lang, sum(f) AS n FROM g1 GROUP BY ALL),
g2 AS (SELECT lang, w1, w2, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT g2.lang, concat_ws(' ', g2.w1, g2.w2) AS phrase, g2.f AS a, x.f AS l, y.f AS r, 1 AS cut FROM g2 JOIN g1 x ON x.lang = g2.lang AND x.w1 = g2.w1 JOIN g1 y ON y.lang = g2.lang AND y.w1 = g2.w2
  LEFT JOIN (SELECT lang, w1, w2, max(f) AS m FROM (SELECT lang, w1, w2, f FROM g3 UNION ALL SELECT lang, w2, w3, f FROM g3) GROUP BY ALL) z ON z.lang = g2.lang AND z.w1 = g2.w1 AND z.w2 = g2.w2
  WHERE m IS NULL OR 100 * m < 50 * g2.f
  UNION ALL SELECT g3.lang, concat_ws(' ', g3.w1, g3.w2, g3.w3), g3.f, x.f, y.f, 1 FROM g3 JOIN g1 x ON x.lang = g3.lang AND x.w1 = g3.w1 JOIN g2 y ON y.lang = g3.lang AND y.w1 = g3.w2 AND y.w2 = g3.w3
  UNION ALL SELECT g3.lang, concat_ws(' ', g3.w1, g3.w2, g3.w3), g3.f, x.f, y.f, 2 FROM g3 JOIN g2 x ON x.lang = g3.lang AND x.w1 = g3.w1 AND x.w2 = g3.w2 JOIN g1 y ON y.lang = g3.lang AND y.w1 = g3.w3),
s AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= 2000""",
}
