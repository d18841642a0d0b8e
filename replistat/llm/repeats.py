"""Substring deduplication by recompression: names of token runs and pairs bring equal windows together."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import shared_folder, table, written

WINDOW = 20
ROUNDS = 6  # pair rounds; names then span up to 20 words and about five on average
LEAST = 4  # a window whose longest name spans fewer words is its own witness
PIECE = 400_000  # words parsed at once
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
GAP = np.uint64(0x5851F42D4C957F2D)  # stands between documents; windows over it are left out
NO_ID = (1 << 63) - 1  # null ids come after all others


def blend(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Name of a pair: the same 64 bits on every executor, without a dictionary."""
    x = a * A + b * B + np.uint64(k * int(C) & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    x *= B
    return x ^ (x >> np.uint64(32))


def hash_windows(tok: np.ndarray, at: np.ndarray, factor: np.uint64, width: int = WINDOW) -> np.ndarray:
    out = np.full(at.size, np.uint64(width))
    for j in range(width):
        out *= factor
        out += tok[at + j]
        out ^= out >> np.uint64(31)
    return out


def witnesses(tok: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``tok``: the name of its longest symbol, and where that symbol starts.

    Recompression: maximal runs of one token get a name, then in each round every symbol falls left
    or right by its name alone, and a left symbol followed by a right one becomes a pair with a new
    name. A symbol carries the interval of tokens that its existence depends on. Only symbols whose
    interval lies in the window are candidates, so the choice (longest, then name, then place) is a
    function of the window's tokens: equal windows have equal witnesses, wherever they stand. Past
    either end of ``tok`` nothing is known, so nothing that depends on it is a candidate.
    """
    n = tok.size
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.flatnonzero(tok[1:] != tok[:-1]) + 1
    s = np.concatenate([[0], cut])
    e = np.concatenate([cut, [n]])
    name = np.where(e - s > 1, blend(tok[s], (e - s).astype(np.uint64), 1), tok[s])
    lo, hi = s - 1, e + 1
    made = [(name[e - s > 1], s[e - s > 1], e[e - s > 1], lo[e - s > 1], hi[e - s > 1])]
    for r in range(2, rounds + 2):
        m = name.size
        if m < 2:
            break
        right = (blend(name, np.full(1, C), r) >> np.uint64(63)).astype(bool)
        pair = ~right[:-1] & right[1:]
        opens, closes = np.append(pair, False), np.concatenate([[False], pair])
        lo2, hi2 = lo.copy(), hi.copy()
        i = np.flatnonzero(~opens & ~right)  # stays single, because the next one is left as well
        nxt = np.minimum(i + 1, m - 1)
        lo2[i], hi2[i] = np.minimum(lo[i], lo[nxt]), np.where(i + 1 < m, np.maximum(hi[i], hi[nxt]), n + 1)
        i = np.flatnonzero(~closes & right)  # stays single, because the one before is right as well
        prev = np.maximum(i - 1, 0)
        lo2[i], hi2[i] = np.where(i > 0, np.minimum(lo[i], lo[prev]), -1), np.maximum(hi[i], hi[prev])
        p = np.flatnonzero(pair)
        name2, e2 = name.copy(), e.copy()
        name2[p], e2[p] = blend(name[p], name[p + 1], r), e[p + 1]
        lo2[p], hi2[p] = np.minimum(lo[p], lo[p + 1]), np.maximum(hi[p], hi[p + 1])
        made.append((name2[p], s[p], e2[p], lo2[p], hi2[p]))
        stay = ~closes
        name, s, e, lo, hi = name2[stay], s[stay], e2[stay], lo2[stay], hi2[stay]
    name, s, e, lo, hi = (np.concatenate(x) for x in zip(*made))
    ok = (hi - lo <= width) & (e - s >= LEAST) & (lo >= 0) & (hi <= n)
    name, s, e, lo, hi = name[ok], s[ok], e[ok], lo[ok], hi[ok]
    key = ((e - s).astype(np.uint64) << np.uint64(59)) | ((name >> np.uint64(26)) << np.uint64(21)) | np.arange(name.size, dtype=np.uint64)
    order = np.lexsort((key, hi - lo))
    ends = np.searchsorted((hi - lo)[order], np.arange(width + 2))
    best = np.zeros(n + 1, np.uint64)
    for d in range(1, width + 1):  # best over all intervals inside [p, p + d)
        np.maximum(best[:-1], best[1:], out=best[:-1])
        own = order[ends[d]:ends[d + 1]]
        best[lo[own]] = np.maximum(best[lo[own]], key[own])
    best = best[:n - width + 1]
    found = best > 0
    which = (best[found] & np.uint64((1 << 21) - 1)).astype(np.int64)
    out, place = np.zeros(best.size, np.uint64), np.arange(best.size)
    out[found], place[found] = name[which], s[which]
    alone = np.flatnonzero(~found)
    out[alone] = hash_windows(tok, alone, C, width)
    return out, place


def parse(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of all texts: tokens and, per window, its start, text number, start in the text, witness, place of the witness."""
    def piece(parts: list[tuple[int, int, list[bytes]]]):
        seen: dict[bytes, int] = {}
        number, ids, starts = seen.setdefault, [], []
        for _, _, words in parts:
            starts.append(len(ids))
            ids += [number(w, len(seen)) for w in words]
            ids.append(-1)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
        which = np.array(ids, np.int64)
        tok = np.where(which < 0, GAP, hashes[which]) if hashes.size else np.full(which.size, GAP)
        name, place = witnesses(tok)
        begin = np.array(starts)
        length = np.array([len(w) for _, _, w in parts])
        at = np.arange(name.size)
        own = np.searchsorted(begin, at, side="right") - 1
        ok = at + WINDOW <= begin[own] + length[own]
        at, own = at[ok], own[ok]
        return tok, at, np.array([d for d, _, _ in parts])[own], at - begin[own] + np.array([o for _, o, _ in parts])[own], name[ok], place[ok]

    wait, size = [], 0
    for d, t in enumerate(texts):
        words = (t or "").encode("utf-8", "surrogatepass").split()
        for o in range(0, max(len(words) - WINDOW + 1, 0), PIECE):  # long texts in overlapping parts
            wait.append((d, o, words[o:o + PIECE + WINDOW - 1]))
            size += len(wait[-1][2])
            if size >= PIECE:
                yield piece(wait)
                wait, size = [], 0
    if wait:
        yield piece(wait)


def slices(rb: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``most`` characters, one row at least."""
    texts = rb.column(column)
    size, at = 0, 0
    for i in range(rb.num_rows):
        size += len(texts[i].as_py() or "")
        if size >= most or i == rb.num_rows - 1:
            yield rb.slice(at, i + 1 - at)
            at, size = i + 1, 0


def _witness_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in (x for b in batches for x in slices(b, "text")):
        key = rb.column("key").to_numpy(zero_copy_only=False)
        for _, at, own, _, name, place in parse(rb.column("text").to_pylist()):
            if not at.size:
                continue
            first = np.ones(at.size, bool)
            first[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1]) | (name[1:] != name[:-1])
            order = np.lexsort((name[first], own[first]))
            o, w, q = own[first][order], name[first][order], place[first][order]
            new = np.ones(o.size, bool)
            new[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
            begin = np.flatnonzero(new)
            low, high = np.minimum.reduceat(q, begin), np.maximum.reduceat(q, begin)
            yield pa.RecordBatch.from_arrays([pa.array(w[begin].view(np.int64)), pa.array(key[o[begin]]), pa.array(low != high)], names=["name", "key", "again"])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name: those whose name comes twice or is repeated in its document, and a partition's first and last row."""
    kept, first = None, True
    for rb in batches:
        t = pa.Table.from_batches([rb] if kept is None else [kept, rb]).combine_chunks()
        if not t.num_rows:
            continue
        name = t.column("name").to_numpy()
        same = np.zeros(name.size + 1, bool)
        same[1:-1] = name[1:] == name[:-1]
        ok = same[1:] | same[:-1] | t.column("again").to_numpy()
        ok[0] |= first
        first = False
        hold = int(ok[-1])  # the last row may meet its like in the next batch
        out = np.flatnonzero(ok[:-1])
        yield from t.select(["name", "key"]).take(pa.array(out)).to_batches()
        last = t.slice(t.num_rows - 1).combine_chunks()
        if hold:  # it already counts: write it, and let it vouch for the next
            last = last.set_column(2, "again", pa.array([True]))
        kept = last.to_batches()[0]
    if kept is not None:
        yield kept.select(["name", "key"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in (x for b in batches for x in slices(b, "text")):
        doc, sub = rb.column("doc").to_numpy(zero_copy_only=False), rb.column("sub").to_numpy(zero_copy_only=False)
        names = np.unique(rb.column("names").flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
        names.sort()
        for tok, at, own, pos, name, _ in parse(rb.column("text").to_pylist()):
            k = np.searchsorted(names, name)
            ok = names[np.minimum(k, names.size - 1)] == name
            at, own, pos = at[ok], own[ok], pos[ok]
            if at.size:
                g = (hash_windows(tok, at, A) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(hash_windows(tok, at, B).view(np.int64)), pa.array(g), pa.array(doc[own]), pa.array(sub[own]), pa.array(pos)], names=["h", "g", "doc", "sub", "at"])


def _later_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (h, g, doc, sub, at): all but the first of each content. The first row of a partition is unsure (1), its last content is told (2)."""
    names = ["h", "g", "doc", "sub", "at"]
    last, head = None, None
    for rb in batches:
        if not rb.num_rows:
            continue
        cols = [rb.column(n).to_numpy(zero_copy_only=False) for n in names]
        kind = np.zeros(rb.num_rows, np.int8)
        if last is None:
            last = [c[0] for c in cols]
            kind[0] = 1
            head = last
        full = [np.concatenate([[x], c]) for x, c in zip(last, cols)]
        same = (full[0][1:] == full[0][:-1]) & (full[1][1:] == full[1][:-1])
        start = np.flatnonzero(~np.concatenate([[True], same]))
        # the first occurrence of the content of each row: carried over, or the row where it begins
        begin = np.zeros(rb.num_rows, np.int64)
        begin[start - 1] = start
        begin = np.maximum.accumulate(begin)
        moved = np.zeros(rb.num_rows, bool)
        for k in (2, 3, 4):
            moved |= full[k][1:] != np.where(begin > 0, full[k][begin], head[k])
        later = same & moved
        if kind[0] == 1:
            later[0] = True
        yield pa.RecordBatch.from_arrays([pa.array(c[later]) for c in cols] + [pa.array(kind[later])], names=[*names, "kind"])
        if start.size:
            head = [c[start[-1]] for c in full]
        last = [c[-1] for c in cols]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([x])) for x in last] + [pa.array(np.array([2], np.int8))], names=[*names, "kind"])


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in (x for b in batches for x in slices(b, "text")):
        total, gone, kept = [], [], []
        for t, starts in zip(rb.column("text").to_pylist(), rb.column("starts")):
            words = (t or "").encode("utf-8", "surrogatepass").split()
            step = np.zeros(len(words) + 1, np.int32)
            if starts.is_valid:
                at = np.unique(starts.values.to_numpy(zero_copy_only=False))
                step[at] += 1
                step[at + WINDOW] -= 1
            stay = np.cumsum(step[:-1]) == 0
            total.append(len(words))
            gone.append(int(stay.size - stay.sum()))
            kept.append(b" ".join(compress(words, stay.tolist())).decode("utf-8", "surrogatepass"))
        rest = [c for c in rb.schema.names if c not in ("text", "starts")]
        yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in rest], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*rest, "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text) for every row.

    A window is WINDOW words of one document. Words that are covered by a window whose words also
    start earlier (smaller id, or earlier in the same document) go; windows are judged on the input.
    Null text has no words. Null ids come last. Rows that repeat an id with another text are
    documents of their own, in the order of a hash of the text; rows that repeat id and text are one
    document, each with its result. Such documents, and those with
    null ids, are told by the id and a 64-bit hash of the text. Texts under WINDOW words stay. An empty table gives an empty result.

    Three shuffles of thin rows: names of each document meet by range of (name, hash of id and text),
    which finds those that come twice; windows that have such a name as witness meet by range of (content hash, id,
    text hash, start), where all but the first are repeats; the repeats return to their document. Ranges split a
    name or content of any frequency; only one row at each border needs a second look. 96 bits of two
    hashes stand for the content of a window.
    """
    slot = shared_folder(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("sub"))
    # the text hash tells documents apart where an id is null or has several texts; elsewhere it is 0, which shuffles cheaply
    many = written(src.filter(F.col("id").isNotNull()).groupBy("doc").agg(F.min("sub").alias("a"), F.max("sub").alias("b")).filter("a <> b").select("doc", F.lit(True).alias("many")))
    src = src.join(many, "doc", "left").withColumn("sub", F.when(F.col("id").isNull() | F.col("many"), F.col("sub")).otherwise(F.lit(0)))
    # where two documents share a key, more windows are compared, no others removed
    src = src.withColumn("key", F.when(F.col("sub") == 0, F.col("doc")).otherwise(F.xxhash64("doc", "sub"))).select("key", "doc", "sub", "id", "text")
    named = written(src.select("key", "text").mapInArrow(_witness_rows, "name long, key long, again boolean"), slot)
    ranged = named.repartitionByRange("name", "key").sortWithinPartitions("name", "key")
    shared = ranged.mapInArrow(_shared_rows, "name long, key long").groupBy("key").agg(F.collect_set("name").alias("names"))
    found = src.select("key", "doc", "sub", "text").join(shared, "key").select("doc", "sub", "text", "names")
    found = written(found.mapInArrow(_window_rows, "h long, g int, doc long, sub long, at long"))

    order = ("h", "g", "doc", "sub", "at")
    later = found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_later_rows, "h long, g int, doc long, sub long, at long, kind byte")
    later = written(later, slot)
    place = ("doc", "sub", "at")
    ends = later.filter("kind = 2").groupBy("h", "g").agg(F.min(F.struct(*place)).alias("last"))
    unsure = later.filter("kind = 1")
    # a partition's first row repeats if another partition ends with the same content at an earlier place
    proven = unsure.join(ends, ["h", "g"]).filter(F.struct(*place) > F.col("last")).select(*place)
    gone = later.filter("kind = 0").select(*place).unionByName(proven)
    starts = gone.groupBy("doc", "sub").agg(F.collect_list("at").alias("starts"))
    out = src.join(starts, ["doc", "sub"], "left").select("id", "text", "starts")
    kind = src.schema["id"].dataType.simpleString()
    return out.mapInArrow(_cut_rows, f"id {kind}, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE = {
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
k AS (SELECT *, i <= n - 19 AS whole, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h FROM u),
f AS (SELECT *, whole AND row_number() OVER (PARTITION BY whole, h ORDER BY doc_id, i) > 1 AS later FROM k),
g AS (SELECT *, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON r.doc_id = d.doc_id""",
}
