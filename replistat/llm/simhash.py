"""SimHash near-duplicates through a segment-popcount embedding and a grid join under Manhattan distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replistat.llm.common import packed, row_key, shared_folder, table, written

EVEN = 0x5555555555555555
#: Set bits of every byte value, one column per bit.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of one text: a bit is 1 if set in over half of the shingle hashes.

    Shingles are ``width`` words joined by spaces, repeats included; fewer words make one shingle, no
    words (or null) give 0. ``bytes`` lower-cases A-Z and splits at ASCII white space only.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.uint16) * 256
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view("<i8")[0])


def embed(fp: np.ndarray) -> np.ndarray:
    """32 segments of two bits, each replaced by its number of set bits."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(EVEN))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two embeddings; never above the Hamming distance of the fingerprints."""
    x = a ^ b
    low, high = x & np.uint64(EVEN), (x >> np.uint64(1)) & np.uint64(EVEN)
    count = np.bitwise_count
    return count(low).astype(np.int16) + 2 * count(high).astype(np.int16) - 2 * count(low & high).astype(np.int16)


def within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    near = manhattan(embed(a), embed(b)) <= most
    near[near] = np.bitwise_count((a ^ b)[near]) <= most
    return near


def spanning_links(fps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect exactly what all pairs within ``most`` bits would; fewer than ``len(fps)``."""
    links, left = [], fps
    while left.size > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and left.size:
            x = frontier.pop()
            near = within(left, np.full(left.shape, x), most)
            if near.any():
                hit = left[near]
                links.append((hit, np.full(hit.shape, x)))
                frontier.extend(hit)
                left = left[~near]
    return links


def _cell_links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by cell; a cell that goes on into the next batch is carried over."""
    names = ("combo", "cell", "tile")
    keep: list[np.ndarray] | None = None

    def links(cols: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = cols[3]
        sizes = ends - starts
        found = []
        two = starts[sizes == 2]
        if two.size:
            a, b = fp[two], fp[two + 1]
            ok = within(a, b, most)
            found.append((a[ok], b[ok]))
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            found.extend(spanning_links(fp[s:e], most))
        if found:
            a, b = (np.concatenate([p[i] for p in found]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    for rb in batches:
        cols = [rb.column(n).to_numpy(zero_copy_only=False) for n in names]
        cols.append(rb.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
        if keep:
            cols = [np.concatenate(x) for x in zip(keep, cols)]
        if not cols[0].size:
            continue
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
        starts = np.concatenate([[0], new])
        if starts.size > 1:
            yield from links(cols, starts[:-1], starts[1:])
        keep = [c[starts[-1]:].copy() for c in cols]
    if keep:
        yield from links(keep, np.array([0]), np.array([keep[0].size]))


def link_fingerprints(fps: DataFrame, most: int = 3, groups: int = 6, tile: int = 16384) -> DataFrame:
    """(a, b) links among distinct fingerprints ``fps`` (fp long) that span all pairs within ``most`` bits.

    A fingerprint becomes the counts of set bits of its 32 two-bit segments. Fingerprints within
    ``most`` bits differ by at most ``most`` in these counts (Manhattan distance), hence in at most
    ``most`` of ``groups`` groups of segments: they share the counts of some ``groups - most`` groups.
    Those shared counts are the grid cells of an equi-join. Inside a cell the Manhattan distance and
    then the Hamming distance are tested, and only links of a spanning forest leave it.

    Cells above ``tile`` members are cut into chunks by hash and worked on per pair of chunks, so a
    task holds at most about two chunks; each is complete for its pairs, so no link is lost.
    """
    cuts = [round(i * 32 / groups) for i in range(groups + 1)]
    masks = [sum(3 << (2 * s) for s in range(cuts[g], cuts[g + 1])) for g in range(groups)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    half = F.shiftrightunsigned("fp", 1)  # per segment: one set bit is 01, two are 10
    embedded = F.col("fp").bitwiseXOR(half).bitwiseAND(F.lit(EVEN)).bitwiseOR(F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(F.lit(EVEN)), 1))
    cells = [F.struct(F.lit(i).cast("short").alias("combo"), F.col("e").bitwiseAND(F.lit(signed(sum(masks[g] for g in c)))).alias("cell"))
             for i, c in enumerate(combinations(range(groups), groups - most))]
    rows = fps.select("fp", embedded.alias("e")).select("fp", F.inline(F.array(*cells)))
    hot = written(rows.groupBy("combo", "cell").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > tile))
    if hot.isEmpty():
        rows = rows.withColumn("tile", F.lit(0).cast("long"))
    else:
        rows = rows.join(hot, ["combo", "cell"], "left").withColumn("t", F.ceil(F.coalesce("m", F.lit(1)) / tile))
        own = F.pmod(F.xxhash64("fp"), F.col("t"))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        rows = rows.withColumn("tile", F.least("own", "other") * F.col("t") + F.greatest("own", "other"))
    rows = rows.select("combo", "cell", "tile", "fp").repartition("combo", "cell", "tile").sortWithinPartitions("combo", "cell", "tile", "fp")
    return rows.mapInArrow(lambda it: _cell_links(it, most), "a long, b long").distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (a > b): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds. A node's smallest neighbour is an aggregate with
    partial sums, joined back, so a hub of any size is no single group. Rounds grow with the logarithm
    of the longest chain; two table slots are used in turn.
    """
    spark = links.sparkSession
    slots = [shared_folder(spark), shared_folder(spark)]
    edges, seen = written(links, slots[0]), None
    for i in range(1, rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = written(small.distinct(), slots[i % 2])
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)
    raise RuntimeError("components did not settle")


def tag_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """``docs`` without its text, with fingerprint (hex) and component_id, the smallest id reachable.

    Null text counts as empty: fingerprint zero, linked like any other. Null ids are never a
    component_id unless a component has no other (then it is null); repeated ids are rows of their own.
    An empty table gives an empty result. Columns named as the results are replaced, others pass.

    Equal fingerprints are one node, so copies cost one row each. Text is read once.
    """
    hashed = F.pandas_udf(lambda s: pd.Series([fingerprint(t) for t in s], dtype="int64"), "long")
    rows = written(docs.drop("fingerprint", "component_id").withColumn("__fp", hashed(F.col(text_col))).drop(text_col))
    nodes = written(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min(id_col).alias("first")))
    found = components(link_fingerprints(nodes.select("fp"), most))
    own = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = own.join(own.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(F.col("fp").alias("__fp"), "component_id")
    out = rows.join(named, "__fp")
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("__fp"), 16, "0"))).drop("__fp")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component, with its own columns: the smallest id (null ids last), then the smallest hash of its text."""
    rows = packed(docs, "doc_id", "text").withColumn("__k", row_key(F.col("doc_id"), F.col("text")))
    stay = tag_near_copies(rows.select("__k", "text"), "__k").filter("__k = component_id").select("__k").distinct()
    return rows.join(stay, "__k", "left_semi").dropDuplicates(["__k"]).select("__row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tag_near_copies(docs).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}
