"""Overlap of element sets: agreement of two masks, redundant candidates, set differences."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from ..params import IOU_LIMIT
from ..session import cut_lineage, unless_large
from .graph import greedy_kept
from .parity import close_pairs, packed, parity, runs, shared, signature_bits, unpacked


def agreement(auto: DataFrame, manual: DataFrame, image: str, elem: str) -> DataFrame:
    """Dice and Jaccard index per image of two element sets; two empty sets agree fully.

    Both sides are counted per (image, element) first, so a huge image is spread over its elements.
    """
    one = auto.select(image, elem, F.lit(1).alias("_a"), F.lit(0).alias("_m"))
    two = manual.select(image, elem, F.lit(0).alias("_a"), F.lit(1).alias("_m"))
    hit = one.unionByName(two).groupBy(image, elem).agg(F.max("_a").alias("_a"), F.max("_m").alias("_m"))
    real = F.col(elem).isNotNull()
    per = hit.groupBy(image).agg(
        F.sum(F.when(real, F.col("_a")).otherwise(0)).alias("n_auto"),
        F.sum(F.when(real, F.col("_m")).otherwise(0)).alias("n_manual"),
        F.sum(F.when(real, F.col("_a") * F.col("_m")).otherwise(0)).alias("n_both"))
    total = F.col("n_auto") + F.col("n_manual")
    return per.withColumn("dice", F.when(total == 0, 1.0).otherwise(2.0 * F.col("n_both") / total)).withColumn(
        "iou", F.when(total == 0, 1.0).otherwise(F.col("n_both") / (total - F.col("n_both"))))


def set_rows(elements: DataFrame, image: str, cand: str, elem: str) -> DataFrame:
    """One row per candidate with its different elements, ``_e``; rows that hold an array already are taken as they are."""
    if isinstance(elements.schema[elem].dataType, ArrayType):
        return elements.filter(F.size(elem) > 0).select(image, cand, F.col(elem).alias("_e"))
    return elements.groupBy(image, cand).agg(F.collect_set(elem).alias("_e"))


def signatures(elements: DataFrame, keys: list[str], elem: str, bits: int | None = None, limit: float = IOU_LIMIT) -> DataFrame:
    """``_sig`` per set, an array of longs: a bit is set if an odd number of elements hash to it.

    Signatures of two sets differ in no more bits than the sets have elements that are not shared. Without ``bits`` their
    number follows the size, a power of two; folded to half its width, a signature is that of half as many bits.
    """
    rows = set_rows(elements.withColumn("_none", F.lit(0)), "_none", keys[0], elem) if len(keys) == 1 else set_rows(elements, *keys, elem)

    @F.pandas_udf("array<bigint>")
    def sign(hashes: pd.Series) -> pd.Series:
        return pd.Series([parity(h, bits or signature_bits(len(h), limit)) for h in hashes])

    return rows.select(*keys, F.size("_e").cast("bigint").alias("n"), *_prints(), sign(F.transform("_e", lambda x: F.xxhash64(x, F.lit(7)))).alias("_sig"))


def _prints() -> list[Column]:
    """Two 64-bit sums by which sets of equal size are told apart."""
    total = lambda seed: F.aggregate("_e", F.lit(0).cast("bigint"), lambda t, x: t.bitwiseXOR(F.xxhash64(x, F.lit(seed))))
    return [total(1).alias("_s"), total(2).alias("_x")]


def _classes(sets: DataFrame, image: str, cand: str) -> DataFrame:
    classes = sets.groupBy(image, "n", "_s", "_x").agg(F.min(cand).alias("rep"), F.count(F.lit(1)).alias("n_same"))
    return sets.select(image, cand, "n", "_s", "_x").join(classes, [image, "n", "_s", "_x"]).select(image, cand, "rep", "n", "n_same")


def overlap_classes(elements: DataFrame, image: str, cand: str, elem: str) -> DataFrame:
    """Membership of each candidate in its class of identical sets: ``rep`` (first member), ``n``, ``n_same``."""
    rows = set_rows(elements, image, cand, elem)
    return _classes(rows.select(image, cand, F.size("_e").cast("bigint").alias("n"), *_prints()), image, cand)


def _found(elements: DataFrame, image: str, cand: str, elem: str, limit: float) -> tuple[DataFrame, DataFrame]:
    """Edges between representatives, and the stored membership. The signatures come from one pass over the sets."""
    signed = cut_lineage(signatures(elements, [image, cand], elem, limit=limit))
    classes = cut_lineage(_classes(signed, image, cand))
    reps = classes.filter(F.col(cand) == F.col("rep"))
    return _edges(set_rows(elements, image, cand, elem), signed, reps, image, cand, limit), classes


def overlap_edges(elements: DataFrame, image: str, cand: str, elem: str, limit: float = IOU_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Pairs of candidates of an image with intersection over union above ``limit``, and the membership.

    ``elements`` has one row per (image, candidate, element), or one per (image, candidate) with an array of its different
    elements. Edges are between class representatives;
    with ``n_pairs``, the number of pairs of candidates an edge stands for, and one row from a
    representative to itself for the pairs inside a class of copies. Joined with the membership of
    both ends they give every pair, so none is lost and copies are not multiplied out here.
    ``first`` comes before ``second`` in the order (size falling, candidate rising).
    """
    edges, classes = _found(elements, image, cand, elem, limit)
    reps = classes.filter(F.col(cand) == F.col("rep"))
    size = reps.select(F.col(image).alias("_i"), F.col("rep").alias("_r"), F.col("n_same").alias("_k"))
    one, two = size, size.select(F.col("_i").alias("_j"), F.col("_r").alias("_q"), F.col("_k").alias("_l"))
    edges = edges.join(one, (F.col(image) == F.col("_i")) & (F.col("first") == F.col("_r"))).join(two, (F.col(image) == F.col("_j")) & (F.col("second") == F.col("_q")))
    edges = edges.withColumn("n_pairs", F.col("_k") * F.col("_l")).drop("_i", "_r", "_k", "_j", "_q", "_l")
    inside = reps.filter("n_same > 1").select(
        image, F.col("rep").alias("first"), F.col("rep").alias("second"), F.col("n").alias("n_first"), F.col("n").alias("n_second"), F.col("n").alias("n_both"),
        F.lit(1.0).alias("iou"), F.expr("n_same * (n_same - 1) div 2").alias("n_pairs"))
    return edges.unionByName(inside), classes


#: Sets and bytes of signatures in a tile, at most; tiles that a task reads from each side, about.
TILE, TILE_BYTES, TILES = 5_000, 2_000_000, 16
#: Pairs that are counted in one call, at most.
CALL = 1_000_000
#: Elements of the packed sets in a bucket, about; a set counts as so many more, which bounds the sets of a bucket too.
BUCKET, EACH = 4_000_000, 50


def _tiles(reps: DataFrame) -> DataFrame:
    """Sets (_i, _c, n, _sig) in order of image, size and candidate, cut into rows of at most ``TILE`` sets."""
    order = ["_i", "n", "_c"]
    parts = reps.count() // (4 * TILE) + 1
    kind = {f.name: f.dataType.simpleString() for f in reps.schema}
    dealt = reps.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)

    def cut(batches):
        turn = 0
        for b in batches:
            if not b.num_rows:
                continue
            n = max(-(-b.num_rows // TILE), -(-b.nbytes // TILE_BYTES))
            for at in np.array_split(np.arange(b.num_rows), min(n, b.num_rows)):
                t = b.slice(int(at[0]), len(at))
                turn += 1
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(t["_part"][0].as_py() << 32) + turn], pa.int64()), t["_i"].slice(0, 1), t["_i"].slice(len(at) - 1), t["n"].slice(0, 1), t["n"].slice(len(at) - 1),
                     one(t["_i"]), one(t["_c"]), one(t["n"]), one(t["_sig"].flatten())], names=["t", "i0", "i1", "n0", "n1", "i", "c", "n", "sig"])

    return cut_lineage(dealt.mapInArrow(cut, f"t bigint, i0 {kind['_i']}, i1 {kind['_i']}, n0 bigint, n1 bigint, i array<{kind['_i']}>, c array<{kind['_c']}>, n array<bigint>, sig array<bigint>"))


def _meetings(tiles: DataFrame, limit: float) -> DataFrame:
    """Pairs of sets whose signatures allow an overlap above ``limit``: a row per meeting of two tiles (or part of one).

    ``i``, ``c`` and ``n`` list the sets that take part, ``p`` and ``q`` the pairs by their places there, ``p`` being first.
    Every tile meets itself and the later ones of its image with sets of fitting size. Tasks read parts of the
    tiles from both sides; nothing is written for a meeting but what it finds.
    """
    kind = {f.name: f.dataType.simpleString() for f in tiles.schema}
    n, cores = tiles.count(), tiles.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n, max(math.ceil(math.sqrt(8 * cores)), -(-n // TILES))))
    a = tiles.repartition(parts)
    b = a.toDF(*[f"{c}_" for c in tiles.columns]).hint("shuffle_replicate_nl")
    met = a.join(b, (F.col("t") == F.col("t_")) | ((F.col("t") < F.col("t_")) & (F.col("i1") == F.col("i0_")) & (F.col("n1") > limit * F.col("n0_") - 1e-9)))

    def meet(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = lambda s: [batch[c + s].slice(at, 1).flatten() for c in ("i", "c", "n", "sig")]  # noqa: E731, B023
                same = batch["t"][at].as_py() == batch["t_"][at].as_py()
                (ia, ca, na, sa), (ib, cb, nb, sb) = row(""), row("_")
                p, q = close_pairs(runs(ia), na.to_numpy(), sa.to_numpy(), runs(ib), nb.to_numpy(), sb.to_numpy(), same, limit)
                for k in range(0, len(p), CALL):
                    x, y = p[k:k + CALL], q[k:k + CALL] + len(ca)
                    used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                    u, w = used[used < len(ca)], used[used >= len(ca)] - len(ca)
                    size = np.concatenate([na.to_numpy()[u], nb.to_numpy()[w]])
                    x, y = place[:len(x)], place[len(x):]
                    turned = size[y] > size[x]              # the larger set comes first
                    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                    both = lambda l, r: pa.concat_arrays([l.take(pa.array(u)), r.take(pa.array(w))])  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{batch['t'][at]} {batch['t_'][at]} {k}"]), one(both(ia, ib)), one(both(ca, cb)), one(pa.array(size, pa.int64())),
                         one(pa.array(np.where(turned, y, x), pa.int32())), one(pa.array(np.where(turned, x, y), pa.int32()))], names=["g", "i", "c", "n", "p", "q"])

    cols = [c + s for s in ("", "_") for c in ("t", "i", "c", "n", "sig")]
    return met.select(*cols).mapInArrow(meet, f"g string, i {kind['i']}, c {kind['c']}, n array<bigint>, p array<int>, q array<int>")


def _candidates(signed: DataFrame, reps: DataFrame, image: str, cand: str, limit: float) -> DataFrame:
    chosen = signed.select(F.col(image).alias("_i"), F.col(cand).alias("_c"), "n", "_sig").join(
        reps.select(F.col(image).alias("_i"), F.col("rep").alias("_c")).hint("merge"), ["_i", "_c"])
    return cut_lineage(_meetings(_tiles(chosen), limit))


def overlap_candidates(elements: DataFrame, reps: DataFrame, image: str, cand: str, elem: str, limit: float = IOU_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives that may overlap above ``limit`` (_i, first, second, n_first, n_second), and their meetings."""
    met = _candidates(signatures(elements, [image, cand], elem, limit=limit), reps, image, cand, limit)
    of = lambda name, at: F.element_at(name, F.col(f"_z.{at}") + 1)
    pairs = met.select("i", "c", "n", F.explode(F.arrays_zip("p", "q")).alias("_z")).select(
        of("i", "p").alias("_i"), of("c", "p").alias("first"), of("c", "q").alias("second"), of("n", "p").alias("n_first"), of("n", "q").alias("n_second"))
    return pairs, met


def _given(met: DataFrame, rows: DataFrame, signed: DataFrame, image: str, cand: str) -> DataFrame:
    """The sets that meetings need, packed: (h, sets) with the place ``at`` of each set and its elements ``_e``.

    Sets never travel as rows of elements: those of a bucket go there in packs, and from there to the meetings in packs.
    A bucket holds sets of about one size, as tiles do, so that a meeting gets its sets from few of them.
    """
    weight = F.sum(F.col("n") + EACH)
    steps = max(1, min(64, (signed.agg(weight).first()[0] or 0) // (8 * BUCKET)))        # classes while the size doubles
    kind = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1))) * steps).cast("int")
    full = {r["k"]: r["w"] for r in signed.groupBy(kind.alias("k")).agg(F.ceil(weight / BUCKET).alias("w")).collect()}
    ways = F.lit([max(1, full.get(k, 1)) for k in range(max(full, default=0) + 1)])
    bucket = (F.shiftleft(kind.cast("bigint"), 32) + F.pmod(F.xxhash64("i", "c"), F.element_at(ways, kind + 1))).alias("b")
    held = rows.select(F.col(image).alias("i"), F.col(cand).alias("c"), "_e", F.size("_e").alias("n")).select(bucket, "i", "c", "_e")
    needed = met.select("g", F.posexplode(F.arrays_zip("i", "c", "n")).alias("at", "_z")).select("g", "at", "_z.*").select(bucket, "g", "at", "i", "c")

    def pack(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch["b"].to_numpy()
            order = np.argsort(slots, kind="stable")
            ends = np.concatenate([[0], np.flatnonzero(np.diff(slots[order])) + 1, [len(order)]])
            sets = [packed(batch.select(["i", "c", "_e"]).take(pa.array(order[x:y])), "_e") for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(slots[order[ends[:-1]]], pa.int64()), pa.array(sets, pa.binary())], names=["b", "sets"])

    def give(one, two):
        out = []
        if one.num_rows and two.num_rows:
            have = unpacked(two["sets"].to_pylist(), "_e")
            place = {k: x for x, k in enumerate(zip(have["i"].to_pylist(), have["c"].to_pylist(), strict=True))}
            lists, one = have["_e"].combine_chunks(), one.sort_by("g").combine_chunks()
            at = np.array([place[k] for k in zip(one["i"].to_pylist(), one["c"].to_pylist(), strict=True)])
            g = one["g"].combine_chunks().dictionary_encode()
            ends = np.concatenate([[0], np.flatnonzero(np.diff(g.indices.to_numpy())) + 1, [len(g)]])
            out = [(g[int(x)].as_py(), packed(pa.table({"at": one["at"].slice(x, y - x), "_e": lists.take(pa.array(at[x:y]))}), "_e")) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([pa.array([h for h, _ in out], pa.string()), pa.array([s for _, s in out], pa.binary())], names=["h", "sets"])

    packs = held.mapInArrow(pack, "b bigint, sets binary")
    return needed.groupBy("b").cogroup(packs.groupBy("b")).applyInArrow(give, "h string, sets binary")


def _edges(rows: DataFrame, signed: DataFrame, reps: DataFrame, image: str, cand: str, limit: float) -> DataFrame:
    """Edges among representatives. A meeting gets each set that it needs once, and counts the shared elements of its pairs."""
    met = _candidates(signed, reps, image, cand, limit)
    given = _given(met, rows, signed, image, cand)
    kind = {c: met.schema[c].dataType.elementType.simpleString() for c in ("i", "c")}

    def count(one, two):
        names = ["i", "first", "second", "n_first", "n_second", "n_both"]
        if not one.num_rows:
            return pa.table({"i": pa.array([], one["i"].type.value_type), "first": pa.array([], one["c"].type.value_type), "second": pa.array([], one["c"].type.value_type),
                             "n_first": pa.array([], pa.int64()), "n_second": pa.array([], pa.int64()), "n_both": pa.array([], pa.int64())})
        i, c, n, p, q = (one[x].combine_chunks().flatten() for x in ("i", "c", "n", "p", "q"))
        lists = unpacked(two["sets"].to_pylist(), "_e").sort_by("at")["_e"].combine_chunks()
        codes = lists.flatten().dictionary_encode()
        size = n.to_numpy()
        p, q = p.to_numpy(), q.to_numpy()
        n_both = shared(codes.indices.to_numpy(), np.concatenate([[0], np.cumsum(size)]), len(codes.dictionary), p, q)
        kept = n_both / (size[p] + size[q] - n_both) > limit
        p, q, n_both = p[kept], q[kept], n_both[kept]
        return pa.table([i.take(pa.array(p)), c.take(pa.array(p)), c.take(pa.array(q)), pa.array(size[p], pa.int64()), pa.array(size[q], pa.int64()), pa.array(n_both, pa.int64())], names=names)

    both = met.groupBy("g").cogroup(given.groupBy("h")).applyInArrow(count, f"i {kind['i']}, first {kind['c']}, second {kind['c']}, n_first bigint, n_second bigint, n_both bigint")
    iou = F.col("n_both") / (F.col("n_first") + F.col("n_second") - F.col("n_both"))
    return both.withColumn("iou", iou).select(F.col("i").alias(image), "first", "second", "n_first", "n_second", "n_both", "iou")


def suppress_overlaps(elements: DataFrame, image: str, cand: str, elem: str, limit: float = IOU_LIMIT) -> DataFrame:
    """Candidates kept after dropping every one that overlaps an earlier kept candidate too much.

    Order: size falling, then candidate. Copies of one set fall to its first candidate, so they add
    no edges.
    """
    edges, classes = _found(elements, image, cand, elem, limit)
    reps = classes.filter(F.col(cand) == F.col("rep"))
    tag = lambda c: F.struct(F.col(image).alias("_i"), F.col(c).alias("_c"))
    edges = edges.select(tag("first").alias("_p"), tag("second").alias("_q"))
    nodes = reps.select(tag("rep").alias("_node"), image, cand, F.col("n").alias("n_elements"), "n_same")
    return greedy_kept(nodes, edges, "_node", "_p", "_q").select(image, cand, "n_elements", "n_same")


def _claimed_atoms(elements: DataFrame, image: str, cand: str, elem: str, order: str, limit: float) -> tuple[DataFrame, DataFrame]:
    """Claimed atoms (_i, _c, _x, _y, _w), and the atom (_x, _y) of every element (_i, _e).

    Elements of an image with the same candidates stay together whatever is decided: such an atom is one row per
    candidate with its number of elements, ``_w``. Sets of candidates are told apart by two 64-bit sums.
    """
    rows = elements.select(F.col(image).alias("_i"), F.col(cand).alias("_c"), F.col(elem).alias("_e"), F.col(order).alias("_o"))
    rows = rows.repartition("_i", "_e").distinct()      # one shuffle for the copies, the atoms and their join
    atom = rows.groupBy("_i", "_e").agg(F.bit_xor(F.xxhash64("_c")).alias("_x"), F.bit_xor(F.xxhash64("_c", F.lit(1))).alias("_y"))
    todo = cut_lineage(rows.join(atom.hint("merge"), ["_i", "_e"]).groupBy("_i", "_c", "_o", "_x", "_y").agg(F.count(F.lit(1)).alias("_w")))
    size = todo.groupBy("_i", "_c").agg(F.sum("_w").alias("_size"))
    todo = unless_large(cut_lineage(todo.join(size.hint("merge"), ["_i", "_c"]).withColumn("_taken", F.lit(False))))
    slot, turn = f"claim-{uuid.uuid4().hex}", 0
    claimed = todo.select("_i", "_c", "_x", "_y", "_w").limit(0)
    while not todo.isEmpty():
        lead = todo.groupBy("_i", "_x", "_y").agg(F.min(F.struct("_o", "_c")).alias("_lead"))
        seen = todo.join(lead, ["_i", "_x", "_y"])
        ready = seen.groupBy("_i", "_c").agg(
            F.bool_and(F.col("_lead._c") == F.col("_c")).alias("_ready"),
            (F.sum(F.when(F.col("_taken"), F.col("_w")).otherwise(0)) / F.first("_size") < limit).alias("_ok"))
        now = unless_large(cut_lineage(todo.join(ready.filter("_ready"), ["_i", "_c"]).select("_i", "_c", "_x", "_y", "_w", "_taken", "_ok")))
        got = now.filter(F.col("_ok") & ~F.col("_taken")).select("_i", "_c", "_x", "_y", "_w")
        claimed = claimed.unionByName(got)
        out = now.select("_i", "_c").distinct()
        fresh = got.select("_i", "_x", "_y", F.lit(True).alias("_new"))
        turn += 1
        todo = unless_large(cut_lineage(
            todo.join(out, ["_i", "_c"], "left_anti").join(fresh, ["_i", "_x", "_y"], "left")
            .withColumn("_taken", F.col("_taken") | F.coalesce(F.col("_new"), F.lit(False))).drop("_new"), f"{slot}-{turn % 2}"))
    return claimed, atom


def claim_elements(elements: DataFrame, image: str, cand: str, elem: str, order: str, limit: float = IOU_LIMIT) -> DataFrame:
    """Candidates in order claim unclaimed elements; one with too large a claimed share is rejected.

    Settled in rounds: a candidate is decided once every earlier candidate it shares an element with
    is decided. Returns one row per claimed element with the accepted candidate.
    """
    claimed, atom = _claimed_atoms(elements, image, cand, elem, order, limit)
    got = atom.join(claimed, ["_i", "_x", "_y"])
    return got.select(F.col("_i").alias(image), F.col("_c").alias(cand), F.col("_e").alias(elem))


def _fold_claims(rows: DataFrame, limit: float) -> DataFrame:
    """Claims of images that fit in a row (_i, _c, n_claimed): candidates one after another, in Spark expressions.

    Nothing but the given rows is shuffled, and not even those if they are dealt by image already.
    """
    sets = rows.groupBy("_i", "_c").agg(F.min("_o").alias("_o"), F.array_distinct(F.array_compact(F.flatten(F.collect_list("_e")))).alias("_s"))
    whole = sets.groupBy("_i").agg(F.array_sort(F.collect_list(F.struct("_o", "_c", "_s"))).alias("_all"))
    kind = sets.schema["_s"].dataType.simpleString()
    counts = f"array<struct<_c:{sets.schema['_c'].dataType.simpleString()},n:bigint>>"

    def claim(acc: Column, x: Column) -> Column:
        fresh = F.array_except(x["_s"], acc["have"])
        n, size = F.size(fresh), F.size(x["_s"])
        got = F.struct(F.concat(acc["have"], fresh).alias("have"), F.array_append(acc["out"], F.struct(x["_c"].alias("_c"), n.cast("bigint").alias("n"))).alias("out"))
        return F.when((n > 0) & ((size - n) / size < limit), got).otherwise(acc)

    start = F.struct(F.array().cast(kind).alias("have"), F.array().cast(counts).alias("out"))
    return whole.select("_i", F.inline(F.aggregate("_all", start, claim)["out"])).select("_i", "_c", F.col("n").alias("n_claimed"))


#: Rows times elements of an image that is worked on in one row, at most.
ONE_ROW = 1_000_000


def claimed_sizes(elements: DataFrame, image: str, cand: str, elem: str, order: str, limit: float = IOU_LIMIT, one_row: int = ONE_ROW) -> DataFrame:
    """Accepted candidates with the number of elements that ``claim_elements`` gives them, ``n_claimed``.

    ``elem`` may hold arrays of elements; ``order`` is the same in all rows of a candidate. Images up to ``one_row`` (rows times elements)
    are settled whole, without a row per element; only larger ones go through rounds.
    """
    given = elements if isinstance(elements.schema[elem].dataType, ArrayType) else elements.withColumn(elem, F.when(F.col(elem).isNotNull(), F.array(elem)))
    rows = given.select(F.col(image).alias("_i"), F.col(cand).alias("_c"), F.col(order).alias("_o"), F.col(elem).alias("_e")).filter(
        "_i is not null and _c is not null and _e is not null")
    work = F.sum(F.size("_e").cast("double")) * F.count(F.lit(1))
    large = unless_large(cut_lineage(rows.groupBy("_i").agg(work.alias("_w")).filter(F.col("_w") > one_row).select("_i")))
    if large.isEmpty():
        return _fold_claims(rows, limit).toDF(image, cand, "n_claimed")
    spread = rows.join(large, "_i", "left_semi").select("_i", "_c", "_o", F.explode("_e").alias("_e"))
    claimed, _ = _claimed_atoms(spread, "_i", "_c", "_e", "_o", limit)
    settled = claimed.groupBy("_i", "_c").agg(F.sum("_w").alias("n_claimed"))
    return settled.unionByName(_fold_claims(rows.join(large, "_i", "left_anti"), limit)).toDF(image, cand, "n_claimed")


def common_members(rows: DataFrame, member: str, source: str) -> DataFrame:
    """Every member with ``in_all``: present in each of the sources, or only in some."""
    n = rows.agg(F.count_distinct(source).alias("n")).scalar()
    return rows.groupBy(member).agg(F.count_distinct(source).alias("n_sources")).withColumn("_n", n).withColumn(
        "in_all", F.col("n_sources") == F.col("_n")).drop("_n")


def only_in(rows: DataFrame, member: str, source: str, here: Column, there: Column) -> DataFrame:
    """Members seen under ``here`` and never under ``there``."""
    a = rows.filter(here).select(member).distinct()
    b = rows.filter(there).select(member).distinct()
    return a.join(b, member, "left_anti")
