"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replistat.llm.common import packed, table, word_count, written

#: Shares of the shuffle order and of virtual time over which prefix sums are taken in two steps.
ORDER_PARTS, TIME_PARTS = 4096, 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Water filling over (source, source_size): target = min(most * size, level * weight).

    The table has one row per source, so the windows over all of it stay small. Sources fill up in
    the order of limit / weight; the level is fixed at the first source that it leaves open.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    w = w.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    w = w.withColumn("room", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("room") / F.col("w"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(share)
    w = w.withColumn("level", (budget - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("w").over(after))
    w = w.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "i", "level"))).over(everything)["level"])
    return w.select("source", "source_size", F.coalesce(F.least("room", F.col("level") * F.col("w")), F.col("room")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = (5, 2, 1),
        share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """``docs`` with source_size, target and taken (words the mix takes, repeats counted).

    ``size_col`` holds the words of a document (long, not null). A source plays its documents in the
    order of md5(seed:id), ``most`` times over. The copy that ends after c words of its source has
    virtual finish time c / target. Copies that begin before time 1 are taken in the order of their
    finish, over all sources, while the total budget lasts. Whole copies only, so a source misses its
    target by about one document.

    Null source: a source of its own, last in order. Null or repeated ids: each row is a document of
    its own. Documents without words and sources without words take nothing. An empty table gives an
    empty result. Input columns named as the result columns are replaced, others pass through.

    The input is written once, thin or not, so that row numbers hold. Prefix sums run over (source,
    part of the hash order) first and over the few part totals then, so a source with most of all
    rows is spread over ORDER_PARTS shares. Only the part of virtual time in which the budget ends is
    put in full order.
    """
    base = written(docs.drop("source_size", "target", "taken").withColumns({
        "__row_no": F.monotonically_increasing_id(), "__src": F.col(source_col), "__n": F.col(size_col), "__key": F.col(id_col),
        "__h": F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")),
    }))
    thin = base.select("__row_no", F.col("__src").alias("source"), F.col("__n").alias("size"), "__h", "__key")
    thin = thin.withColumn("__part", (F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * ORDER_PARTS / F.lit(2**32)).cast("long"))

    parts = thin.groupBy("source", "__part").agg(F.sum("size").alias("__s"))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__ahead", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    sizes = parts.groupBy("source").agg(F.sum("__s").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, most))

    both = thin.alias("a").join(parts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.__part") == F.col("b.__part")))
    both = both.select("a.*", "b.__ahead")
    within = Window.partitionBy("source", "__part").orderBy("__h", "__key", "size", "__row_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.withColumn("__end", F.col("__ahead") + F.sum("size").over(within)).alias("a").join(
        targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select("a.*", "t.source_size", "t.target")
    ends = written(ends.drop("__ahead", "__part"))

    turn = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("__turn")
    copies = ends.filter("size > 0 AND target > 0").select("*", turn).withColumn("__c", F.col("__end") + F.col("__turn") * F.col("source_size"))
    copies = copies.filter(F.col("__c") - F.col("size") < F.col("target")).withColumn("__v", F.col("__c") / F.col("target"))
    copies = copies.withColumn("__t", F.least((F.col("__v") * TIME_PARTS).cast("long"), F.lit(2 * TIME_PARTS)))
    upto = Window.orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    times = copies.groupBy("__t").agg(F.sum("size").alias("__s")).withColumn("__sum", F.sum("__s").over(upto))
    budget = (sizes.agg(F.sum("source_size")).first()[0] or 0) * share
    last = times.filter(F.col("__sum") > budget).agg(F.min(F.struct("__t", (F.col("__sum") - F.col("__s")).alias("base"))).alias("m")).first()["m"]
    cut, ahead = (last["__t"], last["base"]) if last else (2 * TIME_PARTS + 1, 0)

    run = Window.orderBy("__v", F.col("source").asc_nulls_last(), "__turn", "__h", "__key", "size", "__row_no").rowsBetween(Window.unboundedPreceding, 0)
    edge = copies.filter(F.col("__t") == cut).withColumn("__run", F.sum("size").over(run) + F.lit(ahead)).filter(F.col("__run") <= budget)
    taken = copies.filter(F.col("__t") < cut).select("__row_no", "size").unionByName(edge.select("__row_no", "size"))
    taken = taken.groupBy("__row_no").agg(F.sum("size").alias("taken"))
    out = base.join(ends.select("__row_no", "source_size", "target"), "__row_no").join(taken, "__row_no", "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0))).drop("__row_no", "__src", "__n", "__h", "__key")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents the mix takes, with their columns and ``copies``, how often each is played."""
    rows = packed(docs, "doc_id", "source", "text").withColumn("size", word_count(F.col("text"))).drop("text")
    return mix(rows).filter("taken > 0").select("__row.*", (F.col("taken") / F.col("size")).cast("int").alias("copies"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_source_mixing": op3_source_mixing}
ORACLE = {
    "op3_source_mixing": r"""
WITH d AS (SELECT doc_id, source, md5('mix' || coalesce(':' || CAST(doc_id AS VARCHAR), '')) AS h,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS room, source_size * 2.0::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
        - coalesce(sum(room) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(room, (SELECT level FROM f) * w), room) AS target FROM r),
e AS (SELECT d.*, t.source_size, t.target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, c + n * source_size AS fin, (c + n * source_size) / target AS v FROM e, (VALUES (0), (1)) x(n)
      WHERE size > 0 AND c + n * source_size - size < target),
g AS (SELECT doc_id, size, sum(size) OVER (ORDER BY v, source NULLS LAST, n, h, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM k),
b AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM g WHERE run <= (SELECT sum(size) FROM d) * 1.5 GROUP BY doc_id)
SELECT e.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM e LEFT JOIN b ON e.doc_id = b.doc_id""",
}
