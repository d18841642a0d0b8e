"""Exact deduplication: local, salted, then global combining, with full texts compared at each stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replistat.llm.common import collapsed, packed, table, written

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def copy_groups(texts: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text of ``texts`` (__id, __t, __d): smallest id and size of its group.

    The digest chooses the task, the text itself is a grouping key in all three steps, so equal
    digests of different texts never merge. A hot digest is first reduced inside each input
    partition, then inside each of ``salts`` shares, and only one row per share and text meets
    the others.
    """
    salted = (
        texts.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)))
        .groupBy("__d", "__salt", "__t")
        .agg(F.min("__id").alias("__k"), F.count(F.lit(1)).alias("__n"))
    )
    return salted.repartition(F.col("__d")).groupBy("__d", "__t").agg(F.min("__k").alias("__k"), F.sum("__n").alias("__n"))


def tag_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256; every row stays.

    Equal: identical after each run of white space became one space. Null text counts as empty,
    so nulls and empty texts form one group, and a text of white space only equals " ". The row
    with the smallest id stays; null ids lose to any other. Of rows that repeat both id and text
    one stays. A group of null ids only has keep_id null and one kept row. An empty table gives
    an empty result. Input columns named as the result columns are replaced, others pass through.
    """
    rows = docs.drop(*RESULT).withColumns({"__id": F.col(id_col), "__t": collapsed(F.col(text_col))})
    rows = rows.withColumn("__d", digest(F.col("__t")))
    groups = copy_groups(rows.select("__id", "__t", "__d"), salts)
    classes = written(groups.groupBy("__d").agg(F.min("__k").alias("keep_id"), F.sum("__n").alias("group_size"), F.count(F.lit(1)).alias("__texts")))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__id", "__d", F.xxhash64("__t")).orderBy("__id")))
    one = classes.filter("__texts = 1").drop("__texts")
    tagged = rows.join(one, "__d")
    if not classes.filter("__texts > 1").isEmpty():
        # digests that stand for several texts: the same work, keyed by the texts themselves
        clash = classes.filter("__texts > 1").select("__d")
        apart = groups.join(clash, "__d", "left_semi").select("__d", "__t", F.col("__k").alias("keep_id"), F.col("__n").alias("group_size"))
        tagged = tagged.unionByName(rows.join(apart, ["__d", "__t"]))
    return tagged.withColumns({
        "kept": F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__r") == 1),
        "text_sha256": F.col("__d") if digest is sha256 else sha256(F.col("__t")),
    }).drop("__id", "__t", "__d", "__r")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return tag_copies(packed(docs, id_col, text_col), id_col, text_col, salts).filter("kept").select("__row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tag_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE = {
    "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n""",
}
