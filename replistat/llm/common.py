"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the result contracts: white space is space and the five ASCII controls, a word is all else.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a local session without it gets a scratch folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    ``path`` is a slot that may be overwritten; rounds alternate between two slots, so that a
    loop keeps two copies of its state, however long it runs.
    """
    path = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collapsed(text: Column) -> Column:
    """Every run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def word_count(text: Column) -> Column:
    """Number of words, from the single spaces of the collapsed text."""
    t = F.trim(collapsed(text))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The whole row as struct ``__row`` beside the columns an operator needs, so that no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *columns)


def chosen_ids(df: DataFrame, id_col: str, most: int, *by: str) -> DataFrame:
    """At most ``most`` ids (column __id) per value of ``by``, the first by hash; null ids are left out.

    Ids fall into up to 64 shares by hash and each share gives its part, so no group is ranked in one
    task; Spark's group limit drops the rest before the shuffle.
    """
    shares = min(64, most)
    thin = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), *by).withColumn("__h", F.xxhash64(F.col("__id").cast("string")))
    order = Window.partitionBy(*by, F.pmod("__h", F.lit(shares))).orderBy("__h", "__id")
    return thin.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most // shares).select("__id", *by).distinct()


def row_key(id_: Column, text: Column) -> Column:
    """Identity of a row by id and text, without nulls inside, ordered by id with null ids last."""
    return F.struct(id_.isNull().alias("missing"), F.coalesce(id_.cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("hash"))
