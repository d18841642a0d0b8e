"""Run tables in, result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.runs import select_runs
from ..schema import DECISIONS


def read_runs(spark: SparkSession, root: str, names=None, scope: str = "full", fmt: str = "parquet",
              schema: T.StructType | None = None) -> DataFrame:
    """One table over all runs, stored as ``root/run=<name>/``; the run filter prunes directories."""
    reader = spark.read.format(fmt).option("basePath", root)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return select_runs(reader.load(root), "run", names, scope)


def read_run_folders(spark: SparkSession, glob: str, pattern: str, schema: T.StructType, names=None, scope: str = "full") -> DataFrame:
    """CSV files that lie in one folder per run; the run name is cut from the file path."""
    rows = spark.read.schema(schema).option("header", True).csv(glob)
    return select_runs(rows.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)), "run", names, scope)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns in order; absent ones become NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_table(df: DataFrame, path: str, schema: T.StructType, fmt: str = "parquet", partition_by=(), mode: str = "overwrite") -> None:
    w = conform(df, schema).write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def decisions(df: DataFrame, step: str, from_backend, to_backend, reason, outcome: str, details=None, image: str = "image_id") -> DataFrame:
    """Decision rows in the audit-log layout; ``details`` is a column that becomes JSON text."""
    text = F.to_json(details) if details is not None else F.lit("{}")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return conform(df.select(
        stamp.alias("timestamp"), F.col(image).cast("string").alias("image_id"), F.lit(step).alias("step"), from_backend.alias("from_backend"),
        to_backend.alias("to_backend"), reason.alias("reason"), F.lit(outcome).alias("outcome"), text.alias("details")), DECISIONS)


def append_decisions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """The log with its free-form details as a variant."""
    return spark.read.schema(DECISIONS).json(path).withColumn("details", F.try_parse_json("details"))
