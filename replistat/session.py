"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "replistat", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is only given for local runs and tests."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: what the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a scratch folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before iterative operators")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame, slot: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return the reloaded frame.

    Plans stay short, the work is done once, and a lost executor costs nothing that is already
    written. Iterative operators pass two ``slot`` names in turn, so they keep two copies at most.
    """
    path = f"{scratch(df.sparkSession)}/{slot or 'cut-' + uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unless_large(stored: DataFrame, rows: int = 100_000) -> DataFrame:
    """A stored table that Spark may broadcast only if it has at most ``rows`` rows.

    Size checks go by the compressed files, which says little about rows in memory. The count comes from file footers.
    """
    return stored if stored.count() <= rows else stored.hint("merge")
