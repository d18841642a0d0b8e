"""Skip work that is already done: content-addressed keys and an anti-join against the results.

A key covers the input's content hash, the parameters that matter, the model and the version, so
changed parameters recompute and renamed files do not. Works on a batch table and, unchanged, on
each micro-batch of a stream through ``foreachBatch``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F


def canonical(params: dict) -> str:
    """Parameters as JSON with sorted keys and floats at six digits."""
    def clean(v):
        if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
            return v
        if isinstance(v, float):
            if math.isnan(v):
                return "nan"
            return ("inf" if v > 0 else "-inf") if math.isinf(v) else round(v, 6)
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [clean(x) for x in v]
        if isinstance(v, (set, frozenset)):
            return sorted((clean(x) for x in v), key=lambda x: json.dumps(x, sort_keys=True))
        return str(v)
    return json.dumps(clean(params), sort_keys=True, separators=(",", ":"))


def work_key(content_hash: Column, params: dict, model: str = "none", version: str = "0") -> Column:
    h = lambda text: F.sha2(F.lit(text), 256)
    return F.sha2(F.concat(
        F.lit("img:"), content_hash, F.lit("|params:"), h(canonical(params)), F.lit("|model:"), h(model),
        F.lit("|pkg:"), h(version)), 256)


def pending(inputs: DataFrame, done: DataFrame, key: str = "work_key") -> DataFrame:
    """Inputs whose key has no stored result."""
    return inputs.join(done.select(key), key, "left_anti")


def run_fingerprint(fields: DataFrame, run: Sequence[str], columns: Sequence[str], params: dict, model: str = "none") -> DataFrame:
    """One fingerprint per run over the settings and the content of all its inputs, in any row order.

    Rows are hashed one by one and the hashes are added up, so no run gathers its rows in a task.
    """
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns]))
    low, high = F.conv(F.substring(row, 1, 8), 16, 10), F.conv(F.substring(row, 9, 8), 16, 10)
    s = fields.groupBy(*run).agg(F.sum(low.cast("decimal(38,0)")).alias("_a"), F.sum(high.cast("decimal(38,0)")).alias("_b"),
                                 F.count(F.lit(1)).alias("n_inputs"))
    text = F.concat_ws("|", F.lit(canonical(params)), F.lit(model), F.col("n_inputs").cast("string"), F.col("_a").cast("string"), F.col("_b").cast("string"))
    return s.select(*run, "n_inputs", F.sha2(text, 256).alias("fingerprint"))


def complete_runs(fingerprints: DataFrame, markers: DataFrame, run: Sequence[str]) -> DataFrame:
    """Runs whose stored marker carries the same fingerprint."""
    return fingerprints.join(markers.select(*run, "fingerprint"), [*run, "fingerprint"], "left_semi")


def process_new(batch: DataFrame, store: str, compute, key: str = "work_key") -> None:
    """Compute and append only what the parquet table ``store`` lacks.

    The append commits whole, so a failed attempt stores nothing and is simply tried again.
    """
    spark = batch.sparkSession
    try:
        todo = pending(batch, spark.read.parquet(store), key)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        todo = batch      # nothing is stored yet
    compute(todo).write.mode("append").parquet(store)
