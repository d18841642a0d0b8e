"""Comparison of finished runs, from run tables to comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.runs import (ablation_rows, ablation_summary, factorial_effects, family_spread, identical_runs,
                              image_deltas, metrics_by_run, robustness, run_totals, select_runs, spread_by_material)


def compare(per_image: DataFrame, runs: Sequence[str], summary: DataFrame | None = None, names=None, scope: str = "full") -> dict[str, DataFrame]:
    """Deltas per image, totals per run, spread per material, identical runs, metrics by run."""
    rows = select_runs(per_image, "run", names, scope)
    deltas = image_deltas(rows, runs)
    out = {"deltas": deltas, "totals": run_totals(rows), "spread": spread_by_material(deltas), "identical": identical_runs(rows),
           "top": deltas.filter("rank <= 10").orderBy("rank")}
    if summary is not None:
        out["metrics"] = metrics_by_run(select_runs(summary, "run", names, scope), runs, {
            "density_all": F.col("mean_nuclei_per_mm2_all"), "density_clean": F.col("mean_nuclei_per_mm2_clean"),
            "median_nuc_vol": F.col("median_nuclear_volume_um3"), "flag_rate": F.col("flagged_image_rate")})
    return out


def compare_families(qc: DataFrame, features: DataFrame, original: Sequence[str], processed: Sequence[str]) -> dict[str, DataFrame]:
    """Factorial ablation rows, their summary and effects, and the robustness of two run families."""
    rows = ablation_rows(qc, features)
    summary = ablation_summary(rows, "n_nuclei", "n_nuclei_raw", "nuclei_per_mm2", "median_nuclear_volume_um3", "flag_any", "flags_list")
    full = rows.filter(F.col("scope") == "full")
    return {"rows": rows, "summary": summary, "effects": factorial_effects(full, "arm", "n_nuclei", "flag_any"),
            "robustness": robustness(family_spread(features, original, processed))}
