"""Significance codes, run-name labels and display orders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
STAR_STEPS = ((0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*"))
SUBSET_SUFFIX = "_subset"
ARMS = ("PP00", "PP10", "PP01", "PP11")
ARM_TOKEN = r"(?<![A-Za-z0-9])(PP00|PP10|PP01|PP11)(?![0-9])"
CONDITION_ORDER = ("Mat", "S34D30", "S40D30", "S43D20", "S46D10", "S50")
ARTIFACT_FLAGS = ("empty_seg", "dup_masks", "debris_or_merged", "edge_heavy", "saturated", "blurry", "low_snr")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stars(p, levels: int = 4, null_label: str = "untested") -> Column:
    """Star code of a p-value; ``levels`` is 3 or 4 and ``null_label`` names the untested case."""
    p = _col(p)
    out = F.when(p.isNull() | F.isnan(p), F.lit(null_label))
    for limit, text in STAR_STEPS[len(STAR_STEPS) - levels:]:
        out = out.when(p < limit, F.lit(text))
    return out.otherwise(F.lit("ns"))


def run_scope(run) -> Column:
    return F.when(_col(run).endswith(SUBSET_SUFFIX), F.lit("subset")).otherwise(F.lit("full"))


def ablation_arm(run) -> Column:
    """Factorial arm named in a run's slug as a token of its own; NULL if there is none."""
    return F.nullif(F.regexp_extract(_col(run), ARM_TOKEN, 1), F.lit(""))


def subset_slug(run) -> Column:
    run = _col(run)
    return F.when(run.endswith(SUBSET_SUFFIX), run).otherwise(F.concat(run, F.lit(SUBSET_SUFFIX)))


def run_slug(slug, index, name, scope) -> Column:
    """Directory name of a run: its slug, else ``NNN_name``, with the suffix for a subset run."""
    number = F.lpad(_col(index).cast("string"), 3, "0")
    base = F.coalesce(F.nullif(_col(slug), F.lit("")),
                      F.concat(number, F.lit("_"), F.coalesce(_col(name), F.lit("run"))))
    return F.when(_col(scope) == "subset", subset_slug(base)).otherwise(base)


def known_first(value, known=CONDITION_ORDER) -> Column:
    """Sort position: listed names in their order, every other name after them."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), _col(value))
    return F.when(place > 0, place).otherwise(F.lit(len(known) + 1)).cast("bigint")


def timepoint_order(value) -> Column:
    """Sort key of a timepoint: by day number (t0, t7, t10, ...), unreadable names last."""
    v = _col(value)
    day = F.regexp_extract(F.lower(v.cast("string")), r"(\d+)", 1).try_cast("bigint")
    return F.struct(day.isNull().alias("unreadable"), F.coalesce(day, F.lit(0)).alias("day"), v.alias("name"))


def flag_severity(flags, sep: str = ";") -> Column:
    """Number of artifact flags in a flag list (outlier flags do not count)."""
    kept = F.filter(F.split(_col(flags), sep), lambda f: f.isin(*ARTIFACT_FLAGS))
    return F.size(kept).cast("bigint")
