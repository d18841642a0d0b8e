"""Timepoints, conditions and file names as column expressions.

Nothing raises: a name that cannot be read gives NULL fields and a reason code, so one bad
file never stops a job over millions of names.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import bind, regex_groups

# The accepted spellings.
TIMEPOINT = r"(?i)^(?:(?:day|d|t)\s*)?(\d+)$"
COPY_SUFFIX = r"(?i)(?:\s*\(\d+\)|[ _-]+copy(?:[ _]*\d+)?)$"
NAME_TAIL = r"[ _]+gel[ _]?(\d+)[ _](\d+)[ _]TRANS$"
DAY_NAME = r"(?i)^(?:day|d)[ _]?(\d+)[ _]+(.+?)" + NAME_TAIL
DAYLESS_NAME = r"(?i)^(.+?)" + NAME_TAIL
STIFFNESS = r"(?i)^S(\d+)(?:D(\d+))?$"
PLAIN_TOKEN = r"^[A-Za-z0-9-]+$"
CONTROL = "Mat"
CHANNEL_NAME = r"(?i)^(.+)_ch(\d{2})\.tiff?$"
FIELD_NAME = (
    r"^(\S+)\s+Spheroid\s+D(\d+(?:\.\d+)?)(?:\s+([^_]+?))?\s*_"
    r"([A-Za-z0-9][A-Za-z0-9._]*?)-([Gg]el\d+)(?:-(.+))?$"
)
NUCLEAR, ACTIN = "00", "02"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def parse_timepoint(text) -> Column:
    """Day number of ``day 7`` / ``D7`` / ``t7`` / ``7``; NULL when the text is anything else."""
    return _group(F.trim(_col(text)), TIMEPOINT, 1).cast("bigint")


def is_baseline(text) -> Column:
    return parse_timepoint(text) == 0


def normalise_condition(raw) -> Column:
    """Canonical condition, or NULL when it is empty or ambiguous."""
    def decide(text: Column) -> Column:
        def with_joined(joined: Column) -> Column:
            single = text == joined
            return (
                F.when(joined == "", F.lit(None).cast("string"))
                .when(single & (F.lower(joined) == CONTROL.lower()), F.lit(CONTROL))
                .when(joined.rlike(STIFFNESS), F.upper(joined))
                .when(single & joined.rlike(PLAIN_TOKEN), joined))
        return bind(F.regexp_replace(text, r"[ _]+", ""), with_joined)
    return bind(F.regexp_replace(_col(raw), r"^[\s_]+|[\s_]+$", ""), decide)


def file_stem(path) -> Column:
    """Last path part without its extension, trimmed."""
    name = F.regexp_extract(_col(path), r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def zero_padded(number: Column, width: int) -> Column:
    text = number.cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def parse_stem(stem, folder_timepoint=None) -> Column:
    """Struct of the metadata in an image name.

    ``error`` is NULL on success, else ``copy_suffix``, ``unmatched`` or ``ambiguous_condition``;
    the copy test comes first so a duplicated file can never be paired twice.
    """
    if folder_timepoint is None:
        folder_day = F.lit(None).cast("string")
    else:
        folder_day = parse_timepoint(folder_timepoint).cast("string")

    def read(s: Column) -> Column:
        with_day = regex_groups(s, DAY_NAME, 4)
        without = bind(regex_groups(s, DAYLESS_NAME, 3), lambda g: F.when(
            g.isNotNull() & folder_day.isNotNull(), F.concat(F.array(folder_day), g)))
        return bind(F.coalesce(with_day, without), lambda g: bind(normalise_condition(g[1]), lambda c: record(s, g, c)))

    def record(s: Column, g: Column, condition: Column) -> Column:
        error = (
            F.when(s.rlike(COPY_SUFFIX), "copy_suffix")
            .when(g.isNull(), "unmatched")
            .when(condition.isNull(), "ambiguous_condition"))
        whole = F.struct(g[0].try_cast("bigint").alias("day"),
                         F.concat(F.lit("gel"), g[2].try_cast("bigint").cast("string")).alias("replicate"),
                         zero_padded(g[3].try_cast("bigint"), 4).alias("fov"), error.alias("error"))

        def fields(w: Column) -> Column:
            ok = w["error"].isNull()
            return F.struct(
                F.when(ok, s).alias("image_id"),
                F.when(ok, F.concat(F.lit("t"), w["day"].cast("string"))).alias("timepoint"),
                F.when(ok, w["day"]).alias("timepoint_day"),
                F.when(ok, condition).alias("condition"),
                F.when(ok, w["replicate"]).alias("replicate"),
                F.when(ok, w["fov"]).alias("fov"),
                F.when(ok, F.concat_ws("_", condition, w["replicate"], w["fov"])).alias("pair_key"),
                w["error"].alias("error"))
        return bind(whole, fields)

    return bind(F.trim(_col(stem)), read)


def parse_channel(name) -> Column:
    """Struct ``base, channel`` of ``<base>_chNN.tif``; both NULL for other names."""
    n = _col(name)
    return F.struct(_group(n, CHANNEL_NAME, 1).alias("base"), _group(n, CHANNEL_NAME, 2).alias("channel"))


def parse_field(base) -> Column:
    """Struct of the parts of a two-channel field name; all NULL when the name does not fit."""
    return bind(regex_groups(_col(base), FIELD_NAME, 6), lambda g: F.struct(
        g[0].alias("cell_line"),
        g[1].alias("day"),
        g[3].alias("material"),
        g[4].alias("replicate"),
        F.when(g.isNotNull(), F.coalesce(F.nullif(g[5], F.lit("")), F.lit("1"))).alias("subfield")))
