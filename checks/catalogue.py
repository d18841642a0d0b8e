"""All registered queries."""

from . import columns_q, gates_q, joins_q, rasters_q, resample_q, rollup_q, runs_q  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
