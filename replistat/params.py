"""Default parameters of the analyses, as frozen dataclasses.

The numbers are fixed values: results are only comparable when they are kept.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ObjectGate:
    min_d_um: float = 40.0
    max_d_um: float = 1500.0
    min_pass_d_um: float = 40.0
    max_pass_d_um: float = 1200.0
    border_margin_px: int = 15
    ring_radius_px: int = 15
    ring_contrast_factor: float = 0.90
    max_area_share: float = 0.25
    min_circularity: float = 0.65
    min_solidity: float = 0.85
    max_eccentricity: float = 0.82
    max_objects_per_image: int = 0

    @property
    def min_contrast(self) -> float:
        return 1.0 - self.ring_contrast_factor


@dataclass(frozen=True)
class PairGate:
    radius_factor: float = 1.5
    min_displacement_px: float = 50.0
    min_d0_um: float = 60.0
    min_fold_change: float = 0.10
    max_fold_change: float = 20.0


@dataclass(frozen=True)
class Inference:
    control: str = "Mat"
    n_boot: int = 2000
    n_perm: int = 10000
    level: float = 0.95
    seed: int = 42
    include_review: bool = False
    exact_limit: int = 2000
    low_unit_limit: int = 3


@dataclass(frozen=True)
class FieldQC:
    snr_min: float = 1.5
    min_volume_um3: float = 150.0
    max_volume_um3: float = 4000.0
    border_margin_px: int = 5
    edge_share_max: float = 0.25
    saturation_max: float = 0.005
    iqr_factor: float = 1.5
    min_group: int = 3


@dataclass(frozen=True)
class SizeGate:
    reference_um3: float | None = None
    min_um3: float | None = None
    max_um3: float | None = None
    min_multiplier: float = 0.25
    max_multiplier: float = 4.0
    split_factor: float = 2.0
    border_um: float = 5.85

    def bounds(self) -> dict:
        """Resolved lower and upper bound with the text that says where each came from."""
        out: dict = {}
        for side, given, mult in (
            ("min", self.min_um3, self.min_multiplier),
            ("max", self.max_um3, self.max_multiplier),
        ):
            ref = self.reference_um3
            value = given if given is not None else (mult * ref if ref is not None else None)
            out[side] = value
            out[side + "_source"] = "config" if given is not None else f"derived: {mult} x reference_vol_um3"
            out[side + "_multiplier"] = round(value / ref, 4) if value is not None and ref else None
        return out


DUPLICATE_DISTANCE_PX = 35.0
DUPLICATE_DISTANCE_UM = 35.0 * 1.518817
DEFAULT_PIXEL_UM = 1.518817
DEFAULT_FIELD_PIXEL_UM = 0.5050492474122553
MIN_EXTENT_PX = 100
IOU_LIMIT = 0.50
