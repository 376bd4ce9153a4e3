"""Frozen thresholds shared by the operators. Every operator also takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    laplacian_min: float = 100.0
    intensity_min: float = 30.0
    altitude_sigma: float = 2.0
    gap_multiplier: float = 3.0
    confidence_a: float = 0.50
    confidence_b: float = 0.45
    iou_propagated: float = 0.30
    iou_new: float = 0.10
    centroid_tolerance_px: float = 25.0
    elapsed_months: float = 6.0
    false_positive_threshold: float = 0.75
    gps_rmse_target_m: float = 0.5
    grid_spacing_px: int = 500
    area_tolerance: float = 0.02
    nominal_gsd_cm: float = 0.15
    patch_px: int = 96
    upsample_target: int = 600


DEFAULTS = Thresholds()
