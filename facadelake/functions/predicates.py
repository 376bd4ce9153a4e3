"""Row predicates of the readers and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import lookup


def confident(threshold: float, conf: str = "confidence") -> Column:
    return F.coalesce(F.col(conf), F.lit(0.0)) >= threshold


def for_org(df: DataFrame, org_id, org_col: str = "org_id") -> DataFrame:
    """Tenant isolation: the first filter of every reader, so that it reaches the scan."""
    return df.where(F.col(org_col) == F.lit(org_id))


def not_deleted(deleted: str = "deleted_at") -> Column:
    return F.col(deleted).isNull()


def defect_predicate(type: str | None = None, severity: str | None = None, propagated_only: bool = False,
                     severity_col: str = "severity", matched_col: str = "matched_previous_id") -> Column:
    keep = F.lit(True)
    if type:
        keep = keep & (F.col("type") == type)
    if severity:
        keep = keep & (F.col(severity_col) == severity)
    if propagated_only:
        keep = keep & F.col(matched_col).isNotNull()
    return keep


def type_contains(text: str, type_col: str = "type") -> Column:
    return F.lit(True) if text == "all" else F.lower(F.col(type_col)).contains(text.lower())


def is_propagated(status: str = "temporal_status", growth: str = "growth_rate_mm_per_month") -> Column:
    return F.coalesce(F.col(status) == "propagated", F.lit(False)) | F.coalesce(F.col(growth) > 0, F.lit(False))


def is_active(flag: str = "is_false_positive") -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False))


def needs_rebar_analysis(subtype: str = "crack_subtype", area: str = "area_cm2") -> Column:
    return (F.coalesce(F.col(subtype), F.lit("")) == "corrosion_induced") | (
        F.coalesce(F.col(area), F.lit(0.0)) >= 50.0
    )


# Accepted names of the two measurement methods.
METHOD_ALIASES = {
    "geometry": "trigonometry",
    "trig": "trigonometry",
    "coin_flip": "trigonometry",
    "estimate": "trigonometry",
    "computer_vision": "cv",
    "cv_segmentation": "cv",
    "segmentation": "cv",
    "yolo": "cv",
}


def normalize_method(method: Column | str) -> Column:
    c = F.col(method) if isinstance(method, str) else method
    name = F.lower(F.trim(F.coalesce(c, F.lit("trigonometry"))))
    return F.when(name == "cv", "cv").otherwise(lookup(METHOD_ALIASES, name, "trigonometry"))
