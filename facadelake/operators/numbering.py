"""Defect numbers in detection order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hotkeys import ranked


def number_phased(defects: DataFrame, by: str, order: Sequence[str], bucket: Column, out: str = "defect_id") -> DataFrame:
    """``DEFECT-001`` upwards per key, counted after the confidence filter."""
    numbered = ranked(defects, [by], order, bucket, "__rank")
    return numbered.withColumn(out, F.format_string("DEFECT-%03d", "__rank")).drop("__rank")


def number_flat(defects: DataFrame, building: str, cycle: str, ordinal: str, out: str = "defect_id") -> DataFrame:
    """``{building}_C{cycle}_{0000}`` with the zero-based detection ordinal, counted before the filter."""
    return defects.withColumn(
        out, F.concat(F.col(building).cast("string"), F.lit("_C"), F.col(cycle).cast("string"), F.lit("_"), F.format_string("%04d", ordinal))
    )
