"""Camera profiles: a fixed dimension of seven rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facadelake.functions.geometry import literal_table

# Sensor and lens data per camera; the custom row is filled by the caller.
PROFILES = [
    ("dji_phantom_4_pro", "DJI Phantom 4 Pro", 13.2, 8.8, 8.8, 5472, 3648),
    ("dji_mavic_3", "DJI Mavic 3", 17.3, 13.0, 12.29, 5280, 3956),
    ("dji_mavic_2_pro", "DJI Mavic 2 Pro", 13.2, 8.8, 10.26, 5472, 3648),
    ("dji_mini_3_pro", "DJI Mini 3 Pro", 9.7, 7.3, 6.72, 4032, 3024),
    ("dji_air_2s", "DJI Air 2S", 13.2, 8.8, 8.4, 5472, 3648),
    ("autel_evo_ii_pro", "Autel EVO II Pro", 13.2, 8.8, 10.3, 5472, 3648),
    ("custom", "Custom Camera", None, None, None, None, None),
]
DEFAULT_PROFILE = "dji_phantom_4_pro"
SCHEMA = (
    "profile string, profile_name string, sensor_width_mm double, sensor_height_mm double, "
    "focal_length_mm double, image_width_px int, image_height_px int"
)
FIELDS = ["sensor_width_mm", "sensor_height_mm", "focal_length_mm", "image_width_px", "image_height_px"]


def camera_profiles(spark: SparkSession) -> DataFrame:
    return literal_table(spark, PROFILES, SCHEMA)


def resolve_profile(frames: DataFrame, profile_col: str = "camera_profile", default: str = DEFAULT_PROFILE) -> DataFrame:
    """Named profile where it is known, else the default; values on the frame win over both.

    The dimension has seven fixed rows, so it is broadcast, and the default is a literal.
    """
    known = camera_profiles(frames.sparkSession).select(
        F.col("profile").alias("__profile"), *[F.col(f).alias(f"__{f}") for f in FIELDS]
    )
    fallback = dict(zip(["profile", "profile_name", *FIELDS], next(p for p in PROFILES if p[0] == default)))
    joined = frames.join(F.broadcast(known), frames[profile_col] == known["__profile"], "left")
    named = F.col("__profile").isNotNull()
    resolved = []
    for f in FIELDS:
        value = F.when(named, F.col(f"__{f}")).otherwise(F.lit(fallback[f]))
        if f in frames.columns:
            value = F.coalesce(F.col(f), value)
        resolved.append(value.alias(f))
    keep = [c for c in frames.columns if c not in FIELDS]
    return joined.select(*keep, F.coalesce("__profile", F.lit(default)).alias("resolved_profile"), *resolved)
