"""Quality gates of a flight: per frame, then per flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facadelake.config import DEFAULTS

from .hotkeys import exact_median, previous_value, time_bucket

NO_SCALE = (
    "CRITICAL WARNING: No GPS coordinate or altitude scale reference found in image EXIF. "
    "Scale markers must be present for correct calibration. Reshoot suggested."
)


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def quality_gate(frames: DataFrame, lap_min: float = DEFAULTS.laplacian_min, mean_min: float = DEFAULTS.intensity_min) -> DataFrame:
    """Blur and exposure flags, the failed quality they imply, and one formatted warning each."""
    blurry = F.coalesce(F.col("laplacian_variance") < lap_min, F.lit(False))
    dark = F.coalesce(F.col("mean_intensity") < mean_min, F.lit(False))
    notes = F.array_compact(
        F.array(
            F.when(blurry, F.format_string(f"Blurry: Laplacian variance %.1f < {_number(lap_min)}", "laplacian_variance")),
            F.when(dark, F.format_string(f"Underexposed: mean intensity %.1f < {_number(mean_min)}", "mean_intensity")),
        )
    )
    had = frames.columns
    passed = ~(blurry | dark)
    return frames.withColumns(
        {
            "is_blurry": blurry,
            "is_underexposed": dark,
            "quality_passed": F.col("quality_passed") & passed if "quality_passed" in had else passed,
            "warnings": F.concat("warnings", notes) if "warnings" in had else notes,
        }
    )


def missing_field_warnings() -> Column:
    no_gps = F.col("gps_latitude").isNull() | F.col("gps_longitude").isNull()
    no_altitude = F.col("relative_altitude").isNull() & F.col("gps_altitude").isNull()
    return F.array_compact(
        F.array(
            F.when(no_gps, F.lit("Missing GPS coordinates")),
            F.when(F.col("focal_length_mm").isNull(), F.lit("Missing focal length")),
            F.when(no_altitude, F.lit("Missing altitude data")),
            F.when(no_gps & no_altitude, F.lit(NO_SCALE)),
        )
    )


def clean_frames(frames: DataFrame, observation=None) -> DataFrame:
    """Frames that passed. An ``Observation`` collects the counts in the same pass."""
    if observation is not None:
        frames = frames.observe(
            observation,
            F.count_if(F.col("quality_passed")).alias("passed"),
            F.count_if(~F.col("quality_passed")).alias("rejected"),
        )
    return frames.where("quality_passed")


def altitude_anomaly(frames: DataFrame, sigma: float = DEFAULTS.altitude_sigma, flight: str = "flight_id") -> DataFrame:
    """Frames further than ``sigma`` sample deviations from their flight's median altitude.

    A flight uses its relative altitudes if it has any, else the GPS altitudes; fewer than three
    values or no spread flag nothing. Per flight only one row of statistics meets the frames.
    """
    has_relative = frames.groupBy(flight).agg(F.max(F.col("relative_altitude").isNotNull()).alias("__rel"))
    chosen = frames.join(has_relative, flight).withColumn(
        "__alt", F.when(F.col("__rel"), F.col("relative_altitude")).otherwise(F.col("gps_altitude")).cast("double")
    )
    spread = chosen.groupBy(flight).agg(F.count("__alt").alias("__n"), F.stddev_samp("__alt").alias("__std"))
    stats = spread.join(exact_median(chosen, [flight], "__alt", "__median"), flight, "left")
    odd = F.coalesce(
        (F.col("__n") >= 3) & (F.col("__std") > 0) & (F.abs(F.col("__alt") - F.col("__median")) > F.col("__std") * sigma),
        F.lit(False),
    )
    out = chosen.join(stats, flight, "left").withColumn("altitude_anomaly", odd)
    passed = ~F.col("altitude_anomaly")
    if "quality_passed" in frames.columns:
        passed = F.col("quality_passed") & passed
    return out.withColumn("quality_passed", passed).drop("__rel", "__alt", "__n", "__std", "__median")


def temporal_gap(frames: DataFrame, mult: float = DEFAULTS.gap_multiplier, flight: str = "flight_id",
                 ts: str = "ts", tie: str = "frame_id", bucket_seconds: int = 3600) -> DataFrame:
    """Frames that follow a pause longer than ``mult`` times the flight's median interval.

    Frames without a time are kept, never flagged and not counted; fewer than three timed frames
    flag nothing. ``quality_passed`` is not touched.
    """
    timed = frames.where(F.col(ts).isNotNull()).withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    stepped = previous_value(timed, [flight], "__t", [tie], time_bucket(ts, bucket_seconds), "__prev").withColumn(
        "__gap", (F.col("__t") - F.col("__prev")) / F.lit(1e6)
    )
    counted = stepped.groupBy(flight).agg(F.count(F.lit(1)).alias("__n"))
    stats = counted.join(exact_median(stepped, [flight], "__gap", "__median"), flight, "left")
    gap = F.coalesce(
        (F.col("__n") >= 3) & (F.col("__median") > 0) & (F.col("__gap") > F.col("__median") * mult), F.lit(False)
    )
    flagged = stepped.join(stats, flight, "left").withColumn("temporal_gap", gap).select(*frames.columns, "temporal_gap")
    untimed = frames.where(F.col(ts).isNull()).withColumn("temporal_gap", F.lit(False))
    return flagged.unionByName(untimed)
