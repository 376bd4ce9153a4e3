"""Flights on the map: scale statistics, control points, grids and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facadelake.config import DEFAULTS
from facadelake.functions import geometry as g

from .hotkeys import exact_median, ranked


def flight_gsd(frames: DataFrame, flight: str = "flight_id", gsd: str = "gsd") -> DataFrame:
    """Count, median, mean, population deviation, minimum and maximum of the known GSD values."""
    known = frames.where(F.col(gsd).isNotNull())
    stats = known.groupBy(flight).agg(
        F.count(gsd).alias("count"), F.avg(gsd).alias("mean_cm_per_px"), F.stddev_pop(gsd).alias("std_cm_per_px"),
        F.min(gsd).alias("min_cm_per_px"), F.max(gsd).alias("max_cm_per_px"),
    )
    return stats.join(exact_median(known, [flight], gsd, "median_cm_per_px"), flight)


def gps_centroid(frames: DataFrame, by: str = "flight_id") -> DataFrame:
    return frames.groupBy(by).agg(F.avg("gps_latitude").alias("latitude"), F.avg("gps_longitude").alias("longitude"))


def grid_points(mosaics: DataFrame, spacing: int = DEFAULTS.grid_spacing_px, by: str = "flight_id") -> DataFrame:
    """Regular lattice over each mosaic, whose sides are bounded by the canvas limit of 50,000 px."""

    def ticks(side: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(side) - 1, F.lit(spacing)))

    sized = mosaics.where("mosaic_w > 0 AND mosaic_h > 0")
    return sized.select(by, "mosaic_h", ticks("mosaic_w").alias("pixel_x")).select(by, "pixel_x", ticks("mosaic_h").alias("pixel_y"))


def control_points(frames: DataFrame, mosaics: DataFrame, homographies: DataFrame | None, bucket: Column,
                   by: str = "flight_id", order: tuple[str, ...] = ("ts", "frame_id")) -> DataFrame:
    """Mosaic pixel of each located frame: its centre through its homography, else spread evenly by the
    frame's place in the flight. Places count all frames, also those without coordinates."""
    placed = ranked(frames, [by], list(order), bucket, "__place").withColumn("ordinal", F.col("__place") - 1).drop("__place")
    totals = frames.groupBy(by).agg(F.count(F.lit(1)).alias("__frames"))
    located = placed.where(F.col("gps_latitude").isNotNull() & F.col("gps_longitude").isNotNull()).join(totals, by).join(mosaics, by)
    if homographies is not None:
        located = located.join(homographies, "frame_id", "left")
    else:
        located = located.withColumn("h", F.lit(None).cast("array<double>"))
    sized = (F.coalesce("image_width_px", F.lit(0)) > 0) & (F.coalesce("image_height_px", F.lit(0)) > 0)
    cx = F.when(sized, F.col("image_width_px") / 2.0).otherwise(0.0)
    cy = F.when(sized, F.col("image_height_px") / 2.0).otherwise(0.0)
    moved = g.project("h", cx, cy)
    even = F.col("ordinal") / F.greatest(F.col("__frames") - 1, F.lit(1)) * F.col("mosaic_w")
    return located.select(
        "frame_id", by, "ordinal",
        F.when(F.col("h").isNotNull(), moved["x"]).otherwise(even).alias("pixel_x"),
        F.when(F.col("h").isNotNull(), moved["y"]).otherwise(F.col("mosaic_h") / 2.0).alias("pixel_y"),
        "gps_latitude", "gps_longitude",
    )


def idw(queries: DataFrame, controls: DataFrame, by: str = "flight_id", power: float = 2.0, snap_px: float = 1.0) -> DataFrame:
    """Inverse-distance interpolation of coordinates at pixel positions, per flight.

    A control nearer than ``snap_px`` gives its own value (the first of equal distances); flights with
    fewer than two controls give nothing. Controls at one pixel are merged first, with their count and
    sums, so a flight full of repeats costs one control. The weight sums are taken map-side in the join
    stage: what is shuffled is one partial sum per position and task, never the pairs.
    """
    # One record per pixel: how many controls, their coordinate sums, and the first of them.
    merged = controls.groupBy(by, F.col("pixel_x").alias("__cx"), F.col("pixel_y").alias("__cy")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("gps_latitude").alias("__lat"), F.sum("gps_longitude").alias("__lon"),
        F.min(F.struct("ordinal", "gps_latitude", "gps_longitude")).alias("__first"),
    )
    # A flight with many control pixels is cut into pieces of about this many, each joined on its own.
    piece_rows = 2000
    sizes = merged.groupBy(by).agg(F.sum("__n").alias("__k"), F.ceil(F.count(F.lit(1)) / F.lit(piece_rows)).cast("int").alias("__pieces"))
    sizes = sizes.where("__k >= 2").select(by, "__pieces")
    piece = F.pmod(F.xxhash64("__cx", "__cy"), F.col("__pieces").cast("long")).cast("int")
    cut = merged.join(sizes, by).withColumn("__piece", piece).drop("__pieces")
    asked = queries.join(sizes, by).withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__pieces")
    dx, dy = F.col("__cx") - F.col("pixel_x"), F.col("__cy") - F.col("pixel_y")
    # Below the snap distance the weights are not used, so the floor only keeps the division defined.
    distance = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    paired = asked.join(cut, [by, "__piece"]).withColumn("__d", distance)
    weight = F.lit(1.0) / F.pow("__d", F.lit(power))
    sums = paired.groupBy(by, "pixel_x", "pixel_y").agg(
        F.sum(weight * F.col("__n")).alias("__w"), F.sum(weight * F.col("__lat")).alias("__wlat"), F.sum(weight * F.col("__lon")).alias("__wlon"),
        F.min(F.struct("__d", "__first")).alias("__near"),
    )
    snapped = F.col("__near.__d") < snap_px
    return sums.select(
        by, "pixel_x", "pixel_y",
        F.when(snapped, F.col("__near.__first.gps_latitude")).otherwise(F.col("__wlat") / F.col("__w")).alias("gps_latitude"),
        F.when(snapped, F.col("__near.__first.gps_longitude")).otherwise(F.col("__wlon") / F.col("__w")).alias("gps_longitude"),
    )


def gps_rmse(predicted: DataFrame, actual: DataFrame, by: str = "flight_id", target_m: float = DEFAULTS.gps_rmse_target_m) -> DataFrame:
    """Root mean square error in metres at validation points (flat-earth metres); no point is infinity."""
    metres = 111320.0
    dlat = (F.col("gps_latitude") - F.col("true_latitude")) * metres
    dlon = (F.col("gps_longitude") - F.col("true_longitude")) * metres * F.cos(F.radians("true_latitude"))
    errors = actual.join(predicted, [by, "pixel_x", "pixel_y"], "left").withColumn("__e", dlat * dlat + dlon * dlon)
    return errors.groupBy(by).agg(F.coalesce(F.sqrt(F.avg("__e")), F.lit(float("inf"))).alias("rmse_m")).withColumn("passed", F.col("rmse_m") < target_m)
