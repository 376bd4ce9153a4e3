"""Masks as tables: horizontal runs ``(mask_id, y, x0, x1)`` with inclusive ends, or pixels ``(mask_id, x, y)``."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facadelake.config import DEFAULTS
from facadelake.functions.geometry import col

from .hotkeys import exact_median, previous_value, ranked


# --- run-length coding ---------------------------------------------------------------------------


def counts_from_text(c) -> Column:
    """Run lengths given as text, separated by blanks."""
    return F.transform(F.split(F.trim(col(c)), r"\s+"), lambda x: x.cast("int"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _running_sums(counts: pd.Series) -> pd.Series:
    return counts.map(lambda c: None if c is None else np.cumsum(np.nan_to_num(np.asarray(c, float)).astype(np.int64)))


def run_ends(masks: DataFrame) -> DataFrame:
    """Position, length and end of each run of a ``counts`` array. The running sum is made inside the array, before it is taken
    apart, so nothing is shuffled."""
    runs = masks.withColumn("__ends", _running_sums("counts"))
    runs = runs.select(*[c for c in masks.columns if c != "counts"], F.posexplode(F.arrays_zip("counts", "__ends")).alias("pos", "__run"))
    return runs.withColumns({"n": F.col("__run.counts"), "end_px": F.col("__run.__ends")}).drop("__run")


def decode_runs(masks: DataFrame) -> DataFrame:
    """Alternating run lengths, background first, to horizontal runs. Overflow is clipped to the mask."""
    flat = run_ends(masks).where("pos % 2 = 1")
    total = (F.col("height") * F.col("width")).cast("long")
    start = F.col("end_px") - F.col("n")
    clipped = flat.withColumns({"s": F.least(start, total), "e": F.least(F.col("end_px"), total)}).where("s < e")
    rows = clipped.withColumn("y", F.explode(F.sequence(F.expr("CAST(s div width AS INT)"), F.expr("CAST((e - 1) div width AS INT)"))))
    return rows.select(
        "mask_id",
        "y",
        F.greatest(F.col("s") - F.col("y") * F.col("width"), F.lit(0)).cast("int").alias("x0"),
        (F.least(F.col("e") - F.col("y") * F.col("width"), F.col("width").cast("long")) - 1).cast("int").alias("x1"),
    )


def encode_runs(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Horizontal runs back to run lengths; trailing background is not written, an empty mask is []."""
    flat = runs.join(sizes, "mask_id").select(
        "mask_id", (F.col("y").cast("long") * F.col("width") + F.col("x0")).alias("s"), (F.col("y").cast("long") * F.col("width") + F.col("x1") + 1).alias("e")
    )
    before = Window.partitionBy("mask_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("mask_id").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    # Runs that touch across a row border are one run of the flat mask.
    islands = flat.withColumn("__far", F.max("e").over(before)).withColumn(
        "__new", F.when(F.col("__far").isNull() | (F.col("s") > F.col("__far")), 1).otherwise(0)
    ).withColumn("__island", F.sum("__new").over(upto))
    merged = islands.groupBy("mask_id", "__island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    gap = F.col("s") - F.coalesce(F.lag("e").over(Window.partitionBy("mask_id").orderBy("s")), F.lit(0))
    pieces = merged.withColumn("gap", gap).select("mask_id", F.struct("s", F.array("gap", F.col("e") - F.col("s")).alias("two")).alias("p"))
    lists = pieces.groupBy("mask_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["two"])).alias("counts"))
    return sizes.join(lists, "mask_id", "left").withColumn("counts", F.coalesce("counts", F.array().cast("array<bigint>")))


def place_masks(runs: DataFrame, detections: DataFrame) -> DataFrame:
    """Crop runs moved to image coordinates and clipped to the image; without a mask the whole box counts.

    ``detections`` has mask_id, bx, by, bw, bh, image_w, image_h and has_mask.
    """
    moved = runs.join(detections.where("has_mask"), "mask_id").select(
        "mask_id", (F.col("y") + F.col("by")).alias("y"), (F.col("x0") + F.col("bx")).alias("x0"), (F.col("x1") + F.col("bx")).alias("x1"), "image_w", "image_h"
    )
    boxes = (
        detections.where("NOT has_mask AND bw > 0 AND bh > 0")
        .withColumn("y", F.explode(F.sequence(F.col("by"), F.col("by") + F.col("bh") - 1)))
        .select("mask_id", "y", F.col("bx").alias("x0"), (F.col("bx") + F.col("bw") - 1).alias("x1"), "image_w", "image_h")
    )
    return (
        moved.unionByName(boxes)
        .where("y >= 0 AND y < image_h AND x1 >= 0 AND x0 < image_w")
        .select("mask_id", "y", F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("image_w") - 1).alias("x1"))
    )


# --- moments ---------------------------------------------------------------------------------------


def _power_sums(p: int) -> Column:
    """Sum of x**p over a run, in closed form."""
    a, b = F.col("x0").cast("double"), F.col("x1").cast("double")

    def below(m: Column) -> Column:
        if p == 1:
            return m * (m + 1) / 2
        if p == 2:
            return m * (m + 1) * (m * 2 + 1) / 6
        return m * m * (m + 1) * (m + 1) / 4

    return below(b) - below(a - 1)


def run_sums(runs: DataFrame, order: int = 2, by: str = "mask_id") -> DataFrame:
    """Pixel sums of x**i * y**j up to ``order`` and the bounding box, from run ends alone."""
    n = (F.col("x1") - F.col("x0") + 1).cast("double")
    y = F.col("y").cast("double")
    x = {0: n, 1: _power_sums(1), 2: _power_sums(2), 3: _power_sums(3)}
    sums = [
        F.sum(x[i] if j == 0 else x[i] * y if j == 1 else x[i] * y * y if j == 2 else x[i] * y * y * y).alias(f"s{i}{j}")
        for i in range(order + 1)
        for j in range(order + 1 - i)
    ]
    return runs.groupBy(by).agg(
        *sums, F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def mask_moments(runs: DataFrame, by: str = "mask_id") -> DataFrame:
    """Area, box, centroid, principal axis, extent along it, mean width and elongation of each mask."""
    m = run_sums(runs, 2, by)
    n = F.col("s00")
    cx, cy = F.col("s10") / n, F.col("s01") / n
    cxx, cyy, cxy = F.col("s20") / n - cx * cx, F.col("s02") / n - cy * cy, F.col("s11") / n - cx * cy
    axis = m.select(
        by, n.alias("area_px"), "min_x", "min_y", "max_x", "max_y", cx.alias("centroid_x"), cy.alias("centroid_y"),
        (F.atan2(cxy * 2, cxx - cyy) * 0.5).alias("theta"),
    ).withColumns({"vx": F.cos("theta"), "vy": F.sin("theta")})
    # Along any direction the extreme pixel of a run is one of its two ends.
    ends = runs.join(axis.select(by, "vx", "vy"), by)
    left = F.col("x0") * F.col("vx") + F.col("y") * F.col("vy")
    right = F.col("x1") * F.col("vx") + F.col("y") * F.col("vy")
    extent = ends.groupBy(by).agg((F.max(F.greatest(left, right)) - F.min(F.least(left, right))).alias("length_px"))
    out = axis.join(extent, by)
    width = F.col("area_px") / F.nullif(F.col("length_px"), F.lit(0.0))
    angle = F.degrees("theta")
    return out.select(
        by, "area_px", "min_x", "min_y", (F.col("max_x") - F.col("min_x") + 1).alias("bbox_w"), (F.col("max_y") - F.col("min_y") + 1).alias("bbox_h"),
        "centroid_x", "centroid_y", F.when(angle < 0, angle + 180.0).otherwise(angle).alias("angle_deg"), "vx", "vy", "length_px",
        width.alias("width_px"), (F.col("length_px") / F.greatest(width, F.lit(1e-6))).alias("elongation"),
    )


def shape_vector(runs: DataFrame, contours: DataFrame, by: str = "mask_id") -> DataFrame:
    """Elongation, solidity, circularity and four signed-log Hu moments. Hu moments come from pixel sums;
    contours with fewer than three points take the defaults 1, 1, 1 and zeros."""
    s = run_sums(runs, 3, by)
    n = F.col("s00")
    cx, cy = F.col("s10") / n, F.col("s01") / n
    mu20 = F.col("s20") - cx * F.col("s10")
    mu02 = F.col("s02") - cy * F.col("s01")
    mu11 = F.col("s11") - cx * F.col("s01")
    mu30 = F.col("s30") - cx * 3 * F.col("s20") + cx * cx * 2 * F.col("s10")
    mu03 = F.col("s03") - cy * 3 * F.col("s02") + cy * cy * 2 * F.col("s01")
    mu21 = F.col("s21") - cx * 2 * F.col("s11") - cy * F.col("s20") + cx * cx * 2 * F.col("s01")
    mu12 = F.col("s12") - cy * 2 * F.col("s11") - cx * F.col("s02") + cy * cy * 2 * F.col("s10")
    second, third = F.pow(n, F.lit(2.0)), F.pow(n, F.lit(2.5))
    eta = s.select(
        by,
        *[(v / second).alias(k) for k, v in {"e20": mu20, "e02": mu02, "e11": mu11}.items()],
        *[(v / third).alias(k) for k, v in {"e30": mu30, "e03": mu03, "e21": mu21, "e12": mu12}.items()],
    )
    e = {k: F.col(k) for k in ("e20", "e02", "e11", "e30", "e03", "e21", "e12")}
    hu = [
        e["e20"] + e["e02"],
        (e["e20"] - e["e02"]) * (e["e20"] - e["e02"]) + e["e11"] * e["e11"] * 4,
        (e["e30"] - e["e12"] * 3) * (e["e30"] - e["e12"] * 3) + (e["e21"] * 3 - e["e03"]) * (e["e21"] * 3 - e["e03"]),
        (e["e30"] + e["e12"]) * (e["e30"] + e["e12"]) + (e["e21"] + e["e03"]) * (e["e21"] + e["e03"]),
    ]
    logs = eta.select(by, *[F.when(F.abs(h) > 0, -F.signum(h) * F.log10(F.abs(h))).otherwise(0.0).alias(f"hu{i + 1}") for i, h in enumerate(hu)])
    real = F.col("n_points") >= 3
    long_side, short_side = F.greatest("major_px", "minor_px"), F.least("major_px", "minor_px")
    circle = F.col("contour_area") * (4.0 * math.pi) / F.nullif(F.col("perimeter_px") * F.col("perimeter_px"), F.lit(0.0))
    return contours.join(logs, by, "left").select(
        by,
        F.when(real & (short_side > 0), long_side / F.nullif(short_side, F.lit(0.0))).otherwise(1.0).alias("elongation"),
        F.when(real & (F.col("hull_area") > 0), F.col("contour_area") / F.nullif(F.col("hull_area"), F.lit(0.0))).otherwise(1.0).alias("solidity"),
        F.when(~real, 1.0).otherwise(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), circle)), F.lit(0.0))).alias("circularity"),
        *[F.when(real, F.coalesce(f"hu{i}", F.lit(0.0))).otherwise(0.0).alias(f"hu{i}") for i in (1, 2, 3, 4)],
    )


# --- skeletons -------------------------------------------------------------------------------------


def skeleton_length(pixels: DataFrame, gsd_x: float = 1.0, gsd_y: float = 1.0, diagonal: float = math.sqrt(2), by: str = "mask_id") -> DataFrame:
    """Geodesic length, every neighbour edge once. The pixels of a piece of a mask row are the bits of one number. It
    announces itself to its own place, to the place below, and, where an edge leaves it, to the pieces beside those; so one
    aggregation on places replaces four joins, and its groups are pieces, not pixels."""
    wide = 62
    at = F.when(F.col("x").isNotNull(), F.pmod(F.col("x"), F.lit(wide)).cast("int")).otherwise(0)
    pieces = pixels.groupBy(by, "y", F.floor(F.col("x") / wide).alias("__piece")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at)).alias("b"))
    b, full, none = F.col("b"), F.lit((1 << wide) - 1).cast("long"), F.lit(0).cast("long")
    # An unknown x has no neighbours but itself.
    lost = F.col("__piece").isNull()
    right = F.when(lost, b).otherwise(F.shiftleft(b, 1).bitwiseAND(full))
    left = F.when(lost, b).otherwise(F.shiftright(b, 1))
    out_right = F.when(lost, none).otherwise(F.shiftright(b, wide - 1))
    out_left = F.when(lost, none).otherwise(F.shiftleft(b.bitwiseAND(F.lit(1).cast("long")), wide - 1))

    def told(dx: int, dy: int, own=none, flat=none, down=none, fall=none, rise=none):
        return F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), own.alias("own"), flat.alias("flat"), down.alias("down"), fall.alias("fall"), rise.alias("rise"))

    news = F.array(
        told(0, 0, own=b, flat=right), told(0, 1, down=b, fall=right, rise=left),
        F.when(out_right != 0, told(1, 0, flat=out_right)), F.when(out_right != 0, told(1, 1, fall=out_right)), F.when(out_left != 0, told(-1, 1, rise=out_left)),
    )
    heard = pieces.select(by, "y", "__piece", F.explode(F.array_compact(news)).alias("o"))
    places = heard.groupBy(by, (F.col("y") + F.col("o.dy")).alias("py"), (F.col("__piece") + F.col("o.dx")).alias("px")).agg(
        *[F.bit_or(f"o.{c}").alias(c) for c in ("own", "flat", "down", "fall", "rise")]
    )
    n = {c: F.bit_count(F.col("own").bitwiseAND(F.col(c))) for c in ("flat", "down", "fall", "rise")}
    slanted = n["fall"] + n["rise"]
    return places.where("own <> 0").groupBy(by).agg(
        F.sum(n["flat"] + n["down"] + slanted * F.lit(float(diagonal))).alias("length_px"),
        F.sum(n["flat"] * F.lit(float(gsd_x)) + n["down"] * F.lit(float(gsd_y)) + slanted * F.lit(math.hypot(gsd_x, gsd_y))).alias("length_cm"),
    )


def tortuosity(pixels: DataFrame, by: str = "mask_id") -> DataFrame:
    """Skeleton length over the diagonal of its extent; 1 where the extent is at most a pixel."""
    extent = pixels.groupBy(by).agg(
        F.hypot((F.max("x") - F.min("x")).cast("double"), (F.max("y") - F.min("y")).cast("double")).alias("straight_px")
    )
    joined = extent.join(skeleton_length(pixels, by=by), by)
    return joined.select(
        by, "length_px", "straight_px", F.when(F.col("straight_px") > 1, F.col("length_px") / F.nullif(F.col("straight_px"), F.lit(0.0))).otherwise(1.0).alias("tortuosity")
    )


def width_profile(points: DataFrame, gsd_cm: float, n: int = 10, by: str = "mask_id") -> DataFrame:
    """Median and maximum crack width and ``n`` evenly spaced samples in row-major order, in mm.

    ``points`` are skeleton pixels with their distance to the background; a width is twice that.
    """
    mm = gsd_cm * 10.0
    wide = points.withColumn("__w", F.col("distance") * 2.0)
    stats = wide.groupBy(by).agg(F.count(F.lit(1)).alias("n_points"), F.max("__w").alias("__max"))
    placed = ranked(wide, [by], ["y", "x"], F.col("y"), "__rank").join(stats, by)
    k = F.least(F.lit(n), F.col("n_points"))
    last = F.col("n_points") - 1
    wanted = F.transform(
        F.sequence(F.lit(0), (k - 1).cast("int")),
        lambda i: F.when(i == k - 1, last).otherwise(F.floor(i * (last / F.greatest(k - 1, F.lit(1))))),
    )
    wanted = F.when(k == 1, F.array(F.lit(0).cast("long"))).otherwise(wanted)
    # At most n places are looked for, so the list per mask is short.
    sampled = placed.where(F.array_contains(wanted, F.col("__rank") - 1)).groupBy(by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__rank", "__w"))), lambda s: s["__w"] * mm).alias("profile_mm")
    )
    median = exact_median(wide, [by], "__w", "__median")
    return stats.join(median, by).join(sampled, by).select(
        by, "n_points", (F.col("__median") * mm).alias("median_width_mm"), (F.col("__max") * mm).alias("max_width_mm"), "profile_mm"
    )


# --- rules over measured components ------------------------------------------------------------------


def checked_area(pixel, contour, tol: float = DEFAULTS.area_tolerance) -> Column:
    """Mean of pixel and contour area where they agree within ``tol``, else the pixel area."""
    p, c = col(pixel), col(contour)
    apart = F.abs(p - c) / F.greatest(p, F.lit(1e-6))
    return F.when((c == 0) | (apart > tol), p).otherwise((p + c) / 2.0)


def primary_detection(components: DataFrame, method: str, by: str = "image_id", ordinal: str = "ordinal", min_elongation: float = 3.0) -> DataFrame:
    """The one detection that stands for an image. Geometry prefers line-like components and the largest
    elongation times length; the other method the longest. Ties take the first detection."""
    fields = ["length_cm", "width_mm", "angle_deg", "elongation"]
    if method == "cv":
        rank = F.struct(F.col("length_cm"), -F.col(ordinal))
    else:
        rank = F.struct(F.col("elongation") >= min_elongation, F.col("elongation") * F.col("length_cm"), -F.col(ordinal))
    best = components.groupBy(by).agg(F.max_by(F.struct(ordinal, *fields), rank).alias("p"), F.count(F.lit(1)).alias("detected_count"))
    return best.select(by, "detected_count", "p.*")


def with_primary(images: DataFrame, primary: DataFrame, by: str = "image_id") -> DataFrame:
    """Every image with its primary detection, zeros where nothing was detected."""
    return images.join(primary, by, "left").fillna(0.0, subset=["length_cm", "width_mm", "angle_deg", "elongation"]).fillna(0, subset=["detected_count"])


def bar_spacing(lines: DataFrame, gsd_x: float, min_gap: int = 30, by: str = "image_id") -> DataFrame:
    """Median gap of near-vertical line centres, after dropping centres within ``min_gap`` of the last kept.

    Distinct centres are whole pixels of one image, so the set per image is bounded by its width.
    """
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    upright = (dy > 0) & (dx / F.nullif(dy, F.lit(0)) < 0.18)
    centre = F.expr("CAST(floor((x1 + x2) / 2) AS INT)")
    sets = lines.groupBy(by).agg(F.array_sort(F.collect_set(F.when(upright, centre))).alias("xs"))
    none = F.array().cast("array<int>")
    kept = F.aggregate(
        "xs", none, lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > min_gap), F.array_append(acc, x)).otherwise(acc)
    )
    k = F.size("kept")
    gaps = F.array_sort(F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.get("kept", i) - F.get("kept", i - 1)))
    low, high = F.expr("(size(gaps) - 1) div 2").cast("int"), F.expr("size(gaps) div 2").cast("int")
    return (
        sets.withColumn("kept", kept)
        .withColumn("gaps", F.when(k >= 2, gaps))
        .select(
            by,
            F.coalesce((F.get("gaps", low) + F.get("gaps", high)) / 2.0 * gsd_x, F.lit(0.0)).alias("spacing_cm"),
            F.when(k >= 2, k).otherwise(0).alias("detected_rods"),
        )
    )


def parallel_bars(lines: DataFrame, gsd_mm: float, by: str = "region_id", ordinal: str = "line_id", tolerance_deg: float = 15.0) -> DataFrame:
    """Bars of a region: lines near the median angle, their mean spacing in order, cover, count, confidence."""
    angle = F.degrees(F.atan2((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double")))
    angled = lines.withColumn("__a", F.pmod(angle, F.lit(180.0)))
    medians = exact_median(angled, [by], "__a", "median_angle")
    near = angled.join(medians, by).where(F.abs(F.col("__a") - F.col("median_angle")) < tolerance_deg)
    mx, my = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    along = F.when(F.col("median_angle") > 45, mx).otherwise(my)
    placed = near.select(by, ordinal, along.alias("__pos"), F.struct(along, F.col(ordinal), mx.alias("mx"), my.alias("my")).alias("__mid"))
    stepped = previous_value(placed, [by], "__mid", [], F.floor(F.col("__pos") / 64.0), "__before")
    gap = F.hypot(F.col("__mid.mx") - F.col("__before.mx"), F.col("__mid.my") - F.col("__before.my"))
    stats = stepped.groupBy(by).agg(
        F.count(F.lit(1)).alias("bar_count"), (F.coalesce(F.avg(gap), F.lit(0.0)) * gsd_mm).alias("spacing_mm"), (F.min("__mid.my") * gsd_mm).alias("cover_mm")
    )
    return stats.where("bar_count >= 2").withColumn("confidence", F.least(F.lit(1.0), F.col("bar_count") / 10.0))


def contour_stats(images: DataFrame, contours: DataFrame, lines: DataFrame, min_area: float = 200.0, by: str = "image_id") -> DataFrame:
    """Spall contours larger than ``min_area``, line count and edge density per image, zeros where none."""
    big = contours.where(F.col("area_px2") > min_area).groupBy(by).agg(
        F.count(F.lit(1)).alias("spall_count"), F.avg("area_px2").alias("mean_spall_area_px2"), F.max("area_px2").alias("max_spall_area_px2")
    )
    counted = lines.groupBy(by).agg(F.count(F.lit(1)).alias("crack_line_count"))
    density = (F.col("edge_px") * 255.0 / F.nullif(F.col("n_px"), F.lit(0))).alias("edge_density")
    return images.join(big, by, "left").join(counted, by, "left").select(
        by, F.coalesce("spall_count", F.lit(0)).alias("spall_count"), F.coalesce("mean_spall_area_px2", F.lit(0.0)).alias("mean_spall_area_px2"),
        F.coalesce("max_spall_area_px2", F.lit(0.0)).alias("max_spall_area_px2"), F.coalesce("crack_line_count", F.lit(0)).alias("crack_line_count"), density,
    )


def cooccurrence(pixels: DataFrame, by: str = "mask_id", levels: int = 32) -> DataFrame:
    """Grey-level co-occurrence at distance 1 and four angles, symmetric and normalised: contrast,
    correlation, homogeneity and energy. ``pixels`` has x, y and grey 0..255."""
    steps = [(0, 1, 0), (45, 1, 1), (90, 0, 1), (135, -1, 1)]
    offsets = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for a, dx, dy in steps])
    level = F.floor(F.col("grey") / (256 // levels)).cast("int")
    base = pixels.select(by, "x", "y", level.alias("level"))
    moved = base.select(by, F.col("level").alias("li"), "x", "y", F.explode(offsets).alias("o")).select(
        by, "li", "o.angle", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")
    )
    pairs = moved.join(base.withColumnRenamed("level", "lj"), [by, "x", "y"])
    cells = pairs.groupBy(by, "angle", F.least("li", "lj").alias("i"), F.greatest("li", "lj").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    i, j, m = F.col("i").cast("double"), F.col("j").cast("double"), F.col("m")
    d2 = (i - j) * (i - j)
    s = cells.groupBy(by, "angle").agg(
        F.sum(m).alias("n"), F.sum(m * d2).alias("sd"), F.sum(m / (d2 + 1)).alias("sh"), F.sum(m * (i + j)).alias("s1"),
        F.sum(m * (i * i + j * j)).alias("s2"), F.sum(m * i * j).alias("sij"), F.sum(F.when(i == j, m * m * 2).otherwise(m * m)).alias("se"),
    )
    mean = F.col("s1") / (F.col("n") * 2)
    var = F.col("s2") / (F.col("n") * 2) - mean * mean
    cov = F.col("sij") / F.col("n") - mean * mean
    return s.select(
        by, "angle", (F.col("sd") / F.col("n")).alias("contrast"),
        F.when(var < 1e-12, 1.0).otherwise(cov / F.when(var >= 1e-12, var)).alias("correlation"),
        (F.col("sh") / F.col("n")).alias("homogeneity"), F.sqrt(F.col("se") / (F.col("n") * F.col("n") * 2)).alias("energy"),
    )
