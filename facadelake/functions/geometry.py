"""Units, pixel geometry, grids, time and text as Column builders."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed table kept in the plan: no Python worker and no driver-side data source."""
    names = [field.strip().split(" ")[0] for field in schema.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows], ensure_ascii=False)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{','.join(':'.join(f.strip().split(' ')) for f in schema.split(','))}>>")))


def gsd(alt, sensor_w, focal, px_w, sensor_h=None, px_h=None) -> Column:
    """Ground sampling distance in cm/px: the worse of the two axes; null where an input is not positive."""
    alt, sensor_w, focal, px_w = map(col, (alt, sensor_w, focal, px_w))
    wide = alt * sensor_w / (focal * px_w) * F.lit(100.0)
    if sensor_h is not None and px_h is not None:
        sensor_h, px_h = col(sensor_h), col(px_h)
        tall = F.when(
            (sensor_h > 0) & (px_h > 0),
            alt * sensor_h / F.nullif(focal * px_h, F.lit(0.0)) * F.lit(100.0),
        )
    else:
        tall = F.lit(None).cast("double")
    wide = F.when((alt > 0) & (sensor_w > 0) & (focal > 0) & (px_w > 0), wide)
    return F.when(wide.isNotNull(), F.greatest(wide, tall))


def flight_altitude(relative: ColumnLike, gps: ColumnLike) -> Column:
    return F.coalesce(F.abs(col(relative)), F.abs(col(gps)))


def gsd_xy(w_px, h_px, w_m, h_m, nominal: float = 0.15) -> Column:
    """Per-axis GSD from the true width and height in metres; nominal, with a warning, where unknown."""
    w_px, h_px, w_m, h_m = map(col, (w_px, h_px, w_m, h_m))
    x_known, y_known = F.coalesce(w_m > 0, F.lit(False)), F.coalesce(h_m > 0, F.lit(False))
    text = "{} image dimension not supplied — using nominal 0.15 cm/px estimate."
    return F.struct(
        F.when(x_known, w_m * 100.0 / F.greatest(w_px, F.lit(1))).otherwise(F.lit(nominal)).alias("gsd_x"),
        F.when(y_known, h_m * 100.0 / F.greatest(h_px, F.lit(1))).otherwise(F.lit(nominal)).alias("gsd_y"),
        F.array_compact(
            F.array(
                F.when(~x_known, F.lit(text.format("Horizontal"))),
                F.when(~y_known, F.lit(text.format("Vertical"))),
            )
        ).alias("warnings"),
    )


def rod_check(gsd_cm, length_m, px, tol: float = 5.0) -> Column:
    """Reference rod: predicted against true length, passing within ``tol`` percent."""
    predicted = col(px) * col(gsd_cm)
    actual = col(length_m) * F.lit(100.0)
    deviation = F.try_divide(F.abs(predicted - actual), actual) * F.lit(100.0)
    return F.struct(
        predicted.alias("predicted_cm"),
        actual.alias("actual_cm"),
        deviation.alias("deviation_pct"),
        F.coalesce(deviation <= tol, F.lit(False)).alias("passed"),
    )


def px_to_m(px, gsd_cm) -> Column:
    return col(px) * col(gsd_cm) / F.lit(100.0)


def px_to_mm(px, gsd_cm) -> Column:
    return col(px) * col(gsd_cm) * F.lit(10.0)


def dms_to_decimal(dms, ref) -> Column:
    """Degrees, minutes, seconds as rationals ``array<struct<num,den>>``; null on a zero denominator."""
    dms, ref = col(dms), col(ref)
    part = [F.try_divide(dms[i]["num"].cast("double"), dms[i]["den"].cast("double")) for i in range(3)]
    value = part[0] + part[1] / F.lit(60.0) + part[2] / F.lit(3600.0)
    return F.when(F.size(dms) >= 3, F.when(ref.isin("S", "W"), -value).otherwise(value))


def signed_altitude(num, den, ref) -> Column:
    value = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return F.when(F.coalesce(col(ref), F.lit(0)) == 1, -value).otherwise(value)


def trig_measure(vx, vy, length_px, width_px, gx, gy) -> Column:
    """Axis vector and pixel extents to length, width and angle from the horizontal."""
    vx, vy, length_px, width_px, gx, gy = map(col, (vx, vy, length_px, width_px, gx, gy))
    dx, dy = length_px * vx * gx, length_px * vy * gy
    return F.struct(
        F.hypot(dx, dy).alias("length_cm"),
        (F.hypot(width_px * vy * gx, width_px * vx * gy) * F.lit(10.0)).alias("width_mm"),
        F.degrees(F.atan2(F.abs(dy), F.abs(dx))).alias("angle_deg"),
    )


def overlap_1d(a0, a_len, b0, b_len) -> Column:
    return F.greatest(F.lit(0), F.least(a0 + a_len, b0 + b_len) - F.greatest(a0, b0))


def bbox_iou(a, b) -> Column:
    """Intersection over union of two (x, y, w, h) boxes, each given as four columns."""
    ax, ay, aw, ah = map(col, a)
    bx, by, bw, bh = map(col, b)
    inter = overlap_1d(ax, aw, bx, bw) * overlap_1d(ay, ah, by, bh)
    union = aw * ah + bw * bh - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(
        inter.cast("double") / F.nullif(union.cast("double"), F.lit(0.0))
    )


def project(h, x, y) -> Column:
    """Point through a row-major 3x3 homography ``array<double>`` with perspective divide."""
    h, x, y = col(h), col(x), col(y)
    w = h[6] * x + h[7] * y + h[8]
    return F.struct(
        F.try_divide(h[0] * x + h[1] * y + h[2], w).alias("x"),
        F.try_divide(h[3] * x + h[4] * y + h[5], w).alias("y"),
    )


def agreement(a, b) -> Column:
    a, b = col(a), col(b)
    spread = F.lit(1.0) - F.abs(a - b) / F.greatest(a, b, F.lit(1e-6))
    return F.greatest(F.lit(0.0), F.round(F.lit(100.0) * spread, 1))


def facade_area(h, w, gsd_cm) -> Column:
    return col(h) * col(w) * col(gsd_cm) * col(gsd_cm)


def _cell(position: Column, count: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(count - 1), position.cast("int")))


def _letter(index: Column) -> Column:
    return F.chr(index + F.lit(65))


def grid_ref(cx, cy, w, h, cols: int = 8, rows: int = 6) -> Column:
    """Elevation reference such as B4: row letters from the bottom, columns from the left."""
    cx, cy, w, h = (lit_or_col(c).cast("double") for c in (cx, cy, w, h))
    column = _cell(cx / w * cols, cols)
    row = _cell(cy / h * rows, rows)
    return F.concat(_letter(F.lit(rows - 1) - row), (column + 1).cast("string"))


def grid_ref_legacy(cx, cy, w, h) -> Column:
    """Older reference: the row is counted from the bottom edge before truncation."""
    cx, cy, w, h = (lit_or_col(c).cast("double") for c in (cx, cy, w, h))
    row = _cell((h - cy) / (h / 6.0), 6)
    column = _cell(cx / (w / 8.0), 8)
    return F.concat(_letter(row), (column + 1).cast("string"))


def parse_grid(grid: str) -> tuple[int, int]:
    """Rows and columns of ``RxC``; 4 x 4 for anything else."""
    parts = grid.lower().split("x")
    if len(parts) == 2 and all(p.isdigit() for p in parts):
        return int(parts[0]), int(parts[1])
    return 4, 4


def zone_id(cx, cy, w, h, grid: str = "4x4") -> Column:
    """Zone such as A1: column letter, then row number from the top; a missing centroid is the centre."""
    rows, cols = parse_grid(grid)
    w, h = (lit_or_col(c).cast("double") for c in (w, h))
    cx = F.coalesce(lit_or_col(cx).cast("double"), F.floor(w / 2.0).cast("double"))
    cy = F.coalesce(lit_or_col(cy).cast("double"), F.floor(h / 2.0).cast("double"))
    return F.concat(_letter(_cell(cx / (w / cols), cols)), (_cell(cy / (h / rows), rows) + 1).cast("string"))


def zone_id_3x3(cx, cy, w, h) -> Column:
    cx, cy, w, h = (lit_or_col(c).cast("double") for c in (cx, cy, w, h))
    column = F.least((cx / (w / 3.0)).cast("int") + 1, F.lit(3))
    row = F.least((cy / (h / 3.0)).cast("int") + 1, F.lit(3))
    return F.concat(F.lit("R"), row.cast("string"), F.lit("C"), column.cast("string"))


def zone_bounds(zone, w, h) -> Column:
    """Pixel rectangle of a 4x4 zone on the map view, whose rows count from the bottom."""
    zone, w, h = col(zone), lit_or_col(w).cast("double"), lit_or_col(h).cast("double")
    c = (F.ascii(zone) - 65).cast("double")
    r = F.substring(zone, 2, 8).cast("int").cast("double")
    return F.struct(
        (c * w / 4.0).alias("x1"),
        ((c + 1.0) * w / 4.0).alias("x2"),
        ((F.lit(4.0) - r) * h / 4.0).alias("y1"),
        ((F.lit(5.0) - r) * h / 4.0).alias("y2"),
    )


def map_point(px, py, h) -> Column:
    return F.struct((lit_or_col(h) - col(py)).alias("lat"), col(px).alias("lng"))


def member_from_position(cx, cy, w, h) -> Column:
    cx, cy, w, h = (lit_or_col(c).cast("double") for c in (cx, cy, w, h))
    return (
        F.when(cy > h * 0.65, "beam")
        .when((cx < w * 0.25) | (cx > w * 0.75), "column")
        .otherwise("slab")
    )


def exif_timestamp(c) -> Column:
    return F.try_to_timestamp(col(c), F.lit("yyyy:MM:dd HH:mm:ss"))


# Days until the next inspection, by schedule and key.
REINSPECTION_DAYS = {
    "intervention": {"shear": 30, "compression": 30, "corrosion": 90, "hairline": 365, "fine": 180, "other": 90},
    "severity": {"critical": 30, "severe": 90, "moderate": 180, "other": 365},
    "width": {"hairline": 365, "fine": 180, "medium": 90, "wide": 30},
}


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Small fixed table as a map literal; ``default`` for keys it does not hold."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def reinspection_date(base, schedule: str, key) -> Column:
    table = REINSPECTION_DAYS[schedule]
    days = lookup({k: v for k, v in table.items() if k != "other"}, col(key), table.get("other"))
    return F.date_add(col(base).cast("date"), days)


def spall_dims(w, h, gsd_cm) -> Column:
    w, h, g = col(w).cast("double"), col(h).cast("double"), lit_or_col(gsd_cm)
    return F.struct(
        (F.hypot(w, h) * g).alias("length_cm"),
        (F.least(w, h) * g * 10.0).alias("width_mm"),
    )


def delamination_m2(defect_type, area_cm2) -> Column:
    return F.when(col(defect_type) == "spalling", F.round(col(area_cm2) / 10000.0, 5))


def safe_json_list(c) -> Column:
    """Any JSON text as a list of JSON values: malformed, null and empty give [], a scalar is wrapped."""
    c = col(c)
    many = F.from_json(F.concat(F.lit('{"v":'), F.trim(c), F.lit("}")), "v array<string>")["v"]
    valid = F.try_parse_json(F.when(F.trim(c) != "", c))
    is_list = F.trim(c).startswith("[")
    empty = F.array().cast("array<string>")
    return F.when(valid.isNull(), empty).when(is_list, F.coalesce(many, empty)).otherwise(F.array(c))


def safe_json_map(c) -> Column:
    """JSON object as a map; anything malformed is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.from_json(col(c), "map<string,string>"), empty)


def inspection_key(building, date, cycle) -> Column:
    return F.concat(
        col(building).cast("string"), F.lit("_"), col(date).cast("string"), F.lit("_C"), col(cycle).cast("string")
    )


def subtype_slug(t) -> Column:
    return F.replace(F.lower(col(t)), F.lit(" "), F.lit("_"))


def title(t) -> Column:
    return F.initcap(F.replace(col(t), F.lit("_"), F.lit(" ")))


def content_hash(c) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def artifact_key(building, ts, kind) -> Column:
    safe = F.replace(F.replace(col(ts).cast("string"), F.lit(":"), F.lit("-")), F.lit(" "), F.lit("_"))
    return F.concat(col(building).cast("string"), F.lit("/"), safe, F.lit("/"), lit_or_col(kind), F.lit(".json"))


def result_key(building, cycle, inspection) -> Column:
    return F.concat(
        F.lit("results/"),
        col(building).cast("string"),
        F.lit("/cycle_"),
        col(cycle).cast("string"),
        F.lit("/"),
        col(inspection).cast("string"),
    )


def normalize_gps(c) -> Column:
    """A GPS struct with lat/lon or latitude/longitude keys to rounded lat/lon, 0.0 where missing."""
    c = col(c)
    return F.struct(
        F.round(F.coalesce(c["lat"], c["latitude"], F.lit(0.0)), 6).alias("lat"),
        F.round(F.coalesce(c["lon"], c["longitude"], F.lit(0.0)), 6).alias("lon"),
    )


def patch_bounds(cx, cy, w, h, size: int = 96) -> Column:
    """Square window round a centroid: bounds inside the image (i*) and inside the patch (p*)."""
    cx, cy, w, h = (lit_or_col(c).cast("int") for c in (cx, cy, w, h))
    x1, y1 = cx - size // 2, cy - size // 2
    x2, y2 = x1 + size, y1 + size
    zero = F.lit(0)
    return F.struct(
        F.greatest(zero, x1).alias("ix1"),
        F.greatest(zero, y1).alias("iy1"),
        F.least(w, x2).alias("ix2"),
        F.least(h, y2).alias("iy2"),
        F.greatest(zero, -x1).alias("px1"),
        F.greatest(zero, -y1).alias("py1"),
        (F.lit(size) - F.greatest(zero, x2 - w)).alias("px2"),
        (F.lit(size) - F.greatest(zero, y2 - h)).alias("py2"),
    )


def register_sql_functions(spark: SparkSession) -> None:
    """The two most asked-for formulas for SQL users, as temporary SQL functions."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION bbox_iou(
             ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by DOUBLE, bw DOUBLE, bh DOUBLE)
           RETURNS DOUBLE RETURN
           coalesce(try_divide(
             greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by + bh) - greatest(ay, by)),
             nullif(greatest(0, aw * ah + bw * bh
               - greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by + bh) - greatest(ay, by))), 0)), 0)"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION gsd_cm(
             alt DOUBLE, sensor_w DOUBLE, focal DOUBLE, px_w DOUBLE, sensor_h DOUBLE, px_h DOUBLE)
           RETURNS DOUBLE RETURN
           CASE WHEN alt > 0 AND sensor_w > 0 AND focal > 0 AND px_w > 0 THEN
             greatest(try_divide(alt * sensor_w, focal * px_w) * 100,
                      CASE WHEN sensor_h > 0 AND px_h > 0 THEN try_divide(alt * sensor_h, focal * px_h) * 100 END) END"""
    )
