"""Queries of the scalar expressions (X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from facadelake.functions import geometry as g
from facadelake.functions import rules as r
from facadelake.operators import reports
from facadelake.plans import sqltext as s
from facadelake.plans.registry import query, sql_view
from facadelake.sources.profiles import PROFILES, resolve_profile
from facadelake.sources.tables import IMAGE_H, IMAGE_W

_PROFILE_ROWS = s.values_table(PROFILES, "profile, pname, sw, sh, fl, wpx, hpx")
sql_view(
    "resolved_v",
    f"""SELECT f.*, coalesce(p.profile, 'dji_phantom_4_pro') AS resolved_profile,
        CASE WHEN p.profile IS NULL THEN 13.2::DOUBLE ELSE p.sw END AS sensor_width_mm, CASE WHEN p.profile IS NULL THEN 8.8::DOUBLE ELSE p.sh END AS sensor_height_mm,
        coalesce(f.focal_length_mm, CASE WHEN p.profile IS NULL THEN 8.8::DOUBLE ELSE p.fl END) AS focal_mm,
        CASE WHEN p.profile IS NULL THEN 5472 ELSE p.wpx END AS image_width_px, CASE WHEN p.profile IS NULL THEN 3648 ELSE p.hpx END AS image_height_px
      FROM frames_v f LEFT JOIN (SELECT * FROM {_PROFILE_ROWS}) p ON f.camera_profile = p.profile""",
)
sql_view(
    "gsd_v",
    """SELECT frame_id, flight_id, greatest(alt * sensor_width_mm / (focal_mm * image_width_px) * 100, alt * sensor_height_mm / (focal_mm * image_height_px) * 100) AS gsd
       FROM (SELECT *, abs(coalesce(relative_altitude, gps_altitude)) AS alt FROM resolved_v) r""",
)


@query("j9_resolve_profile", "SELECT frame_id, resolved_profile, sensor_width_mm, sensor_height_mm, focal_mm AS focal_length_mm, image_width_px, image_height_px FROM resolved_v")
def _(t):
    return resolve_profile(t.frames).select(
        "frame_id", "resolved_profile", "sensor_width_mm", "sensor_height_mm", "focal_length_mm", "image_width_px", "image_height_px"
    )


@query("s3_camera_profiles", f"SELECT camera_profile, count(*) AS n, min(p.pname) AS profile_name, min(p.fl) AS focal FROM frames_v f LEFT JOIN (SELECT * FROM {_PROFILE_ROWS}) p ON f.camera_profile = p.profile GROUP BY 1")
def _(t):
    from facadelake.sources.profiles import camera_profiles

    profiles = F.broadcast(camera_profiles(t.spark).withColumnRenamed("focal_length_mm", "focal"))
    frames = t.frames.select("camera_profile")
    return (
        frames.join(profiles, frames["camera_profile"] == profiles["profile"], "left")
        .groupBy("camera_profile")
        .agg(F.count(F.lit(1)).alias("n"), F.min("profile_name").alias("profile_name"), F.min("focal").alias("focal"))
    )


def with_gsd(frames):
    """Frames with their own GSD."""
    full = resolve_profile(frames)
    alt = g.flight_altitude("relative_altitude", "gps_altitude")
    return full.withColumn(
        "gsd", g.gsd(alt, "sensor_width_mm", "focal_length_mm", "image_width_px", "sensor_height_mm", "image_height_px")
    )


@query("x1_gsd", "SELECT frame_id, round(gsd, 9) AS gsd FROM gsd_v")
def _(t):
    return with_gsd(t.frames).select("frame_id", F.round("gsd", 9).alias("gsd"))


_SIZE = {
    "w_px": "CAST(4000 + inspection_id % 1000 AS INT)",
    "h_px": "CAST(3000 + inspection_id % 700 AS INT)",
    "w_m": "CASE WHEN inspection_id % 3 <> 0 THEN 2e0 + (inspection_id % 50) / 1e1 END",
    "h_m": "CASE WHEN inspection_id % 5 <> 0 THEN (inspection_id % 40) / 1e1 END",
}
_SIZED = "(SELECT inspection_id, " + ", ".join(f"{e} AS {n}" for n, e in _SIZE.items()) + " FROM inspections_v) z"


@query(
    "x2_gsd_xy",
    f"""SELECT inspection_id, CASE WHEN w_m > 0 THEN w_m * 100 / w_px ELSE 0.15::DOUBLE END AS gsd_x, CASE WHEN h_m > 0 THEN h_m * 100 / h_px ELSE 0.15::DOUBLE END AS gsd_y,
        CAST(CASE WHEN coalesce(w_m > 0, false) THEN 0 ELSE 1 END + CASE WHEN coalesce(h_m > 0, false) THEN 0 ELSE 1 END AS INT) AS n_warnings FROM {_SIZED}""",
)
def _(t):
    rows = t.inspections_base.select("inspection_id", *[F.expr(e).alias(n) for n, e in _SIZE.items()])
    out = rows.select("inspection_id", g.gsd_xy("w_px", "h_px", "w_m", "h_m").alias("x"))
    return out.select("inspection_id", "x.gsd_x", "x.gsd_y", F.size("x.warnings").alias("n_warnings"))


@query(
    "x3_rod_check",
    """SELECT defect_id, p AS predicted_cm, a AS actual_cm, round(abs(p - a) / a * 100, 7) AS deviation_pct, abs(p - a) / a * 100 <= 5 AS passed
       FROM (SELECT defect_id, (150 + part_no % 100) * (3e-1 + (supp_no % 41) / 1e2) AS p, (line_no * 1e0) * 100 AS a FROM defects_v) d""",
)
def _(t):
    check = g.rod_check(F.lit(0.3) + (F.col("supp_no") % 41) / 100.0, F.col("line_no") * 1.0, F.lit(150) + F.col("part_no") % 100)
    out = t.defects.select("defect_id", check.alias("x")).select("defect_id", "x.*")
    return out.withColumn("deviation_pct", F.round("deviation_pct", 7))


@query("x4_pixels_to_metric", "SELECT defect_id, centroid_x * width_mm / 100 AS metres, bbox_w * width_mm * 10 AS millimetres FROM defects_v")
def _(t):
    return t.defects.select("defect_id", g.px_to_m("centroid_x", "width_mm").alias("metres"), g.px_to_mm("bbox_w", "width_mm").alias("millimetres"))


@query(
    "x5_dms_to_decimal",
    """SELECT frame_id, round(CASE WHEN frame_id % 17 = 0 THEN NULL ELSE CASE WHEN frame_id % 4 IN (1, 2) THEN -v ELSE v END END, 9) AS decimal_deg,
        CASE WHEN frame_id % 19 = 0 THEN NULL WHEN frame_id % 2 = 1 THEN -(frame_id % 5000) / 1e1 ELSE (frame_id % 5000) / 1e1 END AS altitude
      FROM (SELECT frame_id, frame_id % 90 + (frame_id % 60) / 60e0 + (frame_id % 600) / 1e1 / 3600e0 AS v FROM frames_v) f""",
)
def _(t):
    i = F.col("frame_id")
    part = lambda num, den: F.struct(num.alias("num"), den.alias("den"))
    dms = F.array(
        part(i % 90, F.lit(1).cast("long")),
        part(i % 60, F.when(i % 17 == 0, 0).otherwise(1).cast("long")),
        part(i % 600, F.lit(10).cast("long")),
    )
    ref = F.get(F.array(F.lit("N"), F.lit("S"), F.lit("W"), F.lit("E")), (i % 4).cast("int"))
    alt = g.signed_altitude(i % 5000, F.when(i % 19 == 0, 0).otherwise(10), (i % 2).cast("int"))
    return t.frames.select("frame_id", F.round(g.dms_to_decimal(dms, ref), 9).alias("decimal_deg"), alt.alias("altitude"))


@query(
    "x6_trig_measure",
    """SELECT defect_id, round(sqrt(dx * dx + dy * dy), 6) AS length_cm, round(sqrt(wx * wx + wy * wy) * 10, 6) AS width_mm, round(degrees(atan2(abs(dy), abs(dx))), 6) AS angle_deg
       FROM (SELECT defect_id, l * c * 0.15 AS dx, l * s * 0.2 AS dy, w * s * 0.15 AS wx, w * c * 0.2 AS wy
             FROM (SELECT defect_id, cos(part_no * 1e0) AS c, sin(part_no * 1e0) AS s, length_cm * 7 AS l, width_mm * 3 AS w FROM defects_v) a) b""",
)
def _(t):
    angle = F.col("part_no") * 1.0
    m = g.trig_measure(F.cos(angle), F.sin(angle), F.col("length_cm") * 7, F.col("width_mm") * 3, F.lit(0.15), F.lit(0.2))
    out = t.defects.select("defect_id", m.alias("m"))
    return out.select("defect_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("length_cm", "width_mm", "angle_deg")])


_INTER = "(greatest(0, least(bbox_x + bbox_w, x2 + bbox_h) - greatest(bbox_x, x2)) * greatest(0, least(bbox_y + bbox_h, y2 + bbox_w) - greatest(bbox_y, y2)))"


@query(
    "x7_bbox_iou",
    f"SELECT defect_id, {_INTER} * 1e0 / (2 * bbox_w * bbox_h - {_INTER}) AS iou FROM (SELECT *, bbox_x + line_no * 25 AS x2, bbox_y - line_no * 10 AS y2 FROM boxes_v) b",
)
def _(t):
    iou = g.bbox_iou(
        ("bbox_x", "bbox_y", "bbox_w", "bbox_h"),
        (F.col("bbox_x") + F.col("line_no") * 25, F.col("bbox_y") - F.col("line_no") * 10, "bbox_h", "bbox_w"),
    )
    return t.boxes.select("defect_id", iou.alias("iou"))


@query(
    "x8_project",
    """SELECT defect_id, round((1.1 * cx + 0.02 * cy + p) / w, 7) AS x, round((0.01 * cx + 0.9 * cy - 3) / w, 7) AS y
       FROM (SELECT defect_id, centroid_x * 1e0 AS cx, centroid_y * 1e0 AS cy, line_no * 1e0 AS p, centroid_x * 1e-4 + centroid_y * 2e-4 + 1 AS w FROM defects_v) d""",
)
def _(t):
    h = F.array(*[F.lit(v) for v in (1.1, 0.02)], F.col("line_no") * 1.0, *[F.lit(v) for v in (0.01, 0.9, -3.0, 1e-4, 2e-4, 1.0)])
    out = t.defects.select("defect_id", g.project(h, "centroid_x", "centroid_y").alias("p"))
    return out.select("defect_id", F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


@query(
    "x9_agreement",
    "SELECT defect_id, greatest(0.0::DOUBLE, round(100 * (1 - abs(a - b) / greatest(a, b, 1e-6)), 1)) AS agreement_pct FROM (SELECT defect_id, length_cm AS a, area_cm2 / 7 AS b FROM defects_v) d",
)
def _(t):
    return t.defects.select("defect_id", g.agreement("length_cm", F.col("area_cm2") / 7.0).alias("agreement_pct"))


@query("x10_facade_area", "SELECT frame_id, round(image_height_px * image_width_px * gsd * gsd, 3) AS area_cm2 FROM (SELECT r.frame_id, image_height_px, image_width_px, gsd FROM resolved_v r JOIN gsd_v g ON r.frame_id = g.frame_id) q")
def _(t):
    return with_gsd(t.frames).select("frame_id", F.round(g.facade_area("image_height_px", "image_width_px", "gsd"), 3).alias("area_cm2"))


@query(
    "x11_grid_ref",
    "SELECT defect_id, chr(CAST(70 - least(5, floor(centroid_y / 384.0 * 6)) AS INT)) || CAST(least(7, floor(centroid_x / 512.0 * 8)) + 1 AS INT) AS grid_ref FROM defects_v",
)
def _(t):
    return t.defects.select("defect_id", g.grid_ref("centroid_x", "centroid_y", IMAGE_W, IMAGE_H).alias("grid_ref"))


@query(
    "x12_grid_ref_legacy",
    "SELECT defect_id, chr(CAST(65 + least(5, floor((384 - centroid_y) / 64.0)) AS INT)) || CAST(least(7, floor(centroid_x / 64.0)) + 1 AS INT) AS grid_reference FROM defects_v",
)
def _(t):
    return t.defects.select("defect_id", g.grid_ref_legacy("centroid_x", "centroid_y", IMAGE_W, IMAGE_H).alias("grid_reference"))


sql_view("zoned_v", "SELECT *, chr(CAST(65 + least(3, floor(centroid_x / 128.0)) AS INT)) || CAST(least(3, floor(centroid_y / 96.0)) + 1 AS INT) AS zone_id FROM scored_v")


@query("x13_zone_id", "SELECT defect_id, CASE WHEN line_no = 7 THEN 'C3' ELSE zone_id END AS zone_id FROM zoned_v")
def _(t):
    known = F.col("line_no") != 7
    zone = g.zone_id(F.when(known, F.col("centroid_x")), F.when(known, F.col("centroid_y")), IMAGE_W, IMAGE_H)
    return t.defects.select("defect_id", zone.alias("zone_id"))


_Z3 = "'R' || least(3, CAST(floor(centroid_y / 128.0) AS INT) + 1) || 'C' || least(3, CAST(floor(centroid_x / (512.0::DOUBLE / 3)) AS INT) + 1)"


@query("x14_zone_id_3x3", f"SELECT {_Z3} AS zone_id, count(*) AS n FROM defects_v GROUP BY 1")
def _(t):
    return t.defects.groupBy(g.zone_id_3x3("centroid_x", "centroid_y", IMAGE_W, IMAGE_H).alias("zone_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x15_member_from_position",
    "SELECT defect_id, CASE WHEN centroid_y > 384 * 0.65 THEN 'beam' WHEN centroid_x < 128 OR centroid_x > 384 THEN 'column' ELSE 'slab' END AS member FROM defects_v",
)
def _(t):
    return t.defects.select("defect_id", g.member_from_position("centroid_x", "centroid_y", IMAGE_W, IMAGE_H).alias("member"))


@query(
    "x16_exif_timestamp",
    "SELECT frame_id, CASE WHEN frame_id % 9 = 0 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS epoch_s FROM frames_v",
)
def _(t):
    text = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    text = F.when(F.col("frame_id") % 9 == 0, F.concat(F.lit("bad "), text)).otherwise(text)
    return t.frames.select("frame_id", F.unix_timestamp(g.exif_timestamp(text).cast("timestamp")).alias("epoch_s"))


@query(
    "x17_reinspection_date",
    """SELECT inspection_id, inspection_date + CAST(CASE inspection_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 90 ELSE 365 END AS INT) AS by_intervention,
        inspection_date + CAST(CASE inspection_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE 365 END AS INT) AS by_severity,
        inspection_date + CAST(CASE inspection_id % 4 WHEN 0 THEN 365 WHEN 1 THEN 180 WHEN 2 THEN 90 ELSE 30 END AS INT) AS by_width FROM inspections_v""",
)
def _(t):
    pick = lambda n, *names: F.get(F.array(*[F.lit(x) for x in names]), (F.col("inspection_id") % n).cast("int"))
    return t.inspections_base.select(
        "inspection_id",
        g.reinspection_date("inspection_date", "intervention", pick(3, "shear", "corrosion", "hairline")).alias("by_intervention"),
        g.reinspection_date("inspection_date", "severity", pick(4, "critical", "severe", "moderate", "minor")).alias("by_severity"),
        g.reinspection_date("inspection_date", "width", pick(4, "hairline", "fine", "medium", "wide")).alias("by_width"),
    )


@query("x18_spall_dims", "SELECT defect_id, round(sqrt(bbox_w * bbox_w + bbox_h * bbox_h) * 0.15, 7) AS length_cm, least(bbox_w, bbox_h) * 0.15::DOUBLE * 10 AS width_mm FROM defects_v")
def _(t):
    out = t.defects.select("defect_id", g.spall_dims("bbox_w", "bbox_h", F.lit(0.15)).alias("s"))
    return out.select("defect_id", F.round("s.length_cm", 7).alias("length_cm"), "s.width_mm")


@query(
    "x19_safe_json",
    """SELECT request_id, CAST(CASE request_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS INT) AS n_items,
        CASE WHEN request_id % 5 = 0 THEN CAST(json_extract(meta_json, '$.k') AS INT) END AS k FROM requests_v""",
)
def _(t):
    i = F.col("request_id") % 5
    text = (
        F.when(i == 0, F.col("meta_json")).when(i == 1, "not-json{{{").when(i == 3, F.concat(F.lit("["), "meta_json", F.lit(', "x"]'))).when(i == 4, "7")
    )
    rows = t.requests.select("request_id", text.alias("raw"))
    return rows.select(
        "request_id",
        F.size(g.safe_json_list("raw")).alias("n_items"),
        F.try_element_at(g.safe_json_map("raw"), F.lit("k")).cast("int").alias("k"),
    )


@query(
    "x20_identifiers",
    "SELECT inspection_id, building_id || '_' || CAST(inspection_date AS VARCHAR) || '_C' || cycle_id AS key FROM inspections_v",
)
def _(t):
    return t.inspections.select("inspection_id", g.inspection_key("building_id", "inspection_date", "cycle_id").alias("key"))


@query("x20_type_titles", "SELECT type, CASE type WHEN 'water_seepage' THEN 'Water Seepage' WHEN 'shear_crack' THEN 'Shear Crack' WHEN 'compression_crack' THEN 'Compression Crack' ELSE upper(type[1]) || substr(type, 2) END AS title, count(*) AS n FROM defects_v GROUP BY 1, 2")
def _(t):
    return t.defects.groupBy("type", g.title("type").alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query("x21_content_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def _(t):
    """Copies collapse on their hash; one pass with map-side combine, whole texts hashed once."""
    return t.raw("documents").groupBy(g.content_hash("text").alias("content_hash")).agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")
    )


@query("x22_band_colour", f"SELECT {s.case_bands('(width_mm * 12.5::DOUBLE)', r.VI_BANDS, 5)} AS colour, count(*) AS n FROM defects_v GROUP BY 1")
def _(t):
    return t.defects.groupBy(r.band_colour(F.col("width_mm") * 12.5).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "x23_calc_breakdown",
    """SELECT defect_id, mean_gsd, round(width_mm / (mean_gsd * 10), 7) AS width_px, CASE WHEN a >= 70 THEN 'near-vertical' WHEN a <= 20 THEN 'near-horizontal' ELSE 'diagonal' END AS angle_band, CAST(4 AS INT) AS n_steps
       FROM (SELECT defect_id, width_mm, part_no % 91 AS a, CASE WHEN line_no <> 7 THEN ((1 + line_no) / 1e1 + 0.3::DOUBLE) / 2 END AS mean_gsd FROM defects_v) d""",
)
def _(t):
    rows = t.defects.select(
        "defect_id", "width_mm", "length_cm", (F.col("part_no") % 91).cast("double").alias("angle_deg"),
        F.when(F.col("line_no") != 7, (F.lit(1) + F.col("line_no")) / 10.0).alias("gsd_x"), F.lit(0.3).alias("gsd_y"),
    )
    out = reports.calc_breakdown(rows)
    return out.select("defect_id", "mean_gsd", F.round("width_px", 7).alias("width_px"), "angle_band", F.size("steps").alias("n_steps"))


@query(
    "x24_zone_bounds",
    """SELECT zone_id, count(*) AS n, min((ascii(zone_id) - 65) * 128e0) AS x1, min((ascii(zone_id) - 64) * 128e0) AS x2,
        min((4 - CAST(substr(zone_id, 2) AS INT)) * 96e0) AS y1, min((5 - CAST(substr(zone_id, 2) AS INT)) * 96e0) AS y2, min(384 - centroid_y) AS lat FROM zoned_v GROUP BY 1""",
)
def _(t):
    rows = t.defects.select(g.zone_id("centroid_x", "centroid_y", IMAGE_W, IMAGE_H).alias("zone_id"), g.map_point("centroid_x", "centroid_y", IMAGE_H)["lat"].alias("lat"))
    counted = rows.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("lat"))
    return counted.withColumn("b", g.zone_bounds("zone_id", IMAGE_W, IMAGE_H)).select("zone_id", "n", "b.*", "lat")


@query("s8_artifact_keys", "SELECT inspection_id, building_id || '/' || CAST(inspection_date AS VARCHAR) || '_00-00-00/inspection_results.json' AS artifact_key, 'results/' || building_id || '/cycle_' || cycle_id || '/' || inspection_id AS result_key FROM inspections_v")
def _(t):
    ts = F.concat(F.col("inspection_date").cast("string"), F.lit(" 00:00:00"))
    return t.inspections.select(
        "inspection_id",
        g.artifact_key("building_id", ts, F.lit("inspection_results")).alias("artifact_key"),
        g.result_key("building_id", "cycle_id", "inspection_id").alias("result_key"),
    )
