"""Queries of sources, the store, its listings and its checks (S*, K1-K4, J6-J8, J16, A11, A12, A29, A30, Q*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from facadelake.operators import listing, quality, reports
from facadelake.plans.q_scoring import _NESTED, documents, scored
from facadelake.plans.registry import query, sql_view
from facadelake.session import work_dir
from facadelake.sources import detections, documents as docs, frames, store

# --- sources ----------------------------------------------------------------------------------------


def _flights(t):
    """Frames written as one folder per flight."""
    path = work_dir(t.spark, "flights")
    # A folder costs far more than its rows: folders are dealt over all tasks, whatever their bytes, and each task moves its own in place.
    writer = t.frames.select("flight_id", "frame_id").repartition(t.parts(), "flight_id").write.partitionBy("flight_id")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)
    return path


@query("s1_list_frames", "SELECT CAST(flight_id AS VARCHAR) AS flight_id, '.json' AS ext, true AS filled FROM frames_v GROUP BY 1")
def _(t):
    """Extensions per flight folder, from the listing alone."""
    found = frames.list_frames(t.spark, _flights(t), exts=(".json",), recursive=True)
    flight = F.regexp_extract("filepath", r"flight_id=([^/]+)/", 1).alias("flight_id")
    return found.groupBy(flight, F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1)).alias("ext")).agg(F.min(F.col("length") > 0).alias("filled"))


@query("s15_flight_batch", "SELECT 'flight_id=' || flight_id AS flight_id FROM frames_v GROUP BY 1")
def _(t):
    return frames.flight_batch(t.spark, _flights(t), exts=(".json",)).select("flight_id").distinct()


@query("a30_flight_outcomes", "SELECT CASE WHEN ok THEN 'succeeded' ELSE 'failed' END AS status, count(*) AS flights FROM (SELECT flight_id, avg(mean_intensity) >= 127 AS ok FROM frames_v GROUP BY 1) f GROUP BY 1")
def _(t):
    runs = t.frames.groupBy("flight_id").agg(F.when(F.avg("mean_intensity") >= 127, "succeeded").otherwise("failed").alias("status"))
    return frames.flight_outcomes(runs)


@query(
    "s2_merge_frame_tags",
    """SELECT frame_id, CASE WHEN frame_id % 3 <> 0 AND relative_altitude IS NOT NULL THEN relative_altitude + 1 WHEN frame_id % 2 = 0 THEN relative_altitude END AS relative_altitude,
         CASE WHEN frame_id % 2 = 0 THEN focal_length_mm END AS focal_length_mm FROM frames_v WHERE frame_id % 3 <> 0 OR frame_id % 2 = 0""",
)
def _(t):
    first = t.frames.where("frame_id % 2 = 0").select("frame_id", "relative_altitude", "focal_length_mm")
    text = F.concat(F.lit("+"), F.format_string("%.1f", F.col("relative_altitude") + 1.0))
    second = t.frames.where("frame_id % 3 <> 0").select("frame_id", F.when(F.col("relative_altitude").isNotNull(), text).alias("relative_altitude"), F.lit("n/a").alias("focal_length_mm"))
    return frames.merge_frame_tags(first, second)


def payloads(t):
    """One response per defect; some failed, some incomplete, some not JSON."""
    box = F.struct(F.greatest("bbox_x", F.lit(-3)).alias("x"), F.greatest("bbox_y", F.lit(-3)).alias("y"), F.col("bbox_w").alias("width"), F.col("bbox_h").alias("height"))
    det = F.struct(
        "defect_id", F.col("type").alias("defect_type"), F.when(F.col("line_no") != 6, F.col("confidence")).alias("confidence"), box.alias("bbox"),
        F.when(F.col("line_no") == 1, "0 4 12").alias("mask"), F.when(F.col("line_no") == 1, "rle").alias("mask_encoding"), F.when(F.col("part_no") % 2 == 0, F.array(F.lit(4), F.lit(4))).alias("mask_shape"),
    )
    body = F.struct(
        F.when(F.col("line_no") == 7, "error").when(F.col("line_no") != 5, "success").alias("status"), F.when(F.col("line_no") == 7, "overload").alias("error_message"),
        F.lit(384).alias("image_height_px"), F.lit(512).alias("image_width_px"), F.array(det).alias("detections"),
    )
    return t.boxes.select(F.col("defect_id").alias("response_id"), F.when(F.col("part_no") % 100 == 3, "{broken").otherwise(F.to_json(body)).alias("payload"))


@query("s4_detections", "SELECT defect_id, CAST(0 AS INT) AS ordinal, type AS defect_type, confidence, CASE WHEN line_no = 1 THEN 'rle' ELSE 'none' END AS mask_encoding FROM defects_v WHERE part_no % 100 <> 3 AND line_no < 5")
def _(t):
    good, _ = detections.explode_detections(payloads(t))
    return good.select("defect_id", "ordinal", "defect_type", "confidence", "mask_encoding")


@query("s4_rejects", "SELECT CASE WHEN part_no % 100 = 3 THEN 'malformed' WHEN line_no = 5 THEN 'missing keys' WHEN line_no = 7 THEN 'status: overload' ELSE 'incomplete detection' END AS reject_reason, count(*) AS n FROM defects_v WHERE part_no % 100 = 3 OR line_no >= 5 GROUP BY 1")
def _(t):
    _, bad = detections.explode_detections(payloads(t))
    return bad.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q2_detection_checks",
    """SELECT rule, count(*) AS n FROM (
         SELECT unnest(list_filter([CASE WHEN type IN ('shear_crack', 'compression_crack', 'stain') THEN 'defect_type enum' END, CASE WHEN bbox_x < 0 OR bbox_y < 0 THEN 'bbox origin' END,
                CASE WHEN line_no = 1 AND part_no % 2 = 1 THEN 'mask_shape' END], lambda x: x IS NOT NULL)) AS rule FROM boxes_v WHERE part_no % 100 <> 3 AND line_no < 5) r GROUP BY 1""",
)
def _(t):
    good, _ = detections.explode_detections(payloads(t))
    return quality.check_detections(good).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# --- documents and files --------------------------------------------------------------------------------


@query("s5_write_documents", _NESTED)
def _(t):
    """Documents written, read back with their schema, and flattened."""
    nested = documents(t)
    path = work_dir(t.spark, "documents")
    docs.write_documents(nested, path, "2024-01-01T00:00:00Z", "threshold: 1")
    building = T.StructType([f for f in nested.schema if f.name != "facade_id"])
    schema = T.StructType([T.StructField("pipeline_config_hash", T.StringType()), T.StructField("buildings", T.ArrayType(building))])
    back = t.spark.read.schema(schema).json(path).select(F.explode("buildings").alias("b")).select("b.*")
    return reports.flatten(back).select(
        "building_id", "facade_id", "orientation", "zone_id", "defect_id", "type", "length_cm", "width_mm", "severity_class", "is_false_positive"
    )


@query(
    "s6_geojson_points",
    "SELECT inspection_id, defect_id, type, 87 + centroid_x / 1e3 AS lon, 22 + centroid_y / 1e3 AS lat, CASE WHEN line_no = 1 THEN 'propagated' ELSE 'new' END AS temporal_status, is_false_positive FROM defects_v",
)
def _(t):
    rows = scored(t).withColumns(
        {
            "lon": F.lit(87.0) + F.col("centroid_x") / 1000.0, "lat": F.lit(22.0) + F.col("centroid_y") / 1000.0, "vi_contribution": F.col("vi"), "confidence_score": F.col("confidence"),
            "temporal_status": F.when(F.col("line_no") == 1, "propagated"),
        }
    )
    return docs.read_features(docs.geojson_points(rows, "inspection_id"), "inspection_id")


@query("s7_geojson_polygons", "SELECT inspection_id, count(*) AS n_features FROM defects_v WHERE line_no <> 7 GROUP BY 1")
def _(t):
    x, y, w, h = (F.col(c).cast("double") for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h"))
    ring = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    rows = t.boxes.withColumns({"contour": F.when(F.col("line_no") != 7, ring), "severity": F.col("severity_b")})
    out = docs.geojson_polygons(rows, "inspection_id")
    corners = F.size(F.from_json("feature", "struct<geometry:struct<coordinates:array<array<array<double>>>>>")["geometry"]["coordinates"][0])
    return out.groupBy("inspection_id").agg(F.count_if(corners == 4).alias("n_features"))


@query("s12_append_audit", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT client_id) AS users FROM requests_v GROUP BY 1")
def _(t):
    path = work_dir(t.spark, "audit")
    rows = t.requests.select("request_id", F.col("client_id").alias("user_id"), F.col("endpoint").alias("action"), F.col("meta_json").alias("metadata"), F.col("ts").alias("created_at"))
    for even in (0, 1):
        store.append_audit(rows.where(F.col("request_id") % 2 == even), path)
    return t.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("s14_export_metadata", "SELECT flight_id, count(*) AS n, count(relative_altitude) AS n_alt, CAST(min(ts) AS DATE) AS first_day FROM frames_v GROUP BY 1")
def _(t):
    path = work_dir(t.spark, "metadata")
    frames.export_metadata(t.frames, path)
    schema = "frame_id long, flight_id long, ts string, relative_altitude double"
    return t.spark.read.schema(schema).json(path).groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("relative_altitude").alias("n_alt"), F.to_date(F.min("ts")).alias("first_day")
    )


# --- store ---------------------------------------------------------------------------------------------


def heads(t):
    return t.inspections_base.select("inspection_id", "building_id", "status", F.col("inspection_date").cast("timestamp").alias("run_timestamp"))


@query(
    "s9_upsert",
    "SELECT inspection_id, building_id, CASE WHEN inspection_id % 3 = 1 THEN status ELSE 'again' END AS status, CAST(CASE WHEN inspection_id % 3 = 2 THEN 2 ELSE 1 END AS INT) AS row_version FROM inspections_v",
)
def _(t):
    rows = heads(t)
    target = rows.where("inspection_id % 3 <> 0").withColumn("row_version", F.lit(1))
    part = rows.where("inspection_id % 3 <> 1")
    later = part.withColumns({"status": F.lit("again"), "run_timestamp": F.col("run_timestamp") + F.expr("INTERVAL 1 HOUR")})
    return store.upsert_inspections(target, part.unionByName(later)).select("inspection_id", "building_id", "status", "row_version")


@query(
    "s10_child_replace",
    """SELECT inspection_id, count(*) AS n, count(*) FILTER (WHERE acc = 0) AS zero_acc FROM (SELECT inspection_id, CASE WHEN inspection_id % 4 = 0 THEN CASE WHEN line_no = 2 THEN 0 ELSE 5e-1 END ELSE 1e0 END AS acc
         FROM defects_v WHERE inspection_id % 4 <> 0 OR line_no < 4) d GROUP BY 1""",
)
def _(t):
    rows = t.defects.select("defect_id", "inspection_id", "type", "width_mm", F.lit(1.0).alias("growth_acceleration"), "line_no")
    delivered = t.inspections_base.where("inspection_id % 4 = 0")
    batch = rows.where("inspection_id % 4 = 0 AND line_no < 4").withColumn("growth_acceleration", F.when(F.col("line_no") != 2, 0.5))
    out = store.replace_defects(rows.drop("line_no"), batch.drop("line_no"), delivered)
    return out.groupBy("inspection_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("growth_acceleration") == 0).alias("zero_acc"))


@query("s11_replace_by_key", "SELECT defect_id, CASE WHEN line_no = 1 THEN width_mm + 2 ELSE width_mm END AS width_mm FROM defects_v")
def _(t):
    rows = t.defects.select("defect_id", "inspection_id", "width_mm", "line_no")
    batch = rows.where("line_no = 1")
    twice = batch.withColumns({"width_mm": F.col("width_mm") + 2, "seq": F.lit(2)}).unionByName(batch.withColumns({"width_mm": F.col("width_mm") + 1, "seq": F.lit(1)}))
    return store.replace_by_key(rows.withColumn("seq", F.lit(0)), twice, "defect_id", "seq").select("defect_id", "width_mm")


@query("s13_conform", "SELECT defect_id, type, CAST(NULL AS DOUBLE) AS growth_acceleration, CAST(NULL AS VARCHAR) AS grid_reference FROM defects_v")
def _(t):
    schema = T.StructType().add("defect_id", "string").add("type", "string").add("growth_acceleration", "double").add("grid_reference", "string")
    return store.conform(t.defects.select("type", "defect_id"), schema)


# --- listings --------------------------------------------------------------------------------------------


def jobs(t):
    return t.inspections_base.select(F.col("inspection_id").alias("job_id"), "org_id", "building_id", "status", F.col("inspection_date").alias("queued_at"))


@query("k1_page_jobs", "SELECT inspection_id AS job_id, building_id FROM inspections_v WHERE org_id = 7 AND status = 'succeeded' ORDER BY inspection_date DESC, inspection_id LIMIT 20 OFFSET 20")
def _(t):
    page, _ = listing.page_jobs(jobs(t), 7, status="succeeded", page=2, size=20)
    return page.select("job_id", "building_id")


@query("k1_page_totals", "SELECT count(*) AS total, (count(*) + 19) // 20 AS pages FROM inspections_v WHERE org_id = 7")
def _(t):
    return listing.page_jobs(jobs(t), 7)[1]


@query("k2_page_defects", "SELECT defect_id, area_cm2 AS area_px2 FROM defects_v WHERE type = 'crack' ORDER BY area_cm2 DESC, defect_id LIMIT 200 OFFSET 200")
def _(t):
    rows = t.defects.where("type = 'crack'").withColumn("area_px2", F.col("area_cm2"))
    return listing.page_defects(rows, "severity", page=2, size=500)[0].select("defect_id", "area_px2")


@query("k2_deep_page", "SELECT defect_id, area_cm2 AS area_px2 FROM defects_v ORDER BY area_cm2 DESC NULLS LAST, defect_id LIMIT 200 OFFSET 3000")
def _(t):
    """A page as a deep one is read: by the ranges it lies in."""
    rows = t.defects.withColumn("area_px2", F.col("area_cm2"))
    return listing.page_defects(rows, "area", page=16, size=200, shallow=0)[0].select("defect_id", "area_px2")


@query("k3_latest_inspections", "SELECT inspection_id, building_id FROM inspections_v ORDER BY inspection_date DESC, inspection_id DESC LIMIT 200")
def _(t):
    return listing.latest_inspections(heads(t), limit=1000).select("inspection_id", "building_id")


@query("k4_defects_alphabetical", "SELECT defect_id, severity_b AS severity, area_cm2 AS area_px2 FROM defects_v ORDER BY severity_b DESC, area_cm2 DESC, defect_id")
def _(t):
    rows = t.defects.select("defect_id", F.col("severity_b").alias("severity"), F.col("area_cm2").alias("area_px2"))
    return listing.defects_alphabetical(rows)


@query("j6_jobs_with_results", "SELECT i.inspection_id AS job_id, CASE WHEN status = 'succeeded' THEN d.n END AS total_defects FROM inspections_v i LEFT JOIN (SELECT inspection_id, count(*) AS n FROM defects_v GROUP BY 1) d ON i.inspection_id = d.inspection_id")
def _(t):
    done = jobs(t).where("status = 'succeeded'").select("job_id")
    counts = t.defects.groupBy(F.col("inspection_id").alias("job_id")).agg(F.count(F.lit(1)).alias("total_defects"))
    return listing.jobs_with_results(jobs(t), counts.join(done, "job_id")).select("job_id", "total_defects")


@query("j7_in_flight", "SELECT s.inspection_id, EXISTS (SELECT 1 FROM inspections_v j WHERE j.building_id = s.building_id AND j.cycle_id = s.cycle_id + 1 AND j.status IN ('pending', 'running')) AS conflict FROM inspections_v s")
def _(t):
    asked = t.inspections.select("inspection_id", "building_id", (F.col("cycle_id") + 1).alias("cycle_id"))
    fine, conflict = listing.reject_in_flight(asked, t.inspections)
    return fine.select("inspection_id", F.lit(False).alias("conflict")).unionByName(conflict.select("inspection_id", F.lit(True).alias("conflict")))


@query("j8_orphans", "SELECT defect_id FROM defects_v WHERE inspection_id % 10 = 0")
def _(t):
    return quality.orphan_defects(t.defects, t.inspections_base.where("inspection_id % 10 <> 0")).select("defect_id")


@query("j16_latest_defects", "SELECT defect_id, inspection_id FROM defects_v WHERE inspection_id = (SELECT arg_max(inspection_id, (inspection_date, inspection_id)) FROM inspections_v WHERE inspection_id IN (SELECT inspection_id FROM defects_v))")
def _(t):
    busy = heads(t).join(t.defects.select("inspection_id"), "inspection_id", "left_semi")
    return listing.latest_defects(busy, t.defects).select("defect_id", "inspection_id")


@query("a11_store_stats", "SELECT count(*) AS total_inspections, count(DISTINCT building_id) AS unique_buildings, (SELECT count(*) FROM defects_v) AS total_defects FROM inspections_v")
def _(t):
    return listing.store_stats(t.inspections_base, t.defects)


@query("a12_org_stats", "SELECT CAST(n_nationkey AS BIGINT) AS org_id, coalesce(n, 0) AS total_jobs FROM nation LEFT JOIN (SELECT org_id, count(*) AS n FROM inspections_v WHERE org_id % 5 <> 0 GROUP BY 1) j ON n_nationkey = org_id WHERE n_regionkey <> 4")
def _(t):
    orgs = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("org_id"), (F.col("n_regionkey") != 4).alias("is_active"))
    return listing.org_stats(orgs, jobs(t).where("org_id % 5 <> 0"))


# --- checks ----------------------------------------------------------------------------------------------


def check_documents_input(t):
    """One nested document per defect, with faults planted at every level."""
    n = F.col("line_no")
    defect = F.struct(
        F.when(n == 3, "bad id!").otherwise(F.col("defect_id")).alias("defect_id"), "type", F.when(n != 2, F.col("area_cm2")).alias("area_cm2"),
        F.struct(F.lit(22.3).alias("lat"), F.when(F.col("part_no") % 40 == 0, 187.5).otherwise(87.3).alias("lon")).alias("centroid_gps"),
        F.struct(F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y")).alias("centroid_px"), F.col("severity_b").alias("severity_class"),
        F.lit(0.5).alias("vi_contribution"), F.when(F.col("supp_no") == 5, 1.5).otherwise(F.col("confidence")).alias("confidence_score"), "is_false_positive",
        F.when(n == 1, F.array(F.lit(1))).alias("bbox_px"),
    )
    zone = F.struct(
        F.when(n == 4, "1A").otherwise("A1").alias("grid_id"), F.lit(10.0).alias("zone_area_cm2"), F.lit(1.5).alias("zone_vi"), F.lit(1).alias("defect_count"),
        F.lit("crack").alias("dominant_defect_type"), F.array(defect).alias("defects"),
    )
    facade = F.struct(
        F.lit("F").alias("id"), F.when(n == 5, "UP").otherwise("N").alias("orientation"), F.lit(1.0).alias("area_m2"), F.lit(12.0).alias("vi_score"), F.lit("minor").alias("vi_class"),
        F.lit("m.png").alias("mosaic_path"), F.struct(F.lit(2.0).alias("clahe_clip_limit")).alias("enhancement_params"), F.array(zone).alias("zones"),
    )
    building = F.struct(
        F.lit("B").alias("id"), F.lit("n").alias("name"), F.when(n != 6, "a").alias("address"), F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")).alias("gps_centroid"),
        F.lit("2024-01-01").alias("inspection_date"), F.lit("1").alias("inspector_module_version"), F.when(F.col("part_no") % 50 == 0, 0).otherwise(1).alias("cycle_number"), F.array(facade).alias("facades"),
    )
    root = F.struct(
        F.when(n == 7, "0.9").otherwise("1.0.0").alias("schema_version"), F.lit("2024-01-01T00:00:00Z").alias("generated_at"), F.lit("ab").alias("pipeline_config_hash"), F.array(building).alias("buildings"),
    )
    json, k = F.to_json(root), F.col("part_no") % 30
    # Faults that change a value's type or the keys of an object; a row has one case, so one pass over its text.
    cases = (
        (1, '"lat":1.0', '"lat":500.0'), (2, '"2024-01-01"', '"nope"'), (3, '"2024-01-01T00:00:00Z"', '"not a date"'), (4, '"cycle_number":1', '"cycle_number":1.5'),
        (5, '"facades":', '"temporal_comparison":{"comparison_cycle":1,"bogus":2},"facades":'), (6, ',"lon":87.3', ""), (7, '"lat":22.3', '"lat":22.3,"alt":1'),
        (8, '"clahe_clip_limit":2.0', '"clahe_clip_limit":2.0,"clahe_tile_size":[8,8,8],"extra":1'), (9, '"is_false_positive":', '"is_false_positive":0,"fp_confidence":'),
        (11, '"area_m2":1.0', '"area_m2":"1.0"'), (12, '"zones":[', '"zones":[7,'), (13, '"mosaic_path":"m.png"', '"mosaic_path":null'),
    )
    old, new = (reduce(lambda when, c: when.when(k == c[0], c[i]), cases, F.when(F.lit(False), "")).otherwise("\0") for i in (1, 2))
    json = F.replace(json, old, new)
    return t.spread_defects().select("defect_id", json.alias("json"))


@query(
    "q1_document_checks",
    """SELECT v.level, v.rule, v.field, count(*) AS n FROM (SELECT unnest(list_filter([
         CASE WHEN line_no = 7 THEN {level: 'root', rule: 'enum', field: 'schema_version'} END, CASE WHEN line_no = 6 THEN {level: 'building', rule: 'required', field: 'address'} END,
         CASE WHEN part_no % 50 = 0 THEN {level: 'building', rule: 'min', field: 'cycle_number'} END, CASE WHEN line_no = 5 THEN {level: 'facade', rule: 'enum', field: 'orientation'} END,
         CASE WHEN line_no = 4 THEN {level: 'zone', rule: 'pattern', field: 'grid_id'} END, CASE WHEN line_no = 3 THEN {level: 'defect', rule: 'pattern', field: 'defect_id'} END,
         CASE WHEN line_no = 2 THEN {level: 'defect', rule: 'required', field: 'area_cm2'} END, CASE WHEN line_no = 1 THEN {level: 'defect', rule: 'unknown key', field: 'bbox_px'} END,
         CASE WHEN severity_b <> 'hairline' THEN {level: 'defect', rule: 'enum', field: 'severity_class'} END, CASE WHEN supp_no = 5 THEN {level: 'defect', rule: 'range', field: 'confidence_score'} END,
         CASE WHEN part_no % 40 = 0 THEN {level: 'defect', rule: 'range', field: 'centroid_gps.lon'} END,
         CASE WHEN part_no % 30 = 1 THEN {level: 'building', rule: 'range', field: 'gps_centroid.lat'} END, CASE WHEN part_no % 30 = 2 THEN {level: 'building', rule: 'format', field: 'inspection_date'} END,
         CASE WHEN part_no % 30 = 3 THEN {level: 'root', rule: 'format', field: 'generated_at'} END, CASE WHEN part_no % 30 = 4 AND part_no % 50 <> 0 THEN {level: 'building', rule: 'type', field: 'cycle_number'} END,
         CASE WHEN part_no % 30 = 5 THEN {level: 'building', rule: 'unknown key', field: 'temporal_comparison.bogus'} END, CASE WHEN part_no % 30 = 5 THEN {level: 'building', rule: 'required', field: 'temporal_comparison.delta_vi'} END,
         CASE WHEN part_no % 30 = 5 THEN {level: 'building', rule: 'required', field: 'temporal_comparison.new_defects_count'} END,
         CASE WHEN part_no % 30 = 5 THEN {level: 'building', rule: 'required', field: 'temporal_comparison.propagated_defects_count'} END,
         CASE WHEN part_no % 30 = 6 AND part_no % 40 <> 0 THEN {level: 'defect', rule: 'required', field: 'centroid_gps.lon'} END, CASE WHEN part_no % 30 = 7 THEN {level: 'defect', rule: 'unknown key', field: 'centroid_gps.alt'} END,
         CASE WHEN part_no % 30 = 8 THEN {level: 'facade', rule: 'length', field: 'enhancement_params.clahe_tile_size'} END, CASE WHEN part_no % 30 = 9 THEN {level: 'defect', rule: 'type', field: 'is_false_positive'} END,
         CASE WHEN part_no % 30 = 9 THEN {level: 'defect', rule: 'type', field: 'fp_confidence'} END, CASE WHEN part_no % 30 = 11 THEN {level: 'facade', rule: 'type', field: 'area_m2'} END,
         CASE WHEN part_no % 30 = 12 THEN {level: 'facade', rule: 'type', field: 'zones[]'} END, CASE WHEN part_no % 30 = 13 THEN {level: 'facade', rule: 'type', field: 'mosaic_path'} END], lambda x: x IS NOT NULL)) AS v FROM defects_v) u GROUP BY 1, 2, 3""",
)
def _(t):
    return quality.check_documents(check_documents_input(t), "defect_id").groupBy("level", "rule", "field").agg(F.count(F.lit(1)).alias("n"))


def audited(t):
    inspections = t.inspections_base.withColumn("warnings_json", F.when(F.col("inspection_id") % 100 == 0, "oops{").otherwise("[]")).where("inspection_id % 1000 <> 1")
    return inspections, t.defects.withColumn("growth_acceleration", F.lit(0.0))


_AUDIT = """SELECT 'inspections row count' AS check_name, 'pass' AS status, count(*) AS n FROM inspections_v WHERE inspection_id % 1000 <> 1
    UNION ALL SELECT 'defects row count', 'pass', count(*) FROM defects_v
    UNION ALL SELECT 'foreign key violations', CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END, count(*) FROM defects_v WHERE inspection_id % 1000 = 1
    UNION ALL SELECT 'growth_acceleration null rows', 'pass', 0
    UNION ALL SELECT 'warnings_json parseable', CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END, count(*) FROM inspections_v WHERE inspection_id % 100 = 0"""


@query("q3_store_audit", _AUDIT)
def _(t):
    return quality.store_audit(*audited(t))


@query("a29_probe_summary", f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'warn') AS warned FROM ({_AUDIT}) a")
def _(t):
    return quality.probe_summary(quality.store_audit(*audited(t)))


@query("q4_duplicate_keys", "SELECT inspection_id, line_no, count(*) AS n FROM defects_v GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return quality.duplicate_keys(t.defects, ["inspection_id", "line_no"])


sql_view("class_v", "SELECT inspection_id, CASE inspection_id % 6 WHEN 0 THEN 'minor' WHEN 1 THEN 'severe' WHEN 2 THEN 'significant' WHEN 3 THEN 'critical' WHEN 4 THEN 'moderate' END AS vi_class FROM inspections_v")


@query("q5_class_domain", "SELECT inspection_id, vi_class FROM class_v WHERE vi_class IS NULL OR vi_class NOT IN ('minor', 'moderate', 'severe', 'critical')")
def _(t):
    pick = F.expr("CASE inspection_id % 6 WHEN 0 THEN 'minor' WHEN 1 THEN 'severe' WHEN 2 THEN 'significant' WHEN 3 THEN 'critical' WHEN 4 THEN 'moderate' END")
    return quality.class_domain(t.inspections_base.select("inspection_id", pick.alias("vi_class")))
