"""Store writes, documents and streams: repeated, late and split deliveries."""

import datetime
import os

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facadelake.operators import quality, reports, scoring, temporal
from facadelake.plans import q_store
from facadelake.plans.q_scoring import documents as documents_of
from facadelake.sources import documents, frames, store, tables
from facadelake.streaming import jobs, sinks

DOC = "inspection_id string, building_id string, inspection_date string, vi_score double, vi_class string, run_timestamp string, defects array<struct<defect_id:string,type:string,growth_acceleration:double>>"


def doc(i, run, n, score=1.0):
    return (f"b{i}_2024-01-01_C1", f"b{i}", "2024-01-01", score, "minor", run, [(f"{i}-{k}", "crack", None if k == 0 else 0.5) for k in range(n)])


def state(spark, path):
    heads = {x["inspection_id"]: (x["row_version"], x["vi_score"]) for x in store.read_inspections(spark, path).collect()}
    rows = store.read_defects(spark, path).groupBy("inspection_id").count().collect()
    return heads, {x["inspection_id"]: x["count"] for x in rows}


def test_ingest_repeats_and_updates(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "store")
    write = lambda rows: spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = sinks.read_stream(spark, str(tmp_path), "src")
        q = jobs.ingest_inspections(stream, out, str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None

    write([doc(1, "t1", 3), doc(2, "t1", 2), doc(1, "t2", 4, 9.0)])
    run()
    heads, rows = state(spark, out)
    assert heads == {"b1_2024-01-01_C1": (1, 9.0), "b2_2024-01-01_C1": (1, 1.0)}
    assert rows == {"b1_2024-01-01_C1": 4, "b2_2024-01-01_C1": 2}
    write([doc(1, "t3", 1, 5.0)])
    run()
    heads, rows = state(spark, out)
    assert heads["b1_2024-01-01_C1"] == (2, 5.0) and heads["b2_2024-01-01_C1"] == (1, 1.0)
    assert rows == {"b1_2024-01-01_C1": 1, "b2_2024-01-01_C1": 2}
    run()
    assert state(spark, out) == (heads, rows)
    # A stream begun anew counts its batches from 0; it updates inspections and defects together.
    write([doc(2, "t4", 0, 7.0)])
    q = jobs.ingest_inspections(sinks.read_stream(spark, str(tmp_path), "src"), out, str(tmp_path / "cp2"))
    q.awaitTermination()
    heads, rows = state(spark, out)
    assert heads == {"b1_2024-01-01_C1": (3, 5.0), "b2_2024-01-01_C1": (2, 7.0)} and rows == {"b1_2024-01-01_C1": 1}
    store.compact(spark, out, f"{out}2")
    assert state(spark, f"{out}2") == (heads, rows)
    zero = store.read_defects(spark, out).where("growth_acceleration IS NULL").count()
    assert zero == 0


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    heads = spark.createDataFrame([("i1", "b1", "r1", 1.0)], "inspection_id string, building_id string, run_timestamp string, vi_score double")
    rows = spark.createDataFrame([("d1", "i1", "b1", None)], "defect_id string, inspection_id string, building_id string, growth_acceleration double")
    for batch in (5, 5, 6, 6):
        store.apply_batch(spark, str(tmp_path), heads, rows, batch)
    path = str(tmp_path)
    assert store.read_inspections(spark, path).first()["row_version"] == 2
    assert store.read_defects(spark, path).count() == 1
    # Delivered without defects, and moved to another building: one row, nothing left of the old.
    store.apply_batch(spark, path, heads.withColumn("building_id", F.lit("b2")), rows.limit(0), 0, "other")
    assert [(r.building_id, r.row_version) for r in store.read_inspections(spark, path).collect()] == [("b2", 3)]
    assert store.read_defects(spark, path).count() == 0


def test_assemble_keeps_everything(spark):
    """One building with most of the defects: a document per facade, every defect in it."""
    names = "defect_id string, type string, length_cm double, width_mm double, area_cm2 double, severity_class string, vi_contribution double, confidence_score double, is_false_positive boolean, centroid_x int, centroid_y int"
    where = [("b" if i % 20 else "c", f"f{i % 3}", f"A{i % 2}") for i in range(570)]
    defects = spark.createDataFrame(
        [(*w, f"d{i}", "crack", 1.0, 1.0, 1.0, "fine", 0.1, 0.9, i % 5 == 0, i, i) for i, w in enumerate(where)], "building_id string, facade_id string, zone_id string, " + names
    )
    facade_keys = [(b, f"f{k}") for b in "bc" for k in range(3)]
    zones = spark.createDataFrame([(*k, z, 5.0, 1.0, 0, None) for k in facade_keys for z in ("A0", "A1", "A9")], "building_id string, facade_id string, zone_id string, zone_area_cm2 double, zone_vi double, defect_count int, dominant_defect_type string")
    facades = spark.createDataFrame([(*k, "N", 1.0, 2.0, "minor") for k in facade_keys], "building_id string, facade_id string, orientation string, area_m2 double, vi_score double, vi_class string")
    heads = spark.createDataFrame([("b", "name"), ("c", "other")], "building_id string, name string")
    docs = reports.assemble(heads, facades, zones, defects)
    assert sorted((r.building_id, r.facade_id) for r in docs.collect()) == facade_keys
    assert all(len(r.facades) == 1 and len(r.facades[0]["zones"]) == 3 for r in docs.collect())
    flat = reports.flatten(docs)
    assert {(r.building_id, r.facade_id, r.zone_id, r.defect_id) for r in flat.collect()} == {(*w, f"d{i}") for i, w in enumerate(where)}
    assert flat.count() == len(where)


def test_cycle_comparison_growth_and_flags(spark):
    rows = [("c1", "b", 1, 100, 100, 50, 20, 10.0, 1.0, 5.0), ("n1", "b", 2, 102, 101, 50, 20, 12.0, 1.5, 6.5), ("n2", "b", 2, 400, 400, 30, 30, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "defect_id string, building_id string, cycle_id int, bbox_x int, bbox_y int, bbox_w int, bbox_h int, length_cm double, width_mm double, area_cm2 double")
    out = {x["defect_id"]: x for x in temporal.match_iou(df, df, ["defect_id"]).collect()}
    hit = out["n1"]
    assert (hit["temporal_status"], hit["parent_defect_id"]) == ("propagated", "c1")
    assert (hit["delta_length_cm"], hit["delta_width_mm"], hit["delta_area_cm2"], hit["growth_rate_mm_per_month"]) == (2.0, 0.5, 1.5, 0.5)
    assert hit["crack_activity_status"] == "aggressive" and out["n2"]["temporal_status"] == "new"


def test_frames_from_files(spark, tmp_path):
    for name in ("a/x.JPG", "a/y.txt", "b/z.png", "loose.jpg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"1")
    got = [(x["flight_id"], x["filename"]) for x in frames.flight_batch(spark, str(tmp_path)).orderBy("filename").collect()]
    assert got == [("a", "x.JPG"), ("b", "z.png")]
    single = frames.flight_batch(spark, str(tmp_path / "a")).collect()
    assert [(x["flight_id"], x["filename"]) for x in single] == [("a", "x.JPG")]
    assert [x["filename"] for x in frames.list_frames(spark, str(tmp_path)).collect()] == ["loose.jpg"]


def test_admission_stream_over_several_batches(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, i, base + datetime.timedelta(seconds=7 * (i // 2))) for i in range(120)]
    for k in range(3):
        pdf = pd.DataFrame(rows[k * 40 : (k + 1) * 40], columns=["client_id", "request_id", "ts"])
        path = tmp_path / "req" / f"part{k}.parquet"
        path.parent.mkdir(exist_ok=True)
        pdf["ts"] = pdf["ts"].astype("datetime64[us]")
        pdf.to_parquet(path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    from facadelake.operators.admission import sliding_admission, token_bucket

    everything = spark.read.parquet(str(tmp_path / "req"))
    want = {(x["client_id"], x["t"]): x["admitted"] for x in sliding_admission(everything, 3, 60).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).collect()}
    q = sinks.append_files(jobs.admission_stream(sinks.read_stream(spark, str(tmp_path), "req", 1), 3, 60), str(tmp_path / "o1"), str(tmp_path / "c1"))
    q.awaitTermination()
    got = {(x["client_id"], x["t"]): x["admitted"] for x in spark.read.parquet(str(tmp_path / "o1")).collect()}
    assert got == want and len(set(want.values())) == 2
    q = sinks.append_files(jobs.token_bucket_stream(sinks.read_stream(spark, str(tmp_path), "req", 1), 2.0, 0.05), str(tmp_path / "o2"), str(tmp_path / "c2"))
    q.awaitTermination()
    batch = {x["request_id"]: x["admitted"] for x in token_bucket(everything, 2.0, 0.05).collect()}
    assert {x["request_id"]: x["admitted"] for x in spark.read.parquet(str(tmp_path / "o2")).collect()} == batch


def test_document_checks(spark):
    df = spark.createDataFrame([(1, "{bad"), (2, '{"schema_version":"1.0.0","generated_at":"x","pipeline_config_hash":"y","buildings":[],"extra":1}'), (3, '{"buildings":[]}')], "id int, json string")
    got = {(x["id"], x["rule"], x["field"]) for x in quality.check_documents(df, "id").collect()}
    assert got == {(1, "malformed", ""), (2, "unknown key", "extra"), (2, "format", "generated_at"), (3, "required", "schema_version"), (3, "required", "generated_at"), (3, "required", "pipeline_config_hash")}


def test_class_balance_needs_both(spark):
    from facadelake.operators import learn

    with pytest.raises(Exception, match="both classes"):
        learn.class_balance(spark.createDataFrame([(1,), (1,)], "y int")).collect()


def test_documents_by_facade_alone(spark, tmp_path):
    """Owners name the building of each facade: the same documents, each large table shuffled by its facade only; zones are made after
    the shuffles; written documents are compressed and read back whole."""
    names = "defect_id string, type string, length_cm double, width_mm double, area_cm2 double, severity_class string, vi_contribution double, confidence_score double, is_false_positive boolean, centroid_x int, centroid_y int"
    area = spark.createDataFrame([("f0", "b", 160.0), ("f1", "b", 0.0), ("f2", "c", 32.0)], "facade_id string, building_id string, facade_area_cm2 double")
    rows = [(f"f{i % 2}", f"A{i % 3}", f"d{i}", "crack" if i % 2 else "stain", 1.0, 1.0, 1.0, "fine", 0.1, 0.9, i % 5 == 0, i, i) for i in range(40)]
    defects = spark.createDataFrame(rows, "facade_id string, zone_id string, " + names)
    zones = scoring.zone_scores(defects.withColumn("vi", F.lit(0.5)), area, ["defect_id"], key="facade_id")
    plan = zones._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")
    facades = area.selectExpr("building_id", "facade_id", "'N' AS orientation", "1e0 AS area_m2", "2e0 AS vi_score", "'minor' AS vi_class")
    heads, owners = area.select("building_id").distinct(), area.select("building_id", "facade_id")
    docs = reports.assemble(heads, facades, zones, defects, owners)
    both = reports.assemble(heads, facades, zones.join(owners, "facade_id"), defects.join(owners, "facade_id"))
    assert sorted(docs.collect(), key=str) == sorted(both.collect(), key=str)
    assert {r.defect_id: r.zone_id for r in reports.flatten(docs).collect()} == {r[2]: r[1] for r in rows if r[1] != "A0"}
    documents.write_documents(docs, str(tmp_path / "docs"), "2024-01-01T00:00:00Z")
    files = list((tmp_path / "docs").glob("part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert spark.read.json(str(tmp_path / "docs")).count() == 3


def test_document_checks_use_every_core(spark, tmp_path):
    """One file with one row group: the documents are still built and checked by many tasks, none lost."""
    from facadelake.plans import q_store
    from facadelake.sources.tables import Tables

    rows = spark.range(300, numPartitions=1).selectExpr(
        "id + 1 AS l_orderkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber", "id AS l_partkey", "id % 9 AS l_suppkey", "id * 1e1 AS l_extendedprice", "id * 1e0 AS l_quantity", "5e-2 AS l_discount", "1e-2 AS l_tax", "'R' AS l_returnflag"
    )
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    made = q_store.check_documents_input(Tables(spark, str(tmp_path)))
    counts = made.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(counts) == 300 and len([n for n in counts if n]) >= 8
    assert made.select("defect_id").distinct().count() == 300


def test_job_progress_by_bucket(spark, tmp_path):
    """Many jobs share few states: their last update, first start and last end over batches are those of the whole table."""
    schema = "job_id long, update_id long, ts timestamp, status string, progress_pct int"
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    status = ["running", "pending", "succeeded", "failed", "running"]
    rows = [(i % 37, i, at(i * 7919 % 500), status[i * 7 % 5], i % 101) for i in range(400)] + [(None, 900, at(3), "running", None), (5, None, at(499), "pending", 1), (5, 1000, at(499), None, 2)]
    out = str(tmp_path)

    def run(batch):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{out}/src")
        q = sinks.update_files(jobs.job_progress_stream(sinks.read_stream(spark, out, "src"), keep_s=600, buckets=4), f"{out}/data", f"{out}/checkpoint")
        q.awaitTermination()
        assert q.exception() is None

    run(rows[:150])
    run(rows[150:])
    got = sinks.read_updates(spark, f"{out}/data", ["job_id"])
    want = jobs.job_progress(spark.createDataFrame(rows, schema)).select("job_id", "status", "progress_pct", F.unix_micros("started_at").alias("started_us"), F.unix_micros("completed_at").alias("completed_us"))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    # Long after, ended jobs are forgotten, and an update begins one anew; the one without an end is known.
    run([(77, 1, at(5000), "running", 0)])
    run([(2, 2000, at(5001), "pending", 9), (None, 2001, at(5001), "pending", 9)])
    last = {r["job_id"]: r for r in sinks.read_updates(spark, f"{out}/data", ["job_id"]).collect()}
    assert (last[2]["started_us"], last[2]["completed_us"], last[2]["progress_pct"]) == (None, None, 9)
    assert last[None]["started_us"] == 1704067203000000


def test_flight_folders_are_dealt_over_tasks(spark):
    """Folders are written by many tasks however few bytes they hold, one file a flight."""
    t = tables.Tables(spark, "/root/testdata/sf0.001")
    t.frames = spark.range(400).selectExpr("id % 40 AS flight_id", "id AS frame_id")
    path = q_store._flights(t)
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".json")]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 1


def test_dealt_defects_are_shuffled_once(spark):
    """Defects by inspection and part need no exchange after the one of plain columns."""
    t = tables.Tables(spark, "/root/testdata/sf0.001")
    rows = t.dealt_defects()
    plan = rows.groupBy("inspection_id", "line_no").agg(F.collect_list("defect_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "concat" not in plan[plan.index("Exchange"):]
    assert rows.count() == t.defects.where("inspection_id IS NOT NULL").count()


def test_document_checks_read_plainly(spark):
    """Documents that mean the same to any reader are not parsed into variants, of which each field costs far more; both readings find the same."""
    nested = '{"buildings":[{"id":"B","cycle_number":%s,"inspection_date":"%s","gps_centroid":{"lat":95,"lon":null,"alt":1},"bogus":1,"facades":[{"id":7,"area_m2":-1,"enhancement_params":{"clahe_tile_size":[8,8.5],"x":1},"zones":[7,{"grid_id":"1A","defects":[{"type":"dent","length_cm":null,"width_mm":-2,"centroid_px":3},null]}]}]}]}'
    plain = [nested % case for case in (("0", "2024-02-30"), ("1.5", "2024-02-28"), ("true", "x"), ("-3", ""))] + ['{"generated_at":"2024-01-01T10:00:00Z"}', '{"generated_at":"2024-13-01T10:00:00Z","buildings":{}}']
    unsure = [nested % case for case in (("1.0", "2024-01-01"), ("1e0", "0000-01-01"), ("1", "٤"), ("9" * 40, "x"))] + [
        '{"generated_at":"2024-01-01t10:00:00+05:30"}', '{"a":1,"a":2}', '{"a":NaN}', "{", "[]", "null", "", None, '{"a":"\\n"}',
    ]
    df = spark.createDataFrame([*enumerate(plain + unsure)], "id long, json string")
    batches = [pa.RecordBatch.from_pydict({"id": [*range(len(x))], "json": x}) for x in (plain, unsure)]
    first, second = quality._read_plainly(iter(batches))
    assert first.column(1).null_count == 0 and first.num_rows == len(plain)
    assert second.column(1).null_count == second.num_rows == len(unsure)
    # An escape in a key changes no meaning, but leaves the document to the variants.
    escaped = df.withColumn("json", F.replace("json", F.lit('"buildings"'), F.lit('"\\u0062uildings"'))).withColumn("json", F.replace("json", F.lit('"generated_at"'), F.lit('"\\u0067enerated_at"')))
    found, again = (sorted(tuple(r) for r in quality.check_documents(d, "id").collect()) for d in (df, escaped))
    assert found == again and {r[0] for r in found} == {*range(len(plain + unsure))}
    assert sum(r[2] == "malformed" for r in found) == 7


def test_documents_deal_defects_by_facade_once(spark):
    """Defects reach their documents by shuffles of plain columns alone: neither totals of zones nor lists of records are shuffled again."""
    t = tables.Tables(spark, "/root/testdata/sf0.001")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = documents_of(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    below = [line.split("\n", 2)[1] for line in plan.split("Exchange hashpartitioning")[1:]]
    assert not any("collect_list" in line or "dominant" in line or "zone_id" in line for line in below)
    assert plan.count("REPARTITION_BY_COL") == 2
