"""Exact values of the rules on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from facadelake.functions import geometry as g
from facadelake.functions import rules as r
from facadelake.operators import gates, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_gsd(spark):
    value = one(spark, g.gsd(F.lit(15.0), F.lit(13.2), F.lit(8.8), F.lit(5472)))
    assert value == pytest.approx(0.4111, abs=0.01)
    assert one(spark, g.gsd(F.lit(-1.0), F.lit(13.2), F.lit(8.8), F.lit(5472))) is None


def test_rod(spark):
    check = one(spark, g.rod_check(F.lit(0.5), F.lit(1.0), F.lit(200)))
    assert (check["predicted_cm"], check["actual_cm"], check["passed"]) == (100.0, 100.0, True)


@pytest.mark.parametrize("a,b,iou", [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (5, 0, 10, 10), 1 / 3), ((0, 0, 10, 10), (20, 20, 5, 5), 0.0), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0)])
def test_iou(spark, a, b, iou):
    value = one(spark, g.bbox_iou([F.lit(x) for x in a], [F.lit(x) for x in b]))
    assert value == pytest.approx(iou)
    assert value == one(spark, g.bbox_iou([F.lit(x) for x in b], [F.lit(x) for x in a]))


def test_defect_and_facade_vi(spark):
    row = spark.createDataFrame(
        [("f", "crack", 0.5, 10.0, None, None, None)] * 2,
        "inspection_id string, type string, width_mm double, area_cm2 double, member_type string, crack_subtype string, exposure_condition string",
    )
    scored = row.withColumn("vi", r.defect_vi())
    assert scored.first()["vi"] == pytest.approx(5.0)
    facades = spark.createDataFrame([("f", 1000.0), ("empty", 1000.0), ("none", 0.0)], "inspection_id string, facade_area_cm2 double")
    out = {x["inspection_id"]: x["vi_score"] for x in scoring.facade_vi(scored, facades).collect()}
    assert out == {"f": pytest.approx(1.0), "empty": 0.0, "none": 0.0}


def test_member_counts_twice(spark):
    row = spark.createDataFrame([("crack", 9.0, 1.0, "column", None, None)], "type string, width_mm double, area_cm2 double, member_type string, crack_subtype string, exposure_condition string")
    assert row.select(r.defect_vi().alias("v")).first()["v"] == pytest.approx(9.0)


def test_class_texts(spark):
    assert one(spark, r.vi_class(F.lit(50.0))) == "Class III (Significant)"
    # Every text with CLASS I in it, also II to IV, scores 15; V scores 90; digits win.
    for text, score in [("Class III (Significant)", 15.0), ("Class V (Critical)", 90.0), ("VI 62.5", 62.5)]:
        assert one(spark, r.score_from_text(F.lit(text))) == score


def test_crack_class_angle_is_folded(spark):
    columns = dict(angle_deg=90.0, width_mm=0.6, confidence=0.5, solidity=0.9, bbox_x=200, bbox_y=300, bbox_w=10, bbox_h=60)
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    # 90 degrees folds to 0: the vertical rules cannot fire, the fallback does.
    assert df.select(r.crack_class(512, 384).alias("v")).first()["v"] == "flexural_crack"


def test_safe_json(spark):
    df = spark.createDataFrame([('[{"a":1}]',), ("not-json{{{",), (None,), ("5",), ("",)], "t string")
    assert [len(x[0]) for x in df.select(g.safe_json_list("t")).collect()] == [1, 0, 0, 1, 0]
    assert df.select(g.safe_json_map("t").alias("m")).collect()[1]["m"] == {}


def test_dms(spark):
    rows = [([(22, 1), (18, 1), (36, 1)], "N"), ([(22, 1), (18, 1), (36, 1)], "S"), ([(22, 0), (18, 1), (36, 1)], "N")]
    df = spark.createDataFrame(rows, "d array<struct<num:long,den:long>>, ref string")
    assert [x[0] for x in df.select(g.dms_to_decimal("d", "ref")).collect()] == [pytest.approx(22.31), pytest.approx(-22.31), None]


def test_grid_references_differ_on_borders(spark):
    # A centroid on a row border is one row apart in the two references.
    assert one(spark, g.grid_ref(F.lit(0), F.lit(64), 512, 384)) == "E1"
    assert one(spark, g.grid_ref_legacy(F.lit(0), F.lit(64), 512, 384)) == "F1"
    assert one(spark, g.zone_id(F.lit(999), F.lit(999), 1000, 1000)) == "D4"
    assert one(spark, g.zone_id(F.lit(0), F.lit(0), 1000, 1000, "odd")) == "A1"


def test_flight_gates(spark):
    base = datetime.datetime(2024, 1, 1, 10)
    seconds = [0, 2, 4, 60, 62, 64]
    rows = [(i, "f", base + datetime.timedelta(seconds=s), 35.0 if i == 4 else 15.0, 60.0, True) for i, s in enumerate(seconds)]
    frames = spark.createDataFrame(rows, "frame_id long, flight_id string, ts timestamp, relative_altitude double, gps_altitude double, quality_passed boolean")
    high = gates.altitude_anomaly(frames, sigma=1.5)
    assert {x["frame_id"] for x in high.where("altitude_anomaly").collect()} == {4}
    assert {x["frame_id"] for x in high.where("NOT quality_passed").collect()} == {4}
    assert {x["frame_id"] for x in gates.temporal_gap(frames, mult=2.0).where("temporal_gap").collect()} == {3}


def test_sql_functions(spark):
    g.register_sql_functions(spark)
    assert spark.sql("SELECT bbox_iou(0, 0, 10, 10, 5, 0, 10, 10)").first()[0] == pytest.approx(1 / 3)
    assert spark.sql("SELECT gsd_cm(15, 13.2, 8.8, 5472, NULL, NULL)").first()[0] == pytest.approx(0.4111, abs=0.01)
