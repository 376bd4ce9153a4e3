"""Cycle matches, detector pairs and descriptor matches against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest

from facadelake.operators import descriptors, kernels, temporal

NAMES = ["defect_id", "building_id", "cycle_id", "seq", "type", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "centroid_x", "centroid_y", "length_cm", "width_mm", "area_cm2", "growth_rate_mm_per_month"]


@pytest.fixture(scope="module")
def defects():
    rng = np.random.default_rng(11)
    n = 900
    # One building holds most defects, with many copies of one box.
    building = np.where(rng.random(n) < 0.6, 1, rng.integers(2, 6, n))
    x, y = rng.integers(-20, 400, n), rng.integers(-20, 300, n)
    copies = rng.random(n) < 0.3
    x[copies], y[copies] = 100, 100
    w, h = rng.integers(20, 150, n), rng.integers(20, 150, n)
    w[copies], h[copies] = 90, 80
    return pd.DataFrame(
        {
            "defect_id": [f"d{i}" for i in range(n)], "building_id": building, "cycle_id": rng.integers(1, 4, n), "seq": np.arange(n), "type": rng.choice(["crack", "stain"], n),
            "bbox_x": x, "bbox_y": y, "bbox_w": w, "bbox_h": h, "centroid_x": (x + w / 2).round(1), "centroid_y": (y + h / 2).round(1),
            "length_cm": rng.random(n) * 50, "width_mm": rng.random(n) * 5, "area_cm2": rng.random(n) * 90, "growth_rate_mm_per_month": rng.integers(-2, 3, n) / 10,
        }
    )[NAMES]


def iou(a, b):
    iw = max(0, min(a.bbox_x + a.bbox_w, b.bbox_x + b.bbox_w) - max(a.bbox_x, b.bbox_x))
    ih = max(0, min(a.bbox_y + a.bbox_h, b.bbox_y + b.bbox_h) - max(a.bbox_y, b.bbox_y))
    return iw * ih / (a.bbox_w * a.bbox_h + b.bbox_w * b.bbox_h - iw * ih)


def groups(defects):
    rows = list(defects.itertuples())
    for a in rows:
        yield a, [b for b in rows if b.building_id == a.building_id and b.cycle_id == a.cycle_id - 1]


@pytest.mark.parametrize("cell", [32, 256])
def test_iou_match(spark, defects, cell):
    df = spark.createDataFrame(defects)
    got = temporal.match_iou(df, df, ["seq"], cell=cell).toPandas().set_index("defect_id")
    assert len(got) == len(defects)
    seen = set()
    for a, previous in groups(defects):
        best, parent = 0.0, None
        for b in previous:
            v = iou(b, a)
            if v > best:
                best, parent = v, b
        row = got.loc[a.defect_id]
        status = "propagated" if best >= 0.3 else "new" if best < 0.1 else "uncertain"
        seen.add(status)
        assert row["temporal_status"] == status
        assert (row["parent_defect_id"] or None) == (None if status == "new" else parent.defect_id)
        if status == "propagated":
            assert row["delta_width_mm"] == pytest.approx(a.width_mm - parent.width_mm, abs=6e-4)
            assert row["growth_rate_mm_per_month"] == pytest.approx(max(0, a.width_mm - parent.width_mm), abs=6e-4)
        elif status == "uncertain":
            assert math.isnan(row["delta_width_mm"]) and row["crack_activity_status"] == "unmonitored"
        else:
            assert row["delta_width_mm"] == 0 and row["crack_activity_status"] == "dormant"
    assert seen == {"propagated", "new", "uncertain"}


def test_centroid_match(spark, defects):
    df = spark.createDataFrame(defects)
    got = temporal.match_centroid(df, df, ["seq"], tol_px=25.0, months=6.0).toPandas().set_index("defect_id")
    matched = 0
    for a, previous in groups(defects):
        best, parent = math.inf, None
        for b in previous:
            d = math.sqrt((a.centroid_x - b.centroid_x) ** 2 + (a.centroid_y - b.centroid_y) ** 2)
            if b.type == a.type and d < best:
                best, parent = d, b
        row = got.loc[a.defect_id]
        if parent is not None and best <= 25.0:
            matched += 1
            rate = (a.width_mm - parent.width_mm) / 6.0
            prev = parent.growth_rate_mm_per_month
            assert row["matched_previous_id"] == parent.defect_id
            assert row["growth_rate_mm_per_month"] == pytest.approx(rate)
            assert row["growth_acceleration"] == pytest.approx(rate - prev if prev != 0 else rate)
        else:
            assert row["matched_previous_id"] is None and row["growth_rate_mm_per_month"] == 0
    assert matched > 50


def test_resolved(spark, defects):
    df = spark.createDataFrame(defects)
    matched = temporal.match_iou(df, df, ["seq"])
    out = {r[0] for r in temporal.resolved(matched, df).select("defect_id").collect()}
    pdf = matched.toPandas()
    taken = set(pdf.loc[pdf.temporal_status == "propagated", "parent_defect_id"])
    last = defects.groupby("building_id")["cycle_id"].max()
    want = {r.defect_id for r in defects.itertuples() if r.cycle_id < last[r.building_id] and r.defect_id not in taken}
    assert out == want


def test_pair_detectors(spark):

    def side(n, seed):
        r = np.random.default_rng(seed)
        return pd.DataFrame(
            {"image_id": r.integers(0, 12, n), "ordinal": np.arange(n), "cx": r.integers(0, 400, n), "cy": r.integers(0, 300, n), "length_cm": (r.random(n) * 40).round(3),
             "width_mm": (r.random(n) * 3).round(4), "angle_deg": r.random(n) * 90, "tortuosity": 1 + r.random(n), "kind": "crack", "img_w": 400, "img_h": 300}
        )

    g, c = side(70, 1), side(60, 2)
    g.loc[g.image_id == 3, "image_id"] = 4  # an image with one side only
    out = kernels.pair_detectors(spark.createDataFrame(g), spark.createDataFrame(c), limit=8).toPandas()
    tol = max(40.0, 0.08 * math.hypot(400, 300))
    for image in set(g.image_id) | set(c.image_id):
        gs, cs = list(g[g.image_id == image].itertuples()), list(c[c.image_id == image].itertuples())
        used, rows = set(), []
        for a in gs:
            best, bd = None, tol
            for i, b in enumerate(cs):
                d = math.hypot(a.cx - b.cx, a.cy - b.cy)
                if i not in used and d < bd:
                    best, bd = i, d
            if best is not None:
                used.add(best)
            rows.append((a.ordinal, cs[best].ordinal if best is not None else None, max(round(a.length_cm, 1), round(cs[best].length_cm, 1) if best is not None else 0)))
        rows += [(None, b.ordinal, round(b.length_cm, 1)) for i, b in enumerate(cs) if i not in used]
        rows = sorted(rows, key=lambda r: -r[2])[:8]
        mine = out[out.image_id == image]
        plain = lambda v: None if pd.isna(v) else int(v)
        assert [(plain(r.geo_no), plain(r.cv_no)) for r in mine.itertuples()] == [(r[0], r[1]) for r in rows]
    assert out["matched"].any()


def test_ratio_match(spark):
    rng = np.random.default_rng(2)
    left, right = rng.normal(size=(40, 8)), rng.normal(size=(50, 8))
    right[:10] = left[:10] + rng.normal(scale=0.01, size=(10, 8))
    frame = lambda m: spark.createDataFrame([(1 + i % 2, i, [float(x) for x in v]) for i, v in enumerate(m)], "pair int, id long, vec array<float>")
    out = {(r["l_id"], r["r_id"]) for r in descriptors.ratio_match(frame(left), frame(right), "pair", 0.75, block=7).collect()}
    want = set()
    for i, v in enumerate(left):
        others = [j for j in range(50) if j % 2 == i % 2]
        d = sorted((math.dist(np.float32(v), np.float32(right[j])), j) for j in others)
        if d[0][0] < 0.75 * d[1][0]:
            want.add((i, d[0][1]))
    assert out == want and len(out) >= 10


def test_reprojection_without_matches_is_infinite(spark):
    h = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for i in (1, 2)], "pair_id int, h array<double>")
    m = spark.createDataFrame([(1, 0.0, 0.0, 3.0, 4.0)], "pair_id int, src_x double, src_y double, dst_x double, dst_y double")
    out = {r["pair_id"]: r["mean_error"] for r in descriptors.reprojection_error(m, h).collect()}
    assert out == {1: 5.0, 2: math.inf}


def _rows(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("match", [temporal.match_iou, temporal.match_centroid])
def test_match_in_groups_and_in_cells(spark, defects, match):
    """Small keys, large keys, both at once, and two tables instead of one; rows without a key match nothing."""
    df = spark.createDataFrame(defects)
    keyless = df.limit(40).selectExpr("concat('k', defect_id) AS defect_id", "CAST(NULL AS BIGINT) AS building_id", *[c for c in NAMES if c not in ("defect_id", "building_id")])
    df = df.unionByName(keyless).unionByName(keyless.selectExpr("concat('c', defect_id) AS defect_id", "1L AS building_id", "CAST(NULL AS BIGINT) AS cycle_id", *NAMES[3:]))
    columns = ["defect_id", *(["temporal_status", "parent_defect_id", "delta_area_cm2", "best_iou"] if match is temporal.match_iou else ["matched_previous_id", "match_distance_px", "growth_acceleration"])]
    cells = _rows(match(df, df, ["seq"], small=0), columns)
    assert len(cells) == len(defects) + 80
    assert _rows(match(df, df, ["seq"]), columns) == cells
    assert _rows(match(df, df, ["seq"], small=200), columns) == cells
    assert _rows(match(df, df.select("*"), ["seq"]), columns) == cells
    assert _rows(match(df, df.select("*"), ["seq"], small=200), columns) == cells


@pytest.mark.parametrize("match", [temporal.match_iou, temporal.match_centroid])
def test_match_shuffles_rows_once(spark, defects, match):
    plan = match(*[spark.createDataFrame(defects)] * 2, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_ratio_match_blocks_grow_with_their_side(spark):
    """Rows are copied once a block of the other side: no more than 16 times until blocks are at their largest."""
    sizes = spark.createDataFrame([(10,), (500,), (100_000,), (10_000_000,)], "n long")
    assert [r[0] for r in sizes.select(descriptors._block_rows(sizes["n"], 32)).collect()] == [32, 32, 6250, descriptors.LARGEST]
    rng = np.random.default_rng(3)
    vecs = rng.random((400, 4))
    df = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(vecs)], "pair long, id long, vec array<double>")
    got = {(r.l_id, r.r_id) for r in descriptors.ratio_match(df.where("id < 200"), df.where("id >= 200"), "pair", 0.9, block=2).collect()}
    want = set()
    for i in range(200):
        d = np.sqrt(((vecs[200:] - vecs[i]) ** 2).sum(axis=1))
        a, b = np.sort(d)[:2]
        if a < 0.9 * b:
            want.add((i, 200 + int(d.argmin())))
    assert got == want and want


def test_boxes_without_a_place_match_nothing(spark, defects):
    df = spark.createDataFrame(defects).selectExpr(*[f"IF(seq % 5 = {i}, NULL, {c}) AS {c}" if c.startswith("bbox") else c for i, c in enumerate(NAMES)])
    columns = ["defect_id", "temporal_status", "parent_defect_id", "best_iou"]
    assert _rows(temporal.match_iou(df, df, ["seq"]), columns) == _rows(temporal.match_iou(df, df, ["seq"], small=0), columns)
