"""Masks, components and frame kernels against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facadelake.functions import geometry as g
from facadelake.operators import components, kernels, masks


def stripes(seed=1, h=60, w=90, density=0.45):
    return np.random.default_rng(seed).random((h, w)) < density


def runs_of(mask, mask_id):
    out = []
    for y, row in enumerate(mask):
        padded = np.diff(np.concatenate([[0], row.astype(int), [0]]))
        out += [(mask_id, y, int(a), int(b) - 1) for a, b in zip(np.where(padded == 1)[0], np.where(padded == -1)[0])]
    return out


def flood(mask):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.where(mask)):
        if seen[y, x]:
            continue
        stack, pixels = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            pixels.append((a, b))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    p, q = a + dy, b + dx
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        stack.append((p, q))
        out.append(pixels)
    return out


@pytest.mark.parametrize("tile", [7, 16, 1024])
def test_components(spark, tile):
    grids = {1: stripes(1), 2: stripes(2, density=0.3), 3: np.ones((40, 40), bool)}
    runs = spark.createDataFrame([r for k, m in grids.items() for r in runs_of(m, k)], "mask_id int, y int, x0 int, x1 int")
    out = components.components(runs, min_area=5, tile=tile).collect()
    got = sorted((r["mask_id"], r["area_px"], r["x"], r["y"], r["w"], r["h"], round(r["cx"], 6), round(r["cy"], 6)) for r in out)
    want = []
    for k, m in grids.items():
        for pixels in flood(m):
            if len(pixels) >= 5:
                ys, xs = np.array(pixels).T
                want.append((k, len(pixels), xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, round(xs.mean(), 6), round(ys.mean(), 6)))
    assert got == sorted(want)


def test_components_by_size(spark, monkeypatch):
    """Masks of few runs are no business of the joins across tiles; larger ones, cut into tiles, give the same. Runs without a mask join at no border."""
    grids = {1: stripes(1), 2: stripes(2, density=0.3), 3: np.ones((3, 40), bool), None: np.ones((4, 20), bool)}
    runs = spark.createDataFrame([r for k, m in grids.items() for r in runs_of(m, k)], "mask_id int, y int, x0 int, x1 int")
    sizes = [r["n"] for r in runs.dropna().groupBy("mask_id").agg(F.count("*").alias("n")).collect()]

    def told(small):
        return sorted((tuple(r) for r in components.components(runs, min_area=1, tile=16, small=small).select("mask_id", "area_px", "x", "y", "w", "h", "cx", "cy").collect()), key=str)

    tiled = told(0)
    assert told(min(sizes)) == tiled and sorted(r[1] for r in tiled if r[0] is None) == [16, 64]
    monkeypatch.setattr(components, "connected_components", lambda *a: pytest.fail("no mask is large"))
    assert told(max(sizes)) == tiled


def test_run_length_round_trip(spark):
    grids = {i: stripes(i, 12, 17) for i in range(4)} | {9: np.zeros((12, 17), bool), 10: np.ones((12, 17), bool)}
    sizes = spark.createDataFrame([(k, 12, 17) for k in grids], "mask_id int, height int, width int")
    runs = spark.createDataFrame([r for k, m in grids.items() for r in runs_of(m, k)], "mask_id int, y int, x0 int, x1 int")
    coded = masks.encode_runs(runs, sizes)
    for r in coded.collect():
        flat = grids[r["mask_id"]].flatten().astype(int)
        edges = np.diff(np.hstack(([0], flat, [0]))).nonzero()[0]
        assert r["counts"] == np.diff(np.hstack(([0], edges))).tolist()
    back = masks.decode_runs(coded.withColumn("counts", F.col("counts").cast("array<int>")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, runs.collect()))


def test_decode_clips_overflow(spark):
    df = spark.createDataFrame([(1, [2, 100], 2, 3)], "mask_id int, counts array<int>, height int, width int")
    assert sorted(map(tuple, masks.decode_runs(df).collect())) == [(1, 0, 2, 2), (1, 1, 0, 2)]
    text = spark.createDataFrame([("2 100",)], "t string").select(masks.counts_from_text("t")).first()[0]
    assert text == [2, 100]


def test_moments_and_skeleton(spark):
    m = np.zeros((40, 60), bool)
    for i in range(30):
        m[5 + i, 10 + i : 15 + i] = True
    runs = spark.createDataFrame(runs_of(m, 1), "mask_id int, y int, x0 int, x1 int")
    r = masks.mask_moments(runs).first()
    ys, xs = np.where(m)
    assert r["area_px"] == m.sum() and r["centroid_x"] == pytest.approx(xs.mean()) and r["angle_deg"] == pytest.approx(45, abs=3)
    cov = np.cov(np.vstack([xs, ys]), bias=True)
    v = np.linalg.eigh(cov)[1][:, 1]
    proj = xs * v[0] + ys * v[1]
    assert r["length_px"] == pytest.approx(np.ptp(proj))
    line = [(1, i, i) for i in range(10)] + [(1, 10 + i, 9) for i in range(5)]
    px = spark.createDataFrame(line, "mask_id int, x int, y int")
    assert masks.skeleton_length(px).first()["length_px"] == pytest.approx(9 * math.sqrt(2) + 5)
    assert masks.skeleton_length(px, diagonal=1.4142).first()["length_px"] == pytest.approx(9 * 1.4142 + 5)


def test_frame_kernels(spark):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (h, w), dtype=np.uint8) for h, w in [(20, 30), (7, 9), (2, 3)]]
    df = spark.createDataFrame([(i, m.shape[0], m.shape[1], m.tobytes()) for i, m in enumerate(images)], "frame_id long, height int, width int, pixels binary")
    q = {r["frame_id"]: r for r in kernels.frame_quality(df).collect()}
    s = {r["frame_id"]: r for r in kernels.gradient_stats(df).collect()}
    for i, m in enumerate(images):
        p = np.pad(m.astype(float), 1, mode="reflect")
        lap, mag = np.zeros(m.shape), np.zeros(m.shape)
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                n = p[y : y + 3, x : x + 3]
                lap[y, x] = n[0, 1] + n[2, 1] + n[1, 0] + n[1, 2] - 4 * n[1, 1]
                gx = (n[:, 2] - n[:, 0]) @ [1, 2, 1]
                gy = (n[2] - n[0]) @ [1, 2, 1]
                mag[y, x] = math.hypot(gx, gy)
        assert q[i]["laplacian_variance"] == pytest.approx(lap.var()) and q[i]["mean_intensity"] == pytest.approx(m.mean())
        assert s[i]["sobel_gradient_mean"] == pytest.approx(mag.mean())


def test_colour_cues(spark):
    hsv = np.zeros((2, 5, 3), np.uint8)
    hsv[0, :3] = (15, 100, 100)
    hsv[1, :2] = (90, 10, 250)
    df = spark.createDataFrame([(1, 2, 5, hsv.tobytes())], "frame_id long, height int, width int, pixels binary")
    r = kernels.colour_cues(df).first()
    assert (r["rust"], r["efflorescence"]) == (0.3, 0.2)


def test_patches(spark):
    m = np.arange(1, 101, dtype=np.uint8).reshape(10, 10)
    df = spark.createDataFrame([(1, 10, 10, m.tobytes(), 0, 0), (2, 10, 10, m.tobytes(), 9, 5)], "frame_id long, height int, width int, pixels binary, cx int, cy int")
    out = kernels.crop_patches(df.withColumn("bounds", g.patch_bounds("cx", "cy", "width", "height", 4)), 4)
    got = {r["frame_id"]: np.frombuffer(r["patch"], np.uint8).reshape(4, 4) for r in out.collect()}
    padded = np.pad(m, 4)
    assert (got[1] == padded[2:6, 2:6]).all() and (got[2] == padded[7:11, 11:15]).all()


def test_bar_spacing_keeps_last_kept(spark):
    xs = [10, 35, 42, 80, 120, 121]
    lines = spark.createDataFrame([(1, x, 0, x, 50) for x in xs] + [(2, 5, 0, 5, 50)], "image_id int, x1 int, y1 int, x2 int, y2 int")
    out = {r["image_id"]: (r["spacing_cm"], r["detected_rods"]) for r in masks.bar_spacing(lines, 1.0).collect()}
    # Kept: 10, 42, 80, 120.
    assert out == {1: (38.0, 4), 2: (0.0, 0)}


def test_width_profile_median(spark):
    rng = np.random.default_rng(8)
    pts = pd.DataFrame({"mask_id": 1, "x": np.arange(57) % 8, "y": np.arange(57) // 8, "distance": rng.random(57)})
    r = masks.width_profile(spark.createDataFrame(pts), 0.2).first()
    w = 2 * pts["distance"].to_numpy() * 2.0
    assert r["median_width_mm"] == pytest.approx(np.median(w)) and r["max_width_mm"] == pytest.approx(w.max())
    assert r["profile_mm"] == pytest.approx(w[np.linspace(0, 56, 10, dtype=int)].tolist())


def test_skeleton_edges_across_pieces(spark):
    """Rows wider than a piece, negative places and repeats: every edge once; groups are pieces of rows, not pixels."""
    import math
    import random

    random.seed(5)
    pixels = {(m, random.randint(-70, 200), random.randint(-3, 6)) for m in (1, 2) for _ in range(900)} | {(3, 61, 0), (3, 62, 1), (3, 62, 0), (3, 61, 1), (4, 5, 5)}
    df = spark.createDataFrame(sorted(pixels) + sorted(pixels)[:50], "mask_id long, x int, y int")
    out = masks.skeleton_length(df, 0.2, 0.15)
    got = {r.mask_id: (round(r.length_px, 6), round(r.length_cm, 6)) for r in out.collect()}
    want = {}
    for m in (1, 2, 3, 4):
        px = cm = 0.0
        for dx, dy, p, c in ((1, 0, 1.0, 0.2), (0, 1, 1.0, 0.15), (1, 1, math.sqrt(2), 0.25), (-1, 1, math.sqrt(2), 0.25)):
            k = sum((m, x + dx, y + dy) in pixels for (q, x, y) in pixels if q == m)
            px, cm = px + k * p, cm + k * c
        want[m] = (round(px, 6), round(cm, 6))
    assert got == want
    assert "bit_or" in out._jdf.queryExecution().optimizedPlan().toString()
