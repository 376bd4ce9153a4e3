"""Arithmetic over frame pixels and per-image order, as Arrow-batched tasks.

Frames arrive decoded: ``(frame_id, height, width, pixels binary)``. Each batch is a handful of frames;
nothing is held beyond one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facadelake.functions.geometry import agreement

# HSV boxes (hue 0..180) of rust stains and of white salt.
RUST_BOX = ((5, 60, 40), (25, 255, 220))
SALT_BOX = ((0, 0, 200), (180, 40, 255))


def _image(pixels: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(pixels, dtype=np.uint8, count=height * width).reshape(height, width).astype(np.float64)


def _padded(img: np.ndarray) -> np.ndarray:
    return np.pad(img, 1, mode="reflect")


def laplacian_variance(img: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian; borders mirrored without repeating the edge pixel."""
    p = _padded(img)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4.0 * img).var())


def sobel_mean(img: np.ndarray) -> float:
    p = _padded(img)
    right, left = p[:, 2:], p[:, :-2]
    gx = (right - left)[:-2] + 2.0 * (right - left)[1:-1] + (right - left)[2:]
    low, high = p[2:, :], p[:-2, :]
    gy = (low - high)[:, :-2] + 2.0 * (low - high)[:, 1:-1] + (low - high)[:, 2:]
    return float(np.sqrt(gx * gx + gy * gy).mean())


def _per_frame(frames: DataFrame, out: dict, key: str = "frame_id") -> DataFrame:
    """One row per frame with the named measures of its grey image."""
    kind = dict(frames.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = [_image(p, h, w) for p, h, w in zip(b["pixels"], b["height"], b["width"])]
            yield pd.DataFrame({key: b[key], **{name: [fn(i) for i in images] for name, fn in out.items()}})

    schema = f"{key} {kind}, " + ", ".join(f"{n} double" for n in out)
    return frames.select(key, "height", "width", "pixels").mapInPandas(run, schema)


def frame_quality(frames: DataFrame) -> DataFrame:
    return _per_frame(frames, {"laplacian_variance": laplacian_variance, "mean_intensity": lambda i: float(i.mean())})


def gradient_stats(frames: DataFrame) -> DataFrame:
    return _per_frame(frames, {"laplacian_variance": laplacian_variance, "sobel_gradient_mean": sobel_mean})


def colour_cues(frames: DataFrame, key: str = "frame_id") -> DataFrame:
    """Shares of rust-coloured and of white pixels; ``pixels`` holds hue, saturation, value triples."""
    kind = dict(frames.dtypes)[key]

    def share(hsv: np.ndarray, box) -> float:
        low, high = np.array(box[0]), np.array(box[1])
        return float(((hsv >= low) & (hsv <= high)).all(axis=1).mean()) if len(hsv) else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = [np.frombuffer(p, np.uint8, h * w * 3).reshape(-1, 3) for p, h, w in zip(b["pixels"], b["height"], b["width"])]
            yield pd.DataFrame(
                {key: b[key], "rust": [share(i, RUST_BOX) for i in images], "efflorescence": [share(i, SALT_BOX) for i in images]}
            )

    return frames.select(key, "height", "width", "pixels").mapInPandas(run, f"{key} {kind}, rust double, efflorescence double")


def crop_patches(frames: DataFrame, size: int = 96, key: str = "frame_id") -> DataFrame:
    """Square grey patches round (cx, cy), zero outside the frame. ``bounds`` comes from ``patch_bounds``."""
    kind = dict(frames.dtypes)[key]

    def crop(pixels, height, width, box) -> bytes:
        img = np.frombuffer(pixels, np.uint8, height * width).reshape(height, width)
        patch = np.zeros((size, size), np.uint8)
        if box["ix2"] > box["ix1"] and box["iy2"] > box["iy1"]:
            patch[box["py1"] : box["py2"], box["px1"] : box["px2"]] = img[box["iy1"] : box["iy2"], box["ix1"] : box["ix2"]]
        return patch.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            patches = [crop(*row) for row in zip(b["pixels"], b["height"], b["width"], b["bounds"])]
            yield pd.DataFrame({key: b[key], "patch": patches})

    return frames.select(key, "height", "width", "pixels", "bounds").mapInPandas(run, f"{key} {kind}, patch binary")


def nearest_free(gx, gy, cx, cy, tol: float) -> list[int]:
    """For each point in order, the nearest other-side point not taken before and nearer than ``tol``, else -1."""
    free = np.ones(len(cx), bool)
    out = []
    for x, y in zip(gx, gy):
        best = -1
        if len(cx):
            d = np.where(free, np.hypot(cx - x, cy - y), np.inf)
            i = int(d.argmin())
            if d[i] < tol:
                best, free[i] = i, False
        out.append(best)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _take_partners(gx: pd.Series, gy: pd.Series, cx: pd.Series, cy: pd.Series, tol: pd.Series) -> pd.Series:
    return pd.Series([nearest_free(*row) for row in zip(gx, gy, cx, cy, tol)])


def pair_detectors(geo: DataFrame, cv: DataFrame, limit: int = 12) -> DataFrame:
    """Geometry and CV detections of an image, paired greedily one to one in geometry order, with the
    leftovers of both sides; the ``limit`` longest rows per image.

    A pair depends on all pairs before it, so an image is one group. It is bounded: a detection covers at
    least 5e-5 of its image, so a detector reports at most 20,000 of them. Only the order-dependent
    choice runs in Python, over arrays; rows are built from it by Spark.
    """
    fields = ["ordinal", *[F.col(c).cast("double").alias(c) for c in ("cx", "cy", "length_cm", "width_mm", "angle_deg", "tortuosity")], "kind"]

    def lists(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("image_id").agg(
            F.array_sort(F.collect_list(F.struct(*fields))).alias(name), F.max(F.hypot(F.col("img_w").cast("double"), F.col("img_h").cast("double"))).alias(f"__{name}")
        )

    both = lists(geo, "g").join(lists(cv, "c"), "image_id", "full")
    sized = both.select(
        "image_id", *[F.coalesce(n, F.array().cast(both.schema[n].dataType)).alias(n) for n in ("g", "c")],
        F.greatest(F.lit(40.0), F.coalesce("__g", "__c") * 0.08).alias("tol"),
    )
    taken = sized.withColumn("take", _take_partners("g.cx", "g.cy", "c.cx", "c.cy", "tol"))
    none = F.lit(None)

    def row(g, c, matched):
        gl, cl = g["length_cm"] if g is not None else none.cast("double"), c["length_cm"] if c is not None else none.cast("double")
        part = lambda r, f: r[f] if r is not None else none
        return F.struct(
            part(g, "ordinal").cast("int").alias("geo_no"), part(c, "ordinal").cast("int").alias("cv_no"),
            F.round(gl, 1).alias("geometry_length_cm"), F.round(part(g, "width_mm").cast("double"), 2).alias("geometry_width_mm"),
            F.round(cl, 1).alias("cv_length_cm"), F.round(part(c, "width_mm").cast("double"), 2).alias("cv_width_mm"),
            part(g if g is not None else c, "angle_deg").alias("angle_deg"), part(c, "tortuosity").cast("double").alias("tortuosity"),
            F.round(cl - gl, 1).alias("delta_cm"), F.when(cl.isNotNull() & gl.isNotNull(), agreement(gl, cl)).alias("agreement_pct"),
            matched.alias("matched"), (F.coalesce(g["kind"], F.lit("crack")) if g is not None else F.lit("crack")).alias("kind"),
        )

    left = F.transform("g", lambda g, i: row(g, F.get("c", F.nullif(F.get("take", i), F.lit(-1))), F.get("take", i) >= 0))
    free = F.filter("c", lambda c, i: ~F.array_contains("take", i))
    right = F.transform(free, lambda c: row(None, c, F.lit(False)))
    rows = taken.select("image_id", F.concat(left, right).alias("rows"))
    # Longest first; rows of equal length keep their order.
    ranked = F.array_sort(
        F.transform("rows", lambda r, i: F.struct((-F.greatest(F.coalesce(r["cv_length_cm"], F.lit(0.0)), F.coalesce(r["geometry_length_cm"], F.lit(0.0)))).alias("k"), i.alias("i"), r.alias("r")))
    )
    return rows.select("image_id", F.explode(F.slice(ranked, 1, limit)).alias("x")).select("image_id", "x.r.*")
