"""Connected components of run tables: masks of few runs as a whole, larger ones tile by tile, with the tiles joined afterwards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facadelake.session import ensure_checkpoint_dir

LABEL_SHIFT = 2**32
SMALL = 2_000  # runs of a mask that may meet in one group


def label_runs(y, x0, x1) -> list[int]:
    """Index of the first run of each run's 8-connected component; runs sorted by (y, x0)."""
    parent = list(range(len(y)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above = 0  # first run of the row before that may still touch
    for i in range(len(y)):
        while above < i and (y[above] < y[i] - 1 or (y[above] == y[i] - 1 and x1[above] < x0[i] - 1)):
            above += 1
        j = above
        while j < i and y[j] == y[i] - 1 and x0[j] <= x1[i] + 1:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
            j += 1
        # Runs of one row that touch side by side.
        if i and y[i - 1] == y[i] and x1[i - 1] >= x0[i] - 1:
            a, b = find(i), find(i - 1)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(y))]


def connected_components(edges: DataFrame, by: str) -> DataFrame:
    """Smallest reachable node of every node of an undirected edge table ``(by, a, b)``.

    Alternating large-star and small-star steps until nothing changes. Each round is checkpointed, so a
    lost executor costs one round and the plan stays short.
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def fingerprint(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(by, "a", "b").cast("decimal(38,0)"))).first()

    def directed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    current = directed(edges).checkpoint()
    before = fingerprint(current)
    while True:
        both = current.unionByName(current.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy(by, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = directed(both.where("b > a").join(lows, [by, "a"]).select(by, F.col("b").alias("a"), F.col("m").alias("b")))
        roots = large.groupBy(by, "a").agg(F.min("b").alias("m"))
        small = large.join(roots, [by, "a"])
        current = directed(
            small.select(by, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(by, "a", F.col("m").alias("b")))
        ).checkpoint()
        after = fingerprint(current)
        if after == before:
            return current.groupBy(by, F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = after


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _first_runs(y: pd.Series, x0: pd.Series, x1: pd.Series) -> pd.Series:
    return pd.Series([label_runs(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(y, x0, x1)])


def _labelled(cut: DataFrame, by: str) -> DataFrame:
    """Runs with the label of their component in the tile: place of its first run. One row per tile, with its runs in order, is labelled at once."""
    tiles = cut.groupBy(by, "tile_x", "tile_y").agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("r"))
    named = tiles.withColumn("first", _first_runs("r.y", "r.x0", "r.x1"))
    start = F.transform("first", lambda i: F.get("r", i)["y"].cast("long") * LABEL_SHIFT + F.get("r", i)["x0"])
    return named.withColumn("label", start).select(by, F.explode(F.arrays_zip("r", "label")).alias("z")).select(by, "z.r.y", "z.r.x0", "z.r.x1", "z.label")


def _measured(labelled: DataFrame, by: str) -> DataFrame:
    n = (F.col("x1") - F.col("x0") + 1).cast("long")
    return labelled.groupBy(by, "label").agg(
        F.sum(n).alias("area_px"), F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        (F.sum(n * (F.col("x0") + F.col("x1")) / 2) / F.sum(n)).alias("cx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"),
    )


def _cut(runs: DataFrame, by: str, tile: int) -> DataFrame:
    return (
        runs.withColumn("tile_x", F.explode(F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))))
        .withColumn("tile_y", F.floor(F.col("y") / tile))
        .select(
            by, F.col("tile_x").cast("int").alias("tile_x"), F.col("tile_y").cast("int").alias("tile_y"), F.col("y").cast("int").alias("y"),
            F.greatest("x0", F.col("tile_x") * tile).cast("int").alias("x0"), F.least("x1", F.col("tile_x") * tile + (tile - 1)).cast("int").alias("x1"),
        )
    )


def _by_mask(runs: DataFrame, by: str, tile: int) -> DataFrame:
    """Components of masks of few runs: a mask is one tile, dealt once, with no border to join at. Runs without a mask
    are no mask of few runs: they are cut into tiles, which join nothing."""
    whole = runs.where(F.col(by).isNotNull() & F.col("x0").isNotNull() & F.col("x1").isNotNull()).select(
        by, F.lit(0).alias("tile_x"), F.when(F.col("y").isNotNull(), 0).alias("tile_y"), *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")]
    )
    dealt = whole.unionByName(_cut(runs.where(F.col(by).isNull()), by, tile)).repartition(by, "tile_x", "tile_y")
    return _measured(_labelled(dealt, by), by)


def _by_tile(runs: DataFrame, by: str, tile: int) -> DataFrame:
    """Components of masks of any size: one task sees at most a tile's runs; those that cross a border are joined through the few runs on it."""
    labelled = _labelled(_cut(runs, by, tile), by).checkpoint()

    # Across a horizontal border: rows y and y + 1, ranges that touch, met in cells of 64 pixels.
    def in_cells(df: DataFrame, low, high) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(F.floor(low / 64), F.floor(high / 64))))

    upper = in_cells(labelled.where(F.col("y") % tile == tile - 1), F.col("x0") - 1, F.col("x1") + 1).select(
        by, (F.col("y") + 1).alias("y"), "cell", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("label").alias("a")
    )
    lower = in_cells(labelled.where(F.col("y") % tile == 0), F.col("x0"), F.col("x1")).select(by, "y", "cell", "x0", "x1", F.col("label").alias("b"))
    across_y = upper.join(lower, [by, "y", "cell"]).where("x0 <= u1 + 1 AND u0 <= x1 + 1").select(by, "a", "b")
    # Across a vertical border: the run that ends a tile and those that start the next, one row around.
    ending = labelled.where(F.col("x1") % tile == tile - 1).select(
        by, F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"), (F.col("x1") + 1).alias("x0"), F.col("label").alias("a")
    )
    across_x = ending.join(labelled.where(F.col("x0") % tile == 0).select(by, "y", "x0", F.col("label").alias("b")), [by, "y", "x0"]).select(by, "a", "b")
    roots = connected_components(across_y.unionByName(across_x), by).withColumnRenamed("node", "label")
    joined = labelled.join(roots, [by, "label"], "left").withColumn("label", F.coalesce("root", "label"))
    return _measured(joined, by)


def components(runs: DataFrame, min_area: int = 15, by: str = "mask_id", tile: int = 1024, max_share: float | None = None,
               image_area: int | None = None, small: int = SMALL) -> DataFrame:
    """8-connected components with area, box and centroid.

    A mask of at most ``small`` runs is one group. A larger one is cut into tiles, so one task sees at most a tile's runs.
    """
    ensure_checkpoint_dir(runs.sparkSession)
    large = runs.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > small).select(by).checkpoint()
    if large.isEmpty():
        stats = _by_mask(runs, by, tile)
    else:
        stats = _by_mask(runs.join(large, by, "left_anti"), by, tile).unionByName(_by_tile(runs.join(large, by, "left_semi"), by, tile))
    kept = stats.where(F.col("area_px") >= min_area)
    if max_share is not None and image_area is not None:
        kept = kept.where(F.col("area_px") <= max_share * image_area)
    return kept


def detection_min_area(image_area: int) -> float:
    """Smallest component that counts as a detection: 40 pixels or 5e-5 of the image."""
    return max(40.0, 5e-5 * image_area)
