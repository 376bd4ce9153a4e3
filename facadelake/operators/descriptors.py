"""Descriptor matches between frame pairs, and the error of a registration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facadelake.functions import geometry as g

PIECES = 16  # blocks of a side
LARGEST = 8_192  # rows of a block that may grow

NEAREST = T.ArrayType(T.StructType([T.StructField("l_id", T.LongType()), T.StructField("r_id", T.LongType()), T.StructField("d1", T.DoubleType()), T.StructField("d2", T.DoubleType())]))


@F.pandas_udf(NEAREST)
def _two_nearest(l_ids: pd.Series, l_vecs: pd.Series, r_ids: pd.Series, r_vecs: pd.Series) -> pd.Series:
    out = []
    for ids, left, others, right in zip(l_ids, l_vecs, r_ids, r_vecs):
        rv = np.stack(right).astype(np.float64)
        rows = []
        for i, v in zip(ids, left):
            d = np.sqrt(((rv - np.asarray(v, np.float64)) ** 2).sum(axis=1))
            # Equal distances take the smaller id.
            order = np.lexsort((others, d))[:2]
            rows.append({"l_id": int(i), "r_id": int(others[order[0]]), "d1": float(d[order[0]]), "d2": float(d[order[1]]) if len(order) > 1 else None})
        out.append(rows)
    return pd.Series(out)


def _block_rows(n: Column, block: int) -> Column:
    return F.greatest(F.lit(block), F.least(F.ceil(n / F.lit(PIECES)), F.lit(LARGEST)))


def ratio_match(left: DataFrame, right: DataFrame, by: str, ratio: float = 0.75, block: int = 1024) -> DataFrame:
    """Exact nearest neighbour by L2 within a frame pair, kept where clearly nearer than the second.

    Both sides are cut into blocks; a task compares one left with one right block and returns two
    candidates per left row, so neither the pairs nor a whole side of a large frame pair meet in one place.
    Every row is copied once for each block of the other side: blocks grow from ``block`` rows with their side, so that
    a side has ``PIECES`` of them, until a block has ``LARGEST`` rows. Columns: ``by``, id, vec.
    """

    def sizes(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy(by).agg(n.alias(f"{name}_n"), F.ceil(n / _block_rows(n, block)).cast("int").alias(f"{name}_blocks"))

    plan = sizes(left, "l").join(sizes(right, "r"), by).where("l_n >= 2 AND r_n >= 2").select(by, "l_blocks", "r_blocks")

    def blocks(df: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks").cast("long")).cast("int")
        spread = df.join(plan, by).select(
            by, mine.alias(f"{own}_no"), F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_no"), F.struct("id", "vec").alias("e")
        )
        return spread.groupBy(by, "l_no", "r_no").agg(F.array_sort(F.collect_list("e")).alias(own))

    met = blocks(left, "l", "r").join(blocks(right, "r", "l"), [by, "l_no", "r_no"])
    found = met.select(by, F.explode(_two_nearest("l.id", "l.vec", "r.id", "r.vec")).alias("m")).select(by, "m.*")
    # Two candidates per block of the other side.
    best = found.groupBy(by, "l_id").agg(
        F.array_sort(F.flatten(F.collect_list(F.array(F.struct(F.col("d1").alias("d"), F.col("r_id")), F.struct(F.col("d2").alias("d"), F.lit(None).cast("long").alias("r_id")))))).alias("c")
    )
    ordered = best.withColumn("c", F.filter("c", lambda x: x["d"].isNotNull()))
    return ordered.select(
        by, "l_id", F.get("c", 0)["r_id"].alias("r_id"), F.get("c", 0)["d"].alias("distance"), F.get("c", 1)["d"].alias("second_distance")
    ).where(F.col("distance") < F.col("second_distance") * ratio)


def reprojection_error(matches: DataFrame, homographies: DataFrame, by: str = "pair_id") -> DataFrame:
    """Mean and root mean square distance, in pixels, of projected to matched points; infinity without matches."""
    p = g.project("h", "src_x", "src_y")
    placed = matches.join(homographies, by).withColumn("p", p)
    error = F.hypot(F.col("p.x") - F.col("dst_x"), F.col("p.y") - F.col("dst_y"))
    stats = placed.withColumn("e", error).groupBy(by).agg(F.avg("e").alias("mean_error"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"))
    inf = F.lit(float("inf"))
    return homographies.select(by).join(stats, by, "left").select(by, F.coalesce("mean_error", inf).alias("mean_error"), F.coalesce("rmse", inf).alias("rmse"))
