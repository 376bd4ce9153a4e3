"""Vulnerability scores of zones, facades and buildings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facadelake.functions import geometry as g
from facadelake.functions import rules as r
from facadelake.functions.predicates import is_active

FACADE = "inspection_id"


def facade_vi(defects: DataFrame, facades: DataFrame, exclude_fp: bool = False, key: str = FACADE,
              vi: str = "vi", area: str = "facade_area_cm2") -> DataFrame:
    """Area-weighted score per facade, 0..100. Rows flagged as false positives count unless excluded."""
    rows = defects.where(is_active()) if exclude_fp else defects
    sums = rows.groupBy(key).agg(F.sum(vi).alias("__vi"))
    score = F.least(F.lit(100.0), F.coalesce("__vi", F.lit(0.0)) / F.nullif(F.col(area), F.lit(0.0)) * 100.0)
    return facades.join(sums, key, "left").withColumn("vi_score", F.when(F.col(area) > 0, score).otherwise(0.0)).drop("__vi")


def _cell_names(grid: str) -> list[str]:
    rows, cols = g.parse_grid(grid)
    return [f"{chr(65 + c)}{y + 1}" for y in range(rows) for c in range(cols)]


def grid_cells(grid: str) -> Column:
    return F.array(*map(F.lit, _cell_names(grid)))


def _zone_types(defects: DataFrame, key: str, vi: str, order: Sequence[str], dealt: bool = False) -> DataFrame:
    """Counts per zone and type, combined map-side, then per zone: a facade's few totals meet in one place,
    where further aggregates and joins on it need no shuffle. Defects that are ``dealt`` by facade are there already."""
    by_type = defects.groupBy(key, "zone_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(vi).alias("s"), F.min(F.struct(*order)).alias("first")
    )
    return (by_type if dealt else by_type.repartition(key)).groupBy(key, "zone_id").agg(
        F.sum("n").alias("defect_count"),
        F.sum("s").alias("vi_sum"),
        # Most frequent type; equal counts take the type seen first.
        F.min_by("type", F.struct(-F.col("n"), "first")).alias("dominant_defect_type"),
    )


def zone_scores(defects: DataFrame, facades: DataFrame, order: Sequence[str], grid: str = "4x4", key: str = FACADE,
                vi: str = "vi", area: str = "facade_area_cm2", dealt: bool = False) -> DataFrame:
    """Every cell of every facade with area, count, score and dominant type; empty cells score 0.

    The occupied zones of a facade, no more than the grid has, are joined as one map; cells are made after that.
    Where a facade's defects are put in one row anyway, they may come ``dealt`` by facade: their totals are not shuffled again.
    """
    rows, cols = g.parse_grid(grid)
    figures = F.struct("defect_count", "vi_sum", "dominant_defect_type")
    occupied = _zone_types(defects.where(F.col("zone_id").isin(*_cell_names(grid))), key, vi, order, dealt).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("zone_id", figures))).alias("__zones")
    )
    cells = facades.select(key, (F.col(area) / (rows * cols)).alias("zone_area_cm2")).join(occupied, key, "left")
    joined = (
        cells.withColumn("zone_id", F.explode(grid_cells(grid)))
        .withColumn("__z", F.try_element_at("__zones", "zone_id"))
        .select(key, "zone_id", "zone_area_cm2", "__z.*")
    )
    score = F.least(F.lit(100.0), F.col("vi_sum") / F.nullif(F.col("zone_area_cm2"), F.lit(0.0)) * 100.0)
    return joined.select(
        key,
        "zone_id",
        "zone_area_cm2",
        F.coalesce("defect_count", F.lit(0)).alias("defect_count"),
        F.when((F.col("zone_area_cm2") > 0) & F.col("vi_sum").isNotNull(), F.round(score, 3)).otherwise(0.0).alias("zone_vi"),
        "dominant_defect_type",
    )


def zone_records(zones: DataFrame, defects: DataFrame, order: Sequence[str], key: str = FACADE) -> DataFrame:
    """Zone rows whose count and dominant type look at active defects only."""
    active = _zone_types(defects.where(is_active()).withColumn("__one", F.lit(0.0)), key, "__one", order)
    active = active.select(key, "zone_id", F.col("defect_count").alias("defect_count_active"), "dominant_defect_type")
    base = zones.withColumnRenamed("defect_count", "defect_count_all").drop("dominant_defect_type")
    return base.join(active, [key, "zone_id"], "left").withColumn(
        "defect_count_active", F.coalesce("defect_count_active", F.lit(0))
    )


ZONES_3X3 = [f"R{y}C{x}" for y in (1, 2, 3) for x in (1, 2, 3)]


def zone_severity_index(defects: DataFrame, inspections: DataFrame, width: int, height: int, key: str = FACADE,
                        severity: str = "severity_b") -> DataFrame:
    """Map of the nine cells to severity weight over the heaviest cell: one aggregation, nine sums."""
    zone = g.zone_id_3x3("centroid_x", "centroid_y", width, height)
    rows = defects.select(key, zone.alias("z"), r.severity_weight(severity).alias("w"))
    sums = rows.groupBy(key).agg(*[F.sum(F.when(F.col("z") == z, F.col("w")).otherwise(0.0)).alias(z) for z in ZONES_3X3])
    filled = inspections.select(key).join(sums, key, "left").fillna(0.0, subset=ZONES_3X3)
    top = F.greatest(*[F.col(z) for z in ZONES_3X3])
    pairs = [x for z in ZONES_3X3 for x in (F.lit(z), F.round(F.col(z) / F.when(top > 0, top).otherwise(1.0), 4))]
    return filled.select(key, F.create_map(*pairs).alias("zone_severity_index"))


def mean_severity_vi(defects: DataFrame, inspections: DataFrame, key: str = FACADE, severity: str = "severity_b") -> DataFrame:
    means = defects.groupBy(key).agg(F.avg(r.severity_weight(severity)).alias("__m"))
    score = F.coalesce("__m", F.lit(0.0))
    return inspections.join(means, key, "left").select(
        *inspections.columns,
        F.round(score, 3).alias("vi_score"),
        r.mean_severity_class(score).alias("vi_class"),
    )


def summary_stats(facades: DataFrame, defects: DataFrame, by: str = "building_id") -> DataFrame:
    """One row per building: facades, active defects, counts per type, mean and top score with its class."""
    heads = facades.groupBy(by).agg(
        F.count(F.lit(1)).alias("num_facades"), F.avg("vi_score").alias("mean_vi_score"), F.max("vi_score").alias("max_vi_score")
    )
    per_type = defects.where(is_active()).groupBy(by, "type").agg(F.count(F.lit(1)).alias("n"))
    counts = per_type.groupBy(by).agg(
        F.sum("n").alias("total_defects"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("defect_counts_by_type"),
    )
    return heads.join(counts, by, "left").withColumns(
        {
            "total_defects": F.coalesce("total_defects", F.lit(0)),
            "overall_vi_class": r.vi_class("max_vi_score", "roman"),
        }
    )


def building_vi(facades: DataFrame, by: str = "building_id") -> DataFrame:
    return facades.groupBy(by).agg(F.coalesce(F.max("vi_score"), F.lit(0.0)).alias("overall_vi"))


def dashboard_stats(defects: DataFrame, index_col: str, severity: str = "severity_b") -> DataFrame:
    return defects.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.lower(severity).isin("critical", "severe")).alias("critical"),
        F.coalesce(F.round(F.avg(index_col), 2), F.lit(0.0)).alias("mean_index"),
    )


def cycle_comparison(facades: DataFrame, defects: DataFrame, by: str = "building_id", cycle: str = "cycle_id") -> DataFrame:
    """Top score and active count of each cycle beside those of the cycle before it."""
    scores = facades.groupBy(by, cycle).agg(F.max("vi_score").alias("max_vi"))
    counts = defects.where(is_active()).groupBy(by, cycle).agg(F.count(F.lit(1)).alias("active"))
    both = scores.join(counts, [by, cycle], "left").fillna(0, subset=["active"])
    before = both.select(by, (F.col(cycle) + 1).alias(cycle), F.col("max_vi").alias("prev_max_vi"), F.col("active").alias("prev_active"))
    return both.join(before, [by, cycle]).withColumns(
        {"delta_vi": F.col("max_vi") - F.col("prev_max_vi"), "delta_active": F.col("active") - F.col("prev_active")}
    )


def previous_vi_from_delta(vi, delta) -> Column:
    """Score of the cycle before where only the change is known; never below zero."""
    return F.greatest(F.lit(0.0), g.col(vi) - g.col(delta))


def vi_by_orientation(current: DataFrame, previous: DataFrame, by: str = "building_id") -> DataFrame:
    """Both cycles' scores per orientation; a side without the orientation counts 0. A later facade of the
    same orientation replaces an earlier one."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(by, F.coalesce("orientation", F.lit("N")).alias("orientation")).agg(
            F.max_by("vi_score", "inspection_id").alias(name)
        )

    return side(current, "vi_current").join(side(previous, "vi_previous"), [by, "orientation"], "full").fillna(
        0.0, subset=["vi_current", "vi_previous"]
    )
