"""Paged and ordered reads of the inspection store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facadelake.functions.geometry import lookup
from facadelake.functions.predicates import for_org
from facadelake.session import work_dir

from .hotkeys import magnitude_bucket, time_bucket


SHALLOW = 10_000  # pages that end within so many rows are a rank limit that Spark applies map-side
DAY = 86_400


def _magnitude(col: str) -> Column:
    """Ordered bucket of a number, infinities and NaN, the largest value, included."""
    c = F.col(col).cast("double")
    edge = F.when(F.isnan(c), F.lit(1 << 41)).when(c == float("inf"), F.lit(1 << 40)).when(c == float("-inf"), F.lit(-(1 << 40)))
    return edge.otherwise(magnitude_bucket(c))


def _page(rows: DataFrame, order: Sequence[Column], bucket: Column, page: int, size: int, top: int, shallow: int = SHALLOW) -> DataFrame:
    """Rows of a page in ``order``; ``bucket`` falls with it and is null last, as its first column is.

    Beyond ``shallow`` rows only the ranges that the page lies in are sorted: buckets are counted, those that the page overlaps (``size``
    at most, as none is empty) are kept, and their rows, which one value may all share, are sorted in ranges of the whole order by many
    tasks. The sorted ranges are written once, and a row's place follows from the counts of the ranges before its own.
    """
    size = max(1, min(size, top))
    first = (max(page, 1) - 1) * size
    if first + size <= shallow:
        return rows.orderBy(*order).offset(first).limit(size)
    placed = rows.withColumn("__bucket", bucket)
    before = Window.orderBy(F.col("__bucket").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    wanted = totals.where((F.col("__start") < first + size) & (F.col("__start") + F.col("__n") > first)).select(F.col("__bucket").alias("__wanted"), "__start")
    near = placed.join(F.broadcast(wanted), F.col("__bucket").eqNullSafe(F.col("__wanted"))).drop("__bucket", "__wanted")
    # The upper bits of the id are the range's number, the lower ones the row's place in it.
    ranged = near.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    path = work_dir(rows.sparkSession, "page")
    ranged.withColumn("__range", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id").write.parquet(path)
    ranged = rows.sparkSession.read.parquet(path)
    lower = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__start").alias("__low"))
    starts = starts.select("__range", (F.coalesce(F.sum("__n").over(lower), F.lit(0)) + F.min("__low").over(Window.partitionBy())).alias("__before"))
    # One row for each range that Spark sorted.
    place = F.col("__before") + F.col("__at")
    found = ranged.join(F.broadcast(starts), "__range").where((place >= first) & (place < first + size))
    return found.orderBy(*order).select(*rows.columns)


def page_jobs(jobs: DataFrame, org_id, building=None, status: str | None = None, page: int = 1, size: int = 20,
              shallow: int = SHALLOW) -> tuple[DataFrame, DataFrame]:
    """One tenant's jobs, newest first, and a one-row frame with the total and the number of pages."""
    rows = for_org(jobs, org_id)
    if building is not None:
        rows = rows.where(F.col("building_id") == building)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    size = max(1, min(size, 100))
    totals = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.expr(f"(total + {size - 1}) div {size}"))
    return _page(rows, [F.col("queued_at").desc(), F.col("job_id")], time_bucket("queued_at", DAY), page, size, 100, shallow), totals


# Severity is sorted by area, like the area order.
SORTS = {"severity": "area_px2", "area": "area_px2", "growth_rate": "growth_rate_mm_per_month"}


def page_defects(defects: DataFrame, sort_by: str = "severity", page: int = 1, size: int = 50, shallow: int = SHALLOW) -> tuple[DataFrame, DataFrame]:
    totals = defects.agg(F.count(F.lit(1)).alias("total"))
    by = SORTS[sort_by]
    return _page(defects, [F.col(by).desc_nulls_last(), F.col("defect_id")], _magnitude(by), page, size, 200, shallow), totals


def latest_inspections(inspections: DataFrame, building=None, limit: int = 50) -> DataFrame:
    rows = inspections if building is None else inspections.where(F.col("building_id") == building)
    return rows.orderBy(F.col("run_timestamp").desc(), F.col("inspection_id").desc()).limit(max(1, min(limit, 200)))


def defects_alphabetical(defects: DataFrame, severity: str = "severity") -> DataFrame:
    """Severity by name, descending (severe, moderate, hairline), then the larger area."""
    return defects.orderBy(F.col(severity).desc(), F.col("area_px2").desc(), F.col("defect_id"))


def remediation_order(ties: Sequence[str] = ("defect_id",), severity: str = "severity_class") -> list[Column]:
    rank = lookup({"wide": 0, "medium": 1, "fine": 2, "hairline": 3}, F.coalesce(F.col(severity), F.lit("hairline")), 4)
    return [rank, *[F.col(c) for c in ties]]


def jobs_with_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    return jobs.join(results, "job_id", "left")


def reject_in_flight(submissions: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions split by whether another job of the same building and cycle is pending or running."""
    busy = jobs.where(F.col("status").isin("pending", "running")).select("building_id", "cycle_id").distinct()
    return submissions.join(busy, ["building_id", "cycle_id"], "left_anti"), submissions.join(busy, ["building_id", "cycle_id"], "left_semi")


def latest_defects(inspections: DataFrame, defects: DataFrame, inspection_id=None) -> DataFrame:
    """Defects of the given inspection, or of the newest run: its id is one aggregated row."""
    if inspection_id is not None:
        return defects.where(F.col("inspection_id") == inspection_id)
    newest = inspections.agg(F.max_by("inspection_id", F.struct("run_timestamp", "inspection_id")).alias("inspection_id"))
    return defects.join(F.broadcast(newest), "inspection_id", "left_semi")


def propagated_chain(defects: DataFrame, inspections: DataFrame, building_id=None) -> DataFrame:
    heads = inspections if building_id is None else inspections.where(F.col("building_id") == building_id)
    return (
        defects.where(F.col("matched_previous_id").isNotNull())
        .join(heads.select("inspection_id", "building_id", "cycle_id", "run_timestamp"), "inspection_id")
        .orderBy(F.col("growth_acceleration").desc(), F.col("growth_rate_mm_per_month").desc(), "defect_id")
    )


def store_stats(inspections: DataFrame, defects: DataFrame, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct("building_id") if approx else F.count_distinct("building_id")
    heads = inspections.agg(F.count(F.lit(1)).alias("total_inspections"), distinct.alias("unique_buildings"))
    # Two one-row frames side by side.
    return heads.crossJoin(F.broadcast(defects.agg(F.count(F.lit(1)).alias("total_defects"))))


def org_stats(orgs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs per active organisation, counted before the join; organisations without jobs count 0."""
    counts = jobs.groupBy("org_id").agg(F.count("job_id").alias("total_jobs"))
    return orgs.where("is_active").select("org_id").join(counts, "org_id", "left").fillna(0, subset=["total_jobs"])
