"""Matching defects between inspection cycles, and the growth that follows from a match.

A key of few defects is one group of a window whose frame is the cycle before: rows are shuffled once and
met by their candidates there. The rows of larger keys are matched by equi-joins on a grid cell besides the
cycle key, so the candidates of a defect are its neighbours in space and not its whole previous cycle. Copies
of one box or point are collapsed before that join and expanded after it; what is compared is the distinct
geometry of a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facadelake.config import DEFAULTS
from facadelake.functions import geometry as g
from facadelake.functions import rules as r
from facadelake.session import ensure_checkpoint_dir

BOX = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]
SMALL = 2_000  # rows of a key that may meet in one group


def _cells(low, high, cell: float):
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def _box_cells(boxes: DataFrame, cell: int) -> DataFrame:
    x, y, w, h = (F.col(c) for c in BOX)
    # The last covered pixel of a box of whole pixels; a box with fractions may reach one cell more.
    return boxes.withColumn("cell_x", _cells(x, x + w, cell)).withColumn("cell_y", _cells(y, y + h, cell))


def _large_keys(current: DataFrame, previous: DataFrame, by: Sequence[str], small: int) -> DataFrame | None:
    """Keys with more than ``small`` rows, None if there are none."""
    keys = current.select(*by) if current is previous else current.select(*by).unionByName(previous.select(*by))
    ensure_checkpoint_dir(current.sparkSession)
    large = keys.dropna().groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > small).drop("__n").checkpoint()
    return None if large.isEmpty() else large


def _with_candidates(current: DataFrame, previous: DataFrame, by: Sequence[str], cycle: str, candidate: dict[str, Column]) -> DataFrame:
    """``current`` with ``__candidates``: the rows of ``previous`` of the same key in the cycle before, as an array of structs.

    ``candidate`` names the fields and how a row of ``previous`` gives them. A table that is matched with itself is shuffled once.
    """
    own = current is previous
    if own:
        rows = current
        fields = F.struct(*[c.alias(n) for n, c in candidate.items()])
    else:
        given = previous.dropna(subset=[*by, cycle]).select(*by, cycle, *[c.alias(f"__p_{n}") for n, c in candidate.items()], F.lit(True).alias("__given"))
        rows = current.withColumn("__given", F.lit(False)).unionByName(given, allowMissingColumns=True)
        fields = F.when(F.col("__given"), F.struct(*[F.col(f"__p_{n}").alias(n) for n in candidate]))
    # Rows without a key meet nothing and are dealt anywhere.
    known = F.lit(True)
    for c in [*by, cycle]:
        known = known & F.col(c).isNotNull()
    spread = F.when(known, F.lit(0)).otherwise(F.pmod(F.xxhash64("defect_id"), F.lit(4096)).cast("int") + 1)
    dealt = rows.withColumn("__spread", spread).repartition(*by, "__spread")
    before = Window.partitionBy(*by, "__spread").orderBy(cycle).rangeBetween(-1, -1)
    met = dealt.withColumn("__candidates", F.when(F.col("__spread") == 0, F.collect_list(fields).over(before)))
    if not own:
        met = met.where(~F.col("__given")).drop("__given", *[f"__p_{n}" for n in candidate])
    return met.drop("__spread")


def match_iou(current: DataFrame, previous: DataFrame, order: Sequence[str], by: Sequence[str] = ("building_id",),
              cycle: str = "cycle_id", hi: float = DEFAULTS.iou_propagated, lo: float = DEFAULTS.iou_new,
              cell: int = 256, months: float = 1.0, small: int = SMALL) -> DataFrame:
    """Best-overlap match of each current defect in the cycle before it.

    At least ``hi`` is propagated; below ``lo`` is new, without parent and with zero change; between is
    uncertain, which keeps the parent and has no change values. Equal overlaps take the parent first in
    ``order``. A parent may be taken more than once. Overlaps below ``lo`` decide nothing, so they are
    dropped as soon as they are computed.
    """
    large = _large_keys(current, previous, by, small)
    if large is None:
        joined = _best_box_in_group(current, previous, order, by, cycle, min(lo, hi))
    else:
        joined = _by_size(current, previous, by, large, lambda c, p: _best_box_in_group(c, p, order, by, cycle, min(lo, hi)),
                          lambda c, p: _best_box_in_cell(c, p, order, by, cycle, min(lo, hi), cell))
    iou = F.coalesce(F.col("__best.iou"), F.lit(0.0))
    status = F.when(iou >= hi, "propagated").when(iou < lo, "new").otherwise("uncertain")
    out = joined.withColumns(
        {
            "temporal_status": status,
            "parent_defect_id": F.when(status != "new", F.col("__best.parent.defect_id")),
            "best_iou": F.col("__best.iou"),
        }
    )
    return deltas(out, months).drop("__best").withColumn("crack_activity_status", r.activity("growth_rate_mm_per_month"))


def _by_size(current: DataFrame, previous: DataFrame, by: Sequence[str], large: DataFrame, group, cells) -> DataFrame:
    """The rows of large keys matched by ``cells``, all others by ``group``."""
    def split(how: str) -> tuple[DataFrame, DataFrame]:
        first = current.join(large, list(by), how)
        return first, first if current is previous else previous.join(large, list(by), how)

    return group(*split("left_anti")).unionByName(cells(*split("left_semi")))


def _positive() -> Column:
    return (F.col("bbox_w") > 0) & (F.col("bbox_h") > 0)


def _best_box_in_group(current: DataFrame, previous: DataFrame, order: Sequence[str], by: Sequence[str], cycle: str, least: float) -> DataFrame:
    fields = {c: F.col(c) for c in [*BOX, "defect_id", "length_cm", "width_mm", "area_cm2"]} | {"place": F.struct(*order)}
    met = _with_candidates(current, previous, by, cycle, fields)
    found = F.transform(
        "__candidates",
        lambda p: F.when(
            p["bbox_x"].isNotNull() & p["bbox_y"].isNotNull() & (p["bbox_w"] > 0) & (p["bbox_h"] > 0),
            F.struct((-g.bbox_iou(BOX, [p[c] for c in BOX])).alias("iou"), F.struct(p["place"].alias("place"), *[p[c].alias(c) for c in ("defect_id", "length_cm", "width_mm", "area_cm2")]).alias("parent")),
        ),
    )
    best = F.array_min(F.filter(found, lambda x: (x["iou"] < 0) & (x["iou"] <= -least)))
    known = F.col("bbox_x").isNotNull() & F.col("bbox_y").isNotNull()
    met = met.withColumn("__first", F.when(known & _positive(), best)).drop("__candidates")
    return met.withColumn("__best", F.when(F.col("__first").isNotNull(), F.struct((-F.col("__first.iou")).alias("iou"), F.col("__first.parent").alias("parent")))).drop("__first")


def _best_box_in_cell(current: DataFrame, previous: DataFrame, order: Sequence[str], by: Sequence[str], cycle: str, least: float, cell: int) -> DataFrame:
    keys = [*by, cycle]
    parents = (
        previous.where(_positive())
        .withColumn(cycle, F.col(cycle) + 1)
        .groupBy(*keys, *BOX)
        .agg(
            F.min_by(
                F.struct(F.struct(*order).alias("place"), F.col("defect_id"), F.col("length_cm"), F.col("width_mm"), F.col("area_cm2")),
                F.struct(*order),
            ).alias("parent")
        )
        .select(*keys, *[F.col(c).alias(f"p_{c}") for c in BOX], "parent")
    )
    px, py, pw, ph = (F.col(f"p_{c}") for c in BOX)
    parent_cells = parents.withColumn("cell_x", _cells(px, px + pw, cell)).withColumn("cell_y", _cells(py, py + ph, cell))
    current_cells = _box_cells(current.where(_positive()).select(*keys, *BOX).distinct(), cell)
    x, y, w, h = (F.col(c) for c in BOX)
    # A pair that shares several cells is kept in the one cell that holds the corner of its overlap.
    home = (F.floor(F.greatest(x, px) / cell) == F.col("cell_x")) & (F.floor(F.greatest(y, py) / cell) == F.col("cell_y"))
    touching = (F.least(x + w, px + pw) > F.greatest(x, px)) & (F.least(y + h, py + ph) > F.greatest(y, py))
    pairs = (
        current_cells.join(parent_cells, [*keys, "cell_x", "cell_y"])
        .where(touching & home)
        .withColumn("iou", g.bbox_iou(BOX, [f"p_{c}" for c in BOX]))
        .where(F.col("iou") >= least)
    )
    best = pairs.groupBy(*keys, *BOX).agg(
        F.min_by(F.struct("iou", "parent"), F.struct(-F.col("iou"), "parent.place")).alias("__best")
    )
    return current.join(best, [*keys, *BOX], "left")


def deltas(df: DataFrame, months: float = 1.0) -> DataFrame:
    """Change against the matched parent, three digits; shrinking widths do not grow negatively."""
    kept, fresh = F.col("temporal_status") == "propagated", F.col("temporal_status") == "new"
    out = {}
    for name in ("length_cm", "width_mm", "area_cm2"):
        change = F.round(F.coalesce(F.col(name), F.lit(0.0)) - F.coalesce(F.col(f"__best.parent.{name}"), F.lit(0.0)), 3)
        out[f"delta_{name}"] = F.when(kept, change).when(fresh, 0.0)
    growth = F.greatest(
        F.lit(0.0), F.coalesce("width_mm", F.lit(0.0)) - F.coalesce(F.col("__best.parent.width_mm"), F.lit(0.0))
    ) / F.lit(float(months))
    out["growth_rate_mm_per_month"] = F.when(kept, F.round(growth, 3)).when(fresh, 0.0)
    return df.withColumns(out)


def aggressive_warnings(matched: DataFrame) -> DataFrame:
    return matched.where(F.col("crack_activity_status") == "aggressive").select(
        "defect_id",
        "growth_rate_mm_per_month",
        F.format_string(
            "AGGRESSIVE CRACK DETECTED: %s growth rate %.3f mm/month — immediate structural review required",
            "defect_id", "growth_rate_mm_per_month",
        ).alias("warning"),
    )


def match_centroid(current: DataFrame, previous: DataFrame, order: Sequence[str], by: Sequence[str] = ("building_id",),
                   cycle: str = "cycle_id", tol_px: float = DEFAULTS.centroid_tolerance_px,
                   months: float = DEFAULTS.elapsed_months, small: int = SMALL) -> DataFrame:
    """Nearest earlier defect of the same type within ``tol_px``; unmatched rows keep zero growth."""
    own = current is previous
    rate = F.col("growth_rate_mm_per_month") if "growth_rate_mm_per_month" in previous.columns else F.lit(0.0)
    old = ["matched_previous_id", "delta_width_mm", "growth_rate_mm_per_month", "growth_acceleration"]
    previous = previous.withColumn("__rate", rate).drop(*old)
    current = previous if own else current.drop(*old)
    elapsed = max(months, 0.001)
    large = _large_keys(current, previous, by, small)
    if large is None:
        joined = _nearest_in_group(current, previous, order, by, cycle, tol_px)
    else:
        joined = _by_size(current, previous, by, large, lambda c, p: _nearest_in_group(c, p, order, by, cycle, tol_px),
                          lambda c, p: _nearest_in_cell(c, p, order, by, cycle, tol_px))
    change = F.col("width_mm") - F.col("__best.parent.width_mm")
    growth = change / F.lit(elapsed)
    return joined.withColumns(
        {
            "matched_previous_id": F.col("__best.parent.defect_id"),
            "match_distance_px": F.col("__best.distance_px"),
            "delta_width_mm": F.coalesce(change, F.lit(0.0)),
            "growth_rate_mm_per_month": F.coalesce(growth, F.lit(0.0)),
            "growth_acceleration": F.coalesce(r.growth_acceleration(growth, "__best.parent.rate"), F.lit(0.0)),
        }
    ).drop("__best", "__rate")


def _distance(x: Column, y: Column) -> Column:
    gap_x, gap_y = F.col("centroid_x") - x, F.col("centroid_y") - y
    return F.sqrt((gap_x * gap_x + gap_y * gap_y).cast("double"))


def _nearest_in_group(current: DataFrame, previous: DataFrame, order: Sequence[str], by: Sequence[str], cycle: str, tol_px: float) -> DataFrame:
    fields = {c: F.col(c) for c in ("type", "centroid_x", "centroid_y", "defect_id", "width_mm")} | {"rate": F.col("__rate"), "place": F.struct(*order)}
    met = _with_candidates(current, previous, by, cycle, fields)
    near = F.transform(
        F.filter("__candidates", lambda p: p["type"] == F.col("type")),
        lambda p: F.struct(
            _distance(p["centroid_x"], p["centroid_y"]).alias("distance_px"), F.struct(p["place"].alias("place"), *[p[c].alias(c) for c in ("defect_id", "width_mm", "rate")]).alias("parent")
        ),
    )
    return met.withColumn("__best", F.array_min(F.filter(near, lambda x: x["distance_px"] <= tol_px))).drop("__candidates")


def _nearest_in_cell(current: DataFrame, previous: DataFrame, order: Sequence[str], by: Sequence[str], cycle: str, tol_px: float) -> DataFrame:
    """Cells are twice as wide as the tolerance: a parent reaches at most two of them along an axis, and a
    point looks into its own."""
    keys = [*by, cycle, "type"]
    cell = 2.0 * tol_px
    parents = (
        previous.withColumn(cycle, F.col(cycle) + 1)
        .groupBy(*keys, F.col("centroid_x").alias("p_x"), F.col("centroid_y").alias("p_y"))
        .agg(
            F.min_by(
                F.struct(F.struct(*order).alias("place"), F.col("defect_id"), F.col("width_mm"), F.col("__rate").alias("rate")), F.struct(*order)
            ).alias("parent")
        )
        .withColumn("cell_x", _cells(F.col("p_x") - tol_px, F.col("p_x") + tol_px, cell))
        .withColumn("cell_y", _cells(F.col("p_y") - tol_px, F.col("p_y") + tol_px, cell))
    )
    points = (
        current.select(*keys, "centroid_x", "centroid_y")
        .distinct()
        .withColumn("cell_x", F.floor(F.col("centroid_x") / cell))
        .withColumn("cell_y", F.floor(F.col("centroid_y") / cell))
    )
    pairs = points.join(parents, [*keys, "cell_x", "cell_y"]).withColumn("distance_px", _distance(F.col("p_x"), F.col("p_y"))).where(F.col("distance_px") <= tol_px)
    best = pairs.groupBy(*keys, "centroid_x", "centroid_y").agg(
        F.min_by(F.struct("distance_px", "parent"), F.struct("distance_px", "parent.place")).alias("__best")
    )
    return current.join(best, [*keys, "centroid_x", "centroid_y"], "left")


def chain_acceleration(matched: DataFrame) -> DataFrame:
    """Acceleration along the chain: the parent's own rate is read from its row of the same result."""
    parents = matched.where("growth_rate_mm_per_month <> 0").select(
        F.col("defect_id").alias("matched_previous_id"), F.col("growth_rate_mm_per_month").alias("__prev")
    )
    chained = F.when(F.col("matched_previous_id").isNotNull(), r.growth_acceleration("growth_rate_mm_per_month", "__prev")).otherwise(0.0)
    return matched.drop("growth_acceleration").join(parents, "matched_previous_id", "left").withColumn("growth_acceleration", chained).drop("__prev")


def resolved(matched: DataFrame, previous: DataFrame, by: Sequence[str] = ("building_id",), cycle: str = "cycle_id") -> DataFrame:
    """Earlier defects whose next cycle exists and holds no match of them."""
    followed = matched.select(*by, (F.col(cycle) - 1).alias(cycle)).distinct()
    taken = matched.where("temporal_status = 'propagated'").select(F.col("parent_defect_id").alias("defect_id"))
    return previous.join(followed, [*by, cycle], "left_semi").join(taken, "defect_id", "left_anti").withColumn(
        "temporal_status", F.lit("resolved")
    )


def previous_cycle_defects(defects: DataFrame, results: DataFrame, jobs: DataFrame) -> DataFrame:
    """For every job after the first cycle: the defects of the building's succeeded job one cycle before."""
    done = (
        jobs.where(F.col("status") == "succeeded")
        .select("building_id", (F.col("cycle_id") + 1).alias("cycle_id"), F.col("job_id").alias("prev_job_id"))
    )
    wanted = jobs.where("cycle_id > 1").select("job_id", "building_id", "cycle_id").join(done, ["building_id", "cycle_id"])
    found = wanted.join(results.select(F.col("job_id").alias("prev_job_id"), "inspection_id"), "prev_job_id")
    return found.select("job_id", "building_id", "cycle_id", "inspection_id").join(defects, "inspection_id")


def temporal_comparison(matched: DataFrame, facades: DataFrame, by: str = "building_id", cycle: str = "cycle_id") -> DataFrame:
    """Per building and cycle after the first: change of score, new and propagated counts, cycle compared."""
    scores = facades.groupBy(by, cycle).agg(F.max("vi_score").alias("vi"))
    before = scores.select(by, (F.col(cycle) + 1).alias(cycle), F.col("vi").alias("prev_vi"))
    counts = matched.groupBy(by, cycle).agg(
        F.count_if(F.col("temporal_status") == "new").alias("new_defects_count"),
        F.count_if(F.col("temporal_status") == "propagated").alias("propagated_defects_count"),
    )
    return (
        scores.join(before, [by, cycle])
        .join(counts, [by, cycle], "left")
        .select(
            by,
            cycle,
            (F.col(cycle) - 1).alias("comparison_cycle"),
            (F.col("vi") - F.col("prev_vi")).alias("delta_vi"),
            F.coalesce("new_defects_count", F.lit(0)).alias("new_defects_count"),
            F.coalesce("propagated_defects_count", F.lit(0)).alias("propagated_defects_count"),
        )
    )
