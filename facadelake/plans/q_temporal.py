"""Queries of cycle matching and growth (J1, J2, J4, J5, W3, N5, A14, R17, R18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from facadelake.operators import listing, temporal
from facadelake.plans.q_scoring import _FIRST, ORDER, facades
from facadelake.plans.registry import query, sql_view

KEYS = ["inspection_id", "building_id", "cycle_id"]


def with_cycle(t):
    """Defects and their boxes with the building and cycle of their inspection."""
    return t.defects_of(t.inspections.select(*KEYS))


def iou_matches(t):
    rows = with_cycle(t)
    return temporal.match_iou(rows, rows, ORDER)


# A stored rate, so that the first comparison has something to accelerate from.
_STORED = "(part_no % 7 - 3) / 1e2"


def centroid_matches(t):
    rows = with_cycle(t).withColumn("growth_rate_mm_per_month", F.expr(_STORED))
    return temporal.match_centroid(rows, rows, ORDER)


sql_view("cbox_v", f"SELECT b.*, {_FIRST} AS place, i.building_id, i.cycle_id FROM boxes_v b JOIN inspections_v i ON b.inspection_id = i.inspection_id")
sql_view(
    "iou_v",
    """SELECT id, arg_min(pid, (-iou, place)) AS pid, max(iou) AS iou, arg_min(pl, (-iou, place)) AS pl, arg_min(pw, (-iou, place)) AS pw, arg_min(pa, (-iou, place)) AS pa FROM (
         SELECT c.defect_id AS id, p.defect_id AS pid, p.place, p.length_cm AS pl, p.width_mm AS pw, p.area_cm2 AS pa,
           CAST(greatest(0, least(c.bbox_x + c.bbox_w, p.bbox_x + p.bbox_w) - greatest(c.bbox_x, p.bbox_x)) * greatest(0, least(c.bbox_y + c.bbox_h, p.bbox_y + p.bbox_h) - greatest(c.bbox_y, p.bbox_y)) AS DOUBLE) AS inter,
           inter / (c.bbox_w * c.bbox_h + p.bbox_w * p.bbox_h - inter) AS iou
         FROM cbox_v c JOIN cbox_v p ON c.building_id = p.building_id AND c.cycle_id = p.cycle_id + 1) x WHERE iou > 0 GROUP BY id""",
)
sql_view(
    "matched_v",
    """SELECT defect_id, building_id, cycle_id, status, CASE WHEN status <> 'new' THEN pid END AS parent,
         CASE status WHEN 'propagated' THEN round(length_cm - pl, 3) WHEN 'new' THEN 0 END AS dl, CASE status WHEN 'propagated' THEN round(width_mm - pw, 3) WHEN 'new' THEN 0 END AS dw,
         CASE status WHEN 'propagated' THEN round(area_cm2 * 0.123456789::DOUBLE - pa * 0.123456789::DOUBLE, 3) WHEN 'new' THEN 0 END AS da, CASE status WHEN 'propagated' THEN round(greatest(0, width_mm - pw), 3) WHEN 'new' THEN 0 END AS rate
       FROM (SELECT c.*, m.pid, m.pl, m.pw, m.pa, CASE WHEN coalesce(m.iou, 0) >= 0.3 THEN 'propagated' WHEN coalesce(m.iou, 0) < 0.1 THEN 'new' ELSE 'uncertain' END AS status
             FROM cbox_v c LEFT JOIN iou_v m ON c.defect_id = m.id) x""",
)


@query("j1_iou_match", "SELECT defect_id, status AS temporal_status, parent AS parent_defect_id, CASE WHEN rate IS NULL THEN 'unmonitored' WHEN rate < 0.01 THEN 'dormant' WHEN rate < 0.05 THEN 'active' ELSE 'aggressive' END AS activity FROM matched_v")
def _(t):
    return iou_matches(t).select("defect_id", "temporal_status", "parent_defect_id", F.col("crack_activity_status").alias("activity"))


@query("r17_deltas", "SELECT defect_id, dl AS delta_length_cm, dw AS delta_width_mm, da AS delta_area_cm2, rate FROM matched_v WHERE status = 'propagated'")
def _(t):
    # A factor of many digits keeps area differences off rounding ties.
    rows = with_cycle(t).withColumn("area_cm2", F.col("area_cm2") * 0.123456789)
    return temporal.match_iou(rows, rows, ORDER).where("temporal_status = 'propagated'").select(
        "defect_id", "delta_length_cm", "delta_width_mm", "delta_area_cm2", F.col("growth_rate_mm_per_month").alias("rate")
    )


@query("r18_aggressive_warnings", "SELECT defect_id, 'AGGRESSIVE CRACK DETECTED: ' || defect_id || ' growth rate ' || printf('%.3f', rate) || ' mm/month — immediate structural review required' AS warning FROM matched_v WHERE rate >= 0.05")
def _(t):
    return temporal.aggressive_warnings(iou_matches(t)).select("defect_id", "warning")


@query(
    "n5_resolved",
    """SELECT defect_id, building_id, cycle_id FROM cbox_v p WHERE EXISTS (SELECT 1 FROM cbox_v n WHERE n.building_id = p.building_id AND n.cycle_id = p.cycle_id + 1)
         AND NOT EXISTS (SELECT 1 FROM matched_v m WHERE m.status = 'propagated' AND m.parent = p.defect_id)""",
)
def _(t):
    return temporal.resolved(iou_matches(t), with_cycle(t)).select("defect_id", "building_id", "cycle_id")


@query(
    "a14_temporal_comparison",
    """SELECT c.building_id, c.cycle_id, c.cycle_id - 1 AS comparison_cycle, round(c.vi_score - p.vi_score, 5) AS delta_vi, coalesce(n.fresh, 0) AS new_defects_count, coalesce(n.kept, 0) AS propagated_defects_count
       FROM facade_v c JOIN facade_v p ON c.building_id = p.building_id AND c.cycle_id = p.cycle_id + 1
       LEFT JOIN (SELECT building_id, cycle_id, count(*) FILTER (WHERE status = 'new') AS fresh, count(*) FILTER (WHERE status = 'propagated') AS kept FROM matched_v GROUP BY 1, 2) n
         ON c.building_id = n.building_id AND c.cycle_id = n.cycle_id""",
)
def _(t):
    return temporal.temporal_comparison(iou_matches(t), facades(t, True)).withColumn("delta_vi", F.round("delta_vi", 5))


sql_view(
    "near_v",
    f"""SELECT id, arg_min(pid, (d, place)) AS pid, min(d) AS d, arg_min(pw, (d, place)) AS pw, arg_min(prate, (d, place)) AS prate FROM (
         SELECT c.defect_id AS id, p.defect_id AS pid, p.place, p.width_mm AS pw, (p.part_no % 7 - 3) / 1e2 AS prate,
                sqrt(CAST((c.centroid_x - p.centroid_x) ** 2 + (c.centroid_y - p.centroid_y) ** 2 AS DOUBLE)) AS d
         FROM cbox_v c JOIN cbox_v p ON c.building_id = p.building_id AND c.cycle_id = p.cycle_id + 1 AND c.type = p.type) x GROUP BY id""",
)
sql_view(
    "grown_v",
    """SELECT defect_id, inspection_id, building_id, cycle_id, pid, d, coalesce(dw, 0) AS dw, coalesce(dw / 6, 0) AS rate, CASE WHEN pid IS NULL THEN 0 WHEN prate <> 0 THEN dw / 6 - prate ELSE dw / 6 END AS acc
       FROM (SELECT c.*, n.pid, n.d, n.prate, c.width_mm - n.pw AS dw FROM cbox_v c LEFT JOIN (SELECT * FROM near_v WHERE d <= 25) n ON c.defect_id = n.id) x""",
)


@query(
    "j2_centroid_match",
    "SELECT defect_id, pid AS matched_previous_id, round(d, 6) AS distance_px, round(dw, 6) AS delta_width_mm, round(rate, 6) AS growth_rate, round(acc, 6) AS growth_acceleration FROM grown_v",
)
def _(t):
    return centroid_matches(t).select(
        "defect_id", "matched_previous_id", F.round("match_distance_px", 6).alias("distance_px"), F.round("delta_width_mm", 6).alias("delta_width_mm"),
        F.round("growth_rate_mm_per_month", 6).alias("growth_rate"), F.round("growth_acceleration", 6).alias("growth_acceleration"),
    )


@query(
    "w3_chain_acceleration",
    """SELECT g.defect_id, round(CASE WHEN g.pid IS NULL THEN 0 WHEN coalesce(p.rate, 0) <> 0 THEN g.rate - p.rate ELSE g.rate END, 6) AS growth_acceleration
       FROM grown_v g LEFT JOIN grown_v p ON g.pid = p.defect_id""",
)
def _(t):
    return temporal.chain_acceleration(centroid_matches(t)).select("defect_id", F.round("growth_acceleration", 6).alias("growth_acceleration"))


@query(
    "j5_propagated_chain",
    "SELECT g.defect_id, g.building_id, g.cycle_id, round(acc, 6) AS growth_acceleration, round(rate, 6) AS growth_rate FROM grown_v g WHERE pid IS NOT NULL",
)
def _(t):
    heads = t.inspections.withColumn("run_timestamp", F.col("inspection_date").cast("timestamp"))
    rows = centroid_matches(t).drop("building_id", "cycle_id")
    return listing.propagated_chain(rows, heads).select(
        "defect_id", "building_id", "cycle_id", F.round("growth_acceleration", 6).alias("growth_acceleration"), F.round("growth_rate_mm_per_month", 6).alias("growth_rate")
    )


@query(
    "j4_previous_cycle",
    """SELECT j.inspection_id AS job_id, d.defect_id FROM inspections_v j JOIN inspections_v p ON p.building_id = j.building_id AND p.cycle_id = j.cycle_id - 1 AND p.status = 'succeeded'
       JOIN defects_v d ON d.inspection_id = p.inspection_id WHERE j.cycle_id > 1""",
)
def _(t):
    jobs = t.inspections.withColumn("job_id", F.col("inspection_id"))
    return temporal.previous_cycle_defects(t.defects, jobs.select("job_id", "inspection_id"), jobs.drop("inspection_id")).select("job_id", "defect_id")
