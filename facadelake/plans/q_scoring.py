"""Queries of scores and reports (A*, N*, K5, K7, R7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from facadelake.functions import geometry as g
from facadelake.functions import rules as r
from facadelake.operators import reports, scoring
from facadelake.plans import sqltext as s
from facadelake.plans.registry import query, sql_view
from facadelake.sources.tables import IMAGE_H, IMAGE_W

ORDER = ["line_no", "part_no", "supp_no", "price"]
_FIRST = "line_no * 1e12 + part_no * 1e6 + supp_no + price * 1e-8"


def scored(t, dealt: bool = False):
    """Defects with severity, contribution and zone."""
    return (t.dealt_defects() if dealt else t.defects).withColumns(
        {
            "severity_class": r.severity4("width_mm"),
            "vi": r.defect_vi(),
            "zone_id": g.zone_id("centroid_x", "centroid_y", IMAGE_W, IMAGE_H),
        }
    )


def facades(t, with_cycle: bool = False):
    """Each inspection as a facade with its score."""
    base = t.inspections if with_cycle else t.inspections_base
    return scoring.facade_vi(scored(t), base).withColumn("facade_id", F.col("inspection_id"))


def zones(t):
    return scoring.zone_scores(scored(t), t.inspections_base, ORDER)


sql_view(
    "facade_v",
    """SELECT i.*, i.inspection_id AS facade_id, CASE WHEN i.facade_area_cm2 > 0 THEN least(100.0::DOUBLE, coalesce(s.vi, 0) / i.facade_area_cm2 * 100) ELSE 0 END AS vi_score
       FROM inspections_v i LEFT JOIN (SELECT inspection_id, sum(vi) AS vi FROM scored_v GROUP BY 1) s ON i.inspection_id = s.inspection_id""",
)
sql_view(
    "zone_type_v",
    f"SELECT inspection_id, zone_id, type, count(*) AS n, sum(vi) AS s, min({_FIRST}) AS first FROM zoned_v GROUP BY 1, 2, 3",
)
sql_view(
    "cells_v",
    "SELECT inspection_id, building_id, orientation, facade_area_cm2 / 16 AS zone_area_cm2, chr(65 + c) || (y + 1) AS zone_id FROM inspections_v, (SELECT CAST(unnest(range(4)) AS INT) AS c) a, (SELECT CAST(unnest(range(4)) AS INT) AS y) b",
)
sql_view(
    "zone_v",
    """SELECT c.inspection_id, c.building_id, c.zone_id, c.zone_area_cm2, coalesce(z.n, 0) AS defect_count,
         CASE WHEN c.zone_area_cm2 > 0 AND z.s IS NOT NULL THEN round(least(100.0::DOUBLE, z.s / c.zone_area_cm2 * 100), 3) ELSE 0 END AS zone_vi, z.dominant AS dominant_defect_type
       FROM cells_v c LEFT JOIN (SELECT inspection_id, zone_id, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, arg_min(type, (-n, first)) AS dominant FROM zone_type_v GROUP BY 1, 2) z
         ON c.inspection_id = z.inspection_id AND c.zone_id = z.zone_id""",
)


@query(
    "flagship_worst_zones",
    f"""SELECT inspection_id, zone_id, zone_vi, defect_count, dominant_defect_type, 'Class ' || {s.case_bands('zone_vi', r.VI_BANDS, 1)} || ' (' || {s.case_bands('zone_vi', r.VI_BANDS, 2)} || ')' AS vi_class
        FROM zone_v WHERE defect_count > 0 ORDER BY zone_vi DESC, inspection_id, zone_id""",
)
def _(t):
    """Occupied zones of every facade, worst first."""
    return (
        zones(t)
        .where("defect_count > 0")
        .select("inspection_id", "zone_id", "zone_vi", "defect_count", "dominant_defect_type", r.vi_class("zone_vi").alias("vi_class"))
        .orderBy(F.col("zone_vi").desc(), "inspection_id", "zone_id")
    )


@query("a1_facade_vi", "SELECT inspection_id, round(vi_score, 6) AS vi_score FROM facade_v")
def _(t):
    return facades(t).select("inspection_id", F.round("vi_score", 6).alias("vi_score"))


@query("a2_zone_scores", "SELECT inspection_id, zone_id, zone_area_cm2, defect_count, zone_vi, dominant_defect_type FROM zone_v")
def _(t):
    return zones(t)


@query(
    "a3_zone_records",
    f"""SELECT z.inspection_id, z.zone_id, z.defect_count AS defect_count_all, coalesce(a.n, 0) AS defect_count_active, a.dominant AS dominant_defect_type
        FROM zone_v z LEFT JOIN (SELECT inspection_id, zone_id, CAST(sum(n) AS BIGINT) AS n, arg_min(type, (-n, first)) AS dominant
             FROM (SELECT inspection_id, zone_id, type, count(*) AS n, min({_FIRST}) AS first FROM zoned_v WHERE NOT is_false_positive GROUP BY 1, 2, 3) x GROUP BY 1, 2) a
          ON z.inspection_id = a.inspection_id AND z.zone_id = a.zone_id""",
)
def _(t):
    return scoring.zone_records(zones(t), scored(t), ORDER).select(
        "inspection_id", "zone_id", "defect_count_all", "defect_count_active", "dominant_defect_type"
    )


_W3 = s.case_map("severity_b", r.SEVERITY_WEIGHTS_3, 1.0)
_Z3 = "'R' || least(3, CAST(floor(centroid_y / 128.0) AS INT) + 1) || 'C' || least(3, CAST(floor(centroid_x / (512.0::DOUBLE / 3)) AS INT) + 1)"


@query(
    "a4_zone_severity_index",
    f"""SELECT inspection_id, zone_id, round(w / CASE WHEN top > 0 THEN top ELSE 1 END, 4) AS index
        FROM (SELECT *, max(w) OVER (PARTITION BY inspection_id) AS top FROM (
          SELECT c.inspection_id, c.zone_id, coalesce(sum(d.w), 0) AS w
          FROM (SELECT inspection_id, 'R' || y || 'C' || x AS zone_id FROM inspections_v, (SELECT unnest([1, 2, 3]) AS y) a, (SELECT unnest([1, 2, 3]) AS x) b) c
          LEFT JOIN (SELECT inspection_id, {_Z3} AS zone_id, {_W3} AS w FROM defects_v) d ON c.inspection_id = d.inspection_id AND c.zone_id = d.zone_id
          GROUP BY 1, 2) g) h""",
)
def _(t):
    out = scoring.zone_severity_index(t.defects, t.inspections_base, IMAGE_W, IMAGE_H)
    return out.select("inspection_id", F.explode("zone_severity_index").alias("zone_id", "index"))


sql_view(
    "mean_v",
    f"SELECT i.inspection_id, i.building_id, i.cycle_id, i.org_id, i.status, i.inspection_date, coalesce(d.m, 0) AS m FROM inspections_v i LEFT JOIN (SELECT inspection_id, avg({_W3}) AS m FROM defects_v GROUP BY 1) d ON i.inspection_id = d.inspection_id",
)
_CLASS4 = "CASE WHEN m < 1.5 THEN 'minor' WHEN m < 3 THEN 'moderate' WHEN m < 5.5 THEN 'severe' ELSE 'critical' END"


@query("a5_mean_severity_vi", f"SELECT inspection_id, round(m, 3) AS vi_score, {_CLASS4} AS vi_class FROM mean_v")
def _(t):
    return scoring.mean_severity_vi(t.defects, t.inspections_base).select("inspection_id", "vi_score", "vi_class")


def with_building(t, rows):
    return rows.join(t.inspections_base.select("inspection_id", "building_id"), "inspection_id")


@query(
    "a6_summary_stats",
    f"""SELECT h.building_id, num_facades, round(mean_vi, 5) AS mean_vi_score, round(max_vi, 5) AS max_vi_score, {s.case_bands('max_vi', r.VI_BANDS, 1)} AS overall_vi_class,
          coalesce(total, 0) AS total_defects, counts
        FROM (SELECT building_id, count(*) AS num_facades, avg(vi_score) AS mean_vi, max(vi_score) AS max_vi FROM facade_v GROUP BY 1) h
        LEFT JOIN (SELECT building_id, CAST(sum(n) AS BIGINT) AS total, string_agg(type || '=' || n, ',' ORDER BY type) AS counts
             FROM (SELECT building_id, type, count(*) AS n FROM defects_v d JOIN inspections_v i ON d.inspection_id = i.inspection_id WHERE NOT is_false_positive GROUP BY 1, 2) x GROUP BY 1) c
          ON h.building_id = c.building_id""",
)
def _(t):
    out = scoring.summary_stats(facades(t), with_building(t, t.defects))
    text = F.array_join(F.transform(F.map_entries("defect_counts_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select(
        "building_id", "num_facades", F.round("mean_vi_score", 5).alias("mean_vi_score"), F.round("max_vi_score", 5).alias("max_vi_score"),
        "overall_vi_class", "total_defects", text.alias("counts"),
    )


@query(
    "a7_defect_inventory",
    """SELECT building_id, CASE WHEN t = 1 THEN 'TOTAL ACTIVE DEFECTS' ELSE title END AS category, n, CAST(t AS INT) AS is_total FROM (
         SELECT building_id, type, count(*) AS n, grouping(type) AS t,
                CASE type WHEN 'water_seepage' THEN 'Water Seepage' WHEN 'shear_crack' THEN 'Shear Crack' WHEN 'compression_crack' THEN 'Compression Crack' ELSE upper(type[1]) || substr(type, 2) END AS title
         FROM defects_v d JOIN inspections_v i ON d.inspection_id = i.inspection_id WHERE NOT is_false_positive GROUP BY GROUPING SETS ((building_id, type), (building_id))) x""",
)
def _(t):
    return reports.defect_inventory(with_building(t, t.defects), ["building_id"])


@query("a13_dashboard_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE severity_b = 'severe') AS critical, round(avg(width_mm), 2) AS mean_index FROM defects_v")
def _(t):
    return scoring.dashboard_stats(t.defects, "width_mm")


@query(
    "a15_cycle_comparison",
    """SELECT c.building_id, c.cycle_id, round(c.vi, 5) AS max_vi, round(p.vi, 5) AS prev_max_vi, c.n AS active, p.n AS prev_active, round(c.vi - p.vi, 5) AS delta_vi, c.n - p.n AS delta_active
       FROM cyc_v c JOIN cyc_v p ON c.building_id = p.building_id AND c.cycle_id = p.cycle_id + 1""",
)
def _(t):
    cycles = t.inspections.select("inspection_id", "building_id", "cycle_id")
    out = scoring.cycle_comparison(facades(t, True), t.defects.join(cycles, "inspection_id"))
    names = ("max_vi", "prev_max_vi", "delta_vi")
    return out.withColumns({c: F.round(c, 5) for c in names}).select(
        "building_id", "cycle_id", "max_vi", "prev_max_vi", "active", "prev_active", "delta_vi", "delta_active"
    )


sql_view(
    "cyc_v",
    """SELECT f.building_id, f.cycle_id, f.vi_score AS vi, coalesce(d.n, 0) AS n FROM facade_v f
       LEFT JOIN (SELECT inspection_id, count(*) AS n FROM defects_v WHERE NOT is_false_positive GROUP BY 1) d ON f.inspection_id = d.inspection_id""",
)


@query("a15_previous_vi", "SELECT inspection_id, round(greatest(0, vi_score - (inspection_id % 30 - 10)), 6) AS previous_vi FROM facade_v")
def _(t):
    return facades(t).select("inspection_id", F.round(scoring.previous_vi_from_delta("vi_score", F.col("inspection_id") % 30 - 10), 6).alias("previous_vi"))


@query(
    "a16_score_histogram",
    """SELECT CAST(b.bin AS INT) AS bin, round(lo + (hi - lo) / 30 * b.bin, 6) AS bin_start, round(lo + (hi - lo) / 30 * (b.bin + 1), 6) AS bin_end, coalesce(n, 0) AS n
       FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN (SELECT min(area_cm2) AS lo, max(area_cm2) AS hi FROM defects_v) r
       LEFT JOIN (SELECT least(29, CAST(floor((area_cm2 - lo) / (hi - lo) * 30) AS INT)) AS bin, count(*) AS n FROM defects_v, (SELECT min(area_cm2) AS lo, max(area_cm2) AS hi FROM defects_v) x GROUP BY 1) c ON b.bin = c.bin""",
)
def _(t):
    return reports.score_histogram(t.defects, "area_cm2").withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


@query("a17_type_share", "SELECT severity_b, type, count(*) AS n, round(count(*) * 100e0 / sum(count(*)) OVER (PARTITION BY severity_b), 1) AS share_pct FROM defects_v GROUP BY 1, 2")
def _(t):
    return reports.type_share(t.defects, ["severity_b"])


@query("a18_building_vi", "SELECT building_id, round(max(vi_score), 6) AS overall_vi FROM facade_v GROUP BY 1")
def _(t):
    return scoring.building_vi(facades(t)).withColumn("overall_vi", F.round("overall_vi", 6))


sql_view("role_v", "SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY cycle_id DESC) AS place FROM facade_v")


@query("n6_current_previous", "SELECT building_id, cycle_id, inspection_id, CASE place WHEN 1 THEN 'current' ELSE 'previous' END AS role FROM role_v WHERE place <= 2")
def _(t):
    return reports.current_and_previous(t.inspections).select("building_id", "cycle_id", "inspection_id", "role")


@query(
    "j13_vi_by_orientation",
    """SELECT coalesce(c.building_id, p.building_id) AS building_id, coalesce(c.orientation, p.orientation) AS orientation, round(coalesce(c.vi_score, 0), 6) AS vi_current, round(coalesce(p.vi_score, 0), 6) AS vi_previous
       FROM (SELECT * FROM role_v WHERE place = 1) c FULL JOIN (SELECT * FROM role_v WHERE place = 2) p ON c.building_id = p.building_id AND c.orientation = p.orientation""",
)
def _(t):
    roles = reports.current_and_previous(facades(t, True))
    out = scoring.vi_by_orientation(roles.where("role = 'current'"), roles.where("role = 'previous'"))
    return out.withColumns({c: F.round(c, 6) for c in ("vi_current", "vi_previous")})


@query(
    "n3_heatmap",
    "SELECT inspection_id, CAST(substr(zone_id, 2) AS INT) AS row_no, "
    + ", ".join(
        f"max(CASE WHEN zone_id[1] = '{c}' THEN zone_vi END) AS {c}_vi, max(CASE WHEN zone_id[1] = '{c}' THEN defect_count END) AS {c}_n, "
        f"max(CASE WHEN zone_id[1] = '{c}' THEN CASE WHEN zone_vi <= 20 THEN '#D4EFDF' WHEN zone_vi <= 40 THEN '#FCF3CF' WHEN zone_vi <= 60 THEN '#F5CBA7' WHEN zone_vi <= 80 THEN '#FADBD8' ELSE '#EBDEF0' END END) AS {c}_fill"
        for c in "ABCD"
    )
    + " FROM zone_v GROUP BY 1, 2",
)
def _(t):
    return reports.heatmap(zones(t), ["inspection_id"])


_GROWTH = "(part_no % 300) / 1e3"


def flag_inputs(t):
    fac = facades(t)
    owner = t.inspections_base.select("inspection_id", "building_id", "orientation", F.col("inspection_id").alias("facade_id"))
    return fac, zones(t).join(owner, "inspection_id"), scored(t).withColumn("growth_rate_mm_per_month", F.expr(_GROWTH)).join(owner, "inspection_id")


sql_view(
    "flag_v",
    f"""SELECT building_id, CAST(inspection_id AS VARCHAR) AS facade, '' AS zone, '' AS defect, 1 AS rule, vi_score AS value FROM facade_v WHERE vi_score > 60
        UNION ALL SELECT building_id, CAST(inspection_id AS VARCHAR), zone_id, '', 2, zone_vi FROM zone_v WHERE zone_vi > 60
        UNION ALL SELECT building_id, CAST(d.inspection_id AS VARCHAR), zone_id, defect_id, 3, width_mm FROM zoned_v d JOIN inspections_v i ON d.inspection_id = i.inspection_id
          WHERE NOT is_false_positive AND width_mm >= 5
        UNION ALL SELECT building_id, CAST(d.inspection_id AS VARCHAR), zone_id, defect_id, 4, {_GROWTH} FROM zoned_v d JOIN inspections_v i ON d.inspection_id = i.inspection_id
          WHERE NOT is_false_positive AND {_GROWTH} > 0.2""",
)


@query("r7_risk_flags", "SELECT building_id, facade, zone, defect, CAST(rule AS INT) AS rule, round(value, 4) AS value FROM flag_v")
def _(t):
    return reports.risk_flags(*flag_inputs(t)).select(
        "building_id", "sort_key.facade", "sort_key.zone", "sort_key.defect", "rule", F.round("value", 4).alias("value")
    )


@query("n4_flag_union", "SELECT CAST(rule AS INT) AS rule, count(*) AS n FROM flag_v GROUP BY 1")
def _(t):
    return reports.risk_flags(*flag_inputs(t)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k7_top_flags",
    "SELECT building_id, facade, zone, defect, CAST(rule AS INT) AS rule, CAST(place AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY facade, zone, defect, rule) AS place FROM flag_v) f WHERE place <= 4",
)
def _(t):
    return reports.top_flags(reports.risk_flags(*flag_inputs(t))).select(
        "building_id", "sort_key.facade", "sort_key.zone", "sort_key.defect", "rule", "position"
    )


@query(
    "k5_remediation_order",
    "SELECT inspection_id, severity_class, count(*) AS n, CAST(CASE severity_class WHEN 'wide' THEN 0 WHEN 'medium' THEN 1 WHEN 'fine' THEN 2 ELSE 3 END AS INT) AS rank FROM scored_v WHERE NOT is_false_positive GROUP BY 1, 2",
)
def _(t):
    from facadelake.operators.listing import remediation_order

    rows = scored(t).where("NOT is_false_positive").groupBy("inspection_id", "severity_class").agg(F.count(F.lit(1)).alias("n"))
    rank = remediation_order()[0]
    return rows.withColumn("rank", rank.cast("int")).orderBy(*remediation_order(["inspection_id"]))


def documents(t):
    facade_id = F.col("inspection_id").alias("facade_id")
    # A document holds all defects of its facade: plain columns are dealt by it, and what a defect derives is worked out after.
    rows = scored(t, dealt=True)
    cells = scoring.zone_scores(rows, t.inspections_base, ORDER, dealt=True)
    full = rows.withColumns({"vi_contribution": F.col("vi"), "confidence_score": F.col("confidence"), "facade_id": facade_id})
    fac = facades(t).withColumns({"area_m2": F.col("facade_area_cm2") / 10000.0, "vi_class": r.vi_class("vi_score", "name")})
    return reports.assemble(
        t.inspections_base.select("building_id", "org_id").distinct(), fac, cells.withColumn("facade_id", facade_id), full,
        t.inspections_base.select("building_id", facade_id),
    )


_NESTED = """SELECT i.building_id, d.inspection_id AS facade_id, i.orientation, d.zone_id, d.defect_id, d.type, round(d.length_cm, 2) AS length_cm, round(d.width_mm, 2) AS width_mm, d.severity_class, d.is_false_positive
    FROM zoned_v d JOIN inspections_v i ON d.inspection_id = i.inspection_id"""


@query(
    "n1_assemble",
    """SELECT building_id, count(DISTINCT inspection_id) AS n_facades, count(*) AS n_zones, CAST(sum(defect_count) AS BIGINT) AS n_defects, count(*) FILTER (WHERE defect_count = 0) AS n_empty FROM zone_v GROUP BY 1""",
)
def _(t):
    docs = documents(t)
    zone_sizes = F.flatten(F.transform("facades", lambda f: F.transform(f["zones"], lambda z: F.size(z["defects"]))))
    sizes = docs.select(
        "building_id",
        F.size(zone_sizes).cast("long").alias("n_zones"),
        F.aggregate(zone_sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_defects"),
        F.size(F.filter(zone_sizes, lambda n: n == 0)).cast("long").alias("n_empty"),
    )
    return sizes.groupBy("building_id").agg(F.count(F.lit(1)).alias("n_facades"), *(F.sum(c).alias(c) for c in ("n_zones", "n_defects", "n_empty")))


@query("n2_flatten", _NESTED)
def _(t):
    return reports.flatten(documents(t)).select(
        "building_id", "facade_id", "orientation", "zone_id", "defect_id", "type", "length_cm", "width_mm", "severity_class", "is_false_positive"
    )
