"""Queries of the rule tables (R*) and row predicates (F*)."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from facadelake.functions import geometry as g
from facadelake.functions import predicates as p
from facadelake.functions import rules as r
from facadelake.operators import gates, reports
from facadelake.plans import sqltext as s
from facadelake.plans.registry import query, sql_view
from facadelake.session import work_dir
from facadelake.sources import store
from facadelake.sources.tables import IMAGE_H, IMAGE_W

sql_view("scored_v", f"SELECT *, {s.SEVERITY4} AS severity_class, {s.DEFECT_VI} AS vi FROM defects_v")


@query("r1_severity4", f"SELECT {s.SEVERITY4} AS severity_class, count(*) AS n, min(width_mm) AS lo, max(width_mm) AS hi FROM defects_v GROUP BY 1")
def _(t):
    return t.defects.groupBy(r.severity4("width_mm").alias("severity_class")).agg(
        F.count(F.lit(1)).alias("n"), F.min("width_mm").alias("lo"), F.max("width_mm").alias("hi")
    )


@query("r2_severity5", f"SELECT image_id, {s.SEVERITY5} AS severity FROM names_v")
def _(t):
    return t.names.select("image_id", r.severity5("width_mm").alias("severity"))


@query("r3_defect_vi", "SELECT defect_id, severity_class, vi FROM scored_v")
def _(t):
    return t.defects.select(
        "defect_id", r.severity4("width_mm").alias("severity_class"), r.defect_vi().alias("vi")
    )


_SCORE = "(width_mm * 12.5::DOUBLE)"


@query(
    "r4_vi_class",
    f"""SELECT defect_id, 'Class ' || {s.case_bands(_SCORE, r.VI_BANDS, 1)} || ' (' || {s.case_bands(_SCORE, r.VI_BANDS, 2)} || ')' AS label,
        {s.case_bands(_SCORE, r.VI_BANDS, 1)} AS roman, lower({s.case_bands(_SCORE, r.VI_BANDS, 2)}) AS name FROM defects_v""",
)
def _(t):
    score = F.col("width_mm") * 12.5
    return t.defects.select(
        "defect_id",
        r.vi_class(score).alias("label"),
        r.vi_class(score, "roman").alias("roman"),
        r.vi_class(score, "name").alias("name"),
    )


@query(
    "r5_action_by_score",
    f"""SELECT defect_id, {s.case_bands(_SCORE, r.ACTION_BANDS, 1, '<')} AS action, {s.case_bands(_SCORE, r.ACTION_BANDS, 2, '<')} AS timeline,
        CASE WHEN {_SCORE} <= 80 THEN 15.0::DOUBLE ELSE 90.0::DOUBLE END AS text_score FROM defects_v""",
)
def _(t):
    score = F.col("width_mm") * 12.5
    act = r.action_by_score(score)
    return t.defects.select(
        "defect_id",
        act["action"].alias("action"),
        act["timeline"].alias("timeline"),
        r.score_from_text(r.vi_class(score)).alias("text_score"),
    )


@query(
    "r6_action_by_class",
    "SELECT defect_id, "
    + ", ".join(f"{s.case_bands(_SCORE, r.VI_BANDS, i)} AS {n}" for i, n in [(1, "class"), (2, "severity"), (3, "action"), (4, "timeline"), (5, "color")])
    + " FROM defects_v",
)
def _(t):
    return t.defects.select("defect_id", r.action_by_class(F.col("width_mm") * 12.5).alias("a")).select("defect_id", "a.*")


_ANGLE = "((part_no * 7 + line_no * 13) % 91)"
_SOLID = "((supp_no % 100) / 1e2)"


@query(
    "r8_crack_class",
    f"""SELECT defect_id, CASE
      WHEN width_mm < 0.25 THEN 'shrinkage_crack'
      WHEN a BETWEEN 30 AND 60 AND (bbox_x < 128 OR bbox_x + bbox_w > 384) AND width_mm > 0.5 THEN 'shear_crack'
      WHEN (a < 15 OR a > 75) AND (width_mm > 1 OR confidence > 0.85) THEN 'corrosion_crack'
      WHEN a > 70 AND bbox_y + bbox_h > 384 * 0.65 THEN 'flexural_crack'
      WHEN a BETWEEN 20 AND 70 AND bbox_y < 384 * 0.4 THEN 'settlement_crack'
      WHEN a > 80 AND bbox_h / bbox_w > 4 THEN 'compression_crack'
      WHEN solid < 0.4 THEN 'fatigue_crack'
      WHEN width_mm > 0.5 THEN 'flexural_crack' ELSE 'shrinkage_crack' END AS crack_class
    FROM (SELECT *, CASE WHEN {_ANGLE} > 45 THEN 90 - {_ANGLE} ELSE {_ANGLE} END AS a, {_SOLID} AS solid FROM boxes_v) b""",
)
def _(t):
    rows = t.boxes.withColumns({"angle_deg": F.expr(_ANGLE), "solidity": F.expr(_SOLID)})
    return rows.select("defect_id", r.crack_class(IMAGE_W, IMAGE_H).alias("crack_class"))


_RAW = "CAST((part_no * 7 + line_no * 13) % 181 - 90 AS DOUBLE)"


@query(
    "r9_crack_subtype",
    f"""SELECT defect_id, sub AS crack_subtype, round(a, 1) AS orientation_angle_deg,
      CASE sub WHEN 'corrosion_induced' THEN 2.0::DOUBLE WHEN 'shrinkage_crazing' THEN 0.8::DOUBLE WHEN 'shear' THEN 2.5::DOUBLE
               WHEN 'settlement' THEN 1.8::DOUBLE ELSE 1.0::DOUBLE END AS risk_multiplier
    FROM (SELECT *, CASE
        WHEN w / greatest(h, 1) > 8 AND (a < 10 OR a > 170) THEN 'corrosion_induced'
        WHEN per > 0 AND 4 * 3.141592653589793::DOUBLE * area / (per * per) < 0.1 AND area < 500 THEN 'shrinkage_crazing'
        WHEN a < 15 OR a > 165 THEN 'flexural'
        WHEN a BETWEEN 30 AND 60 OR a BETWEEN 120 AND 150 THEN 'shear'
        WHEN (a > 15 AND a < 30) OR (a > 150 AND a < 165) THEN 'settlement' ELSE 'unknown' END AS sub
      FROM (SELECT defect_id, CASE WHEN {_RAW} < 0 THEN {_RAW} + 180 ELSE {_RAW} END AS a,
                   area_cm2 * 1e1 AS area, length_cm * 1e1 AS per, bbox_w AS w, 1 + supp_no % 40 AS h FROM defects_v) x) y""",
)
def _(t):
    rows = t.defects.select(
        "defect_id",
        F.expr(_RAW).alias("angle_deg"),
        (F.col("area_cm2") * 10.0).alias("area_px"),
        (F.col("length_cm") * 10.0).alias("perimeter_px"),
        "bbox_w",
        (F.lit(1) + F.col("supp_no") % 40).alias("bbox_h"),
    )
    return rows.select("defect_id", r.crack_subtype().alias("s")).select("defect_id", "s.*")


@query(
    "r10_shape_class",
    """SELECT defect_id, CASE WHEN area <= 0 THEN 'stain' WHEN el >= 5 THEN 'crack'
        WHEN el BETWEEN 2 AND 4 AND so > 0.8 THEN 'construction_joint' ELSE 'spalling' END AS shape,
        round(CASE WHEN area <= 0 THEN 1e0 ELSE el END, 6) AS elongation, round(CASE WHEN area <= 0 THEN 0e0 ELSE so END, 6) AS solidity
      FROM (SELECT defect_id, area, greatest(a, b) / least(a, b) AS el, area / hull AS so
            FROM (SELECT defect_id, CASE WHEN line_no = 7 THEN 0e0 ELSE area_cm2 END AS area, 1e0 + part_no % 60 AS a, 1e0 + supp_no % 23 AS b,
                         area_cm2 * (1e0 + (supp_no % 5) / 1e1) AS hull FROM defects_v) x) y""",
)
def _(t):
    rows = t.defects.select(
        "defect_id",
        F.when(F.col("line_no") == 7, 0.0).otherwise(F.col("area_cm2")).alias("area_px"),
        (F.lit(1.0) + F.col("part_no") % 60).alias("major_px"),
        (F.lit(1.0) + F.col("supp_no") % 23).alias("minor_px"),
        (F.col("area_cm2") * (F.lit(1.0) + (F.col("supp_no") % 5) / 10.0)).alias("hull_px"),
    )
    shape = r.shape_class()
    return rows.select(
        "defect_id",
        shape["shape"].alias("shape"),
        F.round(shape["elongation"], 6).alias("elongation"),
        F.round(shape["solidity"], 6).alias("solidity"),
    )


@query(
    "r11_orientation_class",
    "SELECT image_id, CASE WHEN angle_deg >= 70 THEN 'vertical' WHEN angle_deg <= 20 THEN 'horizontal' ELSE 'diagonal' END AS orientation FROM names_v",
)
def _(t):
    return t.names.select("image_id", r.orientation_class("angle_deg").alias("orientation"))


_RULE_ROWS = [(i, w, kind, base, advice) for i, (words, kind, base, advice) in enumerate(r.KEYWORD_RULES) for w in words]
_RANK5 = "(CASE {0} WHEN 'moderate' THEN 1 WHEN 'severe' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END)"
sql_view(
    "keyword_v",
    f"""SELECT n.image_id, min_by(k.kind, k.rule_no) AS crack_type, min_by(k.base, k.rule_no) AS base, min_by(k.advice, k.rule_no) AS advice
        FROM names_v n JOIN (SELECT * FROM {s.values_table(_RULE_ROWS, 'rule_no, word, kind, base, advice')}) k
          ON contains(lower(n.filename), k.word) GROUP BY n.image_id""",
)
sql_view("measured_v", f"SELECT *, {s.SEVERITY5} AS measured FROM names_v")


@query(
    "r12_keyword_mechanism",
    f"""SELECT k.image_id, crack_type, CASE WHEN {_RANK5.format('base')} >= {_RANK5.format('measured')} THEN base ELSE measured END AS severity,
        advice AS recommendation FROM keyword_v k JOIN measured_v m ON k.image_id = m.image_id""",
)
def _(t):
    return r.keyword_mechanism(t.names).select("image_id", "crack_type", "severity", "recommendation")


sql_view(
    "member_v",
    """SELECT image_id, CASE WHEN regexp_matches(lower(filename), 'column|compression|fire-damage') THEN 'column'
         WHEN regexp_matches(lower(filename), 'beam|shear|flexural|leakage') THEN 'beam' ELSE 'slab' END AS member_type FROM names_v""",
)
_GRAVE = "(CASE WHEN measured = 'critical' THEN 'critical' ELSE 'severe' END)"
sql_view(
    "mechanism_v",
    f"""SELECT m.image_id, b.member_type, m.filename, m.width_mm,
        CASE WHEN k.crack_type IS NOT NULL THEN k.crack_type WHEN rust > 0.04 THEN 'Corrosion-Induced Splitting Crack'
          WHEN efflorescence > 0.12 THEN 'Efflorescence / Moisture Ingress'
          WHEN angle_deg > 20 AND angle_deg < 70 THEN 'Structural Shear Crack'
          WHEN angle_deg >= 70 THEN CASE WHEN member_type = 'column' THEN 'Column Compression / Splitting Crack' ELSE 'Vertical Tension Crack' END
          WHEN member_type IN ('beam', 'slab') THEN 'Flexural Tension Crack' ELSE 'Shrinkage / Map Crack' END AS crack_type,
        CASE WHEN k.crack_type IS NOT NULL THEN CASE WHEN {_RANK5.format('k.base')} >= {_RANK5.format('measured')} THEN k.base ELSE measured END
          WHEN rust > 0.04 THEN {_GRAVE} WHEN efflorescence > 0.12 THEN measured
          WHEN angle_deg > 20 AND (angle_deg < 70 OR member_type = 'column') THEN {_GRAVE} ELSE measured END AS severity
        FROM measured_v m JOIN member_v b ON m.image_id = b.image_id LEFT JOIN keyword_v k ON m.image_id = k.image_id""",
)


def with_mechanism(names):
    """Image rows with member, grid, mechanism and severity."""
    place = r.member_grid_from_name("filename")
    placed = names.withColumns({"member_type": place["member_type"], "grid_reference": place["grid_reference"]})
    return r.mechanism(placed)


@query("r13_mechanism", "SELECT image_id, crack_type, severity FROM mechanism_v")
def _(t):
    return with_mechanism(t.names).select("image_id", "crack_type", "severity")


_UNIT_W = "(CASE " + " ".join(f"WHEN contains(lower(crack_type), '{w}') THEN {v}::DOUBLE" for w, v in r.UNIT_TYPE_WEIGHTS) + " ELSE 0.3::DOUBLE END)"
_UNIT = f"round(least({_UNIT_W} * {s.case_map('severity', r.UNIT_SEVERITY, 0.5)} / 0.85::DOUBLE, 1.0::DOUBLE), 2)"


@query("r14_unit_index", f"SELECT image_id, {_UNIT} AS v_index FROM mechanism_v")
def _(t):
    return with_mechanism(t.names).select("image_id", r.unit_index("crack_type", "severity").alias("v_index"))


@query(
    "r15_member_grid",
    "SELECT image_id, member_type, CASE member_type WHEN 'column' THEN 'A2' WHEN 'beam' THEN 'C3' ELSE 'D4' END AS grid_reference FROM member_v",
)
def _(t):
    return t.names.select("image_id", r.member_grid_from_name("filename").alias("m")).select("image_id", "m.*")


_RATE = "(CASE WHEN line_no = 7 THEN NULL ELSE (part_no % 100 - 10) / 1e3 END)"


@query(
    "r16_activity",
    f"SELECT defect_id, CASE WHEN x IS NULL THEN 'unmonitored' WHEN x < 0.01 THEN 'dormant' WHEN x < 0.05 THEN 'active' ELSE 'aggressive' END AS activity FROM (SELECT defect_id, {_RATE} AS x FROM defects_v) d",
)
def _(t):
    return t.defects.select("defect_id", r.activity(F.expr(_RATE)).alias("activity"))


@query("r19_propagation", "SELECT defect_id, CASE WHEN width_mm >= 0.3 THEN 'active' ELSE 'dormant' END AS propagation_rate FROM defects_v")
def _(t):
    return t.defects.select("defect_id", r.propagation("width_mm").alias("propagation_rate"))


_KIND = """(CASE WHEN type LIKE '%shear%' THEN 'shear' WHEN type LIKE '%corrosion%' THEN 'corrosion' WHEN type LIKE '%compression%' THEN 'compression'
  WHEN width_mm < 0.2 THEN 'hairline' WHEN width_mm < 1 THEN 'fine' ELSE 'other' END)"""


@query(
    "r20_intervention",
    f"SELECT defect_id, {s.case_map(_KIND, r.INTERVENTIONS)} AS recommended_intervention, CAST({s.case_map(_KIND, r.INTERVENTION_DAYS)} AS INT) AS reinspection_days FROM defects_v",
)
def _(t):
    return t.defects.select("defect_id", r.intervention("type", "width_mm").alias("i")).select("defect_id", "i.*")


_BY_SEV = {i: s.case_map("severity_class", {k: v[i] for k, v in r.REMEDIATION_BY_SEVERITY.items() if k != "other"}, r.REMEDIATION_BY_SEVERITY["other"][i]) for i in range(3)}


@query(
    "r21_remediation",
    f"""SELECT defect_id,
      CASE WHEN type = 'spalling' THEN {s.quote(r.REMEDIATION_SPALLING)} WHEN type = 'corrosion' THEN {s.quote(r.REMEDIATION_CORROSION)}
           WHEN type <> 'crack' THEN {s.quote(r.REMEDIATION_OTHER)} ELSE {_BY_SEV[1]} END AS action,
      CASE WHEN type = 'spalling' AND severity_class IN ('wide', 'medium') THEN 'Critical' WHEN type IN ('spalling', 'corrosion') THEN 'High'
           WHEN type <> 'crack' THEN 'Low' ELSE {_BY_SEV[0]} END AS priority,
      CASE WHEN type = 'spalling' AND severity_class IN ('wide', 'medium') THEN 'Within 2 weeks.' WHEN type IN ('spalling', 'corrosion') THEN 'Within 30 days.'
           WHEN type <> 'crack' THEN 'Next maintenance cycle.' ELSE {_BY_SEV[2]} END AS timeline
    FROM scored_v""",
)
def _(t):
    return t.defects.select("defect_id", r.remediation("type", r.severity4("width_mm")).alias("x")).select("defect_id", "x.*")


@query(
    "r22_standard_bar",
    f"""SELECT defect_id, standard_mm, required_cover_mm, CASE WHEN cover >= required_cover_mm THEN 'Adequate' ELSE 'Deficient' END AS cover_status
      FROM (SELECT defect_id, cover, CAST((SELECT min_by(b, abs(x.d - b) * 1e3 + b) FROM (VALUES (8), (10), (12), (16), (20), (25), (32)) AS v(b)) AS INT) AS standard_mm,
                   CAST({s.case_map('exposure_condition', r.MIN_COVER_MM, 30)} AS INT) AS required_cover_mm
            FROM (SELECT defect_id, exposure_condition, width_mm * 5e0 AS d, length_cm + line_no * 3e0 AS cover FROM defects_v) x) y""",
)
def _(t):
    bar = r.standard_bar(F.col("width_mm") * 5.0, F.col("exposure_condition"), F.col("length_cm") + F.col("line_no") * 3.0)
    return t.defects.select("defect_id", bar.alias("b")).select("defect_id", "b.*")


_BAR = "round(nominal - least(width_mm * 1.2::DOUBLE, nominal - 4), 2)"


@query(
    "r23_section_loss",
    f"""SELECT image_id, bar AS visible_bar_diameter_mm, cover AS estimated_cover_loss_mm, round((1 - (bar * bar) / (nominal * nominal)) * 100, 1) AS capacity_reduction_pct
      FROM (SELECT image_id, nominal, {_BAR} AS bar, round(least(width_mm * 10, 40.0::DOUBLE), 2) AS cover
            FROM (SELECT *, CASE WHEN member_type = 'beam' THEN 20e0 ELSE 12e0 END AS nominal FROM mechanism_v
                  WHERE regexp_matches(crack_type, 'Corrosion|Spalling|Steel|Exposed') OR contains(lower(filename), 'stage')) a) b""",
)
def _(t):
    rows = with_mechanism(t.names).where(r.shows_corrosion("crack_type", "filename"))
    return rows.select("image_id", r.section_loss("width_mm", "member_type").alias("x")).select("image_id", "x.*")


@query(
    "r24_rebar_schedule",
    """SELECT defect_id, grid_reference, bar_diameter_mm, bar_is_estimate, cover_loss_mm, capacity_loss_pct,
         CASE WHEN cover_loss_mm > 15 THEN 'Deficient' ELSE 'Adequate' END AS cover_status
       FROM (SELECT defect_id, 'B4' AS grid_reference, coalesce(bar, 12e0) AS bar_diameter_mm, bar IS NULL AS bar_is_estimate,
                    coalesce(loss, 0e0) AS cover_loss_mm, coalesce(cap, 0e0) AS capacity_loss_pct
             FROM (SELECT defect_id, type, CASE WHEN line_no = 3 THEN 8e0 + supp_no % 5 END AS bar,
                          CASE WHEN part_no % 2 = 0 THEN (part_no % 40) * 1e0 END AS loss, CASE WHEN line_no < 4 THEN supp_no * 1e0 END AS cap FROM defects_v) a
             WHERE bar IS NOT NULL OR type LIKE '%corrosion%' OR type LIKE '%spalling%') b""",
)
def _(t):
    rows = t.defects.select(
        "defect_id",
        "type",
        F.when(F.col("line_no") == 3, F.lit(8.0) + F.col("supp_no") % 5).alias("visible_bar_diameter_mm"),
        F.when(F.col("part_no") % 2 == 0, (F.col("part_no") % 40) * 1.0).alias("estimated_cover_loss_mm"),
        F.when(F.col("line_no") < 4, F.col("supp_no") * 1.0).alias("capacity_reduction_pct"),
        F.lit(None).cast("string").alias("grid_reference"),
    )
    return reports.rebar_schedule(rows)


@query(
    "r25_crack_schedule",
    f"""SELECT defect_id, coalesce(crack_subtype, type) AS kind, round(width_mm, 2) AS width_mm, round(length_cm, 2) AS length_cm, 'N/A' AS grid_ref,
        {s.case_map('severity_class', r.SCHEDULE_INTERVENTION, 'Review')} AS intervention FROM scored_v""",
)
def _(t):
    rows = t.defects.withColumns(
        {"severity_class": r.severity4("width_mm"), "grid_ref": F.lit(None).cast("string"), "grid_reference": F.lit(None).cast("string")}
    )
    return reports.crack_schedule(rows)


@query(
    "r26_type_bucket",
    """SELECT CASE WHEN type LIKE '%crack%' THEN 'crack' WHEN type LIKE '%spall%' THEN 'spall' WHEN type LIKE '%corrosion%' THEN 'corrosion'
        WHEN type LIKE '%delamination%' THEN 'delamination' ELSE 'other' END AS bucket, count(*) AS n FROM defects_v GROUP BY 1""",
)
def _(t):
    return t.defects.groupBy(r.type_bucket("type").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "r27_trend",
    f"SELECT CASE WHEN x > 0 THEN 'up' WHEN x < 0 THEN 'down' ELSE 'none' END AS trend, count(*) AS n FROM (SELECT coalesce({_RATE}, 0) AS x FROM defects_v) d GROUP BY 1",
)
def _(t):
    return t.defects.groupBy(r.trend(F.expr(_RATE)).alias("trend")).agg(F.count(F.lit(1)).alias("n"))


_ERR = "concat(endpoint, CASE request_id % 5 WHEN 0 THEN ' S3 NoSuchKey' WHEN 1 THEN ' Timeout after 15 s' WHEN 2 THEN ' OOM killed' WHEN 3 THEN ' Connection reset' ELSE ' other' END)"


@query(
    "r28_error_message",
    f"""SELECT request_id, CASE WHEN regexp_matches(m, 's3|nosuchkey') THEN {s.quote(r.ERROR_RULES[0][1])}
        WHEN regexp_matches(m, 'timeout|connection') THEN {s.quote(r.ERROR_RULES[1][1])} WHEN regexp_matches(m, 'memory|oom') THEN {s.quote(r.ERROR_RULES[2][1])}
        ELSE {s.quote(r.ERROR_DEFAULT)} END AS message FROM (SELECT request_id, lower({_ERR}) AS m FROM requests_v) x""",
)
def _(t):
    return t.requests.select("request_id", r.error_message(F.expr(_ERR)).alias("message"))


_COVER = "CAST(10 + (part_no * 3 + supp_no) % 60 AS INT)"


@query(
    "r29_cover_warnings",
    f"""SELECT defect_id, 'COVER_DEFICIENT' AS code, 'fatal' AS severity, 'none' AS fallback,
        'COVER DEFICIENT at B4: measured ' || cover || 'mm, required ' || req || 'mm' AS message
      FROM (SELECT defect_id, {_COVER} AS cover, {s.case_map('exposure_condition', r.MIN_COVER_MM, 30)} AS req FROM defects_v
            WHERE crack_subtype = 'corrosion_induced' OR area_cm2 >= 50) x WHERE cover < req""",
)
def _(t):
    cover = F.expr(_COVER)
    rows = t.defects.where(p.needs_rebar_analysis()).withColumns({"grid_ref": F.lit("B4"), "measured_cover_mm": cover})
    bar = r.standard_bar(F.lit(12.0), F.col("exposure_condition"), F.col("measured_cover_mm"))
    return reports.cover_warnings(rows.withColumn("bar", bar).select("defect_id", "grid_ref", "measured_cover_mm", "bar.*"))


@query(
    "r30_analysis_record",
    f"""SELECT image_id, found AS defect_found,
        CASE WHEN found THEN crack_type ELSE 'No Crack Detected' END AS crack_type, CASE WHEN found THEN severity ELSE 'none' END AS severity,
        CASE WHEN found THEN {_UNIT} ELSE 0e0 END AS v_index,
        CASE WHEN found THEN replace(lower(crack_type), ' ', '_') ELSE 'none' END AS crack_subtype,
        CASE WHEN NOT found THEN 'none' WHEN width_mm >= 0.3 THEN 'active' ELSE 'dormant' END AS propagation_rate,
        CASE WHEN found THEN CASE WHEN sized THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END ELSE CASE WHEN sized THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END END AS analysis_confidence,
        CAST(CASE WHEN NOT found THEN 365 WHEN severity = 'critical' THEN 30 WHEN severity = 'severe' THEN 90 WHEN severity = 'moderate' THEN 180 ELSE 365 END AS INT) AS reinspection_days
      FROM (SELECT *, width_mm >= 0.05 AS found, image_id % 2 = 0 AS sized FROM mechanism_v) m""",
)
def _(t):
    rows = with_mechanism(t.names).withColumns(
        {
            "detected_count": F.when(F.col("width_mm") >= 0.05, 1).otherwise(0),
            "real_width_m": F.when(F.col("image_id") % 2 == 0, 3.0),
            "real_height_m": F.when(F.col("image_id") % 2 == 0, 2.0),
        }
    )
    return reports.analysis_record(rows).select(
        "image_id", "defect_found", "crack_type", "severity", "v_index", "crack_subtype", "propagation_rate", "analysis_confidence", "reinspection_days"
    )


@query(
    "r31_crack_reference",
    f"""SELECT d.defect_id, c.label, c.clause, c.risk, CAST(c.days AS INT) AS reinspect_days, d.angle BETWEEN c.lo AND c.hi AS angle_in_range
      FROM (SELECT defect_id, {_ANGLE} AS angle, CASE part_no % 9 WHEN 0 THEN 'shear' WHEN 1 THEN 'flexural' WHEN 2 THEN 'corrosion' WHEN 3 THEN 'settlement'
              WHEN 4 THEN 'compression' WHEN 5 THEN 'shrinkage' WHEN 6 THEN 'hairline' WHEN 7 THEN 'none' ELSE 'odd' END AS k FROM defects_v) d
      LEFT JOIN {s.values_table(r.CRACK_REFERENCE, 'crack_key, label, clause, risk, cause, failure, intervention, days, lo, hi')} c ON d.k = c.crack_key""".replace(") AS t(", ") AS c("). replace(") c ON", ") ON"),
)
def _(t):
    key = F.expr(
        "CASE part_no % 9 WHEN 0 THEN 'shear' WHEN 1 THEN 'flexural' WHEN 2 THEN 'corrosion' WHEN 3 THEN 'settlement' "
        "WHEN 4 THEN 'compression' WHEN 5 THEN 'shrinkage' WHEN 6 THEN 'hairline' WHEN 7 THEN 'none' ELSE 'odd' END"
    )
    rows = t.defects.select("defect_id", F.expr(_ANGLE).alias("angle"), key.alias("k"))
    return r.with_crack_reference(rows, "k", "angle").select("defect_id", "label", "clause", "risk", "reinspect_days", "angle_in_range")


# --- predicates ----------------------------------------------------------------------------------


@query(
    "f1_quality_gate",
    """SELECT frame_id, coalesce(laplacian_variance < 100, false) AS is_blurry, coalesce(mean_intensity < 30, false) AS is_underexposed,
        NOT (coalesce(laplacian_variance < 100, false) OR coalesce(mean_intensity < 30, false)) AS quality_passed,
        concat_ws('; ', CASE WHEN laplacian_variance < 100 THEN 'Blurry: Laplacian variance ' || printf('%.1f', laplacian_variance) || ' < 100' END,
                        CASE WHEN mean_intensity < 30 THEN 'Underexposed: mean intensity ' || printf('%.1f', mean_intensity) || ' < 30' END) AS warnings
      FROM (SELECT frame_id, floor(laplacian_variance) + 0.3 AS laplacian_variance, mean_intensity FROM frames_v) f""",
)
def _(t):
    # Whole numbers and three tenths: a printed digit that never is a rounding tie.
    frames = t.frames.select("frame_id", (F.floor("laplacian_variance") + F.lit(0.3)).cast("double").alias("laplacian_variance"), "mean_intensity")
    out = gates.quality_gate(frames)
    return out.select("frame_id", "is_blurry", "is_underexposed", "quality_passed", F.array_join("warnings", "; ").alias("warnings"))


@query(
    "f2_missing_fields",
    """SELECT frame_id, CAST(nogps AS INT) + CAST(nofocal AS INT) + CAST(noalt AS INT) + CAST(nogps AND noalt AS INT) AS n_warnings,
        concat_ws('|', CASE WHEN nogps THEN 'Missing GPS coordinates' END, CASE WHEN nofocal THEN 'Missing focal length' END,
                  CASE WHEN noalt THEN 'Missing altitude data' END, CASE WHEN nogps AND noalt THEN 'CRITICAL' END) AS warnings
      FROM (SELECT frame_id, gps_latitude IS NULL OR gps_longitude IS NULL AS nogps, focal_length_mm IS NULL AS nofocal,
                   relative_altitude IS NULL AND frame_id % 2 = 0 AS noalt FROM frames_v) f""",
)
def _(t):
    frames = t.frames.withColumn("gps_altitude", F.when(F.col("frame_id") % 2 == 1, F.col("gps_altitude")))
    rows = frames.select("frame_id", gates.missing_field_warnings().alias("w"))
    short = F.transform("w", lambda x: F.when(x.startswith("CRITICAL"), "CRITICAL").otherwise(x))
    return rows.select("frame_id", F.size("w").alias("n_warnings"), F.array_join(short, "|").alias("warnings"))


@query(
    "f3_clean_frames",
    "SELECT flight_id, count(*) AS passed FROM frames_v WHERE laplacian_variance >= 12 AND mean_intensity >= 25 GROUP BY 1",
)
def _(t):
    gated = gates.quality_gate(t.frames, lap_min=12.0, mean_min=25.0)
    return gates.clean_frames(gated).groupBy("flight_id").agg(F.count(F.lit(1)).alias("passed"))


@query("f4_confident", "SELECT defect_id FROM defects_v WHERE CASE WHEN line_no = 7 THEN 0 ELSE confidence END >= 0.5")
def _(t):
    rows = t.defects.withColumn("confidence", F.when(F.col("line_no") != 7, F.col("confidence")))
    return rows.where(p.confident(0.5)).select("defect_id")


@query("f5_tenant", "SELECT inspection_id, building_id FROM inspections_v WHERE org_id = 7")
def _(t):
    return p.for_org(t.inspections_base, 7).select("inspection_id", "building_id")


@query("f6_not_deleted", "SELECT count(*) AS n, min(inspection_id) AS lo, max(inspection_id) AS hi FROM inspections_v WHERE inspection_id % 5 <> 0")
def _(t):
    rows = t.inspections_base.withColumn("deleted_at", F.when(F.col("inspection_id") % 5 == 0, F.col("inspection_date")))
    return rows.where(p.not_deleted()).agg(
        F.count(F.lit(1)).alias("n"), F.min("inspection_id").alias("lo"), F.max("inspection_id").alias("hi")
    )


@query("f7_defect_filters", "SELECT defect_id FROM defects_v WHERE type = 'crack' AND severity_b = 'severe' AND supp_no % 3 = 0")
def _(t):
    rows = t.defects.withColumn("matched_previous_id", F.when(F.col("supp_no") % 3 == 0, F.col("defect_id")))
    return rows.where(p.defect_predicate("crack", "severe", True, severity_col="severity_b")).select("defect_id")


@query("f8_type_contains", "SELECT type, count(*) AS n FROM defects_v WHERE contains(lower(type), 'crack') GROUP BY 1")
def _(t):
    return t.defects.where(p.type_contains("CRACK")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("f9_propagated", "SELECT defect_id FROM defects_v WHERE line_no = 2 OR (line_no <> 7 AND part_no % 100 > 10)")
def _(t):
    rows = t.defects.select(
        "defect_id",
        F.when(F.col("line_no") == 2, "propagated").alias("temporal_status"),
        F.expr(_RATE).alias("growth_rate_mm_per_month"),
    )
    return rows.where(p.is_propagated()).select("defect_id")


@query("f10_active", "SELECT inspection_id, count(*) AS active FROM defects_v WHERE line_no = 1 OR NOT is_false_positive GROUP BY 1")
def _(t):
    rows = t.defects.withColumn("is_false_positive", F.when(F.col("line_no") != 1, F.col("is_false_positive")))
    return rows.where(p.is_active()).groupBy("inspection_id").agg(F.count(F.lit(1)).alias("active"))


@query("f11_retention", "SELECT count(*) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE gone) AS purged FROM (SELECT ts < TIMESTAMP '2024-01-15 00:00:00' AS gone FROM requests_v) r")
def _(t):
    """The table written without its expired rows, which are counted in the same pass."""
    now = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    seen, path = Observation("retention"), work_dir(t.spark, "retention")
    store.purge_expired(t.requests.withColumn("expires_at", F.col("ts").cast("timestamp")), now, seen).write.parquet(path)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept")).withColumn("purged", F.lit(seen.get["purged"]).cast("long"))


@query("f12_rebar_trigger", "SELECT defect_id FROM defects_v WHERE crack_subtype = 'corrosion_induced' OR area_cm2 >= 50")
def _(t):
    return t.defects.where(p.needs_rebar_analysis()).select("defect_id")


@query(
    "f13_schema_defects",
    """SELECT defect_id, type, round(length_cm, 3) AS length_cm, round(width_mm, 3) AS width_mm, round(area_cm2 / 7, 3) AS area_cm2, severity_class,
        round(vi * 0.123456789::DOUBLE, 4) AS vi_contribution, round(confidence, 4) AS confidence_score, is_false_positive, round(fp_prob, 4) AS fp_confidence,
        CAST(centroid_x AS INT) AS x, CAST(centroid_y AS INT) AS y, 22.31::DOUBLE AS lat, 87.31::DOUBLE AS lon,
        CASE WHEN type = 'spalling' THEN round(area_cm2 / 7e4, 5) END AS delamination_area_m2 FROM scored_v""",
)
def _(t):
    rows = t.defects.withColumns(
        {
            "severity_class": r.severity4("width_mm"),
            "area_cm2": F.col("area_cm2") / 7.0,
            "vi_contribution": r.defect_vi() * 0.123456789,
            "confidence_score": F.col("confidence"),
            "fp_confidence": F.col("fp_prob"),
            "delamination_area_m2": g.delamination_m2("type", F.col("area_cm2") / 7.0),
        }
    )
    out = reports.schema_defects(rows)
    return out.select(
        "defect_id", "type", "length_cm", "width_mm", "area_cm2", "severity_class", "vi_contribution", "confidence_score", "is_false_positive",
        "fp_confidence", "centroid_px.x", "centroid_px.y", "centroid_gps.lat", "centroid_gps.lon", "delamination_area_m2",
    )


@query(
    "f14_normalize_gps",
    """SELECT frame_id, round(coalesce(gps_latitude, 0), 6) AS lat, round(coalesce(CASE WHEN frame_id % 2 = 0 THEN gps_longitude END, gps_longitude + 1, 0), 6) AS lon FROM frames_v""",
)
def _(t):
    none = F.lit(None).cast("double")
    even = F.col("frame_id") % 2 == 0
    gps = F.struct(
        none.alias("lat"), F.when(even, F.col("gps_longitude")).alias("lon"),
        F.col("gps_latitude").alias("latitude"), (F.col("gps_longitude") + 1.0).alias("longitude"),
    )
    return t.frames.select("frame_id", g.normalize_gps(gps).alias("x")).select("frame_id", "x.*")


_METHODS = ["geometry", " TRIG ", "computer_vision", "cv", "yolo", "coin_flip", "unheard", "segmentation", "trigonometry", "Estimate", "cv_segmentation"]
_METHOD = "(CASE request_id % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_METHODS)) + " END)"


@query(
    "f15_method_alias",
    f"""SELECT m AS method, count(*) AS n FROM (SELECT CASE WHEN x IN ('cv', 'computer_vision', 'cv_segmentation', 'segmentation', 'yolo') THEN 'cv' ELSE 'trigonometry' END AS m
        FROM (SELECT lower(trim({_METHOD})) AS x FROM requests_v) a) b GROUP BY 1""",
)
def _(t):
    return t.requests.groupBy(p.normalize_method(F.expr(_METHOD)).alias("method")).agg(F.count(F.lit(1)).alias("n"))
