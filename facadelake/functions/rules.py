"""Engineering rule tables as Column builders: one projection each, no join and no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .geometry import col, lit_or_col, literal_table, lookup

# --- fixed values: scoring tables -------------------------------------------------------------

DEFECT_WEIGHTS = {
    "crack": 1.0,
    "spalling": 0.8,
    "corrosion": 0.6,
    "water_seepage": 0.5,
    "efflorescence": 0.3,
    "plaster_detachment": 0.7,
    "structural_displacement": 1.0,
    "stain": 0.1,
}
SEVERITY_MULTIPLIERS = {"hairline": 0.3, "fine": 0.5, "medium": 0.8, "wide": 1.0}
MEMBER_WEIGHTS = {
    "column": 3.0,
    "beam": 2.0,
    "slab": 1.5,
    "wall_structural": 1.2,
    "wall_partition": 0.5,
    "unknown": 1.0,
}
SUBTYPE_WEIGHTS = {
    "shear": 2.5,
    "corrosion_induced": 2.0,
    "settlement": 1.8,
    "flexural": 1.0,
    "shrinkage_crazing": 0.8,
    "unknown": 1.0,
}
SEVERITY_WEIGHTS_3 = {"hairline": 1.0, "moderate": 3.0, "severe": 7.0}
STANDARD_BARS_MM = [8, 10, 12, 16, 20, 25, 32]
MIN_COVER_MM = {"mild": 20, "moderate": 30, "severe": 45, "very_severe": 50, "extreme": 75}
SEVERITY_RANK_5 = {"minor": 0, "hairline": 0, "moderate": 1, "severe": 2, "critical": 3}
UNIT_TYPE_WEIGHTS = [
    ("shear", 0.85),
    ("structural", 0.75),
    ("compression", 0.7),
    ("flexural", 0.45),
    ("corrosion", 0.7),
    ("spalling", 0.6),
    ("seepage", 0.4),
    ("efflorescence", 0.2),
    ("shrinkage", 0.12),
    ("void", 0.1),
    ("joint", 0.3),
]
UNIT_SEVERITY = {"hairline": 0.3, "minor": 0.4, "moderate": 0.6, "severe": 0.85, "critical": 1.0}

# Condition bands (upper bound, Roman, name, action, timeline, colour).
VI_BANDS = [
    (20.0, "I", "Minor", "Monitor at next scheduled inspection", "—", "#2ECC71"),
    (40.0, "II", "Moderate", "Plan maintenance", "Within 6 months", "#F1C40F"),
    (60.0, "III", "Significant", "Prioritise repair", "Within 3 months", "#E67E22"),
    (80.0, "IV", "Severe", "Immediate engineer assessment required", "Within 2 weeks", "#E74C3C"),
    (None, "V", "Critical", "Halt occupancy; emergency structural review", "Immediate", "#9B59B6"),
]
ACTION_BANDS = [
    (30.0, "Monitor at next cycle", "Next cycle"),
    (60.0, "Detailed investigation", "Within 90 days"),
    (80.0, "Repair and remediation", "Within 30 days"),
    (None, "Emergency site visit by structural engineer", "Within 72 hours"),
]

# Keyword rules (keywords, mechanism, base severity, advice); the first match wins.
KEYWORD_RULES = [
    (["sealan-seepage", "sealan"], "Sealant Seepage (Water Ingress)", "moderate",
     "Rake out old sealant, clean joint faces, inject hydrophobic polyurethane grout, and re-seal with polyurethane sealant."),
    (["leakage"], "Active Liquid Leakage", "moderate",
     "Inject hydrophobic polyurethane water-stop grout under pressure. Verify external drainage/waterproofing layer."),
    (["efflorescence", "effloresense", "salt"], "Efflorescence Salt Deposition", "minor",
     "Wire-brush and mild acid wash. Seal with a penetrating silane/siloxane water repellent coating."),
    (["shrinkage", "nonstructural", "non-structural"], "Non-Structural Shrinkage Crack", "minor",
     "Apply surface-penetrating crack sealant and an elastomeric acrylic facade coating. Re-inspect next cycle."),
    (["joint"], "Expansion/Construction Joint Crack", "moderate",
     "Clean degraded joint, insert closed-cell backer rod, and seal with high-performance polyurethane joint sealant."),
    (["plaster"], "Facade Plaster Spalling", "moderate",
     "Remove loose plaster, apply polymer-modified bonding agent, and patch with structural facade repair mortar."),
    (["settlement", "compression-settlement"], "Masonry Settlement Crack", "severe",
     "Geotechnical foundation assessment required. Underpin if movement continues; stitch with stainless steel bars."),
    (["fire-damage", "blistered", "fire"], "Fire Damage Concrete Blistering", "critical",
     "Core test + rebound hammer NDT. Chip degraded concrete, add reinforcing mesh, and spray shotcrete."),
    (["waterproofing", "protective coating"], "Waterproofing Coating Degradation", "moderate",
     "Pressure-wash, repair substrate voids, and re-apply multi-layer elastomeric waterproofing membrane."),
    (["voids", "bughole"], "Surface Concrete Bugholes/Voids", "minor",
     "Wire-brush and fill voids with a cementitious fairing coat prior to painting."),
    (["stage 4"], "Stage 4 Severe Corrosion Spalling & Seepage", "critical",
     "EMERGENCY: shore the member. Encase in RC jacketing or apply structural CFRP laminates to restore capacity."),
    (["stage 3"], "Stage 3 Corrosion Spalling (Exposed Rebar)", "critical",
     "Cut out spalled concrete, sandblast bars, add auxiliary reinforcement if section loss >15%, patch with structural mortar."),
    (["stage 2"], "Stage 2 Corrosion Splitting Crack", "severe",
     "Expose corroded rebar, remove scale, prime, and patch with high-strength structural repair mortar."),
    (["stage 1"], "Stage 1 Corrosion Crack", "moderate",
     "Expose rebar locally, clean rust, apply zinc-rich primer, and seal with polymer-modified cementitious mortar."),
    (["shear"], "Structural Shear Crack", "severe",
     "Diagonal shear cracking. Shore immediately, pressure-inject structural epoxy, and consider CFRP wrapping."),
]

# Advice of the mechanisms that are read from colour or geometry.
MECHANISM_ADVICE = {
    "Corrosion-Induced Splitting Crack": "Active rebar corrosion. Chisel cover, clean steel to bright metal, apply zinc-rich primer, patch with polymer mortar.",
    "Efflorescence / Moisture Ingress": "Salt leaching indicates moisture migration. Identify water source, dry the substrate, and apply a breathable water-repellent sealer.",
    "Structural Shear Crack": "Diagonal (shear) cracking. Monitor with tell-tale gauges, pressure-inject structural epoxy, and evaluate CFRP shear strengthening.",
    "Column Compression / Splitting Crack": "Vertical cracking on a column suggests overload/splitting. Verify axial capacity; confine with RC/steel jacketing or CFRP wrap.",
    "Vertical Tension Crack": "Vertical tension crack. Seal with low-viscosity epoxy and monitor for width growth across inspection cycles.",
    "Flexural Tension Crack": "Flexural cracking under bending. Install tell-tale gauges, seal with elastomeric sealant, and review live-load demand.",
    "Shrinkage / Map Crack": "Fine shrinkage/thermal cracking. Clean surface and apply a penetrating silane sealer; re-inspect next cycle.",
}

# Crack reference (key, label, clause, risk, cause, failure mode, intervention, days, angle low, angle high).
CRACK_REFERENCE = [
    ("shear", "Shear Crack", "IS 456:2000 Cl.40.4", "CRITICAL",
     "Shear stress exceeding diagonal tensile capacity near supports. Transverse reinforcement insufficient.",
     "Sudden brittle failure — no warning. Column or beam splits diagonally.",
     "IMMEDIATE: Install shoring props. Pressure-inject structural epoxy (viscosity ≤ 50 cP). Wrap member with CFRP U-strips at 150mm c/c. Reassess load path.",
     7, 30.0, 60.0),
    ("flexural", "Flexural Crack", "IS 456:2000 Cl.43.1", "SEVERE",
     "Bending moment exceeding cracking moment. Tensile stress at bottom fibre exceeds fct.",
     "Progressive — crack opens at bottom, propagates upward. Compression zone reduces. Eventual crushing.",
     "Detailed load assessment required. Inject low-viscosity epoxy. Add flexural steel if under-reinforced. Monitor neutral axis depth.",
     30, 85.0, 95.0),
    ("corrosion", "Corrosion-Induced Crack", "IS 456:2000 Cl.8.2.8", "SEVERE",
     "Rebar oxidation causing 2–4× volume expansion of iron oxide. Splitting tensile stress in cover concrete.",
     "Cover spalls off. Bar section loss. Bond failure. Progressive collapse of cover zone.",
     "Remove all delaminated cover. Treat rebar (NACE SP0169). Apply polymer-modified repair mortar. Increase cover ≥ 50mm. Apply anti-carbonation coating.",
     14, 0.0, 10.0),
    ("settlement", "Settlement Crack", "IS 1904:1986 Cl.5", "SEVERE",
     "Differential foundation settlement. Stress concentration at re-entrant corners of openings.",
     "Crack widens over time as settlement continues. Opening distortion. Masonry tie failure.",
     "Stop at source — investigate and stabilise foundation. Soil investigation (SPT/DCPT). Underpinning if required. Then seal cracks with flexible sealant.",
     14, 30.0, 50.0),
    ("compression", "Compression Crack", "IS 456:2000 Cl.39.3", "CRITICAL",
     "Axial load exceeding 0.4 fck·Ac + 0.67 fy·Asc. Lateral confinement inadequate. Column crushing imminent.",
     "Explosive brittle failure. No ductility. Column loses load-carrying capacity completely.",
     "EVACUATE IMMEDIATELY if active. Install steel angles + welded plate jacketing. Add RCC or steel jacket for confinement. Reassess entire structural load path.",
     1, 80.0, 100.0),
    ("shrinkage", "Shrinkage / Map Crack", "IS 456:2000 Cl.13.5", "MINOR",
     "Plastic shrinkage during curing. Rapid moisture loss. High cement content, low w/c ratio.",
     "Cosmetic only if shallow. Risk of water ingress leading to rebar corrosion over time.",
     "Clean and wash surface. Apply cementitious slurry coat or crystalline waterproofing. Monitor for depth progression.",
     365, 0.0, 180.0),
    ("hairline", "Hairline Crack", "IS 456:2000 Table 20", "HAIRLINE",
     "Early shrinkage, thermal movement, or very minor flexural stress. Within acceptable limits per code.",
     "No structural risk at current width. Monitor for progression.",
     "Gravity-feed low-viscosity epoxy. Surface seal with epoxy paint. Photograph and log for temporal comparison.",
     180, 0.0, 180.0),
    ("none", "No Selection", "Compliant", "CLEARED",
     "No active defect selected. Choose a pre-defined crack scenario from the quick select options or upload a UAV frame for real-time analysis.",
     "No structural failure mode active.",
     "System is idle. Awaiting concrete facade image ingestion or crack scenario selection.",
     0, 0.0, 0.0),
]

# User-facing error texts by keyword.
ERROR_RULES = [
    ("s3|nosuchkey", "Image file not found in storage. Please re-upload."),
    ("timeout|connection", "External detection service unavailable. Please retry."),
    ("memory|oom", "Image too large to process. Use a smaller image."),
]
ERROR_DEFAULT = "An unexpected error occurred. The team has been notified."

# Intervention texts by kind.
INTERVENTIONS = {
    "shear": "Structural CFRP wrapping and high-pressure epoxy resin injection",
    "corrosion": "Expose bar, mechanical rust removal, zinc-rich coating, polymer-modified repair mortar",
    "compression": "Emergency temporary support props and concrete column steel plate jacketing",
    "hairline": "Surface treatment with silane-siloxane penetrating hydrophobic sealer",
    "fine": "V-groove routing and sealing with elastomeric polyurethane compound",
    "other": "Stitching using helical stainless steel bars embedded in non-shrink grout",
}
INTERVENTION_DAYS = {"shear": 30, "corrosion": 90, "compression": 30, "hairline": 365, "fine": 180, "other": 90}

# Remediation plan (priority, action, timeline) by severity, then overrides by type.
REMEDIATION_BY_SEVERITY = {
    "wide": ("Critical", "Structural pressure grouting with low-viscosity epoxy resins. Core drill validation.", "Within 2 weeks."),
    "medium": ("High", "Polyurethane injection resin seal. Grind crack lips and seal with epoxy mortar.", "Within 60 days."),
    "fine": ("Medium", "Surface crack sealer and flexible elastomeric protective coating. Monitor annually.", "Within 3 months."),
    "other": ("Low", "Surface crack sealer. Monitor at next scheduled inspection.", "Within 6 months."),
}
REMEDIATION_SPALLING = "Hacksaw boundaries, remove loose concrete, clean rebar, coat with anti-rust, re-profile mortar."
REMEDIATION_CORROSION = "Chisel concrete, brush clean rebar, apply zinc-rich protective primer, polymer concrete patch."
REMEDIATION_OTHER = "Clean surface deposits using mild washing agents. Seal facade with water-repellant silane sealer."
SCHEDULE_INTERVENTION = {
    "hairline": "Surface Sealer",
    "fine": "V-Groove Routing",
    "medium": "Epoxy Injection",
    "wide": "Structural Jacketing",
}


def bands(value: Column, table: list[tuple], pick: int, strict: bool = False) -> Column:
    """Ordered bands: the first whose upper bound holds the value; the last has no bound."""
    out = None
    for row in table:
        if row[0] is None:
            return out.otherwise(F.lit(row[pick]))
        test = value < row[0] if strict else value <= row[0]
        out = F.when(test, row[pick]) if out is None else out.when(test, row[pick])
    return out


# --- severity and score -------------------------------------------------------------------------


def severity4(width) -> Column:
    table = [(0.2, "hairline"), (1.0, "fine"), (5.0, "medium"), (None, "wide")]
    return bands(F.coalesce(col(width), F.lit(0.0)), table, 1, strict=True)


def severity5(width) -> Column:
    table = [(0.10, "hairline"), (0.30, "minor"), (1.00, "moderate"), (2.00, "severe"), (None, "critical")]
    return bands(col(width), table, 1, strict=True)


def defect_vi(
    type="type", width="width_mm", area="area_cm2", member="member_type", subtype="crack_subtype",
    exposure="exposure_condition", severity=None, crack_type=None, exposure_default: str = "normal",
) -> Column:
    """Contribution of one defect. Member criticality enters twice: by substring and by exact name."""
    kind = F.coalesce(col(type), F.lit("crack"))
    band = severity4(width)
    if severity is not None:
        band = F.coalesce(F.nullif(col(severity), F.lit("")), band)
    label = F.lower(F.coalesce(col(crack_type), kind) if crack_type is not None else kind)
    place = F.lower(F.coalesce(col(member), F.lit("slab")))
    weather = F.lower(F.coalesce(col(exposure), F.lit(exposure_default)))
    type_risk = (
        F.when(label.contains("shear"), 2.5)
        .when(label.contains("corrosion"), 2.0)
        .when(label.contains("compression"), 3.0)
        .otherwise(1.0)
    )
    member_risk = (
        F.when(place.contains("column"), 3.0)
        .when(place.contains("beam"), 2.0)
        .when(place.contains("slab"), 1.0)
        .when(place.contains("wall"), 0.5)
        .otherwise(1.0)
    )
    weather_risk = F.when(weather.isin("extreme", "coastal", "severe"), 1.5).otherwise(1.0)
    base = (
        lookup(DEFECT_WEIGHTS, kind, 0.5)
        * lookup(SEVERITY_MULTIPLIERS, band, 0.5)
        * F.coalesce(col(area), F.lit(0.0))
        * type_risk
        * member_risk
        * weather_risk
    )
    return base * lookup(MEMBER_WEIGHTS, col(member), 1.0) * lookup(SUBTYPE_WEIGHTS, col(subtype), 1.0)


def vi_class(score, style: str = "label") -> Column:
    """``label`` = Class II (Moderate), ``roman`` = II, ``name`` = moderate."""
    score = col(score)
    if style == "roman":
        return bands(score, VI_BANDS, 1)
    if style == "name":
        return F.lower(bands(score, VI_BANDS, 2))
    return F.concat(F.lit("Class "), bands(score, VI_BANDS, 1), F.lit(" ("), bands(score, VI_BANDS, 2), F.lit(")"))


def band_colour(score) -> Column:
    return bands(col(score), VI_BANDS, 5)


def action_by_score(score) -> Column:
    score = col(score)
    return F.struct(
        bands(score, ACTION_BANDS, 1, strict=True).alias("action"),
        bands(score, ACTION_BANDS, 2, strict=True).alias("timeline"),
    )


def score_from_text(text) -> Column:
    """Score read from a class text. Digits win; any text holding CLASS I, so also II to IV, is 15."""
    digits = F.regexp_extract(col(text), r"(\d+\.?\d*)", 1)
    return F.when(digits != "", F.try_to_number(digits, F.lit("999999999.999999")).cast("double")).otherwise(
        F.when(F.upper(col(text)).contains("CLASS I"), 15.0).otherwise(90.0)
    )


def action_by_class(score) -> Column:
    score = col(score)
    return F.struct(
        bands(score, VI_BANDS, 1).alias("class"),
        bands(score, VI_BANDS, 2).alias("severity"),
        bands(score, VI_BANDS, 3).alias("action"),
        bands(score, VI_BANDS, 4).alias("timeline"),
        bands(score, VI_BANDS, 5).alias("color"),
    )


def mean_severity_class(score) -> Column:
    table = [(1.5, "minor"), (3.0, "moderate"), (5.5, "severe"), (None, "critical")]
    return bands(col(score), table, 1, strict=True)


def severity_weight(severity) -> Column:
    return lookup(SEVERITY_WEIGHTS_3, col(severity), 1.0)


# --- geometry classifiers ---------------------------------------------------------------------------


def crack_class(img_w, img_h, angle="angle_deg", width="width_mm", conf="confidence", solidity="solidity",
                x="bbox_x", y="bbox_y", w="bbox_w", h="bbox_h") -> Column:
    """Seven crack classes, first match wins. The angle is folded to 0..45 first, so the rules that ask
    for more than 45 degrees never fire; their order is kept all the same."""
    img_w, img_h = lit_or_col(img_w).cast("double"), lit_or_col(img_h).cast("double")
    a = F.abs(col(angle))
    a = F.when(a > 45, F.lit(90.0) - a).otherwise(a)
    wd, x, y, w, h = col(width), col(x), col(y), col(w), col(h)
    near_support = (x < img_w * 0.25) | (x + w > img_w * 0.75)
    return (
        F.when(wd < 0.25, "shrinkage_crack")
        .when(a.between(30, 60) & near_support & (wd > 0.5), "shear_crack")
        .when(((a < 15) | (a > 75)) & ((wd > 1.0) | (col(conf) > 0.85)), "corrosion_crack")
        .when((a > 70) & (y + h > img_h * 0.65), "flexural_crack")
        .when(a.between(20, 70) & (y < img_h * 0.4), "settlement_crack")
        .when((a > 80) & (h / F.greatest(w.cast("double"), F.lit(1e-6)) > 4.0), "compression_crack")
        .when(col(solidity) < 0.4, "fatigue_crack")
        .when(wd > 0.5, "flexural_crack")
        .otherwise("shrinkage_crack")
    )


def crack_subtype(angle="angle_deg", area="area_px", perimeter="perimeter_px", w="bbox_w", h="bbox_h") -> Column:
    raw = col(angle)
    a = F.when(raw < 0, raw + 180.0).otherwise(raw)
    compact = F.try_divide(col(area) * (4.0 * 3.141592653589793), col(perimeter) * col(perimeter))
    crazing = (col(perimeter) > 0) & (compact < 0.1) & (col(area) < 500)
    aspect = col(w).cast("double") / F.greatest(col(h), F.lit(1))
    corroded = (aspect > 8) & ((a < 10) | (a > 170))
    flat = (a < 15) | (a > 165)
    diagonal = a.between(30, 60) | a.between(120, 150)
    slanted = ((a > 15) & (a < 30)) | ((a > 150) & (a < 165))

    def pick(corrosion, craze, flexural, shear, settlement, unknown):
        return (
            F.when(F.coalesce(corroded, F.lit(False)), corrosion)
            .when(F.coalesce(crazing, F.lit(False)), craze)
            .when(flat, flexural)
            .when(diagonal, shear)
            .when(slanted, settlement)
            .otherwise(unknown)
        )

    return F.struct(
        pick("corrosion_induced", "shrinkage_crazing", "flexural", "shear", "settlement", "unknown").alias("crack_subtype"),
        F.round(a, 1).alias("orientation_angle_deg"),
        pick(2.0, 0.8, 1.0, 2.5, 1.8, 1.0).alias("risk_multiplier"),
    )


def shape_class(area="area_px", major="major_px", minor="minor_px", hull="hull_px") -> Column:
    longest, shortest = F.greatest(col(major), col(minor)), F.least(col(major), col(minor))
    elongation = F.when(shortest > 0, longest / F.nullif(shortest, F.lit(0.0))).otherwise(1.0)
    solidity = F.when(col(hull) > 0, col(area) / F.nullif(col(hull), F.lit(0.0))).otherwise(0.0)
    flat = col(area) <= 0
    kind = (
        F.when(elongation >= 5.0, "crack")
        .when(elongation.between(2.0, 4.0) & (solidity > 0.8), "construction_joint")
        .otherwise("spalling")
    )
    return F.struct(
        F.when(flat, "stain").otherwise(kind).alias("shape"),
        F.when(flat, 1.0).otherwise(elongation).alias("elongation"),
        F.when(flat, 0.0).otherwise(solidity).alias("solidity"),
    )


def orientation_class(angle) -> Column:
    a = col(angle)
    return F.when(a >= 70.0, "vertical").when(a <= 20.0, "horizontal").otherwise("diagonal")


# --- mechanism of one image ----------------------------------------------------------------------------


def _any_keyword(name: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(w) for w in words])


# All mechanisms in order of precedence: the keyword rules, then those read from colour and geometry.
# A base of None takes the measured severity as it is.
MECHANISMS = [(kind, base, advice) for _, kind, base, advice in KEYWORD_RULES] + [
    (kind, base, MECHANISM_ADVICE[kind])
    for kind, base in [
        ("Corrosion-Induced Splitting Crack", "severe"),
        ("Efflorescence / Moisture Ingress", None),
        ("Structural Shear Crack", "severe"),
        ("Column Compression / Splitting Crack", "severe"),
        ("Vertical Tension Crack", None),
        ("Flexural Tension Crack", None),
        ("Shrinkage / Map Crack", None),
    ]
]


def keyword_rule(name) -> Column:
    """Number of the first keyword rule a name meets, or null. The list is fixed and short, so it is a
    literal array searched inside the scan stage, not a rule join."""
    lowered = F.lower(col(name))
    entries = F.array(
        *[F.struct(F.lit(i).alias("rule"), F.lit(w).alias("word")) for i, (words, *_) in enumerate(KEYWORD_RULES) for w in words]
    )
    return F.get(F.filter(entries, lambda e: lowered.contains(e["word"])), 0)["rule"]


def sight_rule(angle, member, rust, efflorescence) -> Column:
    """Number of the mechanism read from colour shares, orientation and member."""
    first = len(KEYWORD_RULES)
    pattern = orientation_class(angle)
    return (
        F.when(F.coalesce(col(rust), F.lit(0.0)) > 0.04, first)
        .when(F.coalesce(col(efflorescence), F.lit(0.0)) > 0.12, first + 1)
        .when(pattern == "diagonal", first + 2)
        .when((pattern == "vertical") & (col(member) == "column"), first + 3)
        .when(pattern == "vertical", first + 4)
        .when(col(member).isin("beam", "slab"), first + 5)
        .otherwise(first + 6)
    )


def mechanism_record(number: Column, measured: Column) -> Column:
    """Type, severity and advice of a mechanism. Its base severity is raised to the measured one;
    equal ranks keep the base."""

    def pick(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), number)

    base_rank = pick([SEVERITY_RANK_5[base] if base else -1 for _, base, _ in MECHANISMS])
    base = pick([base for _, base, _ in MECHANISMS])
    return F.struct(
        pick([kind for kind, _, _ in MECHANISMS]).alias("crack_type"),
        F.when(base_rank >= lookup(SEVERITY_RANK_5, measured, 0), base).otherwise(measured).alias("severity"),
        pick([advice for _, _, advice in MECHANISMS]).alias("recommendation"),
    )


def keyword_mechanism(df: DataFrame, name: str = "filename", width: str = "width_mm") -> DataFrame:
    """Rows whose name holds a keyword, with the mechanism it names."""
    numbered = df.withColumn("__rule", keyword_rule(name)).where(F.col("__rule").isNotNull())
    return numbered.withColumn("__m", mechanism_record(F.col("__rule"), severity5(width))).select(*df.columns, "__m.*")


def mechanism(df: DataFrame, name: str = "filename", width: str = "width_mm", angle: str = "angle_deg",
              member: str = "member_type", rust: str = "rust", efflorescence: str = "efflorescence") -> DataFrame:
    """Precedence: keyword, rust share, efflorescence share, then orientation and member."""
    number = F.coalesce(keyword_rule(name), sight_rule(angle, member, rust, efflorescence))
    numbered = df.withColumn("__rule", number)
    return numbered.withColumn("__m", mechanism_record(F.col("__rule"), severity5(width))).select(*df.columns, "__m.*")


def unit_index(crack_type, severity) -> Column:
    """0..1 index of one image: the first keyword found in the type, times its severity."""
    t = F.lower(col(crack_type))
    weight = None
    for word, value in UNIT_TYPE_WEIGHTS:
        weight = F.when(t.contains(word), value) if weight is None else weight.when(t.contains(word), value)
    return F.round(F.least(weight.otherwise(0.3) * lookup(UNIT_SEVERITY, col(severity), 0.5) / 0.85, F.lit(1.0)), 2)


def member_grid_from_name(name) -> Column:
    n = F.lower(col(name))
    column = _any_keyword(n, ["column", "compression", "fire-damage"])
    beam = _any_keyword(n, ["beam", "shear", "flexural", "leakage"])
    return F.struct(
        F.when(column, "column").when(beam, "beam").otherwise("slab").alias("member_type"),
        F.when(column, "A2").when(beam, "C3").otherwise("D4").alias("grid_reference"),
    )


def section_loss(width, member, crack_type=None, name=None) -> Column:
    """Bar section lost to corrosion; null where neither type nor name speaks of corrosion."""
    nominal = F.when(col(member) == "beam", 20.0).otherwise(12.0)
    bar = F.round(nominal - F.least(col(width) * 1.2, nominal - 4.0), 2)
    record = F.struct(
        bar.alias("visible_bar_diameter_mm"),
        F.round(F.least(col(width) * 10.0, F.lit(40.0)), 2).alias("estimated_cover_loss_mm"),
        F.round((F.lit(1.0) - (bar * bar) / (nominal * nominal)) * 100.0, 1).alias("capacity_reduction_pct"),
    )
    if crack_type is None:
        return record
    return F.when(shows_corrosion(crack_type, name), record)


def shows_corrosion(crack_type, name) -> Column:
    return col(crack_type).rlike("Corrosion|Spalling|Steel|Exposed") | F.lower(col(name)).contains("stage")


# --- growth ------------------------------------------------------------------------------------------


def activity(rate) -> Column:
    r = col(rate)
    return F.when(r.isNull(), "unmonitored").when(r < 0.01, "dormant").when(r < 0.05, "active").otherwise("aggressive")


def growth_acceleration(rate, prev_rate) -> Column:
    r, p = col(rate), col(prev_rate)
    return F.when(F.coalesce(p, F.lit(0.0)) != 0.0, r - p).otherwise(r)


def trend(acceleration) -> Column:
    a = F.coalesce(col(acceleration), F.lit(0.0))
    return F.when(a > 0, "up").when(a < 0, "down").otherwise("none")


def propagation(width) -> Column:
    return F.when(col(width) >= 0.3, "active").otherwise("dormant")


# --- recommendations -------------------------------------------------------------------------------------


def intervention_kind(type, width) -> Column:
    t, w = col(type), col(width)
    return (
        F.when(t.contains("shear"), "shear")
        .when(t.contains("corrosion"), "corrosion")
        .when(t.contains("compression"), "compression")
        .when(w < 0.2, "hairline")
        .when(w < 1.0, "fine")
        .otherwise("other")
    )


def intervention(type, width) -> Column:
    kind = intervention_kind(type, width)
    return F.struct(
        lookup(INTERVENTIONS, kind).alias("recommended_intervention"),
        lookup(INTERVENTION_DAYS, kind).alias("reinspection_days"),
    )


def remediation(type, severity) -> Column:
    t, s = F.coalesce(col(type), F.lit("crack")), F.lower(F.coalesce(col(severity), F.lit("hairline")))

    def by_severity(i: int) -> Column:
        return lookup(
            {k: v[i] for k, v in REMEDIATION_BY_SEVERITY.items() if k != "other"}, s, REMEDIATION_BY_SEVERITY["other"][i]
        )

    grave = s.isin("wide", "medium")
    other = ~t.isin("crack", "spalling", "corrosion")
    return F.struct(
        F.when(t == "spalling", REMEDIATION_SPALLING)
        .when(t == "corrosion", REMEDIATION_CORROSION)
        .when(other, REMEDIATION_OTHER)
        .otherwise(by_severity(1))
        .alias("action"),
        F.when((t == "spalling") & grave, "Critical")
        .when(t.isin("spalling", "corrosion"), "High")
        .when(other, "Low")
        .otherwise(by_severity(0))
        .alias("priority"),
        F.when((t == "spalling") & grave, "Within 2 weeks.")
        .when(t.isin("spalling", "corrosion"), "Within 30 days.")
        .when(other, "Next maintenance cycle.")
        .otherwise(by_severity(2))
        .alias("timeline"),
    )


def standard_bar(diameter, exposure, cover) -> Column:
    """Nearest standard bar (equal distances take the smaller) and the cover check for the exposure."""
    d = lit_or_col(diameter)
    nearest = F.array_min(F.array(*[F.struct(F.abs(d - s).alias("gap"), F.lit(s).alias("bar")) for s in STANDARD_BARS_MM]))
    required = lookup(MIN_COVER_MM, lit_or_col(exposure), 30)
    return F.struct(
        nearest["bar"].alias("standard_mm"),
        required.alias("required_cover_mm"),
        F.when(lit_or_col(cover) >= required, "Adequate").otherwise("Deficient").alias("cover_status"),
    )


def type_bucket(type) -> Column:
    t = F.lower(F.coalesce(col(type), F.lit("crack")))
    return (
        F.when(t.contains("crack"), "crack")
        .when(t.contains("spall"), "spall")
        .when(t.contains("corrosion"), "corrosion")
        .when(t.contains("delamination"), "delamination")
        .otherwise("other")
    )


def error_message(text) -> Column:
    t = F.lower(col(text))
    out = None
    for pattern, message in ERROR_RULES:
        test = t.rlike(pattern)
        out = F.when(test, message) if out is None else out.when(test, message)
    return out.otherwise(ERROR_DEFAULT)


def crack_reference(spark: SparkSession) -> DataFrame:
    """Eight fixed rows: always small enough to broadcast."""
    return literal_table(
        spark,
        CRACK_REFERENCE,
        "crack_key string, label string, clause string, risk string, cause string, failure_mode string, "
        "intervention string, reinspect_days int, angle_low double, angle_high double",
    )


def with_crack_reference(df: DataFrame, key: str, angle: str) -> DataFrame:
    ref = F.broadcast(crack_reference(df.sparkSession))
    joined = df.join(ref, df[key] == ref["crack_key"], "left")
    return joined.withColumn("angle_in_range", F.col(angle).between(F.col("angle_low"), F.col("angle_high")))
