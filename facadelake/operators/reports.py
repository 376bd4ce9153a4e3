"""The tables behind the reports: schedules, inventories, flags and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facadelake.config import DEFAULTS
from facadelake.functions import rules as r
from facadelake.functions.geometry import lookup, normalize_gps, subtype_slug, title
from facadelake.functions.predicates import is_active


def schema_defects(defects: DataFrame, gps: dict | None = None) -> DataFrame:
    """Defects in the document's shape: one rounding per field, nulls kept, absent fields null."""
    had = set(defects.columns)
    place = gps or {"latitude": 22.31, "longitude": 87.31}

    def number(name: str, digits: int, default: float | None = None):
        value = F.col(name).cast("double") if name in had else F.lit(None).cast("double")
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        return F.round(value, digits).alias(name)

    def text(name: str, default: str | None = None):
        value = F.col(name).cast("string") if name in had else F.lit(None).cast("string")
        return (F.coalesce(value, F.lit(default)) if default is not None else value).alias(name)

    if "centroid_px" in had:
        kind = dict(defects.dtypes)["centroid_px"]
        at = (F.col("centroid_px")[0], F.col("centroid_px")[1]) if kind.startswith("array") else (F.col("centroid_px.x"), F.col("centroid_px.y"))
    elif "centroid_x" in had:
        at = (F.col("centroid_x"), F.col("centroid_y"))
    else:
        at = (F.lit(0), F.lit(0))
    point = F.struct(*[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for c, n in zip(at, "xy")])
    known = {"inspection_id", "building_id", "facade_id", "zone_id"}
    return defects.select(
        *[c for c in defects.columns if c in known],
        text("defect_id", "DEFECT-000"),
        text("type", "crack"),
        number("length_cm", 3),
        number("width_mm", 3),
        number("area_cm2", 3, 0.0),
        F.struct(F.lit(float(place["latitude"])).alias("lat"), F.lit(float(place["longitude"])).alias("lon")).alias("centroid_gps"),
        point.alias("centroid_px"),
        text("severity_class", "hairline"),
        number("vi_contribution", 4, 0.0),
        number("confidence_score", 4, 0.0),
        (F.coalesce(F.col("is_false_positive").cast("boolean"), F.lit(False)) if "is_false_positive" in had else F.lit(False)).alias("is_false_positive"),
        number("fp_confidence", 4),
        number("visible_bar_diameter_mm", 2),
        number("estimated_cover_loss_mm", 2),
        number("capacity_reduction_pct", 1),
        number("orientation_angle", 1),
        text("propagation_rate"),
        number("delamination_area_m2", 5),
        text("grid_reference"),
        text("member_type"),
        text("recommended_intervention"),
        text("reinspection_date"),
    )


def rebar_schedule(defects: DataFrame) -> DataFrame:
    bar = F.col("visible_bar_diameter_mm")
    loss = F.coalesce(F.col("estimated_cover_loss_mm"), F.lit(0.0))
    kind = F.lower("type")
    return defects.where(bar.isNotNull() | kind.contains("corrosion") | kind.contains("spalling")).select(
        "defect_id",
        F.coalesce(F.nullif(F.col("grid_reference"), F.lit("")), F.lit("B4")).alias("grid_reference"),
        F.coalesce(bar, F.lit(12.0)).alias("bar_diameter_mm"),
        bar.isNull().alias("bar_is_estimate"),
        loss.alias("cover_loss_mm"),
        F.coalesce(F.col("capacity_reduction_pct"), F.lit(0.0)).alias("capacity_loss_pct"),
        F.when(loss > 15.0, "Deficient").otherwise("Adequate").alias("cover_status"),
    )


def crack_schedule(defects: DataFrame) -> DataFrame:
    return defects.select(
        "defect_id",
        F.coalesce("crack_subtype", "type", F.lit("crack")).alias("kind"),
        F.round(F.coalesce("width_mm", F.lit(0.0)), 2).alias("width_mm"),
        F.round(F.coalesce("length_cm", F.lit(0.0)), 2).alias("length_cm"),
        F.coalesce("grid_ref", "grid_reference", F.lit("N/A")).alias("grid_ref"),
        lookup(r.SCHEDULE_INTERVENTION, F.lower(F.coalesce("severity_class", F.lit("hairline"))), "Review").alias("intervention"),
    )


def cover_warnings(rebar: DataFrame) -> DataFrame:
    """One structured warning per bar whose cover is deficient."""
    return rebar.where(F.col("cover_status") == "Deficient").select(
        "defect_id",
        F.lit("COVER_DEFICIENT").alias("code"),
        F.lit("fatal").alias("severity"),
        F.concat(
            F.lit("COVER DEFICIENT at "), "grid_ref", F.lit(": measured "), F.col("measured_cover_mm").cast("string"),
            F.lit("mm, required "), F.col("required_cover_mm").cast("string"), F.lit("mm"),
        ).alias("message"),
        F.lit("none").alias("fallback"),
    )


def analysis_record(images: DataFrame) -> DataFrame:
    """Result row of one image: classified where something was found, else the record of a sound surface."""
    found = F.coalesce(F.col("detected_count"), F.lit(0)) > 0
    sized = F.coalesce(F.col("real_width_m") > 0, F.lit(False)) & F.coalesce(F.col("real_height_m") > 0, F.lit(False))
    advice = (
        "No structural cracks or surface defects were detected in this frame. "
        "The surface appears sound. Continue the routine inspection cycle."
    )
    days = F.when(~found, 365).otherwise(lookup({"critical": 30, "severe": 90, "moderate": 180}, F.col("severity"), 365))
    index = F.when(found, r.unit_index("crack_type", "severity")).otherwise(0.0)
    slug = F.when(found, subtype_slug("crack_type")).otherwise("none")
    return images.select(
        *[c for c in images.columns if c not in {"crack_type", "severity", "recommendation"}],
        found.alias("defect_found"),
        F.when(found, F.col("crack_type")).otherwise("No Crack Detected").alias("crack_type"),
        slug.alias("crack_subtype"),
        F.when(found, F.col("severity")).otherwise("none").alias("severity"),
        index.alias("v_index"),
        F.when(found, F.col("recommendation")).otherwise(advice).alias("recommendation"),
        F.when(found, F.col("recommendation"))
        .otherwise("No action required. Re-inspect on the next scheduled cycle.")
        .alias("recommended_intervention"),
        F.when(found, r.propagation("width_mm")).otherwise("none").alias("propagation_rate"),
        F.when(found, F.when(sized, 0.9).otherwise(0.65)).otherwise(F.when(sized, 0.85).otherwise(0.6)).alias("analysis_confidence"),
        days.alias("reinspection_days"),
    )


def calc_breakdown(analysis: DataFrame) -> DataFrame:
    """The numbers of a printed calculation: mean GSD, width in pixels, angle band, and the step texts."""
    mean = (F.col("gsd_x") + F.col("gsd_y")) / 2.0
    width_px = F.col("width_mm") / F.nullif(mean * 10.0, F.lit(0.0))
    angle = F.col("angle_deg")
    band = F.when(angle >= 70, "near-vertical").when(angle <= 20, "near-horizontal").otherwise("diagonal")
    return analysis.withColumns({"mean_gsd": mean, "width_px": width_px, "angle_band": band}).withColumn(
        "steps",
        F.array_compact(
            F.array(
                F.when(F.col("mean_gsd").isNotNull(), F.format_string("Mean GSD = (GSDx + GSDy) / 2 = %.4f cm/px", "mean_gsd")).otherwise(
                    F.lit("Real-world dimensions not supplied - nominal 0.15 cm/px assumed.")
                ),
                F.format_string("Length = %.1f cm", "length_cm"),
                F.when(
                    F.col("width_px").isNotNull(),
                    F.format_string("Width = width(px) x GSD x 10 = %.1f px x %.4f x 10 = %.2f mm", "width_px", "mean_gsd", "width_mm"),
                ).otherwise(F.format_string("Measured crack width = %.2f mm", "width_mm")),
                F.format_string("theta from horizontal = %.1f deg (%s)", "angle_deg", "angle_band"),
            )
        ),
    )


def defect_inventory(defects: DataFrame, by: list[str]) -> DataFrame:
    """Active defects per type, most frequent first, and a total row per ``by`` key."""
    grouped = (
        defects.where(is_active())
        .rollup(*[F.col(c) for c in by], "type")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("type").alias("is_total"), F.grouping_id().alias("__level"))
        .where(F.col("__level") <= 1)
    )
    return grouped.select(
        *by,
        F.when(F.col("is_total") == 1, "TOTAL ACTIVE DEFECTS").otherwise(title("type")).alias("category"),
        "n",
        F.col("is_total").cast("int").alias("is_total"),
    )


def type_share(defects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of each type in percent; the total comes from the few type counts, not from the rows."""
    by = by or []
    counts = defects.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("share_pct", F.round(F.col("n") * 100.0 / total, 1))


def score_histogram(df: DataFrame, score: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over the score range, empty bins included, the maximum in the last bin."""
    span = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    position = F.floor((F.col(score) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    bin_no = F.least(F.lit(bins - 1), F.coalesce(position, F.lit(0))).cast("int")
    # One row of range: always small enough to broadcast.
    counted = df.where(F.col(score).isNotNull()).crossJoin(F.broadcast(span)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    step = (F.col("hi") - F.col("lo")) / bins
    return grid.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.col("lo") + step * F.col("bin")).alias("bin_start"),
        (F.col("lo") + step * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def heatmap(zones: DataFrame, by: list[str]) -> DataFrame:
    """4x4 matrix per facade: one row per grid row, columns A to D with score, count and colour."""
    from facadelake.functions.rules import bands

    # Fill colours of the five bands.
    fills = [(20.0, "#D4EFDF"), (40.0, "#FCF3CF"), (60.0, "#F5CBA7"), (80.0, "#FADBD8"), (None, "#EBDEF0")]
    cells = zones.select(
        *by,
        F.substring("zone_id", 2, 8).cast("int").alias("row_no"),
        F.substring("zone_id", 1, 1).alias("col"),
        "zone_vi",
        "defect_count",
    )
    return (
        cells.groupBy(*by, "row_no")
        .pivot("col", ["A", "B", "C", "D"])
        .agg(
            F.coalesce(F.max("zone_vi"), F.lit(0.0)).alias("vi"),
            F.coalesce(F.max("defect_count"), F.lit(0)).alias("n"),
            bands(F.coalesce(F.max("zone_vi"), F.lit(0.0)), fills, 1).alias("fill"),
        )
    )


def risk_flags(facades: DataFrame, zones: DataFrame, defects: DataFrame, by: str = "building_id") -> DataFrame:
    """Four rule streams in one table. ``sort_key`` is the reading order: a facade's own flag, then per
    zone its flag and, defect by defect, the width flag before the growth flag."""
    none = F.lit("")

    def stream(df, rule, zone, defect, value, text):
        return df.select(
            by,
            F.struct(
                F.col("facade_id").cast("string").alias("facade"), zone.alias("zone"), defect.alias("defect"), F.lit(rule).alias("rule")
            ).alias("sort_key"),
            F.lit(rule).alias("rule"),
            value.cast("double").alias("value"),
            text.alias("message"),
        )

    active = defects.where(is_active())
    wide = (F.lower(F.coalesce("severity_class", none)) == "wide") | (F.coalesce("width_mm", F.lit(0.0)) > 5.0)
    return (
        stream(
            facades.where("vi_score > 60"), 1, none, none, F.col("vi_score"),
            F.format_string("Facade %s (%s) has high overall VI score (%.1f), requiring urgent engineering review.", F.col("facade_id").cast("string"), "orientation", "vi_score"),
        )
        .unionByName(
            stream(
                zones.where("zone_vi > 60"), 2, F.col("zone_id"), none, F.col("zone_vi"),
                F.format_string("Zone %s on Facade %s has severe local vulnerability (%.1f).", "zone_id", F.col("facade_id").cast("string"), "zone_vi"),
            )
        )
        .unionByName(
            stream(
                active.where(wide), 3, F.col("zone_id"), F.col("defect_id"), F.col("width_mm"),
                F.format_string("Critical Defect %s on Facade %s has a wide crack width of %.1fmm.", "defect_id", F.col("facade_id").cast("string"), "width_mm"),
            )
        )
        .unionByName(
            stream(
                active.where(F.coalesce("growth_rate_mm_per_month", F.lit(0.0)) > 0.2), 4, F.col("zone_id"), F.col("defect_id"), F.col("growth_rate_mm_per_month"),
                F.format_string("High Growth Rate: Defect %s is expanding rapidly at %.2f mm/month.", "defect_id", "growth_rate_mm_per_month"),
            )
        )
    )


def top_flags(flags: DataFrame, k: int = 4, by: str = "building_id") -> DataFrame:
    """First ``k`` flags per building. The rank limit runs map-side first, so a building with very many
    flags sends only ``k`` per task."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("sort_key"))
    return flags.withColumn("position", place).where(F.col("position") <= k)


def assemble(buildings: DataFrame, facades: DataFrame, zones: DataFrame, defects: DataFrame, owners: DataFrame | None = None) -> DataFrame:
    """Building -> facade -> zone -> defect documents, one row per building and facade, whatever their size.

    The defects and the zones of a facade are each listed by one aggregate and put together in its row; lists are sorted, for
    row order does not survive a shuffle. Facades and zones without defects are there, too. Where ``owners`` gives the
    building of every facade, zones and defects need only name their facade, which then is the only key of the large tables.
    """
    by = ["building_id", "facade_id"] if owners is None else ["facade_id"]
    record = F.struct(
        "defect_id", "type", F.round("length_cm", 2).alias("length_cm"), F.round("width_mm", 2).alias("width_mm"),
        F.round("area_cm2", 2).alias("area_cm2"), "severity_class", F.round("vi_contribution", 4).alias("vi_contribution"),
        F.round("confidence_score", 4).alias("confidence_score"), F.coalesce("is_false_positive", F.lit(False)).alias("is_false_positive"),
        F.struct("centroid_x", "centroid_y").alias("centroid_px"),
    )
    found = defects.groupBy(*by).agg(F.collect_list(F.struct("zone_id", record.alias("record"))).alias("__defects"))
    listed = zones.groupBy(*by).agg(
        F.collect_list(
            F.struct(F.col("zone_id").alias("grid_id"), F.round("zone_area_cm2", 2).alias("zone_area_cm2"), F.round("zone_vi", 2).alias("zone_vi"),
                     "defect_count", "dominant_defect_type")
        ).alias("__zones")
    )
    heads = buildings.join(
        facades.select("building_id", "facade_id", F.struct("orientation", F.round("area_m2", 2).alias("area_m2"), F.round("vi_score", 2).alias("vi_score"), "vi_class").alias("__head")),
        "building_id",
    )
    if owners is not None:
        # A building that is named twice as the owner has the facade's zones and defects twice.
        heads = heads.join(owners.groupBy("building_id", "facade_id").agg(F.count(F.lit(1)).cast("int").alias("__times")), ["building_id", "facade_id"])
    docs = listed.join(found, by, "left").join(heads, by)
    none = F.array().cast(found.schema["__defects"].dataType)
    docs = docs.withColumn("__defects", F.coalesce("__defects", none))
    if owners is not None:
        docs = docs.withColumns({c: F.when(F.col("__times") == 1, F.col(c)).otherwise(F.flatten(F.array_repeat(c, F.col("__times")))) for c in ("__zones", "__defects")})

    def with_defects(z: Column) -> Column:
        mine = F.transform(F.filter("__defects", lambda d: d["zone_id"] == z["grid_id"]), lambda d: d["record"])
        return F.struct(*[z[c].alias(c) for c in ("grid_id", "zone_area_cm2", "zone_vi", "defect_count", "dominant_defect_type")], F.array_sort(mine).alias("defects"))

    facade = F.struct(F.col("facade_id").alias("id"), "__head.*", F.array_sort(F.transform("__zones", with_defects)).alias("zones"))
    return docs.select(*buildings.columns, "facade_id", F.array(facade).alias("facades"))


def flatten(documents: DataFrame) -> DataFrame:
    """Defect rows of nested documents, with their parents' keys."""
    keys = [c for c in documents.columns if c not in {"facades", "facade_id"}]
    facades = documents.select(*keys, F.explode("facades").alias("f"))
    zones = facades.select(*keys, F.col("f.id").alias("facade_id"), "f.orientation", F.explode("f.zones").alias("z"))
    return zones.select(*keys, "facade_id", "orientation", F.col("z.grid_id").alias("zone_id"), F.explode("z.defects").alias("d")).select(
        *keys, "facade_id", "orientation", "zone_id", "d.*"
    )


def current_and_previous(buildings: DataFrame, by: str = "building_id", cycle: str = "cycle_id") -> DataFrame:
    """Highest cycle per building = current, the next = previous. Two rows per building leave each task."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(cycle).desc()))
    return (
        buildings.withColumn("__place", place)
        .where(F.col("__place") <= 2)
        .withColumn("role", F.when(F.col("__place") == 1, "current").otherwise("previous"))
        .drop("__place")
    )


def gps_struct(df: DataFrame) -> DataFrame:
    return df.withColumn("gps_centroid", normalize_gps("gps_centroid"))
