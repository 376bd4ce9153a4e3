"""Data-quality jobs: constraint checks as violation tables, and the audit of the store."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The document's enumerations.
DEFECT_TYPES = [
    "crack", "spalling", "corrosion", "water_seepage", "efflorescence", "plaster_detachment", "structural_displacement", "stain",
    "flexural_crack", "shear_crack", "settlement_crack", "shrinkage_crack", "compression_crack", "corrosion_crack", "fatigue_crack",
]
DETECTION_TYPES = DEFECT_TYPES[:7]
SEVERITIES = ["hairline", "fine", "medium", "wide"]
VI_CLASSES = ["minor", "moderate", "significant", "severe", "critical"]
ORIENTATIONS = ["N", "S", "E", "W", "NE", "NW", "SE", "SW"]
STATUSES = ["new", "propagated", "resolved", "uncertain"]
# Fields of each kind of object with type, rule and bound; a type that ends in ? may be null. Fields named in
# REQUIRED must be there, others may; no further keys except where OPEN says so.
FIELDS = {
    "root": [
        ("schema_version", "string", "enum", ["1.0.0"]), ("generated_at", "string", "format", "date-time"), ("pipeline_config_hash", "string", None, None),
        ("buildings", "array", None, "building"),
    ],
    "building": [
        ("id", "string", None, None), ("name", "string", None, None), ("address", "string", None, None), ("gps_centroid", "object", None, "gps"),
        ("inspection_date", "string", "format", "date"), ("inspector_module_version", "string", None, None), ("cycle_number", "integer", "min", 1.0),
        ("facades", "array", None, "facade"), ("temporal_comparison", "object", None, "temporal_comparison"),
    ],
    "facade": [
        ("id", "string", None, None), ("orientation", "string", "enum", ORIENTATIONS), ("area_m2", "number", "min", 0.0), ("vi_score", "number", "range", (0.0, 100.0)),
        ("vi_class", "string", "enum", VI_CLASSES), ("mosaic_path", "string", None, None), ("enhancement_params", "object", None, "enhancement_params"), ("zones", "array", None, "zone"),
    ],
    "zone": [
        ("grid_id", "string", "pattern", "^[A-Z][0-9]+$"), ("zone_area_cm2", "number", "min", 0.0), ("zone_vi", "number", "range", (0.0, 100.0)), ("defect_count", "integer", "min", 0.0),
        ("dominant_defect_type", "string?", "enum", DEFECT_TYPES), ("defects", "array", None, "defect"),
    ],
    "defect": [
        ("defect_id", "string", "pattern", "^[a-zA-Z0-9_-]+$"), ("type", "string", "enum", DEFECT_TYPES), ("length_cm", "number?", "min", 0.0), ("width_mm", "number?", "min", 0.0),
        ("area_cm2", "number", "min", 0.0), ("centroid_gps", "object", None, "gps"), ("centroid_px", "object", None, "pixel"), ("severity_class", "string", "enum", SEVERITIES),
        ("vi_contribution", "number", "min", 0.0), ("confidence_score", "number", "range", (0.0, 1.0)), ("image_crop_path", "string?", None, None), ("is_false_positive", "boolean", None, None),
        ("fp_confidence", "number?", "range", (0.0, 1.0)), ("temporal_status", "string", "enum", STATUSES), ("parent_defect_id", "string?", None, None), ("delta_length_cm", "number?", None, None),
        ("delta_width_mm", "number?", None, None), ("delta_area_cm2", "number?", None, None), ("growth_rate_mm_per_month", "number?", None, None), ("visible_bar_diameter_mm", "number?", None, None),
        ("estimated_cover_loss_mm", "number?", None, None), ("capacity_reduction_pct", "number?", None, None), ("orientation_angle", "number?", None, None),
        ("propagation_rate", "string?", "enum", ["dormant", "active", "aggressive"]), ("delamination_area_m2", "number?", None, None), ("grid_reference", "string?", None, None),
        ("member_type", "string?", None, None), ("recommended_intervention", "string?", None, None), ("reinspection_date", "string?", None, None),
    ],
    "gps": [("lat", "number", "range", (-90.0, 90.0)), ("lon", "number", "range", (-180.0, 180.0))],
    "pixel": [("x", "integer", "min", 0.0), ("y", "integer", "min", 0.0)],
    "temporal_comparison": [
        ("comparison_cycle", "integer", None, None), ("delta_vi", "number", None, None), ("new_defects_count", "integer", None, None), ("propagated_defects_count", "integer", None, None),
    ],
    "enhancement_params": [
        ("clahe_clip_limit", "number", None, None), ("clahe_tile_size", "integers", "length", 2), ("gaussian_kernel_size", "integers", "length", 2), ("gaussian_sigma", "number", None, None),
    ],
}
REQUIRED = {
    "root": ["schema_version", "generated_at", "pipeline_config_hash", "buildings"],
    "building": ["id", "name", "address", "gps_centroid", "inspection_date", "inspector_module_version", "cycle_number", "facades"],
    "facade": ["id", "orientation", "area_m2", "vi_score", "vi_class", "mosaic_path", "enhancement_params", "zones"],
    "zone": ["grid_id", "zone_area_cm2", "zone_vi", "defect_count", "dominant_defect_type", "defects"],
    "defect": ["defect_id", "type", "area_cm2", "centroid_gps", "centroid_px", "severity_class", "vi_contribution", "confidence_score", "is_false_positive"],
    "gps": ["lat", "lon"],
    "pixel": ["x", "y"],
    "temporal_comparison": ["comparison_cycle", "delta_vi", "new_defects_count", "propagated_defects_count"],
    "enhancement_params": [],
}
OPEN = {"enhancement_params"}
CHILD = {"root": ("buildings", "building"), "building": ("facades", "facade"), "facade": ("zones", "zone"), "zone": ("defects", "defect")}
KINDS = {"string": ["STRING"], "boolean": ["BOOLEAN"], "number": ["BIGINT", "DOUBLE", "FLOAT"], "integer": ["BIGINT"]}
DECIMALS = {"number": "DECIMAL%", "integer": "DECIMAL(%,0)"}
FORMATS = {"date": ("^\\d{4}-\\d{2}-\\d{2}$", "date"), "date-time": ("^\\d{4}-\\d{2}-\\d{2}[Tt ]\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?([Zz]|[+-]\\d{2}:\\d{2})$", "timestamp")}


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _typed(value: Column, kind: str) -> Column:
    found = F.schema_of_variant(value)
    return found.isin(*KINDS[kind]) | found.like(DECIMALS[kind]) if kind in DECIMALS else found.isin(*KINDS[kind])


def _broken(value: Column, rule: str, bound) -> Column:
    """Whether a value of the right type breaks its rule."""
    if rule in ("enum", "pattern", "format"):
        text = _as(value, "string")
        if rule == "enum":
            return ~text.isin(*bound)
        if rule == "pattern":
            return ~text.rlike(bound)
        pattern, kind = FORMATS[bound]
        return ~text.rlike(pattern) | text.try_cast(kind).isNull()
    if rule == "length":
        return F.size(_as(value, "array<variant>")) != bound
    number = _as(value, "double")
    return number < bound if rule == "min" else (number < bound[0]) | (number > bound[1])


def _fields_of(value: Column, kind: str) -> Column:
    """An object's fields by one cast, arrays as lists, and its keys; null if it isn't an object.

    A cast to a variant writes its value anew with all below it, so only what is looked at becomes one: single fields and the items of arrays.
    """
    types = ",".join(f"`{f[0]}`:{'array<variant>' if f[1] == 'array' else 'variant'}" for f in FIELDS[kind])
    return F.struct(_as(value, f"struct<{types}>").alias("own"), F.map_keys(_as(value, "map<string,struct<>>")).alias("keys"))


def _object_faults(value: Column, kind: str, level: str, prefix: str = "") -> Column:
    """All broken rules of an object in a field of another."""
    return F.get(F.transform(F.array(_fields_of(value, kind)), lambda o: _field_faults(o, kind, level, prefix)), F.lit(0))


def _field_faults(fields: Column, kind: str, level: str, prefix: str = "") -> Column:
    """All broken rules of an object, of which ``fields`` tells (``_fields_of``), and of the objects that are its fields, as ``array<struct<level, rule, field>>``."""

    def fault(rule: str, field: Column | str) -> Column:
        named = F.lit(prefix + field) if isinstance(field, str) else F.concat(F.lit(prefix), field)
        return F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), named.alias("field"))

    none = F.array().cast("array<struct<level:string,rule:string,field:string>>")
    names = [f[0] for f in FIELDS[kind]]
    lists = []
    if kind not in OPEN:
        lists.append(F.transform(F.array_except(fields["keys"], F.array(*map(F.lit, names))), lambda k: fault("unknown key", k)))
    single = []
    for name, type_, rule, bound in FIELDS[kind]:
        own = fields["own"][name]
        nullable, base = type_.endswith("?"), type_.rstrip("?")
        there = F.array_contains(fields["keys"], name) if base == "array" else own.isNotNull()
        if name in REQUIRED[kind]:
            single.append(F.when(~there, fault("required", name)))
        if base == "array":
            single.append(F.when(there & own.isNull(), fault("type", name)))
            lists.append(F.coalesce(F.transform(F.filter(own, lambda x: ~_is_object(x)), lambda x: fault("type", f"{name}[]")), none))
        elif base == "object":
            single.append(F.when(there & ~_is_object(own), fault("type", name)))
            lists.append(F.when(_is_object(own), _object_faults(own, bound, level, f"{prefix}{name}.")).otherwise(none))
        else:
            if base == "integers":
                items = _as(own, "array<variant>")
                typed = F.coalesce(F.forall(items, lambda x: _typed(x, "integer")), F.lit(False))
            else:
                typed = _typed(own, base)
            bad = F.when(~typed, fault("type", name))
            if rule:
                bad = bad.when(_broken(own, rule, bound), fault(rule, name))
            single.append(F.when(there & ~F.is_variant_null(own) if nullable else there, bad))
    return F.concat(*lists, F.array_compact(F.array(*single)))


FAULT = pa.struct([("level", pa.string()), ("rule", pa.string()), ("field", pa.string())])
PYTHON = {"string": (str,), "boolean": (bool,), "number": (int, float), "integer": (int,)}


class _Unsure(Exception):
    """A plain reading might differ from that as a variant."""


def _integer(text: str) -> int:
    if len(text) > 18:
        raise _Unsure
    return int(text)


def _object(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _Unsure
    return found


def _constant(text: str):
    raise _Unsure


READ = json.JSONDecoder(object_pairs_hook=_object, parse_int=_integer, parse_constant=_constant).decode


@lru_cache(10_000)
def _bad_format(text: str, bound: str) -> bool:
    if not re.search(FORMATS[bound][0], text, re.ASCII):
        return True
    if text < "0001" or bound == "date-time" and not re.fullmatch(r".{10}[T ]([01]\d|2[0-3])(:[0-5]\d){2}Z", text):
        raise _Unsure
    try:
        datetime.date.fromisoformat(text[:10])
    except ValueError:
        return True
    return False


def _breaks(rule: str | None, bound) -> Callable | None:
    """As ``_broken``, for a value that was read plainly."""
    if rule in ("enum", "pattern"):
        known, like = (frozenset(bound), None) if rule == "enum" else (None, re.compile(bound, re.ASCII))
        return (lambda v: v not in known) if rule == "enum" else (lambda v: not like.search(v))
    if rule in ("format", "length"):
        return (lambda v: _bad_format(v, bound)) if rule == "format" else (lambda v: len(v) != bound)
    if rule in ("min", "range"):
        return (lambda v: v < bound) if rule == "min" else (lambda v: not bound[0] <= v <= bound[1])
    return None


@cache
def _plan(kind: str) -> tuple:
    fields = {name: (t.rstrip("?"), t.endswith("?"), PYTHON.get(t.rstrip("?"), ()), rule, bound, _breaks(rule, bound)) for name, t, rule, bound in FIELDS[kind]}
    return fields, frozenset(REQUIRED[kind]), kind in OPEN, CHILD.get(kind, (None, None))


def _plain_faults(found: dict, kind: str, level: str, prefix: str, out: list) -> None:
    """As ``_field_faults``, and of the objects of the levels below."""
    fields, required, free, (child, below) = _plan(kind)
    if not required <= found.keys():
        out.extend((level, "required", prefix + name) for name in required if name not in found)
    for name, value in found.items():
        if name not in fields:
            if not free:
                out.append((level, "unknown key", prefix + name))
            continue
        base, nullable, types, rule, bound, breaks = fields[name]
        if base == "array":
            if type(value) is not list:
                out.append((level, "type", prefix + name))
                continue
            for item in value:
                if type(item) is not dict:
                    out.append((level, "type", f"{prefix}{name}[]"))
                elif name == child:
                    _plain_faults(item, below, below, "", out)
        elif base == "object":
            if type(value) is dict:
                _plain_faults(value, bound, level, f"{prefix}{name}.", out)
            else:
                out.append((level, "type", prefix + name))
        elif value is not None or not nullable:
            if base == "integers":
                if type(value) is list and any(type(x) is float and x.is_integer() for x in value):
                    raise _Unsure
                typed = type(value) is list and all(type(x) is int for x in value)
            else:
                if base == "integer" and type(value) is float and value.is_integer():
                    raise _Unsure
                typed = type(value) in types
            if not typed:
                out.append((level, "type", prefix + name))
            elif breaks and breaks(value):
                out.append((level, rule, prefix + name))


def _read_plainly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, faults and text of the documents with faults; instead of the faults null where a plain reading isn't sure to be that as a variant."""
    for batch in batches:
        rows, texts, ends, level, rule, field = [], [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            out = []
            try:
                if text is None or "\\" in text or not text.isascii() or type(found := READ(text)) is not dict:
                    raise _Unsure
                _plain_faults(found, "root", "root", "", out)
            except (_Unsure, ValueError, RecursionError):
                out = None
            if out is None or out:
                rows.append(i)
                texts.append(text if out is None else None)
                for x in out or ():
                    level.append(x[0]), rule.append(x[1]), field.append(x[2])
                ends.append(None if out is None else len(level))
        offsets, upto = [], 0
        for end in ends:
            offsets.append(None if end is None else upto)
            upto = upto if end is None else end
        faults = pa.ListArray.from_arrays(pa.array([*offsets, upto], pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (level, rule, field)], fields=[*FAULT]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), faults, pa.array(texts, pa.string())], ["__key", "__plain", "__text"])


def check_documents(documents: DataFrame, key: str, column: str = "json") -> DataFrame:
    """One row per broken rule: key, level, rule and field.

    One scan, no shuffle. A document that means the same to any reader is read by Python's parser and checked by the same tables; all others, with long
    integers, whole numbers written as fractions, escapes, other letters than ASCII, repeated keys, rare dates or broken syntax, are parsed once into a variant, whose objects are listed
    level by level, taken apart once each, and checked in place. What isn't a JSON object is ``malformed``.
    """
    fault = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("level", "rule", "field")]))
    asked = documents.select(F.col(key).alias("__key"), F.col(column).cast("string").alias("__text"))
    schema = T.StructType([asked.schema["__key"], T.StructField("__plain", fault), T.StructField("__text", T.StringType())])
    read = asked.mapInArrow(_read_plainly, schema)
    parsed = read.withColumn("doc", F.when(F.col("__plain").isNull(), F.try_parse_json("__text"))).withColumn("ok", F.coalesce(_is_object(F.col("doc")), F.lit(False)))
    nothing = F.array().cast("array<variant>")
    found, levels = F.when(F.col("ok"), F.array("doc")).otherwise(nothing), ["root"]
    rows = parsed.withColumn("root", F.transform(found, lambda x: _fields_of(x, "root")))
    while levels[-1] in CHILD:
        name, below = CHILD[levels[-1]]
        found = F.flatten(F.transform(levels[-1], lambda o: F.coalesce(F.filter(o["own"][name], _is_object), nothing)))
        rows = rows.withColumn(below, F.transform(found, lambda x: _fields_of(x, below)))
        levels.append(below)
    whole = F.struct(F.lit("root").alias("level"), F.lit("malformed").alias("rule"), F.lit("").alias("field"))
    rows = rows.withColumns({f"{x}_faults": F.flatten(F.transform(x, _faults_of(x))) for x in levels})
    faults = F.when(F.col("__plain").isNotNull(), F.col("__plain")).when(F.col("ok"), F.concat(*(f"{x}_faults" for x in levels))).otherwise(F.array(whole))
    return rows.select(F.col("__key").alias(key), F.explode(faults).alias("v")).select(key, "v.*")


def _is_object(value: Column) -> Column:
    return _as(value, "struct<>").isNotNull()


def _faults_of(level: str) -> Callable[[Column], Column]:
    return lambda o: _field_faults(o, level, level)


def violations(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows of ``key`` and rule name for every predicate that does not hold; one pass over the table."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))
    return df.select(key, F.explode(broken).alias("rule"))


def check_detections(detections: DataFrame, key: str = "defect_id") -> DataFrame:
    box = F.col("bbox")
    return violations(
        detections, key,
        [
            ("defect_id pattern", F.col("defect_id").rlike("^[a-zA-Z0-9_-]+$")),
            ("defect_type enum", F.col("defect_type").isin(*DETECTION_TYPES)),
            ("confidence range", F.col("confidence").between(0.0, 1.0)),
            ("bbox origin", (box["x"] >= 0) & (box["y"] >= 0)),
            ("bbox size", (box["width"] >= 1) & (box["height"] >= 1)),
            ("mask_encoding enum", F.coalesce("mask_encoding", F.lit("none")).isin("base64_png", "rle", "none")),
            ("mask_shape", F.col("mask").isNull() | (F.size(F.coalesce("mask_shape", F.array().cast("array<int>"))) == 2)),
        ],
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def class_domain(df: DataFrame, column: str = "vi_class", domain: Sequence[str] = ("minor", "moderate", "severe", "critical")) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*domain))


def orphan_defects(defects: DataFrame, inspections: DataFrame, key: str = "inspection_id") -> DataFrame:
    return defects.join(inspections.select(key), key, "left_anti")


def store_audit(inspections: DataFrame, defects: DataFrame) -> DataFrame:
    """Checks of the store as rows: name, status (pass, warn, fail) and the count behind it."""

    def check(count: DataFrame, name: str, bad: str | None) -> DataFrame:
        status = F.lit("pass") if bad is None else F.when(F.expr(bad), "warn" if bad == "n = 0" else "fail").otherwise("pass")
        return count.select(F.lit(name).alias("check_name"), status.alias("status"), F.col("n").cast("long").alias("n"))

    one = F.count(F.lit(1)).alias("n")
    malformed = F.try_parse_json("warnings_json").isNull()
    return (
        check(inspections.agg(one), "inspections row count", "n = 0")
        .unionByName(check(defects.agg(one), "defects row count", None))
        .unionByName(check(orphan_defects(defects, inspections).agg(one), "foreign key violations", "n > 0"))
        .unionByName(check(defects.agg(F.count_if(F.col("growth_acceleration").isNull()).alias("n")), "growth_acceleration null rows", "n > 0"))
        .unionByName(check(inspections.agg(F.count_if(malformed).alias("n")), "warnings_json parseable", "n > 0"))
    )


def probe_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "warn").alias("warned"),
    )
