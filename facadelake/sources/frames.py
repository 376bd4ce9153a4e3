"""Frame files, their tags, and flights of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".jpg", ".jpeg", ".dng", ".tiff", ".tif", ".png")


def list_frames(spark: SparkSession, root: str, exts: tuple[str, ...] = EXTENSIONS, recursive: bool = False,
                with_content: bool = False) -> DataFrame:
    """Files of a folder by extension, whatever its case, in name order. Contents are read only on request."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return (
        files.where(ext.isin(*exts))
        .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.col("path").alias("filepath"), "length", "modificationTime", *(["content"] if with_content else []))
        .orderBy("filename", "filepath")
    )


def tag_number(c: Column | str) -> Column:
    """Numbers that may be written with a leading plus; anything else is null."""
    return F.expr(f"try_cast(replace({c}, '+', '') AS DOUBLE)") if isinstance(c, str) else F.replace(c, F.lit("+"), F.lit("")).try_cast("double")


def merge_frame_tags(primary: DataFrame, secondary: DataFrame, key: str = "frame_id") -> DataFrame:
    """Two tag tables merged field by field; the second wins where it has a value. Text fields of numeric
    tags are read as numbers."""
    fields = [c for c in primary.columns if c != key]

    def typed(df: DataFrame, side: str) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(
            key, *[(tag_number(c) if kinds[c] == "string" and c not in TEXT_TAGS else F.col(c)).alias(f"{side}_{c}") for c in fields if c in df.columns]
        )

    a, b = typed(primary, "a"), typed(secondary, "b")
    both = a.join(b, key, "full")
    return both.select(key, *[(F.coalesce(f"b_{c}", f"a_{c}") if f"b_{c}" in both.columns else F.col(f"a_{c}")).alias(c) for c in fields])


TEXT_TAGS = {"timestamp", "filename", "filepath", "camera_model"}


def flight_batch(spark: SparkSession, root: str, exts: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Frames of all flights below ``root``, one flight per subfolder; frames directly in a root without
    subfolders are one flight of its own name."""
    frames = list_frames(spark, root, exts, recursive=True)
    clean = root.rstrip("/")
    inside = F.regexp_extract("filepath", "/" + _escape(clean.rsplit("/", 1)[-1]) + "/(.*)$", 1)
    nested = F.size(F.split(inside, "/")) > 1
    flight = F.when(nested, F.split(inside, "/")[0]).otherwise(F.lit(clean.rsplit("/", 1)[-1]))
    placed = frames.withColumn("flight_id", flight).withColumn("__nested", nested)
    # Loose files beside flight folders belong to no flight.
    any_nested = placed.agg(F.max("__nested").alias("__any"))
    return placed.crossJoin(F.broadcast(any_nested)).where(F.col("__nested") | ~F.col("__any")).drop("__nested", "__any")


def _escape(text: str) -> str:
    import re

    return re.escape(text)


def flight_outcomes(runs: DataFrame) -> DataFrame:
    """How many flights succeeded and failed; a flight fails alone."""
    return runs.groupBy("status").agg(F.count_distinct("flight_id").alias("flights"))


def export_metadata(frames: DataFrame, path: str) -> None:
    """Rows as JSON; types JSON lacks are written as text, nulls are kept."""
    plain = {"string", "int", "bigint", "double", "float", "boolean", "smallint", "tinyint"}
    cast = [F.col(c) if t in plain or t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in frames.dtypes]
    frames.select(*cast).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
