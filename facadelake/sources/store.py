"""The inspection store: upserts, replacements and appends over Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facadelake.operators.hotkeys import latest

def upsert_inspections(target: DataFrame, batch: DataFrame, key: str = "inspection_id", order: str = "run_timestamp") -> DataFrame:
    """Insert with version 1, or overwrite the fields and raise the version. Of several deliveries of one
    key in a batch the latest counts."""
    fields = [c for c in batch.columns if c != key]
    newest = latest(batch, [key], [F.col(order)])
    old = target.select(key, *[F.col(c).alias(f"__old_{c}") for c in target.columns if c != key], F.lit(True).alias("__had"))
    new = newest.select(key, *[F.col(c).alias(f"__new_{c}") for c in fields], F.lit(True).alias("__got"))
    both = old.join(new, key, "full")
    got, had = F.col("__got").isNotNull(), F.col("__had").isNotNull()
    out = []
    for c in target.columns:
        if c in (key, "row_version"):
            continue
        out.append((F.when(got, F.col(f"__new_{c}")).otherwise(F.col(f"__old_{c}")) if c in fields else F.col(f"__old_{c}")).alias(c))
    version = F.when(had & got, F.coalesce("__old_row_version", F.lit(1)) + 1).when(had, F.col("__old_row_version")).otherwise(1).cast("int")
    return both.select(key, *out, version.alias("row_version"))


def replace_defects(target: DataFrame, batch: DataFrame, delivered: DataFrame, key: str = "inspection_id") -> DataFrame:
    """All defects of the delivered inspections replaced, also by none; a null acceleration becomes 0."""
    kept = target.join(delivered.select(key).distinct(), key, "left_anti")
    clean = conform(batch.withColumn("growth_acceleration", F.coalesce("growth_acceleration", F.lit(0.0))), target.schema)
    return kept.unionByName(clean)


def replace_by_key(target: DataFrame, batch: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """Last write wins on a unique key: any batch row beats the target, later batch rows beat earlier ones."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = batch.withColumn("__batch", F.lit(1)).withColumn("__order", F.col(order))
    stale = target.withColumn("__batch", F.lit(0)).withColumn("__order", F.lit(None).cast(dict(batch.dtypes)[order]))
    both = stale.unionByName(fresh, allowMissingColumns=True)
    return latest(both, keys, ["__batch", "__order"]).select(*target.columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive migration: columns the schema has and the frame lacks are added as nulls, in schema order."""
    had = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in had else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def purge_expired(df: DataFrame, now, observation=None, expires: str = "expires_at") -> DataFrame:
    """Rows not yet expired at ``now``; an ``Observation`` counts the purged ones in the same pass."""
    gone = F.coalesce(F.col(expires) < now, F.lit(False))
    if observation is not None:
        df = df.observe(observation, F.count_if(gone).alias("purged"))
    return df.where(~gone)


def append_audit(df: DataFrame, path: str, created: str = "created_at") -> None:
    df.withColumn("day", F.to_date(created)).write.mode("append").partitionBy("day").parquet(path)


# The store of a stream of deliveries. A delivery only ever adds files: its inspections, its defects, and, last of all,
# one row in the log of commits that makes both visible. Nothing that other deliveries wrote is touched.


def _stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A table of the store, or None if nothing was written yet."""
    from pyspark.errors import AnalysisException

    try:
        reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
        return reader.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """``(commit, seq)`` of everything visible."""
    return _stored(spark, f"{path}/commits", T.StructType().add("seq", "long").add("commit", "string"))


def apply_batch(spark: SparkSession, path: str, inspections: DataFrame, defects: DataFrame, batch_id: int, writer: str = "batch") -> None:
    """Deliver a batch of inspections with all their defects, maybe none.

    ``writer`` names the query that delivers, so batch numbers of a restarted or another query are their own. A batch that is in the
    log changes nothing when it is run again; one that failed before rewrites its own files. Of several deliveries of one
    inspection in a batch the latest counts.
    """
    commit = f"{writer}-{batch_id}"
    log = commits(spark, path)
    done = log.where(F.col("commit") == commit).limit(1).count() if log is not None else 0
    if done:
        return
    last = log.agg(F.max("seq")).first()[0] if log is not None else None
    heads = latest(inspections, ["inspection_id"], [F.col("run_timestamp")]).withColumn("deliveries", F.lit(1).cast("long"))
    rows = defects.withColumn("growth_acceleration", F.coalesce("growth_acceleration", F.lit(0.0)))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/defects/commit={commit}")
    heads.write.mode("overwrite").parquet(f"{path}/inspections/commit={commit}")
    spark.range(1).select(F.lit((last or 0) + 1).cast("long").alias("seq")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/commit={commit}")


def read_inspections(spark: SparkSession, path: str) -> DataFrame:
    """The latest delivery of every inspection, with ``row_version``, how often it was delivered, and its ``commit``.

    One aggregate with map-side maxima, so an inspection that is delivered very often costs one row per task.
    """
    heads, log = _stored(spark, f"{path}/inspections"), commits(spark, path)
    if heads is None or log is None:
        raise FileNotFoundError(f"no inspections are committed below {path}")
    heads = heads.withColumn("commit", F.col("commit").cast("string"))
    fields = [c for c in heads.columns if c not in ("inspection_id", "deliveries")]
    newest = heads.join(log, "commit").groupBy("inspection_id").agg(
        F.max_by(F.struct(*fields), F.struct("seq", "commit")).alias("h"), F.sum("deliveries").cast("int").alias("row_version")
    )
    return newest.select("inspection_id", "h.*", "row_version")


def read_defects(spark: SparkSession, path: str) -> DataFrame:
    """Defects of every inspection's latest delivery."""
    rows = _stored(spark, f"{path}/defects").withColumn("commit", F.col("commit").cast("string"))
    visible = read_inspections(spark, path).select("inspection_id", "commit")
    return rows.join(visible, ["inspection_id", "commit"], "left_semi").drop("commit")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The visible state as the first commit of a new store, without what later deliveries replaced."""
    heads = read_inspections(spark, path).withColumn("deliveries", F.col("row_version").cast("long")).drop("row_version", "commit")
    read_defects(spark, path).write.parquet(f"{target}/defects/commit=compacted-0")
    heads.write.parquet(f"{target}/inspections/commit=compacted-0")
    spark.range(1).select(F.lit(0).cast("long").alias("seq")).coalesce(1).write.parquet(f"{target}/commits/commit=compacted-0")
