"""Per-key order statistics that never put a whole key into one task.

A plain window or ``percentile`` sends every row of a key to one task. Here the order column is
cut into ordered buckets by a data-independent rule, only bucket totals (a bounded number per key)
are combined per key, and rows meet those totals on (key, bucket). One key may hold a large share
of the table: its rows still spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"


def time_bucket(col: Column | str, seconds: int) -> Column:
    """Ordered bucket of a timestamp."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(seconds)).cast("long")


def magnitude_bucket(col: Column | str) -> Column:
    """Ordered bucket of a double: its sign and log2 magnitude in steps of 1/256 octave."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    size = F.floor((F.log2(F.abs(c) + F.lit(1e-12)) + F.lit(40.0)) * F.lit(256.0))
    return F.when(c == 0, F.lit(0).cast("long")).otherwise((F.signum(c) * size).cast("long"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], bucket: Column, out: str) -> DataFrame:
    """``row_number()`` per key; ``bucket`` must rise with ``order``. Keys must not be null."""
    rows = df.withColumn(BUCKET, bucket)
    sizes = rows.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order))
    return (
        rows.withColumn("__local", inside)
        .join(starts, [*keys, BUCKET])
        .withColumn(out, F.col("__start") + F.col("__local"))
        .drop(BUCKET, "__local", "__start")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[Column | str], bucket: Column, out: str
) -> DataFrame:
    """``lag(value)`` per key in the order of ``value`` and ``ties``; ``bucket`` rises with ``value``."""
    rows = df.withColumn(BUCKET, bucket)
    tops = rows.groupBy(*keys, BUCKET).agg(F.max(value).alias("__top"))
    carry = tops.select(
        *keys, BUCKET, F.lag("__top").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("__carry")
    )
    inside = F.lag(value).over(Window.partitionBy(*keys, BUCKET).orderBy(value, *ties))
    return (
        rows.withColumn("__inside", inside)
        .join(carry, [*keys, BUCKET])
        .withColumn(out, F.coalesce("__inside", "__carry"))
        .drop(BUCKET, "__inside", "__carry")
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median of the non-null values per key: one row per key.

    Equal values are counted first, so copies cost nothing; then only the one or two buckets that
    hold the middle ranks are looked into.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(BUCKET, magnitude_bucket("__v"))
    )
    sizes = counted.groupBy(*keys, BUCKET).agg(F.sum("__n").alias("__size"))
    per_key = Window.partitionBy(*keys)
    middle = (
        sizes.withColumn("__end", F.sum("__size").over(per_key.orderBy(BUCKET)))
        .withColumn("__total", F.sum("__size").over(per_key))
        .withColumn("__lo", F.expr("(__total - 1) div 2"))
        .withColumn("__hi", F.expr("__total div 2"))
        .withColumn("__start", F.col("__end") - F.col("__size"))
        .where(
            ((F.col("__start") <= F.col("__lo")) & (F.col("__lo") < F.col("__end")))
            | ((F.col("__start") <= F.col("__hi")) & (F.col("__hi") < F.col("__end")))
        )
        .select(*keys, BUCKET, "__start", "__lo", "__hi")
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy("__v")
    placed = counted.join(middle, [*keys, BUCKET]).withColumn(
        "__upto", F.col("__start") + F.sum("__n").over(inside)
    )
    return placed.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("__upto") > F.col("__lo"), F.col("__v")))
                + F.min(F.when(F.col("__upto") > F.col("__hi"), F.col("__v")))
            )
            / F.lit(2.0)
        ).alias(out)
    )


def spread_values(df: DataFrame, keys: Sequence[str], value: str, parts: int, out: str) -> DataFrame:
    """Per key, in order, the values that stand in the middle of ``parts`` equal shares of its rows; all its values if it has no more than ``parts``.

    As in ``exact_median``, only buckets that hold a wanted rank are looked into; all rows are counted.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(BUCKET, magnitude_bucket("__v"))
    )
    sizes = counted.groupBy(*keys, BUCKET).agg(F.sum("__n").alias("__size"), F.count(F.lit(1)).alias("__kinds"))
    per_key = Window.partitionBy(*keys)
    ranks = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.floor((2 * i + 1) * F.col("__total") / (2 * parts)))
    middle = (
        sizes.withColumn("__start", F.sum("__size").over(per_key.orderBy(BUCKET)) - F.col("__size"))
        .withColumns({"__total": F.sum("__size").over(per_key), "__few": F.sum("__kinds").over(per_key) <= parts})
        .withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__start")) & (r < F.col("__start") + F.col("__size"))))
        .where("__few OR size(__ranks) > 0")
        .select(*keys, BUCKET, "__start", "__few", "__ranks")
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy("__v")
    placed = counted.join(middle, [*keys, BUCKET]).withColumn("__upto", F.col("__start") + F.sum("__n").over(inside))
    wanted = F.exists("__ranks", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n")))
    return placed.where(F.col("__few") | wanted).groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias(out))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], newest: bool = True) -> DataFrame:
    """One whole row per key, by the order struct; combined map-side before the exchange."""
    cols = df.columns
    best = F.max_by if newest else F.min_by
    row = F.struct(*[F.col(c) for c in cols])
    return (
        df.groupBy(*keys)
        .agg(best(row, F.struct(*order)).alias("__row"))
        .select(*[F.col("__row")[c].alias(c) for c in cols])
    )
