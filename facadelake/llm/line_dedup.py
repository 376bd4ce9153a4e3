"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a text that hold a character other than white space are one window, known
by a 128-bit hash of its lines. A window that occurs more than once anywhere stays where it occurs first,
by ``doc_id`` and line; where it occurs later its lines are covered. Covered stretches of a text are merged
and taken out, with the blank lines inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def _windows(rows: DataFrame) -> DataFrame:
    """``(key, hi, lo, i)``: both hash halves and the line number of every window of the rows."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.trim(x, F.lit(" \t\x0b\x0c\r")).alias("x"), i.alias("i")))
    lines = F.filter(numbered, lambda s: F.length(s["x"]) > 0)
    hashed = F.transform(lines, lambda s: F.struct(F.xxhash64(s["x"]).alias("a"), F.xxhash64(F.lit(1), s["x"]).alias("b"), s["i"].alias("i")))
    starts = F.sequence(F.lit(1), F.size("h") - (WINDOW - 1))

    def window(at: Column) -> Column:
        part = [F.element_at("h", at + j) for j in range(WINDOW)]
        return F.struct(
            F.xxhash64(*(p["a"] for p in part)).alias("hi"), F.xxhash64(*(p["b"] for p in part)).alias("lo"), part[0]["i"].alias("i"), part[-1]["i"].alias("j")
        )

    return (
        rows.select("key", hashed.alias("h"))
        .where(F.size("h") >= WINDOW)
        .select("key", F.explode(F.transform(starts, window)).alias("w"))
        .select("key", "w.hi", "w.lo", "w.i", "w.j")
    )


def covered_lines(docs: DataFrame) -> DataFrame:
    """``(key, gone)``: the covered line numbers, ascending, of every text with later occurrences.

    ``key`` is ``(doc_id, hash of the text)``. Windows are counted with map-side sums, so a frequent one
    costs one row per task; the join back to its places is split at run time where it is skewed.
    """
    rows = docs.where("text IS NOT NULL").select(F.struct("doc_id", F.xxhash64("text").alias("t")).alias("key"), "text")
    windows = _windows(rows)
    place = F.struct(F.col("key"), F.col("i"))
    repeated = windows.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hi", "lo", "first")
    later = windows.join(repeated, ["hi", "lo"]).where(place > F.col("first"))
    spans = later.groupBy("key").agg(F.collect_set(F.struct("i", "j")).alias("spans"))
    return spans.select("key", F.sort_array(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["i"], s["j"]))))).alias("gone"))


def merged_stretches(covered: DataFrame) -> DataFrame:
    """``covered`` with ``first`` and ``last``: ends of the stretches without a gap that its line numbers make."""

    def ends(step: int):
        return F.filter("gone", lambda x, i: F.coalesce(F.get("gone", i + step) != x + step, F.lit(True)))

    return covered.select("key", F.size("gone").alias("removed"), ends(-1).alias("first"), ends(1).alias("last"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeated three-line windows taken out, and ``n_lines_removed``.

    ``text`` holds the remaining lines; ``n_lines_removed`` counts the others, blank ones included; ``n_chars``,
    where present, is counted anew where lines went. Lines are compared without white space at their ends. Texts that are null
    or have fewer than three lines with a character stay as they are. Rows alike in ``doc_id`` and text
    are one occurrence and stay alike; rows of one ``doc_id`` with several texts are ordered by the text's
    hash; null ids come first. An empty table gives an empty result. All columns are kept.
    """
    found = merged_stretches(covered_lines(docs)).select(
        F.col("key.doc_id").alias("_llm_doc"), F.col("key.t").alias("_llm_hash"), F.col("first").alias("_llm_first"), F.col("last").alias("_llm_last"), F.col("removed").alias("_llm_removed")
    )
    same = F.coalesce(F.col("doc_id").eqNullSafe(F.col("_llm_doc")), F.lit(False)) & (F.xxhash64("text") == F.col("_llm_hash"))
    concerned = F.col("_llm_first").isNotNull()
    joined = docs.join(found, same, "left").withColumn("_llm_lines", F.when(concerned, F.split("text", "\n", -1)))

    def between(k):
        """The lines between the stretch before number k and that one."""
        start = F.coalesce(F.get("_llm_last", k - 1) + 1, F.lit(0))
        return F.slice("_llm_lines", start + 1, F.coalesce(F.get("_llm_first", k), F.size("_llm_lines")) - start)

    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_llm_first")), between))
    cut = joined.withColumn("_llm_text", F.when(concerned, F.array_join(left, "\n")).otherwise(F.col("text")))
    new = {"text": F.col("_llm_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(concerned, F.length("_llm_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    columns = [new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return cut.select(*columns, F.coalesce("_llm_removed", F.lit(0)).cast("long").alias("n_lines_removed"))
