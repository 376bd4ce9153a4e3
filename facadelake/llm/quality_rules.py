"""Quality rules, in DataFrame functions only: base figures of each text, and line frequency across a host.

A line that many different documents of one host (``source``) have is boilerplate: its normalised form is
hashed, the distinct texts per host that have it are counted, and lines above the host's limit are removed.
A document that these removals deplete is rejected. Copies of one text count once, so copying a document
does not turn its own lines into boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5  # words
LEAST_WORDS = 10
REPEATED_PERCENT = 20  # of the words, in repeated windows, at most
# A line is boilerplate in more texts of a host than the larger of both.
LINE_TEXTS, LINE_PERCENT = 20, 2
LEFT_PERCENT = 30  # of the characters in words, that must be left


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def normal_line(line: Column) -> Column:
    """Lower case, digits as one 0, white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), "[ \\t\\x0B\\f\\r]+", " "))


def base_figures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``.

    All within the row: nothing is shuffled. A null text has no words.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(_without(x, SEPARATORS)) > 0)
    out = docs.withColumns(
        {
            "_llm_words": F.transform(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+", -1), ""), lambda x: F.xxhash64(x)),
            "_llm_lines": F.transform(lines, lambda x: F.xxhash64(x)),
            "word_chars": F.length(_without(text, SEPARATORS)).cast("long"),
            "n_symbols": (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("_llm_words").cast("long"),
            "n_dup_lines": (F.size("_llm_lines") - F.size(F.array_distinct("_llm_lines"))).cast("long"),
            "_llm_windows": F.when(
                F.size("_llm_words") >= WINDOW,
                F.transform(
                    F.sequence(F.lit(1), F.size("_llm_words") - (WINDOW - 1)), lambda i: F.xxhash64(*(F.element_at("_llm_words", i + j) for j in range(WINDOW)))
                ),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    # Only texts with a repeated window pay for the sort that finds its places.
    repeats = F.size("_llm_windows") > F.size(F.array_distinct("_llm_windows"))
    placed = F.sort_array(F.transform("_llm_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_llm_placed", F.when(repeats, placed))
    twice = F.transform(
        "_llm_placed",
        lambda e, k: F.when(F.coalesce(F.get("_llm_placed", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("_llm_placed", k + 1)["h"] == e["h"], F.lit(False)), e["i"]),
    )
    out = out.withColumn("_llm_starts", F.sort_array(F.filter(twice, F.isnotnull)))
    # Each start covers words up to the next one, WINDOW at most.
    covered = F.transform("_llm_starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_llm_starts", k + 1) - p, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _keys() -> list[Column]:
    return [F.xxhash64("source").alias("host"), F.xxhash64("text").alias("t")]


def line_table(docs: DataFrame) -> DataFrame:
    """``(host, line, t, chars)``: one row per line of a host and text that has it, with the characters in words.

    Repeated rows and copies of a text add up here; the shares taken of it are those of one.
    """
    every = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), F.length(_without(x, SEPARATORS)).alias("chars")))
    lines = docs.where("text IS NOT NULL").select(*_keys(), F.explode(every).alias("x")).select("host", "t", "x.line", "x.chars").where("chars > 0")
    return lines.groupBy("host", "line", "t").agg(F.sum("chars").alias("chars"))


def frequent_lines(docs: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """``(host, line)`` of the lines above their host's limit. Counts are summed map-side: a line that a third of all
    documents have is one row per task."""
    lines = line_table(docs) if lines is None else lines
    texts = docs.where("text IS NOT NULL").select(*_keys()).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LINE_TEXTS)
    return counts.join(texts, "host").where(100 * F.col("n") > LINE_PERCENT * F.col("texts")).select("host", "line")


def apply_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with its base figures, ``removed_lines`` (hashes of the boilerplate lines it has, null if none) and ``kept``.

    ``kept`` is false if a base rule fails, or if less than ``LEFT_PERCENT`` of the characters in words are outside
    boilerplate lines. Null and empty texts fail by their words. A null ``source`` is a host of its own.
    Repeated rows get equal results; an empty table an empty one. All columns are kept.
    """
    lines = line_table(docs)
    marked = lines.join(frequent_lines(docs, lines).withColumn("boilerplate", F.lit(True)), ["host", "line"], "left")
    verdict = marked.groupBy("host", "t").agg(
        F.sum("chars").alias("chars"), F.sum(F.when(F.col("boilerplate"), F.col("chars"))).alias("gone"), F.collect_list(F.when(F.col("boilerplate"), F.col("line"))).alias("removed_lines")
    )
    verdict = verdict.where("gone > 0").select(
        F.col("host").alias("_llm_host"), F.col("t").alias("_llm_t"), "removed_lines", (100 * (F.col("chars") - F.col("gone")) < LEFT_PERCENT * F.col("chars")).alias("depleted")
    )
    keyed = docs.withColumns({"_llm_h": F.xxhash64("source"), "_llm_x": F.xxhash64("text")})
    figures = base_figures(keyed)
    out = figures.join(verdict, (F.col("_llm_h") == F.col("_llm_host")) & (F.col("_llm_x") == F.col("_llm_t")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_lines", kept.alias("kept"))


def without_boilerplate(ruled: DataFrame) -> DataFrame:
    """The result of ``apply_rules`` with the boilerplate lines taken out of ``text``."""
    left = F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("removed_lines", F.xxhash64(normal_line(x))))
    return ruled.withColumn("text", F.when(F.col("removed_lines").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")))
