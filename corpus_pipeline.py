"""A corpus pipeline over ``documents``: each stage is one operator, and works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facadelake.llm import byte_bpe, language_crf, line_dedup, mixing, ngram_join
from facadelake.llm.common import read, written
from facadelake.session import tune


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which no learned language holds half of the letters, or that have none."""
    tune(spark)
    return language_crf.accepted(docs, language_crf.train(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents of which nothing is left, too: their lines all stand elsewhere."""
    tune(spark)
    out = line_dedup.dedup_lines(docs)
    left = F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0
    return out.where((F.col("n_lines_removed") == 0) | F.coalesce(left, F.lit(True))).drop("n_lines_removed")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    tune(spark)
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring the domains to their target weights; what is judged clean stays."""
    tune(spark)
    return mixing.mixed(docs, read(spark, sf_dir, "labels"), keep_clean=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the documents that are left, and digests of them and of what they decode to."""
    tune(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode_decode(docs, path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("repeated_lines", repeated_lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

# The stages learn, iterate and merge bytes, which SQL cannot say; tests/llm/test_pipeline.py compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
