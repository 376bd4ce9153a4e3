"""The named queries of the subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facadelake.llm import byte_bpe, fingerprints, html_extract, language_crf, license_scan, mixing, ngram_join, prefix_trie, quality_rules, token_counts, token_store, turn_repair
from facadelake.llm import line_dedup as lines
from facadelake.llm.common import read
from facadelake.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op6_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links of three-word shingles at similarity 0.9."""
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"), k=3, percent=90)


@query(
    "op1_line_dedup",
    """
    WITH l AS (SELECT doc_id, i - 1 AS i, trim(p[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x
               FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL) d, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM l WHERE x <> ''),
    w AS (SELECT a.doc_id, a.i, c.i AS j, a.x || chr(10) || b.x || chr(10) || c.x AS w
          FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.r = a.r + 1 JOIN n c ON a.doc_id = c.doc_id AND c.r = a.r + 2),
    later AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later WHERE k > 1),
    kept AS (SELECT t.doc_id, count(g.i) AS n_lines_removed, string_agg(t.x, chr(10) ORDER BY t.i) FILTER (WHERE g.i IS NULL) AS text
             FROM (SELECT doc_id, i - 1 AS i, p[i] AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL) d,
                   LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)) t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id)
    SELECT d.doc_id, CAST(coalesce(k.n_lines_removed, 0) AS BIGINT) AS n_lines_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeated windows cover."""
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines_removed", "text")


@query("op9_byte_bpe")
def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.encode_decode(read(spark, sf_dir, "documents"), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_token_store")
def token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and digests of all documents' ids, from the blocks read back."""
    path = work_dir(spark, "token-store")
    token_store.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.crc32(token_store.read(spark, path))


@query("op10_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, and their likeness."""
    out = fingerprints.compared(read(spark, sf_dir, "documents"))
    return out.withColumn("edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256)).drop("edited_text")


@query(
    "op7_quality_rules",
    r"""
    WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
    p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, p) AS n FROM p) WHERE n > 1),
    rw AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY doc_id),
    l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x FROM d),
    lw AS (SELECT doc_id, source, text, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS c,
           trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[ \t\x0B\f\r]+', ' ', 'g')) AS norm FROM l),
    lines AS (SELECT * FROM lw WHERE c > 0),
    dl AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM lines GROUP BY doc_id),
    hosts AS (SELECT source, count(DISTINCT text) AS n FROM documents WHERE text IS NOT NULL GROUP BY source),
    lf AS (SELECT source, norm, count(DISTINCT text) AS n FROM lines GROUP BY source, norm),
    boiler AS (SELECT lf.source, norm FROM lf JOIN hosts ON lf.source IS NOT DISTINCT FROM hosts.source WHERE lf.n > 20 AND 100 * lf.n > 2 * hosts.n),
    gone AS (SELECT a.doc_id, sum(c) AS c, sum(c) FILTER (WHERE b.norm IS NOT NULL) AS g FROM lines a LEFT JOIN boiler b ON a.source IS NOT DISTINCT FROM b.source AND a.norm = b.norm GROUP BY a.doc_id),
    f AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
          length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words,
          coalesce(100 * (gone.c - gone.g) < 30 * gone.c, false) AS depleted
          FROM d JOIN w ON d.doc_id = w.doc_id LEFT JOIN dl ON d.doc_id = dl.doc_id LEFT JOIN rw ON d.doc_id = rw.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept FROM b
    """,
)
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdicts of every document."""
    out = quality_rules.apply_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, domain posteriors and fitted rate of every document."""
    _, _, rated = mixing.mixing_rates(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), read(spark, sf_dir, "labels"))
    return rated


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where the id's checksum leaves a remainder other than 2."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_crf.train(docs, where=~F.coalesce(held_out, F.lit(False)))
    return language_crf.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op4_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op5_token_counts")
def counts_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_prefix_trie")
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over the rebuilt conversations."""
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


@query("op12_turn_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    audits, _ = turn_repair.repair(read(spark, sf_dir, "conversations"))
    return audits


@query("op13_license_scan")
def license_scan_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and license labels of every document."""
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))
