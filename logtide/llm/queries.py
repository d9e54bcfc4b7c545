"""The operators of this package as queries over the supplied tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logtide.llm import (
    credentials, exact_dedup, factor_model, katz, line_chunks, line_frequency, packing, periodic_runs, pseudonyms, simhash,
    token_alignment, token_files, trie_bpe,
)
from logtide.llm.texts import documents

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    LLM_QUERIES[function.__name__] = function
    return function


@query
def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(documents(spark, sf_dir))


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(documents(spark, sf_dir))


@query
def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), report=True)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query
def op5_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op6_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_scan(documents(spark, sf_dir))


@query
def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_model.quality_scores(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    )


@query
def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.drop_shared_lines(documents(spark, sf_dir).select("doc_id", "text"), report=True)


@query
def op9_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encoded_and_decoded(documents(spark, sf_dir))


@query
def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality_report(documents(spark, sf_dir))


@query
def op11_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir), order=2, folds=5, fold=1)


@query
def op12_identity_map_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda text: F.when(text == "", "").otherwise(F.sha2(text, 256))
    return token_alignment.alignments(documents(spark, sf_dir), groups=digest).withColumnRenamed("groups", "groups_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten, by its id's crc32, the words from one place on repeat a period."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    planted = F.expr("""
        concat(slice(words, 1, CAST(a AS INT)), slice(flatten(array_repeat(
            slice(words, CAST(a AS INT) + 1, CAST(p AS INT)), CAST(ceil((n - a) / p) AS INT)
        )), 1, CAST(n - a AS INT)))
    """)
    return (
        cut.withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
        .withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
        .select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    )


@query
def op13_multiscale_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(documents(spark, sf_dir)))
    greatest = F.expr("""
        reduce(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>),
            (m, r) -> CASE WHEN m IS NULL OR r.length * m.period > m.length * r.period THEN r ELSE m END)
    """)
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("top", greatest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )


LLM_ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
""",
    "op10_line_frequency": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d
), filled AS (
  SELECT doc_id, host, t, line,
         array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), above AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM filled GROUP BY ALL)
  JOIN (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host) USING (host)
  WHERE n > 20 AND n > 0.05 * docs
), removed AS (
  SELECT doc_id, sum(n)::BIGINT AS words_removed FROM filled JOIN above USING (host, norm) GROUP BY doc_id
), dups AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM filled GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k)
  GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(words_removed, 0) AS words_removed
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT *, base_failed IS FALSE AND n_words - words_removed >= 0.5 * n_words AS kept FROM (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
""",
}
