"""The registered queries of this package. Chat formatting, decontamination and hard negatives have SQL; the others' hashes,
tokenizers, signal processing and learned models aren't expressible in it, or too slow on whole tables. tests/llm holds each
against a brute-force version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, interpolation, language, lines, media, negatives, packing, periods, sharding, shingles, syncmers
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.scores(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_path(), with_ids=False).drop("row_key")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(spark, sf_dir)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines before and after, the deleted lines' numbers, and the text that is left."""
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", F.size("lines_cut").alias("n_cut"), "lines_cut", "text")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(table(spark, sf_dir, "conversations"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_report(table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_lm_scoring, op3_packing, op4_language_id, op5_sharding, op6_line_dedup, op7_byte_bpe,
        op8_minhash_near_dedup, op9_chat_formatting, op10_document_fingerprints, op11_benchmark_decontamination,
        op12_hard_negatives, op13_periodic_runs,
    )
}
_ORDER = "OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)"
_LONG = lambda x: f"length(replace(replace({x}, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'))"
_WORDS = lambda x: rf"regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    #: A block's head, blank line and end have 24 characters besides its role; each further turn of it has a mark of 11.
    "op9_chat_formatting": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(i)),
t AS (SELECT *, row_number() {_ORDER} AS n, coalesce(role <> lag(role) {_ORDER}, true) AS starts FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_LONG('text')} + CASE WHEN starts THEN 24 + {_LONG('role')} ELSE 11 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    #: Windows of the benchmark, joined with a document's stretches of as many words.
    "op11_benchmark_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS('text')} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS words FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(p) WHERE len(w) > 0),
seen AS (SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) t(p)),
hits AS (SELECT DISTINCT rid, p, n, item FROM seen JOIN win USING (n, words)),
hit AS (SELECT rid, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT rid, p, n FROM hits), unnest(range(n)) t(k) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)""",
    "op12_hard_negatives": """WITH r AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM r a JOIN r b ON a.row <> b.row WHERE a.vec_id % 100 = 0),
p AS (SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.row, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (row, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
}
