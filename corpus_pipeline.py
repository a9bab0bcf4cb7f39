"""A training corpus from ``documents``: language ID, line dedup, near-dedup, packing; each stage is kept as Parquet."""

from __future__ import annotations

from duelkit.llm import language, lines, packing, shingles
from duelkit.llm.common import kept, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is rejected if no language reaches this share of the likelihood.
LEAST_SCORE = 0.5
#: Near-duplicates share this percentage of their 5-word shingles.
SIMILAR = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is found; ``lang`` becomes the language found."""
    model = language.fit(docs.where(~language.held_out()))
    found = language.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks that an earlier document has. A document that loses all its words goes: nothing of it is left."""
    done = lines.dedup_lines(docs)
    left = (F.size("lines_cut") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return done.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the least id (rows without an id go if another row has
    one). Repeated rows of one id and text stay or go together."""
    found = shingles.near_duplicates(docs, SIMILAR).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_key").alias("keep_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & shingles.text_key("text").eqNullSafe(F.col("keep_key"))
    return docs.join(found, same, "left_semi").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every piece, each piece a sequence of its own, and their checksum."""
    return packing.pack(docs, packing.default_path()).drop("row_key")


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("minhash_near_dedup", near_stage), ("packing", packing_stage)]
#: No SQL: every stage needs hashes, a learned model or a tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
