"""Corpus pipeline over ``documents``: language ID, line dedup, near-dedup,
decontamination, BPE. Counts as part of the ``revlens.llm`` subpackage.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that reads all rows its
predecessor kept; ``run`` writes each result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import bpe, decontam, langid, line_dedup, near_dup
from revlens.llm.text import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the texts in which no language can be found (null, or without a letter).
    Prototypes come from the stage's own rows (three of four folds)."""
    profiles = langid.fit(docs.where(langid.fold(4) != 2))
    return langid.identify(docs, profiles).where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines of recurring templates but their first; documents of which only
    blank lines are left go, n_chars follows the text."""
    out = line_dedup.deduplicate(docs.select(*COLUMNS))
    left = F.regexp_like("kept_text", F.lit(r"[^\x20\x09-\x0D]"))
    return (out.where((F.col("n_dropped") == 0) | left)
            .withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars")))
            .withColumn("text", F.col("kept_text")).select(*COLUMNS))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class; rows with a null doc_id have no class and stay."""
    classes = near_dup.near_duplicates(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(classes, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.contaminated(docs, benchmark).where(F.size("hits") == 0).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary())


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dup", near_dup_stage),
          ("decontamination", decontamination_stage), ("bpe", bpe_stage)]

# Hyperdimensional profiles, signatures and BPE have no SQL form; tests compare each
# stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
