"""The corpus pipeline: stages that each apply one operator to what the one before kept.

A stage takes the rows that its predecessor kept and returns the rows it keeps, with the columns of
``documents``; the last one returns the encoded texts. ``run`` writes each stage's rows to the
shared folder and reads them back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import decontaminate, exact_dedup, language_id, near_dedup, pieces
from topicloom.stash import stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognised with enough confidence."""
    judged = language_id.identify_languages(docs.select(*COLUMNS))
    return judged.where("accepted").select("record.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts, the one with the largest id."""
    return exact_dedup.distinct_texts(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, the one with the smallest id."""
    return near_dedup.distinct_documents(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.find_contamination(docs.select(*COLUMNS), benchmark)
    return judged.where("NOT contaminated").select("record.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text left, checked by decoding them."""
    encoded = pieces.encode_texts(docs.select("doc_id", "text"))
    return encoded.select("record.doc_id", "ids", "n_pieces", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode),
]

# Viterbi segmentation and the latent search are beyond SQL; a test holds run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
