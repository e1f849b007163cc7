"""The corpus pipeline: from `documents` to packed training sequences.

Each stage is one of the operators, works on all that its predecessor kept, and is
written as Parquet and read back before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleworks.llm import decontam, langid, packing, pii, shingles
from candleworks.llm.common import durable, release


#: Bytes of an Arrow batch: tasks in Python hold a few copies of one, and texts are long.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def small_batches(spark: SparkSession) -> None:
    """Settings of the session that the pipeline runs in."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts most of whose letters are in one of the languages of `lang`; texts
    that are null or without letters go."""
    small_batches(spark)
    model = langid.fit(docs)
    return langid.identify(docs, model, only=model.languages, min_score=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: texts that
    share at least 0.8 of their five-word shingles, compared exactly. BK-tree shards of
    SimHash fingerprints find the nearest; such texts lie up to a dozen bits apart, too
    far for shards of agreeing bits, so a search by shingles finds all that these have not
    connected. op5_simhash keeps its own contract. Only rows that may be in a group are
    shuffled."""
    small_batches(spark)
    return shingles.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that do not hold passages of `benchmark`."""
    small_batches(spark)
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), only_clean=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, with personal data replaced by tags and n_chars brought
    up to date."""
    small_batches(spark)
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, keep=["doc_id"])


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: Fingerprints, Viterbi labels, token ids and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = durable(stage(spark, docs, sf_dir))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
