"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. All stages but the last return the columns of ``docs`` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontamination, language_id, mixing, near_copies, token_files
from foliant.llm._tables import documents, new_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a recognizable language go. Learned from the training fold of ``docs`` itself."""
    return language_id.keep_identified(docs, language_id.train(docs.filter(language_id.training_fold(docs))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 5-word shingles >= 0.8) stays: that with the
    smallest doc_id."""
    return near_copies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the files hold them in the order of the mixture."""
    return mixing.in_order(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the mixture's files hold the documents, read back: a row for each
    document with its place in the token stream."""
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs.withColumn("__at", token_files.file_order(docs)), path, order="__at")
    return token_files.token_digests(spark, path)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_ids),
]

#: Language ID, SimHash and the tokenizer have no SQL form; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
