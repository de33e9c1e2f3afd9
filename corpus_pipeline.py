"""A corpus pipeline: five filtering and rewriting stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import forget, stored
from gridloom.llm.decontam import drop_contaminated
from gridloom.llm.line_dedup import drop_frequent_lines
from gridloom.llm.near_copies import drop_near_copies
from gridloom.llm.queries import SP_MODEL
from gridloom.llm.sp_tokens import encode_texts
from gridloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3; the model is fitted on labelled documents of this stage's input."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that ten documents or more have; n_chars follows the text."""
    kept = drop_frequent_lines(docs, min_docs=10, counts=("__lines", "__dropped"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near copies: five-word Jaccard 0.8 or more.

    SimHash fingerprints and pigeonring filtering give the first links, prefix filtering those beyond their radius.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), error_rate=0.05)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its tokens; decoding them and SentencePiece itself confirm them."""
    return encode_texts(docs, SP_MODEL)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: The first stage's model has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; the table before it goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
