"""A cleaning pipeline for training text, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the docs of the next one.  All stages but the last return the columns of
``documents``.

Defined cases, the same for all stages: a null or empty text is kept as it is until it is
packed (a null text as an empty one); a row without an id takes part where texts are
compared, except in substring dedup, which goes by ids; repeated rows are near copies, of
which one stays (not so null and empty texts); an empty table gives an empty result; very
long texts are worked on whole; further columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repopulse.llm.decontamination import drop_contaminated
from repopulse.llm.near_duplicates import drop_near_duplicates
from repopulse.llm.overlap import kept_in
from repopulse.llm.packing import pack_documents
from repopulse.llm.substring_dedup import drop_duplicate_passages
from repopulse.llm.toxicity import drop_toxic, held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine doesn't reject; learned from the training fold of the labels.

    Without toxic or without clean labels nothing can be learned, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = held_out(F.col("doc_id"))
    return drop_toxic(docs, docs.filter(~held), labels.filter(~held))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (none is smallest), on ties by text hash."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that stand in a document with a smaller id; ``n_chars`` is counted again."""
    return drop_duplicate_passages(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty items have none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in token sequences of fixed length; ties in length go by id, tokens and a hash."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained and approximate stages can't be written as SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept_in(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
