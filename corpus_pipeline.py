"""From raw documents to packed training sequences, in five stages that each read what the one before wrote.

Quality classifier (rejected documents go), exact deduplication (one row of equal texts stays), SimHash near
deduplication (one document of each group stays), mixing of sources to target weights (rows are repeated as
often as they are taken), best-fit packing (one row a piece with its place in a sequence).

All stages take null and empty texts as texts without words, texts of any length whole, rows with a null doc_id and
repeated rows as rows of their own, and empty tables; every column of their input but the last stage's comes out
with its name and values, whatever it is called. Ties go by doc_id, null last, then by the row's place in its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stringloom.llm import exact_dedup, packing, quality, simhash, source_mixing
from stringloom.llm.common import written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, gives its threshold or more. Without labels all have 0.5 and go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest; all texts without words are equal."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id; lower-cased words count, so "A b" and "a  B" are copies."""
    return simhash.keep_one(docs, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once or several times, so that sources near their targets; a document without words isn't taken."""
    return source_mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places; the ids themselves are left out, since they can be made again from the text."""
    return packing.packed(packing.tokenised_pieces(docs, keep_ids=False))


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier's weights, the fingerprints and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
