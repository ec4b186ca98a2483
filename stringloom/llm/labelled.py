"""Bounded samples of labelled documents, without the held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import held_out, text_of, written


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """About `rows` rows (doc_id, text, label) of docs that have a label and are not held out.

    Chosen by a hash of doc_id, so reruns agree. The chosen labels are a few more than `rows` at most, which
    bounds their broadcast; the texts are not shuffled. Of several labels of a document the largest counts.
    Labels, ids or documents that are null are left out.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(1, usable.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = written(usable.filter(draw < share), "labelled")
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
