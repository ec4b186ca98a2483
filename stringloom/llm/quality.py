"""Quality classifier: hashed word n-gram logistic regression trained with FTRL updates, scored as sparse dot products.

Words are runs of letters and digits, and runs of other signs. Features are the n-grams of one to three words,
and those of one to three words reduced to their shape (case, length class, repetition of the word before;
signs stay as they are), which carry over to words that training never saw. A word is hashed once a text, and
the n-grams are mixed from the words' hashes by array arithmetic. Values are log term frequencies, and each of
the two kinds is normalised to length 1, so a text's length alone says nothing.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import held_out, text_of
from stringloom.llm.ftrl import FTRL, sigmoid
from stringloom.llm.labelled import labelled_sample

DIMS = 1 << 18
#: Rows of labelled documents to train on, and models that are trained on parts of them and averaged.
SAMPLE, SHARDS, EPOCHS = 16_000, 4, 4
THRESHOLD = 0.7
_WORD = re.compile(r"\w+|[^\w\s]+")


def shape(word: str) -> str:
    if not (word[0].isalnum() or word[0] == "_"):
        return word[:3]
    case = "d" if word.isdigit() else "l" if word.islower() else "u" if word.isupper() and len(word) > 1 else "t" if word.istitle() else "m"
    return case + str(min(len(word), 16) // 4)


def _grams(hashes: np.ndarray, first: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (`number` ones from `first` on) and normalised values of the n-grams of one to three of the hashed words."""
    grams, own = [], hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(first)
    for n in range(1, min(3, len(hashes)) + 1):
        mixed = own[: len(own) - n + 1]
        for k in range(1, n):
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + own[k : len(own) - n + 1 + k]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        grams.append((mixed ^ (mixed >> np.uint64(31))) % np.uint64(number) + np.uint64(first))
    at, counts = np.unique(np.concatenate(grams) if grams else np.empty(0, np.uint64), return_counts=True)
    values = np.log1p(counts)
    return at.astype(np.int64), values / max(1e-12, float(np.sqrt(values @ values)))


def features(text: str, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and their values: 0 is the constant, which an empty text has alone, then come words, then shapes."""
    words = _WORD.findall(text)
    known: dict[str, tuple[int, int]] = {}
    for w in words:
        if w not in known:
            known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")), zlib.crc32(shape(w).encode("utf-8", "surrogatepass"))
    hashes = np.array([known[w] for w in words], np.uint64).reshape(-1, 2)
    shapes = hashes[:, 1].copy()
    shapes[1:][hashes[1:, 0] == hashes[:-1, 0]] = 0  # the word before again
    half = dims // 2
    a, x = _grams(hashes[:, 0], 1, half - 1)
    b, y = _grams(shapes, half, dims - half)
    return np.concatenate([[0], a, b]), np.concatenate([[0.3], x, y])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, epochs: int = EPOCHS, dims: int = DIMS) -> np.ndarray:
    """The weights. Each shard of the sample trains a model in a task of its own, and the weights are averaged.

    The driver gets at most `dims` weights. Rows without a label, an id or a label that is null teach nothing;
    without any, all weights are 0 and every score is 0.5.
    """

    def one_model(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        data = [(*features(t, dims), int(y > 0)) for t, y in zip(rows["text"], rows["label"])]
        model, rng = FTRL(dims), np.random.default_rng(7)
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                model.update(*data[k])
        w = model.weights()
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at]})

    rows = labelled_sample(docs, labels, "quality", sample).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    models = rows.groupBy("shard").applyInPandas(one_model, "at long, w double")
    weights = np.zeros(dims)
    for r in models.groupBy("at").agg(F.sum("w").alias("w")).collect():
        weights[r["at"]] = r["w"] / shards
    return weights


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted.

    A null text counts as empty; every row has a score, which depends on its text alone, so repeated rows and
    ties score alike. Texts of any length are scored whole. A null doc_id isn't held out. Columns of docs called
    held_out, score or predicted are replaced; an empty table gives no rows.
    """
    dims = len(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at, values = features(t, dims)
            out.append(sigmoid(float(weights[at] @ values)))
        return pd.Series(out, dtype="float64")

    named = docs.withColumn("held_out", held_out()).withColumn("score", score(text_of()))
    return named.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier does not reject, with all its columns."""
    columns = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"), "doc_id", "text")
    return scored(row, weights, threshold).filter("predicted = 1").select("row.*")
