"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases.

Folding lower-cases, turns homoglyphs into Latin letters, and digits or signs next to a letter into the letters
that they stand for; numbers by themselves stay. The lexicon's entries are word beginnings and whole words. They are learnt from labelled
rows: what stands in many different contexts of toxic documents and in hardly any of others. Counting
contexts instead of documents keeps copies of one document from filling the lexicon.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import held_out, text_of, written
from stringloom.llm.ftrl import sigmoid
from stringloom.llm.labelled import labelled_sample

#: Rows of labelled documents to learn from.
SAMPLE = 8_000
THRESHOLD = 0.3
#: An entry stands in so many contexts of toxic documents, and so many times more often there than elsewhere.
CONTEXTS, ODDS = 5, 12.0
#: Entries that need no labels (fixed values): common insults, with the weight of a certain match.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "trash", "clown", "imbecile", "dumbass", "bastard")
SEED_WEIGHT = 3.0
#: Phrases in which a match does not count (fixed values).
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "clownfish", "sore loser", "class clown", "stupidly simple", "idiot proof")
#: Characters that look like Latin letters (fixed values), and digits that stand for letters.
LOOKALIKES = "аaеeоoрpсcхxуyіiјjѕsԁdһhӏlкkмmтtвbнnαaεeοoρpτtυuιiκkνvχxɡgɩiıi"
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_FOLD = {ord(LOOKALIKES[i]): LOOKALIKES[i + 1] for i in range(0, len(LOOKALIKES), 2)} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
_LOOKALIKE = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_SIGNS = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])|[@$](?=[^\W\d_]{2})")
_DIGITS, _LETTERS = re.compile("[0-9]+"), str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W\d_]+")


def _letters(digits: re.Match) -> str:
    """Digits next to a letter as the letters that they stand for."""
    start, end, text = digits.start(), digits.end(), digits.string
    beside = text[start - 1 : start].isalpha() or text[end : end + 1].isalpha()
    return digits.group().translate(_LETTERS) if beside else digits.group()


def fold(text: str) -> str:
    if not text.isascii():
        text = _LOOKALIKE.sub(lambda m: _FOLD[ord(m.group())] or "", unicodedata.normalize("NFKC", text).lower())
    text = text.lower()
    text = _DIGITS.sub(_letters, text)
    if "@" in text or "$" in text:
        text = _SIGNS.sub(lambda m: "a" if m.group() == "@" else "s", text)
    return text


def word_stems(word: str) -> list[str]:
    """The beginnings of 4 to 7 letters and, marked by a blank, the whole word."""
    return [word[:n] for n in range(4, min(8, len(word) + 1))] + [word + " "] * (len(word) >= 3)


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Every entry in CONTEXTS contexts of toxic rows or more whose odds are ODDS or more, with its weight (log odds).

    A context is a word with the words before and after it, counted once however often it stands; it counts for
    all beginnings of the word. What reaches the driver is bounded by the sample, which has a bounded number of rows.
    """

    @F.pandas_udf("array<struct<word: string, context: long>>")
    def occurrences(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            words = _WORD.findall(fold(t))
            around = zip(words, ["", *words], [*words[1:], ""])
            out.append([{"word": w, "context": c} for w, c in {(w, zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass"))) for w, a, b in around}])
        return pd.Series(out)

    @F.pandas_udf("array<string>")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(word_stems)

    found = sample.select((F.col("label") > 0).alias("toxic"), F.explode(occurrences("text")).alias("o")).select("toxic", "o.word", "o.context").distinct()
    words = found.groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    counts = words.select("t", "c", F.explode(stems("word")).alias("stem")).groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = written(counts, "toxic-stems")
    nt, nc = counts.filter(F.length("stem") == 4).agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    odds = ((F.col("t") + 0.5) / (nt + 1)) / ((F.col("c") + 0.5) / (nc + 1))
    rated = counts.filter(F.col("t") >= CONTEXTS).withColumn("weight", F.log(odds)).filter(odds >= ODDS)
    weights = {r["stem"]: r["weight"] for r in rated.collect()}
    # a longer entry says nothing new if a beginning of it has nearly its weight
    return {s: w for s, w in weights.items() if not any(weights.get(s[:n], -9) >= w - 1.0 for n in range(4, len(s)))}


_automata: dict[tuple, ahocorasick.Automaton] = {}


def _automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    """Built once a worker for the last lexicon."""
    if (entries, exceptions) not in _automata:
        found = ahocorasick.Automaton()
        for stem, weight in entries:
            found.add_word(stem.rstrip(" "), (len(stem.rstrip(" ")), weight, stem.endswith(" ")))
        for phrase in exceptions:
            found.add_word(phrase, (len(phrase), None, True))
        found.make_automaton()
        _automata.clear()
        _automata[entries, exceptions] = found
    return _automata[entries, exceptions]


def matches(text: str, entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...] = EXCEPTIONS) -> list[tuple[int, int, float]]:
    """(start, end, weight) in the folded text, the strongest for each word; none within an exception phrase."""
    folded, best, excused = fold(text), {}, []
    if not entries:
        return []
    for end, (length, weight, whole) in _automaton(entries, exceptions).iter(folded):
        start = end - length + 1
        if start and folded[start - 1].isalpha() or whole and end + 1 < len(folded) and folded[end + 1].isalpha():
            continue
        if weight is None:
            excused.append((start, end + 1))
        elif weight > best.get(start, (0, 0.0))[1]:
            best[start] = (end + 1, weight)
    out, reach, at = [], 0, 0
    excused.sort()
    for s, (e, w) in sorted(best.items()):  # one sweep: the farthest end of the phrases that start here or before
        while at < len(excused) and excused[at][0] <= s:
            reach, at = max(reach, excused[at][1]), at + 1
        if e > reach:
            out.append((s, e, w))
    return out


def signals(text: str, entries: tuple[tuple[str, float], ...]) -> tuple[float, float, float]:
    """Weight of the matches, in all and for each word, both as logarithms, and the constant."""
    total = sum(w for _, _, w in matches(text, entries))
    return np.log1p(total), np.log1p(100.0 * total / max(10, len(text.split()))), 1.0


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression of a few signals by Newton steps; without rows of both kinds a fixed scale."""
    if len(set(y.tolist())) < 2:
        return np.array([1.0, 1.0, -4.0])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


def _signals_udf(entries):
    @F.pandas_udf("struct<a: double, b: double, c: double>")
    def both(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signals(t, entries) for t in texts], columns=["a", "b", "c"], dtype="float64")

    return both


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[tuple, np.ndarray]:
    """(lexicon entries, scale): what scored() needs. The driver gets the lexicon and three numbers a sampled row.

    Rows without a label, an id or a label that is null teach nothing; without any, SEED and a fixed scale are the model.
    """
    rows = written(labelled_sample(docs, labels, "toxic", sample), "toxic-sample")
    lexicon = {s: SEED_WEIGHT for s in SEED} | learn_lexicon(rows)
    entries = tuple(sorted(lexicon.items()))
    got = rows.select("label", _signals_udf(entries)("text").alias("s")).select("label", "s.*").collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in got]).reshape(-1, 3)
    return entries, fit_scale(x, np.array([int(r["label"] > 0) for r in got]))


def scored(docs: DataFrame, model: tuple[tuple, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted.

    A null text counts as empty; every row has a score, which depends on its text alone, so repeated rows and
    ties score alike. Texts of any length are scored whole. A null doc_id isn't held out. Columns of docs called
    held_out, score or predicted are replaced; an empty table gives no rows.
    """
    entries, scale = model
    found = _signals_udf(entries)(text_of())
    linear = sum((F.col(f"_signals.{k}") * F.lit(float(w)) for k, w in zip("abc", scale)), F.lit(0.0))
    named = docs.withColumn("held_out", held_out()).withColumn("_signals", found).withColumn("score", 1 / (1 + F.exp(-linear)))
    return named.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("_signals")
