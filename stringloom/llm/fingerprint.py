"""Document fingerprints: a threshold-scaled sketch of the hashes of all runs of WIDTH code points.

The sketch keeps every hash below a fixed fraction of the range, so sketches of parts merge by union, and the
share of a small document's hashes that a large one's sketch holds estimates containment, however unequal the
two are. A text with no hash below the threshold keeps its smallest one, so that only equal sets of shingles
give equal sketches of short texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import text_of

WIDTH = 12
#: One hash in so many is kept.
SCALE = 16
#: Rows of a range of ids, and ranges at most: what one task sorts, and spills beyond memory.
RANGE_ROWS, RANGES = 2_000, 10_000


def _mix(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    h = (a * np.uint64(p)) ^ (b + np.uint64(0x9E3779B97F4A7C15))
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def sketch(text: str, scale: int = SCALE) -> np.ndarray:
    """Sorted distinct 32-bit hashes below 2**32 / scale of all WIDTH-shingles (a shorter text is one shingle)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) < WIDTH:
        points = np.concatenate([points, np.full(WIDTH - len(points), 0x110000, np.uint64)])
    two = _mix(points[:-1], points[1:], 0x9FB21C651E98DF25)
    four = _mix(two[:-2], two[2:], 0xD6E8FEB86659FD93)
    eight = _mix(four[:-4], four[4:], 0xA0761D6478BD642F)
    hashes = _mix(eight[:-4], four[8:], 0xE7037ED1A0B428DB)
    hashes = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    kept = hashes[hashes < np.uint32((1 << 32) // scale)]
    return np.unique(kept if len(kept) else hashes.min(keepdims=True))


def encoded(kept: np.ndarray) -> str:
    return base64.b64encode(kept.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def merged(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both < np.uint32((1 << 32) // scale)]
    return low if len(low) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the smaller set of shingles in the larger, 0 to 1."""
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprint_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([encoded(sketch(t)) for t in texts], dtype=object)

    return fingerprint(text)


def edited(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by as many of the first code points of `following`."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows (part, extra, doc_id, text) in which each row's successor by doc_id is the next of its part.

    Ids are cut into ranges at quantiles, which are ids of the table: the row at a cut also goes, as an
    extra, to the range below it, and the first row of all to the last. So the texts are shuffled once.
    Rows with equal ids follow each other by text; a null id comes first.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ranges = min(RANGES, rows.count() // range_rows + 2)
    at = rows.agg(F.min(key).alias("least"), F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10_000).alias("cuts")).first()
    cuts = np.array(sorted({at["least"], *(at["cuts"] or [])} - {None}), np.int64)

    @F.pandas_udf("array<int>")
    def parts(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy()
        part = np.searchsorted(cuts, x, side="right") - 1
        is_cut = cuts[np.maximum(part, 0)] == x if len(cuts) else np.zeros(len(x), bool)
        return pd.Series([[p, (p - 1) % len(cuts)] if c else [p] for p, c in zip(part.tolist(), is_cut.tolist())])

    spread = rows.select("doc_id", "text", F.posexplode(parts(key)).alias("extra", "part"))
    return spread.select("part", (F.col("extra") > 0).alias("extra"), "doc_id", "text").repartition("part").sortWithinPartitions("part", "extra", "doc_id", "text")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None  # (part, extra, doc_id, text, sketch) of the row before
    for batch in batches:
        out = []
        for part, extra, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            own = sketch(text)
            if held and not held[1] and held[0] == part:
                changed = edited(held[3], text)
                print_of_changed = sketch(changed)
                out.append((held[2], len(held[3]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), encoded(held[4]), encoded(print_of_changed), likeness(held[4], print_of_changed), likeness(held[4], own)))
            held = (part, extra, doc_id, text, own)
        yield pa.record_batch([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names=names)


def compared_with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of docs: its fingerprint, that of its edited text, and likenesses to that and to the next row.

    A null text counts as empty, a single row is its own next, an empty table gives no rows. Repeated rows each have
    a row; rows of one doc_id follow each other by text, and lie in one range, as rows without a doc_id do. Texts of
    any length are hashed whole, three at a time in memory; other columns of docs are not read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, range_rows).mapInArrow(_compared, schema)
