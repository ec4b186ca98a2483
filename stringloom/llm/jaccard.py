"""Links between texts whose sets of shingles have a Jaccard similarity of at least a limit.

Texts of equal sets are one node. Candidates share one of BANDS keys, each made of ROWS minima of the set under
different permutations, so a pair of similarity 0.8 is missed with a probability of (1 - 0.8**ROWS)**BANDS, which is
about 1e-7. Every candidate is confirmed by counting the common shingles. In a bucket all sets are first compared with
the least one, and the links found join sets to components. Where a bucket still holds several components, tasks
compare its sets outside the largest one with all its sets of other components, in blocks of BLOCK sets a side;
they hand on the links alone, one for each two components that they join. So no step makes rows of pairs in a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import join_by_key, text_of, written
from stringloom.llm.components import components

BANDS, ROWS = 40, 5
_random = np.random.default_rng(42)
_FLIP, _TIMES = (_random.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
#: Hashes that are permuted at once.
_BLOCK = 1024
#: Sets of each side that a task compares at once.
BLOCK = 256


def set_digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(np.unique(hashes).astype("<u8").tobytes(), 42)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of 64-bit hashes that isn't empty."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for s in range(0, len(hashes), _BLOCK):
        np.minimum(least, ((hashes[None, s : s + _BLOCK] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    least, keys = least.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in range(ROWS):
        keys = (keys ^ least[:, row]) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys


def _confirmed(pairs: DataFrame, shingles: DataFrame, limit: float) -> DataFrame:
    """Those of pairs (a, b) whose sets have the similarity."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(a, b):
            common = len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))
            return common * 1000 >= ((len(a) + len(b)) // 8 - common) * round(limit * 1000)

        return pd.Series([one(a, b) for a, b in zip(left, right)], dtype=bool)

    def side(end: str, other: str, left: DataFrame) -> DataFrame:
        counts = pairs.groupBy(end).agg(F.count(F.lit(1)).alias(f"n_{end}"))
        right = shingles.select(F.col("set").alias(end), F.col("shingles").alias(f"of_{end}")).join(counts, end)
        return join_by_key(left, right, end, f"n_{end}", F.col(other))

    return side("b", "a", side("a", "b", pairs)).filter(similar("of_a", "of_b")).select("a", "b")


def _block_links(rows: list[tuple[int, int, bool, bool, bytes]], limit: float) -> list[tuple[int, int]]:
    """Links between the loose sets and the others of a block, of rows (set, comp, loose, other, shingles).

    Only sets of different components are compared, and a link makes one component of two.
    """
    others = [r for r in rows if r[3]]
    if not others:
        return []
    tokens, places = np.unique(np.concatenate([np.frombuffer(r[4], "<u8") for r in others]), return_inverse=True)
    sizes = np.array([len(r[4]) // 8 for r in others])
    starts, found, root = np.cumsum(sizes) - sizes, [], {r[1]: r[1] for r in rows}
    comps = np.array([r[1] for r in others])

    def top(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    for own, comp, loose, _, shingles in rows:
        if not loose:
            continue
        mine = np.frombuffer(shingles, "<u8")
        at = np.searchsorted(tokens, mine)
        at = at[(at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == mine)]
        held = np.zeros(len(tokens), np.int64)
        held[at] = 1
        common = np.add.reduceat(held[places], starts)
        for k in np.flatnonzero((common * 1000 >= (sizes + len(mine) - common) * round(limit * 1000)) & (comps != comp)).tolist():
            a, b = top(comp), top(int(comps[k]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((own, others[k][0]))
    return found


def _rest_links(members: DataFrame, near: DataFrame, shingles: DataFrame, limit: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of members (key, set) that share a bucket but no component of near."""
    roots = components(near).select(F.col("node").alias("set"), "root")
    labelled = written(members.join(roots, "set", "left").select("key", "set", F.coalesce("root", "set").alias("comp")), "jaccard-members")
    of_key = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top"))
    mixed = of_key.filter("comps > 1").select("key", F.col("top.comp").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("n_loose"), F.ceil(F.col("all") / block).cast("int").alias("n_all"))
    rows = labelled.join(mixed, "key").withColumn("_mine", F.pmod(F.xxhash64("set", F.lit("loose")), F.col("n_loose")).cast("int")).withColumn("_own", F.pmod(F.xxhash64("set", F.lit("all")), F.col("n_all")).cast("int"))
    loose = F.col("comp") != F.col("top")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda i, j, is_loose, other: F.struct(i.alias("i"), j.alias("j"), is_loose.alias("loose"), F.lit(other).alias("other"))
    # every set meets each block of loose ones; a loose one also goes to the blocks that its own isn't
    as_other = F.transform(numbers("n_loose"), lambda i: cell(i, F.col("_own"), loose & (i == F.col("_mine")), True))
    as_loose = F.transform(F.filter(numbers("n_all"), lambda j: loose & (j != F.col("_own"))), lambda j: cell(F.col("_mine"), j, F.lit(True), False))
    dealt = rows.select("key", "set", "comp", F.inline(F.concat(as_other, as_loose))).join(shingles, "set")
    dealt = dealt.select("key", "i", "j", "set", "comp", "loose", "other", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        out = lambda found: pa.record_batch([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for batch in batches:
            found = []
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (key, i, j):
                    found += _block_links(held, limit)
                    held, at = [], (key, i, j)
                held.append(row)
            yield out(found)
        yield out(_block_links(held, limit))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, prints: DataFrame, limit: float, shingles_of) -> DataFrame:
    """Links (a, b) between fingerprints that connect whatever sets of the similarity connect.

    docs: locator and text; prints: locator, fp, set and bands of each row (set and bands null for a text without words);
    shingles_of: the sorted distinct hashes of a text.
    """
    prints = prints.filter("set is not null")
    sets = written(prints.groupBy("set").agg(F.min("fp").alias("least"), F.min("locator").alias("locator")), "jaccard-sets")
    keys = prints.select("set", F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.min("set").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "a")
    members = written(keys.join(shared, "key").select("key", "a", "set"), "jaccard-buckets")
    wanted = members.select("set").distinct()

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t).astype("<u8").tobytes() for t in texts], dtype=object)

    texts = docs.select("locator", "text").join(wanted.join(sets, "set").select("set", "locator"), "locator")
    shingles = written(texts.select("set", packed(text_of()).alias("shingles")), "jaccard-shingles")
    first = written(members.filter("set != a").select("a", F.col("set").alias("b")).distinct(), "jaccard-pairs")
    near = written(_confirmed(first, shingles, limit), "jaccard-links")
    near = near.unionByName(written(_rest_links(members.select("key", "set"), near, shingles, limit), "jaccard-links"))
    for end in ("a", "b"):
        near = near.join(sets.select(F.col("set").alias(end), F.col("least").alias(f"{end}_fp")), end)
    same = prints.join(sets.select("set", "least"), "set").filter("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return near.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).unionByName(same).filter("a != b").distinct()
