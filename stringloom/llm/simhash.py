"""SimHash near-duplicates: 64-bit fingerprints linked at a Hamming distance of at most 3 by pigeonring filtering.

Four segments of 16 bits stand in a ring. If two fingerprints differ in at most 3 bits, there is a segment
from which every chain of l consecutive segments differs in at most l * 3 / 4 bits: 0, 1, 2 and 3. So from
some segment on, the first is equal, one half of the second is equal, and one third of the third is equal.
These (start, half, third) combinations are 24 join keys of about 29 bits, which keep buckets small; in a
bucket the chains are checked in order before the full distance. A bucket gives a spanning forest of its
links, never all pairs; one with more fingerprints than MAX_BUCKET is linked through balls of radius 1 and 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm import jaccard
from stringloom.llm.common import free_name, join_by_key, text_of, with_locator, written
from stringloom.llm.components import components

#: Distinct fingerprints of a bucket that one task links by itself.
MAX_BUCKET = 65_536
#: The three parts of a 16-bit segment: shift and mask.
THIRDS = ((0, 0x1F), (5, 0x1F), (10, 0x3F))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `width` words, repeats included; fewer words make one shingle, none makes none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z and splits at 0x20 and 0x09-0x0D only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, len(words) - width + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(shingle_hashes(t, width)) for t in texts], np.uint64).view(np.int64))

    return fingerprint(text)


def signature_column(text: Column, width: int) -> Column:
    """fp, and the digest and band keys of the set of shingles (null without words)."""

    @F.pandas_udf("fp long, set long, bands array<long>")
    def signature(texts: pd.Series) -> pd.DataFrame:
        fps, sets, bands = [], [], []
        for t in texts:
            hashes = shingle_hashes(t, width)
            fps.append(simhash(hashes))
            sets.append(int(np.uint64(jaccard.set_digest(hashes)).view(np.int64)) if len(hashes) else None)
            bands.append(jaccard.band_keys(hashes).view(np.int64) if len(hashes) else None)
        return pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "set": pd.array(sets, "Int64"), "bands": pd.Series(bands, dtype=object)})

    return signature(text)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF))


def candidate_keys(fp: Column) -> Column:
    """The 24 keys: number of the combination above 32 bits, then the equal bits."""
    keys = []
    for i in range(4):
        first, second, third = _segment(fp, i), _segment(fp, i + 1), _segment(fp, i + 2)
        for half in range(2):
            for t, (shift, mask) in enumerate(THIRDS):
                part = F.shiftright(second, 8 * half).bitwiseAND(F.lit(0xFF))
                piece = F.shiftright(third, shift).bitwiseAND(F.lit(mask))
                bits = F.shiftleft(first, 14).bitwiseOR(F.shiftleft(part, 6)).bitwiseOR(piece)
                keys.append(F.lit((i * 6 + half * 3 + t) << 32).bitwiseOR(bits.cast("long")))
    return F.array(*keys)


def _rotated(fps: np.ndarray, start: int) -> np.ndarray:
    """Segment `start` as the lowest 16 bits, the next ones of the ring above it."""
    if not start:
        return fps
    return (fps >> np.uint64(16 * start)) | (fps << np.uint64(64 - 16 * start))


def _near(differing: np.ndarray) -> np.ndarray:
    """Which of the rotated differences pass the chains of 1, 2 and 3 segments and then the full check."""
    at = np.flatnonzero((differing & np.uint64(0xFFFF)) == 0)
    for bits, budget in ((32, 1), (48, 2), (64, 3)):
        chain = differing[at] & np.uint64((1 << bits) - 1)
        at = at[np.bitwise_count(chain) <= budget]
    return at


def bucket_links(fps: np.ndarray, start: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links that the bucket's chains show, as (from, to) arrays."""
    rotated, rest = _rotated(fps, start), np.arange(len(fps))
    froms, tos = [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            at = _near(rotated[rest] ^ rotated[x])
            if len(at):
                found = rest[at]
                froms.append(np.full(len(found), fps[x], np.uint64))
                tos.append(fps[found])
                queue += found.tolist()
                rest = np.delete(rest, at)
    return froms, tos


def _link_runs(batches: Iterator[pa.RecordBatch], largest: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key to links (a, b); rows of a bucket over `largest` come back as (fp, null)."""

    def out(froms, tos, hot):
        a = np.concatenate([*froms, *hot]) if froms or hot else np.empty(0, np.uint64)
        b = np.concatenate(tos).view(np.int64) if tos else np.empty(0, np.int64)
        n_hot = sum(map(len, hot))
        return pa.record_batch([pa.array(a.view(np.int64)), pa.concat_arrays([pa.array(b), pa.nulls(n_hot, pa.int64())])], names=["a", "b"])

    keys, fps, too_large = np.empty(0, np.int64), np.empty(0, np.uint64), None

    def runs(keys, fps, final):
        """Links of all runs that are complete; gives back what may go on."""
        nonlocal too_large
        edges = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
        froms, tos, hot, kept = [], [], [], len(keys)
        done = len(starts) if final else len(starts) - 1
        for s, e in zip(starts[:done].tolist(), ends[:done].tolist()):
            if e - s == 1 and too_large != keys[s]:
                continue
            if too_large == keys[s] or e - s > largest:
                too_large = keys[s]
                hot.append(fps[s:e])
                continue
            f, t = bucket_links(fps[s:e], int(keys[s] >> 32) // 6)
            froms += f
            tos += t
        if not final:
            kept = int(starts[-1])
            if len(keys) - kept > largest or too_large == keys[-1]:  # this bucket is already too large: its rows need not be held
                too_large = keys[-1]
                hot.append(fps[kept:])
                kept = len(keys)
        return out(froms, tos, hot), keys[kept:], fps[kept:]

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(keys):
            rows, keys, fps = runs(keys, fps, False)
            yield rows
    if len(keys):
        yield runs(keys, fps, True)[0]


def _ball_links(hot: DataFrame) -> DataFrame:
    """All links between the fingerprints of hot, through the values z within 1 of one end and 2 of the other.

    A fingerprint has 65 values within 1 and 2081 within 2, so work and groups are bounded per row.
    """
    near = [0] + [1 << i for i in range(64)]
    wide = near + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = lambda masks: F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    moved = lambda masks: F.explode(F.transform(signed(masks), lambda m: F.col("fp").bitwiseXOR(m))).alias("z")
    hubs = hot.select("fp", moved(near)).groupBy("z").agg(F.min("fp").alias("a"))
    return hot.select(F.col("fp").alias("b"), moved(wide)).join(hubs, "z").filter("a != b").select("a", "b")


def links(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect whatever chains of links connect."""
    found = (
        fps.select("fp", F.explode(candidate_keys(F.col("fp"))).alias("key"))
        .select("key", "fp")
        .repartition("key").sortWithinPartitions("key", "fp")
        .mapInArrow(lambda it: _link_runs(it, max_bucket), "a long, b long")
    )
    found = written(found, "simhash-links")
    direct = found.filter("b is not null").distinct()
    hot = written(found.filter("b is null").select(F.col("a").alias("fp")).distinct(), "simhash-hot")
    return direct.unionByName(_ball_links(hot)) if hot.head(1) else direct


def near_groups(docs: DataFrame, width: int = 3, max_bucket: int = MAX_BUCKET, similarity: float | None = None) -> DataFrame:
    """One row per row of docs: locator, doc_id, fp, component_id (the smallest doc_id reachable over links).

    Null and empty texts have the fingerprint 0 and are linked like any other. A null doc_id keeps its row,
    and its group's id is the smallest id that is not null (null if there is none). Equal fingerprints are
    one node, so copies cost no links. Repeated rows each have a row. An empty table gives no rows. Texts of any
    length are hashed whole; other columns of docs are not read, so their names may clash.
    With a similarity, texts whose sets of shingles have that Jaccard similarity are linked too, whatever
    their distance.
    """
    source = with_locator(docs.select("doc_id", "text"), "locator")
    if similarity is None:
        prints = written(source.select("locator", "doc_id", fingerprint_column(text_of(), width).alias("fp")), "simhash-fingerprints")
    else:
        signed = written(source.select("locator", "doc_id", signature_column(text_of(), width).alias("_s")).select("locator", "doc_id", "_s.*"), "simhash-fingerprints")
        prints = signed.select("locator", "doc_id", "fp")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    found = links(nodes.select("fp"), max_bucket)
    if similarity is not None:
        found = found.unionByName(jaccard.links(source, signed, similarity, lambda text: np.unique(shingle_hashes(text, width))))
    roots = written(components(found), "simhash-roots").select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = join_by_key(rooted.select("fp", "n", "root"), ids, "root", "members", F.col("fp"))
    return join_by_key(prints, written(named.select("fp", "n", "component_id"), "simhash-components"), "fp", "n", F.col("locator"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """The rows of docs with the smallest doc_id of their group; of repeated rows the one with the smallest locator.

    Rows without words are all near each other and leave one row. Columns keep their names and values, whatever they
    are called; nulls, long texts and empty tables are treated as near_groups() says.
    """
    name, columns = free_name(docs, "_locator"), docs.columns
    kept = (
        near_groups(docs, width, similarity=similarity)
        .withColumn("component_id", F.coalesce("component_id", F.col("fp")))
        .groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")).alias("first"))
        .select(F.col("first.locator").alias(name))
    )
    return with_locator(docs, name).join(kept, name, "left_semi").select(*columns)
