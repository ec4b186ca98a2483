"""k-mer similarity, search with mismatches, and design of probes, over whole texts.

All of it is equi-joins on k-mers: counts per text for similarity, exact seeds for search with mismatches (of
m + 1 pieces of a probe at least one stands unchanged wherever it matches with m mismatches).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stringloom.operators import blocks
from stringloom.operators.intervals import merged, reverse_complement
from stringloom.operators.storage import stored

#: Rows of a set that is broadcast after they have been counted.
FEW = 1_000_000
#: Probes of the best buckets that are broadcast.
COVER_FEW = 10_000
#: Slots of k-mers by which those that can't count are left out.
SLOT_BITS = 22
#: Characters whose k-mers are counted at once, or one text.
_AT_ONCE = 1 << 22


def _windows(c: Column, k: Column | int) -> Column:
    """All substrings of k characters, in order, in one pass over the text. The second part skips the middle of a surrogate pair."""
    k = F.lit(str(k)) if isinstance(k, int) else k.cast("string")
    return F.regexp_extract_all(c, F.concat(F.lit("(?s)(?=(.{"), k, F.lit("}))(?![\\x{DC00}-\\x{DFFF}])")), F.lit(1))


def kmer_set(texts: Column, k: int) -> Column:
    """The k-mers of an array of texts, without repeats."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda x: _windows(x, k))))


def kmer_counts(items: DataFrame, key: str, data: str, k: int, alphabet: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """key, kmer, n; with an alphabet only k-mers of its characters count, with known (kmer) only those. Shorter texts have none."""
    rows = items.select(key, F.explode(_windows(F.col(data), k)).alias("kmer"))
    if known is not None:
        rows = rows.join(known, "kmer", "left_semi")
    if alphabet:
        rows = rows.filter(F.col("kmer").rlike(f"^[{alphabet}]*$"))
    return rows.groupBy(key, "kmer").agg(F.count(F.lit(1)).alias("n"))


def relatives(source: DataFrame, target: DataFrame, key: str, data: str, k: int, scale: str = "source", **options) -> DataFrame:
    """(source, target, score, relative): k-mers in common, each as often as it stands in both.

    relative divides by the number of k-mers of the source, the target, the shorter (min) or the longer (max) of
    them. Pairs without a common k-mer are absent. The sources should be a stated set of queries: only those k-mers
    of the targets that a source has are counted and shuffled, by a broadcast of the sources' k-mers up to FEW of them.
    """
    counted = stored(kmer_counts(source, key, data, k, **options), "kmers")
    a = counted.select(F.col(key).alias("source"), "kmer", F.col("n").alias("_a"))
    known = counted.select("kmer").distinct()
    known = F.broadcast(known) if counted.count() <= FEW else known
    b = kmer_counts(target, key, data, k, known=known, **options).select(F.col(key).alias("target"), "kmer", F.col("n").alias("_b"))
    scores = b.join(a, "kmer").groupBy("source", "target").agg(F.sum(F.least("_a", "_b")).alias("score"))
    size = lambda df, name: df.select(F.col(key).alias(name), F.char_length(data).alias(f"_{name}"))
    rows = scores.join(size(source, "source"), "source").join(size(target, "target"), "target")
    length = {"source": F.col("_source"), "target": F.col("_target"), "min": F.least("_source", "_target"), "max": F.greatest("_source", "_target")}[scale]
    return rows.select("source", "target", "score", (F.col("score") / (length - k + 1)).alias("relative"))


def best_relatives(scored: DataFrame, most: int, by: str = "score") -> DataFrame:
    """The `most` best targets of each source with their rank; of equal ones the one with the larger id first."""
    order = Window.partitionBy("source").orderBy(F.desc(by), F.desc("target"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mismatches(a: Column, b: Column) -> Column:
    """Places in which two strings of equal length differ."""
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))


def probe_pieces(probes: DataFrame, key: str, data: str, most: int) -> DataFrame:
    """key, probe, seed, shift: most + 1 pieces of each probe, none of which overlap."""
    texts = probes.select(F.col(key).alias("probe_id"), F.col(data).alias("_text"))
    n = F.char_length("_text")
    number = F.least(F.lit(most + 1), F.greatest(n, F.lit(1)))
    at = lambda i: F.call_function("div", i * n, number).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), number - 1), lambda i: F.struct(F.substring(F.col("_text"), at(i) + 1, at(i + 1) - at(i)).alias("seed"), at(i).alias("shift")))
    return texts.select("probe_id", F.col("_text"), F.inline(pieces)).withColumnRenamed("_text", "probe")


def probe_match(probes: DataFrame, probe_key: str, probe: str, items: DataFrame, key: str, data: str, most: int, seed_length: int = 12) -> DataFrame:
    """All places where a probe stands in a text with at most `most` differing characters.

    Returns probe_id, key, position (from 1) and mismatches. Seeds are the first seed_length characters of the
    pieces (all of a shorter piece). The texts' windows meet a seed by an equi-join, so a text is compared
    only where a seed stands; every place with at most `most` mismatches has such a seed. Probes longer than
    the text, empty and null ones have no place.
    """
    pieces = probe_pieces(probes.filter(F.char_length(probe) > 0), probe_key, probe, most)
    pieces = pieces.withColumn("seed", F.left("seed", F.lit(seed_length))).withColumn("_k", F.char_length("seed"))
    lengths = pieces.select("_k").distinct()
    # a probe set has few lengths of seeds, seed_length at most: one row a text and length before the windows are cut
    windows = (
        items.select(key, data).join(F.broadcast(lengths))
        .select(key, "_k", F.posexplode(_windows(F.col(data), F.col("_k"))).alias("_at", "seed"))
        .join(pieces, ["_k", "seed"])
        .select(key, "probe_id", (F.col("_at") - F.col("shift") + 1).alias("position"))
        .filter("position > 0").distinct()
    )
    found = windows.join(probes.select(F.col(probe_key).alias("probe_id"), F.col(probe).alias("_probe")), "probe_id").join(items.select(key, F.col(data).alias("_data")), key)
    piece = F.substring(F.col("_data"), F.col("position"), F.char_length("_probe"))
    return (
        found.filter(F.char_length("_data") - F.col("position") + 1 >= F.char_length("_probe"))
        .withColumn("mismatches", mismatches(piece, F.col("_probe"))).filter(F.col("mismatches") <= most)
        .select("probe_id", key, "position", "mismatches")
    )


def prepared(items: DataFrame, key: str, data: str, gaps: str = "-.") -> DataFrame:
    """key, bases (data without gaps, in upper case, U as T) and columns: of each base its column (from 1) in the data."""
    chars = F.filter(F.split(F.col(data), ""), lambda ch: ch != "")
    kept = F.filter(F.transform(chars, lambda ch, i: F.struct(ch.alias("ch"), (i + 1).alias("at"))), lambda x: F.instr(F.lit(gaps), x["ch"]) == 0)
    bases = F.translate(F.upper(F.translate(F.col(data), gaps, "")), "U", "T")
    return items.select(key, bases.alias("bases"), F.transform(kept, lambda x: x["at"]).alias("columns"))


#: What a bond of two letters is worth, probe's letter first, and what a place counts at least (fixed values).
BONDS = {
    "AA": 0.0, "AC": 0.0, "AG": 0.5, "AT": 1.1, "CA": 0.0, "CC": 0.0, "CG": 1.5, "CT": 0.0,
    "GA": 0.5, "GC": 1.5, "GG": 0.4, "GT": 0.9, "TA": 1.1, "TC": 0.0, "TG": 0.9, "TT": 0.0,
}


def bond_loss(bonds: dict[str, float] | None = None) -> dict[str, float]:
    """Of each two letters how much weaker the probe's letter binds than the one that fits it: the best bond of the row less the bond."""
    bonds, pair = bonds or BONDS, {"A": "T", "C": "G", "G": "C", "T": "A"}
    return {a + b: max(0.0, bonds[a + pair[a]] - bonds[a + pair[b]]) for a in "ACGT" for b in "ACGT"}


def probe_hits(
    probes: DataFrame, probe_key: str, probe: str, items: DataFrame, key: str, data: str, most: int,
    reverse: bool = False, ignored: int = 0, limit: int = 4, ambiguous: str = "N.", loss: dict[str, float] | None = None, shortest: int = 10,
) -> DataFrame:
    """Places of probes in prepared data with their mismatches: probe_id, reverse, key, position, mismatches, n_mismatches, weighted, piece.

    Letters of `ambiguous` in the data are counted apart; of fewer than `limit` of them `ignored` ones cost nothing.
    A place is a hit if what is left of them and the other mismatches are `most` at most, which may be half the
    probe's length at most. With reverse the reverse complements are searched too. weighted sums the loss of the
    bonds by place. Probes shorter than `shortest` are left out. All places are found: pieces of a short probe that stand
    unchanged are so short that they stand nearly everywhere, so blocks of probes are held against blocks of texts.
    """
    usable = probes.filter((F.char_length(probe) >= shortest) & (F.char_length(probe) >= 2 * most))
    both = usable.select(F.col(probe_key).alias("probe_id"), F.lit(False).alias("reverse"), F.col(probe).alias("_probe"))
    if reverse:
        both = both.unionByName(usable.select(F.col(probe_key).alias("probe_id"), F.lit(True).alias("reverse"), reverse_complement(F.col(probe)).alias("_probe")))
    hits = blocks.probe_places(both, "_probe", items, key, data, most, ignored, limit, ambiguous)
    weight = weighted_mismatches(F.col("_probe"), F.col("piece"), loss or bond_loss())
    return hits.select("probe_id", "reverse", key, "position", "mismatches", "n_mismatches", weight.alias("weighted"), F.col("_probe").alias("probe"), "piece")


def hit_order(key: str, weighted: bool = False) -> list[Column]:
    """How hits are listed: by mismatches, ambiguous letters, weight, place and item; or by weight first."""
    by = ["weighted", "mismatches", "n_mismatches"] if weighted else ["mismatches", "n_mismatches", "weighted"]
    return [F.asc(c) for c in (*by, "position", key)]


def hit_overlay(probe: Column, piece: Column, same: str = "=") -> Column:
    """The piece as it is shown under its probe: `same` where they agree, else the piece's letter."""
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.array_join(F.zip_with(chars(probe), chars(piece), lambda x, y: F.when(x == y, same).otherwise(F.coalesce(y, F.lit("")))), "")


def overlaid(items: DataFrame, key: str, data: str, hits: DataFrame, mark: str = "x", free: str = ".") -> DataFrame:
    """key and a line as long as the item's data with `mark` where a hit (key, position, probe) stands, `free` elsewhere."""
    spans = hits.select(key, F.col("position").alias("start"), (F.col("position") + F.char_length("probe") - 1).alias("stop")).distinct()
    # disjoint spans, so an item has no more of them than half its length
    apart = F.array_sort(F.collect_list(F.struct("start", "stop")))
    rows = items.select(key, F.char_length(data).alias("_n")).join(merged(spans, key, bin_size=1 << 16).groupBy(key).agg(apart.alias("_spans")), key)
    before = F.transform("_spans", lambda s, i: s["start"] - F.when(i > 0, F.get("_spans", i - 1)["stop"]).otherwise(0) - 1)
    pieces = F.zip_with("_spans", before, lambda s, n: F.concat(F.repeat(F.lit(free), n.cast("int")), F.repeat(F.lit(mark), (s["stop"] - s["start"] + 1).cast("int"))))
    return rows.select(key, F.rpad(F.array_join(pieces, ""), F.col("_n"), F.lit(free)).alias("overlay"))


def weighted_mismatches(probe: Column, piece: Column, bond: dict[str, float], first: float = 0.3, second: float = 1.0) -> Column:
    """Sum over the differing places of the bond value of the two letters (key `xy`) times the weight of the place.

    The weight is p (n - 1 - p) / (n - 1)^2 * 4 * second + first for place p of n.
    """
    n = F.char_length(probe)
    pairs = F.arrays_zip(F.filter(F.split(probe, ""), lambda c: c != "").alias("a"), F.filter(F.split(piece, ""), lambda c: c != "").alias("b"))
    values = F.create_map(*[x for k, v in bond.items() for x in (F.lit(k), F.lit(float(v)))])

    def one(x: Column, p: Column) -> Column:
        weight = p * (n - 1 - p) / F.greatest((n - 1) * (n - 1), F.lit(1)) * 4 * second + first
        return F.when(x["a"] == x["b"], F.lit(0.0)).otherwise(F.coalesce(F.try_element_at(values, F.concat(x["a"], x["b"])), F.lit(1.0)) * weight)

    return F.aggregate(F.transform(pairs, one), F.lit(0.0), lambda s, x: s + x)


def accepted_ambiguous(ambiguous: Column, plain: Column, most: int, ignored: int = 1, limit: int = 4) -> Column:
    """Ambiguous places below the limit count less the ignored ones; accepted if they and the plain mismatches fit."""
    counted = F.when(ambiguous < limit, F.greatest(ambiguous - ignored, F.lit(0))).otherwise(ambiguous)
    return counted + plain <= most


def gc_content(c: Column) -> Column:
    """How many letters are G or C. Both cases are listed, since upper case can make two letters of one."""
    return F.char_length(c) - F.char_length(F.translate(c, "GCgc", ""))


def melting_temperature(c: Column) -> Column:
    """4 for each G or C, 2 for each A, T or U."""
    at = F.char_length(c) - F.char_length(F.translate(c, "ATUatu", ""))
    return 4 * gc_content(c) + 2 * at


def _numbered(letters: np.ndarray, k: int) -> np.ndarray:
    """Of each place a number that two places have in common if and only if their k characters are the same."""
    found = np.unique(letters)
    values, size, n = np.searchsorted(found, letters), len(found), 1
    while n < k:
        if size > 1 << 31:
            found = np.unique(values)
            values, size = np.searchsorted(found, values), len(found)
        # the next characters may overlap those before
        step = min(n, k - n)
        values, size, n = values[:-step] * size + values[step:], size * size, n + step
    return values


def _slots(letters: np.ndarray, k: int) -> np.ndarray:
    """Of each place a slot of its k characters, the same one wherever they stand."""
    values, n = letters.astype(np.uint64) + np.uint64(1), 1
    while n < k:
        step = min(n, k - n)
        values = (values[:-step] * np.uint64(0x9E3779B97F4A7C15)) ^ (values[step:] * np.uint64(0xC2B2AE3D27D4EB4F))
        values, n = values ^ (values >> np.uint64(31)), n + step
    return (values * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def _strings(letters: np.ndarray, k: int) -> pa.Array:
    """Rows of k characters as strings."""
    if letters.dtype == np.uint8:
        return pa.StringArray.from_buffers(len(letters), pa.py_buffer(np.arange(len(letters) + 1, dtype=np.int32) * np.int32(k)), pa.py_buffer(np.ascontiguousarray(letters)))
    whole = np.ascontiguousarray(letters).tobytes().decode("utf-32-le")
    return pa.array([whole[i:i + k] for i in range(0, len(whole), k)], pa.string())


def _counts_at_once(texts: list[str], k: int, wanted: np.ndarray | None) -> pa.RecordBatch:
    whole = "".join(texts)
    letters = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(x) for x in texts])
    windows = np.maximum(lengths - k + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(text)) + np.repeat(lengths.cumsum() - lengths - windows.cumsum() + windows, windows)
    slots = _slots(letters, k) if len(at) else np.zeros(0, np.int32)
    if wanted is not None:
        kept = wanted[slots[at]]
        text, at = text[kept], at[kept]
    values = _numbered(letters, k)[at] if len(at) else at
    order = np.argsort(values)
    values, text, at = values[order], text[order], at[order]
    new = np.append(True, values[1:] != values[:-1])[: len(values)]
    firsts = np.flatnonzero(new)
    pairs = np.sort((new.cumsum() - 1) * len(texts) + text)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
    place = at - (lengths.cumsum() - lengths)[text]
    n, place = (np.bincount(pairs // len(texts)), np.minimum.reduceat(place, firsts) + 1) if len(at) else (at, at)
    return pa.record_batch([_strings(letters[at[firsts][:, None] + np.arange(k)], k), pa.array(n), pa.array(place), pa.array(slots[at[firsts]])], names=["kmer", "n", "first", "slot"])


def texts_with(texts: DataFrame, k: int, wanted: Broadcast | None = None) -> DataFrame:
    """kmer, n (the texts that it stands in, rows of the one column), first (its smallest place in one, from 1) and slot.

    k-mers are counted in tasks, about 4 million characters or one text at a time, before rows are made of them. wanted:
    of each slot whether its k-mers count; others stay out before they are counted.
    """

    at_once = _AT_ONCE

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for x in batch.column(0).to_pylist():
                if held and size + len(x) > at_once:
                    yield _counts_at_once(held, k, wanted and wanted.value)
                    held, size = [], 0
                if len(x) >= k:
                    held.append(x)
                    size += len(x)
            if held:
                yield _counts_at_once(held, k, wanted and wanted.value)

    counts = texts.dropna().mapInArrow(counted, "kmer string, n long, first long, slot int")
    return counts.groupBy("kmer").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min("slot").alias("slot"))


def _designed(items: DataFrame, data: str, is_target: Column, k: int, least_share: float, most_others: int) -> DataFrame:
    """What probe_design gives, and first: the smallest place (from 1) in a target."""
    target = F.coalesce(is_target, F.lit(False))
    whole = items.agg(F.count_if(target).alias("all"))
    found = texts_with(items.filter(target).select(data), k).crossJoin(F.broadcast(whole)).filter(F.col("n") >= F.col("all") * least_share)
    found = stored(found.select("kmer", F.col("n").alias("targets"), "first", "slot"), "designed")
    # only what enough targets have is counted in the other texts
    wanted = None
    if found.count() <= FEW:
        slots = np.zeros(1 << SLOT_BITS, bool)
        slots[[r[0] for r in found.select("slot").distinct().collect()]] = True
        wanted = items.sparkSession.sparkContext.broadcast(slots)
    others = texts_with(items.filter(~target).select(data), k, wanted).select("kmer", F.col("n").alias("others"))
    kept = found.join(others, "kmer", "left").withColumn("others", F.coalesce("others", F.lit(0).cast("long"))).filter(F.col("others") <= most_others)
    return kept.select("kmer", "targets", "others", gc_content(F.col("kmer")).alias("gc"), melting_temperature(F.col("kmer")).alias("temperature"), "first")


def probe_design(items: DataFrame, key: str, data: str, is_target: Column, k: int, least_share: float, most_others: int) -> DataFrame:
    """k-mers that stand in at least that share of the targets and in at most most_others other texts.

    Returns kmer, targets, others, gc and temperature. A missing flag counts as not a target.
    """
    return _designed(items, data, is_target, k, least_share, most_others).drop("first")


def ranked_design(items: DataFrame, key: str, data: str, is_target: Column, k: int, least_share: float, most_others: int, clip: int, window: tuple[int, int] | None = None, gc: tuple[int, int] = (0, 100)) -> DataFrame:
    """The `clip` best designed probes with their rank: kmer, targets, others, gc, temperature, first, rank.

    first is the smallest place of the k-mer in a target (from 1); with a window it has to lie there. gc limits the
    share of G and C in percent. Better is what more targets have, then fewer others, then the higher temperature,
    then the smaller k-mer. The report is a top-k: only `clip` rows per task and in the end are sorted.
    """
    found = _designed(items, data, is_target, k, least_share, most_others)
    kept = found.filter((F.col("gc") * 100 / k).between(*gc))
    if window:
        kept = kept.filter(F.col("first").between(*window))
    order = [F.desc("targets"), F.asc("others"), F.desc("temperature"), F.asc("kmer")]
    best = kept.orderBy(*order).limit(clip)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def probe_quality(buckets: Column, mishits: Column, group_size: Column) -> Column:
    """group_size * i + 1000 / (1000 + buckets[i]), i the first bucket at which the running sum exceeds twice the mishits."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        hit = F.when((acc["hit"] < 0) & (total > mishits * 2), acc["at"]).otherwise(acc["hit"])
        return F.struct(total.alias("sum"), (acc["at"] + 1).alias("at"), hit.alias("hit"))

    found = F.aggregate(buckets, start, step, lambda acc: acc["hit"])
    i = F.when(found >= 0, found).otherwise(F.size(buckets) - 1)
    return group_size * i + F.lit(1000.0) / (F.lit(1000.0) + F.get(buckets, i.cast("int")))


def separating_probes(kmers: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """a, b and the smallest k-mer that one of the two has and the other lacks; pairs (a, b) without one are absent.

    kmers: key and kmer, distinct.
    """
    of = lambda who: pairs.join(kmers.select(F.col(key).alias(who), "kmer"), who)
    sides = of("a").unionByName(of("b")).groupBy("a", "b", "kmer").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return sides.groupBy("a", "b").agg(F.min("kmer").alias("kmer"))


def primer_pairs(primers: DataFrame, group: str, least: int, most: int, most_difference: int = 4) -> DataFrame:
    """Pairs of primers (group, kmer, position) of one text whose distance lies in the window and whose melting temperatures are close.

    Positions are cut into bins of the window's length, so only primers of the same or of neighbouring bins meet.
    """
    binned = primers.withColumn("_bin", F.floor(F.col("position") / most)).withColumn("temperature", melting_temperature(F.col("kmer")))
    left = binned.select(group, "_bin", *[F.col(c).alias(f"{c}_1") for c in ("kmer", "position", "temperature")])
    right = binned.select(group, F.explode(F.array(F.col("_bin"), F.col("_bin") - 1)).alias("_bin"), *[F.col(c).alias(f"{c}_2") for c in ("kmer", "position", "temperature")])
    apart = F.col("position_2") - F.col("position_1")
    close = F.abs(F.col("temperature_1") - F.col("temperature_2")) <= most_difference
    return left.join(right, [group, "_bin"]).filter(apart.between(least, most) & close).drop("_bin")


def covering_probes(hits: DataFrame, excluded: DataFrame | None = None, share: float = 0.5, most: int | None = None) -> DataFrame:
    """round, kmer and covered: probes that together stand in every item (kmer, item in hits) that any allowed probe stands in.

    Many probes a round: every item that is left votes for the probe that covers most of what is left, by buckets whose
    counts differ by less than half, and within a bucket by a hash that each round has anew, so that ties don't wait
    for each other; each probe that gets `share` of its items' votes is taken. The best probe always gets all of its own, and a
    taken one covers at least two thirds of that share of what greedy choice would take. The rounds grow with the
    logarithm of the items, not with the probes. covered: the items that voted for it.
    excluded: kmer of a second group, whose probes are out. most: ends after so many rounds. Of each round only the number
    of probes of each bucket is collected.
    """
    return covering_sets(hits.groupBy("item").agg(F.collect_set("kmer").alias("kmers")), excluded, share, most)


def covering_sets(sets: DataFrame, excluded: DataFrame | None = None, share: float = 0.5, most: int | None = None) -> DataFrame:
    """covering_probes of one row an item: kmers, its probes without repeats.

    Probes are counted as they come out of the rows. The best buckets are few probes, which are broadcast, and have
    a probe of nearly every item; only items without one meet all probes in a join.
    """
    spark, number, chosen = sets.sparkSession, 0, []
    out = excluded.select("kmer").distinct() if excluded is not None else None
    rest = stored(sets.select(F.monotonically_increasing_id().alias("item"), "kmers"), "cover")
    while most is None or number < most:
        number += 1
        each = lambda df: df.select("item", F.explode("kmers").alias("kmer"))
        gains = each(rest).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
        if out is not None:
            gains = gains.join(out, "kmer", "left_anti")
        bucket = -F.floor(F.log("n") / math.log(1.5))
        gains = stored(gains.select("kmer", "n", bucket.alias("bucket"), F.xxhash64("kmer", F.lit(number)).alias("turn")), "cover-gains")
        sizes = sorted((r["bucket"], r["probes"]) for r in gains.groupBy("bucket").agg(F.count(F.lit(1)).alias("probes")).collect())
        if not sizes:
            break
        upto, total = None, 0
        for number_of, probes in sizes:
            total += probes
            if total > COVER_FEW:
                break
            upto = number_of
        vote = lambda df, own: each(df).join(own, "kmer").groupBy("item").agg(F.min(F.struct("bucket", "turn", "kmer", "n")).alias("_best"))
        if upto is None:
            votes = vote(rest, gains)
        else:
            votes = vote(rest, F.broadcast(gains.filter(F.col("bucket") <= upto)))
            if upto != sizes[-1][0]:
                votes = stored(votes, "cover-votes")
                votes = votes.unionByName(vote(rest.join(votes.select("item"), "item", "left_anti"), gains.filter(F.col("bucket") > upto)))
        won = votes.groupBy(F.col("_best.kmer").alias("kmer"), F.col("_best.n").alias("n")).agg(F.count(F.lit(1)).alias("covered"))
        taken = stored(won.filter(F.col("covered") >= F.col("n") * share).select(F.lit(number).alias("round"), "kmer", "covered"), "cover-taken")
        if taken.count() <= COVER_FEW:
            row = taken.agg(F.collect_list("kmer").alias("_taken"))
            rest = rest.crossJoin(F.broadcast(row)).filter(~F.coalesce(F.arrays_overlap("kmers", "_taken"), F.lit(False))).drop("_taken")
        else:
            covered = each(rest).join(taken.select("kmer"), "kmer", "left_semi").select("item").distinct()
            rest = rest.join(covered, "item", "left_anti")
        rest = stored(rest, "cover")
        chosen.append(taken)
    return reduce(DataFrame.unionByName, chosen) if chosen else spark.createDataFrame([], "round int, kmer string, covered long")
