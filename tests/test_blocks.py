"""Distances by blocks against the same distances of single pairs, and character counts against plain ones."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stringloom.operators import blocks, columns, distances, kmers
from stringloom.plans import kmers as kmer_plans

TEXTS = ["ACGT-A", "ACGA.A", "acgTTAC", "", None, "--..", "SMÄ𝒳01", "SLÄ𝒳10", "0101"]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES", 2)
    monkeypatch.setattr(blocks, "ITEMS", 3)


def items(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "A")], "id int, data string")


def test_distances_by_blocks(spark, small_blocks):
    df, costs = items(spark), {"01": 0.25, "10": 0.25}
    pairs = df.select(F.col("id").alias("a"), F.col("data").alias("x")).join(df.select(F.col("id").alias("b"), F.col("data").alias("y")), F.col("a") != F.col("b"))
    x, y = F.col("x"), F.col("y")
    plain = pairs.select("a", "b", distances.by_matrix(x, y, costs), distances.grouped_difference(x, y), distances.share_different(x, y))
    assert sorted(distances.protein_distances(df, df, "id", "data", costs).collect()) == sorted(plain.collect())
    once = distances.distances(df, df, "id", "data", each_once=True).collect()
    assert sorted(once) == sorted(pairs.filter("a < b").select("a", "b", distances.share_different(x, y)).collect())


@pytest.mark.parametrize("product", [1, 5, 512])
def test_costs_as_products(monkeypatch, product):
    """Some places at a time are one product of matrices, whatever letters stand there and whichever are ignored."""
    monkeypatch.setattr(blocks, "PRODUCT", product)
    rng = random.Random(4)
    x, y = ([rng.choice([None, "", "".join(rng.choice("ACGT-.é𝒳") for _ in range(rng.randrange(12)))]) for _ in range(n)] for n in (9, 14))
    cost = lambda p, q: 0.0 if p == q else 0.25 if p + q in ("AC", "é𝒳") else 1.0
    cells = lambda a, b: [cost(p, q) for p, q in zip(a or "", b or "") if p not in "-." and q not in "-."]
    expected = [[sum(c) / len(c) if (c := cells(a, b)) else 0.0 for b in y] for a in x]
    assert np.allclose(blocks.mean_cost(pa.array(x, pa.string()), pa.array(y, pa.string()), cost, "-."), expected, atol=1e-12)


def test_sums_of_bits():
    """64 counts in one word: as many bits as are set, and which counts are no larger than a bound."""
    rng = np.random.default_rng(12)
    for n in (1, 2, 3, 7, 14, 16):
        bits = list(rng.integers(0, 2**63, (n, 5), dtype=np.uint64))
        plain = sum(np.unpackbits(b.view(np.uint8)).astype(int) for b in bits)
        digits = blocks._added(bits)
        assert np.array_equal(sum(np.unpackbits(d.view(np.uint8)).astype(int) << i for i, d in enumerate(digits)), plain)
        for most in (0, 1, 4, n, 40):
            assert np.array_equal(np.unpackbits(blocks._at_most(digits, most).view(np.uint8)), plain <= most)


@pytest.mark.parametrize("at_once", [64, 1 << 16])
def test_many_probes_of_several_lengths(monkeypatch, at_once):
    """More probes than a word has bits, of several lengths, in letters of which the probes lack some."""
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    rng = random.Random(13)
    probes = ["".join(rng.choice("ACGé") for _ in range(rng.choice([5, 6, 9]))) for _ in range(150)]
    texts = ["".join(rng.choice("ACGTéN.𝒳") for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    expected = set()
    for i, p in enumerate(probes):
        for k, t in enumerate(texts):
            for at in range(len(t) - len(p) + 1):
                wrong = [c for x, c in zip(p, t[at:]) if x != c]
                cloudy = sum(c in "N." for c in wrong)
                if len(wrong) - cloudy + (max(cloudy - 1, 0) if cloudy < 3 else cloudy) <= 2:
                    expected.add((i, k, at + 1, len(wrong) - cloudy, cloudy))
    found = list(zip(*[v.tolist() for v in blocks.near_places(probes, texts, 2, 1, 3, "N.")]))
    assert set(found) == expected and len(found) == len(expected) > 300


@pytest.mark.parametrize("name", ["hit_overlays", "ordered_hits", "probe_hits"])
def test_reads_are_put_together_once(spark, name):
    """The lines of an item were collected and sorted anew each time that items or probes were read or counted."""
    lines = spark.createDataFrame([(k, k * 7 % 40, k % 2 * 20, 1, float(k % 3), 0.1) for k in range(80)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double")
    plan = getattr(kmer_plans, name)(lambda table: lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_fields_shown_by_block(spark, small_blocks):
    """Rounded and corrected distances are made with a block's distances, not row by row in expressions."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["ACGT", "ACGA", "TTTT", "AC", None])], "id int, data string")
    shown = lambda d: {"rounded": blocks.rounded(d, 2), "corrected": blocks.rounded(blocks.jukes_cantor(d), 6)}
    found = distances.distances(df, df, "id", "data", shown=shown, fields=("rounded", "corrected"))
    plain = distances.distances(df, df, "id", "data")
    d = F.col("distance")
    expected = plain.select("a", "b", distances.rounded(d, 2), distances.rounded(distances.jukes_cantor(d), 6)).collect()
    key = lambda r: tuple(r)[:2]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, expected), key=key) and any(r[3] is None for r in expected)


def test_blocks_are_dealt_out(spark, small_blocks):
    """All pairs of a small file were scored by one task."""
    df = items(spark).coalesce(1)
    assert distances.distances(df, df, "id", "data").rdd.getNumPartitions() > 1


def test_cosines_by_blocks(spark, small_blocks):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-2.0, 0.0]), (5, None)], "id int, v array<double>")
    found = {(r.a, r.b): r.distance for r in distances.cosine_distances(df.filter("id = 1"), df, "id", "v").collect()}
    assert found.keys() == {(1, 2), (1, 3), (1, 4), (1, 5)} and found[1, 3] is None and found[1, 5] is None
    assert abs(found[1, 2] - (1 - 0.5**0.5)) < 1e-12 and abs(found[1, 4] - 2) < 1e-12


def test_rounded(spark):
    found = spark.createDataFrame([(0.12345,), (0.0,), (None,), (1 / 3,)], "v double").select(distances.rounded(F.col("v"), 4)).collect()
    assert [r[0] for r in found] == [0.1235, 0.0, None, 0.3333]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 22])
def test_counts_in_parts(spark, monkeypatch, at_once):
    """The same counts however many characters are counted at once, by sorting or by places."""
    monkeypatch.setattr(columns, "AT_ONCE", at_once)
    rows = [("x", "aä𝒳"), ("x", "aäb"), (None, "a\x00"), (None, None), ("y", ""), ("x", "a" * 50)]
    monkeypatch.undo() if at_once == 1 << 22 else None
    expected = Counter((g, i + 1, ch) for g, t in rows for i, ch in enumerate(t or ""))
    tallied = columns._tallied([t for _, t in rows if t])
    assert Counter({(p, chr(c)): n for p, c, n in zip(*[v.tolist() for v in tallied])}) == sum((Counter({(p, ch): n}) for (_, p, ch), n in expected.items()), Counter())
    found = columns.counts(spark.createDataFrame(rows, "g string, t string"), "t", "g", fill=None).collect()
    assert {(r.g, r.pos, r.ch): r.n for r in found} == dict(expected) and len(found) == len(expected)


def test_counts_explode_no_letters(spark):
    """A row for each letter was made before anything was counted."""
    plan = columns.counts(spark.createDataFrame([("a",)], "t string"), "t", fill=None)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_gc_content_of_letters_that_upper_case_makes_longer(spark):
    found = spark.createDataFrame([("straße",), ("ﬆgc",), ("Gcau",)], "c string").select(kmers.gc_content(F.col("c")).alias("gc"), kmers.melting_temperature(F.col("c")).alias("t")).collect()
    assert [tuple(r) for r in found] == [(0, 4), (2, 8), (2, 12)]


def test_many_alike_rows_are_not_broadcast(spark, monkeypatch):
    """The files of alike rows are small, so Spark sent gigabytes of them through the driver."""
    from stringloom.operators import storage

    many = storage.sized(spark.range(200_000).select((F.col("id") % 3).alias("k"), F.lit(1.0).alias("v")), "many")
    few = storage.sized(spark.range(3).withColumnRenamed("id", "k"), "few")
    plan = lambda a, b: a.join(b, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(many, many.groupBy("k").count())
    assert "BroadcastHashJoin" in plan(few, few.withColumn("v", F.lit(1)))


def test_probe_hits_with_any_seeds(spark, small_blocks, monkeypatch):
    """Every place, at the ends of texts and of parts too, also where no piece of the probe stands unchanged by itself."""
    monkeypatch.setattr(blocks, "AT_ONCE", 16)
    texts = [(1, "ACGTACGTAC" * 5), (2, "NNACGTNCGAAC"), (3, "ACGTACGTA"), (4, None), (5, ""), (6, "TTTTTTTTTTACGTTCGTAC")]
    probes = spark.createDataFrame([(7, "ACGTACGTAC"), (8, "TTTTTTTTTTAC"), (9, "ACGT")], "p int, t string")
    df = spark.createDataFrame(texts, "id int, data string")
    found = kmers.probe_hits(probes, "p", "t", df, "id", "data", 2, ignored=1).collect()

    def passes(a, b):
        other = sum(x != y and y in "N." for x, y in zip(a, b))
        plain = sum(x != y and y not in "N." for x, y in zip(a, b))
        return plain + (max(other - 1, 0) if other < 4 else other) <= 2, plain, other

    expected = []
    for p, probe in [(7, "ACGTACGTAC"), (8, "TTTTTTTTTTAC")]:
        for i, t in texts:
            for at in range(len(t or "") - len(probe) + 1):
                ok, plain, other = passes(probe, t[at : at + len(probe)])
                expected += [(p, i, at + 1, plain, other, t[at : at + len(probe)])] if ok else []
    assert sorted((r.probe_id, r.id, r.position, r.mismatches, r.n_mismatches, r.piece) for r in found) == sorted(expected)
    assert blocks.near_places(["ACGTA" * 60], ["ACGTA" * 60], 3, 1, 4, "N")[2].tolist() == [1]  # more letters than a byte counts


def test_equal_pairs_are_aligned_once(spark, monkeypatch):
    from stringloom.operators import aligning

    calls, align = [], aligning.align
    monkeypatch.setattr(aligning, "align", lambda *pair, **points: calls.append(pair) or align(*pair, **points))
    found = aligning._each_once([("ACGT", "AGT")] * 50 + [("AC", "A")])
    assert found == [("ACGT", "A-GT", 4)] * 50 + [("AC", "A-", 0)] and len(calls) == 2
    rows = spark.createDataFrame([("ACGT", "AGT"), ("AC", "A"), ("ACGT", "AGT")], "a string, b string")
    assert [tuple(r.x) for r in rows.select(aligning.aligned(F.col("a"), F.col("b")).alias("x")).collect()] == [found[0], found[-1], found[0]]
