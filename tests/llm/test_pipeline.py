"""The corpus pipeline stage by stage against brute force on the smallest tables."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.llm import jaccard, simhash
from tests.llm.test_contracts import brute_fingerprint

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    out, docs = {}, spark.read.parquet(f"{TABLES}/documents.parquet")
    columns = docs.columns
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, TABLES).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == "packing" or docs.columns == columns
        out[name] = docs.collect()
    return out


def test_quality_keeps_good_documents(spark, stages):
    kept = {r.doc_id for r in stages["quality"]}
    assert len(stages["quality"]) == len(kept) < len(stages["documents"])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    good = [d for d, y in labels.items() if y == 1]
    assert sum(d in kept for d in good) >= 0.9 * len(good)


def test_exact_copies_go(stages):
    texts = defaultdict(list)
    for r in stages["quality"]:
        texts[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in stages["exact_dedup"]) == sorted(min(x)[1] for x in texts.values())


def brute_kept(rows):
    """The smallest doc_id of each group of (doc_id, text): linked by 3 bits or fewer, or by a Jaccard similarity of 0.8."""
    rows = [(d, set(simhash.shingle_hashes(t, 5).tolist()), brute_fingerprint(t, 5)) for d, t in rows]
    root = {d: d for d, _, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x, fx) in enumerate(rows):
        for b, y, fy in rows[:i]:
            if (fx ^ fy).bit_count() <= 3 or (min(len(x), len(y)) * 10 >= 8 * max(len(x), len(y)) and len(x & y) * 10 >= 8 * len(x | y)):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(d for d in root if root[d] == d)


def test_near_copies_go(stages):
    assert sorted(r.doc_id for r in stages["near_dedup"]) == brute_kept([(r.doc_id, r.text or "") for r in stages["exact_dedup"]])


def test_no_near_copy_is_left(spark, tmp_path):
    """Against brute-force Jaccard of five-word shingles, on a table with pairs of 4 to 10 differing bits and some chains."""
    import corpus_pipeline

    tables, letters = "/root/testdata/sf0.01", [f"w{k}" for k in range(300)]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    chain = [(800_000 + k, " ".join(letters[4 * k : 4 * k + 100])) for k in range(40)] + [(800_100, "One two THREE"), (800_101, "one  two three"), (800_102, None)]
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(chain, "doc_id long, text string")).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, tables).collect()]
    assert sorted(kept) == brute_kept([(r.doc_id, r.text or "") for r in docs.collect()])


def test_large_buckets_are_linked_in_blocks(spark):
    """Sets that all share a bucket, in several components and blocks, against a comparison of all pairs."""
    rng, sets = np.random.default_rng(9), {}
    for k in range(90):
        base = np.arange(200) + 1000 * (k % 2)
        own = base.copy()
        change = rng.choice(200, int(rng.integers(0, 60)), False)
        own[change] = rng.integers(1 << 20, 1 << 40, len(change)) if k % 3 else own[change] + 500
        sets[k] = np.unique(own.astype("<u8"))
    similar = lambda x, y: len(np.intersect1d(sets[x], sets[y])) * 10 >= 8 * len(np.union1d(sets[x], sets[y]))
    members = spark.createDataFrame([(7, k) for k in sets], "key long, set long")
    shingles = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in sets.items()], "set long, shingles binary")
    for block, near in ((4, []), (32, [(0, k) for k in sets if k and similar(0, k)]), (256, [(0, k) for k in sets if k and similar(0, k)])):
        found = [(r.a, r.b) for r in jaccard._rest_links(members, spark.createDataFrame(near, "a long, b long"), shingles, 0.8, block).collect()]
        assert all(similar(a, b) for a, b in found)
        groups = []
        for links in (found + near, [(a, b) for a in sets for b in sets if a < b and similar(a, b)]):
            root = {k: k for k in sets}

            def find(k):
                while root[k] != k:
                    k = root[k]
                return k

            for a, b in links:
                low, high = sorted((find(a), find(b)))
                root[high] = low
            groups.append({k: find(k) for k in sets})
        assert groups[0] == groups[1] and len(set(groups[1].values())) > 5


EDGES = [
    (None, "No id here, but good and plain words of some length."), (1, None), (2, ""), (3, " \n\t "), (4, "Some good and plain words of a text. " * 20), (4, "Some good and plain words of a text. " * 20),
    (5, "SOME good  and plain words of a text. " * 20), (6, "lorem ipsum dolor sit amet " * 6000), (7, "a"), (8, "b"),
]


@pytest.fixture(scope="module")
def edge_tables(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the names that stages use themselves."""
    out = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame(EDGES, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.when(F.col("doc_id") > 3, "s").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    for c in ("score", "predicted", "held_out", "locator", "_locator", "row", "size", "rate", "draw", "copies", "_number", "length", "fp", "component_id", "digest"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{TABLES}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")).write.parquet(f"{out}/labels.parquet")
    return out


@pytest.mark.parametrize("number, kept", [(1, [None, 3, 4, 5, 6, 7, 8]), (2, [None, 1, 4, 6, 7, 8]), (3, None)])
def test_stages_on_edge_cases(spark, edge_tables, number, kept):
    """Each stage by itself on all edge cases: rows that stay keep every column, whatever it is called."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{edge_tables}/documents.parquet")
    got = corpus_pipeline.STAGES[number][1](spark, docs, edge_tables)
    assert got.columns == docs.columns and all(r.score == "x" for r in got.collect())
    ids = Counter(r.doc_id for r in got.collect())
    if kept is not None:  # texts that differ in white space alone are exact copies; 1, 2 and 3 have no words, and 4 and 5 the same ones
        assert ids == Counter(kept)
    else:
        assert set(ids) <= {None, 4, 5, 6, 7, 8} and max(ids.values()) <= 4


def test_first_and_last_stage_on_edge_cases(spark, edge_tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{edge_tables}/documents.parquet")
    scored = corpus_pipeline.STAGES[0][1](spark, docs, edge_tables)
    assert scored.columns == docs.columns and scored.count() <= len(EDGES)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, edge_tables).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _ in EDGES)


def test_mixing_repeats_rows(stages):
    before, after = Counter(r.doc_id for r in stages["near_dedup"]), Counter(r.doc_id for r in stages["mixing"])
    assert set(after) <= set(before) and max(after.values()) <= 2
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert 1.3 * words(stages["near_dedup"]) < words(stages["mixing"]) < 1.7 * words(stages["near_dedup"])


def test_packing_holds_every_row(stages):
    first = Counter(r.doc_id for r in stages["packing"] if r.piece == 0)
    assert first == Counter(r.doc_id for r in stages["mixing"])
    filled = Counter()
    for r in stages["packing"]:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048


def test_run(spark, stages):
    import corpus_pipeline

    got = Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, TABLES).collect())
    assert got == Counter((r.doc_id, r.piece, r.length) for r in stages["packing"])
