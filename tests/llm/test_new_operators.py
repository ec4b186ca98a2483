"""Record files, the filter audit and the impact index against brute force, on whole tables and made-up rows."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom.llm import filter_audit, impact_index, license_scan, pii, queries, record_files, toxicity

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")

LONG = "Lorem ipsum, dolor sit amet & more " * 9000
EXTRA = [
    (800001, None), (800002, ""), (800003, " \n\t "), (800004, LONG), (800005, LONG), (800006, LONG + "!"), (800007, "<|endoftext|> a"), (800008, "É İıſK 中文 x²½ it's"),
    (None, "no id"), (None, "no id"), (800009, "same text"), (800009, "same text"), (800010, "same text"), (800011, "A" * 300), (800012, "A" * 299 + "B"), (800013, "A" * 299 + "B"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables with the extra rows and with columns whose names clash with those of the operators."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    more = spark.createDataFrame(EXTRA, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    clash = {c: F.lit("x") for c in ("part", "mask", "words", "_class", "_n", "locator", "number", "key", "_tie", "start", "score", "rank", "item", "n", "good", "_text")}
    docs.unionByName(more, allowMissingColumns=True).withColumns(clash).repartition(3).write.parquet(f"{out}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (800010, 1, None), (800010, 0, 1), (800005, None, 1)], "doc_id long, quality int, toxic int"))
    labels.withColumn("part", F.lit("y")).write.parquet(f"{out}/labels.parquet")
    items = spark.read.parquet(f"{TABLES}/benchmark.parquet").unionByName(spark.createDataFrame([(700001, None), (700002, "..."), (700003, "lorem IPSUM ipsum"), (700003, "no id"), (None, "same text")], "item_id long, text string"))
    items.withColumn("rank", F.lit("y")).write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def documents(spark, folder):
    return [(r.doc_id, r.text or "", r.lang or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def emptied(spark, folder, tmp_path, *names):
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# op11


def plain_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rng = np.random.default_rng(3)
    parts = [b"123456789", b"", b"\0", b"\0" * 64] + [rng.bytes(int(n)) for n in rng.integers(0, 700, 60)] + [rng.bytes(70_000)]
    found = record_files.crc32c(parts)
    assert found[0] == 0xE3069283 and found.tolist() == [plain_crc(p) for p in parts]
    assert record_files.crc32c([]).tolist() == []
    assert record_files.masked(np.array([plain_crc(b"abc")], np.uint32))[0] == (((plain_crc(b"abc") >> 15) | (plain_crc(b"abc") << 17)) + 0xA282EAD8) % 2**32


def test_encoder_equals_the_tokenizer(documents, monkeypatch):
    monkeypatch.setattr(record_files, "REMEMBERED", 500)  # what is remembered goes again and again
    encode, rng = record_files.Encoder(record_files.default_vocabulary()), random.Random(1)
    letters = "aAbB's'tTreve llLdD09.,!?<|endoftext|> \t\n éÉßñÖÿ×÷µªº²½  ́İıΣςÅ中文​\x00\x1f\x7f\x85\U0001f600ſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(20_000)] + [t for _, t, _ in documents]
    assert encode.by_chunks
    for text, own in zip(texts, encode.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encode(text), "<u4").tolist() == own.ids


def test_round_trip(spark, folder, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(record_files.default_vocabulary())
    expected = {}
    for doc_id, text, _ in documents:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        expected.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = sorted(queries.QUERIES["op11_binary_records"](spark, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted((i for i in ids if i is not None)) + [None, None]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}


def test_shuffled_reads_and_damage(spark, documents, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(documents)], "doc_id long, text string")
    path = record_files.write_records(docs)
    index = record_files.index_of(spark, path)
    in_order = {r.key: r.ids for r in record_files.read_records(index, path).collect()}
    mixed = record_files.read_records(record_files.shuffled(index, 7), path).collect()
    assert {r.key: r.ids for r in mixed} == in_order and len(mixed) == len(documents)
    assert [r.key for r in mixed] != sorted((r.key for r in mixed), key=int)
    again = record_files.read_records(record_files.shuffled(index, 7), path).collect()
    assert [r.key for r in again] == [r.key for r in mixed]
    few = index.filter("number = 1")
    assert record_files.read_records(few, path).count() == few.count() > 0
    row = index.orderBy(F.desc("n_bytes")).first()
    name = f"{path}/data/{row.file}".removeprefix("file://")
    data = bytearray(open(name, "rb").read())
    data[row.offset + 40] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        record_files.read_records(index, path).collect()


def test_payloads():
    for key, ids in ((None, []), ("", [1]), ("7", [65535]), ("é" * 9, [65536, 3])):
        raw = np.array(ids, "<u4").tobytes()
        assert record_files.opened_payload(record_files.payload(key, raw)) == (key, raw)
    one = record_files.frames([b"x", b""])
    assert record_files.opened_frames(one) == [b"x", b""] and one[0][:8] == (1).to_bytes(8, "little")
    with pytest.raises(ValueError):
        record_files.opened_frames([one[0][:-1]])


def test_files_are_closed_at_their_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 50) for i in range(40)], "doc_id long, text string")
    path = record_files.write_records(docs)
    index = record_files.index_of(spark, path)
    assert index.select("file").distinct().count() <= index.select("part").distinct().count()
    assert index.groupBy("file").agg(F.sum("n_bytes").alias("n"), F.max(F.col("offset") + F.col("n_bytes")).alias("end")).filter("n != end").count() == 0


# op12


def brute_audit(documents, labels):
    good, toxic, least = defaultdict(int), defaultdict(int), {}
    for d, q, t in labels:
        good[d], toxic[d] = max(good[d], int(q == 1)), max(toxic[d], int(t == 1))
    for d, t, _ in documents:
        if d is not None:
            least[t] = min(least.get(t, d), d)
    rows = []
    for d, t, part in documents:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t]]
        rows.append((part, {x for x, f in zip("ABCDE", fails) if f}, good[d] if d is not None else 0, toxic[d] if d is not None else 0))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                redundant = sum(x in r[1] for r in own) - len(gone)
                out[part, order, step] = (len(left), len(gone), redundant, sum(r[1] == {x} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, x] += len(gone)
    return {k: v + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def test_filter_audit(spark, folder, documents):
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    got = queries.QUERIES["op12_filter_audit"](spark, folder).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got) and found == brute_audit(documents, labels)


def test_sql_of_the_audit_and_the_search(spark, tmp_path):
    con = duckdb.connect()
    for f in ("documents", "labels", "benchmark"):
        path = f"{TABLES}/{f}.parquet"
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    for name in ("op12_filter_audit", "op13_ranked_search"):
        df = queries.QUERIES[name](spark, TABLES)
        assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("collide", [False, True])
def test_refinement(spark, monkeypatch, collide):
    """Texts that agree in their first blocks, in their lengths only, or in all hashes (when every hash is the same)."""
    monkeypatch.setattr(filter_audit, "FIRST", 4)
    monkeypatch.setattr(filter_audit, "GROWTH", 2)
    if collide:
        monkeypatch.setattr(filter_audit, "refined", lambda number, text="text": F.char_length(text).cast("long") * 0 + number)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 3, 4, 12, 29]))) for _ in range(300)] + ["abab" + x + "é" * 40 for x in "aabbcd"] + ["é" * 61] * 3
    docs = [(rng.choice([None, *range(250)]), t) for t in texts]
    least = {}
    for d, t in docs:
        if d is not None:
            least[t] = min(least.get(t, d), d)
    got = filter_audit.duplicates(spark.createDataFrame(docs, "doc_id long, text string"), []).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t in docs if d is not None and d > least[t])


# op13


def brute_search(documents, items, top=50):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    docs = [(d, Counter(terms(t))) for d, t, _ in documents]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms, df = len(docs), sum(c.total() for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        ranked = []
        for d, c in docs:
            m = 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            ranked += [(-score, d is None, d or 0)] * (score > 0)
        out += [(item_id, k, None if n else d, -s) for k, (s, n, d) in enumerate(sorted(ranked)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, folder, documents, monkeypatch, small):
    if small:  # many blocks of items and of documents, and few items at once
        for name, value in (("ITEM_BYTES", 3000), ("TEXT_BYTES", 7)):
            monkeypatch.setattr(impact_index, name, value)
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = queries.QUERIES["op13_ranked_search"](spark, folder).collect()
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == brute_search(documents, items)


def test_slices_add_and_rank():
    """Blocks of any size: sums of the slices are the sums of the impacts, and the walk down finds the best, ties by id."""
    rng = np.random.default_rng(4)
    for n_docs, n_terms, high in ((1, 1, 1), (64, 3, 5), (200, 12, 2**35), (130, 7, 2), (65, 4, 1)):
        document, term = (x.ravel() for x in np.meshgrid(np.arange(n_docs), np.arange(n_terms)))
        impact = rng.integers(0, high, n_docs * n_terms) * (rng.random(n_docs * n_terms) < 0.5)
        block = impact_index.Block(document, term, impact, n_docs)
        items = [np.flatnonzero(rng.random(n_terms) < 0.6) for _ in range(9)] + [np.array([], np.int64), np.arange(n_terms) + n_terms]
        table = impact.reshape(n_terms, n_docs)
        ids = rng.permutation(n_docs) * 3
        for top in (1, 5, 50):
            item, score, _, key = impact_index.best_of_block(block, items, ids, np.zeros(n_docs, bool), top)
            for k, own in enumerate(items):
                sums = table[own[own < n_terms]].sum(axis=0)
                best = sorted((-s, i) for s, i in zip(sums.tolist(), ids.tolist()) if s)[:top]
                assert [(-s, i) for s, i in zip(score[item == k].tolist(), key[item == k].tolist())] == best


def test_small_slices_split_blocks(spark, folder, documents, monkeypatch):
    """A task whose slices outgrow their bound takes fewer documents a block; the result is the same."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    terms = [np.flatnonzero(rng.random(300) < 0.1).astype(np.int32) for _ in range(500)]
    batch = pa.record_batch([pa.array(range(500), pa.int64()), pa.array([len(t) for t in terms], pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array([np.ones(len(t), np.int64) for t in terms], pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "counts"])
    run = lambda: [b.to_pylist() for b in impact_index._search(iter([batch, batch.slice(0, 0)]), [np.arange(k, k + 9) for k in range(40)], list(range(40)), np.full(300, 700), 500, 15_000, 5)]
    whole = run()
    monkeypatch.setattr(impact_index, "SLICE_BYTES", 100_000)
    assert run() == whole and whole


def test_empty_tables(spark, folder, tmp_path):
    empty = emptied(spark, folder, tmp_path, "documents", "labels", "benchmark")
    for name in ("op11_binary_records", "op12_filter_audit", "op13_ranked_search"):
        assert queries.QUERIES[name](spark, empty).count() == 0
    none = impact_index.search(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{empty}/benchmark.parquet"))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


# limits that are gone: short templates, long keys, many matches in one text


def test_short_templates_have_the_threshold_of_all(spark):
    texts = [
        "This work is licensed under the MIT License.", "The license was released; the mit campus is under water", "released under the apache license", "licensed under cc by nc 4.0",
        "released under the mit license", "Licensed under the GNU General Public License version 2",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = lambda **o: [sorted({b.label for b in r.blocks if b.named}) for r in sorted(license_scan.scanned(docs, **o).collect(), key=lambda r: r.doc_id)]
    assert named() == [["mit"], [], [], ["cc-by-nc"], ["mit"], ["gpl-2.0"]]
    assert named(threshold=1.0)[0] == [] and named(threshold=1.0)[4] == ["mit"]
    held = [r.blocks for r in sorted(license_scan.scanned(docs).collect(), key=lambda r: r.doc_id)]
    assert [b.containment for b in held[1] if b.label == "mit"] == [1.0]  # the join itself knows no order


def test_order_of_a_template():
    rng = random.Random(4)
    for _ in range(300):
        own, words = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 9))] for _ in range(2))
        table = [[0] * (len(words) + 1) for _ in range(len(own) + 1)]
        for i, x in enumerate(own):
            for j, y in enumerate(words):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert license_scan.Template("x", own, 0.8, {}).in_order(words) == pytest.approx(table[-1][-1] / len(own))


def test_keys_of_any_length(spark):
    texts = [f"token {'0123456789abcdef' * n} end" for n in (2, 8, 9, 400)] + ["token " + "a1" * 15 + " end"]
    rows = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.kind, s.end - s.start) for s in r.spans if s.kind == "secret"] for r in rows} == {0: [("secret", 32)], 1: [("secret", 128)], 2: [("secret", 144)], 3: [("secret", 6400)], 4: []}


def test_many_matches_and_exceptions_in_one_text():
    import time

    entries, exceptions = (("idiot", 2.0), ("stupid", 1.5)), ("idiot proof", "stupid simple")
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["idiot", "stupid", "idiot proof", "stupid simple", "calm"]) for _ in range(60)) for _ in range(20)]
    for text in texts:
        plain = [(m.start(), m.end(), dict(entries)[m[0]]) for m in re.finditer("idiot|stupid", text) if not any(text.startswith(x, m.start()) for x in exceptions)]
        assert toxicity.matches(text, entries, exceptions) == plain
    long = "idiot idiot proof " * 100_000
    start = time.perf_counter()
    assert len(toxicity.matches(long, entries, exceptions)) == 100_000
    assert time.perf_counter() - start < 20
