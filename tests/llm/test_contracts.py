"""The registered queries against brute force over whole tables, with made-up rows added for the cases that the tables lack."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stringloom.llm import fingerprint, ftrl, license_scan, packing, pii, quality, queries, simhash, source_mixing, token_files, toxicity

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")

LONG = "lorem ipsum dolor sit amet " * 4000
EXTRA = [
    (900001, None), (900002, ""), (900003, " \n\t "), (900004, LONG), (900005, LONG + "x"), (900006, "A  b\tC"), (900007, "AbC"), (900008, "a b C"),
    (900009, "CC BY, all rights reserved; cc-by GENERAL public License cc by"), (900010, "All rights reserved rights reserved"),
    (900011, "mail a.b@c.de, x@y.z.w and ..@-.-! 1.2.3.4 1.2.3.4.5 256.1.1.1 001.2.3.4 4111 1111 1111 1111 4111-1111-1111-1112 +49 (30) 123.456-78 +1 2 +123456789012345678"),
    (900012, "bank IBAN DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, DE00 3704 0044 0532 0130 00"), (900013, "é" * 50 + " 4111111111111111 " + "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6"),
    (900014, "<|endoftext|> same"), (900015, "0" * 300 + "@" + "a" * 300), (None, "text without an id"), (900016, "one two"), (900017, "ONE two"),
    (900018, "IBAN ES9121000418450200051332 BANK, NO9386011117947 and ES912100041845020005133 or es9121000418450200051332"),
    (900019, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff' + " ." * 30 + " 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    (900020, "x " * 40 + "Released under the MIT license. Licensed under the GNU General Public License version 2 or the GNU lesser general public license."),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The tables with the extra rows, a repeated row, and columns whose names clash with those of the operators."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    more = spark.createDataFrame(EXTRA, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "src1").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    clash = {c: F.lit("x") for c in ("digest", "locator", "spans", "score", "fp", "size", "row", "part", "_locator", "sequence_id", "label")}
    docs.unionByName(more).unionByName(more.filter("doc_id = 900006")).withColumns(clash).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{TABLES}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 1), (900002, None, None)], "doc_id long, quality int, toxic int")).write.parquet(f"{out}/labels.parquet")
    return out


@pytest.fixture(scope="module")
def documents(spark, folder):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def rows(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def test_license_scan(spark, folder, documents):
    expected = Counter()
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    for doc_id, text, _ in documents:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hits = [(i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
        at = [i for i, _ in hits]
        expected[doc_id, len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    got = rows(spark, folder, "op1_license_scan")
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == expected
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def brute_blocks(text):
    """(label, start, containment) of every template and block, by counting distinct words alone."""
    words, found = license_scan.words_of(text), []
    for label, template, *_ in license_scan.TEMPLATES:
        own = license_scan.words_of(template)
        size = 64
        while size < 2 * len(own):
            size *= 2
        need = -(-len(set(own)) * 8 // 10)
        for b in range(max(1, -(-len(words) // (size // 2)))):
            both = len(set(own) & set(words[b * size // 2 : b * size // 2 + size]))
            if both >= need:
                found.append((label, b * size // 2, both / len(set(own))))
    return sorted(found)


def test_license_blocks(spark):
    """Blocks against a comparison of everything with everything, on texts made of pieces of the templates."""
    rng, pieces = np.random.default_rng(5), [t[1] for t in license_scan.TEMPLATES]
    texts = ["", "the " * 300]
    for _ in range(120):
        words = []
        for _ in range(int(rng.integers(1, 6))):
            own = pieces[rng.integers(len(pieces))].split()
            kept = [w for w in own if rng.random() > rng.choice([0.0, 0.1, 0.25])]
            words += ["filler", "of", "the"] * int(rng.integers(0, 30)) + (list(rng.permutation(kept)) if rng.random() < 0.3 else kept)
        texts.append(" ".join(words))
    got = license_scan.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    expected = {k: brute_blocks(t) for k, t in enumerate(texts)}
    assert {r.doc_id: [(b.label, b.start, b.containment) for b in r.blocks] for r in got} == expected
    assert sum(map(len, expected.values())) > 100 and not expected[1]


def test_license_filters_prune():
    """Both filters leave out candidates that share a prefix word, the positional one also where the length is enough."""
    frequency = {w: k + 1 for k, w in enumerate(b"a b c d e f g h i j k l m n o p".split())}
    own = b"a b c d e f g h i j".split()
    templates = license_scan.Templates([license_scan.Template("x", own, 0.8, frequency), license_scan.Template("y", b"k l m n o p q r s t".split(), 0.8, frequency)], frequency)
    prefixes = templates.by_block[64]
    pruned = [0, 0]
    assert license_scan.block_matches(own, templates, prefixes, pruned) == [(0, 10)] and pruned == [0, 0]
    assert license_scan.block_matches(own[:3], templates, prefixes, pruned) == [] and pruned == [1, 0]
    assert license_scan.block_matches(own[2:] + b"k l".split(), templates, prefixes, pruned) == [(0, 8)]
    pruned = [0, 0]
    mixed = sorted(own[:3] + b"q r s t k l m".split(), key=lambda w: templates.order[w])
    assert license_scan.block_matches(mixed, templates, prefixes, pruned) == [] and pruned[1] >= 1


def test_source_mixing(spark, folder, documents):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = Counter()
    for _, t, s in documents:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    limited, budget = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in limited]
        rest = budget - sum(2 * sizes[s] for s in limited)
        target = {s: 2 * sizes[s] if s in limited else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            break
        limited |= over
    got = rows(spark, folder, "op2_source_mixing")
    by_id = {d: (t, s) for d, t, s in documents}
    taken = Counter()
    for r in got:
        text, source = by_id[r.doc_id]
        assert r.size == size(text) and r.source_size == sizes[source] and abs(r.target - target[source]) < 1e-6
        assert r.taken <= 2 * r.size
        taken[source] += r.taken
    assert len(got) == len(documents)
    hash_of = lambda x, n, seed: xxhash.xxh64_intdigest(x.to_bytes(n, "little"), seed)
    spread = Counter()
    for r in got:
        source = by_id[r.doc_id][1]
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        spread[source] += r.size**2 * (rate % 1) * (1 - rate % 1)
        if r.doc_id is not None:
            draw = hash_of(42, 4, hash_of(hash_of(r.doc_id, 8, 42), 8, 42)) % (1 << 40) / (1 << 40)
            assert r.taken == r.size * (int(rate) + (draw < rate % 1))
    for s in order:
        assert abs(taken[s] - target[s]) <= 4 * spread[s] ** 0.5 + 1e-6
    again = rows(spark, folder, "op2_source_mixing")
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_draws_each_row_with_the_fraction(spark):
    """Rows of one source at rate 1.25: a quarter of them twice, whatever their size, and rows without an id by their text."""
    docs = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    got = source_mixing.allotted(docs, share=1.25).groupBy(F.col("doc_id").isNull().alias("no_id")).agg(F.count_if(F.col("copies") == 1).alias("one"), F.count_if(F.col("copies") == 2).alias("two")).collect()
    for r in got:
        assert r.one + r.two == 10_000 and abs(r.two - 2500) < 5 * (10_000 * 0.25 * 0.75) ** 0.5
    alone = [source_mixing.allotted(spark.createDataFrame([(k, "a b", "s")], "doc_id long, text string, source string"), share=1.45).first().copies for k in range(10)]
    assert set(alone) == {1, 2}


def test_packing(spark, folder, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    lengths = []
    for doc_id, text, _ in documents:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cuts(len(ids))):
            expected[doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
            lengths.append(n)
    got = rows(spark, folder, "op3_best_fit_packing")
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert len(places) <= -(-sum(lengths) // packing.CAPACITY) * 1.02 + 1
    assert min(places) == 0 and max(places) == len(places) - 1


def test_packing_encodes_as_tokenizers(spark):
    """The tokenizer as it is loaded, with add_special_tokens=False: the added token's string is the added token."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> same", "<|endoftext|><|endoftext|>\n x", "<|endoftext |> no", "it's  plain\u00a0text <|endoftext|", "", "x<|endoftext|>"]
    got = packing.tokenised_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}


def best_fit(lengths, capacity):
    """The number of sequences that best fit, longest first, opens, piece by piece."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        gaps.append((min(fit) if fit else capacity) - n)
        if fit:
            gaps.remove(min(fit))
    return len(gaps)


@pytest.mark.parametrize("counts", [{}, {5: 1}, {2048: 3, 1: 10}, {1000: 7, 700: 5, 348: 9, 2: 1}, {n: 3 for n in range(1, 400, 7)}, {1: 5000}])
@pytest.mark.parametrize("share", [20_000, 40])
def test_packing_is_best_fit(spark, counts, share):
    """As many sequences as best fit opens, and with many deals about one a deal more; no place is taken twice."""
    lengths = [n for n, k in counts.items() for _ in range(k)]
    pieces = spark.createDataFrame([(n, "x") for n in lengths], "length long, extra string")
    got = packing.packed(pieces, share=share).collect()
    assert sorted(r.length for r in got) == sorted(lengths)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    assert sorted(filled) == list(range(len(filled)))
    assert len(filled) <= best_fit(lengths, packing.CAPACITY) + len(lengths) // share


def test_sweep_takes_successors():
    """Each piece takes the smallest gap that holds it at that moment; deals don't mix; what is left is reported."""
    import pyarrow as pa

    rng, rows = np.random.default_rng(2), []
    for deal in range(3):
        rows += [(deal, False, int(g), 1000 * deal + k) for k, g in enumerate(sorted(rng.integers(1, 60, 20), reverse=True))]
        rows += [(deal, True, int(n), 1000 * deal + k) for k, n in enumerate(sorted(rng.integers(1, 50, 60), reverse=True))]
    table = pa.table({k: pa.array(v) for k, v in zip(("deal", "is_piece", "size", "number"), zip(*rows))})
    out = [r for b in packing.sweep(iter(table.to_batches(max_chunksize=17)), 64, 100_000, 3) for r in b.to_pylist()]
    placed = {r["number"]: (r["sequence_id"], r["place"]) for r in out if r["is_piece"]}
    for deal in range(3):
        gaps = {q: g for d, is_piece, g, q in rows if d == deal and not is_piece}
        size = dict(gaps)
        for d, is_piece, n, number in rows:
            if d != deal or not is_piece:
                continue
            sequence, place = placed[number]
            fit = [g for g in gaps.values() if g >= n]
            if fit:
                assert gaps[sequence] == min(fit)
            else:
                assert sequence not in gaps
                gaps[sequence] = size[sequence] = 64
            assert place == 64 - gaps[sequence]
            gaps[sequence] -= n
        left = {r["sequence_id"]: r["place"] for r in out if not r["is_piece"] and r["sequence_id"] in gaps}
        assert left == {q: g for q, g in gaps.items() if g}


def brute_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, folder, documents):
    docs = [(d, brute_fingerprint(t, 3)) for d, t, _ in documents]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            if (a ^ docs[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    expected = Counter((d, f"{fp:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, fp) in enumerate(docs))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows(spark, folder, "op4_simhash")) == expected


@pytest.mark.parametrize("most", [65_536, 2])
def test_links_are_complete(spark, most):
    """Random fingerprints with planted near ones; a tiny bucket limit sends buckets the other, exact way."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), False)) for x in base for _ in range(3)]
    fps = sorted({int(x) for x in base} | set(near) | {(1 << 64) - 1, 0, 7, 1 << 63})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 3
        root[find(r.a)] = find(r.b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                assert find(a) == find(b)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8])
def test_no_row_of_a_large_bucket_is_lost(size):
    """A bucket over the limit comes back whole, however the batches cut it."""
    import pyarrow as pa

    keys, fps = [1, 2, 2, 2, 2, 3, 4, 4], [0, 1, 2, 3, 4, 5, 6, 6 + (1 << 40)]
    table = pa.table({"key": pa.array(keys, pa.int64()), "fp": pa.array(fps, pa.int64())})
    out = [r for b in simhash._link_runs(iter(table.to_batches(max_chunksize=size)), 2) for r in b.to_pylist()]
    assert sorted(r["a"] for r in out if r["b"] is None) == [1, 2, 3, 4]
    assert [{r["a"], r["b"]} for r in out if r["b"] is not None] == [{6, 6 + (1 << 40)}]


def test_token_counts(spark, folder, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True  # op5 takes the identifier's string in a text as ordinary text, so that it never ends a document
    expected = Counter((d, len(tokenizer.encode(t, add_special_tokens=False).ids)) for d, t, _ in documents)
    assert Counter((r.doc_id, r.n_tokens) for r in rows(spark, folder, "op5_token_counts")) == expected


def test_token_counts_do_not_depend_on_splits(spark, tmp_path):
    """The files are split in another way after the token files are written."""
    from stringloom.llm import token_files

    path = f"{tmp_path}/documents"
    spark.read.parquet(f"{TABLES}/documents.parquet").repartition(6).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    expected = Counter((r.doc_id, r.n_tokens) for r in token_files.count_tokens(spark.read.parquet(path)).collect())
    assert sum(expected.values()) == spark.read.parquet(path).count()
    try:
        counted = token_files.count_tokens(spark.read.parquet(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        assert Counter((r.doc_id, r.n_tokens) for r in counted.collect()) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("bytes_a_range", [640, 10_010, 1 << 27])
def test_token_files_of_any_bytes(spark, tmp_path, bytes_a_range):
    """Files with the identifier's bytes at odd places too, cut into ranges of any size, with and without a closing identifier."""
    rng, end, files = np.random.default_rng(3), token_files.END_OF_DOCUMENT, {}
    for k in range(10):
        ids = rng.choice(np.array([end, 0x50C4, 0xC450, 0x5000, 0x00C4, 0xC4C4, 0x5050, 1, 2, 0x0D0A, 0xBBEF], "<u2"), int(rng.integers(0, 4000))).tobytes()
        sep = end.to_bytes(2, "little")
        files[k] = [ids, b"\xef\xbb\xbf\x01" + ids, b"\xef\xbb\xbf\x01" + ids + sep, ids + b"\x07", ids + sep, ids + b"\x07" + sep, b"", sep * 5, b"\x07" * 6000, ids * 9][k]
        (tmp_path / f"part-{k:05d}").write_bytes(files[k])
    expected = []
    for k, content in files.items():
        ids, at = np.frombuffer(content[: len(content) // 2 * 2], "<u2"), 0
        stops = [*np.flatnonzero(ids == end).tolist(), len(ids)]
        for number, stop in enumerate(stops):
            if number < len(stops) - 1 or at < stop:
                expected.append((k, number, at, stop - at))
            at = stop + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_a_range))
        got = token_files.document_tokens(token_files.scan_blocks(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((int(r.file[-5:]), r.number, r.start, r.n_tokens) for r in got) == sorted(expected)


def test_token_files_refuse_wide_ids():
    assert token_files._narrow(np.array([1, 65_535], "<u4")) == b"\x01\x00\xff\xff"
    with pytest.raises(ValueError, match="16 bits"):
        token_files._narrow(np.array([65_536], "<u4"))


def test_lost_token_files_are_an_error(spark, monkeypatch):
    from stringloom.llm import token_files

    whole = token_files.document_tokens
    monkeypatch.setattr(token_files, "document_tokens", lambda blocks: whole(blocks).filter("number <> 1"))
    with pytest.raises(Exception, match="token files and ids differ"):
        token_files.count_tokens(spark.read.parquet(f"{TABLES}/documents.parquet")).collect()


def test_fingerprints(spark, folder, documents):
    ordered = sorted(documents, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    got = rows(spark, folder, "op6_fingerprint")
    assert len(got) == len(documents)
    by_id = {r.doc_id: r for r in got}
    for (d, text, _), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        if d == 900006:
            continue
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        r = by_id[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if changed == text:
            assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    same = defaultdict(set)
    for d, text, _ in documents:
        same[text].add(by_id[d].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    long = [by_id[d] for d, t, _ in documents if len(t) > 500 and d < 900000]
    assert np.mean([r.near_edited for r in long]) > 0.6 and np.mean([r.near_next for r in long]) < 0.1


def brute_sketch(text):
    """The sketch by its definition, with whole numbers: hash of every run of code points, those below the threshold, or the least."""
    mask, kept, least = (1 << 64) - 1, set(), None

    def mix(a, b, p):
        h = (a * p & mask) ^ (b + 0x9E3779B97F4A7C15 & mask)
        h ^= h >> 29
        return h * 0xBF58476D1CE4E5B9 & mask

    points = [ord(c) for c in text] + [0x110000] * max(0, fingerprint.WIDTH - len(text))
    for i in range(len(points) - 11):
        x = points[i : i + 12]
        two = [mix(a, b, 0x9FB21C651E98DF25) for a, b in zip(x, x[1:])]
        four = [mix(two[k], two[k + 2], 0xD6E8FEB86659FD93) for k in range(len(two) - 2)]
        eight = [mix(four[k], four[k + 4], 0xA0761D6478BD642F) for k in range(len(four) - 4)]
        h = mix(eight[0], four[8], 0xE7037ED1A0B428DB)
        h = (h ^ h >> 32) & 0xFFFFFFFF
        least = h if least is None else min(least, h)
        if h < (1 << 32) // fingerprint.SCALE:
            kept.add(h)
    return sorted(kept or {least})


def test_sketch_and_likeness_by_definition(spark, folder, documents):
    texts = ["", "short", "twelve chars", "é" * 40, *[t for d, t, _ in documents if d is not None and d % 9 == 0 and len(t) < 3000]]
    for t in texts:
        assert fingerprint.sketch(t).tolist() == brute_sketch(t)
    got = sorted((r for r in rows(spark, folder, "op6_fingerprint") if r.doc_id is not None and r.doc_id < 900000), key=lambda r: r.doc_id)
    of = {r.doc_id: fingerprint.decoded(r.fingerprint).tolist() for r in got}
    for r, after in zip(got, got[1:]):
        own, other, changed = set(of[r.doc_id]), set(of[after.doc_id]), set(fingerprint.decoded(r.edited_fingerprint).tolist())
        assert r.near_next == len(own & other) / min(len(own), len(other)) and r.near_edited == len(own & changed) / min(len(own), len(changed))


def test_sketches_merge():
    a, b = "first text " * 50 + "one", "second words " * 60
    both = fingerprint.merged(fingerprint.sketch(a), fingerprint.sketch(b))
    assert fingerprint.likeness(fingerprint.sketch(a), both) == 1 and (fingerprint.decoded(fingerprint.encoded(both)) == both).all()


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.mark.parametrize("name, label, least, threshold", [("op7_quality", "quality", 0.8, 0.7), ("op9_toxicity", "toxic", 0.75, 0.3)])
def test_classifiers(spark, name, label, least, threshold):
    """Held-out rows of a table with some hundred labels: ranked well, and no labels or ids among the inputs."""
    tables = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in rows(spark, tables, name)}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    assert all(r.held_out == held_out(d) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for d, r in got.items())
    test = [(got[d].score, y) for d, y in labels.items() if held_out(d)]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    assert good and bad
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc >= least


@pytest.mark.parametrize("name", ["op7_quality", "op9_toxicity"])
def test_classifiers_score_every_row(spark, folder, documents, name):
    got = rows(spark, folder, name)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in documents)
    assert all(r.score is not None and r.held_out == held_out(r.doc_id) for r in got)


def plain_features(text):
    """Words by name instead of by hash: counts of the n-grams of words and of shapes."""
    words = re.findall(r"\w+|[^\w\s]+", text)
    shapes = [quality.shape(w) for w in words]
    shapes = [x if i == 0 or words[i] != words[i - 1] else "=" for i, x in enumerate(shapes)]
    return [Counter(tuple(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)) for own in (words, shapes)]


def test_quality_features_are_hashed_ngrams():
    """Every n-gram of one to three words has a feature of its own (but for collisions), with the logarithm of its count."""
    for text in ["", "one", "a b", "the cat sat on the mat the cat sat, THE 12 12 12 !!", "é ñ é ñ x_y " * 30]:
        at, values = quality.features(text, 1 << 30)
        assert at[0] == 0 and values[0] == 0.3 and len(set(at.tolist())) == len(at)
        for counts, (low, high) in zip(plain_features(text), ((1, 1 << 29), (1 << 29, 1 << 30))):
            logs = np.log1p(list(counts.values()))
            own = values[(at >= low) & (at < high)]
            assert np.allclose(np.sort(own), np.sort(logs / max(1e-12, np.sqrt((logs**2).sum()))))
    same = lambda a, b: set(quality.features(a)[0].tolist()) & set(quality.features(b)[0].tolist())
    assert len(same("red fox runs", "red fox runs")) == 12 and len(same("red fox runs", "runs fox red")) < 12


def test_ftrl_by_definition():
    """Weights and state after every update against the published formulas, one coordinate at a time."""
    rng, model = np.random.default_rng(4), ftrl.FTRL(12, 0.3, 1.0, 0.02, 0.5)
    z, n = [0.0] * 12, [0.0] * 12

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.02 else -(z[i] - np.sign(z[i]) * 0.02) / ((1.0 + n[i] ** 0.5) / 0.3 + 0.5)

    for _ in range(200):
        at = rng.choice(12, int(rng.integers(1, 6)), False)
        values, label = rng.random(len(at)), int(rng.random() < 0.5)
        w = {int(i): weight(i) for i in at}
        p = 1 / (1 + np.exp(-sum(w[int(i)] * v for i, v in zip(at, values))))
        for i, v in zip(at.tolist(), values):
            g = (p - label) * v
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.update(at, values, label)
        assert np.allclose(model.weights(), [weight(i) for i in range(12)])


def test_quality_scores_are_dot_products(spark):
    weights = np.random.default_rng(8).normal(size=quality.DIMS)
    texts = ["", "Some words here. And some more words, here.", None]
    got = quality.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()
    for r in got:
        at, values = quality.features(r.text or "")
        assert abs(r.score - 1 / (1 + np.exp(-sum(weights[i] * v for i, v in zip(at, values))))) < 1e-12


def test_lexicon_by_definition(spark):
    """The learnt lexicon against a plain count of contexts; it has no limit on entries or on the length of words."""
    rng = np.random.default_rng(6)
    clean, bad = [f"word{'abcdefghij'[k]}" for k in range(10)], ["nastyword", "vile", "n" * 60, "grim" * 9]
    texts = []
    for k in range(300):
        words = list(rng.choice(clean, 12))
        if k % 3 == 0:
            words[int(rng.integers(1, 11))] = bad[k // 3 % 4]
        texts.append((" ".join(words), int(k % 3 == 0)))
    found = toxicity.learn_lexicon(spark.createDataFrame(texts, "text string, label int"))
    seen = defaultdict(set)
    for text, label in texts:
        words = text.split()
        for a, w, b in zip(["", *words], words, [*words[1:], ""]):
            for stem in toxicity.word_stems(w):
                seen[stem, label].add((w, a, b))
    count = lambda stem, label: len(seen[stem, label])
    stems = {k for k, _ in seen}
    nt, nc = (sum(count(k, y) for k in stems if len(k) == 4) for y in (1, 0))
    odds = {k: ((count(k, 1) + 0.5) / (nt + 1)) / ((count(k, 0) + 0.5) / (nc + 1)) for k in stems}
    weights = {k: float(np.log(v)) for k, v in odds.items() if v >= toxicity.ODDS and count(k, 1) >= toxicity.CONTEXTS}
    expected = {k: w for k, w in weights.items() if not any(weights.get(k[:n], -9) >= w - 1.0 for n in range(4, len(k)))}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    assert {"nast", "vile", "nnnn", "grim"} <= set(found)


def test_toxic_matches_by_definition():
    """The automaton against a search for every entry at every place."""
    rng, pool = np.random.default_rng(7), ["idiot", "1D10T", "stupid", "trash", "can", "trash can", "xstupid", "stupidly", "simple", "m0r0n", "555", "ok", "clown", "fish"]
    entries = tuple(sorted({"idiot": 3.0, "stup": 2.0, "stupid ": 4.0, "moron": 1.0, "trash": 2.5, "clown": 1.5, "sss": 9.0}.items()))
    for _ in range(200):
        text = " ".join(rng.choice(pool, 8))
        folded, best = toxicity.fold(text), {}
        places = lambda word, whole: [i for i in range(len(folded)) if folded.startswith(word, i) and not (i and folded[i - 1].isalpha()) and not (whole and folded[i + len(word) : i + len(word) + 1].isalpha())]
        excused = [(i, i + len(p)) for p in toxicity.EXCEPTIONS for i in places(p, True)]
        for entry, weight in entries:
            word = entry.rstrip()
            for i in places(word, entry != word):
                if weight > best.get(i, (0, 0))[1]:
                    best[i] = (i + len(word), weight)
        assert toxicity.matches(text, entries) == [(i, e, w) for i, (e, w) in sorted(best.items()) if not any(a <= i and e <= b for a, b in excused)]
    assert toxicity.fold("call 555 now 4 you, 1D10T b00k 7up") == "call 555 now 4 you, idiot book tup"


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2 - 9 * (int(d) > 4)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()}


def test_personal_data(spark, folder, documents):
    expected = Counter()
    for d, text, _ in documents:
        spans = base_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, own in spans.items() for a, b in own)
        expected[d, *map(len, spans.values()), hashlib.sha256(listed.encode()).hexdigest()] += 1
    got = rows(spark, folder, "op8_pii")
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == expected
    for r in got:
        text = next(t for d, t, _ in documents if d == r.doc_id)
        spans = own_spans(text)
        assert (r.spans, r.scores, r.score) == (",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans), ",".join(f"{x:.2f}" for *_, x in spans), max((x for *_, x in spans), default=0.0))
    found = {r.doc_id: Counter(x.split(":")[0] for x in r.spans.split(",") if x) for r in got}
    assert found[900012]["iban"] == 2 and found[900018]["iban"] == 2 and found[900019]["secret"] == 1


def own_spans(text):
    """All spans with their scores, in plain Python: contract patterns, account numbers by country and remainder, keys behind a context word."""
    def mod97(m):
        plain = m.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1

    lengths = {c: n for n, own in pii.IBAN_LENGTHS.items() for c in own.split()}
    found = {k: list(own) for k, own in base_spans(text).items()}
    found["iban"] = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}", text):
        rest, n, at = lengths.get(m[0][:2], 0) - 4, 0, m.end()
        while rest > n and at < len(text):
            if text[at] == " " and n % 4 == 0:
                at += 1
            if at < len(text) and re.match("[A-Z0-9]", text[at]):
                n, at = n + 1, at + 1
            else:
                break
        if rest > 0 and n == rest and not re.match("[A-Za-z0-9]", text[at : at + 1]) and mod97(text[m.start() : at]):
            found["iban"].append((m.start(), at))
    found["secret"] = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])", text)]
    # the context of a span goes back to the match before it, also one that failed its check
    proposed = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": pii.CARD, "phone": pii.PHONE, "iban": pii.IBAN, "secret": pii.SECRET.replace("}+", "}")}
    out = []
    for kind, own in found.items():
        starts = [m.start() for m in re.finditer(proposed[kind], text)]
        for a, b in own:
            before = max((x for x in starts if x < a), default=0)
            near = re.search(pii.CONTEXT[kind], text[max(before, a - pii.CONTEXT_CHARS) : a])
            if kind != "secret" or near:
                out.append((kind, a, b, 1.0 if near else 0.75))
    return out


def test_personal_data_in_long_chains(spark):
    """A million labels, and a hundred thousand matches, in one text."""
    texts = ["a@b" + ".c" * 1_000_000, "1.1.1.1 " * 100_000, "+1 " * 100_000 + "(" * 100_000, "1-" * 200_000, "DE89 " * 50_000]
    got = pii.with_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.size("spans").alias("n"), F.get("spans", F.size("spans") - 1).alias("last")).collect()
    assert {r.doc_id: r.n for r in got} == {0: 1, 1: 100_000, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: (r.last.start, r.last.end) for r in got if r.n} == {0: (0, 2_000_003), 1: (799_992, 799_999)}


def test_redaction(spark):
    df = spark.createDataFrame([("é a@b.cd x",), (None,), ("",)], "text string")
    assert [r.redacted for r in pii.redacted(df).collect()] == ["é <email> x", "", ""]


def test_folding_and_exceptions():
    entries = tuple(sorted({s: toxicity.SEED_WEIGHT for s in toxicity.SEED}.items()))
    words = lambda t: [toxicity.fold(t)[s:e] for s, e, _ in toxicity.matches(t, entries)]
    assert words("You 1D10T and ѕtuріd m0r0n") == ["idiot", "stupid", "moron"]
    assert words("a trash can, a trash talker") == ["trash"]
    assert words("") == []


@pytest.mark.parametrize("digest", [None, lambda text: F.substring(F.sha2(text, 256), 1, 1)])
def test_exact_dedup(spark, folder, documents, digest):
    """Also with a digest of one digit, which confuses most texts: the comparison of the bytes has to sort it out."""
    from stringloom.llm import exact_dedup

    groups = defaultdict(list)
    for d, text, _ in documents:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), d is None, d or 0, d))
    expected = Counter()
    for own in groups.values():
        own.sort()
        for *_, d in own:
            expected[d, own[0][3], len(own)] += 1
    if digest is None:
        got = rows(spark, folder, "op10_exact_dedup")
        sha = {hashlib.sha256(t.encode()).hexdigest() for t in groups}
        assert {r.text_sha256 for r in got} == sha
    else:
        got = exact_dedup.exact_groups(spark.read.parquet(f"{folder}/documents.parquet"), digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("bits", [None, 1 << 15])
def test_bitmap_keeps_what_it_knows(spark, bits):
    from stringloom.llm import exact_dedup

    contents = spark.range(50_000).select(F.concat(F.lit("f#"), F.col("id").cast("string")).alias("locator"), "id")
    known = contents.filter("id % 50 = 7").select("locator")
    kept = {r.id for r in exact_dedup.only_known(contents, known, bits).collect()}
    assert kept >= set(range(7, 50_000, 50)) and len(kept) < (1_500 if bits is None else 5_000)


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    import corpus_pipeline

    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{TABLES}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert (queries.QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, str(tmp_path)).collect() == []
