"""Queries on made-up tables whose work once grew faster than the tables."""

import itertools
import math
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stringloom import plans
from stringloom.operators import distances, intervals, kmers, likelihood, merging, trees
from stringloom.sources import nodes
from tests.test_queries import comparable


def same_as_sql(spark, folder, name, **tables):
    """The query and its SQL on DataFrames of made-up tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.toPandas().to_parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(map(comparable, r)) for r in df.select(*columns).collect()), key=repr)
    found = con.execute(plans.ORACLE_SQL[name])
    places = [[c[0] for c in found.description].index(c) for c in columns]
    assert got == sorted((tuple(comparable(r[i]) for i in places) for r in found.fetchall()), key=repr)
    return got


def test_clusters_of_repeated_names(spark, tmp_path):
    """Suppliers of one name in several nations, and several times in one, with equal values and equal means."""
    rng = random.Random(13)
    rows = [(k, f"S{rng.randrange(40)}", k % 3, float(rng.randrange(-1000, 9000 if k % 3 == 0 else 3000)) / rng.choice([1, 4, 100])) for k in range(600)]
    rows += [(1000 + k, f"T{k}", 3, float(v)) for k, v in enumerate([1, 2, 2, 2, 3])] + [(1010, "U", 4, 1.0), (1011, "U", 4, 2.0), (1012, "U", 4, 3.0)]
    tables = {
        "supplier": spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "nation": spark.createDataFrame([(k, f"N{k}", 0) for k in range(6)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    assert len(same_as_sql(spark, tmp_path, "clusters", **tables)) == 4
    assert len(same_as_sql(spark, tmp_path, "cluster_representatives", **tables)) == 3


@pytest.mark.parametrize("name", ["base_units", "column_counts_of_texts", "consensus_of_bases", "distinct_characters", "max_frequency"])
def test_empty_texts_and_texts_without_a_language(spark, tmp_path, name):
    """The SQL has an empty letter at no place for each empty text, none for a null text, and no dots for texts of no language."""
    rows = [("en", "ACG-"), ("en", ""), ("en", ""), ("en", None), ("fr", ""), ("de", "a.n"), ("de", "r "), (None, "xyz"), (None, "x"), (None, ""), ("es", None)]
    found = same_as_sql(spark, tmp_path, name, documents=spark.createDataFrame(rows, "lang string, text string"))
    assert len([r for r in found if None in r]) > 3


def test_representatives_of_one_large_group(spark):
    """20,000 leaves of one group have 200 million pairs; none are made."""
    below = spark.range(20_001).selectExpr("'t' AS tree", "'n' AS node", "concat('L', id) AS leaf", "CAST((id * 7919) % 20001 AS double) AS value")
    found = spark.createDataFrame([("t", "n")], "tree string, node string")
    [best] = trees.representatives_of_values(found, below).collect()
    # the middle one of 0 to 20000 is the nearest to the others
    assert best.name == f"L{next(i for i in range(20_001) if i * 7919 % 20_001 == 10_000)}" and abs(best.mean - 10_000 * 10_001 / 20_000) < 1e-6


def test_codes_that_fit_one_pass(spark):
    """All genetic codes are tried in one pass over the codons, with the answers of a plain loop over the codes."""
    rng = random.Random(16)
    rows = [("".join(rng.choice("ACGTUNRYryX-." if k % 2 else "ACGT") for _ in range(rng.randrange(12))), "".join(rng.choice("FLSYWMKNRTIQ*X-.bZé") for _ in range(rng.randrange(4)))) for k in range(1500)]
    for dna, code in [("TGAATA", 2), ("CTGTGA", 12), ("AGAAGG", 13), ("TTATAG", 16)] * 10:
        rows.append((dna, "".join(intervals.genetic_code(code)[dna[i:i + 3]] for i in (0, 3))))
    rows += [(None, "M"), ("ATG", None)]

    def plain(dna, protein):
        if dna is None or protein is None:
            return []
        dna, out = dna.upper().replace("U", "T"), []
        for k in sorted(intervals.GENETIC_CODES):
            code = intervals.ambiguous_code(k)
            codons = [dna[i:i + 3] for i in range(0, len(dna) // 3 * 3, 3)]
            own = [c[0] if not c.strip("-.") else code.get(c, "X") for c in codons]
            pairs = itertools.zip_longest(own, protein.upper())
            if all(x == y or (x or "?") in "X-." or (y or "?") in "X-." for x, y in pairs):
                out.append(k)
        return out

    df = spark.createDataFrame(rows, "dna string, protein string")
    fit = intervals.codes_that_fit(F.col("dna"), F.col("protein"))
    assert [r[0] for r in df.select(fit).collect()] == [plain(*r) for r in rows]
    assert str(fit).count("regexp_extract_all") == 1


def test_rates_of_alike_leaves(spark, monkeypatch):
    """Leaves with one parent, branch length and letter are one row with a count; the rates are those of the leaves one by one."""
    nodes = [("t", "root", None, None, None)] + [("t", f"n{k}", "root", None, 0.3 + k) for k in range(2)] + [("t", f"l{k}", f"n{k % 2}", f"L{k}", 0.5 * (k % 3)) for k in range(300)]
    nodes += [("t", "l300", "root", "L300", 2.0), ("one", "r", None, "R", None)]
    letters = [("t", f"L{k}", col, "ACGT"[(k // 7 * col + k % 2) % 4]) for k in range(301) for col in (1, 2)] + [("one", "R", 1, "G")]
    df = spark.createDataFrame(nodes, "tree string, node string, parent string, name string, length double")
    written, real = {}, likelihood.sized
    monkeypatch.setattr(likelihood, "sized", lambda table, name: written.setdefault(name, real(table, name)) if name == "leaf-vectors" else real(table, name))
    got = {(r.tree, r.col): r for r in likelihood.column_rates(df, spark.createDataFrame(letters, "tree string, name string, col int, ch string"), rounds=1, steps=4).collect()}
    assert written["leaf-vectors"].count() <= 2 * 3 * 4 * 2 + 2 + 1
    b = likelihood.Model().speeds()[0]

    def value(col, rate):
        def moved(v, time):
            return [math.exp(-b * time * rate) * x + (1 - math.exp(-b * time * rate)) * sum(v) / 4 for x in v]

        base = {name: [float(x == ch) for x in "ACGT"] for tree, name, c, ch in letters if tree == "t" and c == col}
        logs = {p: [0.0] * 4 for p in ("root", "n0", "n1")}
        for _, _, parent, name, length in nodes[3:-1]:
            logs[parent] = [s + math.log(max(x, 1e-300)) for s, x in zip(logs[parent], moved(base[name], max(length, 1e-9)))]
        for k in range(2):
            top = max(logs[f"n{k}"])
            logs["root"] = [s + top + math.log(x) for s, x in zip(logs["root"], moved([math.exp(y - top) for y in logs[f"n{k}"]], 0.3 + k))]
        top = max(logs["root"])
        return top + math.log(sum(math.exp(x - top) for x in logs["root"]) / 4)

    for col in (1, 2):
        best, rate = max((value(col, (1 / 64) * 1024 ** (k / 4)), (1 / 64) * 1024 ** (k / 4)) for k in range(5))
        assert abs(got["t", col].rate - rate) < 1e-9 and abs(got["t", col].log_likelihood - best) < 1e-6
    assert abs(got["one", 1].log_likelihood - math.log(0.25)) < 1e-9


def test_rates_of_customers_of_one_name(spark, tmp_path):
    """Customers are leaves by their keys, also where they share names."""
    tables = {
        "customer": spark.range(1, 61).selectExpr("id AS c_custkey", "concat('C', id % 5) AS c_name", "CAST(id % 4 AS int) AS c_nationkey"),
        "nation": spark.range(4).selectExpr("CAST(id AS int) AS n_nationkey", "concat('N', id) AS n_name", "CAST(id % 2 AS int) AS n_regionkey"),
        "region": spark.range(2).selectExpr("CAST(id AS int) AS r_regionkey", "concat('R', id) AS r_name"),
    }
    assert len(same_as_sql(spark, tmp_path, "column_rates", **tables)) == 6


def test_partial_matches_of_long_texts(spark):
    """Texts of 30,000 letters are compared in one pass; gaps at both ends, unequal lengths and missing texts as before."""
    rng = random.Random(29)
    rows = [("".join(rng.choice("ab-.😀") for _ in range(rng.randrange(8))), "".join(rng.choice("ab-.é") for _ in range(rng.randrange(8)))) for _ in range(300)] + [(None, "a"), ("a", None), ("", ""), ("a-b", "---")]
    rows += [("ab" * 15_000, "-" * 100 + "b" * 29_000 + "..")] * 8

    def plain(whole, partial):
        if whole is None or partial is None:
            return None, None, 0.0
        places = [i for i, ch in enumerate(partial) if ch not in "-."]
        inside = list(zip(whole, partial))[places[0]:places[-1] + 1] if places else []
        off = sum(x != y for x, y in inside)
        return len(inside), off, ((len(inside) - off) / len(inside) if inside else 0.0) - max(6 - len(inside), 0) * 0.1

    df = spark.createDataFrame(rows, "whole string, partial string").coalesce(1)
    start = time.perf_counter()
    found = df.select(distances.overlap_match(F.col("whole"), F.col("partial"), least=6, outside=0.1).alias("m")).select("m.*").collect()
    assert time.perf_counter() - start < 20
    assert [(r.overlap, r.different, round(r.score, 9)) for r in found] == [(n, off, round(score, 9)) for n, off, score in (plain(*r) for r in rows)]


def test_column_map_moves_texts(spark):
    """Of two alignments only the texts are joined, whatever their length; the map is a plain loop's, also where references repeat."""
    rng = random.Random(26)
    row = lambda: (rng.choice([None, *range(40)]), rng.choice([None, "", "--", "".join(rng.choice("ab-.é😀") for _ in range(12))]))
    sides = [[row() for _ in range(100)] for _ in range(2)]
    bases = lambda t: [i + 1 for i, ch in enumerate(t or "") if ch not in "-."]
    plain = {}
    for key, s in sides[0]:
        for other, t in sides[1]:
            if key is not None and key == other:
                for x, y in zip(bases(s), bases(t)):
                    plain[x] = min(plain.get(x, y), y)
    dfs = [spark.createDataFrame(rows, "id int, data string") for rows in sides]
    found = merging.column_map(*dfs, "id", "data")
    assert {r.source: r.target for r in found.collect()} == plain
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join"), "texts are cut into rows only behind the join"


def test_node_tables_are_made_once(spark, tmp_path):
    """A node table that is read several times isn't joined together anew each time."""
    (tmp_path / "a.arb").write_text('/*ARBDB ASCII*/\nitem\t\t%% (%\n\tname\t\t"x"\n\t%)\n')
    found = nodes.read_nodes(spark, str(tmp_path / "a.arb"))
    assert [(r.path, r.value) for r in found.orderBy("id").collect()] == [("/item", None), ("/item/name", "x")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_designed_probes_are_counted_before_rows_are_made(spark, monkeypatch):
    """k-mers are numbered in tasks whatever the alphabet; in other texts only those count that enough targets have."""
    rng = random.Random(18)
    letters = ["ACGT", "AC\0é😀", "".join(map(chr, range(0x4E00, 0x5200)))]
    rows = [(n, ("xy", "x", None)[n % 3], "".join(rng.choice(letters[n % 5 % 3]) for _ in range(rng.randrange(60)))) for n in range(200)] + [(200, "x", None), (201, "xy", "ACG")]
    items = spark.createDataFrame(rows, "item long, flag string, data string")
    # a few texts at once, and all
    for k, share, most, at_once in ((3, 0.1, 20, 1 << 22), (4, 0.02, 3, 500), (7, 0.0, 200, 1 << 22), (1, 0.0, 200, 500)):
        monkeypatch.setattr(kmers, "_AT_ONCE", at_once)
        of = lambda own: [{t[i:i + k]: i + 1 for i in reversed(range(len(t) - k + 1))} for t in own]
        targets, others = (of(t or "" for _, flag, t in rows if (flag == "xy") == own) for own in (True, False))
        want = {}
        for kmer in set().union(*targets):
            first = [d[kmer] for d in targets if kmer in d]
            n = sum(kmer in d for d in others)
            if len(first) >= len(targets) * share and n <= most:
                want[kmer] = (len(first), n, min(first))
        got = kmers._designed(items, "data", F.col("flag") == "xy", k, share, most).collect()
        assert want and len(got) == len(want) and {r.kmer: (r.targets, r.others, r.first) for r in got} == want
    line = np.array([ord(c) for c in "".join(rng.choice(letters[2]) for _ in range(3000))], np.uint32)
    line = np.concatenate([line, line])
    numbers = kmers._numbered(line, 20)
    assert len(numbers) == 5981 and len(np.unique(numbers)) == 3000 and (numbers[:2981] == numbers[3000:]).all()


def test_covering_probes_of_sets(spark, monkeypatch):
    """The same probes whether the best buckets are broadcast, only some of them, or none; sets take the place of rows."""
    rng = random.Random(19)
    sets = [(k, sorted({min(int(rng.expovariate(0.03)), 150) for _ in range(rng.randrange(5))})) for k in range(300)] + [(300, []), (301, [900, 901])]
    rows = [(f"p{x}", f"i{k}") for k, own in sets for x in own]
    hits = spark.createDataFrame(rows, "kmer string, item string")
    out = spark.createDataFrame([("p900",), ("p3",), ("p3",)], "kmer string")
    held = spark.createDataFrame([([f"p{x}" for x in own],) for _, own in sets], "kmers array<string>")
    found = []
    for few in (10_000, 30, 0):
        monkeypatch.setattr(kmers, "COVER_FEW", few)
        for got in (kmers.covering_sets(held, out), kmers.covering_probes(hits.unionByName(hits), out)):
            found.append(sorted(tuple(r) for r in got.collect()))
    assert found[0] and all(f == found[0] for f in found)
    taken = {kmer for _, kmer, _ in found[0]}
    assert not taken & {"p900", "p3"}
    assert all(taken & {f"p{x}" for x in own} for _, own in sets if set(own) - {900, 3})
