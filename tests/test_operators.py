"""Operators against small cases worked by hand and against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stringloom.functions import predicates as p
from stringloom.operators import columns, distances, intervals, kmers, merging, search, trees
from stringloom.operators.storage import ranked
from stringloom.sources import nodes as node_io
from stringloom.sources import records


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_wildcards(spark):
    cases = [("abc", "a*c", True), ("abc", "ab*bc", True), ("abc", "A?C", True), ("abc", "ab", False), ("abc", "*", True), ("a\nc", "a*", True), ("", "*", True), ("a.c", "a.?", True), ("abc", "a.?", False)]
    df = spark.createDataFrame([(a, b, c) for a, b, c in cases], "v string, pattern string, hit boolean")
    for pattern in {c[1] for c in cases}:
        for row in df.filter(F.col("pattern") == pattern).select("v", "hit", p.wildcard(F.col("v"), pattern).alias("got")).collect():
            assert row.got == row.hit, (row.v, pattern)
    assert one(spark, p.wildcard(F.lit(None).cast("string"), "*")) is False


def test_missing_values_and_negation(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "")], "id long, v string")
    ids = lambda c: [r.id for r in df.filter(c).orderBy("id").collect()]
    v = F.col("v")
    assert ids(p.matches(v, "")) == [3]
    assert ids(p.matches(v, "*")) == [1, 2]
    assert ids(p.matches(v, "<7")) == [1]
    assert ids(p.combined(p.Line(p.matches(v, "<7"), negated=True))) == [2, 3, 4]
    assert ids(p.any_field([F.col("id"), v], "x")) == [2]


def nucleotide_consensus(sequences, gap_bound=60, consider=30, upper=95, lower=70, count_gaps=True):
    out = ""
    for chars in zip(*sequences):
        units = Counter()
        for ch in chars:
            for b in columns.AMBIGUITY.get(ch.upper(), ""):
                units[b] += 12 // len(columns.AMBIGUITY[ch.upper()])
        total, s = 12 * len(chars), sum(units.values())
        if not s:
            out += "="
            continue
        if count_gaps and 100 * (total - s) // total >= gap_bound:
            out += "-"
            continue
        chosen = [b for b in "ACGT" if units[b] and 100 * units[b] // s >= consider]
        if chosen:
            letter, k = columns.CODES[sum(1 << "ACGT".index(b) for b in chosen)], sum(units[b] for b in chosen)
        else:
            letter = max("ACGT", key=lambda b: units[b])
            k = units[letter]
        share = 100 * k // (total if count_gaps else s)
        out += letter if share >= upper else letter.lower() if share >= lower else "."
    return out


@pytest.mark.parametrize("options", [{}, {"count_gaps": False}, {"consider": 26, "lower": 0, "upper": 75}])
def test_consensus(spark, options):
    rng = random.Random(3)
    sequences = ["".join(rng.choice("AACCGT-.NRYmk") for _ in range(60)) for _ in range(9)]
    df = spark.createDataFrame([(x,) for x in sequences], "data string")
    names = {"consider": "consider_bound"}
    found = columns.consensus(columns.counts(df, "data"), **{names.get(k, k): v for k, v in options.items()})
    assert columns.joined(found, "letter").first().data == nucleotide_consensus(sequences, **options)


def test_short_sequences_count_as_dots(spark):
    df = spark.createDataFrame([("g", "ab"), ("g", "abcd"), ("g", None), ("h", "x")], "k string, data string")
    got = {(r.k, r.pos, r.ch): r.n for r in columns.counts(df, "data", "k").collect()}
    assert got == {("g", 1, "a"): 2, ("g", 1, "."): 1, ("g", 2, "b"): 2, ("g", 2, "."): 1, ("g", 3, "c"): 1, ("g", 3, "."): 2, ("g", 4, "d"): 1, ("g", 4, "."): 2, ("h", 1, "x"): 1}
    assert columns.counts(df.filter("false"), "data").count() == 0


def test_signed_counts_equal_recount(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ACG-") for _ in range(12))) for i in range(20)]
    after = [(i, x[::-1] if i % 3 == 0 else x) for i, x in rows]
    a, b = (spark.createDataFrame(x, "id long, data string") for x in (rows, after))
    moved = {(r.pos, r.ch): r.n for r in columns.signed_counts(a, b, "data").collect()}
    full = lambda df: Counter({(r.pos, r.ch): r.n for r in columns.counts(df, "data").collect()})
    before, now = full(a), full(b)
    assert {k: now[k] - before[k] for k in before.keys() | now.keys() if now[k] != before[k]} == moved


def test_runs_and_filters(spark):
    assert [tuple(r) for r in one(spark, columns.runs(F.lit("xx--x-"), "x"))] == [(1, 2), (5, 5)]
    assert one(spark, columns.runs(F.lit("---"), "x")) == []
    df = spark.createDataFrame([(1, "a-b-"), (2, "--b-")], "id long, data string")
    assert [r.data for r in columns.without_common_gaps(df, "data").orderBy("id").collect()] == ["ab", "-b"]
    sampled = columns.resampled(df, "data", 4, seed=1).orderBy("id").collect()
    assert len(sampled[0].data) == 4 and all((x == "a") <= (y == "-") for x, y in zip(sampled[0].data, sampled[1].data))
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (4, 5, 0.7), (5, 6, 0.1)], "p int, q int, information double")
    assert {r.pos: r.cluster for r in columns.correlated_clusters(pairs, 0.5).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_probe_match_is_exhaustive(spark):
    rng = random.Random(11)
    texts = [(i, "".join(rng.choice("ab") for _ in range(80))) for i in range(6)] + [(6, ""), (7, None), (8, "ab")]
    probes = [(i, "".join(rng.choice("ab") for _ in range(9 + i))) for i in range(4)] + [(9, ""), (10, None)]
    found = kmers.probe_match(spark.createDataFrame(probes, "p long, probe string"), "p", "probe", spark.createDataFrame(texts, "id long, text string"), "id", "text", 2, 3)
    expected = set()
    for pid, probe in probes:
        for tid, text in texts:
            for at in range(len(text or "") - len(probe or "") + 1) if probe and text else ():
                off = sum(x != y for x, y in zip(probe, text[at:]))
                if off <= 2:
                    expected.add((pid, tid, at + 1, off))
    rows = [tuple(r) for r in found.select("probe_id", "id", "position", "mismatches").collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_windows_of_letters_beyond_the_basic_plane(spark):
    df = spark.createDataFrame([(1, "a😀b😀c"), (2, "ab"), (3, None)], "id long, text string")
    got = sorted((r.kmer, r.n) for r in kmers.kmer_counts(df, "id", "text", 3).collect())
    assert got == sorted([("a😀b", 1), ("😀b😀", 1), ("b😀c", 1)])


def test_weights_and_acceptance(spark):
    assert one(spark, kmers.weighted_mismatches(F.lit("ACGT"), F.lit("ACGT"), {"AC": 2.0})) == 0.0
    middle = 1 * 2 / 9 * 4 * 1.0 + 0.3
    assert math.isclose(one(spark, kmers.weighted_mismatches(F.lit("AAGT"), F.lit("ACGT"), {"AC": 2.0})), 2 * middle)
    accepted = [one(spark, kmers.accepted_ambiguous(F.lit(a), F.lit(b), 1)) for a, b in ((1, 1), (2, 1), (2, 0), (4, 0))]
    assert accepted == [True, False, True, False]


def made_up_location(rng):
    """A location as text, and its parts (start, stop, complement, fuzzy start, fuzzy stop) in the order in which they are read."""
    parts, texts = [], []
    for _ in range(rng.randint(1, 4)):
        a = rng.randint(1, 900)
        kind, complement = rng.choice(["one", "range", "between"]), rng.random() < 0.3
        if kind == "one":
            part, text = (a, a, complement, "", ""), str(a)
        elif kind == "between":
            part, text = (a + 1, a, complement, "", ""), f"{a}^{a + 1}"
        else:
            b, f, g = a + rng.randint(1, 50), rng.choice(["", "<"]), rng.choice(["", ">"])
            part, text = (a, b, complement, f, g), f"{f}{a}..{g}{b}"
        parts.append(part)
        texts.append(f"complement({text})" if complement else text)
    text = texts[0] if len(texts) == 1 else f"{rng.choice(['join', 'order'])}({','.join(texts)})"
    if len(texts) > 1 and rng.random() < 0.3:
        text, parts = f"complement({text})", [(a, b, not c, f, g) for a, b, c, f, g in reversed(parts)]
    return text, parts


def test_locations(spark):
    """Random locations against their parts, as text again, and as fields; what is no location has no parts."""
    rng = random.Random(3)
    made = [made_up_location(rng) for _ in range(300)]
    df = spark.createDataFrame([(k, text if k % 2 else text.replace(",", " , ")) for k, (text, _) in enumerate(made)], "id int, text string")
    parts = intervals.location_parts(F.col("text"))
    fields = intervals.position_fields(F.col("parts"))
    placed = spark.createDataFrame(df.select("id", parts.alias("parts")).collect(), "id int, parts array<struct<start: int, stop: int, complement: boolean, fuzzy_start: string, fuzzy_stop: string>>")
    rows = spark.createDataFrame(placed.select("id", "parts", fields.alias("f"), intervals.location_text(F.col("parts")).alias("text")).collect()).select("id", "parts", "f", intervals.parts_of_fields(F.col("f.pos_start"), F.col("f.pos_stop"), F.col("f.pos_complement"), F.col("f.pos_certain")).alias("again"), intervals.location_parts(F.col("text")).alias("read"))
    for r in rows.collect():
        assert [tuple(p) for p in r.parts] == [tuple(p) for p in r.again] == [tuple(p) for p in r.read] == made[r.id][1]
        assert r.f.pos_joined == len(r.parts)
    assert [len(one(spark, intervals.location_parts(F.lit(x)))) for x in ("5-9", "", "join(x)", "five")] == [0, 0, 0, 0]


def test_location_of_very_many_parts(spark):
    text = "join(" + ",".join(f"{10 * k + 1}..{10 * k + 5}" for k in range(100_000)) + ")"
    row = spark.createDataFrame([(text,)], "text string").select(intervals.location_parts(F.col("text")).alias("p")).select(F.size("p"), F.element_at("p", -1)["stop"]).first()
    assert tuple(row) == (100_000, 999_995)


def test_extraction(spark):
    data = F.lit("ACGTTGCA")
    cut = lambda location: one(spark, intervals.extracted(data, intervals.location_parts(F.lit(location))))
    assert cut("2..4") == "CGT" and cut("complement(2..4)") == "ACG" and cut("join(1..2,complement(7..8))") == "ACTG"
    assert cut("complement(join(1..2,7..8))") == "TGGT" and cut("4^5") == "" and cut("5..9") is None
    assert one(spark, intervals.translated(F.lit("ATGTGA---AUNG"))) == "M*-X"
    assert one(spark, intervals.translated(F.lit("ATGTGA"), 4)) == "MW"
    assert one(spark, intervals.ends_dotted(F.lit("--a-c--"))) == "..a-c.." and one(spark, intervals.ends_dotted(F.lit("--"))) == ".."


def test_regions(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 6, 8), ("a", 11, 12), ("b", 4, 4)], "g string, start long, stop long")
    for size in (None, 2, 100):
        assert sorted(map(tuple, intervals.merged(df, "g", bin_size=size).collect())) == [("a", 1, 8, 3), ("a", 11, 12, 1), ("b", 4, 4, 1)]
    sizes = spark.createDataFrame([("a", 15), ("b", 4)], "g string, length long")
    assert sorted(map(tuple, intervals.free_regions(df, sizes, "g").collect())) == [("a", 9, 10), ("a", 13, 15), ("b", 1, 3)]


def test_remapped_columns(spark):
    a = spark.createDataFrame([("r", "AC-GT"), ("s", "A--GT")], "name string, data string")
    b = spark.createDataFrame([("r", "A-CG-T")], "name string, data string")
    mapping = merging.column_map(a, b, "name", "data")
    assert {r.source: r.target for r in mapping.collect()} == {1: 1, 2: 3, 4: 4, 5: 6}
    assert [r.data for r in merging.remapped(a, "data", mapping, 6).orderBy("name").collect()] == ["A-CG-T", "A--G-T"]


NEWICK = "[made up [twice] here]((oak:0.2, elm:0.4)broad:0.6,(fir : 0.3,'red pine':0.1)80:0.1,(fern:0.02, \"tall-moss\":0.04)'90:low':0.06):0.2;"


def test_newick(spark):
    df = spark.createDataFrame([("t", NEWICK), ("u", "(x,y);")], "tree string, text string")
    found = node_io.trees(df, "tree", "text")
    t = {r.node: r for r in found.filter("tree = 't'").collect()}
    assert [t[k].name for k in sorted(t)] == [None, "broad", "oak", "elm", None, "fir", "red pine", "low", "fern", "tall-moss"]
    assert t[4].support == 80 and t[7].support == 90 and t[2].length == 0.2 and t[1].length == 0.6 and t[0].parent is None
    again = {r.tree: r.newick for r in node_io.newick(found).collect()}
    assert again["u"] == "(x,y);" and again["t"].startswith("((oak:0.2,elm:0.4)broad:0.6,(fir:0.3,'red pine':0.1):0.1,")
    assert {r.tree: (r.leaves, r.inner_nodes, r.groups) for r in trees.info(found).collect()} == {"t": (6, 4, 2), "u": (2, 1, 0)}


def test_consensus_keeps_sets_as_rows(spark):
    """Nested majority sets, a root with one child, and sets that differ in a leaf; no step makes one row of a set."""
    texts = [("a", "(((A,B),C),(D,E),F);"), ("b", "(((B,A),C),((D,F),E));"), ("c", "(((A,C),B,D),(E,F));"), ("d", "((((A,B),C),D,E,F));")]
    forest = node_io.trees(spark.createDataFrame(texts, "tree string, newick string"), "tree", "newick")
    below, weight = {}, Counter()
    for r in trees.members(forest).collect():
        below.setdefault((r.tree, r.node), set()).add(r.leaf)
    for tree, leaves in {(t, frozenset(x)) for (t, _), x in below.items()}:
        weight[leaves] += 1 < len(leaves) < 6
    found = trees.splits(forest)
    assert {k: v for k, v in found.dtypes}["leaf"] == "string" and not any("array" in v for _, v in found.dtypes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    rows = {}
    for r in found.collect():
        rows.setdefault((r.set, r.size, r.weight), set()).add(r.leaf)
    assert {frozenset(x): w for (_, n, w), x in rows.items() if n == len(x)} == {k: v for k, v in weight.items() if v} and len(rows) == sum(v > 0 for v in weight.values())
    kept = {}
    for r in trees.consensus(found, 4.0).collect():
        kept.setdefault((r.node, r.parent, r.support), set()).add(r.leaf)
    names = {n: frozenset(x) for (n, _, _), x in kept.items()}
    assert {frozenset(x): (names.get(p), s) for (_, p, s), x in kept.items()} == {frozenset("AB"): (frozenset("ABC"), 0.75), frozenset("ABC"): (None, 0.75)}


def test_tree_changes(spark):
    found = node_io.trees(spark.createDataFrame([("t", NEWICK)], "tree string, text string"), "tree", "text")
    pruned = trees.pruned(found, spark.createDataFrame([("t", "oak"), ("t", "fir"), ("t", "red pine")], "tree string, name string"))
    got = {r.name: r for r in pruned.collect() if r.name}
    assert math.isclose(got["oak"].length, 0.8) and got["oak"].parent == 0 and got["fir"].parent == got["red pine"].parent == 4
    flat = trees.multifurcated(found, 85).filter("name in ('fir', 'fern')").collect()
    assert {r.name: r.parent for r in flat} == {"fir": 0, "fern": 7}
    d = trees.common_ancestors(spark.createDataFrame([("t", 2, 8), ("t", 2, 3)], "tree string, a long, b long"), trees.closure(found))
    assert {(r.a, r.b): (r.ancestor, round(r.distance, 6)) for r in d.collect()} == {(2, 8): (0, 0.88), (2, 3): (1, 0.6)}
    # brothers are equally large, so the smallest name below decides
    assert {r.name: r.position for r in trees.leaf_order(found).collect()} == {"elm": 1, "oak": 2, "fern": 3, "tall-moss": 4, "fir": 5, "red pine": 6}


def test_marked_leaves_in_the_order_of_the_tree(spark):
    found = node_io.trees(spark.createDataFrame([("t", NEWICK), ("u", NEWICK)], "tree string, text string"), "tree", "text")
    marks = spark.createDataFrame([("t", "fir"), ("t", "oak"), ("u", "fern"), ("u", "fir"), ("u", "fir"), ("u", "nowhere")], "tree string, name string")
    assert {(r.tree, r.name): r.place for r in trees.configuration(found, marks).collect()} == {("t", "oak"): 1, ("t", "fir"): 2, ("u", "fern"): 1, ("u", "fir"): 2}
    small_first = {(r.tree, r.name): r.position for r in trees.leaf_order(found, big_first=False).collect()}
    assert len(small_first) == 12 and sorted(small_first.values()) == sorted([*range(1, 7)] * 2)


def test_moves_below_itself_are_an_error(spark):
    found = node_io.trees(spark.createDataFrame([("t", NEWICK)], "tree string, text string"), "tree", "text")
    with pytest.raises(PySparkException, match="below itself"):
        trees.moved(found, spark.createDataFrame([("t", 1, 2)], "tree string, node long, under long")).collect()


@pytest.mark.parametrize("a, b, d", [(None, None, 0), ("x/y", None, 2), ("x/y", "x/y", 0), ("x/y/z", "x/q", 3), ("", "x", 1)])
def test_path_difference(spark, a, b, d):
    assert one(spark, trees.path_difference(F.lit(a).cast("string"), F.lit(b).cast("string"))) == d


def plain_neighbour_joining(names, d):
    """Steps of neighbour joining on one tree: {node: (parent, length)}; nodes by number, leaves by name first."""
    d = {frozenset((names.index(a), names.index(b))): x for (a, b), x in d.items()}
    live, parents, new = list(range(len(names))), {}, len(names)
    while len(live) > 2:
        r = {i: sum(d[frozenset((i, k))] for k in live if k != i) for i in live}
        _, j, i = min((d[frozenset((i, j))] - (r[i] + r[j]) / (len(live) - 2), j, i) for i in live for j in live if i < j)
        ij = d[frozenset((i, j))]
        own = ij / 2 + (r[i] - r[j]) / (2 * (len(live) - 2))
        parents[i], parents[j] = (new, own), (new, ij - own)
        live = [k for k in live if k not in (i, j)]
        for k in live:
            d[frozenset((k, new))] = (d[frozenset((i, k))] + d[frozenset((j, k))] - ij) / 2
        live.append(new)
        new += 1
    for k in live:
        parents[k] = (new, d[frozenset(live)] / 2)
    return parents


def test_neighbour_joining(spark):
    """Every join of several trees of different sizes, made in the same rounds, against one tree after the other."""
    rng, rows, expected = random.Random(8), [], {}
    for tree, n in (("two", 2), ("three", 3), ("six", 6), ("nine", 9)):
        names = [f"leaf{k}" for k in range(n)]
        d = {(a, b): round(rng.uniform(0.1, 2.0), 3) for i, a in enumerate(names) for b in names[i + 1 :]}
        rows += [(tree, *(pair if rng.random() < 0.5 else pair[::-1]), x) for pair, x in d.items()]
        expected[tree] = (names, plain_neighbour_joining(names, d))
    found = trees.neighbour_joining(spark.createDataFrame(rows, "tree string, a string, b string, distance double")).collect()
    for tree, (names, parents) in expected.items():
        own = {r.node: r for r in found if r.tree == tree}
        assert {k: r.name for k, r in own.items() if r.name} == dict(enumerate(names))
        assert {k: r.parent for k, r in own.items() if r.parent is not None} == {k: p for k, (p, _) in parents.items()}
        assert all(math.isclose(own[k].length, x, abs_tol=1e-9) for k, (_, x) in parents.items()) and len(own) == len(parents) + 1


def test_parsimony(spark):
    nodes = spark.createDataFrame([("t", 0, None, None, 1.0), ("t", 1, 0, None, 1.0), ("t", 2, 1, "a", 1.0), ("t", 3, 1, "b", 1.0), ("t", 4, 0, "c", 1.0)], "tree string, node long, parent long, name string, length double")
    data = spark.createDataFrame([("t", "a", "ACAN"), ("t", "b", "ACGA"), ("t", "c", "AGTA")], "tree string, name string, data string")
    assert [r.mutations for r in trees.parsimony(nodes, data).orderBy("column").collect()] == [0, 1, 2, 0]


def test_distances(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "ACGA"), ("c", "A-.T")], "name string, data string")
    found = {(r.a, r.b): r.distance for r in distances.distances(df, df, "name", "data", each_once=True).collect()}
    assert found == {("a", "b"): 0.25, ("a", "c"): 0.0, ("b", "c"): 0.5}
    assert math.isclose(one(spark, distances.jukes_cantor(F.lit(0.25))), -0.75 * math.log(1 - 0.25 / 0.75))
    assert one(spark, distances.jukes_cantor(F.lit(0.8))) is None
    lines = node_io.matrix_lines(distances.square(distances.distances(df, df, "name", "data", each_once=True)), "%.2f").orderBy("a").collect()
    assert [r.line for r in lines] == ["a", "b 0.25", "c 0.00 0.50"]


DUMP = '''/*ASCII dump*/
item_data\t\t%% (%
\titem\t\t:5000\t%$ (%
\t\tname\t\t:7600\t"first"
\t\tali\t\t\t%% (%
\t\t\tdata\t\t:7000\t"AC-GT"
\t\t\t%) /*ali*/

\t\tcolor\t\t\t%i 2
\t\tnumber\t\t\t%f 3.14
\t\tnumber\t\t\t%f 2.71
\t\tbits\t\t\t%I\t"-+-"
\t\t%) /*item*/

\titem\t\t:5000\t%% (%
\t\tname\t\t"sec\\"ond"
\t\tpercent\t\t%s\t"%text"
\t\t%) /*item*/

\t%) /*item_data*/
'''


def test_node_dump(spark, tmp_path):
    (tmp_path / "x.dump").write_text(DUMP)
    nodes = node_io.read_nodes(spark, str(tmp_path / "x.dump")).cache()
    items = node_io.items_of(nodes, "/item_data/item", ["name", "color", "number", "percent"]).orderBy("id").collect()
    assert [(r.marked, r.name, r.color, r.number, r.percent) for r in items] == [(True, "first", "2", "3.14", None), (False, 'sec"ond', None, None, "%text")]
    assert [r.value for r in node_io.at_path(nodes, "/item_data/*/ali/data").collect()] == ["AC-GT"]
    first = nodes.filter("path = '/item_data/item'").orderBy("id").limit(1)
    assert [r.value for r in node_io.children(nodes, first, "number").orderBy("ord").collect()] == ["3.14", "2.71"]
    assert nodes.filter("key = 'bits'").select(node_io.dump_line(F.col("key"), F.col("type"), F.col("value"))).first()[0] == 'bits\t\t%I "-+-"'


def test_record_files(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">s1 first one\nACGT\nAC\n>s2\nGG\n\n")
    assert [tuple(r) for r in records.read_fasta(spark, str(tmp_path / "x.fasta")).orderBy("name").collect()] == [("s1", "first one", "ACGTAC"), ("s2", "", "GG")]
    (tmp_path / "x.embl").write_text("ID   AB1; SV 1; linear\nXX\nAC   AB1;\nDE   Some organism\nDE   and more.\nRA   One A.;\nRN   [2]\nRA   Two B.;\nFT   gene            complement(1..4)\nFT                   /gene=\"x y\"\nSQ   Sequence 6 BP;\n     acgt ac       6\n//\nID   AB2;\nSQ\n     gg  2\n//\n")
    rows = records.read_embl(spark, str(tmp_path / "x.embl")).orderBy("name").collect()
    assert [(r.name, r.acc, r.full_name, r.author, r.data) for r in rows] == [("AB1", "AB1", "Some organism and more.", "One A. Two B.", "acgtac"), ("AB2", None, None, None, "gg")]
    found = records.read_entries(spark, str(tmp_path / "x.embl"), 5).select(F.explode(records.features(F.col("record"))).alias("f")).select("f.*").filter("kind = 'gene'").first()
    assert (found.location, found.qualifiers) == ("complement(1..4)", ["gene=x y"])
    (tmp_path / "x.gb").write_text("LOCUS       AB3  6 bp\nDEFINITION  Some organism,\n            partial.\nACCESSION   AB3\nSOURCE      x\n  ORGANISM  Some organism\nORIGIN\n        1 acgt ac\n//\n")
    row = records.read_genbank(spark, str(tmp_path / "x.gb")).first()
    assert (row.name, row.full_name, row.tax, row.data) == ("AB3", "Some organism, partial.", "Some organism", "acgtac")
    kinds = {"embl": "ID  *", "genbank": "LOCUS *", "fasta": ">*"}
    assert one(spark, records.detected(F.lit("LOCUS   x"), kinds)) == "genbank" and one(spark, records.detected(F.lit("?"), kinds)) is None


def test_written_records(spark):
    fields = {"ID": F.lit("AB1;"), "DE": F.lit(None).cast("string")}
    lines = one(spark, records.embl(fields, F.lit("ACGT" * 3))).split("\n")
    assert lines[:2] == ["ID   AB1;", "SQ   Sequence 12 BP;"] and lines[3] == "//"
    assert lines[2].split() == ["ACGTACGTAC", "GT", "12"] and len(lines[2]) == 5 + 65 + 10
    assert one(spark, records.genbank({"LOCUS": F.lit("AB1")}, F.lit("ACGT"))) == "LOCUS       AB1\nORIGIN\n1         acgt\n//"
    df = spark.createDataFrame([("b", "GG--"), ("a", "ACGT")], "name string, data string")
    assert [r.value for r in records.phylip(df, "name", "data").collect()] == ["2 4", "a         ACGT", "b         GG--"]


def test_sheet_and_names(spark):
    items = spark.createDataFrame([(1, "x"), (2, "y")], "id long, a string")
    sheet = spark.createDataFrame([(2, "z", 5), (3, "n", 6)], "id long, a string, b int")
    assert [tuple(r) for r in records.import_sheet(items, sheet, "id").orderBy("id").collect()] == [(1, "x", None), (2, "z", 5)]
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id long, name string")
    got = {r.id: r.unique_name for r in search.numbered_names(names, "id", "name").collect()}
    assert got[1] == "a001" and got[2] == "a002" and got[3] == "b"
    mapping = spark.createDataFrame([("a", "q")], "old string, new string")
    assert [r.name for r in search.renamed(names, "name", mapping).orderBy("id").collect()] == ["q", "q", "b", None, None]


def test_ranks_without_a_global_window(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(200)], "id long, k long").repartition(5)
    got = {r.id: r.rank for r in ranked(df, [F.desc("k"), F.asc("id")]).collect()}
    assert got == {x: n + 1 for n, x in enumerate(sorted(range(200), key=lambda i: (-(i % 7), i)))}
    assert ranked(df.filter("false"), [F.asc("id")]).count() == 0


def test_alignment_is_best(spark):
    from functools import lru_cache

    from stringloom.operators.aligning import GAP, MATCH, MISMATCH, align

    rng = random.Random(2)
    for _ in range(40):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))

        @lru_cache(None)
        def best(i, j):
            ways = [(i + j) * GAP] if not (i and j) else [best(i - 1, j - 1) + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), best(i - 1, j) + GAP, best(i, j - 1) + GAP]
            return max(ways)

        x, y, score = align(a, b)
        assert score == best(len(a), len(b)) and x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
        assert score == sum(GAP if "-" in (p, q) else MATCH if p == q else MISMATCH for p, q in zip(x, y))


def test_made_up_sequences(spark):
    from stringloom.sources.synthetic import sequences

    rows = {r.id: r for r in sequences(spark, 31, 200, 0.1).collect()}
    assert rows[1].parent is None and all(len(r.data) == 200 and set(r.data) <= set("ACGT") for r in rows.values())
    off = [sum(x != y for x, y in zip(rows[i].data, rows[i // 2].data)) for i in range(2, 32)]
    assert 5 < sum(off) / len(off) < 25
    assert {r.id: r for r in sequences(spark, 31, 200, 0.1).repartition(7).collect()} == rows


def test_rerooted(spark):
    found = node_io.trees(spark.createDataFrame([("t", "(((a:1,b:2):3,c:4):5,d:6);")], "tree string, text string"), "tree", "text")
    at = found.filter("name = 'a'").select("tree", "node")
    turned = trees.rerooted(found, at, 99)
    assert node_io.newick(turned).first().newick.count("(") == 3
    names = {r.name: r.node for r in turned.collect() if r.name}
    both = [("t", names[x], names[y]) for x in "abcd" for y in "abcd" if x < y]
    way = lambda n, ids: {(r.a, r.b): r.distance for r in trees.common_ancestors(spark.createDataFrame(ids, "tree string, a long, b long"), trees.closure(n)).collect()}
    assert way(turned, both) == way(found, both)
    assert turned.filter("parent is null").first().node == 99 and 0 not in {r.node for r in turned.collect()}


def test_more_writers(spark):
    df = spark.createDataFrame([("b", "GG--"), ("a'c", "ACGT")], "name string, data string")
    assert "\n".join(r.value for r in records.nexus(df, "name", "data").collect()) == "#NEXUS\nbegin data;\ndimensions ntax=2 nchar=4;\nformat datatype=DNA gap=- missing=.;\nmatrix\n'a''c' ACGT\n'b' GG--\n;\nend;"
    assert one(spark, records.gcg(F.lit("x"), F.lit("AC"))) == "x  Length: 2  Check: 199  ..\n\n1         AC"
    assert one(spark, records.pir(F.lit("x"), F.lit("t"), F.lit("AC"))) == ">P1;x\nt\nAC*"


def test_codes_and_cover(spark):
    assert [one(spark, columns.combined_code(F.array(*map(F.lit, x)))) for x in ("AG", "acgt", "-A", "YR", "--")] == ["R", "N", "A", "N", "-"]
    hits = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2), ("y", 3), ("z", 3)], "kmer string, item int")
    assert {r.kmer for r in kmers.covering_probes(hits).collect()} in ({"x", "y"}, {"x", "z"}, {"y", "x", "z"})


def test_covering_takes_many_probes_a_round(spark):
    """Every item is covered, in few rounds, by not many more probes than one after the other would take; a second group's probes are out."""
    rng = random.Random(12)
    sets = {f"k{j:03}": set(rng.sample(range(400), rng.choice([1, 3, 10, 60]))) for j in range(300)}
    hits = spark.createDataFrame([(k, i) for k, own in sets.items() for i in own] * 2, "kmer string, item long")
    out = spark.createDataFrame([(f"k{j:03}",) for j in range(40)], "kmer string")
    for excluded in (None, out):
        usable = {k: v for k, v in sets.items() if excluded is None or k >= "k040"}
        rows = kmers.covering_probes(hits, excluded).collect()
        whole = set().union(*usable.values())
        assert set().union(*(usable[r.kmer] for r in rows)) == whole and sum(r.covered for r in rows) <= len(whole)
        left, greedy = set(whole), 0
        while left:
            left, greedy = left - usable[max(sorted(usable), key=lambda k: len(usable[k] & left))], greedy + 1
        assert len(rows) <= 2 * greedy and max(r["round"] for r in rows) <= 12 < greedy
    assert kmers.covering_probes(hits, most=1).agg(F.max("round")).first()[0] == 1
    assert kmers.covering_probes(hits.limit(0)).count() == 0


def plain_partial(trees, share):
    """trees: name to (leaves, sets). Kept sets (leaves, support) after comparing every set with every tree."""
    found = []
    for name, (all_, sets) in trees.items():
        for own in sets:
            if not 1 < len(own) < len(all_):
                continue
            asked = agree = 0
            for other, more in trees.values():
                cut, common = own & other, all_ & other
                if 1 < len(cut) < len(common):
                    asked += 1
                    agree += any(x & all_ == cut for x in more)
            if agree > asked * share:
                found.append((own, all_, agree / asked, agree))
    return found


def test_consensus_of_partial_trees(spark):
    rng, forest, plain = random.Random(15), [], {}
    names = [f"l{k:02}" for k in range(14)]
    true = [set(names[:7]), set(names[7:]), set(names[:3]), set(names[9:])]
    for t in range(5):
        own = set(rng.sample(names, 11))
        sets = {frozenset(x & own) for x in true if rng.random() < 0.85 and len(x & own) > 1}
        if t == 4:
            sets = {frozenset(sorted(own)[::2])}  # crosses the others
        plain[f"t{t}"] = (own, sets)
        forest.append((f"t{t}", "root", None, None))
        ids = {x: f"n{k}" for k, x in enumerate(sorted(sets, key=lambda x: (len(x), sorted(x))))}
        above = lambda x, ids=ids: next((i for y, i in ids.items() if x < y or len(x) == 1 and x <= y), "root")
        forest += [(f"t{t}", i, above(x), None) for x, i in ids.items()] + [(f"t{t}", x, above(frozenset([x])), x) for x in own]
    nodes = spark.createDataFrame(forest, "tree string, node string, parent string, name string").withColumn("length", F.lit(1.0))
    got = {}
    for r in trees.partial_consensus(nodes).collect():
        got.setdefault((r.node, r.support, r.parent), set()).add(r.leaf)
    kept = plain_partial(plain, 0.5)
    # the leaves of every set that stays lie in one result, and results don't cross
    assert kept and got
    for own, _, support, _ in kept:
        assert any(own <= x for x in got.values())
    assert {round(s, 9) for _, s, _ in got} <= {round(s, 9) for _, _, s, _ in kept}
    for x in got.values():
        assert any(x <= y or x - y == x for y in true)
        for y in got.values():
            assert not x & y or x <= y or y <= x
    sizes = {n: len(x) for (n, _, _), x in got.items()}
    for (n, _, parent), x in got.items():
        holders = [m for (m, _, _), y in got.items() if x & y and len(y) > len(x)]
        assert (parent in holders and sizes[parent] == min(sizes[m] for m in holders)) if holders else parent is None


def test_probe_hits_against_brute_force(spark):
    """Both strands, unclear letters and mismatches at every place, in random sequences with planted probes."""
    rng = random.Random(4)
    probes = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(3)]
    turned = [p[::-1].translate(str.maketrans("ACGT", "TGCA")) for p in probes]
    items = {}
    for k in range(25):
        data = [rng.choice("ACGTACGTACGTN") for _ in range(60)]
        planted = list(rng.choice(probes + turned))
        for i in rng.sample(range(12), rng.randint(0, 5)):
            planted[i] = rng.choice("ACGTN")
        data[20:32] = planted
        items[k] = "".join(data)
    expected = set()
    for n, (p, q) in enumerate(zip(probes, turned)):
        for reverse, probe in ((False, p), (True, q)):
            for k, data in items.items():
                for at in range(len(data) - 11):
                    piece = data[at : at + 12]
                    plain = sum(x != y and y != "N" for x, y in zip(probe, piece))
                    unclear = sum(x != y and y == "N" for x, y in zip(probe, piece))
                    if plain + (max(unclear - 1, 0) if unclear < 4 else unclear) <= 2:
                        expected.add((n, reverse, k, at + 1, plain, unclear))
    df = spark.createDataFrame(list(items.items()), "item long, data string")
    found = kmers.probe_hits(spark.createDataFrame(list(enumerate(probes)), "id long, probe string"), "id", "probe", df, "item", "data", 2, reverse=True, ignored=1)
    assert {(r.probe_id, r.reverse, r.item, r.position, r.mismatches, r.n_mismatches) for r in found.collect()} == expected and len(expected) > 10


def test_kept_columns_of_groups(spark):
    df = spark.createDataFrame([("g", "abc"), ("h", "abc"), ("i", "abc")], "g string, data string")
    keep = spark.createDataFrame([("g", 1), ("g", 3), ("h", 2), ("h", 9)], "g string, pos int")
    assert {r.g: r.data for r in columns.kept_columns(df, "data", keep, "g").collect()} == {"g": "ac", "h": "b", "i": ""}


def test_ambiguous_codons(spark):
    table = [("GAR", "E"), ("RAY", "B"), ("SAR", "Z"), ("CTN", "L"), ("YTR", "L"), ("NNN", "X"), ("ATH", "I"), ("---", "-")]
    text = "".join(c for c, _ in table)
    assert one(spark, intervals.translated(F.lit(text), ambiguous=True)) == "".join(a for _, a in table)
    assert one(spark, intervals.translated(F.lit("GARATG"))) == "XM"
    assert one(spark, intervals.codes_that_fit(F.lit("TGAATA"), F.lit("WM"))) == [2, 3, 5, 13, 21]
    assert all(len(x) == 64 for x in intervals.GENETIC_CODES.values())


def test_flags_and_bootstrap(spark):
    with pytest.raises(PySparkException, match="0 or 1"):
        one(spark, search.partial_flag(F.lit("2"), 0))
    assert one(spark, search.partial_flag(F.lit(None).cast("string"), 1)) == 1
    low, high = (one(spark, trees.bootstrap_estimate(F.lit(g), F.lit(100), F.lit(20))) for g in (0, 12))
    assert low == 0.5 and high > 0.99
