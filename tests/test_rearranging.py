"""Branch swaps against plain versions: Fitch's count of every swapped tree, and planted trees."""

import random

import pytest

from stringloom.operators import rearranging as ra
from stringloom.operators.trees import BASE_BITS

SCHEMA = "tree string, node long, parent long, name string, length double"


def heap(names, tree="t"):
    """A binary tree of the names: node k has the children 2k and 2k + 1."""
    m = len(names)
    return {k: (k // 2 or None, names[k - m] if k >= m else None) for k in range(1, 2 * m)}


def fitch(tree, letters, weights):
    kids = {}
    for k, (p, _) in tree.items():
        kids.setdefault(p, []).append(k)
    root = kids[None][0]

    def below(k, col):
        if k not in kids:
            return BASE_BITS.get(letters.get((tree[k][1], col), "-").upper(), 15), 0
        (a, x), (b, y) = (below(c, col) for c in kids[k])
        return (a & b or a | b), x + y + (not a & b)

    return sum(w * below(root, c)[1] for c, w in weights.items())


def frame(spark, trees):
    return spark.createDataFrame([(t, k, p, n, 1.0) for t, tree in trees.items() for k, (p, n) in tree.items()], SCHEMA)


def letter_frame(spark, letters):
    return spark.createDataFrame([(t, n, c, ch) for t, own in letters.items() for (n, c), ch in own.items()], "tree string, name string, col int, ch string")


def random_case(rng, m, columns, alphabet="ACGTRN-u"):
    names = [f"l{k}" for k in range(m)]
    return heap(names), {(n, c): rng.choice(alphabet) for n in names for c in range(columns) if rng.random() < 0.95}


def test_every_swap(spark):
    rng = random.Random(5)
    cases = {f"t{m}": random_case(rng, m, 5) for m in (1, 2, 3, 4, 7, 12)}
    weights = {c: c / 2 for c in range(1, 5)}  # column 0 doesn't count
    trees, letters = ({t: case[i] for t, case in cases.items()} for i in (0, 1))
    nodes, rows, w = frame(spark, trees), letter_frame(spark, letters), spark.createDataFrame(list(weights.items()), "col int, weight double")
    plain = {t: fitch(trees[t], letters[t], weights) for t in trees}
    assert {r.tree: r.changes for r in ra.changes(nodes, rows, w).collect()} == plain
    found, count = set(), 0
    for r in ra.swaps(nodes, rows, w).collect():
        other = dict(trees[r.tree])
        (px, nx), (py, ny) = other[r.x], other[r.y]
        other[r.x], other[r.y] = (py, nx), (px, ny)
        assert r.gain == plain[r.tree] - fitch(other, letters[r.tree], weights)
        assert px == r.edge and py in (r.upper, 1)
        found.add((r.tree, r.edge))
        count += 1
    # a binary tree of m leaves has m - 3 inner edges, and each two swaps
    assert count == 2 * len(found) == 2 * sum(max(int(t[1:]) - 3, 0) for t in trees)


def splits(tree):
    kids, out = {}, set()
    for k, (p, _) in tree.items():
        kids.setdefault(p, []).append(k)
    all_ = frozenset(n for _, n in tree.values() if n)

    def below(k):
        own = frozenset([tree[k][1]]) if k not in kids else frozenset().union(*map(below, kids[k]))
        if 1 < len(own) < len(all_) - 1:
            out.add(min(own, all_ - own, key=sorted))
        return own

    below(kids[None][0])
    return out


def test_planted_trees_are_found_and_scores_never_rise(spark):
    rng, trees, letters, planted = random.Random(11), {}, {}, {}
    for t, m in (("a", 8), ("b", 13), ("c", 5)):
        names = [f"l{k}" for k in range(m)]
        good = heap(names)
        planted[t] = splits(good)
        # two columns for each split
        columns = [s for s in sorted(planted[t], key=sorted) for _ in range(2)]
        letters[t] = {(n, c): "A" if n in s else "G" for c, s in enumerate(columns) for n in names}
        for _ in range(4):  # some branch swaps away
            inner = [k for k, (p, n) in good.items() if n is None and p not in (None, 1)]
            if inner:
                v = rng.choice(inner)
                x = rng.choice([k for k, (p, _) in good.items() if p == v])
                y = next(k for k, (p, _) in good.items() if p == good[v][0] and k != v)
                good[x], good[y] = (good[y][0], good[x][1]), (good[x][0], good[y][1])
        trees[t] = good
    trees["noise"], letters["noise"] = random_case(rng, 16, 9, "ACGT")
    trees["one"], letters["one"] = heap(["only"]), {("only", 0): "A"}
    nodes, rows = frame(spark, trees), letter_frame(spark, letters)
    scores = [{t: fitch(tree, letters[t], dict.fromkeys(range(40), 1)) for t, tree in trees.items()}]
    for rounds in (1, None):
        got = {t: {} for t in trees}
        for r in ra.improved(nodes, rows, rounds=rounds).collect():
            assert r.node not in got[r.tree]
            got[r.tree][r.node] = (r.parent, r.name)
        assert all(sorted(n for _, n in got[t].values() if n) == sorted(n for _, n in trees[t].values() if n) and len(got[t]) == len(trees[t]) for t in trees)
        scores.append({t: fitch(tree, letters[t], dict.fromkeys(range(40), 1)) for t, tree in got.items()})
    for earlier, later in zip(scores, scores[1:]):
        assert all(later[t] <= earlier[t] for t in trees)
    assert scores[1]["noise"] < scores[0]["noise"]
    assert {t: splits(got[t]) for t in planted} == planted
    assert not [r for r in ra.swaps(frame(spark, got), rows).collect() if r.gain > 0]


def test_trees_that_are_not_binary(spark):
    nodes = spark.createDataFrame([("t", 0, None, None, 1.0), ("t", 1, 0, "a", 1.0), ("t", 2, 0, "b", 1.0), ("t", 3, 0, "c", 1.0)], SCHEMA)
    with pytest.raises(ValueError, match="3 children"):
        ra.improved(nodes, spark.createDataFrame([], "tree string, name string, col int, ch string"))
    assert ra.improved(nodes.limit(0), spark.createDataFrame([], "tree string, name string, col int, ch string")).collect() == []
