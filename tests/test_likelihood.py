"""Likelihoods, rates and ancestors against sums over all bases of all inner nodes."""

import itertools
import math
import random

import numpy as np
import pytest

from stringloom.operators import likelihood as ml


def exact_matrix(model, time):
    """The exponential of the rate matrix, by its eigenvectors."""
    b, a = model.speeds()
    p, q = np.array(model.frequencies), np.zeros((4, 4))
    for i, j in itertools.permutations(range(4), 2):
        kind = p[0] + p[2] if i % 2 == 0 else p[1] + p[3]
        q[i, j] = b * p[j] + (a * p[j] / kind if i % 2 == j % 2 else 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    assert abs(-(p * np.diag(q)).sum() - 1) < 1e-12
    values, vectors = np.linalg.eig(q)
    return (vectors @ np.diag(np.exp(values * time)) @ np.linalg.inv(vectors)).real


def all_bases(tree, letters, model, rate, codes):
    """(likelihood, {inner node: shares of its bases}) of one column, summed over every choice of inner bases."""
    inner = [n for n in tree if any(parent == n for parent, _ in tree.values())]
    p, total, by = np.array(model.frequencies), 0.0, {n: np.zeros(4) for n in inner}
    matrices = {n: exact_matrix(model, max(t, ml.SHORTEST) * rate) for n, (parent, t) in tree.items() if parent is not None}
    for choice in itertools.product(range(4), repeat=len(inner)):
        state = dict(zip(inner, choice))
        value = 1.0
        for n, (parent, _) in tree.items():
            if parent is None:
                value *= p[state[n]]
            elif n in state:
                value *= matrices[n][state[parent], state[n]]
            elif letters.get(n) in codes:
                value *= sum(matrices[n][state[parent], "ACGT".index(c)] for c in codes[letters[n]])
        total += value
        for n in inner:
            by[n][state[n]] += value
    return total, {n: v / total for n, v in by.items()}


TREE = {"root": (None, 0.0), "x": ("root", 0.1), "y": ("x", 0.05), "a": ("y", 0.2), "b": ("y", 0.0), "c": ("x", 0.3), "d": ("root", 0.4), "z": ("root", 0.1), "e": ("z", 0.2), "f": ("z", 0.6)}
CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG"}


@pytest.mark.parametrize("model", [ml.Model(), ml.Model((0.1, 0.2, 0.3, 0.4), 2.5)])
def test_rates_and_ancestors(spark, model):
    rng = random.Random(2)
    columns = {k: {n: rng.choice("ACGTR-") for n in "abcdef"} for k in range(5)} | {5: dict.fromkeys("abcdef", "G"), 6: dict.fromkeys("abcdef", "-"), 7: dict.fromkeys("abc", "-") | dict(zip("def", "AuC"))}
    nodes = spark.createDataFrame([("t", n, p, n if len(n) == 1 and n in "abcdef" else None, t) for n, (p, t) in TREE.items()], "tree string, node string, parent string, name string, length double")
    letters = spark.createDataFrame([("t", n, k, c) for k, own in columns.items() for n, c in own.items()], "tree string, name string, col int, ch string")
    upper = {k: {n: c.upper().replace("U", "T") for n, c in own.items()} for k, own in columns.items()}
    rates = ml.column_rates(nodes, letters, model, steps=8, rounds=2, ambiguous={"R": "AG"}).cache()
    got = {r.col: (r.rate, r.log_likelihood) for r in rates.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 7]
    for k, (rate, value) in got.items():
        low, high = 1 / 64, 16.0
        for _ in range(2):
            tried = [low * (high / low) ** (i / 8) for i in range(9)]
            values = [math.log(all_bases(TREE, upper[k], model, r, CODES)[0]) for r in tried]
            at = max(range(9), key=lambda i: (round(values[i], 10), -i))
            ratio = (high / low) ** (1 / 8)
            low, high, best = max(tried[at] / ratio, 1 / 64), min(tried[at] * ratio, 16.0), (tried[at], values[at])
        assert rate == pytest.approx(best[0], rel=1e-9) and value == pytest.approx(best[1], abs=1e-9)
    found = {(r.node, r.col): (r.base, r.share) for r in ml.ancestors(nodes, letters, rates, model, {"R": "AG"}).collect()}
    assert set(found) == {(n, k) for n in ("root", "x", "y", "z") for k in got}
    for k in got:
        shares = all_bases(TREE, upper[k], model, got[k][0], CODES)[1]
        for n, own in shares.items():
            base, share = found[n, k]
            assert share == pytest.approx(own.max(), abs=1e-7) and own["ACGT".index(base)] == pytest.approx(own.max(), abs=1e-7)


def test_many_leaves_do_not_underflow(spark):
    nodes = spark.createDataFrame([("t", "r", None, None, 0.0)] + [("t", f"n{k}", "r", f"n{k}", 0.5) for k in range(3000)], "tree string, node string, parent string, name string, length double")
    letters = spark.createDataFrame([("t", f"n{k}", 1, "ACGT"[k % 4]) for k in range(3000)], "tree string, name string, col int, ch string")
    row = ml.column_rates(nodes, letters, steps=4, rounds=1).first()
    assert math.isfinite(row.log_likelihood) and row.log_likelihood < -3000 and row.rate == 16.0


def test_leaf_surprises(spark):
    """Without its own letter, the tree gives a leaf the shares that trying all four bases for it gives."""
    rng, model = random.Random(7), ml.Model((0.1, 0.2, 0.3, 0.4), 2.5)
    columns = {k: {n: rng.choice("ACGT-") for n in "abcdef"} for k in range(1, 7)}
    columns[3]["a"], columns[4] = "R", dict.fromkeys("bcdef", "-") | {"a": "G"}
    nodes = spark.createDataFrame([("t", n, p, n if n in "abcdef" else None, t) for n, (p, t) in TREE.items()], "tree string, node string, parent string, name string, length double")
    letters = spark.createDataFrame([("t", n, k, c.lower()) for k, own in columns.items() for n, c in own.items()], "tree string, name string, col int, ch string")
    rates = spark.createDataFrame([("t", k, 0.5 + k / 4) for k in columns], "tree string, col int, rate double")
    got = {(r.name, r.col): r.surprise for r in ml.leaf_surprises(nodes, letters, rates, model, {"R": "AG"}).collect()}
    assert set(got) == {(n, k) for k, own in columns.items() for n, c in own.items() if c in "ACGT"}
    for (n, k), surprise in got.items():
        values = [all_bases(TREE, columns[k] | {n: b}, model, 0.5 + k / 4, CODES)[0] for b in "ACGT"]
        shares = np.array(values) / sum(values)
        assert surprise == pytest.approx(math.log(shares.max() / (shares["ACGT".index(columns[k][n])] + 0.0001)), abs=1e-6)


def plain_quality(own, length, width):
    """own: {column: surprise} of one leaf."""
    all_, ts, lines = list(own.values()), [], []
    mean = sum(all_) / len(all_)
    deviation = math.sqrt(max(sum(x * x for x in all_) / len(all_) - mean * mean, 0))
    for n in (2, 5, length // width + 1):
        line = ""
        for part in range(n):
            here = [x for c, x in own.items() if (c - 1) * n // length == part]
            if len(here) < 2:
                line += "."
                continue
            t = 0 if deviation < 1e-9 else (sum(here) / len(here) - mean) / (deviation / math.sqrt(len(here)))
            ts.append(abs(t))
            step = min(max(int(0.7 * t + 0.5) + 5, 0), 9)
            line += "-" if step == 5 else str(step)
        lines.append(line)
    return (sum(ts) / len(ts) if ts else None, sum(ts), *lines)


def test_chimera_quality(spark):
    rng, length = random.Random(3), 53
    own = {f"n{k}": {c: rng.random() * (5 if c > 30 and k % 2 else 1) for c in range(1, length + 1) if rng.random() < 0.8} for k in range(8)}
    own |= {"one": {5: 0.4}, "two": {5: 0.4, 50: 0.4}, "same": {c: 0.25 for c in range(1, length + 1)}, "planted": {c: 3.0 * (c > 26) + c % 2 / 9 for c in range(1, length + 1)}}
    df = spark.createDataFrame([("t", n, c, x) for n, row in own.items() for c, x in row.items()], "tree string, name string, col int, surprise double")
    got = {r.name: (r.mean_t, r.sum_t, r.halves, r.fifths, r.windows) for r in ml.chimera_quality(df, length, 7).collect()}
    assert set(got) == set(own)
    for n, row in own.items():
        want = plain_quality(row, length, 7)
        assert got[n][2:] == want[2:] and got[n][1] == pytest.approx(want[1]) and got[n][0] == (want[0] if want[0] is None else pytest.approx(want[0]))
    assert got["planted"][2] == "38" and got["one"][2:] == ("..", ".....", "........") and set("".join(got["same"][2:])) == {"-"}
    assert ml.chimera_quality(df.limit(0), length, 7).collect() == []
