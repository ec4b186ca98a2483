"""Binary trees with fewer changes: branch swaps of all trees and edges at once, scored by Fitch's sets from both sides.

An inner edge has two subtrees on either side. Exchanging one of the first side with one of the second gives two other
trees; what they cost less follows from the four sets alone, so all swaps are scored by one aggregation over edges and
columns. Of the swaps that help, those go that are best at every node they touch; they share no node, so all are done
at once. Trees of any number lie in one table (see trees); sets go up and down level by level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.operators.storage import sized
from stringloom.operators.trees import BASE_BITS, closure, leaves

_ANY = 15


def _meet(rows: DataFrame, *keys: str) -> DataFrame:
    """What is common to the sets of a key, else all of them; changes is 1 where nothing was common. A single set stays."""
    common = F.bit_and("bases")
    return rows.groupBy(*keys).agg(F.when(common == 0, F.bit_or("bases")).otherwise(common).alias("bases"), (common == 0).cast("long").alias("changes"))


def _depths(nodes: DataFrame) -> DataFrame:
    deep = closure(nodes).groupBy("tree", "node").agg(F.max("steps").alias("depth"))
    return sized(nodes.hint("merge").join(deep, ["tree", "node"]).select("tree", "node", "parent", "depth"), "swap-depths")


def _leaf_sets(nodes: DataFrame, letters: DataFrame) -> DataFrame:
    """tree, node, col and bases of leaves whose letter says anything; a letter that can be any base is left out."""
    bits = F.create_map(*[F.lit(x) for pair in BASE_BITS.items() for x in pair])
    # letters are many rows of each row of their table, which Spark takes for their size
    rows = letters.hint("merge").join(leaves(nodes).select("tree", "node", "name"), ["tree", "name"]).select("tree", "node", "col", F.try_element_at(bits, F.upper("ch")).alias("bases"))
    return rows.filter(F.col("bases") < _ANY)


def _upwards(depths: DataFrame, ends: DataFrame) -> DataFrame:
    """tree, node, parent, depth, col, bases and changes: of each node the set of the subtree below it."""
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    placed = sized(ends.join(depths, ["tree", "node"]).withColumn("changes", F.lit(0).cast("long")), "swap-ends")
    all_, level = [placed], placed.filter(F.col("depth") == deepest)
    for depth in range(deepest - 1, -1, -1):
        met = _meet(level.select("tree", F.col("parent").alias("node"), "col", "bases"), "tree", "node", "col")
        above = sized(met.join(depths.filter(F.col("depth") == depth), ["tree", "node"]), "swap-up")
        all_.append(above)
        level = above.unionByName(placed.filter(F.col("depth") == depth))
    return reduce(DataFrame.unionByName, all_)


def _total(up: DataFrame, weights: DataFrame | None) -> DataFrame:
    weighed = up.withColumn("weight", F.lit(1.0)) if weights is None else up.join(weights.select("col", "weight"), "col")
    return weighed.groupBy("tree").agg(F.sum(F.col("changes") * F.col("weight")).alias("changes"))


def changes(nodes: DataFrame, letters: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """tree and changes: the least number of changes that the letters take on binary trees, columns counted by weight.

    letters: tree, name (of a leaf), col and ch; ambiguity codes are sets, other letters and missing rows can be any base.
    weights: col and weight, else 1; columns without one don't count. A tree without letters has 0.
    """
    found = _total(_upwards(_depths(nodes), _leaf_sets(nodes, letters)), weights)
    return nodes.select("tree").distinct().join(found, "tree", "left").select("tree", F.coalesce("changes", F.lit(0.0)).alias("changes"))


def _downwards(up: DataFrame, depths: DataFrame) -> DataFrame:
    """tree, node, col and bases: of each node but the root the set of all that isn't below it."""
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    narrow = up.select("tree", "node", "parent", "depth", "col", "bases")
    all_, above = [], None
    for depth in range(1, deepest + 1):
        nodes = depths.filter(F.col("depth") == depth)
        pair = nodes.join(nodes.select("tree", "parent", F.col("node").alias("_other")), ["tree", "parent"]).filter("node != _other")
        sets = pair.select("tree", "node", F.col("_other").alias("_from")).join(narrow.select("tree", F.col("node").alias("_from"), "col", "bases"), ["tree", "_from"]).select("tree", "node", "col", "bases")
        if above is not None:
            sets = sets.unionByName(nodes.select("tree", "node", "parent").join(above.select("tree", F.col("node").alias("parent"), "col", "bases"), ["tree", "parent"]).select("tree", "node", "col", "bases"))
        above = sized(_meet(sets, "tree", "node", "col").drop("changes"), "swap-down")
        all_.append(above)
    return reduce(DataFrame.unionByName, all_)


def _edges(depths: DataFrame) -> DataFrame:
    """tree, edge, upper, a, b, c, d and beyond: the four subtrees at each inner edge, which has its lower node's name.

    d is a node of which beyond tells whether what isn't below it is meant. The edge through the root is that of the
    smaller of its ends; its c and d lie below the other one.
    """
    kids = depths.filter("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
    own = depths.join(kids, ["tree", "node"]).filter("parent is not null").withColumnsRenamed({"node": "edge", "low": "a", "high": "b"})
    at = own.join(kids.select("tree", F.col("node").alias("parent"), "low", "high"), ["tree", "parent"]).withColumn("sibling", F.when(F.col("low") == F.col("edge"), F.col("high")).otherwise(F.col("low")))
    inner = at.filter("depth > 1").select("tree", "edge", F.col("parent").alias("upper"), "a", "b", F.col("sibling").alias("c"), F.col("parent").alias("d"), F.lit(True).alias("beyond"))
    ends = kids.select("tree", F.col("node").alias("sibling"), F.col("low").alias("c"), F.col("high").alias("d"))
    through = at.filter("depth = 1 and edge < sibling").drop("low", "high").join(ends, ["tree", "sibling"])
    return inner.unionByName(through.select("tree", "edge", F.col("sibling").alias("upper"), "a", "b", "c", "d", F.lit(False).alias("beyond")))


def _cost(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Changes at the two inner nodes and the edge of a tree that has a and b on one side, c and d on the other."""
    both = lambda x, y: F.when(x.bitwiseAND(y) == 0, x.bitwiseOR(y)).otherwise(x.bitwiseAND(y))
    apart = lambda x, y: (x.bitwiseAND(y) == 0).cast("int")
    return apart(a, b) + apart(c, d) + apart(both(a, b), both(c, d))


def swaps(nodes: DataFrame, letters: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """tree, edge, upper, x, y and gain of every branch swap of binary trees: x and y change places, gain changes less are left.

    edge and upper are the nodes at the edge's ends. Each swap is scored as if it were the only one.
    """
    depths = _depths(nodes)
    return _scored(depths, sized(_upwards(depths, _leaf_sets(nodes, letters)), "swap-sets"), weights)


def _scored(depths: DataFrame, up: DataFrame, weights: DataFrame | None) -> DataFrame:
    edges = sized(_edges(depths), "swap-edges")
    if not edges.head(1):
        return edges.select("tree", "edge", "upper", F.col("a").alias("x"), F.col("c").alias("y"), F.lit(0.0).alias("gain"))
    below, beyond = up.select("tree", "node", "col", "bases"), _downwards(up, depths)
    roles = edges.select("tree", "edge", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("node"), (F.col("beyond") if r == "d" else F.lit(False)).alias("outside")) for r in "abcd"])))
    sets = roles.filter("not outside").join(below, ["tree", "node"]).unionByName(roles.filter("outside").join(beyond, ["tree", "node"]))
    four = sets.groupBy("tree", "edge", "col").agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("bases"))), F.lit(_ANY)).alias(r) for r in "abcd"])
    four = four.withColumn("weight", F.lit(1.0)) if weights is None else four.join(weights.select("col", "weight"), "col")
    a, b, c, d = map(F.col, "abcd")
    saved = lambda other: F.sum((_cost(a, b, c, d) - other) * F.col("weight"))
    gains = four.groupBy("tree", "edge").agg(saved(_cost(c, b, a, d)).alias("gain_a"), saved(_cost(a, c, b, d)).alias("gain_b"))
    each = F.inline(F.array(*[F.struct(F.col(x).alias("x"), F.col("c").alias("y"), F.coalesce(f"gain_{x}", F.lit(0.0)).alias("gain")) for x in "ab"]))
    return edges.join(gains, ["tree", "edge"], "left").select("tree", "edge", "upper", each)


def _free_of_conflict(found: DataFrame) -> DataFrame:
    """Of each edge the better swap, and of those the ones that no better one shares a node with."""
    best = found.groupBy("tree", "edge").agg(F.max(F.struct("gain", "x", "upper", "y")).alias("s")).select("tree", "edge", "s.*")
    touched = best.select("tree", "edge", "gain", F.explode(F.array("edge", "upper")).alias("node"))
    top = touched.groupBy("tree", "node").agg(F.max(F.struct("gain", "edge")).alias("top"))
    kept = touched.join(top, ["tree", "node"]).groupBy("tree", "edge").agg(F.min((F.col("top.edge") == F.col("edge")).cast("int")).alias("kept"))
    return best.join(kept.filter("kept = 1").select("tree", "edge"), ["tree", "edge"])


def _exchanged(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    of = lambda end: nodes.select("tree", F.col("node").alias(end), F.col("parent").alias(f"_{end}"))
    both = chosen.select("tree", "x", "y").join(of("x"), ["tree", "x"]).join(of("y"), ["tree", "y"])
    moves = both.select("tree", F.inline(F.array(F.struct(F.col("x").alias("node"), F.col("_y").alias("_under")), F.struct(F.col("y").alias("node"), F.col("_x").alias("_under")))))
    return nodes.join(moves, ["tree", "node"], "left").withColumn("parent", F.coalesce("_under", "parent")).select(*nodes.columns)


def improved(nodes: DataFrame, letters: DataFrame, weights: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """nodes after branch swaps, until none would save a change (or `rounds` are over); see changes for letters and weights.

    Every round makes the swaps that are best at all nodes they touch. Scores hold for one swap; where several together
    don't save a change, the tree gets its best one alone, which does. So the score of a tree falls in every round, and a
    tree that can't fall is done and not looked at again. Of equal gains the larger node's edge goes first. A node takes its
    branch length along. Trees have to be binary, their root too; others are an error, a single leaf stays as it is.
    """
    odd = nodes.filter("parent is not null").groupBy("tree", "parent").count().filter("count != 2").head()
    if odd:
        raise ValueError(f"node {odd['parent']} of tree {odd['tree']} has {odd['count']} children, not two")
    done, active, turn = [], sized(nodes, "swap-trees"), 0
    depths = _depths(active)
    up = sized(_upwards(depths, _leaf_sets(active, letters)), "swap-sets")
    while rounds is None or turn < rounds:
        helping = sized(_scored(depths, up, weights).filter("gain > 1e-9"), "swap-found")
        trees = helping.select("tree").distinct()
        done.append(active.join(trees, "tree", "left_anti"))
        if not helping.head(1):
            active = None
            break
        active = sized(active.join(trees, "tree", "left_semi"), "swap-trees")
        before = sized(_total(up, weights).join(trees, "tree", "left_semi"), "swap-scores")
        chosen = sized(_free_of_conflict(helping), "swap-chosen")
        trial = sized(_exchanged(active, chosen), "swap-trees")
        depths = _depths(trial)
        up = sized(_upwards(depths, _leaf_sets(trial, letters)), "swap-sets")
        failed = sized(before.join(_total(up, weights).select("tree", F.col("changes").alias("_now")), "tree").filter("_now >= changes - 1e-9").select("tree"), "swap-failed")
        if failed.head(1):
            single = helping.join(failed, "tree", "left_semi").groupBy("tree").agg(F.max(F.struct("gain", "edge", "x", "y")).alias("s")).select("tree", "s.*")
            kept = chosen.join(failed, "tree", "left_anti").select("tree", "x", "y").unionByName(single.select("tree", "x", "y"))
            trial = sized(_exchanged(active, kept), "swap-trees")
            depths = _depths(trial)
            up = sized(_upwards(depths, _leaf_sets(trial, letters)), "swap-sets")
        active, turn = trial, turn + 1
    return reduce(DataFrame.unionByName, done + ([] if active is None else [active]))
