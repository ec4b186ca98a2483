"""Likelihood of aligned columns on trees: rates of columns and bases of ancestors.

Each node has a vector for each column: how likely the leaves below it are, given each base there. Vectors go up the
tree level by level, all nodes, columns and candidate rates of a level in one join and one aggregation, and come
down again for the ancestors. Trees of any number lie in one table (see trees). The model has base
frequencies and a bias of changes within purines and within pyrimidines; its time unit is a change per column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.operators.storage import sized
from stringloom.operators.trees import closure, leaves

BASES = "ACGT"
#: Of each base the places of its kind (purines, pyrimidines).
_KIND = (0, 1, 0, 1)
#: Shorter branches count as this long, so that every change stays possible.
SHORTEST = 1e-9


@dataclass(frozen=True)
class Model:
    """Base frequencies in the order ACGT, and how much likelier a change within a kind is (0: no likelier)."""

    frequencies: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)
    bias: float = 0.0

    def speeds(self) -> tuple[float, float]:
        """Speed of any change, and that of changes within a kind on top of it: one change a unit of time in the mean."""
        kinds = [sum(p for p, k in zip(self.frequencies, _KIND) if k == kind) for kind in (0, 1)]
        any_ = 1 - sum(p * p for p in self.frequencies)
        within = sum(p * (1 - p / kinds[k]) for p, k in zip(self.frequencies, _KIND))
        b = 1 / (any_ + self.bias * within)
        return b, self.bias * b

    def moved(self, v: Column, time: Column) -> Column:
        """The vector v at the other end of a branch: of each base there the mean of v over what the branch may have made of it."""
        b, a = self.speeds()
        stay, kind = F.exp(-(a + b) * time), F.exp(-b * time)
        part = lambda places: reduce(lambda x, y: x + y, [F.get(v, F.lit(i)) * self.frequencies[i] for i in places])
        own = [[i for i in range(4) if _KIND[i] == k] for k in (0, 1)]
        within = [part(places) / sum(self.frequencies[i] for i in places) for places in own]
        return F.array(*[stay * F.get(v, F.lit(i)) + (kind - stay) * within[_KIND[i]] + (1 - kind) * part(range(4)) for i in range(4)])


def _depths(nodes: DataFrame) -> DataFrame:
    deep = closure(nodes).groupBy("tree", "node").agg(F.max("steps").alias("depth"))
    time = F.greatest(F.coalesce("length", F.lit(0.0)), F.lit(SHORTEST))
    return sized(nodes.hint("merge").join(deep, ["tree", "node"]).select("tree", "node", "parent", time.alias("time"), "depth"), "tree-depths")


def _leaf_vectors(nodes: DataFrame, letters: DataFrame, ambiguous: dict[str, str]) -> DataFrame:
    """tree, node, col, v and scale of leaves whose letter says anything; letters: tree, name, col, ch."""
    letter = F.translate(F.upper("ch"), "U", "T")
    known = {b: b for b in BASES} | ambiguous
    vectors = F.create_map(*[x for k, bases in known.items() for x in (F.lit(k), F.array(*[F.lit(float(b in bases)) for b in BASES]))])
    ends = leaves(nodes).select("tree", "node", "name")
    # letters are many rows of each row of their table, which Spark takes for their size
    rows = letters.hint("merge").join(ends, ["tree", "name"]).select("tree", "node", "col", F.try_element_at(vectors, letter).alias("v"))
    return rows.filter(F.col("v").isNotNull()).withColumn("scale", F.lit(0.0))


def _product(rows: DataFrame, *keys: str) -> DataFrame:
    """v and scale: the products of the vectors of each key, n times each where rows have an n, the largest entry 1 and its logarithm in scale."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    logs = [F.sum(F.log(F.greatest(F.get("v", F.lit(i)), F.lit(1e-300))) * n).alias(f"_{i}") for i in range(4)]
    summed = rows.groupBy(*keys).agg(*logs, F.sum(F.col("scale") * n).alias("_scale")).withColumn("_top", F.greatest(*[f"_{i}" for i in range(4)]))
    return summed.select(*keys, F.array(*[F.exp(F.col(f"_{i}") - F.col("_top")) for i in range(4)]).alias("v"), (F.col("_scale") + F.col("_top")).alias("scale"))


def _upwards(depths: DataFrame, ends: DataFrame, model: Model) -> DataFrame:
    """tree, node, col, rate, v and scale of all nodes that have a letter below them; ends: those of the leaves."""
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    placed = sized(ends.join(depths.select("tree", "node", "depth"), ["tree", "node"]), "up-0")
    all_, level = [placed.drop("depth")], placed.filter(F.col("depth") == deepest).drop("depth")
    for depth in range(deepest, 0, -1):
        branch = depths.filter(F.col("depth") == depth).select("tree", "node", "parent", "time")
        moved = level.join(branch, ["tree", "node"]).select("tree", F.col("parent").alias("node"), "col", "rate", model.moved(F.col("v"), F.col("time") * F.col("rate")).alias("v"), "scale")
        level = sized(_product(moved, "tree", "node", "col", "rate"), "up")
        all_.append(level)
        level = level.unionByName(placed.filter(F.col("depth") == depth - 1).drop("depth"))
    return reduce(DataFrame.unionByName, all_)


def _likelihoods(depths: DataFrame, alike: DataFrame, asked: DataFrame, model: Model) -> DataFrame:
    """tree, col, rate and log_likelihood for the rates in asked (tree, col, rate); alike: n leaves of one parent, depth, time, col and v each."""
    deepest, level = depths.agg(F.max("depth")).first()[0] or 0, None
    at = lambda depth: alike.filter(F.col("depth") == depth).join(asked, ["tree", "col"]).withColumn("scale", F.lit(0.0))
    for depth in range(deepest, 0, -1):
        rows = at(depth).select("tree", "parent", "time", "col", "rate", "v", "scale", "n")
        if level is not None:
            branch = depths.filter(F.col("depth") == depth).select("tree", "node", "parent", "time")
            rows = rows.unionByName(level.join(branch, ["tree", "node"]).select("tree", "parent", "time", "col", "rate", "v", "scale", F.lit(1).cast("long").alias("n")))
        moved = rows.select("tree", F.col("parent").alias("node"), "col", "rate", model.moved(F.col("v"), F.col("time") * F.col("rate")).alias("v"), "scale", "n")
        level = sized(_product(moved, "tree", "node", "col", "rate"), "up")
    roots = at(0).select("tree", "col", "rate", "v", "scale")
    if level is not None:
        roots = roots.unionByName(level.select(*roots.columns))
    mean = reduce(lambda x, y: x + y, [F.get("v", F.lit(i)) * p for i, p in enumerate(model.frequencies)])
    return roots.select("tree", "col", "rate", (F.log(mean) + F.col("scale")).alias("log_likelihood"))


def column_rates(nodes: DataFrame, letters: DataFrame, model: Model = Model(), least: float = 1 / 64, most: float = 16.0, steps: int = 16, rounds: int = 3, ambiguous: dict[str, str] | None = None) -> DataFrame:
    """tree, col, rate and log_likelihood: of each column the rate, times which all branches are taken, that makes it likeliest.

    letters: tree, name (of a leaf), col and ch; U is T, letters that `ambiguous` gives several bases may be any of
    them, all others say nothing. A column's search goes on in rounds, all columns at once: `steps` + 1 rates in equal
    ratios between the bounds, then as many between the neighbours of the best one, `rounds` times; of equal ones the
    smallest counts. Columns without a base are left out. Leaves of one parent with one branch length and letter are
    counted before they meet the rates, since they stay alike under each.
    """
    depths = _depths(nodes)
    ends = _leaf_vectors(nodes, letters, ambiguous or {}).join(depths, ["tree", "node"])
    alike = sized(ends.groupBy("tree", "parent", "depth", "time", "col", "v").agg(F.count(F.lit(1)).alias("n")), "leaf-vectors")
    columns = alike.select("tree", "col").distinct().withColumns({"low": F.lit(float(least)), "high": F.lit(float(most))})
    for _ in range(rounds):
        candidates = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.struct(k.alias("k"), (F.col("low") * F.pow(F.col("high") / F.col("low"), k / steps)).alias("rate")))
        asked = sized(columns.select("tree", "col", "low", "high", F.inline(candidates)), "rates")
        found = _likelihoods(depths, alike, asked.select("tree", "col", "rate"), model)
        best = asked.join(found, ["tree", "col", "rate"]).groupBy("tree", "col").agg(F.max(F.struct("log_likelihood", (-F.col("k")).alias("k"), "rate", "low", "high")).alias("b"))
        ratio = F.pow(F.col("b.high") / F.col("b.low"), F.lit(1 / steps))
        columns = sized(best.select("tree", "col", F.greatest(F.col("b.rate") / ratio, F.lit(float(least))).alias("low"), F.least(F.col("b.rate") * ratio, F.lit(float(most))).alias("high"), "b.rate", "b.log_likelihood"), "rates")
    return columns.select("tree", "col", "rate", "log_likelihood")


def _rated(ends: DataFrame, rates: DataFrame | None) -> DataFrame:
    """Leaf vectors with the rate of their column, 1 everywhere if none are given."""
    ends = ends.withColumn("rate", F.lit(1.0)) if rates is None else ends.join(rates.select("tree", "col", "rate"), ["tree", "col"])
    return sized(ends, "leaf-vectors")


def _inner(depths: DataFrame) -> DataFrame:
    return depths.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()


def _outside(depths: DataFrame, ends: DataFrame, model: Model, inner: DataFrame, with_leaves: bool) -> tuple[DataFrame, DataFrame]:
    """Vectors from below (up) and of what lies outside each node's subtree (out): of inner nodes, or also of leaves that have a letter."""
    up = sized(_upwards(depths, ends, model).join(depths, ["tree", "node"]), "up-vectors")
    branch = up.withColumn("moved", model.moved(F.col("v"), F.col("time") * F.col("rate"))).select("tree", "node", "parent", "col", "rate", "time", "depth", "moved")
    # all children of a node together, of which each one's own part is taken out again
    ones = F.array(*[F.lit(1.0)] * 4)
    columns = up.filter("depth = 0").select("tree", "col", "rate").distinct()
    down = depths.filter("depth = 0").select("tree", "node").join(columns, "tree").withColumn("out", ones)
    all_, deepest = [down], depths.agg(F.max("depth")).first()[0] or 0
    for depth in range(1, deepest + 1):
        own = branch.filter(F.col("depth") == depth)
        whole = up.filter(F.col("depth") == depth - 1).select("tree", F.col("node").alias("parent"), "col", F.col("v").alias("whole"))
        above = down.select("tree", F.col("node").alias("parent"), "col", F.col("out").alias("above"))
        # nodes without a letter below them have no vector; what is outside them is what their parent says
        silent = depths.filter(F.col("depth") == depth).select("tree", "node", "parent", "time").join(above.select("tree", "parent", "col"), ["tree", "parent"]).join(inner, ["tree", "node"], "left_semi")
        silent = silent.join(own.select("tree", "node", "col"), ["tree", "node", "col"], "left_anti").join(columns, ["tree", "col"]).withColumn("moved", ones)
        asked = own if with_leaves else own.join(inner, ["tree", "node"], "left_semi")
        rows = asked.select("tree", "node", "parent", "col", "rate", "time", "moved").unionByName(silent.select("tree", "node", "parent", "col", "rate", "time", "moved"))
        rows = rows.join(above, ["tree", "parent", "col"]).join(whole, ["tree", "parent", "col"], "left")
        rest = [F.get("above", F.lit(i)) * F.coalesce(F.get("whole", F.lit(i)), F.lit(1.0)) / F.greatest(F.get("moved", F.lit(i)), F.lit(1e-300)) for i in range(4)]
        top = F.greatest(*[F.get("_rest", F.lit(i)) for i in range(4)])
        scaled = rows.withColumn("_rest", F.array(*rest)).withColumn("_rest", F.transform("_rest", lambda x: x / top))
        down = sized(scaled.select("tree", "node", "col", "rate", model.moved(F.col("_rest"), F.col("time") * F.col("rate")).alias("out")), "down")
        all_.append(down)
    return up, reduce(DataFrame.unionByName, all_)


def ancestors(nodes: DataFrame, letters: DataFrame, rates: DataFrame | None = None, model: Model = Model(), ambiguous: dict[str, str] | None = None) -> DataFrame:
    """tree, node, col, base and share: of each inner node and column the likeliest base, and its share of the likelihood.

    What lies outside a node's subtree comes down level by level: from its parent, what lies outside that one, times what
    its other children say. rates: tree, col and rate, else 1 everywhere. Of equal bases the first of ACGT counts;
    columns without a base have no ancestors.
    """
    depths = _depths(nodes)
    ends, inner = _rated(_leaf_vectors(nodes, letters, ambiguous or {}), rates), _inner(depths)
    up, out = _outside(depths, ends, model, inner, False)
    both = out.join(inner, ["tree", "node"], "left_semi").join(up.select("tree", "node", "col", "v"), ["tree", "node", "col"], "left")
    shares = [F.get("out", F.lit(i)) * F.coalesce(F.get("v", F.lit(i)), F.lit(1.0)) * p for i, p in enumerate(model.frequencies)]
    rows = both.select("tree", "node", "col", F.array(*shares).alias("_p")).withColumn("_sum", F.aggregate("_p", F.lit(0.0), lambda s, x: s + x))
    best = F.array_position("_p", F.array_max("_p")).cast("int")
    return rows.select("tree", "node", "col", F.substring(F.lit(BASES), best, F.lit(1)).alias("base"), (F.array_max("_p") / F.col("_sum")).alias("share"))


def leaf_surprises(nodes: DataFrame, letters: DataFrame, rates: DataFrame | None = None, model: Model = Model(), ambiguous: dict[str, str] | None = None) -> DataFrame:
    """tree, name, col and surprise: how unlike what the rest of the tree expects of it a leaf's base is.

    With the shares of the four bases that all other leaves give a leaf, it is ln(the largest share / (the share of its
    own base + 0.0001)); so a leaf says nothing about itself. Letters that aren't one base are left out, their vectors
    still count for the others. In a tree of one leaf the shares are the model's.
    """
    depths = _depths(nodes)
    letter = F.translate(F.upper("ch"), "U", "T")
    ends, inner = _rated(_leaf_vectors(nodes, letters, ambiguous or {}), rates), _inner(depths)
    _, out = _outside(depths, ends, model, inner, True)
    named = leaves(nodes).select("tree", "node", "name")
    bases = letters.select("tree", "name", "col", letter.alias("base")).filter(F.col("base").isin(*BASES)).hint("merge").join(named, ["tree", "name"])
    shares = [F.get("out", F.lit(i)) * p for i, p in enumerate(model.frequencies)]
    own = reduce(lambda found, i: F.when(F.col("base") == BASES[i], shares[i]).otherwise(found), range(4), F.lit(None))
    surprise = F.log(F.greatest(*shares) / (own + 0.0001 * reduce(lambda x, y: x + y, shares)))
    return bases.join(out.select("tree", "node", "col", "out"), ["tree", "node", "col"]).select("tree", "name", "col", surprise.alias("surprise"))


def chimera_quality(surprises: DataFrame, length: int, width: int) -> DataFrame:
    """tree, name, mean_t, sum_t, halves, fifths and windows: where the surprises of a leaf differ from those of its whole text.

    Columns are numbered from 1 to length, which is cut into equal parts: two, five, and length // width + 1. A part's t is
    the difference of its mean surprise and that of the leaf over the standard error (the leaf's deviation over the root of
    the part's number of bases). Each part gets a character: 0 to 4 for a mean below, 6 to 9 above, `-` for a part like
    the whole (0.7 t, moved by a half and cut to a whole number, is 0), `.` for a part of fewer than two bases. mean_t and
    sum_t are over the sizes of all t, null and 0 without any; a leaf without deviation has only t of 0.
    """
    kinds = {"halves": 2, "fifths": 5, "windows": length // width + 1}
    at = F.struct(*[F.floor((F.col("col") - 1) * n / length).cast("int").alias(k) for k, n in kinds.items()])
    # sums by leaf and the least common parts first, so that a leaf's columns are met once
    value = F.col("surprise")
    fine = surprises.groupBy("tree", "name", at.alias("at")).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"at.{k}").alias("part")) for k in kinds]))
    parts = fine.select("tree", "name", each.alias("k"), "n", "s", "q").groupBy("tree", "name", "k.kind", "k.part").agg(*[F.sum(x).alias(x) for x in "nsq"])
    whole = fine.groupBy("tree", "name").agg(F.sum("n").alias("all"), (F.sum("s") / F.sum("n")).alias("mean"), (F.sum("q") / F.sum("n")).alias("squares"))
    deviation = F.sqrt(F.greatest(F.col("squares") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    t = F.when(F.col("deviation") < 1e-9, 0.0).otherwise((F.col("s") / F.col("n") - F.col("mean")) / (F.col("deviation") / F.sqrt("n")))
    rows = parts.join(whole.withColumn("deviation", deviation), ["tree", "name"]).withColumn("t", F.when(F.col("n") > 1, t))
    step = F.least(F.greatest((F.col("t") * 0.7 + 0.5).cast("int") + 5, F.lit(0)), F.lit(9))
    marked = rows.select("tree", "name", "kind", "part", "t", F.when(F.col("t").isNotNull(), F.when(step == 5, "-").otherwise(step.cast("string"))).alias("mark"))
    entry = lambda k: F.collect_list(F.when((F.col("kind") == k) & F.col("mark").isNotNull(), F.struct("part", "mark")))
    lines = marked.groupBy("tree", "name").agg(F.avg(F.abs("t")).alias("mean_t"), F.coalesce(F.sum(F.abs("t")), F.lit(0.0)).alias("sum_t"), *[F.map_from_entries(entry(k)).alias(k) for k in kinds])
    line = lambda k, n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(F.col(k), i), F.lit("."))), "")
    return lines.select("tree", "name", "mean_t", "sum_t", *[line(k, n).alias(k) for k, n in kinds.items()])
