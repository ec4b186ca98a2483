"""Node dumps of hierarchical databases, Newick trees and distance matrices, as tables.

A node dump has one node a line: key, an optional protection field, and a value; containers open with `(%` and
close with `%)`. It is read in byte ranges that prefix scans put together. A node table has id, parent, ord, key, path, type, value and marked, and any number of files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.operators.storage import before, stored

#: Type letters of the format (fixed values).
KINDS = {"i": "int", "f": "float", "y": "byte", "s": "string", "I": "bits", "Y": "bytes", "N": "ints", "F": "floats", "l": "link"}
#: Key, protection and the rest of a line.
_LINE = r"^([A-Za-z0-9_@]+)[ \t]+(?::\S+[ \t]+)?(.*)$"
_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|inf)$"


def unescaped(text: Column) -> Column:
    """A quoted text without its escapes: \\n and \\t are a line break and a tab, any other escaped character is itself."""
    kept = F.replace(text, F.lit("\\\\"), F.lit("\u0001"))
    kept = F.replace(F.replace(kept, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return F.replace(F.regexp_replace(kept, r"\\(.)", "$1"), F.lit("\u0001"), F.lit("\\"))


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line that isn't blank or a comment: file, block, line, kind, key, value and marked.

    Spark's reader cuts files into byte ranges at line ends; block is a range's start and line grows in it. kind is
    container, close, a node's type, or corrupt for a line that is none of these, whose value is the line.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
        F.regexp_replace(F.regexp_replace("value", "\\s+$", ""), r"^\s*(?:/\*.*?\*/\s*)*", "").alias("_text"),
    )
    rows = rows.filter("_text != ''").withColumn("key", F.regexp_extract("_text", _LINE, 1)).withColumn("_rest", F.regexp_extract("_text", _LINE, 2))
    letter, typed = F.substring("_rest", 2, 1), F.regexp_replace("_rest", "^%.[ \\t]+", "")
    string = F.when(F.col("_rest").rlike("^%s[ \\t]"), typed).otherwise(F.col("_rest"))
    inner = lambda c: F.substring(c, F.lit(2), F.greatest(F.char_length(c) - 2, F.lit(0)))
    quoted = lambda c: (F.char_length(c) > 1) & c.startswith('"') & c.endswith('"') & ~F.contains(F.regexp_replace(inner(c), r"\\.", ""), F.lit('"')) & ~F.regexp_replace(inner(c), r"\\.", "").endswith("\\")
    is_typed = F.col("_rest").rlike("^%[ilyfIYNF][ \\t]")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), letter)
    sound = F.when(letter.isin("i", "y", "f"), typed.rlike(_NUMBER)).when(letter == "I", quoted(typed)).otherwise(typed != "")
    found = (
        F.when(F.col("_text").rlike(r"^%\)\s*(?:/\*.*\*/)?$"), F.struct(F.lit("close").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("marked")))
        .when((F.col("key") != "") & F.col("_rest").rlike(r"^%[%$]\s*\(%$"), F.struct(F.lit("container").alias("kind"), F.lit(None).cast("string").alias("value"), (letter == "$").alias("marked")))
        .when((F.col("key") != "") & is_typed & sound, F.struct(kind.alias("kind"), F.when(letter == "I", inner(typed)).otherwise(typed).alias("value"), F.lit(False).alias("marked")))
        .when((F.col("key") != "") & ~is_typed & quoted(string), F.struct(F.lit("string").alias("kind"), unescaped(inner(string)).alias("value"), F.lit(False).alias("marked")))
        .otherwise(F.struct(F.lit("corrupt").alias("kind"), F.col("_text").alias("value"), F.lit(False).alias("marked")))
    )
    return rows.withColumn("_found", found).select("file", "block", "line", "_found.kind", F.when(~F.col("_found.kind").isin("close", "corrupt"), F.col("key")).alias("key"), "_found.value", "_found.marked")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node dumps as a node table: file, id, parent, ord, key, path, type, value, marked.

    Files are read in byte ranges: a line's depth is what the lines before it opened and closed, which a prefix scan
    over the ranges tells, and its parent the last container before it that is one level higher. ids go up with the
    place in the file, ord counts a parent's nodes. A line that is no node is a node of type corrupt, with the line as
    its value and no key; so is the end of a container where none is open. A container that is never closed keeps what follows it. Texts are one line
    each, line breaks in them are escaped. Files without lines give no rows.
    """
    texts = stored(dump_lines(spark, path), "dump-lines")
    # the scans see narrow rows; keys and values come back in the end
    kind = F.col("kind")
    lines = before(texts.select("file", "block", "line", "kind"), "_sum", F.when(kind == "container", 1).when(kind == "close", -1).otherwise(0), F.sum, "file")
    after = F.col("_sum") - F.when(kind == "close", 1).otherwise(0)
    lines = before(lines, "_least", after, F.min, "file")
    # ends beyond the outermost level don't count
    least = F.least(F.coalesce("_least", F.lit(0)), F.lit(0))
    stray = (kind == "close") & (after < least)
    lines = lines.withColumns({"level": F.col("_sum") - least, "kind": F.when(stray, "corrupt").otherwise(kind)})
    nodes = stored(before(lines.filter("kind != 'close'").drop("_sum", "_least"), "id", F.lit(1), F.sum, "file"), "nodes")
    opened = nodes.filter("kind = 'container'").select("file", "block", "line", (F.col("level") + 1).alias("level"), F.col("id").alias("_opened"))
    scopes = nodes.withColumn("_opened", F.lit(None).cast("long")).unionByName(opened, allowMissingColumns=True)
    # a container's own line is a node of its level first and opens the next level, so the two never meet
    placed = before(scopes, "parent", F.col("_opened"), F.max, "file", "level").filter("_opened is null").drop("_opened")
    placed = before(placed.withColumn("_parent", F.coalesce("parent", F.lit(-1))), "ord", F.lit(1), F.sum, "file", "_parent")
    value = F.when((F.col("kind") == "corrupt") & F.col("value").isNull(), "%)").otherwise(F.col("value"))
    placed = stored(placed.join(texts.select("file", "block", "line", "key", "value", "marked"), ["file", "block", "line"]).withColumn("value", value), "placed-nodes")
    levels = placed.filter("kind = 'container'").agg(F.max("level")).first()[0]
    containers = placed.filter("kind = 'container'").select("file", "id", "_parent", "level", "key")
    paths = last = containers.filter("level = 0").select("file", "id", F.concat(F.lit("/"), "key").alias("_path"))
    for level in range(1, (levels or 0) + 1):
        above = last.withColumnRenamed("id", "_parent")
        last = containers.filter(F.col("level") == level).join(above, ["file", "_parent"]).select("file", "id", F.concat("_path", F.lit("/"), "key").alias("_path"))
        paths = paths.unionByName(last)
    rows = placed.join(paths.withColumnRenamed("id", "_parent"), ["file", "_parent"], "left")
    path_of = F.concat(F.coalesce("_path", F.lit("")), F.lit("/"), F.coalesce("key", F.lit("")))
    # written, since what is asked of nodes reads them several times
    return stored(rows.select("file", "id", "parent", F.col("ord").cast("int").alias("ord"), "key", path_of.alias("path"), F.col("kind").alias("type"), "value", "marked"), "node-table")


def items_of(nodes: DataFrame, container: str, fields: list[str]) -> DataFrame:
    """One row for each node at the path, with the values of its fields (of a repeated one the first), and marked."""
    items = nodes.filter(F.col("path") == container).select("file", "id", "marked")
    values = nodes.filter((F.col("type") != "container") & F.col("key").isin(fields)).select("file", F.col("parent").alias("id"), "key", "ord", "value")
    picked = [F.min(F.when(F.col("key") == f, F.struct("ord", "value"))).alias(f) for f in fields]
    return items.join(values, ["file", "id"], "left").groupBy("file", "id", "marked").agg(*picked).select("file", "id", "marked", *[F.col(f"{f}.value").alias(f) for f in fields])


def at_path(nodes: DataFrame, pattern: str) -> DataFrame:
    """The nodes whose path matches; * stands for one key, ** for any number of them."""
    regex = "^" + "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", pattern)) + "$"
    return nodes.filter(F.col("path").rlike(regex))


def children(nodes: DataFrame, of: DataFrame, key: str | None = None) -> DataFrame:
    """The children of some nodes in order of their places, all or those with the key."""
    found = nodes.join(of.select("file", F.col("id").alias("parent")), ["file", "parent"], "left_semi")
    return found if key is None else found.filter(F.col("key") == key)


def dump_line(key: Column, kind: Column, value: Column) -> Column:
    """A terminal node as a line of a dump."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r'([\\"])', r"\\$1"), "\n", r"\\n"), "\t", r"\\t")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    letters = F.create_map(*[F.lit(x) for letter, name in KINDS.items() for x in (name, letter)])
    typed = F.concat(F.lit("%"), F.try_element_at(letters, kind), F.lit(" "), F.when(kind == "bits", quoted(value)).otherwise(value))
    return F.concat(key, F.lit("\t\t"), F.when(kind == "string", quoted(escaped)).otherwise(typed))


def dumped(nodes: DataFrame) -> DataFrame:
    """file, id and value: a node table as the lines of dumps, for a text writer that keeps the order of ids.

    Behind a node stand the ends of the containers that the next node, of the next id, is no longer in. Corrupt
    nodes are left out, and ids may have gaps for them. A container without nodes ends behind its own line.
    """
    level = F.size(F.split("path", "/")) - 2
    sound = nodes.filter("type != 'corrupt'").select("file", "id", "key", "type", "value", "marked", level.alias("level"))
    sound = stored(before(sound.withColumn("block", (F.col("id") / 100_000).cast("long")).withColumn("line", F.col("id")), "_number", F.lit(1), F.sum, "file"), "dumped")
    following = sound.select("file", (F.col("_number") - 1).alias("_number"), F.col("level").alias("_next"))
    rows = sound.join(following, ["file", "_number"], "left")
    inner = F.col("level") + F.when(F.col("type") == "container", 1).otherwise(0)
    tabs = lambda n: F.repeat(F.lit("\t"), n)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(inner - F.coalesce("_next", F.lit(0)), F.lit(1))), lambda k: F.concat(F.lit("\n"), tabs((inner - k + 1).cast("int")), F.lit("%)")))
    head = F.concat(F.col("key"), F.lit("\t\t%"), F.when(F.col("marked"), "$").otherwise("%"), F.lit(" (%"))
    line = F.concat(tabs(F.col("level")), F.when(F.col("type") == "container", head).otherwise(dump_line(F.col("key"), F.col("type"), F.col("value"))))
    return rows.select("file", "id", F.concat(line, F.when(inner > F.coalesce("_next", F.lit(0)), F.array_join(ends, "")).otherwise("")).alias("value"))


_TOKEN = re.compile(r"\[([^\]\[]*(?:\[[^\]]*\][^\]\[]*)*)\]|'((?:[^']|'')*)'|\"([^\"]*)\"|([(),:;])|([^\s(),:;\[\]'\"]+)")


def newick_nodes(text: str) -> list[dict]:
    """Nodes of one Newick tree, numbered in the order in which they open: node, parent, name, length, support."""
    nodes, open_, last, at_length, comment_next = [], [], None, False, False

    def new(parent):
        nodes.append({"node": len(nodes), "parent": parent, "name": None, "length": None, "support": None})
        return len(nodes) - 1

    for m in _TOKEN.finditer(text):
        if m[1] is not None:
            continue
        mark, word = m[4], next((g for g in (m[2], m[3], m[5]) if g is not None), None)
        if mark == "(":
            open_.append(new(open_[-1] if open_ else None))
            last, at_length = None, False
        elif mark in (",", ")"):
            if mark == ")" and open_:
                last, at_length = open_.pop(), False
            else:
                last, at_length = None, False
        elif mark == ":":
            if last is None:
                last = new(open_[-1] if open_ else None)
            at_length = True
        elif mark == ";":
            break
        elif at_length:
            nodes[last]["length"] = float(word)
        else:
            if last is None:
                last = new(open_[-1] if open_ else None)
                nodes[last]["name"] = word.replace("''", "'")
            elif re.fullmatch(r"[0-9.]+%?", word):
                nodes[last]["support"] = float(word.rstrip("%"))
            else:
                support, _, name = word.rpartition(":")
                nodes[last]["name"] = name
                if re.fullmatch(r"[0-9.]+%?", support):
                    nodes[last]["support"] = float(support.rstrip("%"))
    return nodes


def trees(df: DataFrame, tree: str, text: str) -> DataFrame:
    """tree, node, parent, name, length, support of the Newick trees in a text column; comments go."""

    @F.pandas_udf("array<struct<node: long, parent: long, name: string, length: double, support: double>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(newick_nodes, na_action="ignore")

    return df.select(F.col(tree).alias("tree"), F.inline(parsed(text)))


def _newick(rows: pd.DataFrame) -> pd.DataFrame:
    below: dict = {}
    for r in rows.sort_values("node").itertuples():
        below.setdefault(None if pd.isna(r.parent) else int(r.parent), []).append(r)

    def label(r) -> str:
        name = "" if r.name_ is None or pd.isna(r.name_) else r.name_
        name = "'" + name.replace("'", "''") + "'" if re.search(r"[\s(),:;\[\]'\"]", name) else name
        return name + ("" if pd.isna(r.length) else f":{r.length:.6g}")

    done: dict[int, str] = {}
    order, todo = [], list(below.get(None, []))
    while todo:
        r = todo.pop()
        order.append(r)
        todo += below.get(r.node, [])
    for r in reversed(order):
        inner = below.get(r.node)
        done[r.node] = ("(" + ",".join(done[c.node] for c in inner) + ")" if inner else "") + label(r)
    return pd.DataFrame({"tree": [rows["tree"].iloc[0]], "newick": [",".join(done[r.node] for r in below.get(None, [])) + ";"]})


def newick(nodes: DataFrame) -> DataFrame:
    """tree and newick: each tree as text. The text of a tree is one cell, so a tree is also the unit of work."""
    rows = nodes.select("tree", "node", "parent", F.col("name").alias("name_"), "length")
    return rows.groupBy("tree").applyInPandas(_newick, "tree string, newick string")


def matrix_lines(pairs: DataFrame, form: str = "%.6f", separator: str = " ") -> DataFrame:
    """a and line: each row of a lower-triangle matrix as text, from pairs (a, b, distance) of both directions."""
    below = F.array_sort(F.collect_list(F.when(F.col("b") < F.col("a"), F.struct("b", "distance"))))
    return pairs.groupBy("a").agg(F.array_join(F.concat(F.array(F.col("a").cast("string")), F.transform(below, lambda x: F.format_string(form, x["distance"]))), separator).alias("line"))
