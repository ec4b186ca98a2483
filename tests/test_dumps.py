"""Node dumps read in byte ranges of any size, against a parser with a stack."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stringloom.sources import nodes as node_io


def plain_nodes(text):
    """(id, parent, ord, key, path, type, value, marked) of each node, one line after the other."""
    stack, out, order = [(None, "")], [], {}
    kinds = {"i": "int", "f": "float", "y": "byte", "I": "bits", "Y": "bytes", "N": "ints", "F": "floats", "l": "link"}

    def add(key, kind, value, marked=False):
        parent, path = stack[-1]
        order[parent] = order.get(parent, -1) + 1
        out.append((len(out), parent, order[parent], key, f"{path}/{key or ''}", kind, value, marked))

    for line in text.split("\n"):
        line = re.sub(r"^\s*(/\*.*?\*/\s*)*", "", line.rstrip())
        if not line:
            continue
        m = re.fullmatch(r"([A-Za-z0-9_@]+)[ \t]+(?::\S+[ \t]+)?(.*)", line)
        if re.fullmatch(r"%\)\s*(/\*.*\*/)?", line):
            if len(stack) > 1:
                stack.pop()
            else:
                add(None, "corrupt", "%)")
        elif m and (c := re.fullmatch(r"%([%$])\s*\(%", m[2])):
            add(m[1], "container", None, c[1] == "$")
            stack.append((out[-1][0], out[-1][4]))
        elif m and (c := re.fullmatch(r"%([iyf])[ \t]+([+-]?\d+(\.\d*)?(e[+-]?\d+)?)", m[2])) or m and (c := re.fullmatch(r"%([lYNF])[ \t]+(.+)", m[2])) or m and (c := re.fullmatch(r'%(I)[ \t]+"([-+]*)"', m[2])):
            add(m[1], kinds[c[1]], c[2])
        elif m and (c := re.fullmatch(r'(?:%s[ \t]+)?"((?:[^"\\]|\\.)*)"', m[2])):
            add(m[1], "string", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), c[1]))
        else:
            add(None, "corrupt", line)
    return out


def made_dump(seed, size, damage):
    rng, lines, depth = random.Random(seed), ["/*DUMP*/"], 0
    for _ in range(size):
        tabs, kind = "\t" * depth, rng.random()
        if kind < 0.2 and depth < 6:
            lines.append(f"{tabs}box{rng.randint(0, 2)}\t\t{rng.choice(['', ':7600 '])}%{rng.choice('%$')} (%")
            depth += 1
        elif kind < 0.4 and depth:
            depth -= 1
            lines += [f"{tabs}%) /*box*/", ""]
        elif kind < 0.4 + damage:
            lines.append(rng.choice(["%)", 'name\t\t"open', "no value", "x\t%i seven", 'y\t\t%q 1', 'z\t\t"a"b"', "w\t\t%% (", 'v\t\t"tail\\"']))
            depth = max(0, depth - 1) if lines[-1] == "%)" else depth
        else:
            lines.append(tabs + rng.choice(['name\t\t"a \\"quoted\\" \\\\n text\\n"', "n\t\t%i -12", "f\t:123\t%f 3.1e-05", 'b\t\t%I "-+-"', 't\t\t%s "%s"', "l\t\t%l gene:1", "y\t\t%Y 00ff", 'e\t\t""', "s\t\t%y 3"]))
    return "\n".join([*lines, *["%)"] * rng.randint(0, depth)]) + "\n"


@pytest.mark.parametrize("split, end", [(300, "\n"), (700, "\r\n"), (1 << 20, "\n")])
def test_any_split_gives_the_same_nodes(spark, tmp_path, split, end):
    dumps = {f"d{k}.dump": made_dump(k, 80, 0.1) for k in range(3)}
    for name, text in dumps.items():
        (tmp_path / name).write_bytes(text.replace("\n", end).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        lines = node_io.dump_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 3 or split == 1 << 20
        got = node_io.read_nodes(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in dumps.items():
        own = sorted((r.id, r.parent, r.ord, r.key, r.path, r.type, r.value, r.marked) for r in got if r.file.endswith(name))
        assert own == plain_nodes(text)
    assert {r.type for r in got} >= {"corrupt", "container", "string", "int", "float", "bits", "link", "bytes", "byte"}


def test_dumps_are_written_and_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"d{k}.dump").write_text(made_dump(k + 10, 150, 0.05))
    nodes = node_io.read_nodes(spark, str(tmp_path / "in")).filter("type != 'corrupt'").cache()
    for k, (file,) in enumerate(nodes.select("file").distinct().collect()):
        lines = node_io.dumped(nodes.filter(F.col("file") == file)).orderBy("id").coalesce(1)
        lines.select("value").write.text(str(tmp_path / f"out{k}"))
        again = node_io.read_nodes(spark, str(tmp_path / f"out{k}"))
        rows = lambda df: sorted(((r.path, r.type, r.value, r.marked, r.id) for r in df.collect()), key=lambda r: r[-1])
        assert [r[:4] for r in rows(again)] == [r[:4] for r in rows(nodes.filter(F.col("file") == file))]


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.dump").write_text("/*DUMP*/\n\n")
    assert node_io.read_nodes(spark, str(tmp_path)).count() == 0
