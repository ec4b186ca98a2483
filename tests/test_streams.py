"""Stream commands against plain Python versions of them, on made-up texts."""

import datetime
import math
import random
import re
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stringloom.functions import streams as s
from stringloom.functions import text as t

_random = random.Random(11)
WORDS = ["river", "Stone", "a", "", "0", "17", "-4", "bend", "BEND", "x=y", "tab\tbed", "ünder", "00", "9000000000", " pad ", "q\"uo\\te", "aabbb"]
#: Lists of streams; an item of the table is one list.
LISTS = [["river", "Stone"], ["", ""], ["17", "-4"], ["9000000000", "17"]] + [[_random.choice(WORDS) for _ in range(2 * _random.randint(1, 4))] for _ in range(60)]


def whole(x):
    m = re.match(r"\s*([+-]?\d+)", x)
    return int(m[1]) if m else 0


def each(f):
    return lambda streams: [str(f(x)) for x in streams]


def pairs(f):
    return lambda streams: [str(f(a, b)) for a, b in zip(streams[::2], streams[1::2])]


def toward_zero(a, b):
    return 0 if b == 0 else abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def sign(a, b):
    return (a > b) - (a < b)


def find(a, b):
    return a.find(b) + 1


def capitals(x):
    return " ".join(w[:1].upper() + w[1:].lower() for w in x.split(" "))


def between(x, first, last):
    """Characters first to last, from 0; a negative place counts from the end."""
    n = len(x)
    start, stop = (p if p >= 0 else n + p for p in (first, last))
    return x[max(start, 0) : max(stop + 1, max(start, 0))]


def marked_rules(x):
    """The rules of the test in Python's terms."""
    x = x if x == "" else x.replace("en", "<N>")
    x = x if x == "" else re.sub("(?s)b(.)d", r"(\1)", x)
    return x if x == "" else re.sub("(?s)S(.*?)n", r"\1~", x)


COMMANDS = {
    "echo": (s.echo("one", "two"), lambda x: ["one", "two"]),
    "dd": (s.dd, lambda x: x),
    "fork": (s.fork(s.dd, s.echo("+"), s.length()), lambda x: x + ["+"] + [str(len(v)) for v in x]),
    "do": (s.do(s.fork(s.dd, s.dd)), lambda x: ["".join(x + x)]),
    "command": (s.command(s.fork(s.dd, s.echo("|"))), each(lambda v: v + "|")),
    "cut": (s.cut(2, 1), lambda x: [x[1], x[0]]),
    "drop": (s.drop(1), lambda x: x[1:]),
    "dropempty": (s.dropempty, lambda x: [v for v in x if v]),
    "dropzero": (s.dropzero, lambda x: [v for v in x if whole(v)]),
    "swap": (s.swap(), lambda x: x[:-2] + [x[-1], x[-2]]),
    "swap of two": (s.swap(1, 2), lambda x: [x[1], x[0]] + x[2:]),
    "toback": (s.toback(1), lambda x: x[1:] + x[:1]),
    "tofront": (s.tofront(2), lambda x: [x[1], x[0]] + x[2:]),
    "merge": (s.merge("; "), lambda x: ["; ".join(x)]),
    "split": (s.pipe(s.merge("\n"), s.split()), lambda x: "\n".join(x).split("\n")),
    "split before": (s.split("e", 1), lambda x: [p for v in x for p in re.split("(?=e)", v)]),
    "split behind": (s.split("e", 2), lambda x: [p for v in x for p in re.split("(?<=e)", v)]),
    "streams": (s.streams, lambda x: [str(len(x))]),
    "head": (s.head(3), each(lambda v: v[:3])),
    "head of none": (s.head(-1), each(lambda v: "")),
    "tail": (s.tail(2), each(lambda v: v[-2:])),
    "length": (s.length(), each(len)),
    "length without": (s.length("be"), each(lambda v: len(v) - v.count("b") - v.count("e"))),
    "mid": (s.mid(2, 3), each(lambda v: v[1:3])),
    "mid from the end": (s.mid(-1, 0), each(lambda v: between(v, -2, -1))),
    "mid0": (s.mid0(1, -2), each(lambda v: between(v, 1, -2))),
    "crop": (s.crop(" a"), each(lambda v: v.strip(" a"))),
    "remove": (s.remove("aeb-"), each(lambda v: re.sub("[aeb-]", "", v))),
    "keep": (s.keep("aeb-]"), each(lambda v: re.sub("[^aeb\\]-]", "", v))),
    "count": (s.count("be\\"), each(lambda v: len(re.findall(r"[be\\]", v)))),
    "rules": (s.rules(("en", "<N>"), ("b?d", "(?1)"), ("S*n", "*1~")), each(marked_rules)),
    "matched": (s.matched("[a-z]+e"), each(lambda v: (re.search("[a-z]+e", v) or [""])[0])),
    "matched in any case": (s.matched("BE.", True), each(lambda v: (re.search("(?i)BE.", v) or [""])[0])),
    "replaced": (s.replaced("([aeiou])([a-z])", r"\2\1"), each(lambda v: re.sub("([aeiou])([a-z])", r"\2\1", v))),
    "translate": (s.translate("abe", "xyz"), each(lambda v: v.translate(str.maketrans("abe", "xyz")))),
    "translate others": (s.translate("ab", "xy", "."), each(lambda v: "".join({"a": "x", "b": "y"}.get(c, ".") for c in v))),
    "tab": (s.tab(5), each(lambda v: v.ljust(5))),
    "pretab": (s.pretab(5), each(lambda v: v.rjust(5))),
    "upper": (s.upper, each(str.upper)),
    "lower": (s.lower, each(str.lower)),
    "caps": (s.pipe(s.remove("\t\"\\"), s.caps), each(lambda v: capitals(re.sub(r'[\t"\\]', "", v)))),
    "escape": (s.escape, each(lambda v: re.sub(r'(["\\])', r"\\\1", v))),
    "escape and back": (s.pipe(s.escape, s.quote, s.unquote, s.unescape), lambda x: x),
    "quote": (s.quote, each(lambda v: f'"{v}"')),
    "checksum": (s.checksum("e"), each(lambda v: f"{zlib.crc32(v.replace('e', '').encode()):08X}")),
    "gcgchecksum": (s.gcgchecksum, each(lambda v: sum(ord(c) * (i % 57 + 1) for i, c in enumerate(v.upper())) % 10000)),
    "plus": (s.plus(), pairs(lambda a, b: whole(a) + whole(b))),
    "minus": (s.minus("3"), each(lambda v: whole(v) - 3)),
    "mult": (s.mult("-2"), each(lambda v: whole(v) * -2)),
    "div": (s.div(), pairs(lambda a, b: toward_zero(whole(a), whole(b)))),
    "rest": (s.rest("7"), each(lambda v: int(math.fmod(whole(v), 7)) if abs(whole(v)) < 1 << 50 else None)),
    "per_cent": (s.per_cent("40"), each(lambda v: toward_zero(whole(v) * 100, 40))),
    "nothing divided": (s.div("0"), each(lambda v: 0)),
    "of two programs": (s.minus(s.length(), s.count("e")), each(lambda v: len(v) - v.count("e"))),
    "compare": (s.compare(), pairs(lambda a, b: sign(a.encode(), b.encode()))),
    "icompare": (s.icompare("bend"), each(lambda v: sign(v.lower().encode(), b"bend"))),
    "equals": (s.equals("bend"), each(lambda v: int(v == "bend"))),
    "iequals": (s.iequals("bend"), each(lambda v: int(v.lower() == "bend"))),
    "contains": (s.contains("en"), each(lambda v: find(v, "en"))),
    "icontains": (s.icontains("EN"), each(lambda v: find(v.lower(), "en"))),
    "partof": (s.partof("riverbend"), each(lambda v: find("riverbend", v))),
    "ipartof": (s.ipartof("RIVERBEND"), each(lambda v: find("riverbend", v.lower()))),
    "select": (s.pipe(s.length(), s.rest("3"), s.select(s.echo("none"), s.echo("one"), s.echo("two"))), each(lambda v: ["none", "one", "two"][len(v) % 3])),
    "difference": (s.pairwise(lambda d, f: s.difference(d, f, "=", None)), pairs(lambda f, d: "".join("=" if c == f[i : i + 1] else c for i, c in enumerate(d)))),
    "filtered": (s.pairwise(lambda d, f: s.filtered(d, f, include="abe")), pairs(lambda f, d: "".join(c for i, c in enumerate(d) if f[i : i + 1] and f[i] in "abe"))),
    "filtered out": (s.pairwise(lambda d, f: s.filtered(d, f, exclude="abe")), pairs(lambda f, d: "".join(c for i, c in enumerate(d) if f[i : i + 1] not in ("a", "b", "e")))),
    "changed": (s.pairwise(lambda d, f: s.changed(d, f, "abe", "#")), pairs(lambda f, d: "".join("#" if re.match("[A-Za-z]", c) and f[i : i + 1] in ("a", "b", "e") else c for i, c in enumerate(d)))),
    "extract_words": (s.pipe(s.merge(" "), s.extract_words("0123456789", 2)), lambda x: [" ".join(sorted(w for w in re.split("[ \t,;:|]", " ".join(x)) if len(re.findall("[0-9]", w)) >= 2))]),
    "extract_sequence": (s.pipe(s.merge(" "), s.extract_sequence("bend", 0.75)), lambda x: [" ".join(w for w in re.split("[ \t,;:|]", " ".join(x)) if len(w) >= 3 and sum(c in "bend" for c in w) >= 0.75 * len(w))]),
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(LISTS)), "id int, streams array<string>").cache()


@pytest.mark.parametrize("name", COMMANDS)
def test_command(table, name):
    command, plain = COMMANDS[name]
    got = {r.id: r.out for r in table.select("id", command(F.col("streams")).alias("out")).collect()}
    for k, streams in enumerate(LISTS):
        assert got[k] == plain(list(streams)), streams


def test_apply_starts_with_one_stream(spark):
    df = spark.createDataFrame([("slow river",), (None,)], "x string")
    assert [r[0] for r in df.select(s.apply(F.col("x"), s.fork(s.dd, s.echo("/"), s.read("x")))).collect()] == ["slow river/slow river", "/"]
    assert [r[0] for r in df.select(s.apply(F.lit(""), s.sequence("x"), s.length())).collect()] == ["10", "0"]
    assert df.select(s.apply(F.lit("z"), s.sequence_type("rna"))).first()[0] == "rna"


@pytest.mark.parametrize("text, program, message", [
    ("stone", (s.drop(3),), "no stream has the number 3, the last one is 1"),
    ("stone", (s.cut(0),), "no stream has the number 0"),
    ("stone", (s.swap(),), "only one of two streams"),
    ("st,one", (s.split(","), s.swap(1, 5)), "no stream has the number 5, the last one is 2"),
    ("0,7", (s.split(","), s.select(s.dd, s.dd)), "no program has the number 7, the last one is 1"),
    ("1,2,3", (s.split(","), s.plus()), "without a partner"),
    ("99999999999999999999", (s.plus("1"),), "99999999999999999999"),
])
def test_errors(spark, text, program, message):
    with pytest.raises(PySparkException, match=message):
        spark.range(1).select(s.apply(F.lit(text), *program)).collect()


def plain_lines(text, width, first, tab, gap, left, right):
    """A sequence in lines of blocks, line by line."""
    out, n = [], len(text)
    for k in range(0, max(n, 1), width):
        part = text[k : k + width]
        blocks = " ".join(part[i : i + gap] for i in range(0, len(part), gap)) if gap else part
        indent = tab if k else first
        lead = str(k + 1).ljust(indent)[:max(indent, 0)] if left else " " * indent
        if right:
            full = width + ((width - 1) // gap if gap else 0)
            blocks = blocks.ljust(full) + " " + str(min(k + width, n)).rjust(right if right > 0 else len(str(n)))
        out.append(lead + blocks)
    return "\n".join(out)


@pytest.mark.parametrize("options", [(7, 4, 4, 3, False, 0), (7, 6, 2, 0, True, 0), (5, 3, 3, 2, False, 6), (5, 0, 1, 5, False, -1), (40, 2, 2, 10, False, 0), (1, 0, 0, 1, False, 0)])
def test_sequences_in_lines(spark, options):
    width, first, tab, gap, left, right = options
    texts = ["", "g", "gattaca", "gattacagattacagattac", "ggg" * 11]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = [r[0] for r in df.select(t.format_sequence(F.col("x"), width=width, first_tab=first, tab=tab, gap=gap, number_left=left, number_right=right)).collect()]
    assert got == [plain_lines(x, *options) for x in texts]
    with pytest.raises(ValueError, match="at least 1"):
        t.format_sequence(F.col("x"), width=0)
    with pytest.raises(ValueError, match="exclude"):
        t.format_sequence(F.col("x"), number_left=True, number_right=3)


def test_wrapped_text(spark):
    """No line is too long, no word is lost, and a line ends where the next word would not fit."""
    texts = ["", "short", "many small words make a long line of text", "averyveryverylongwordindeed and more", "two\nlines of text here"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for width in (4, 9, 100):
        for x, row in zip(texts, df.select(t.format_text(F.col("x"), width=width, first_tab=3, tab=1)).collect()):
            lines = row[0].split("\n")
            assert lines[0][:3] == "   " and all(v.startswith(" ") for v in lines)
            bodies = [lines[0][3:], *[v[1:] for v in lines[1:]]]
            assert max(map(len, bodies)) <= width
            assert re.sub(r"\s", "", "".join(bodies)) == re.sub(r"\s", "", x)
            for a, b in zip(bodies, bodies[1:]):
                if "\n" not in x and width == 9 and " " in x and b.split(" ")[0] in x.split(" ") and a.split(" ")[-1] in x.split(" "):
                    assert len(a) + 1 + len(b.split(" ")[0]) > width
    with pytest.raises(ValueError, match="at least 1"):
        t.format_text(F.col("x"), width=0)


def test_numbers(spark):
    texts = ["12345678901", "-9000000000 apples", "+5", "  7", "x7", "", "-", "0009223372036854775807", "1999999999"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(t.number(F.col("x"))).collect()] == [whole(x) for x in texts]
    values = [0.0, 2.5, -3.25, 1e6, 0.1, 1 / 3, None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [r[0] for r in df.select(t.number_text(F.col("x"), 4)).collect()] == ["0", "2.5", "-3.25", "1000000", "0.1", "0.3333", None]
    counts = [0, 1, 5, 999, 1000, 1001, 100_000]
    df = spark.createDataFrame([(x,) for x in counts], "x int")
    for n, r in zip(counts, df.select(t.log_factorial(F.col("x"))).collect()):
        assert math.isclose(r[0], math.lgamma(n + 1), rel_tol=1e-11, abs_tol=1e-11)
    assert spark.range(1).select(t.log_factorial(F.lit(-1))).first()[0] is None


def test_tabs_go_to_the_next_stop(spark):
    texts = ["", "\t", "a\tb", "12345678\tx", "1234567\tx\ty\n\tz\n\n a\t", "no tab"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for width in (8, 3):
        assert [r[0] for r in df.select(t.expand_tabs(F.col("x"), width)).collect()] == [x.expandtabs(width) for x in texts]


def test_rules_with_fields(spark):
    """A field goes in as it is, whatever signs it or the text holds; its default stands for a missing one."""
    rows = [("a\0b and b", "*x?"), ("b", None), ("", "y"), ("none", "z")]
    df = spark.createDataFrame(rows, "x string, f string")
    got = [r[0] for r in df.select(t.replace_rules(F.col("x"), ("b", t.field(F.col("f"), "-")))).collect()]
    assert got == [x.replace("b", f or "-") if x else x for x, f in rows]
    nested = t.field(F.col("f"), "-", ("x", "X"))
    assert df.select(t.replace_rules(F.col("x"), ("b", nested))).first()[0] == "a\0*X? and *X?"
    program = t.field(F.col("f"), "-", program=lambda c: s.apply(c, s.length()))
    assert df.select(t.replace_rules(F.col("x"), ("b", program))).first()[0] == "a\x003 and 3"
    with pytest.raises(ValueError, match="search"):
        t.replace_rules(F.col("x"), ("", "y"))


def test_authors_and_keys(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(t.author_list(F.lit("Doe J., Roe R., Low L. ;"))) == "Doe J., Roe R. and Low L."
    assert one(t.author_list(F.lit("Doe J."))) == "Doe J." and one(t.author_list(F.lit(""))) == ""
    assert [one(t.key_fault(F.lit(x))) for x in ("a", "ab", "a b", "a" * 31)] == ["short", None, "character", "long"]


def test_tags_and_dates(spark):
    row = spark.range(1).select(
        t.tags(F.lit("free [P] left [Q] right [P] again")).alias("tags"), t.merge_tags(F.lit("[P] left [Q] right"), F.lit("[Q] recht [R] rest")).alias("merged"),
        t.record_date(F.lit("3-mar-2005")).alias("d1"), t.record_date(F.lit("2005-03-03")).alias("d2"), t.record_date(F.lit("someday")).alias("d3"),
        t.clean_key(F.lit("k.1/x")).alias("key"), t.shorten_repeats(F.lit("moooon  ss")).alias("short"),
    ).first()
    assert row.tags == {"": "free", "P": "left", "Q": "right"}
    assert row.merged == "[P] left [Q] right recht [R] rest"
    assert (row.d1, row.d2, row.d3) == (datetime.date(2005, 3, 3).strftime("%d-%b-%Y").upper(),) * 2 + (None,)
    assert (row.key, row.short) == ("k_1_x", "mon s")
