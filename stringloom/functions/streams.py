"""Commands on streams: every value is an ordered list of strings (array<string>), every command maps lists to lists.

`fork` runs commands on the same input and appends their outputs, `pipe` feeds one command's output to the next,
and `apply` starts with one stream and joins what is left. Commands are ordinary Python values, so a macro is
a variable and a nested program an argument. Everything compiles to one native column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stringloom.functions import text as t

Command = Callable[[Column], Column]


def apply(value: Column, *commands: Command) -> Column:
    """The text that the piped commands make of the value; a null value is an empty text."""
    return F.array_join(pipe(*commands)(F.array(t.empty_if_null(value))), "")


def pipe(*commands: Command) -> Command:
    def run(streams: Column) -> Column:
        for c in commands:
            streams = c(streams)
        return streams

    return run


def fork(*commands: Command) -> Command:
    return lambda streams: F.concat(*[c(streams) for c in commands])


def each(function: Callable[[Column], Column]) -> Command:
    """A function of one string on every stream."""
    return lambda streams: F.transform(streams, lambda s: function(s).cast("string"))


def command(*commands: Command) -> Command:
    """A program of its own on every stream, with its output joined."""
    return lambda streams: F.transform(streams, lambda s: F.array_join(pipe(*commands)(F.array(s)), ""))


def do(*commands: Command) -> Command:
    """A program on all streams, with its output joined to one stream."""
    return lambda streams: F.array(F.array_join(pipe(*commands)(streams), ""))


def echo(*texts: str) -> Command:
    return lambda streams: F.array(*[F.lit(x) for x in texts]).cast("array<string>")


def sequence(data: str, parts: Column | None = None, rna: bool = False) -> Command:
    """The item's aligned data as the only stream, empty if it has none; with parts (see intervals) a gene's own piece of it."""
    from stringloom.operators.intervals import extracted

    return lambda streams: F.array(t.empty_if_null(F.col(data) if parts is None else extracted(F.col(data), parts, rna=rna)))


def sequence_type(kind: str) -> Command:
    """The kind of the alignment (dna, rna, ami), which is the same for all rows."""
    return echo(kind)


def read(field: str) -> Command:
    """A column of the row as the only stream; null is empty."""
    return lambda streams: F.array(t.empty_if_null(F.col(field)))


def dd(streams: Column) -> Column:
    return streams


def _checked(streams: Column, number: int) -> Column:
    """The stream number if there is such a stream, else an error."""
    text = F.concat(F.lit(f"no stream has the number {number}, the last one is "), F.size(streams).cast("string"))
    return F.when((F.lit(number) >= 1) & (F.lit(number) <= F.size(streams)), F.lit(number)).otherwise(F.raise_error(text).cast("int"))


def cut(*numbers: int) -> Command:
    return lambda streams: F.array(*[F.get(streams, _checked(streams, n) - 1) for n in numbers])


def drop(*numbers: int) -> Command:
    def run(streams: Column) -> Column:
        checked = F.array(*[_checked(streams, n) for n in numbers])
        return F.filter(streams, lambda s, i: ~F.array_contains(checked, i + 1))

    return run


def dropempty(streams: Column) -> Column:
    return F.filter(streams, lambda s: s != "")


def dropzero(streams: Column) -> Column:
    return F.filter(streams, lambda s: t.number(s) != 0)


def swap(a: int | None = None, b: int | None = None) -> Command:
    """Two streams change places, the last two if none are named."""

    def run(streams: Column) -> Column:
        n = F.size(streams)
        if a is None:
            first = F.when(n >= 2, n - 1).otherwise(F.raise_error(F.lit("only one of two streams to swap is there")).cast("int"))
            second = n
        else:
            first, second = _checked(streams, a), _checked(streams, b)
        return F.transform(streams, lambda s, i: F.when(i + 1 == first, F.get(streams, second - 1)).when(i + 1 == second, F.get(streams, first - 1)).otherwise(s))

    return run


def toback(number: int) -> Command:
    return lambda streams: F.concat(drop(number)(streams), cut(number)(streams))


def tofront(number: int) -> Command:
    return lambda streams: F.concat(cut(number)(streams), drop(number)(streams))


def merge(separator: str = "") -> Command:
    return lambda streams: F.array(F.array_join(streams, separator))


def split(separator: str = "\n", mode: int = 0) -> Command:
    """Every stream at the separator, which goes (mode 0), starts the next stream (1) or ends its own (2)."""
    quoted = "\\Q" + separator + "\\E"
    pattern = {0: quoted, 1: f"(?={quoted})", 2: f"(?<={quoted})"}[mode]
    return lambda streams: F.flatten(F.transform(streams, lambda s: F.split(s, pattern, -1)))


def streams(value: Column) -> Column:
    """The number of streams."""
    return F.array(F.size(value).cast("string"))


def head(n: int) -> Command:
    return each(lambda s: t.head(s, n))


def tail(n: int) -> Command:
    return each(lambda s: t.tail(s, n))


def length(without: str = "") -> Command:
    return each(lambda s: t.length_without(s, without))


def mid(first: int, last: int) -> Command:
    return each(lambda s: t.mid(s, first, last))


def mid0(first: int, last: int) -> Command:
    return each(lambda s: t.mid0(s, first, last))


def crop(chars: str) -> Command:
    return each(lambda s: t.crop(s, chars))


def remove(chars: str) -> Command:
    return each(lambda s: t.remove(s, chars))


def keep(chars: str) -> Command:
    return each(lambda s: t.keep(s, chars))


def count(chars: str) -> Command:
    return each(lambda s: t.count_chars(s, chars))


def rules(*pairs: tuple[str, str]) -> Command:
    return each(lambda s: t.replace_rules(s, *pairs))


def matched(pattern: str, ignore_case: bool = False) -> Command:
    return each(lambda s: t.matched(s, pattern, ignore_case))


def replaced(pattern: str, replacement: str, ignore_case: bool = False) -> Command:
    return each(lambda s: t.replaced(s, pattern, replacement, ignore_case))


def translate(old: str, new: str, other: str | None = None) -> Command:
    return each(lambda s: t.translate(s, old, new, other))


def tab(n: int) -> Command:
    return each(lambda s: t.pad_right(s, n))


def pretab(n: int) -> Command:
    return each(lambda s: t.pad_left(s, n))


upper, lower, caps = each(F.upper), each(F.lower), each(F.initcap)
escape, unescape, quote, unquote = each(t.escape), each(t.unescape), each(t.quote), each(t.unquote)
gcgchecksum = each(t.gcg_checksum)


def checksum(exclude: str = "", upper: bool = False) -> Command:
    return each(lambda s: t.checksum(s, exclude, upper))


def extract_words(chars: str, least: int) -> Command:
    return each(lambda s: t.extract_words(s, chars, least))


def extract_sequence(chars: str, share: float) -> Command:
    return each(lambda s: t.extract_sequence(s, chars, share))


def format_sequence(**options) -> Command:
    return each(lambda s: t.format_sequence(s, **options))


def format_text(value: Column, **options) -> Column:
    """Wrapped text of a whole column: this one needs a Python worker, so it takes a column and not a stream."""
    return t.format_text(value, **options)


def _binary(operation: Callable[[Column, Column], Column]):
    """No argument: pairs of streams; a text: each stream with it; two commands: their outputs for each stream."""

    def make(a=None, b=None) -> Command:
        def run(value: Column) -> Column:
            if a is None:
                odd = F.raise_error(F.lit("a stream is left without a partner")).cast("array<int>")
                half = F.size(value) / 2
                pairs = F.when(F.size(value) % 2 != 0, odd).when(half >= 1, F.sequence(F.lit(0), half.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
                return F.transform(pairs, lambda i: operation(F.get(value, i * 2), F.get(value, i * 2 + 1)).cast("string"))
            if b is None:
                return F.transform(value, lambda s: operation(s, F.lit(a)).cast("string"))
            joined = lambda c, s: F.array_join(c(F.array(s)), "")
            return F.transform(value, lambda s: operation(joined(a, s), joined(b, s)).cast("string"))

        return run

    return make


def _compared(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _caseless(operation):
    return lambda a, b: operation(F.lower(a), F.lower(b))


def _or_zero(operation):
    """Whole-number arithmetic that gives 0 where the divisor is 0."""
    return lambda a, b: F.when(t.number(b) == 0, F.lit(0)).otherwise(operation(t.number(a).cast("long"), F.nullif(t.number(b).cast("long"), F.lit(0).cast("long"))))


def _div(x: Column, y: Column) -> Column:
    """Truncates towards zero."""
    return F.call_function("div", x, y)


compare, icompare = _binary(_compared), _binary(_caseless(_compared))
equals, iequals = _binary(lambda a, b: (a == b).cast("int")), _binary(_caseless(lambda a, b: (a == b).cast("int")))
contains, icontains = _binary(F.instr), _binary(_caseless(F.instr))
partof, ipartof = _binary(lambda a, b: F.instr(b, a)), _binary(_caseless(lambda a, b: F.instr(b, a)))
plus = _binary(lambda a, b: t.number(a).cast("long") + t.number(b))
minus = _binary(lambda a, b: t.number(a).cast("long") - t.number(b))
mult = _binary(lambda a, b: t.number(a).cast("long") * t.number(b))
div = _binary(_or_zero(_div))
rest = _binary(_or_zero(lambda x, y: x % y))
per_cent = _binary(_or_zero(lambda x, y: _div(x * 100, y)))


def select(*programs: Command) -> Command:
    """Each stream's number picks a program, which runs on one empty stream."""

    def run(value: Column) -> Column:
        def chosen(s: Column) -> Column:
            n = t.number(s)
            found = F.when(F.lit(False), F.lit(""))
            for i, p in enumerate(programs):
                found = found.when(n == i, F.array_join(p(F.array(F.lit(""))), ""))
            return found.otherwise(F.raise_error(F.concat(F.lit("no program has the number "), s, F.lit(f", the last one is {len(programs) - 1}"))))

        return F.transform(value, chosen)

    return run


def _by_place(data: Column, other: Column, function) -> Column:
    """function(character of data, character of other) at each place of data, joined."""
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.array_join(F.filter(F.zip_with(chars(data), chars(other), lambda a, b: F.when(a.isNotNull(), function(a, F.coalesce(b, F.lit(""))))), lambda x: x.isNotNull()), "")


def difference(data: Column, against: Column, equal: str | None = ".", differ: str | None = None) -> Column:
    """data where it differs from the other sequence, `equal` where it doesn't; None leaves characters as they are."""
    kept = lambda a, as_: a if as_ is None else F.lit(as_)
    return _by_place(data, against, lambda a, b: F.when(a == b, kept(a, equal)).otherwise(kept(a, differ)))


def filtered(data: Column, by: Column, include: str = "", exclude: str = "") -> Column:
    """The columns of data where the other sequence has a character of `include`, or none of `exclude`."""
    wanted = lambda b: b.rlike(t.one_of(include)) if include else ~b.rlike(t.one_of(exclude))
    return _by_place(data, by, lambda a, b: F.when(wanted(b), a))


def changed(data: Column, by: Column, include: str, to: str, percent: float = 100.0, seed: int = 0) -> Column:
    """Letters of data become one of `to` with the given probability, where the other sequence has a character of `include`.

    The draw hashes text, place and seed, so reruns agree.
    """
    chars = lambda c: F.filter(F.split(c, ""), lambda ch: ch != "")
    letters = F.arrays_zip(chars(data).alias("a"), chars(by).alias("b"), F.array_repeat(F.xxhash64(data), F.char_length(data)).alias("of"))
    options = F.array(*[F.lit(x) for x in to])

    def one(x: Column, i: Column) -> Column:
        draw = lambda salt: F.pmod(F.xxhash64(x["of"], i, F.lit(seed), F.lit(salt)), F.lit(1 << 30))
        hit = x["a"].rlike("[A-Za-z]") & F.coalesce(x["b"], F.lit("")).rlike(t.one_of(include)) & (draw("draw") < F.lit(percent / 100.0 * (1 << 30)))
        return F.when(hit, F.get(options, (draw("pick") % len(to)).cast("int"))).otherwise(x["a"])

    return F.array_join(F.filter(F.transform(letters, one), lambda ch: ch.isNotNull()), "")


def pairwise(function: Callable[[Column, Column], Column]) -> Command:
    """function(second, first) on pairs of streams: the first of a pair is the filter, the second the data."""

    def run(value: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size(value) / 2).cast("int") - 1), lambda i: function(F.get(value, i * 2 + 1), F.get(value, i * 2)))

    return run
