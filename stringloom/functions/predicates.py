"""Search predicates: wildcards, numbers, regular expressions and programs, with and, or, not."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def wildcard(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whole-value match; * is any run, ? one character. Null never matches.

    What follows the last * is only tested against the end of the value, also if it overlaps what came before.
    """
    flags = "(?is)" if ignore_case else "(?s)"
    regex = lambda p: "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in p)
    if "*" not in pattern:
        return F.coalesce(c.rlike(f"{flags}^{regex(pattern)}$"), F.lit(False))
    before, after = pattern.rsplit("*", 1)
    matches = c.rlike(f"{flags}^{regex(before)}") if before else c.isNotNull()
    if after:
        matches = matches & c.rlike(f"{flags}{regex(after)}$")
    return F.coalesce(matches, F.lit(False))


def position(c: Column, pattern: str, ignore_case: bool = False, wildcards: bool = False) -> Column:
    """1-based place of the first occurrence within the value, 0 if none; with wildcards ? is any character."""
    regex = "".join("." if wildcards and ch == "?" else re.escape(ch) for ch in pattern)
    return F.coalesce(F.regexp_instr(c, F.lit(("(?is)" if ignore_case else "(?s)") + f"({regex})")), F.lit(0))


def numeric(c: Column, sign: str, value: float) -> Column:
    """< or > on values that are numbers; what isn't a number never matches, so its negation does."""
    as_number = c.cast("string").try_cast("double")
    return F.coalesce(as_number < value if sign == "<" else as_number > value, F.lit(False))


def matches(c: Column, expression: str) -> Column:
    """The predicate of one search line: empty (no value), <n, >n, /regex/, or a wildcard (case doesn't count)."""
    if expression == "":
        return c.isNull()
    if expression == "*":
        return c.isNotNull() & (c.cast("string") != "")
    if expression[0] in "<>" and re.fullmatch(r"\s*[+-]?\d+(\.\d+)?\s*", expression[1:]):
        return numeric(c, expression[0], float(expression[1:]))
    if m := re.fullmatch(r"/(.+)/(i?)", expression, re.S):
        return F.coalesce(c.rlike(("(?i)" if m[2] else "") + m[1]), F.lit(False))
    return wildcard(c.cast("string"), expression)


def program_hits(result: Column) -> Column:
    """A row is a hit if what a program made of it is not 0."""
    return F.coalesce(result.cast("string"), F.lit("")) != "0"


def any_field(columns: list[Column], expression: str) -> Column:
    """Any of the columns matches."""
    return F.exists(F.array(*[c.cast("string") for c in columns]), lambda c: matches(c, expression))


@dataclass(frozen=True)
class Line:
    """One search line: a predicate, how it joins the lines before it ('and' or 'or'), and whether it is negated."""

    predicate: Column
    join: str = "and"
    negated: bool = False


def combined(*lines: Line) -> Column:
    """The lines from first to last, without precedence."""
    found = None
    for line in lines:
        one = F.coalesce(line.predicate, F.lit(False))
        one = ~one if line.negated else one
        found = one if found is None else (found & one if line.join == "and" else found | one)
    return found
