"""String functions as native columns. Positions and lengths count code points; null counts as empty where the docstring says so."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a word of extract_words (fixed values).
WORD_ENDS = " \t,;:|"


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def one_of(chars: str) -> str:
    """A regular expression for one character of chars."""
    return "[" + "".join("\\" + ch if ch in "\\]^-[&" else ch for ch in chars) + "]" if chars else "(?!)"


def none_of(chars: str) -> str:
    return "[^" + one_of(chars)[1:] if chars else "(?s:.)"


def number(c: Column) -> Column:
    """The whole number (64 bits) that a text starts with, 0 if it starts with none; one beyond that range is an error."""
    digits = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1)
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.cast("long"))


def head(c: Column, n: int) -> Column:
    return F.left(c, F.lit(max(n, 0)))


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(max(n, 0)))


def mid0(c: Column, first: int, last: int) -> Column:
    """Characters from position first to last, counted from 0; a negative position counts from the end."""
    n = F.char_length(c)
    start = F.lit(first) if first >= 0 else F.greatest(n + first, F.lit(0))
    stop = F.lit(last) if last >= 0 else n + last
    return F.substring(c, start + 1, F.greatest(stop - start + 1, F.lit(0)))


def mid(c: Column, first: int, last: int) -> Column:
    """Characters from position first to last, counted from 1; a position below 1 counts from the end."""
    return mid0(c, first - 1, last - 1)


def crop(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def remove(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, one_of(chars), "")


def keep(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, none_of(chars), "")


def count_chars(c: Column, chars: str) -> Column:
    return F.char_length(c) - F.char_length(remove(c, chars))


def length_without(c: Column, chars: str = "") -> Column:
    return F.char_length(remove(c, chars)) if chars else F.char_length(c)


def translate(c: Column, old: str, new: str, other: str | None = None) -> Column:
    """Characters of old become those of new in the same place, all others become `other` if that is given."""
    if other is None:
        return F.translate(c, old, new)
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.when(ch == "", ch).when(ch.rlike(f"^{one_of(old)}$"), F.translate(ch, old, new)).otherwise(other)), "")


def pad_right(c: Column, n: int) -> Column:
    """Blanks to n characters; longer text is never cut."""
    return F.rpad(c, F.greatest(F.lit(n), F.char_length(c)), F.lit(" "))


def pad_left(c: Column, n: int) -> Column:
    return F.lpad(c, F.greatest(F.lit(n), F.char_length(c)), F.lit(" "))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, one_of(WORD_ENDS)), lambda w: w != "")


def extract_words(c: Column, chars: str, least: int) -> Column:
    """Words with at least `least` characters of chars, sorted, joined by blanks."""
    return F.array_join(F.array_sort(F.filter(_words(c), lambda w: count_chars(w, chars) >= least)), " ")


def extract_sequence(c: Column, chars: str, share: float) -> Column:
    """Words of which at least the given share of characters is in chars, in order; below 1.0 a word needs 3 characters."""
    good = lambda w: (count_chars(w, chars) >= F.char_length(w) * share) & (F.lit(share >= 1.0) | (F.char_length(w) >= 3))
    return F.array_join(F.filter(_words(c), good), " ")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r'([\\"])', r"\\$1")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def quote(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def unquote(c: Column) -> Column:
    """Without the quotes around it; text that isn't quoted on both ends stays."""
    return F.when(c.rlike(r'(?s)^".*"$') & (F.char_length(c) > 1), F.substring(c, F.lit(2), F.char_length(c) - 2)).otherwise(c)


def checksum(c: Column, exclude: str = "", upper: bool = False) -> Column:
    """CRC-32 as 8 hexadecimal digits."""
    c = remove(c, exclude) if exclude else c
    return F.lpad(F.hex(F.crc32((F.upper(c) if upper else c).cast("binary"))), 8, "0")


def gcg_checksum(c: Column) -> Column:
    """Upper-case codes times places 1 to 57, repeating, modulo 10000."""
    chars = F.filter(F.split(F.upper(c), ""), lambda ch: ch != "")
    return F.aggregate(F.transform(chars, lambda ch, i: F.ascii(ch).cast("long") * (i % 57 + 1)), F.lit(0).cast("long"), lambda a, x: a + x) % 10000


def format_sequence(c: Column, width: int = 50, first_tab: int = 10, tab: int = 10, gap: int = 10, number_left: bool = False, number_right: int = 0) -> Column:
    """Lines of `width` characters in blocks of `gap`. number_right: width of the numbers on the right, -1 for as wide as needed."""
    if width < 1:
        raise ValueError("width must be at least 1")
    if number_left and number_right:
        raise ValueError("number_left and number_right exclude each other")
    full = width + (max(0, (width - 1) // gap) if gap else 0)
    parts = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    parts = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    sized = F.arrays_zip(parts.alias("part"), F.array_repeat(F.char_length(c), F.size(parts)).alias("n"))

    def line(x: Column, i: Column) -> Column:
        part = F.regexp_replace(x["part"], f"(?s)(.{{{gap}}})(?=.)", "$1 ") if gap else x["part"]
        indent = F.when(i == 0, F.lit(first_tab)).otherwise(F.lit(tab))
        lead = F.rpad((i * width + 1).cast("string"), indent, F.lit(" ")) if number_left else F.repeat(F.lit(" "), indent)
        if number_right:
            size = F.lit(number_right) if number_right > 0 else F.char_length(x["n"].cast("string"))
            part = F.concat(F.rpad(part, full, " "), F.lit(" "), F.lpad(F.least((i + 1) * width, x["n"]).cast("string"), size, F.lit(" ")))
        return F.concat(lead, part)

    return F.array_join(F.transform(sized, line), "\n")


def _wrap(text: str, width: int, first_tab: int, tab: int, breaks: str, forced: str) -> str:
    lines = []
    for part in re.split("[" + re.escape(forced) + "]", text) if forced else [text]:
        while len(part) > width:
            at = max((part.rfind(ch, 1, width + 1) for ch in breaks), default=-1)
            lines.append(part[:at] if at > 0 else part[:width])
            part = part[at + 1 :] if at > 0 else part[width:]
        lines.append(part)
    return "\n".join(" " * (tab if i else first_tab) + x for i, x in enumerate(lines))


def format_text(c: Column, width: int = 50, first_tab: int = 10, tab: int = 10, breaks: str = " ", forced: str = "\n") -> Column:
    """Text wrapped at the last of `breaks` that fits, which goes; where there is none, after `width` characters."""
    if width < 1:
        raise ValueError("width must be at least 1")

    @F.pandas_udf("string")
    def wrapped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _wrap(t, width, first_tab, tab, breaks, forced), na_action="ignore")

    return wrapped(c)


def _rule_pattern(search: str) -> tuple[str, list[str]]:
    """A search of a replacement rule as a regular expression, and which wildcard each group stands for."""
    parts, kinds = ["(?s)"], []
    for i, ch in enumerate(search):
        if ch == "*":
            parts.append("(.*)" if i == len(search) - 1 else "(.*?)")
            kinds.append("*")
        elif ch == "?":
            parts.append("(.)")
            kinds.append("?")
        else:
            parts.append(re.escape(ch))
    return "".join(parts), kinds


def _rule_replacement(replacement: str, kinds: list[str]) -> str:
    """*n and ?n stand for the n-th wildcard of that kind, without a number for the next one."""
    groups = {k: [i + 1 for i, x in enumerate(kinds) if x == k] for k in "*?"}
    used, out = {"*": 0, "?": 0}, []
    for m in re.finditer(r"([*?])([1-9]?)|([\\$])|(.)", replacement, re.S):
        if m[1]:
            used[m[1]] += not m[2]
            which = int(m[2]) if m[2] else used[m[1]]
            out.append(f"${{g{groups[m[1]][which - 1]}}}" if which <= len(groups[m[1]]) else "")
        else:
            out.append("\\" + m[3] if m[3] else m[4])
    return "".join(out)


def replace_rules(c: Column, *rules: tuple[str, str]) -> Column:
    """Rules (search, replacement) one after the other, each on all places; * is the shortest run, ? one character.

    In a replacement *1 or ?2 stand for what the first * or the second ? of the search took. A replaced
    piece is not searched again. Empty text is changed only by a rule that searches for * alone. A
    replacement may also be a column (see field), which is inserted as it is.
    """
    for search, replacement in rules:
        if not search:
            raise ValueError("a rule needs something to search for")
        if isinstance(replacement, Column):
            pieces = F.split(c, _rule_pattern(search)[0], -1)
            c = F.when(c == "", c).otherwise(F.call_function("array_join", pieces, empty_if_null(replacement)))
            continue
        pattern, kinds = _rule_pattern(search)
        named = iter(range(1, len(kinds) + 1))
        pattern = re.sub(r"\((\.\*\??|\.)\)", lambda m: f"(?<g{next(named)}>{m[1]})", pattern)
        if search == "*":
            pattern = "(?s)^(?<g1>.*)$"
        done = F.regexp_replace(c, F.lit(pattern), F.lit(_rule_replacement(replacement, kinds)))
        c = done if search == "*" else F.when(c == "", c).otherwise(done)
    return c


def field(c: Column, default: str = "", *rules: tuple[str, str], program: Callable[[Column], Column] | None = None) -> Column:
    """A column as the replacement of a rule: the default where it is null or empty, else what rules or a program make of it."""
    text = empty_if_null(c)
    value = program(text) if program else replace_rules(text, *rules) if rules else text
    return F.when(text == "", F.lit(default)).otherwise(value)


def matched(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    """The first match of a regular expression, empty if there is none."""
    return F.regexp_extract(c, ("(?i)" if ignore_case else "") + pattern, 0)


def replaced(c: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    r"""All matches replaced; \1 in the replacement is the first group."""
    return F.regexp_replace(c, ("(?i)" if ignore_case else "") + pattern, re.sub(r"\\(\d)", r"$\1", replacement))


def tags(c: Column) -> Column:
    """map of `[TAG] text` sections; text before the first tag is under the empty tag; of a repeated tag the first counts."""
    sections = F.filter(F.split(F.regexp_replace(c, r"\s*\[(\w+)\]\s*", "\u0001$1\u0002"), "\u0001"), lambda s: s != "")
    pairs = F.transform(sections, lambda s: F.when(F.contains(s, F.lit("\u0002")), F.split(s, "\u0002")).otherwise(F.array(F.lit(""), s)))
    entry = lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q[0] == p[0]))
    return F.map_from_entries(F.transform(first, entry))


def merge_tags(a: Column, b: Column) -> Column:
    """Two tagged texts as one, tags sorted; texts that both hold under a tag are kept once, different ones joined by a blank."""
    left, right = tags(a), tags(b)
    keys = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))

    def section(k: Column) -> Column:
        texts = F.array_distinct(F.array_compact(F.array(F.try_element_at(left, k), F.try_element_at(right, k))))
        text = F.array_join(texts, " ")
        return F.when(k == "", text).otherwise(F.concat(F.lit("["), k, F.lit("] "), text))

    return F.array_join(F.transform(keys, section), " ")


def clean_key(c: Column) -> Column:
    """Letters, digits, _ and @ are legal in a key, all others become _."""
    return F.regexp_replace(c, "[^A-Za-z0-9_@]", "_")


def shorten_repeats(c: Column, most: int = 1) -> Column:
    """Runs of one character cut to `most`."""
    return F.regexp_replace(c, f"(?s)(.)\\1{{{most},}}", "$1" * most)


def expand_tabs(c: Column, width: int = 8) -> Column:
    """Each tab filled up with blanks to the next multiple of width in its line."""

    def line(text: Column) -> Column:
        # behind a tab a piece starts at a multiple of the width, so its own length tells how many blanks follow
        pieces = F.split(text, "\t", -1)
        filled = lambda p: F.rpad(p, ((F.char_length(p) / width).cast("int") + 1) * width, F.lit(" "))
        return F.concat(F.array_join(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), filled), ""), F.element_at(pieces, -1))

    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


def number_text(c: Column, digits: int = 6) -> Column:
    """A number as text: whole ones without a point, others with up to `digits` places and no zeros at the end; null stays null."""
    value = c.cast("double")
    fixed = F.regexp_replace(F.format_string(f"%.{digits}f", value), "\\.?0+$", "") if digits else F.format_string("%.0f", value)
    return F.when(value.isNotNull(), F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(fixed))


def log_factorial(n: Column, largest: int = 1000) -> Column:
    """ln(n!) of whole numbers: a sum up to `largest`, beyond it Stirling's series, which is exact to 1e-12 there; null below 0."""
    sums = [0.0]
    for k in range(1, largest + 1):
        sums.append(sums[-1] + math.log(k))
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    known = F.get(F.array(*[F.lit(v) for v in sums]), F.when((n >= 0) & (n <= largest), n).cast("int"))
    return F.when(n >= 0, F.when(n <= largest, known).otherwise(series))


def author_list(c: Column) -> Column:
    """Authors of a reference as `A., B. and C.`: a semicolon at the end goes, the last comma becomes `and`."""
    names = F.filter(F.split(F.regexp_replace(c, "\\s*;\\s*$", ""), "\\s*,\\s*"), lambda x: x != "")
    n = F.size(names)
    return F.when(n > 1, F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(names, -1))).otherwise(F.array_join(names, ""))


#: Why a name is no key (fixed values of this function): too short, too long, or a character that isn't allowed.
KEY_FAULTS = ("short", "long", "character")


def key_fault(c: Column, least: int = 2, most: int = 30) -> Column:
    """Which of KEY_FAULTS keeps a name from being a key, null if none: letters, digits, _ and @ are allowed."""
    n = F.char_length(c)
    return F.when(n < least, KEY_FAULTS[0]).when(n > most, KEY_FAULTS[1]).when(c.rlike("[^A-Za-z0-9_@]"), KEY_FAULTS[2])


#: Layouts of dates in sequence records, tried in this order (fixed values).
DATE_LAYOUTS = ("dd-MMM-yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd", "MM/dd/yy")


def record_date(c: Column) -> Column:
    """A date in one of the usual layouts as DD-MMM-YYYY; null if none fits."""
    shaped = F.initcap(F.trim(c))
    found = F.coalesce(*[F.try_to_timestamp(shaped, F.lit(layout)) for layout in DATE_LAYOUTS])
    return F.upper(F.date_format(found, "dd-MMM-yyyy"))


def dated_line(log: Column, line: Column, at: Column) -> Column:
    """log with a line put before it that starts with the date."""
    return F.concat_ws("\n", F.concat_ws(" ", F.date_format(at, "EEE MMM dd HH:mm:ss yyyy"), line), log)
