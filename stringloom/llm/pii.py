"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only. Places come from the text between the matches: splitting by a pattern gives the
pieces before, between and after its matches, and running sums of lengths give start and end in code points.
Repeated groups are possessive, so that Java matches them in a loop and not by recursion, however long a text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import text_of

#: Lookbehinds keep a search from starting again at every character of a long run; where a match ends
#: inside a run, \G lets the next one start there. They and the possessive repeats don't change what is found.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A chain of digits with single blanks or hyphens between them, whole, of 16 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Lengths of international bank account numbers by country (fixed values).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Two letters, two digits, then as many letters and digits as the country has, in fours that a blank may part.
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(
    "(?:" + countries.replace(" ", "|") + r")[0-9]{2}(?:\x20?[A-Z0-9]{4}){" + str((n - 4) // 4) + "}" + (r"\x20?[A-Z0-9]{" + str((n - 4) % 4) + "}" if n % 4 else "")
    for n, countries in IBAN_LENGTHS.items()
) + ")(?![A-Za-z0-9])"
#: A hexadecimal key or token. It has no checksum, so a context word has to confirm it.
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: What a match needs before any pattern is tried on a text.
HINTS = {"email": "@", "ip": "[0-9][.][0-9]", "phone": "[+][0-9]", "card": "[0-9]", "iban": "[A-Z][A-Z][0-9]", "secret": "[0-9A-Fa-f]{32}"}
#: Words that make a match of their kind likelier (fixed values), and how far before it they may stand.
CONTEXT = {
    "email": "(?i)mail|contact|write|address", "ip": "(?i)\\bip\\b|host|server|address",
    "card": "(?i)card|visa|credit|payment", "phone": "(?i)phone|call|tel|mobile|fax",
    "iban": "(?i)iban|bank|account", "secret": "(?i)token|secret|passw|api.?key|access.?key|credential",
}
CONTEXT_CHARS = 40
BASE_SCORE, CONTEXT_SCORE = 0.75, 0.25
#: Lengths that one step of the running sums adds up by itself, so that appending copies little.
BLOCK = 256


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _mod97(c: Column) -> Column:
    """The remainder of an IBAN's number: first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda ch: F.when(ch.between("0", "9"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    return F.aggregate(turned, F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise((acc * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97))


#: Kind, pattern and the check that a match (its text, and whether a context word is near) has to pass, in the order in which spans are listed.
KINDS = (
    ("email", EMAIL, lambda m, near: F.lit(True)),
    ("ip", IP, lambda m, near: m.rlike("^" + r"\.".join([OCTET] * 4) + "$")),
    ("card", CARD, lambda m, near: F.call_function("luhn_check", _digits(m))),
    ("phone", PHONE, lambda m, near: F.length(_digits(m)).between(8, 15)),
    ("iban", IBAN, lambda m, near: _mod97(m) == 1),
    ("secret", SECRET, lambda m, near: near),
)
#: The kinds of the contract; the others are the method's own.
BASE = ("email", "ip", "card", "phone")
_SPANS = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, block: int = BLOCK) -> Column:
    """The sums of the first 0, 1, 2, ... of an array of whole numbers that isn't empty.

    Blocks are summed by themselves and then moved by the sums of the blocks before, so the work grows with
    n * (block + n / block**2) and not with the square of n.
    """
    grow = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    zero = F.array(F.lit(0))
    starts = F.sequence(F.lit(0), F.call_function("div", F.size(values) - 1, F.lit(block)).cast("int"))
    parts = F.transform(starts, lambda b: F.aggregate(F.slice(values, b * block + 1, F.lit(block)), zero, grow))
    moved = lambda p: F.zip_with(p, F.aggregate(F.transform(p, lambda s: F.element_at(s, -1)), zero, grow), lambda s, o: F.transform(F.slice(s, F.lit(2), F.size(s) - 1), lambda x: x + o))
    return _let(parts, lambda p: F.concat(zero, F.flatten(F.filter(moved(p), lambda s: s.isNotNull()))))


def _proposed(text: Column, kind: str, pattern: str, valid) -> Column:
    """array<struct<kind, start, end, value, score>> of the kind's confirmed matches, in order."""
    # texts that can't hold a match are not searched
    searched = F.when(text.rlike(HINTS[kind]), text).otherwise(F.lit(""))
    found = F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))
    pieces = F.split(searched, pattern, -1)
    before = F.concat(F.array(F.lit("")), found)  # the match before each piece
    cells = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("value"), F.slice(before, 1, F.size(found)).alias("last"))

    def placed(cells: Column) -> Column:
        ends = running_sums(F.transform(cells, lambda c: F.char_length(c["piece"]) + F.char_length(c["value"])))
        return F.zip_with(cells, F.slice(ends, F.lit(2), F.size(cells)), span)

    def span(cell: Column, end: Column) -> Column:
        near = F.right(F.concat(cell["last"], cell["piece"]), F.lit(CONTEXT_CHARS)).rlike(CONTEXT[kind])
        score = F.lit(BASE_SCORE) + F.when(near, F.lit(CONTEXT_SCORE)).otherwise(F.lit(0.0))
        return F.struct(F.lit(kind).alias("kind"), (end - F.char_length(cell["value"])).alias("start"), end.alias("end"), cell["value"].alias("value"), score.alias("score"))

    spans = F.filter(_let(cells, placed), lambda s: valid(s["value"], s["score"] > BASE_SCORE))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPANS))


def spans(text: Column) -> Column:
    """All confirmed spans of a text (null: empty) by kind as listed in KINDS, then start; ends are exclusive, in code points.

    A span's score is BASE_SCORE, and CONTEXT_SCORE more if one of its kind's context words stands in the
    CONTEXT_CHARS characters before it, back to the start of the match before it. Spans of different kinds may overlap.
    """
    return F.concat(*[_proposed(text, *k) for k in KINDS])


def with_spans(docs: DataFrame, name: str = "spans") -> DataFrame:
    """docs with an array of spans; a null or empty text has none. Repeated rows, their order and other columns stay as they are.

    A column called `name` is replaced. Texts of any length are searched whole, in a number of steps that grows
    about with the length; an empty table gives no rows.
    """
    return docs.withColumn(name, spans(text_of()))


def redacted(docs: DataFrame, name: str = "redacted") -> DataFrame:
    """docs with the text in which every span is replaced by its kind in angle brackets; of overlapping spans the first counts."""
    text = text_of()
    order = F.array_sort(F.transform(F.col("_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), piece.alias("out"))).otherwise(acc)

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.char_length(F.col("_text")))))
    return docs.withColumn("_text", text).withColumn("_spans", spans(text)).withColumn(name, done).drop("_text", "_spans")


def scores(spans_column: Column) -> Column:
    """The spans' scores in their order, comma-joined, and the highest of them (0 without spans)."""
    values = F.transform(spans_column, lambda s: s["score"])
    return F.struct(F.array_join(F.transform(values, lambda v: F.format_number(v, 2)), ",").alias("listed"), F.coalesce(F.array_max(values), F.lit(0.0)).alias("highest"))


def listed(spans_column: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
