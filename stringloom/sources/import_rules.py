"""Import rules as text: a rule file becomes columns that carry variables through the lines of each record.

A rule file has one keyword a line, with an argument in quotes: AUTODETECT, BEGIN, KEYWIDTH, FILETAG, AUTOTAG,
IFNOTSET, SETGLOBAL, INCLUDE, then MATCH blocks (SRT, ACI, TAG, WRITE, WRITE_INT, WRITE_FLOAT, APPEND, SETVAR), then
SEQUENCESTART, SEQUENCECOLUMN, SEQUENCESRT, SEQUENCEACI, SEQUENCEEND, CREATE_ACC_FROM_SEQUENCE and END. Commands of
ACI are no text here: the argument is a name, and the caller gives the commands for it.

Records are cut by Spark's text reader, and each is one expression: a fold over its lines whose state is the
fields and variables so far, so what a line sets is there for the lines behind it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.functions import streams as s
from stringloom.functions.predicates import wildcard
from stringloom.functions.text import checksum, replace_rules

#: What joins the lines of one key.
JOINT = "|"


@dataclass(frozen=True)
class Match:
    """What happens to a line that the pattern matches, in this order."""

    pattern: str
    srt: str | None = None
    program: str | None = None
    tag: str | None = None
    write: str | None = None
    kind: str = "string"
    append: bool = False
    setvar: str | None = None


@dataclass(frozen=True)
class Format:
    """A parsed rule file."""

    matches: tuple[Match, ...] = ()
    detect: str | None = None
    begin: str = "*"
    key_width: int = 0
    file_tag: str | None = None
    reasons: dict[str, str] = field(default_factory=dict)
    values: dict[str, str] = field(default_factory=dict)
    start: str | None = None
    column: int = 0
    sequence_srt: str | None = None
    sequence_program: str | None = None
    end: str = "//"
    accession: bool = False


_BLOCK = {"SRT": "srt", "ACI": "program", "TAG": "tag", "SETVAR": "setvar"}
_WRITES = {"WRITE": ("string", False), "WRITE_INT": ("int", False), "WRITE_FLOAT": ("float", False), "APPEND": ("string", True)}
_PLAIN = {"AUTODETECT": "detect", "BEGIN": "begin", "FILETAG": "file_tag", "SEQUENCESTART": "start", "SEQUENCESRT": "sequence_srt", "SEQUENCEACI": "sequence_program", "SEQUENCEEND": "end"}


def parsed_rules(text: str, includes: dict[str, str] | None = None) -> Format:
    """A rule text as a Format; INCLUDE takes its text from `includes`. What can't be understood is an error that names the line."""
    found, matches, block, auto = {}, [], None, None
    reasons: dict[str, str] = {}
    values: dict[str, str] = {}
    lines = [(str(n), line) for n, line in enumerate(text.splitlines(), 1)]

    def closed() -> None:
        if block is not None:
            matches.append(Match(**{"tag": auto, **block}))

    while lines:
        number, line = lines.pop(0)
        m = re.fullmatch(r"\s*([A-Z_]+)(?:\s+(.*?))?\s*", line)
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if not m:
            raise ValueError(f"line {number}: {line.strip()!r} has no keyword")
        word, rest = m[1], m[2] or ""
        quoted = re.fullmatch(r'"(.*)"', rest)
        value = quoted[1] if quoted else rest
        if word == "MATCH":
            closed()
            block = {"pattern": value}
        elif word in _WRITES and block is not None and "write" not in block:
            block |= {"write": value, "kind": _WRITES[word][0], "append": _WRITES[word][1]}
        elif word in _BLOCK and block is not None and _BLOCK[word] not in block:
            block[_BLOCK[word]] = value
        elif word in _PLAIN and word != "FILETAG":
            found[_PLAIN[word]] = value.replace("\\n", "\n") if word == "AUTODETECT" else value
        elif word == "FILETAG":
            found["file_tag"] = value
        elif word in ("KEYWIDTH", "SEQUENCECOLUMN") and value.isdigit():
            found["key_width" if word == "KEYWIDTH" else "column"] = int(value)
        elif word == "AUTOTAG":
            closed()
            block, auto = None, value or None
        elif word in ("IFNOTSET", "SETGLOBAL") and (v := re.fullmatch(r'([a-z])\s+"(.*)"', rest)):
            (reasons if word == "IFNOTSET" else values)[v[1]] = v[2]
        elif word == "INCLUDE" and value in (includes or {}):
            lines[:0] = [(f"{number} ({value} {n})", x) for n, x in enumerate(includes[value].splitlines(), 1)]
        elif word == "CREATE_ACC_FROM_SEQUENCE":
            found["accession"] = True
        elif word == "DONT_GEN_NAMES":
            pass
        elif word == "END":
            break
        else:
            raise ValueError(f"line {number}: {word} isn't allowed here or has a wrong argument {rest!r}")
    closed()
    return Format(matches=tuple(matches), reasons=reasons, values=values, **found)


def records_of(spark: SparkSession, path: str, form: Format) -> DataFrame:
    """file, place and lines of each record: from a line that BEGIN matches to the line of SEQUENCEEND, which splits files.

    An end pattern with * at its end is the first line of the next record, any other one a line of its own. Lines
    before the first that BEGIN matches go, and records without one. Line ends may be LF or CR LF.
    """
    start_of_next = form.end.endswith("*")
    mark = form.end.rstrip("*")
    if not mark or re.search(r"[*?]", mark):
        raise ValueError("SEQUENCEEND has to be a text, with * at its end at most")
    rows = spark.read.option("lineSep", "\n" + mark).text(path)
    text = F.regexp_replace("value", "\r", "")
    # the first record of a file still has its mark, since no line end stands before it
    text = F.when(F.lit(start_of_next) & ~text.startswith(mark), F.concat(F.lit(mark), text)).otherwise(text)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    flags = F.transform(lines, lambda x: wildcard(x, form.begin, ignore_case=False))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place"), lines.alias("_lines"), flags.alias("_flags"))
    kept = F.slice(F.col("_lines"), F.array_position(F.col("_flags"), True).cast("int"), F.size("_lines"))
    return rows.filter(F.array_contains("_flags", True)).select("file", "place", kept.alias("lines"))


def _split(lines: Column, form: Format) -> tuple[Column, Column]:
    """The lines of the head and those of the sequence; the line that SEQUENCESTART matches belongs to both."""
    if form.start is None:
        return lines, F.array().cast("array<string>")
    at = F.array_position(F.transform(lines, lambda x: wildcard(x, form.start, ignore_case=False)), True).cast("int")
    return F.when(at > 0, F.slice(lines, F.lit(1), at)).otherwise(lines), F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))


def joined_lines(lines: Column, width: int) -> Column:
    """Lines that start with `width` blanks put behind the line before them, without blanks in front, after a |."""
    if not width:
        return lines
    goes_on = lambda x: x.startswith(" " * width)
    marked = F.transform(lines, lambda x, i: F.when((i > 0) & goes_on(x), F.concat(F.lit(JOINT), F.ltrim(x))).otherwise(F.concat(F.lit("\n"), x)))
    return F.filter(F.split(F.array_join(marked, ""), "\n"), lambda x: x != "")


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rule_pairs(srt: str) -> list[tuple[str, str]]:
    """`a=b:c=d` as pairs; a backslash keeps the character behind it."""
    return [tuple(re.sub(r"\\([=:])", r"\1", part) for part in re.split(r"(?<!\\)=", rule, maxsplit=1)) for rule in re.split(r"(?<!\\):", srt) if rule]


class _Names:
    """Where fields and variables are in the state."""

    def __init__(self, form: Format):
        self.variables = sorted({m.setvar for m in form.matches if m.setvar} | set(form.values) | set(form.reasons))
        self.fields = list(dict.fromkeys(m.write for m in form.matches if m.write))
        self.kinds = {f: [m.kind for m in form.matches if m.write == f][-1] for f in self.fields}

    def empty(self, form: Format) -> Column:
        text = lambda v: F.lit(v).cast("string")
        return F.struct(*[text(form.values.get(v)).alias(f"v_{v}") for v in self.variables], *[text(None).alias(f"f_{k}") for k, _ in enumerate(self.fields)])


def _expanded(text: str, state: Column, names: _Names, form: Format) -> tuple[str, list[tuple[str, Column]]]:
    """A text with a private letter for each variable in it, and what each letter stands for. An unset variable is the error of its reason."""
    found: list[tuple[str, Column]] = []

    def one(m: re.Match) -> str:
        if m[1] == "$":
            return "$"
        if m[1] not in names.variables:
            raise ValueError(f"the variable {m[1]} is never set")
        value = state[f"v_{m[1]}"]
        reason = form.reasons.get(m[1], f"the variable {m[1]} is not set")
        letter = chr(0xE000 + len(found))
        found.append((letter, F.coalesce(value, F.raise_error(F.lit(reason)).cast("string"))))
        return letter

    return re.sub(r"\$(.)", one, text), found


def _filled(c: Column, letters: list[tuple[str, Column]]) -> Column:
    for letter, value in letters:
        c = F.replace(c, F.lit(letter), value)
    return c


def _applied(rule: Match, line: Column, state: Column, names: _Names, form: Format, programs: dict[str, tuple]) -> Column:
    """The state behind a line that the rule matches."""
    text = line
    if rule.srt is not None:
        srt, letters = _expanded(rule.srt, state, names, form)
        pairs = _rule_pairs(srt)
        if any(letter in pair[0] for letter, _ in letters for pair in pairs):
            raise ValueError("a variable may stand in what SRT puts in, not in what it searches for")
        text = _filled(replace_rules(text, *[(p[0], p[1] if len(p) > 1 else "") for p in pairs]), letters)
    if rule.program is not None:
        if rule.program not in programs:
            raise ValueError(f"no commands are given for the program {rule.program!r}")
        text = s.apply(text, *programs[rule.program])

    def put(value: Column) -> Column:
        out = state
        if rule.write is not None:
            at = f"f_{names.fields.index(rule.write)}"
            bare = F.regexp_replace(value, r"^[ \t|]+|[ \t|\r]+$", "")
            old = state[at]
            if rule.kind == "int":
                new = F.coalesce(F.regexp_extract(bare, r"^[+-]?\d+", 0).try_cast("long"), F.lit(0)).cast("string")
            elif rule.kind == "float":
                new = F.coalesce(F.regexp_extract(bare, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double"), F.lit(0.0)).cast("string")
            else:
                if rule.tag is not None:
                    tag, letters = _expanded(rule.tag, state, names, form)
                    shown = F.concat(_filled(F.lit(f"[{tag}] "), letters), bare)
                    tagged = F.contains(F.lower(old), F.lower(_filled(F.lit(f"[{tag}]"), letters)))
                else:
                    shown, tagged = bare, F.lit(True)
                new = F.when(old.isNull(), shown).otherwise(F.concat(old, F.lit(" "), F.when(tagged, bare).otherwise(shown))) if rule.append else shown
            out = out.withField(at, F.when(bare == "", old).otherwise(new))
        if rule.setvar is not None:
            out = out.withField(f"v_{rule.setvar}", value)
        return out

    return _let(text, put)


def imported_by(records: DataFrame, form: Format, programs: dict[str, tuple] | None = None, *keep: str) -> DataFrame:
    """One row a record: a column for each field that the rules write, and data, the sequence.

    Rules work on each line in their order, one line after the other. WRITE replaces a field, APPEND puts text behind
    it after a blank, a tag goes in front unless an appended field has it; empty text is not written. A variable is the text that the last SETVAR left; using
    it unset is an error with the reason of IFNOTSET. Sequence lines are cut before SEQUENCECOLUMN.
    """
    names, programs = _Names(form), programs or {}
    head, tail = _split(F.col("lines"), form)

    def step(state: Column, line: Column) -> Column:
        for rule in form.matches:
            state = _let(state, _after(rule, line))
        return state

    def _after(rule: Match, line: Column):
        return lambda now: F.when(wildcard(line, rule.pattern, ignore_case=False), _applied(rule, line, now, names, form, programs)).otherwise(now)

    data = F.array_join(F.transform(F.col("_tail"), lambda x: F.substring(x, F.lit(form.column + 1), F.char_length(x))), "\n")
    if form.sequence_srt is not None:
        data = replace_rules(data, *[(p[0], p[1] if len(p) > 1 else "") for p in _rule_pairs(form.sequence_srt)])
    if form.sequence_program is not None:
        data = s.apply(data, *programs[form.sequence_program])
    rows = records.select(*keep, joined_lines(head, form.key_width).alias("_head"), tail.alias("_tail"))
    rows = rows.select(*keep, F.aggregate("_head", names.empty(form), step).alias("_state"), F.regexp_replace(data, r"\s+", "").alias("data"))
    kinds = {"string": "string", "int": "long", "float": "double"}
    fields = {f: F.col("_state")[f"f_{k}"].cast(kinds[names.kinds[f]]) for k, f in enumerate(names.fields)}
    if form.accession:
        made = F.concat(F.lit("ACC_"), checksum(F.col("data"), upper=True))
        fields["acc"] = F.coalesce(fields["acc"], made) if "acc" in fields else made
    return rows.select(*keep, *[c.alias(f) for f, c in fields.items()], "data")


def with_file_tag(form: Format) -> Format:
    """The format with its FILETAG as the tag of every rule that writes text and has none."""
    if form.file_tag is None:
        return form
    return replace(form, matches=tuple(replace(m, tag=m.tag or form.file_tag) if m.write and m.kind == "string" and m.write not in ("name", "acc") else m for m in form.matches))


def detected_format(head: Column, forms: dict[str, Format]) -> Column:
    """The first format whose AUTODETECT matches the beginning of a file; null if none does."""
    found = F.when(F.lit(False), F.lit(""))
    for name, form in forms.items():
        if form.detect is not None:
            found = found.when(wildcard(head, form.detect, ignore_case=False), name)
    return found
