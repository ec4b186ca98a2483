"""Sequence record files as tables: Spark's text reader cuts the records, column expressions take the fields.

Records are cut by the reader's line separator, so large files are split among tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.functions import streams as s
from stringloom.functions.predicates import wildcard
from stringloom.functions.text import format_sequence, gcg_checksum
from stringloom.operators.merging import upserted
from stringloom.operators.storage import before


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, full_name and data of each record. The name is the first word of the title, white space in data goes."""
    rows = spark.read.option("lineSep", "\n>").text(path).filter(F.length(F.trim("value")) > 0)
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")
    title = F.regexp_extract(text, "^([^\\n]*)", 1)
    data = F.regexp_replace(F.regexp_extract(text, "(?s)^[^\\n]*\\n(.*)$", 1), "\\s+", "")
    return rows.select(F.regexp_extract(title, "^(\\S+)", 1).alias("name"), F.trim(F.regexp_extract(title, "^\\S+\\s+(.*)$", 1)).alias("full_name"), data.alias("data"))


def read_entries(spark: SparkSession, path: str, key_width: int, separator: str = "\n//", until: str | None = None) -> DataFrame:
    """Records whose lines start with a key in the first key_width characters: record and lines, array<struct<key, value>>.

    record is the whole text; the line that starts with `until`, and what follows it, has no keys. A record ends with a
    line that starts with //; line ends may be LF or CR LF.
    """
    rows = spark.read.option("lineSep", separator).text(path)
    # what is left of the line that ended the record before, its line end at least
    text = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^[ \t]*\n", "")
    return rows.filter(F.col("value").rlike("\\S")).select(text.alias("record"), keyed_lines(F.regexp_replace(text, f"(?s)\n{until}.*$", "") if until else text, key_width).alias("lines"))


def keyed_lines(text: Column, key_width: int) -> Column:
    """Lines as (key, value); a line without a key, or with that of the line before it, goes on with that one's value."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    before = F.concat(F.array(F.lit("").cast("string")), F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))))
    key = lambda x: F.trim(F.left(x, F.lit(key_width)))

    def marked(x: Column, y: Column) -> Column:
        value = F.trim(F.substring(x, F.lit(key_width + 1), F.char_length(x)))
        return F.when((key(x) == "") | (key(x) == key(y)), F.concat(F.lit("\u0001"), value)).otherwise(F.concat(F.lit("\u0002"), key(x), F.lit("\u0003"), value))

    blocks = F.filter(F.split(F.array_join(F.zip_with(lines, before, marked), ""), "\u0002"), lambda x: F.contains(x, F.lit("\u0003")))
    return F.transform(blocks, lambda x: F.struct(F.substring_index(x, "\u0003", 1).alias("key"), F.replace(F.substring_index(x, "\u0003", -1), F.lit("\u0001"), F.lit(" ")).alias("value")))


@dataclass(frozen=True)
class Rule:
    """What an import does with lines whose key matches: commands on their text, then written to, or appended to, a field.

    tag: put before the text in brackets. kind: the field's type.
    """

    match: str
    field: str
    commands: tuple = ()
    append: bool = False
    tag: str | None = None
    kind: str = "string"


def _texts(rule: Rule) -> Column:
    """What a rule makes of its lines, in order, without empty texts."""
    hits = F.filter("lines", lambda x: wildcard(x["key"], rule.match))
    return F.filter(F.transform(hits, lambda x: F.trim(s.apply(x["value"], *rule.commands))), lambda x: x != "")


def imported(entries: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """One column for each field of the rules. Blanks and tabs around values go, and an empty value is not written.

    Written fields take their last value; appended ones all values, joined by blanks, of which a tag is put once.
    """
    fields: dict[str, Column] = {}
    for rule in rules:
        texts = _texts(rule)
        if rule.append:
            value = F.array_join(texts, " ")
            value = F.when(F.size(texts) > 0, F.concat(F.lit(f"[{rule.tag}] "), value) if rule.tag else value)
        else:
            value = F.get(texts, F.size(texts) - 1)
            value = F.concat(F.lit(f"[{rule.tag}] "), value) if rule.tag else value
        before = fields.get(rule.field)
        if before is not None:
            joined = F.concat_ws(" ", before, value)
            value = F.when(joined != "", joined) if rule.append else F.coalesce(value, before)
        fields[rule.field] = value
    kinds = {r.field: r.kind for r in rules}
    return entries.select(*keep, *[(c if kinds[n] == "string" else c.try_cast(kinds[n])).alias(n) for n, c in fields.items()])


#: Rules for the two usual flat-file formats (keys are fixed values).
EMBL = [Rule("ID", "name", (s.matched("^[^; ]+"),)), Rule("AC", "acc", (s.matched("^[^; ]+"),)), Rule("DE", "full_name"), Rule("OC", "tax"), Rule("RA", "author", (s.remove(";"),), append=True), Rule("KW", "keywords")]
GENBANK = [Rule("LOCUS", "name", (s.matched("^[^; ]+"),)), Rule("ACCESSION", "acc", (s.matched("^[^; ]+"),)), Rule("DEFINITION", "full_name"), Rule("ORGANISM", "tax"), Rule("AUTHORS", "author", append=True), Rule("KEYWORDS", "keywords")]


SWISSPROT = [Rule("ID", "name", (s.matched("^[^; ]+"),)), Rule("AC", "acc", (s.matched("^[^; ]+"),)), Rule("DE", "full_name"), Rule("GN", "gene"), Rule("OS", "organism"), Rule("OC", "tax"), Rule("RA", "author", (s.remove(";"),), append=True), Rule("KW", "keywords")]


def sequence_of(record: Column, start: str) -> Column:
    """What follows the line that starts with the given word, without numbers and white space."""
    return F.regexp_replace(F.regexp_extract(record, f"(?s)(?:^|\\n){start}[^\\n]*\\n(.*)$", 1), "[\\s0-9/]+", "")


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    entries = read_entries(spark, path, 5, until="SQ")
    return imported(entries.withColumn("data", sequence_of(F.col("record"), "SQ")), EMBL, "data")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    entries = read_entries(spark, path, 12, until="ORIGIN")
    return imported(entries.withColumn("data", sequence_of(F.col("record"), "ORIGIN")), GENBANK, "data")


def read_swissprot(spark: SparkSession, path: str) -> DataFrame:
    entries = read_entries(spark, path, 5, until="SQ")
    return imported(entries.withColumn("data", sequence_of(F.col("record"), "SQ")), SWISSPROT, "data")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value without carriage returns, and _at, which grows along each file: its path, the start of the range and the line in it."""
    rows = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), "_metadata.file_path", "_metadata.file_block_start")
    return rows.select("value", F.struct("file_path", "file_block_start", F.monotonically_increasing_id().alias("line")).alias("_at"))


def _joined_by_name(rows: DataFrame, name: str, value: str, separator: str = "") -> DataFrame:
    """file, name and the values of its rows there in the order of _at, joined. Equal names of several files are items of their own."""
    ordered = F.array_sort(F.collect_list(F.struct("_at", value)))
    return rows.groupBy(F.col("_at.file_path").alias("file"), name).agg(F.array_join(F.transform(ordered, lambda x: x[value]), separator).alias(value))


def read_macke(spark: SparkSession, path: str) -> DataFrame:
    """file, name, fields (map of key to its values joined by blanks) and data of Macke files.

    Lines `#:name:key:value` give fields, lines of a name, a position and bases give data; all other lines that start with # are comments.
    """
    lines = _numbered_lines(spark, path)
    part = lambda k: F.regexp_extract("value", "^#:([^:]*):([^:]*):(.*)$", k)
    fields = lines.filter(F.col("value").startswith("#:")).select("_at", F.col("_at.file_path").alias("file"), part(1).alias("name"), part(2).alias("key"), F.trim(part(3)).alias("value"))
    each = fields.groupBy("file", "name", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), " ").alias("value"))
    mapped = each.groupBy("file", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))
    cells = F.split(F.trim("value"), "\\s+", 3)
    data = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("_at", F.get(cells, F.lit(0)).alias("name"), F.regexp_replace(F.get(cells, F.lit(2)), "\\s+", "").alias("data"))
    return mapped.join(_joined_by_name(data, "name", "data"), ["file", "name"], "full_outer")


def read_phylip(spark: SparkSession, path: str, width: int = 10) -> DataFrame:
    """file, name and data of PHYLIP files whose lines each start with a name of `width` characters; the line of counts goes."""
    lines = _numbered_lines(spark, path).filter(F.trim("value") != "").filter(~F.col("value").rlike("^\\s*[0-9]+\\s+[0-9]+\\s*$"))
    rows = lines.select("_at", F.trim(F.left("value", F.lit(width))).alias("name"), F.regexp_replace(F.substring("value", width + 1, 1 << 30), "\\s+", "").alias("data"))
    return _joined_by_name(rows, "name", "data")


def read_nexus(spark: SparkSession, path: str) -> DataFrame:
    """file, name and data of the matrix of NEXUS files: lines of a quoted or plain name and bases, up to the semicolon.

    Only lines between a line `matrix` and the next one that holds a semicolon count, so other blocks and commands
    are no sequences; which lines those are is a scan over the files' byte ranges. Comments in brackets go, each in one line.
    """
    rows = _numbered_lines(spark, path).select(F.col("_at.file_path").alias("file"), F.col("_at.file_block_start").alias("block"), F.col("_at.line").alias("line"), F.trim(F.regexp_replace("value", "\\[[^\\]]*\\]", "")).alias("value"))
    # the newest line that opened or closed a matrix, as a growing number that is odd for one that opened it
    opens, closes = F.lower("value").rlike("^matrix\\b"), F.contains("value", F.lit(";"))
    turn = F.when(opens & ~closes, F.struct("block", F.col("line").alias("at"), F.lit(1).alias("open"))).when(closes, F.struct("block", F.col("line").alias("at"), F.lit(0).alias("open")))
    inside = before(rows, "_turn", turn, F.max, "file").filter("_turn.open = 1").filter(~opens)
    cells = F.regexp_replace("value", ";.*$", "")
    quoted, plain = "^'((?:[^']|'')*+)'\\s+(.+)$", "^([^'\\s]+)\\s+(.+)$"
    is_quoted = cells.rlike(quoted)
    pick = lambda k: F.when(is_quoted, F.replace(F.regexp_extract(cells, quoted, k), F.lit("''"), F.lit("'"))).otherwise(F.regexp_extract(cells, plain, k))
    lines = inside.filter(is_quoted | cells.rlike(plain)).select(F.struct(F.col("file").alias("file_path"), F.col("block"), "line").alias("_at"), pick(1).alias("name"), F.regexp_replace(pick(2), "\\s+", "").alias("data"))
    return _joined_by_name(lines, "name", "data")


def features(record: Column) -> Column:
    """array<struct<kind, location, qualifiers>> of a record's feature table."""
    short = F.transform(F.regexp_extract_all(record, F.lit("(?m)^FT(.*)$"), F.lit(1)), lambda x: F.concat(F.lit("  "), x))
    table = F.when(F.size(short) > 0, F.array_join(short, "\n")).otherwise(F.regexp_extract(record, r"(?s)(?:^|\n)FEATURES[^\n]*\n(.*?)(?:\n(?:ORIGIN|BASE)|$)", 1))
    blocks = F.filter(F.split(table, r"\n(?= {5}\S)"), lambda x: F.trim(x) != "")

    def one(x: Column) -> Column:
        location = F.regexp_replace(F.regexp_extract(x, r"(?s)^\s*\S+\s+([^/]*)", 1), "\\s+", "")
        qualifiers = F.regexp_extract_all(x, F.lit(r"/(\w+=\"[^\"]*\"|\w+=\S+|\w+)"), F.lit(1))
        return F.struct(F.regexp_extract(x, r"^\s*(\S+)", 1).alias("kind"), location.alias("location"), F.transform(qualifiers, lambda q: F.regexp_replace(F.replace(q, F.lit('"'), F.lit("")), "\\s+", " ")).alias("qualifiers"))

    return F.transform(blocks, one)


def detected(head: Column, formats: dict[str, str]) -> Column:
    """The first format whose wildcard matches the beginning of a file; null if none does."""
    found = F.when(F.lit(False), F.lit(""))
    for name, pattern in formats.items():
        found = found.when(wildcard(head, pattern), name)
    return found


def import_sheet(items: DataFrame, sheet: DataFrame, key: str) -> DataFrame:
    """items with the other columns of a sheet of the same key; the sheet's values win where it has one."""
    new = [c for c in sheet.columns if c not in items.columns]
    wide = items.select("*", *[F.lit(None).cast(dict(sheet.dtypes)[c]).alias(c) for c in new])
    return upserted(wide, sheet.join(items.select(key), key, "left_semi"), key)


# writers: one column of text for each item, written by Spark's text writer


def fasta(name: Column, title: Column, data: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), F.concat_ws(" ", name, title), F.lit("\n"), format_sequence(data, width, 0, 0, 0))


def embl(fields: dict[str, Column], data: Column) -> Column:
    """A record of two-letter keys with the sequence in blocks of ten."""
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{key:<5}"), c)) for key, c in fields.items()]
    size = F.concat(F.lit("SQ   Sequence "), F.char_length(data).cast("string"), F.lit(" BP;"))
    return F.concat_ws("\n", *lines, size, format_sequence(data, 60, 5, 5, 10, number_right=9), F.lit("//"))


def genbank(fields: dict[str, Column], data: Column) -> Column:
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{key:<12}"), c)) for key, c in fields.items()]
    return F.concat_ws("\n", *lines, F.lit("ORIGIN"), format_sequence(F.lower(data), 60, 10, 10, 10, number_left=True), F.lit("//"))


def phylip(items: DataFrame, name: str, data: str, width: int = 10) -> DataFrame:
    """value: the lines of a sequential PHYLIP file in order of names, with the counts on the first one."""
    counts = items.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.char_length(data)).cast("string")).alias("value")).select(F.lit(0).alias("_at"), F.lit("").alias("_name"), "value")
    lines = items.select(F.lit(1).alias("_at"), F.col(name).alias("_name"), F.concat(F.rpad(F.col(name), width, " "), F.col(data)).alias("value"))
    return counts.unionByName(lines).orderBy("_at", "_name").select("value")


def gcg(name: Column, data: Column) -> Column:
    """One sequence with its length and check number."""
    head = F.concat(name, F.lit("  Length: "), F.char_length(data).cast("string"), F.lit("  Check: "), gcg_checksum(data).cast("string"), F.lit("  .."))
    return F.concat(head, F.lit("\n\n"), format_sequence(data, 50, 10, 10, 10, number_left=True))


def pir(name: Column, title: Column, data: Column) -> Column:
    return F.concat(F.lit(">P1;"), name, F.lit("\n"), title, F.lit("\n"), format_sequence(data, 60, 0, 0, 0), F.lit("*"))


def nexus(items: DataFrame, name: str, data: str, kind: str = "DNA") -> DataFrame:
    """value: the lines of a NEXUS data block in order of names; numbered parts keep the order, no task sees all lines."""
    line = lambda at, value: items.sparkSession.range(1).select(F.lit(at).alias("_at"), F.lit("").alias("_name"), F.lit(value).alias("value"))
    size = items.agg(F.concat(F.lit("dimensions ntax="), F.count(F.lit(1)).cast("string"), F.lit(" nchar="), F.coalesce(F.max(F.char_length(data)), F.lit(0)).cast("string"), F.lit(";")).alias("value"))
    size = size.select(F.lit(1).alias("_at"), F.lit("").alias("_name"), "value")
    rows = items.select(F.lit(3).alias("_at"), F.col(name).alias("_name"), F.concat_ws(" ", F.concat(F.lit("'"), F.replace(F.col(name), F.lit("'"), F.lit("''")), F.lit("'")), data).alias("value"))
    parts = [line(0, "#NEXUS\nbegin data;"), size, line(2, f"format datatype={kind} gap=- missing=.;\nmatrix"), rows, line(4, ";\nend;")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.orderBy("_at", "_name").select("value")


def macke(name: Column, fields: dict[str, Column], data: Column, width: int = 50) -> Column:
    """The lines of an item in a Macke file: its fields that aren't empty, then its data in pieces behind their first position."""
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit("#:"), name, F.lit(f":{key}:"), c)) for key, c in fields.items()]
    pieces = F.regexp_extract_all(data, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    placed = F.transform(pieces, lambda p, i: F.concat_ws(" ", name, (i * width).cast("string"), p))
    return F.concat_ws("\n", *lines, F.array_join(placed, "\n"))


def swissprot(fields: dict[str, Column], data: Column) -> Column:
    """A protein record: as EMBL, with the length in amino acids."""
    lines = [F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{key:<5}"), c)) for key, c in fields.items()]
    size = F.concat(F.lit("SQ   SEQUENCE   "), F.char_length(data).cast("string"), F.lit(" AA;"))
    return F.concat_ws("\n", *lines, size, format_sequence(data, 60, 5, 5, 10), F.lit("//"))


#: Marks of an export template: $(field) is a field's text, $(field|default) has a default for a missing one.
_MARK = re.compile(r"\$\(([A-Za-z0-9_]+)(?:\|([^)]*))?\)")


def exported(template: str, fields: dict[str, Column], programs: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """The text of an item after a template; a field's program works on its text. A name that is no field is an error."""
    parts, at = [], 0
    for m in _MARK.finditer(template):
        if m[1] not in fields:
            raise ValueError(f"the template asks for {m[1]}, which is no field")
        text = F.coalesce(fields[m[1]].cast("string"), F.lit(""))
        if programs and m[1] in programs:
            text = programs[m[1]](text)
        parts += [F.lit(template[at : m.start()]), F.when(text == "", F.lit(m[2] or "")).otherwise(text)]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def write_text(df: DataFrame, value: Column, path: str, **options) -> None:
    df.select(value.alias("value")).write.options(**options).text(path)
