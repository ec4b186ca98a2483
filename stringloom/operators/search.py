"""Hit sets, duplicates, marks and field writes over items.

A hit set is a DataFrame of ids. Every operator is a join or an aggregation on the id or on a digest of the
value; long texts are never shuffled, and the joins are plain ones, so that adaptive execution can split a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stringloom.functions import text as t
from stringloom.functions.predicates import any_field
from stringloom.operators.storage import ranked


def generate(items: DataFrame, key: str, predicate: Column) -> DataFrame:
    """The ids of the items that match; null counts as no match."""
    return items.filter(F.coalesce(predicate, F.lit(False))).select(key).distinct()


def enlarge(hits: DataFrame, more: DataFrame) -> DataFrame:
    return hits.unionByName(more).distinct()


def reduce(hits: DataFrame, by: DataFrame) -> DataFrame:
    return hits.join(by.distinct(), hits.columns, "left_semi")


def without(hits: DataFrame, others: DataFrame) -> DataFrame:
    return hits.join(others.distinct(), hits.columns, "left_anti")


def of_parents(items: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The items whose parent is in the set."""
    return items.join(parents.select(key).distinct(), key, "left_semi")


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def duplicates(items: DataFrame, key: str, value: str) -> DataFrame:
    """key, state (unique, 1st or dup), first (smallest key of equal values) and copies, for items that have a value.

    key has to be unique. Keys are compared as they are, values by their SHA-256.
    """
    rows = items.filter(F.col(value).isNotNull()).select(key, _digest(F.col(value)).alias("_digest"))
    groups = rows.groupBy("_digest").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
    state = F.when(F.col("copies") == 1, "unique").when(F.col(key) == F.col("first"), "1st").otherwise("dup")
    return rows.join(groups, "_digest").select(key, state.alias("state"), "first", "copies")


def word_duplicates(items: DataFrame, key: str, value: str, separators: str = "[^\\p{L}\\p{N}]+") -> DataFrame:
    """Words that stand in more than one item: word, items, first (smallest key)."""
    words = items.select(key, F.explode(F.array_distinct(F.split(F.col(value), separators))).alias("word")).filter("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("items"), F.min(key).alias("first")).filter("items > 1")


def missing_last(name: str, descending: bool = False) -> Column:
    """A sort key that puts missing values last in both directions."""
    return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()


def marked(items: DataFrame, hits: DataFrame, key: str, name: str = "marked") -> DataFrame:
    """items with a flag that tells which are in the set."""
    flags = hits.select(key).distinct().withColumn(name, F.lit(True))
    return items.drop(name).join(flags, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def inverted(items: DataFrame, name: str = "marked") -> DataFrame:
    return items.withColumn(name, ~F.coalesce(F.col(name), F.lit(False)))


def mark_by_list(items: DataFrame, key: str, field: str, references: DataFrame, reference: str) -> DataFrame:
    """items marked if one of the words in field is in the list of references."""
    words = items.select(key, F.explode(F.split(F.col(field), "[\\s,;]+")).alias("_word"))
    hits = words.join(references.select(F.col(reference).alias("_word")).distinct(), "_word", "left_semi")
    return marked(items, hits, key)


def written(items: DataFrame, hits: DataFrame, key: str, field: str, value: Column, append: str | None = None) -> DataFrame:
    """field overwritten in all hits, or the value appended behind the given separator. A missing field is created."""
    if field not in items.columns:
        items = items.withColumn(field, F.lit(None).cast("string"))
    flagged = marked(items, hits, key, "_hit")
    new = value if append is None else F.concat_ws(append, F.col(field), value)
    return flagged.withColumn(field, F.when(F.col("_hit"), new).otherwise(F.col(field))).drop("_hit").select(*items.columns)


def lossless(c: Column, kind: str) -> Column:
    """c converted to another type where that keeps it as it is, else null."""
    converted = c.try_cast(kind)
    return F.when(converted.cast("string") == c.cast("string"), converted)


def first_field(items: DataFrame, fields: list[str], default) -> Column:
    """The first of the fields that is there, or the default."""
    return F.coalesce(*[F.col(f) for f in fields if f in items.columns], F.lit(default))


def field_scan(items: DataFrame) -> DataFrame:
    """field, type and how many items have it."""
    kinds = dict(items.dtypes)
    counted = items.agg(*[F.count(c).alias(c) for c in items.columns])
    stacked = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("type"), F.col(c).alias("items")) for c in items.columns])
    return counted.select(F.inline(stacked)).filter("items > 0")


def display(items: DataFrame, columns: list[tuple[str, Column, int]], style: str = "padded") -> Column:
    """One line an item of (name, value, width): padded with blanks, tab or csv (quoted only where the separator occurs)."""
    cells = []
    for _, value, width in columns:
        c = t.empty_if_null(value)
        if style == "padded":
            cells.append(t.pad_right(F.left(c, F.lit(width)), width))
        else:
            separator = "\t" if style == "tab" else ","
            cells.append(F.when(F.contains(c, F.lit(separator)), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    return F.concat_ws({"padded": " ", "tab": "\t", "csv": ","}[style], *cells)


def numbered_names(items: DataFrame, key: str, name: str, width: int = 3) -> DataFrame:
    """(key, unique_name): equal names get a number behind them, in the order of key; names that stand alone stay.

    Numbers come from ranks in range-sorted rows, so a name that a third of all rows have fills no single task.
    """
    rows = ranked(items.select(name, key), [F.col(name).asc_nulls_first(), F.col(key).asc_nulls_first()], "_rank")
    groups = rows.groupBy(name).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    number = F.col("_rank") - F.col("_first") + 1
    shown = F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat(F.col("_name"), F.lpad(number.cast("string"), F.greatest(F.lit(width), F.char_length(number.cast("string"))), F.lit("0"))))
    return rows.withColumn("_name", F.col(name)).join(groups, rows[name].eqNullSafe(groups[name])).select(key, shown.alias("unique_name"))


def renamed(table: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """A dependent table after a rename: mapping has old and new; names without an entry stay."""
    order = table.columns
    joined = table.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(*order)


def in_fields(items: DataFrame, fields: list[str], expression: str) -> Column:
    """The any-field predicate over the named columns."""
    return any_field([F.col(f) for f in fields], expression)



def stored_marks(items: DataFrame, key: str, name: str = "marked", slot: str = "default") -> DataFrame:
    """slot and key of the marked items, to be kept and restored later; several slots lie in one table."""
    return items.filter(F.coalesce(F.col(name), F.lit(False))).select(F.lit(slot).alias("slot"), key)


def restored_marks(items: DataFrame, kept: DataFrame, key: str, slot: str = "default", name: str = "marked") -> DataFrame:
    """items marked as they were when the slot was stored; ids that are gone since are no error."""
    return marked(items, kept.filter(F.col("slot") == slot).select(key), key, name)


def followed(items: DataFrame, link: str, targets: dict[str, tuple[DataFrame, str]], *fields: str) -> DataFrame:
    """items with fields of what their link (`type:id`) points to: targets has (table, key) by type; a dead link gives null."""
    kind, at = F.substring_index(link, ":", 1), F.regexp_extract(link, "^[^:]*:(.*)$", 1)
    rows = None
    for name, (table, key) in targets.items():
        own = table.select(F.lit(name).alias("_type"), F.col(key).cast("string").alias("_id"), *[F.col(f).cast("string").alias(f) for f in fields])
        rows = own if rows is None else rows.unionByName(own)
    found = items.withColumn("_type", kind).withColumn("_id", at).join(rows, ["_type", "_id"], "left")
    return found.select(*items.columns, *fields)


def partial_flag(field: Column, default: int) -> Column:
    """1 for a partial sequence, 0 for a whole one; a missing flag is the default, another value an error."""
    value = F.coalesce(field.cast("int"), F.lit(default))
    return F.when(value.isin(0, 1), value).otherwise(F.raise_error(F.lit("a partial flag is 0 or 1")).cast("int"))


def limited(items: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows in that order, with truncated: whether there were more. One row more than asked for is taken, not all."""
    rows = items.orderBy(*order).limit(most + 1)
    numbered = rows.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    return numbered.withColumn("truncated", F.max("_at").over(Window.partitionBy()) > most).filter(F.col("_at") <= most).drop("_at")


def faults(items: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and fault, one row for each rule that an item breaks; a rule that gives null isn't kept."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return items.select(key, F.explode(found).alias("fault"))


def repaired(items: DataFrame, version: str, passes: list[tuple[int, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """items after all passes with a number above their version, in order; a second run changes nothing.

    A pass maps all items with all columns; it takes effect only on rows whose version lies below its number.
    """
    for number, change in sorted(passes, key=lambda p: p[0]):
        old = F.coalesce(F.col(version), F.lit(0)) < number
        items = items.filter(~old).unionByName(change(items.filter(old)).withColumn(version, F.lit(number)).select(*items.columns))
    return items
