"""Two tables side by side: matches on values or words, upserts, joined items, concatenated and remapped alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS = "[^\\p{L}\\p{N}]+"


def equal_values(left: DataFrame, right: DataFrame, field: str, other: str, exists: bool = True) -> DataFrame:
    """The rows of left whose value is, or isn't, in right; a missing value is in no table."""
    values = right.select(F.col(other).alias("_value")).filter("_value is not null").distinct()
    return left.join(values, F.col(field) == F.col("_value"), "left_semi" if exists else "left_anti")


def equal_words(left: DataFrame, key: str, field: str, right: DataFrame, other: str, exists: bool = True) -> DataFrame:
    """The rows of left of which a word, or no word, stands in right. Words are exploded and reduced before they meet."""
    words = left.select(key, F.explode(F.array_distinct(F.split(field, WORDS))).alias("_word")).filter("_word != ''")
    known = right.select(F.explode(F.split(other, WORDS)).alias("_word")).filter("_word != ''").distinct()
    hits = words.join(known, "_word", "left_semi").select(key).distinct()
    return left.join(hits, key, "left_semi" if exists else "left_anti")


def word_overlap(left: DataFrame, key: str, field: str, right: DataFrame, other: str) -> DataFrame:
    """key and common: how many different words of the row stand in right."""
    words = left.select(key, F.explode(F.array_distinct(F.split(field, WORDS))).alias("_word")).filter("_word != ''")
    known = right.select(F.explode(F.split(other, WORDS)).alias("_word")).filter("_word != ''").distinct()
    return words.join(known, "_word").groupBy(key).agg(F.count(F.lit(1)).alias("common"))


def upserted(base: DataFrame, changes: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """base with the rows of changes put in by key: fields that a change has win (or only fill gaps); new keys are added."""
    both = [c for c in base.columns if c != key and c in changes.columns]
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in both])
    pick = (lambda c: F.coalesce(f"_{c}", c)) if overwrite else (lambda c: F.coalesce(c, f"_{c}"))
    return base.join(renamed, key, "full_outer").select(*[pick(c).alias(c) if c in both else F.col(c) for c in base.columns])


def fresh_delta(base: DataFrame, delta: DataFrame, key: str, deleted: str) -> DataFrame:
    """base after a delta of whole rows with a flag for deleted ones: rows of the delta replace those of base."""
    kept = base.join(delta.select(key), key, "left_anti")
    return kept.unionByName(delta.filter(~F.coalesce(F.col(deleted), F.lit(False))).select(*base.columns))


def saved_delta(before: DataFrame, now: DataFrame, key: str, deleted: str = "deleted") -> DataFrame:
    """What fresh_delta needs to make now from before: rows that are new or differ in any column, and the keys that are gone, flagged.

    Rows meet by key, and only a hash of the other columns of before is shuffled. Keys are unique; null is no key.
    """
    others = [c for c in now.columns if c != key]
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in others]), 256)
    old = before.select(key, digest.alias("_old"))
    both = now.withColumn("_new", digest).join(old, key, "full_outer")
    changed = both.filter(~F.col("_new").eqNullSafe(F.col("_old")))
    return changed.select(*now.columns, F.col("_new").isNull().alias(deleted))


def with_origin(items: DataFrame, link: str, origins: DataFrame, key: str, name: str = "origin") -> DataFrame:
    """items with a struct of the fields of what each was taken from (the organism or the gene of a pseudo item).

    Commands then work on a field of it, as on one of the item's own; items without an origin, or with one that is absent, have null.
    """
    fields = origins.select(F.col(key).alias("_origin_key"), F.struct(*origins.columns).alias(name))
    return items.join(fields, F.col(link) == F.col("_origin_key"), "left").drop("_origin_key")


def joined_items(items: DataFrame, group: str, order: str, field: str, separator: str) -> DataFrame:
    """group, the field's values in order joined by the separator, and the number of rows; missing values are left out."""
    ordered = F.array_sort(F.collect_list(F.when(F.col(field).isNotNull(), F.struct(order, field))))
    text = F.array_join(F.transform(ordered, lambda x: x[field]), separator)
    return items.groupBy(group).agg(text.alias(field), F.count(F.lit(1)).alias("rows"))


def concatenated(parts: list[DataFrame], key: str, data: str, separator: str = "", fill: str = ".") -> DataFrame:
    """key and the alignments' strings one behind the other; a missing one is filled up to its alignment's longest string."""
    whole = None
    for i, part in enumerate(parts):
        part = part.select(key, F.col(data).alias(f"_{i}"))
        whole = part if whole is None else whole.join(part, key, "full_outer")
    lengths = [part.agg(F.coalesce(F.max(F.char_length(data)), F.lit(0)).alias(f"_n{i}")) for i, part in enumerate(parts)]
    for n in lengths:
        whole = whole.crossJoin(F.broadcast(n))
    cells = [F.coalesce(f"_{i}", F.repeat(F.lit(fill), F.col(f"_n{i}").cast("int"))) for i in range(len(parts))]
    return whole.select(key, F.concat_ws(separator, *cells).alias(data))


def base_columns(data: Column, gaps: str = "-.") -> Column:
    """array<int>: the column (from 1) of each character that is not a gap, by its number."""
    chars = F.filter(F.split(data, ""), lambda ch: ch != "")
    places = F.transform(chars, lambda ch, i: F.when(F.instr(F.lit(gaps), ch) > 0, F.lit(0)).otherwise(i + 1))
    return F.filter(places, lambda p: p > 0)


def column_map(source: DataFrame, target: DataFrame, key: str, data: str, gaps: str = "-.") -> DataFrame:
    """source and target column for every column in which a reference that both tables have holds the same base number.

    Of several references for a column the smallest target column counts.
    """
    # the texts meet once by their reference; a row for each base would be shuffled and sorted
    both = source.select(key, F.col(data).alias("_s")).join(target.select(key, F.col(data).alias("_t")), key)
    cells = F.zip_with(base_columns(F.col("_s"), gaps), base_columns(F.col("_t"), gaps), lambda s, t: F.struct(s.alias("source"), t.alias("target")))
    return both.select(F.inline(cells)).filter("source is not null and target is not null").groupBy("source").agg(F.min("target").alias("target"))


def remapped(df: DataFrame, data: str, mapping: DataFrame, length: int, gap: str = "-") -> DataFrame:
    """df with every mapped column at its new place; columns without an entry go, places without one become gaps.

    The map has one entry a column of the alignment, and goes along as one array.
    """
    entries = mapping.agg(F.map_from_entries(F.collect_list(F.struct("target", "source"))).alias("_map"))
    places = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda t: F.try_element_at(F.col("_map"), t))
    chars = F.transform(places, lambda s: F.when((s > 0) & (s <= F.char_length(data)), F.substring(F.col(data), s, F.lit(1))).otherwise(gap))
    return df.crossJoin(F.broadcast(entries)).withColumn(data, F.array_join(chars, "")).drop("_map")


def soft_columns(mapping: DataFrame) -> DataFrame:
    """source, left, right, first, last and target of every column between the mapped ones, and of these.

    mapping: source and target column, both growing. A column between two mapped ones has those as left and right
    neighbours (their targets are first and last) and a share of the targets between them: evenly spread, or, if
    there is more room than columns, half of them at either end. A mapped column is its own neighbour. A join in
    both directions: the map's entries in order give the neighbours, and what lies between is made from each pair.
    """
    order = Window.orderBy("source")  # one entry a column of the alignment
    pairs = mapping.select("source", "target", F.lead("source").over(order).alias("_next"), F.lead("target").over(order).alias("_to"))
    fixed = mapping.select("source", F.col("source").alias("left"), F.col("source").alias("right"), F.col("target").alias("first"), F.col("target").alias("last"), "target")
    n, room = F.col("_next") - F.col("source") - 1, F.col("_to") - F.col("target") - 1
    step = F.when((n > 1) & (room > 1), (room - 1) / (n - 1)).otherwise(0.0)
    off = F.col("_off")
    halves = F.col("target") + 1 + off + F.when(off < F.floor(n / 2), 0).otherwise(room - n)
    even = F.floor(F.col("target") + 1 + off * step + 0.5)
    between = pairs.filter(n > 0).withColumn("_off", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    soft = between.select((F.col("source") + 1 + off).cast("int").alias("source"), F.col("source").alias("left"), F.col("_next").alias("right"), F.col("target").alias("first"), F.col("_to").alias("last"), F.when((step >= 1) & (room > n), halves).otherwise(even).cast("int").alias("target"))
    return fixed.unionByName(soft)


def soft_remapped(df: DataFrame, key: str, data: str, mapping: DataFrame, gaps: str = "-.") -> DataFrame:
    """key and data with every base at its column's target, or near it; no base is lost.

    Bases between two mapped columns go to their soft targets (see soft_columns); if two want one place the left one
    gives way to the left, and where there are as many bases as places or more they stand side by side, and what does not fit
    moves everything behind it. Bases before the first mapped column end right before its target, those behind the
    last one follow it. Gaps are `-` or, where the gap in the data began with a dot, dots; both ends are dots.
    An item without bases, or without data, is dots up to the last mapped place.
    """
    columns = soft_columns(mapping)
    ends = mapping.agg(F.min("source").alias("_s0"), F.max("source").alias("_s1"), F.min("target").alias("_t0"), F.max("target").alias("_t1"))
    chars = F.filter(F.split(F.col(data), ""), lambda c: c != "")
    rows = df.select(key, F.posexplode(chars).alias("_at", "ch")).withColumn("source", F.col("_at") + 1)
    is_gap = F.instr(F.lit(gaps), F.col("ch")) > 0
    item = Window.partitionBy(key)  # the characters of one text
    # the base before tells where a gap began
    rows = rows.withColumn("_last", F.max(F.when(~is_gap, F.col("source"))).over(item.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)))
    began = F.min(F.when(is_gap, F.struct("source", "ch"))).over(item.partitionBy(key, "_last").orderBy("source").rowsBetween(Window.unboundedPreceding, 0))
    bases = rows.withColumn("_gap", F.coalesce(began["ch"], F.lit("-"))).filter(~is_gap).join(F.broadcast(columns), "source", "left").crossJoin(F.broadcast(ends))
    segment = F.when(F.col("source") < F.col("_s0"), -1).when(F.col("source") > F.col("_s1"), F.col("_s1")).otherwise(F.coalesce("left", F.lit(0)))
    bases = bases.withColumn("_segment", segment).withColumn("_fixed", F.coalesce(F.col("left") == F.col("right"), F.lit(False)))
    own = Window.partitionBy(key, "_segment", "_fixed")
    bases = bases.withColumns({"_k": F.row_number().over(own.orderBy("source")), "_n": F.count(F.lit(1)).over(own)})
    tight = F.col("_n") >= F.col("last") - F.col("first") - 1
    wanted = (
        F.when(F.col("source") < F.col("_s0"), F.col("_t0") - F.col("_n") + F.col("_k") - 1).when(F.col("source") > F.col("_s1"), F.col("_t1") + F.col("_k"))
        .when(F.col("_fixed"), F.col("target")).when(tight, F.col("first") + F.col("_k")).otherwise(F.col("target"))
    )
    bases = bases.withColumn("_want", wanted.cast("int"))
    # from the right end of a segment: each base at least one place before the one behind it, the last one within the segment
    roomy = ~F.col("_fixed") & (F.col("source") > F.col("_s0")) & (F.col("source") < F.col("_s1")) & ~tight
    capped = F.least(F.min(F.col("_want") - F.col("_k")).over(own.orderBy(F.desc("source"))), F.col("last") - 1 - F.col("_n")) + F.col("_k")
    bases = bases.withColumn("_want", F.when(roomy, capped).otherwise(F.col("_want")))
    whole = item.orderBy("source")
    bases = bases.withColumn("_i", F.row_number().over(whole))
    bases = bases.withColumn("_place", F.greatest(F.max(F.col("_want") - F.col("_i")).over(whole), F.lit(0)) + F.col("_i"))
    bases = bases.withColumn("_before", F.coalesce(F.lag("_place").over(whole), F.lit(0)))
    piece = F.concat(F.repeat(F.when(F.col("_i") == 1, ".").otherwise(F.col("_gap")), (F.col("_place") - F.col("_before") - 1).cast("int")), F.col("ch"))
    texts = bases.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", piece.alias("piece")))), lambda x: x["piece"]), "").alias("_text"), F.max("_place").alias("_end"))
    return df.select(key).join(texts, key, "left").crossJoin(F.broadcast(ends.select("_t1"))).select(key, F.rpad(F.coalesce("_text", F.lit("")), F.greatest(F.coalesce("_end", F.lit(0)), F.coalesce("_t1", F.lit(0))), F.lit(".")).alias(data))


def zombies(leaves: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """Names of leaves without an item."""
    return leaves.select(name).distinct().join(items.select(name), name, "left_anti")


def group_joined(items: DataFrame, group: str, order: str, texts: list[str], others: list[str], separator: str = " ") -> DataFrame:
    """One row a group: different texts of each field joined in order, equal ones kept once, other fields from the first row.

    Texts are made distinct before they meet, so a group holds as many as it has different values.
    """
    out = items.groupBy(group).agg(*[F.min(F.struct(F.col(order), F.col(c))).alias(f"_{c}") for c in others], F.count(F.lit(1)).alias("rows"))
    out = out.select(group, "rows", *[F.col(f"_{c}")[c].alias(c) for c in others])
    for c in texts:
        first = items.filter(F.col(c).isNotNull()).groupBy(group, c).agg(F.min(order).alias("_at"))
        joined = first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", c))), lambda x: x[c]), separator).alias(c))
        out = out.join(joined, group, "left")
    return out


def transferred(base: DataFrame, more: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """Whole objects (trees, annotations, configurations, names) of another table put in by key: equal keys are replaced, or kept without overwrite."""
    if overwrite:
        return base.join(more.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(more.select(*base.columns))
    return base.unionByName(more.join(base.select(key).distinct(), key, "left_anti").select(*base.columns))


def data_changes(now: DataFrame, before: DataFrame, key: str, data: str) -> DataFrame:
    """key and change (new, gone, changed, same) of each item's data against an earlier version; only digests are shuffled."""
    digest = lambda df, name: df.select(key, F.sha2(F.coalesce(F.col(data), F.lit("")), 256).alias(name))
    both = digest(now, "_now").join(digest(before, "_before"), key, "full_outer")
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("_before"), "changed").otherwise("same")
    return both.select(key, change.alias("change"))


def stamped(history: Column, change: Column, at: Column) -> Column:
    """history with a line for the change put behind it; the same items keep theirs."""
    return F.when(change == "same", history).otherwise(F.concat_ws("\n", history, F.concat_ws(" ", F.date_format(at, "yyyy-MM-dd"), change)))
