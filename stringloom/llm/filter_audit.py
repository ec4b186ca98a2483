"""How filters on the same documents interact: what each removes in every order, alone, and on average over all orders.

Each document has a mask of the filters it fails, and all figures follow from the number of documents of each mask
and part. One filter needs the whole table: texts that a smaller doc_id has too. They are found by partition
refinement: documents are split by code-point length, then by the hashes of successive blocks of their texts, whose
sizes grow; a class with one document is dropped. Texts that survive all blocks are compared whole, and the
documents that don't have the smallest id of their text are marked.

Rows are narrow and counted before they are shuffled, so a class with very many documents is one row a task. Texts move
only once, for the classes that survive the first block. DataFrame functions only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import SPACE, join_by_key, text_of, written
from stringloom.llm.exact_dedup import only_known

#: Code points of the first block, and how much longer each next one is.
FIRST, GROWTH = 256, 8


def words_of(text: Column) -> Column:
    """The maximal runs of other characters than white space."""
    bare = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+"))


def text_filters() -> dict[str, Column]:
    """The filters that look at one text, as conditions on the columns text and words under which a document fails."""
    return {
        "A": F.size("words") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * F.char_length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.char_length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def mask_of(filters: dict[str, Column]) -> Column:
    """Bit k is set if the document fails the k-th filter."""
    return sum((F.when(fails, F.lit(1 << k)).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0)).cast("int")


def block(number: int) -> tuple[int, int]:
    """(start from 1, length) of a block."""
    before = sum(FIRST * GROWTH**k for k in range(number))
    return before + 1, FIRST * GROWTH**number


def refined(number: int, text: str = "text") -> Column:
    """A document's class after `number` blocks: its length's hash, and each block's hash with the class before."""
    found = F.xxhash64(F.char_length(text))
    for k in range(number):
        found = F.xxhash64(found, F.substring(text, *block(k)))
    return found


def duplicates(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of docs (doc_id, text, which isn't null, and the columns) whose text a smaller doc_id has too: doc_id, text and the columns."""
    narrow = docs.groupBy(refined(1).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    classes = written(narrow.filter("_n > 1"), "refined-1")
    own = docs.withColumn("locator", refined(1))
    held = join_by_key(only_known(own, classes.select(F.col("_class").alias("locator"))), classes.withColumnRenamed("_class", "locator"), "locator", "_n", F.xxhash64("doc_id", "text"))
    held = written(held.filter(F.col("_n").isNotNull()).select("doc_id", "text", *columns, F.char_length("text").alias("_length")), "refined-texts")
    longest, rounds = held.agg(F.max("_length")).first()[0] or 0, 1
    while sum(block(rounds - 1)) <= longest:
        rounds += 1
        counted = held.groupBy(refined(rounds - 1).alias("_before"), refined(rounds).alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
        alive = counted.filter("_n > 1").join(classes.select(F.col("_class").alias("_before")), "_before", "left_semi")
        classes = written(alive.select("_class", "_n"), f"refined-{rounds}")
    held = join_by_key(held.withColumn("_class", refined(rounds)), classes, "_class", "_n", F.xxhash64("doc_id", "_length")).filter(F.col("_n").isNotNull())
    # whole texts meet as grouping keys: equal ones are one row a task before they are shuffled
    texts = held.groupBy("_class", "text").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    whole = written(texts.groupBy("_class").agg(F.count(F.lit(1)).alias("_texts"), F.min("_least").alias("_least"), F.sum("_rows").alias("_rows")), "refined-classes")
    same = join_by_key(held.drop("_n"), whole.filter("_texts = 1").drop("_texts"), "_class", "_rows", F.xxhash64("doc_id", "_length"))
    marked = same.filter(F.col("doc_id") > F.col("_least")).select("doc_id", "text", *columns)
    mixed = whole.filter("_texts > 1").select("_class")
    if mixed.head(1):  # different texts whose hashes all agree
        apart = held.drop("_n").join(mixed, "_class", "left_semi").join(texts.select("_class", "text", "_least"), ["_class", "text"])
        marked = marked.unionByName(apart.filter(F.col("doc_id") > F.col("_least")).select("doc_id", "text", *columns))
    return marked


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None) -> DataFrame:
    """part, mask, n, good and toxic: how many documents of a part fail just these filters, and how many of them have the labels.

    The last bit of the mask, behind those of the filters, is that of texts which a smaller doc_id has too.
    """
    filters = filters or text_filters()
    twice = 1 << len(filters)
    rows = docs.select("doc_id", text_of().alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    masked = lambda df: df.withColumn("words", words_of(F.col("text"))).select("doc_id", "part", mask_of(filters).alias("mask"))
    again = written(masked(duplicates(rows, ["part"])), "audit-duplicates")
    moved = again.select("doc_id", "part", "mask", F.lit(-1).alias("n")).unionByName(again.select("doc_id", "part", (F.col("mask") + twice).alias("mask"), F.lit(1).alias("n")))
    every = masked(rows).withColumn("n", F.lit(1)).unionByName(moved)
    known = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    with_id = every.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left").drop("doc_id")
    without = every.filter(F.col("doc_id").isNull()).select("part", "mask", "n", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    of = lambda label: F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias(label)
    return with_id.unionByName(without).groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E") -> DataFrame:
    """One row per part (lang; null is ""), order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null or empty text has no words; equal rows of one doc_id don't fail the filter of copies (`copies`), since none of
    them is smaller, and neither does a null doc_id; null labels and missing ones count as 0, and of repeated rows
    of labels the greatest does. Texts of any length are split and compared whole. An empty table has no parts and
    no rows. Other columns of docs and labels are not read.
    """
    filters = filters or text_filters()
    letters = [*filters, copies]
    bit = {x: 1 << k for k, x in enumerate(letters)}
    counts = mask_counts(docs, labels, filters)
    # a part's counts in one row, of as many numbers as there are masks
    of = lambda name: F.map_from_entries(F.collect_list(F.struct("mask", name))).alias(name)
    parts = counts.groupBy("part").agg(of("n"), of("good"), of("toxic"))
    orders = ["".join(p) for p in permutations(letters)]
    value = lambda text: sum((F.when(F.instr(text, x) > 0, F.lit(b)).otherwise(0) for x, b in bit.items()), F.lit(0))
    total = lambda name, test: F.aggregate(F.filter(F.map_entries(name), lambda e: test(e["key"])), F.lit(0).cast("long"), lambda s, e: s + e["value"])
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    steps = steps.withColumn("_own", value(F.col("filter_order").substr(F.col("step"), F.lit(1)))).withColumn("_before", value(F.col("filter_order").substr(F.lit(1), F.col("step") - 1)))
    own, before = F.col("_own"), F.col("_before")
    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    steps = steps.select(
        "part", "filter_order", "step", "_own",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
    )
    steps = written(steps, "audit-steps")
    each = steps.groupBy("part", "_own").agg(F.sum("removed").alias("shapley"))
    return steps.join(each, ["part", "_own"]).drop("_own")
