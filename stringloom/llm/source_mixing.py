"""Mixing sources to target weights: tokens per source, repetition rates, then whole copies plus a seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stringloom.llm.common import SPACE, join_by_key, written

#: Weights of the sources in the order of their code points, null last, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this share of all words, and no source more than this many times its own.
SHARE, MOST = 1.5, 2.0
#: Seed of the draws.
SEED = 42


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) to those columns and target, one row a source.

    A target is the weight times one common level, or `most` times the source's size where that is less:
    what giving the excess again to the sources below their limit, by weight, leads to. With the sources
    sorted by the level at which they reach their limit, running sums tell which do. The rows here are the
    sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int"))).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    limited = F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    free = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if all sources before this one in the order are at their limit; the first source that stays below its own has the right one.
    levels = weighed.withColumn("level", (budget - limited) / free)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything)
    return levels.withColumn("target", F.least("limit", F.coalesce(level * F.col("weight"), F.col("limit")))).select("source", "source_size", "target")


def draw_key() -> Column:
    """What a row's draw hashes: its doc_id, or its text where that is null."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))


def n_copies(seed: int = SEED) -> Column:
    """floor(rate) whole copies and one more if the row's draw, from 0 to 1, is below the fraction; none of a row without words."""
    draw = F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    return F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))


def source_plan(narrow: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) to one row a source: source_key, rows, source_size, target and rate."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes, "mix-sources")
    targets = source_targets(sizes.drop("rows"), weights, share, most).withColumn("source_key", source_key()).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return written(sizes.select(source_key().alias("source_key"), "rows").join(targets.withColumn("rate", rate), "source_key"), "mix-plan")


def source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def by_source(rows: DataFrame, plan: DataFrame, most: int = 100_000) -> DataFrame:
    """rows with their source's plan: a broadcast of up to `most` sources, else a join that spreads hot ones."""
    if plan.count() <= most:
        return rows.join(F.broadcast(plan), "source_key")
    return join_by_key(rows, plan, "source_key", "rows", F.col("draw"))


def allotted(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target and copies.

    copies is floor(rate) and one more with probability of the fraction, rate = target / source_size. The extra
    copy is one Bernoulli draw for each row, by a hash of its doc_id and the seed. So reruns agree, rows with
    equal ids are drawn alike, and a source's total lands about its target: the more documents, the nearer. A
    null text has no words, a null source is a source of its own, a source without words has rate 0, a row with
    a null doc_id is drawn by its text; an empty table gives no rows. Texts of any length are counted whole.
    Other columns of docs are not read, so their names may clash.
    """
    narrow = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw_key().alias("draw")), "mix-sizes")
    rows = by_source(narrow.withColumn("source_key", source_key()), source_plan(narrow, **options))
    return rows.select("doc_id", "source", "size", "source_size", "target", n_copies(seed).alias("copies"))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs. Rows without words are not taken.

    Rows are treated as allotted() says; columns of docs keep their names and values, whatever they are called.
    """
    columns = docs.columns
    narrow = written(docs.select("source", n_words(F.col("text")).alias("size")), "mix-sizes")
    plan = source_plan(narrow, **options).select("source_key", "rows", "rate")
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    rows = by_source(docs.select(row, "doc_id", source_key().alias("source_key"), n_words(F.col("text")).alias("size"), draw_key().alias("draw")), plan)
    copies = rows.select("row", n_copies(seed).alias("copies")).filter("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
