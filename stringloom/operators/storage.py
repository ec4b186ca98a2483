"""Intermediate tables in the folder that all executors share, and global ranks and prefix scans without a global window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if everything runs on one machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, where its lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A written table of more rows is never broadcast, however small its files are.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, name: str) -> DataFrame:
    """stored, for tables of alike rows, whose files are so small that Spark would broadcast gigabytes through the driver.

    The files' footers tell how many rows there are; many rows are joined by sorting.
    """
    written = stored(df, name)
    return written.hint("merge") if written.count() > BROADCAST_ROWS else written


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """df with the place (from 1) of each row in the given order, which has to be total.

    Rows are range-sorted; the driver adds up one count for each partition, and no task sees all rows.
    """
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(before, "_part long, _before long")
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + row + 1).drop("_part", "_before", "_at")


def before(rows: DataFrame, name: str, value: Column, fold, *keys: str) -> DataFrame:
    """rows with `name`: the fold (F.sum, F.min or F.max) of value over the rows of the same keys that stand before; null without any.

    A prefix scan: rows are folded within their block, the blocks' results over the blocks, and both are put together.
    No task has more rows than a block, or than a key has blocks. rows are written first, since they are read twice: keep them narrow.
    """
    behind = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    rows = stored(rows.withColumn("_value", value), "scan").withColumn("_within", fold("_value").over(behind(Window.partitionBy(*keys, "block").orderBy("line"))))
    blocks = rows.groupBy(*keys, "block").agg(fold("_value").alias("_whole"))
    carried = blocks.select(*keys, "block", fold("_whole").over(behind(Window.partitionBy(*keys).orderBy("block"))).alias("_carried"))
    both = F.filter(F.array("_within", "_carried"), lambda x: x.isNotNull())
    joined = rows.join(carried, [*keys, "block"])
    # the fold of both, of which either may be missing
    put = {F.sum: F.coalesce("_within", F.lit(0)) + F.coalesce("_carried", F.lit(0)), F.min: F.array_min(both), F.max: F.array_max(both)}[fold]
    return joined.withColumn(name, put).drop("_value", "_within", "_carried")
