"""Change feeds: watching paths, replaying changes into the newest state, keeping column counts up to date.

A change is (seq, path, op, old, new) with op insert, update or delete. Everything is ordinary streaming
DataFrame code; state lives in Spark's state store.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watched(changes: DataFrame, pattern: str, *ops: str) -> DataFrame:
    """The changes of nodes at a path; * stands for one key. ops: the kinds that count, all if none are named."""
    regex = "^" + "[^/]*".join(re.escape(p) for p in pattern.split("*")) + "$"
    found = changes.filter(F.col("path").rlike(regex))
    return found.filter(F.col("op").isin(*ops)) if ops else found


def letter_deltas(changes: DataFrame) -> DataFrame:
    """Each change as signed letters: pos, ch, n (+1 for a letter of the new text, -1 for one of the old)."""
    letters = lambda c, sign: F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda ch: ch != ""), lambda ch, i: F.struct((i + 1).alias("pos"), ch.alias("ch"), F.lit(sign).alias("n")))
    return changes.select(F.inline(F.concat(letters(F.col("old"), -1), letters(F.col("new"), 1))))


def column_counts(changes: DataFrame) -> DataFrame:
    """pos, ch, n kept up to date: the sums of the signed letters. State is one number a column and letter."""
    return letter_deltas(changes).groupBy("pos", "ch").agg(F.sum("n").alias("n"))


def latest(changes: DataFrame) -> DataFrame:
    """path and value after all changes so far, the one with the largest seq last; deleted paths have a null value."""
    last = F.max(F.struct("seq", F.when(F.col("op") != "delete", F.col("new")).alias("value")))
    return changes.groupBy("path").agg(last.alias("x")).select("path", "x.value")


def windowed(changes: DataFrame, at: str, late: str, width: str, *keys: Column) -> DataFrame:
    """Changes counted in windows of event time; rows later than the watermark are left out."""
    return changes.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("changes"))


def on_commit(changes: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs the callback on each batch of changes, in order; a batch may be given again after a failure, under the same number."""
    return changes.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """All that is there now into a table in memory; for tests and small results."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
