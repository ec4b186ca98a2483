"""Change feeds run batch by batch against the whole feed at once."""

import json
import os

from pyspark.sql import functions as F

from stringloom.operators import columns
from stringloom.streaming import changes

SCHEMA = "seq long, path string, op string, old string, new string, at timestamp"
FEED = [
    [(1, "/s/a/data", "insert", None, "ACG", "2024-01-01T00:00:00"), (2, "/s/b/data", "insert", None, "AC", "2024-01-01T00:01:00"), (3, "/s/b/name", "insert", None, "x", "2024-01-01T00:20:00")],
    [(4, "/s/a/data", "update", "ACG", "TCG", "2024-01-01T00:21:00"), (5, "/s/b/data", "delete", "AC", None, "2024-01-01T00:22:00")],
    [(6, "/s/c/name", "insert", None, "y", "2024-01-01T00:02:00"), (7, "/s/c/data", "insert", None, "TT", "2024-01-01T00:40:00")],
]


def feed(spark, path):
    for i, batch in enumerate(FEED):
        (path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "path", "op", "old", "new", "at"), r))) for r in batch))
        os.utime(path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of their times
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(path))


def table(spark, stream, tmp, name, mode):
    changes.run_to_table(stream, name, mode, str(tmp / name)).awaitTermination()
    return spark.table(name)


def test_column_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = changes.column_counts(changes.watched(feed(spark, tmp_path / "in"), "/s/*/data"))
    got = {(r.pos, r.ch): r.n for r in table(spark, stream, tmp_path, "counts", "complete").filter("n != 0").collect()}
    final = spark.createDataFrame([("TCG",), ("TT",)], "data string")
    assert got == {(r.pos, r.ch): r.n for r in columns.counts(final, "data", fill=None).collect()}


def test_latest_and_watched(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = feed(spark, tmp_path / "in")
    got = {r.path: r.value for r in table(spark, changes.latest(stream), tmp_path, "newest", "complete").collect()}
    assert got == {"/s/a/data": "TCG", "/s/b/data": None, "/s/b/name": "x", "/s/c/name": "y", "/s/c/data": "TT"}
    seen = table(spark, changes.watched(stream, "/s/*/name", "insert"), tmp_path, "names", "append")
    assert sorted(r.seq for r in seen.collect()) == [3, 6]


def test_late_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = changes.windowed(feed(spark, tmp_path / "in"), "at", "5 minutes", "10 minutes")
    got = {r.window.start.minute: r.changes for r in table(spark, stream, tmp_path, "windows", "append").collect()}
    assert got[0] == 2  # the change of minute 2 comes after the watermark has passed its window


def test_callbacks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    changes.on_commit(feed(spark, tmp_path / "in").filter(F.col("op") != "delete"), lambda df, n: seen.append((n, df.count())), str(tmp_path / "state")).awaitTermination()
    assert seen == [(0, 3), (1, 1), (2, 2)]
