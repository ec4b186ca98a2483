"""Collects the queries of a module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function of `table`, which gives a table by name, under its own name."""

        def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table for work that makes many rows of each text: dealt out anew if it has fewer parts than there are cores.

    Large tables have more parts than that and stay as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
