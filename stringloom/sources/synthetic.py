"""Made-up sequences along a random tree, the same on every run and in any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sequences(spark: SparkSession, n: int, length: int, rate: float = 0.05, seed: int = 0, letters: str = "ACGT") -> DataFrame:
    """id (1 to n), parent (id / 2) and data: each sequence is its parent's with about `rate` of its letters drawn anew.

    A letter comes from the last node on the way from the root at which its place was drawn anew, which hashes of
    node and place tell, so every row is made by itself.
    """
    rows = spark.range(1, n + 1).select("id", F.when(F.col("id") > 1, F.shiftright("id", 1)).alias("parent"))
    steps = F.floor(F.log2("id")).cast("int")
    way = F.transform(F.sequence(F.lit(0), steps), lambda k: F.call_function("div", F.col("id"), F.pow(F.lit(2.0), k).cast("long")))
    rows = rows.withColumn("_way", way).select("id", "parent", "_way")
    draw = lambda node, place, what: F.pmod(F.xxhash64(node, place, F.lit(seed), F.lit(what)), F.lit(1 << 30))
    changes = lambda node, place: (node == 1) | (draw(node, place, "new") < F.lit(rate * (1 << 30)))
    options = F.array(*[F.lit(x) for x in letters])

    def letter(place):
        node = F.get(F.filter(F.col("_way"), lambda x: changes(x, place)), F.lit(0))
        return F.get(options, (draw(node, place, "letter") % len(letters)).cast("int"))

    return rows.select("id", "parent", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "").alias("data"))
