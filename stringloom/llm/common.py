"""What several operators share: the shared folder, written tables, joins on hot keys, held-out rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and 0x09-0x0D.
SPACE = " \\x09-\\x0D"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if everything runs on one machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return "file://" + _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs one file's tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_locator(docs: DataFrame, name: str = "_locator") -> DataFrame:
    """docs with a stable position of each row: file path and row number in it.

    A DataFrame that doesn't come straight from files is written to the shared folder first.
    """
    try:
        docs.select("_metadata.row_index", "_metadata.file_path")
    except AnalysisException:
        docs = written(docs, "located")
    return docs.withColumn(name, F.concat_ws("#", "_metadata.file_path", F.col("_metadata.row_index").cast("string")))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out() -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def join_by_key(left: DataFrame, right: DataFrame, key: str, count: str, spread: Column, share: int = 1000) -> DataFrame:
    """left join of right, which has one row a key and in `count` the number of left rows with that key.

    Keys with over 1/share of all rows are fewer than share, so they can be broadcast whatever the
    input; their left rows skip the shuffle's hot partition. All others are joined by a shuffle in
    which no key has more than 1/share of the rows. spread: an expression that differs between rows.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * share > total
    values = [c for c in right.columns if c != key]
    packed = F.struct(*values)
    hot_rows = right.filter(hot).select(key, packed.alias("_hot"))
    cold_rows = right.filter(~hot).select(F.col(key).alias("_cold_key"), packed.alias("_cold"))
    kind = dict(right.dtypes)[key]
    elsewhere = F.xxhash64(spread, F.lit("spread")).cast(kind)
    if kind == "string":
        elsewhere = F.concat(F.lit("~"), elsewhere)
    return (
        left.join(F.broadcast(hot_rows), key, "left")
        .withColumn("_cold_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(elsewhere))
        .join(cold_rows, "_cold_key", "left")
        .withColumn("_all", F.coalesce("_hot", "_cold"))
        .select(*[left[c] for c in left.columns], *[F.col(f"_all.{v}").alias(v) for v in values])
    )
