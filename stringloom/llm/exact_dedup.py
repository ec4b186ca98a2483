"""Exact deduplication with streaming state: digests fold into keyed state on disk, hits are compared byte by byte.

The state (RocksDB, no expiry) holds for each digest the row that stays: its length, its identifier and
the locator of its content (file and row number), and how many rows share the digest. To compare each hit with
the row that the state points to, only texts whose locator a bitmap knows are shuffled; digests that turn out to
cover different texts are regrouped by the texts themselves. DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm.common import SPACE, free_name, join_by_key, new_path, text_of, with_locator, written

#: Rows of one group that are compared in one task's partition of the join.
SUBGROUP = 5000
#: Bits of the bitmap for each row that it knows, and bits at most (32 MB): what is broadcast never grows beyond.
BITS, MOST_BITS = 256, 1 << 28


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fold_digests(spark: SparkSession, events_path: str, schema, files_per_batch: int = 10_000) -> DataFrame:
    """Runs the stream of (digest, n_chars, doc_id, locator) rows in events_path through the keyed state.

    Returns one row a digest: keep_chars, keep_id, keep_locator, group_size. A restarted query goes on
    from the state's checkpoint; as a batch may be written twice then, the last version of a digest counts.
    """
    conf = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
        # many small stores: without this each one reserves some MB of disk for its logs
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    versions, work = new_path(spark, "dedup-versions"), new_path(spark, "dedup-state")

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{versions}/batch_{batch_id}")

    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(events_path)
        best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("_not_id"), "locator"))
        state = events.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        query = state.writeStream.outputMode("update").option("checkpointLocation", work).trigger(availableNow=True).foreachBatch(emit).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema_of_versions = "digest string, best struct<n_chars: int, _not_id: bigint, locator: string>, group_size bigint, batch int"
    latest = (
        spark.read.schema(schema_of_versions).option("recursiveFileLookup", "true").parquet(versions)
        .groupBy("digest").agg(F.max(F.struct("batch", "best", "group_size")).alias("v"))
    )
    return latest.select(
        "digest", F.col("v.best.n_chars").alias("keep_chars"), F.bitwise_not("v.best._not_id").alias("keep_id"),
        F.col("v.best.locator").alias("keep_locator"), F.col("v.group_size").alias("group_size"),
    )


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: locator, doc_id, n_chars, digest, keep_locator, keep_id, group_size, kept.

    Texts are equal when identical without white space; null counts as empty, so null and empty texts form
    one group. Of equal texts the row with most code points stays, then the smallest doc_id (a null id
    loses), then, for repeated rows, the greatest locator: exactly one row of a group is kept. An empty
    table gives no rows. Texts of any length are compared whole. Other columns of docs are not read. digest: any string function of the
    normalised text; whatever it confuses is told apart by comparing the texts.
    """
    spark = docs.sparkSession
    source = with_locator(docs.select("doc_id", "text"), "locator")
    content = normalised(F.col("text"))
    events = written(
        source.select(digest(content).alias("digest"), F.char_length(text_of()).alias("n_chars"), "doc_id", "locator"),
        "dedup-digests",
    )
    path = events.inputFiles()[0].rsplit("/", 1)[0] if events.inputFiles() else None
    if path is None or not events.head(1):
        return events.select(
            "locator", "doc_id", "n_chars", "digest", F.col("locator").alias("keep_locator"),
            F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        )
    state = written(fold_digests(spark, path, events.schema), "dedup-latest")
    rows = join_by_key(events, state, "digest", "group_size", F.col("locator"))
    rows = written(
        rows.select("locator", "doc_id", "n_chars", "digest", "keep_locator", "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept")),
        "dedup-rows",
    )
    wrong = written(_unequal_hits(rows, source.select("locator", content.alias("content"))), "dedup-unequal")
    if not wrong.head(1):
        return rows
    return _regrouped(rows, source.select("locator", content.alias("content")), wrong)


def _bit(locator: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(locator, F.lit("bitmap")), F.lit(bits))


def only_known(contents: DataFrame, known: DataFrame, bits: int | None = None) -> DataFrame:
    """The rows of contents whose locator may be in known: all that are, and few others.

    One bit for each locator of known, in a bitmap of at most MOST_BITS that is broadcast in pieces of 4 kB; with
    very many rows in known it lets more of the others through, which costs time but no rows.
    """
    if bits is None:
        bits = min(MOST_BITS, 1 << max(15, (BITS * known.count()).bit_length()))
    at = _bit(F.col("locator"), bits)
    pieces = known.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bitmap"))
    place = F.bitmap_bit_position(at)
    octet = F.conv(F.hex(F.substring(F.col("_bitmap"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(_octet, cast(_place % 8 as int)) & 1 = 1")
    found = contents.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(pieces), "_bucket")
    return found.withColumn("_octet", octet).withColumn("_place", place).filter(hit).select(*contents.columns)


def _unequal_hits(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Digests for which some hit's bytes differ from those of the row that stays.

    A group is compared in subgroups of about SUBGROUP rows, each of which gets a copy of the kept text.
    """
    parts = (F.col("group_size") / SUBGROUP).cast("int") + 1
    grouped = rows.filter("group_size > 1").select("locator", "digest", "keep_locator", "kept", parts.alias("parts"))
    shared = grouped.join(only_known(contents, grouped.select("locator")), "locator")
    kept = shared.filter("kept").select(
        F.col("keep_locator"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("content").alias("kept_content")
    )
    hits = shared.filter("not kept").withColumn("part", F.pmod(F.xxhash64("locator"), F.col("parts")).cast("int"))
    return hits.join(kept, ["keep_locator", "part"]).filter(F.col("content") != F.col("kept_content")).select("digest").distinct()


def _regrouped(rows: DataFrame, contents: DataFrame, wrong: DataFrame) -> DataFrame:
    """rows, with the groups of the digests in wrong formed by their texts instead."""
    mixed = written(rows.join(wrong, "digest", "left_semi").select("locator", "doc_id", "n_chars", "digest"), "dedup-mixed")
    mixed = mixed.join(only_known(contents, mixed.select("locator")), "locator")
    best = F.max(F.struct("n_chars", F.bitwise_not("doc_id").alias("_not_id"), "locator")).alias("best")
    groups = mixed.groupBy("content").agg(best, F.count(F.lit(1)).alias("group_size"))
    again = mixed.join(groups, "content").select(
        "locator", "doc_id", "n_chars", "digest", F.col("best.locator").alias("keep_locator"), F.bitwise_not("best._not_id").alias("keep_id"),
        "group_size", (F.col("locator") == F.col("best.locator")).alias("kept"),
    )
    return rows.join(wrong, "digest", "left_anti").select(*again.columns).unionByName(again)


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all its columns, whatever they are called; rows are treated as exact_groups() says."""
    name, columns = free_name(docs, "_locator"), docs.columns
    kept = exact_groups(docs).filter("kept").select(F.col("locator").alias(name))
    return with_locator(docs, name).join(kept, name, "left_semi").select(*columns)
