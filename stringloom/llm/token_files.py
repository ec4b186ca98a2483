"""Token counts of flat token files: unsigned 16-bit ids without an index, each document closed by one identifier.

A file is scanned in byte ranges, one task each, however large it is: the reader ends a record wherever the
identifier's two bytes stand, and array arithmetic turns the records' lengths into the places of these ends in
the block. Whether an end is the identifier or the second byte of one id and the first of the next depends on
whether its place in the file is even, so a block reports both kinds. A prefix scan over the blocks of a file
adds up their lengths, which settles that and stitches documents that cross any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stringloom.llm.common import new_path, text_of, written
from stringloom.llm.packing import default_vocabulary, encoder

END_OF_DOCUMENT = 50_256


def _narrow(ids: np.ndarray) -> bytes:
    if len(ids) and ids.max() >= 1 << 16:
        raise ValueError("token files hold ids of 16 bits; this vocabulary has larger ones")
    return ids.astype("<u2").tobytes()


def write_token_files(docs: DataFrame, vocabulary: str | None = None, end: int = END_OF_DOCUMENT) -> str:
    """Tokenises docs into flat files in a new folder of the shared folder; gives back its path.

    Each task writes one file with its rows in order, kind=0, and beside it under the same number, kind=1, the
    doc_ids of these rows in the same order. The text writer puts the identifier's two bytes behind each row's
    bytes as its line separator. A null or empty text is the identifier alone, and so is a null doc_id. The
    identifier's own string in a text is ordinary text and so never ends a document. Ids beyond 16 bits are an error.
    """
    vocabulary = vocabulary or default_vocabulary()
    path = new_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(vocabulary), 0
        for batch in batches:
            n = batch.num_rows
            ids = [_narrow(encode(t.as_py())) for t in batch.column(1)]
            keys = [b"" if d is None else b"%d" % d for d in batch.column(0).to_pylist()]
            numbers = np.arange(number, number + n)
            yield pa.record_batch([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(numbers, 2), pa.int64()), pa.array(ids + keys, pa.binary())], names=["kind", "number", "ids"])
            number += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "kind int, number long, ids binary")
    lines = rows.sortWithinPartitions("kind", "number").select("kind", F.col("ids").cast("string").alias("value"))
    lines.write.partitionBy("kind").option("lineSep", end.to_bytes(2, "little").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 0).text(path)
    return path


def _files(spark: SparkSession, path: str, kind: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return (files.filter(F.col("kind") == kind) if "kind" in files.columns else files).select("path", "content")  # an empty folder has no kinds


def read_keys(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT) -> DataFrame:
    """One row a document: file, number (from 0 in its file) and doc_id, as the task that wrote its tokens left them."""
    line_end = end.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                keys = (content.as_py() or b"").split(line_end)[:-1]
                yield pa.record_batch([pa.array([name.as_py()] * len(keys), pa.string()), pa.array(np.arange(len(keys)), pa.int64()), pa.array([int(k) if k else None for k in keys], pa.int64())], names=["file", "number", "doc_id"])

    return _files(spark, path, 1).mapInArrow(run, "file string, number long, doc_id long")


def scan_blocks(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT) -> DataFrame:
    """One row a block: file, file_size, block (its order in the file), n_bytes, and ends, the places of the identifier's bytes in it.

    A block is what one batch of records of one byte range holds; ranges are the session's maxPartitionBytes. The
    identifier's two bytes must differ. A record may have up to 2 GB, which is a document of a billion tokens.
    """
    if end >> 8 == end & 0xFF:
        raise ValueError("the identifier's two bytes must differ")
    separator = end.to_bytes(2, "little").decode("latin-1")
    records = spark.read.option("lineSep", separator).option("encoding", "ISO-8859-1").option("pathGlobFilter", "part-*").text(path)
    if "kind" in records.columns:
        records = records.filter("kind = 0")
    rows = records.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start", F.octet_length("value").cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            files, starts = batch.column(0), batch.column(2).to_numpy()
            lengths = batch.column(3).to_numpy() + 2
            same = np.append(0, np.flatnonzero((starts[1:] != starts[:-1]) | np.asarray(files[1:].to_numpy(False) != files[:-1].to_numpy(False))) + 1) if len(starts) else []
            for s, e in zip(same, [*same[1:], len(starts)]):
                ends = np.cumsum(lengths[s:e]) - 2
                columns = [[files[s].as_py()], [batch.column(1)[s].as_py()], [{"start": int(starts[s]), "batch": k}], [int(ends[-1]) + 2], [ends]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["file", "file_size", "block", "n_bytes", "ends"]
    types = [pa.string(), pa.int64(), pa.struct([("start", pa.int64()), ("batch", pa.int64())]), pa.int64(), pa.list_(pa.int64())]
    return rows.mapInArrow(run, "file string, file_size long, block struct<start: long, batch: long>, n_bytes long, ends array<long>")


def document_tokens(blocks: DataFrame) -> DataFrame:
    """One row a document: file, number (from 0 in its file), start (its first token's place) and n_tokens without the identifier.

    Tokens behind the last identifier of a file are a document of their own; an empty file has none; a last odd
    byte belongs to no token. The prefix scan sees one narrow row a block; the places stay where they are.
    """
    parity = lambda odd: F.filter("ends", lambda e: e % 2 == (1 if odd else 0))
    last = lambda odd: F.element_at(parity(odd), -1)
    sums = [F.size(parity(k)).alias(f"n_{k}") for k in (0, 1)] + [F.when(F.size(parity(k)) > 0, last(k)).alias(f"last_{k}") for k in (0, 1)]
    order = Window.partitionBy("file").orderBy("block")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    scan = blocks.select("file", "file_size", "block", "n_bytes", *sums).withColumn("first", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
    # the records' lengths and a separator each may exceed the file by the separator that its last record lacks, or fall short by a byte order mark, which the reader drops
    over = F.sum("n_bytes").over(whole) - F.col("file_size")
    scan = scan.withColumn("over", over).withColumn("mark", F.when(F.col("over") < 0, 3).otherwise(0)).withColumn("first", F.col("first") + F.col("mark"))
    odd = F.pmod("first", F.lit(2)) == 1
    closed = F.pmod("over", F.lit(3)) == 0  # 0 or -3: the last record has its separator
    scan = scan.withColumn("n", F.when(odd, F.col("n_1")).otherwise(F.col("n_0"))).withColumn("last", F.col("first") + F.when(odd, F.col("last_1")).otherwise(F.col("last_0")))
    scan = scan.withColumn("closed", closed).withColumn("is_last", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1)
    scan = scan.withColumn("open", F.coalesce(F.max("last").over(before) + 2, F.lit(0))).withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0)))
    stitched = blocks.select("file", "block", "ends").join(scan.select("file", "file_size", "block", "first", "open", "done", "closed", "is_last"), ["file", "block"])
    places = F.filter(F.transform("ends", lambda e: e + F.col("first")), lambda e: e % 2 == 0)
    # what the file's end closes is no identifier; it is a document if it holds a token
    size = F.col("file_size") - F.pmod("file_size", F.lit(2))
    real = F.filter(places, lambda e: ~F.col("is_last") | F.col("closed") | (e < F.col("file_size") - 1))
    rest = F.when(F.size(real) > 0, F.element_at(real, -1) + 2).otherwise(F.col("open"))
    stops = F.when(F.col("is_last") & (rest < size), F.concat(real, F.array(size))).otherwise(real)
    rows = stitched.withColumn("stops", stops).select("file", "open", "done", "stops", F.posexplode("stops").alias("k", "stop"))
    start = F.when(F.col("k") > 0, F.get("stops", F.col("k") - 1) + 2).otherwise(F.col("open"))
    return rows.select("file", (F.col("done") + F.col("k")).alias("number"), (start / 2).cast("long").alias("start"), ((F.col("stop") - start) / 2).cast("long").alias("n_tokens"))


def file_number(file):
    """The number of the task that wrote the file."""
    return F.regexp_extract(file, r"part-(\d+)", 1).cast("long")


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, file_number, number and n_tokens, counted in flat files written from docs.

    docs is read once: ids and tokens come from the same task, so neither later splits nor the order of the rows
    matter, and docs may be any DataFrame. A null or empty text has 0 tokens; repeated rows each have a row; a
    null doc_id stays null; an empty table gives no rows; other columns of docs are not read. A document that
    has tokens but no id, or an id but no tokens, is an error.
    """
    spark = docs.sparkSession
    path = write_token_files(docs, vocabulary)
    at = lambda df, *columns: df.select(file_number(F.col("file")).alias("file_number"), "number", *columns)
    counts = at(document_tokens(written(scan_blocks(spark, path), "token-blocks")), "n_tokens")
    keys = at(read_keys(spark, path), "doc_id", F.lit(True).alias("_key"))
    whole = F.col("_key").isNotNull() & F.col("n_tokens").isNotNull()
    lost = F.raise_error(F.concat(F.lit("token files and ids differ at "), F.concat_ws("#", "file_number", "number"))).cast("long")
    return keys.join(counts, ["file_number", "number"], "full").select("doc_id", "file_number", "number", F.when(whole, F.col("n_tokens")).otherwise(lost).alias("n_tokens"))
