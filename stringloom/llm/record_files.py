"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A file is a sequence of frames: the payload's length (unsigned 64-bit), the masked checksum of these 8 bytes, the
payload, and its masked checksum; numbers are little-endian, checksums are CRC-32C, masked by a rotation and an
addition, which is the usual framing of record files, so other readers open them. A payload is a document's key
(its length as unsigned 32-bit, then UTF-8; the length 0xFFFFFFFF stands for a null key), the number of bytes of an
id (unsigned 8-bit: 2 if that is enough for all ids of the document, else 4) and the ids.

The index is a Parquet table with a row a record: part, number, file, offset, n_bytes, tokens_before and n_tokens.
Spark commits it, and a task names its files anew at each attempt, so a lost or repeated attempt leaves files that
no index row names, never half a record that one does. Readers take index rows in any order.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import free_name, new_path, text_of

END_ID = 1
#: A file is closed at this size; a larger document has a file of its own.
FILE_BYTES = 64 << 20
#: Bytes that are framed, written, read or checked at once (a longer record goes by itself).
BLOCK_BYTES = 4 << 20
NO_KEY = 0xFFFFFFFF
#: What the masked checksum adds (fixed value of the framing).
MASK_DELTA = 0xA282EAD8
#: Entries, and characters of each, of what the encoder remembers.
REMEMBERED, LONGEST = 1 << 19, 32


# CRC-32C of many byte strings at once: lanes of equal length side by side, then shifted to their places and added.

_LANE = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)  # the Castagnoli polynomial, reflected
    return table


_BYTE = _byte_table()
_PAIR = _BYTE[(_BYTE[np.arange(65536) & 255] ^ (np.arange(65536) >> 8)) & 255] ^ (_BYTE[np.arange(65536) & 255] >> 8)


def _shift_tables(n: int) -> list[np.ndarray]:
    """Tables (4, 256) of the linear maps that move a checksum over 1, 2, 4, ... zero bytes."""
    out, images = [], None
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(n):
        images = _BYTE[bits & 255] ^ (bits >> 8) if images is None else _moved(images, out[-1])
        table = np.zeros((4, 256), np.uint32)
        for k in range(32):
            table[k // 8] ^= np.where(np.arange(256) >> (k % 8) & 1, images[k], 0).astype(np.uint32)
        out.append(table)
    return out


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_SHIFTS = _shift_tables(40)


def _moved_by(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    crc, bit = crc.copy(), 0
    while (n_bytes >> bit).any():
        on = np.flatnonzero(n_bytes >> bit & 1)
        crc[on] = _moved(crc[on], _SHIFTS[bit])
        bit += 1
    return crc


def crc32c(parts: list[bytes]) -> np.ndarray:
    """The CRC-32C of each byte string."""
    if not parts:
        return np.zeros(0, np.uint32)
    lengths = np.array([len(p) for p in parts], np.int64)
    lanes = np.maximum(1, -(-lengths // _LANE))
    padded = b"".join(x for p, n in zip(parts, lanes) for x in (bytes(int(n) * _LANE - len(p)), p))  # zeros in front change nothing
    columns = np.ascontiguousarray(np.frombuffer(padded, "<u2").reshape(-1, _LANE // 2).T)
    crc = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        crc = _PAIR[(crc ^ column) & 0xFFFF] ^ (crc >> 16)
    first = np.cumsum(lanes) - lanes
    behind = np.repeat(lanes, lanes) - 1 - (np.arange(len(crc)) - np.repeat(first, lanes))
    sums = np.bitwise_xor.reduceat(_moved_by(crc, behind * _LANE), first)
    return sums ^ _moved_by(np.full(len(parts), 0xFFFFFFFF, np.uint32), lengths) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 and raised by MASK_DELTA, so that checksums of data that hold checksums stay sound."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


# Encoding

#: What the fast path relies on: the vocabulary's own normalizers and the pattern by which it cuts texts (fixed values).
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of the fast path, where the normalizers only lower letters and join white space, and the pattern for them when lowered.
_PLAIN = re.compile(r"[ \t\n\x0b\x0c\r!-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9ß-öø-ÿ]+")
_CHUNKS = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(others)}


class Encoder:
    """Text to its ids (little-endian unsigned 32-bit, as bytes), equal to the tokenizer's own for the whole text.

    The vocabulary drops white space and cuts at it, so a text's ids are those of its chunks. What consists of ASCII
    characters and western letters is cut by the vocabulary's pattern and goes to the model piece by piece; a chunk with
    any other character, or that may hold an added token, goes to the tokenizer. The ids of short pieces and chunks are
    remembered, the REMEMBERED newest ones and the as many before. A vocabulary with other rules is used for whole texts.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        rules = json.loads(self.tokenizer.to_str())
        try:
            cuts = [rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], [n["type"] for n in rules["normalizer"]["normalizers"]]]
            self.by_chunks = cuts == [_PATTERN, _NORMALIZERS] and all("<|" in t["content"] and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in rules["added_tokens"])
        except (KeyError, TypeError, IndexError):
            self.by_chunks = False
        letters, model = _byte_letters(), self.tokenizer.model
        ids = lambda found: np.array(found, "<u4").tobytes()
        self.encoded = lambda text: ids(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        self.piece = _Remembered(lambda piece: ids([t.id for t in model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(letters))]))
        self.chunk = _Remembered(lambda chunk: self.plain(chunk) if self.is_plain(chunk) else self.encoded(chunk))

    def is_plain(self, text: str) -> bool:
        return "<|" not in text and _PLAIN.fullmatch(text) is not None

    def plain(self, text: str) -> bytes:
        pieces = _PIECES.findall(text.lower())
        return b"".join(itemgetter(*pieces)(self.piece)) if len(pieces) > 1 else b"".join(map(self.piece.__getitem__, pieces))

    def __call__(self, text: str) -> bytes:
        if not self.by_chunks:
            return self.encoded(text)
        return self.plain(text) if self.is_plain(text) else b"".join(map(self.chunk.__getitem__, _CHUNKS.findall(text)))


class _Remembered(dict):
    """A function's values for short keys, a bounded number of them."""

    def __init__(self, f):
        super().__init__()
        self.f, self.older = f, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.f(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One a worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# Files


def payload(key: str | None, ids: bytes) -> bytes:
    """ids: unsigned 32-bit."""
    name, wide = b"" if key is None else key.encode(), np.frombuffer(ids, "<u4")
    narrow = wide.max(initial=0) < 1 << 16
    return (NO_KEY if key is None else len(name)).to_bytes(4, "little") + name + (b"\2" + wide.astype("<u2").tobytes() if narrow else b"\4" + ids)


def opened_payload(data: bytes) -> tuple[str | None, bytes]:
    """(key, ids) of a payload, the ids as unsigned 32-bit again."""
    n = int.from_bytes(data[:4], "little")
    key, at = (None, 4) if n == NO_KEY else (data[4 : 4 + n].decode(), 4 + n)
    return key, np.frombuffer(data, f"<u{data[at]}", offset=at + 1).astype("<u4").tobytes()


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    sums = masked(crc32c(heads + payloads)).astype("<u4").tobytes()
    at = lambda k: sums[4 * k : 4 * k + 4]
    return [h + at(k) + p + at(len(heads) + k) for k, (h, p) in enumerate(zip(heads, payloads))]


def opened_frames(data: list[bytes]) -> list[bytes]:
    """The payloads of whole frames; a wrong length or checksum is an error."""
    heads, payloads = [d[:8] for d in data], [d[12:-4] for d in data]
    found = masked(crc32c(heads + payloads))
    said = np.frombuffer(b"".join([d[8:12] for d in data] + [d[-4:] for d in data]), "<u4")
    if any(int.from_bytes(h, "little") != len(p) for h, p in zip(heads, payloads)) or (found != said).any():
        raise ValueError("a record is damaged")
    return payloads


_INDEX = "part int, number long, file string, offset long, n_bytes long, tokens_before long, n_tokens long"
_INDEX_ARROW = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("tokens_before", pa.int64()), ("n_tokens", pa.int64())])


class _Files:
    """The files that one attempt of a task writes, one after the other."""

    def __init__(self, folder: str):
        self.system, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.part, self.attempt, self.opened, self.number, self.tokens = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0, 0
        self.stream, self.name, self.size = None, "", 0

    def close(self) -> None:
        if self.stream:
            self.stream.close()
        self.stream = None

    def write(self, payloads: list[bytes], counts: list[int]) -> pa.RecordBatch:
        rows = []
        for frame, n in zip(frames(payloads), counts):
            if self.stream is None or self.size and self.size + len(frame) > FILE_BYTES:
                self.close()
                self.name = f"part-{self.part:06d}-{self.opened:05d}-{self.attempt}.records"
                self.stream, self.size, self.opened = self.system.open_output_stream(f"{self.folder}/{self.name}"), 0, self.opened + 1
            self.stream.write(frame)
            rows.append((self.part, self.number, self.name, self.size, len(frame), self.tokens, n))
            self.size, self.number, self.tokens = self.size + len(frame), self.number + 1, self.tokens + n
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX_ARROW)], schema=_INDEX_ARROW)


def write_records(docs: DataFrame, vocabulary: str | None = None, end: int = END_ID) -> str:
    """Writes the ids of docs into record files in a new folder of the shared folder; gives back its path.

    The documents of part 0 come before those of part 1, and within a part by number, in ascending doc_id order (null
    last, equal ids by a hash of their texts). Parts are ranges of doc_id and of that hash, so one doc_id with very
    many rows has several. A null or empty text has the end id only. A text of any length is one record, which its
    task holds. Other columns of docs are not read.
    """
    vocabulary = vocabulary or default_vocabulary()
    path = new_path(docs.sparkSession, "records")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, files = encoder(vocabulary), _Files(f"{path}/data")
        for batch in batches:
            ready, counts, size = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py()) + last
                ready.append(payload(key.as_py(), ids)), counts.append(len(ids) // 4)
                size += len(ids)
                if size >= BLOCK_BYTES:
                    yield files.write(ready, counts)
                    ready, counts, size = [], [], 0
            if ready:
                yield files.write(ready, counts)
        files.close()

    order = [F.col("doc_id").asc_nulls_last(), F.col("_tie")]
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("_tie", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.select(F.col("doc_id").cast("string").alias("key"), "text").mapInArrow(run, _INDEX).write.parquet(f"{path}/index")
    return path


def index_of(spark, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


def shuffled(index: DataFrame, seed: int) -> DataFrame:
    """The index in an order that the seed fixes: reading by it gives the records in random order, without moving them."""
    by = free_name(index, "_by")
    return index.withColumn(by, F.xxhash64(F.lit(seed), "part", "number")).repartitionByRange(by).sortWithinPartitions(by, "part", "number").drop(by)


def read_records(index: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """The records of the index rows, in their order: part, number, key, n_tokens, ids_crc32 and, if asked for, ids.

    Records that follow each other in a file are read together, up to BLOCK_BYTES. Checksums, lengths and the number
    of ids have to agree with the frame and the index, else it is an error. An empty index gives no rows.
    """
    fields = [("part", pa.int32()), ("number", pa.int64()), ("key", pa.string()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pyarrow.fs.FileSystem.from_uri(f"{path}/data")
        name, stream = None, None
        for batch in batches:
            part, number, file, offset, n_bytes, n_tokens = (batch.column(k).to_pylist() for k in range(6))
            at = 0
            while at < len(part):
                to, size = at + 1, n_bytes[at]
                while to < len(part) and file[to] == file[at] and offset[to] == offset[at] + size and size + n_bytes[to] <= BLOCK_BYTES:
                    size, to = size + n_bytes[to], to + 1
                if file[at] != name:
                    name, stream = file[at], system.open_input_file(f"{folder}/{file[at]}")
                stream.seek(offset[at])
                data, starts = stream.read(size), [o - offset[at] for o in offset[at:to]]
                records = [opened_payload(p) for p in opened_frames([data[s : s + n] for s, n in zip(starts, n_bytes[at:to])])]
                if [len(ids) // 4 for _, ids in records] != n_tokens[at:to]:
                    raise ValueError("records and index differ")
                columns = [part[at:to], number[at:to], [k for k, _ in records], n_tokens[at:to], [zlib.crc32(ids) for _, ids in records]]
                columns += [[np.frombuffer(ids, "<u4").astype(np.int64) for _, ids in records]] * keep_ids
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])
                at = to

    schema = "part int, number long, key string, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return index.select("part", "number", "file", "offset", "n_bytes", "n_tokens").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per row of docs, from files written and read back: doc_id, start, n_tokens and ids_crc32.

    start counts the ids of all documents before it; the driver adds up one sum a part. Repeated rows each have a
    row, a null doc_id stays null and comes last, an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = write_records(docs, vocabulary)
    index = index_of(spark, path)
    sums = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    before = spark.createDataFrame(starts, "part int, before long")
    placed = index.select("part", "number", "tokens_before").join(F.broadcast(before), "part").select("part", "number", (F.col("before") + F.col("tokens_before")).alias("start"))
    rows = read_records(index, path, keep_ids=False).join(placed, ["part", "number"])
    return rows.select(F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")
