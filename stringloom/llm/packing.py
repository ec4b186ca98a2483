"""Best-fit packing of tokenised documents into sequences of fixed length, in bulk-synchronous rounds.

Pieces go by ranges of length, longest first, one round each. In a round the pieces of the range and all gaps
that are left are dealt out to tasks by hashes of their numbers and range-sorted there; every task sweeps its
pieces over its gaps. A piece takes its successor, the smallest gap that holds it; of pieces that want the same
gap the one of the higher rank (longer, then smaller number) gets it, the others go on to the next; without a
gap a new sequence opens. Filled gaps move to their new size at once. At the end of a round the gaps are written
and dealt out anew, so that what one task could not use another one can, and the next range follows.
A task holds the gaps of one deal, about SHARE rows, whatever the input; the driver gets one count.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stringloom.llm.common import free_name, text_of, written

CAPACITY = 2048
END_ID = 0
#: The vocabulary's added token; its id is the first behind the ranks.
END_OF_TEXT = "<|endoftext|>"
#: Pieces of one deal: what a task packs by itself in a round. Its gaps are no more than that in the mean.
SHARE = 20_000
#: A round takes the lengths down to this part of the longest ones before.
NARROWER = 4


def load_encoding(ranks_file: bytes):
    """The byte-level BPE whose ranks are given, and its added token behind them."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


_encodings: dict[str, object] = {}


def encoder(vocabulary: str, added: bool = False):
    """text to its ids (little-endian unsigned 32-bit); the vocabulary is read once a worker.

    The added token's string in a text is ordinary text, or with `added` the added token.
    """
    if vocabulary not in _encodings:
        with open(vocabulary, "rb") as f:
            _encodings[vocabulary] = load_encoding(f.read())
    encoding = _encodings[vocabulary]
    allowed = {END_OF_TEXT} if added else set()
    return lambda text: encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4", copy=False)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones of the capacity after a first one that may be shorter."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of docs: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Ids are those of the tokenizer's own call, which makes END_OF_TEXT in a text the added token. Each row's ids end
    with END_ID; a null or empty text has that id only. A text of any length is encoded whole and then cut. Repeated
    rows are pieces of their own, a null doc_id stays null, an empty table gives no pieces. Other columns are not read.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, added=True)
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.append(encode(text.as_py()), np.uint32(END_ID)).astype("<u4", copy=False)
                for k, (s, n) in enumerate(cuts(len(tokens), capacity)):
                    doc.append(doc_id), piece.append(k), start.append(s), length.append(n)
                    crc.append(zlib.crc32(tokens[s : s + n]))
                    if keep_ids:
                        ids.append(tokens[s : s + n].astype(np.int32))
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


class Gaps:
    """Sequences by the room that is left in them."""

    def __init__(self, capacity: int):
        self.capacity, self.by_size, self.sizes = capacity, [[] for _ in range(capacity + 1)], []

    def add(self, size: int, sequence: int) -> None:
        if not size:
            return
        if not self.by_size[size]:
            bisect.insort(self.sizes, size)
        self.by_size[size].append(sequence)

    def successor(self, length: int) -> tuple[int, int] | None:
        """(size, sequence) of the smallest gap that holds the length, which is taken out; None without one."""
        at = bisect.bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        size = self.sizes[at]
        sequence = self.by_size[size].pop()
        if not self.by_size[size]:
            del self.sizes[at]
        return size, sequence

    def rest(self) -> list[tuple[int, int]]:
        return [(size, sequence) for size in self.sizes for sequence in self.by_size[size]]


def sweep(batches: Iterator[pa.RecordBatch], capacity: int, first_new: int, step_new: int) -> Iterator[pa.RecordBatch]:
    """Rows (deal, is_piece, size, number), sorted so with pieces by falling size, to rows (is_piece, number, sequence_id, place).

    For a piece: its number, its sequence and its offset there. For what is left of a gap at the end of a deal:
    null, the sequence and the gap's size. New sequences of deal d are d + first_new, then step_new further each.
    """
    schema = pa.schema([("is_piece", pa.bool_()), ("number", pa.int64()), ("sequence_id", pa.int64()), ("place", pa.int64())])
    gaps, deal, new = Gaps(capacity), None, 0

    def out(numbers, found, places, rest):
        n, k = len(numbers), len(rest)
        columns = [[True] * n + [False] * k, numbers + [None] * k, found + [q for _, q in rest], places + [g for g, _ in rest]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        numbers, found, places, rest = [], [], [], []
        for of, is_piece, size, number in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if of != deal:
                rest += gaps.rest()
                gaps, deal, new = Gaps(capacity), of, of + first_new
            if not is_piece:
                gaps.add(size, number)
                continue
            gap = gaps.successor(size)
            if gap is None:
                gap, new = (capacity, new), new + step_new
            room, sequence = gap
            gaps.add(room - size, sequence)
            numbers.append(number), found.append(sequence), places.append(capacity - room)
        yield out(numbers, found, places, rest)
    yield out([], [], [], gaps.rest())


def ranges(capacity: int) -> list[tuple[int, int]]:
    """(shortest, longest) length of each round, longest first."""
    out, longest = [], capacity
    while longest:
        out.append((longest // NARROWER + 1, longest))
        longest //= NARROWER
    return out


def packed(pieces: DataFrame, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """pieces with sequence_id and offset; they need a column length from 1 to the capacity.

    pieces are written to the shared folder, since every round must see the same rows. Sequences are numbered
    from 0 without gaps, and filled from offset 0 without gaps. Equal lengths rank by the rows' numbers, so
    repeated rows have places of their own, and a lost task packs its deals again in the same way. Columns of
    pieces called sequence_id or offset are an error; an empty table gives no rows. Packing by deals opens at
    most about one sequence a deal, which is one for each `share` pieces, more than one best fit over all would.
    """
    number, spark = free_name(pieces, "_number"), pieces.sparkSession
    parted = written(pieces.withColumn(number, F.monotonically_increasing_id()), "pack-pieces")
    deals, steps = parted.count() // share + 1, ranges(capacity)
    narrow = parted.select(F.lit(True).alias("is_piece"), F.col("length").alias("size"), F.col(number).alias("number"))
    gaps = spark.createDataFrame([], "is_piece boolean, size long, number long")
    placed = None
    for step, (shortest, longest) in enumerate(steps):
        rows = narrow.filter(F.col("size").between(shortest, longest)).unionByName(gaps)
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("number", "is_piece", F.lit(step)), F.lit(deals)))
        dealt = dealt.select("deal", "is_piece", F.col("size").cast("long").alias("size"), "number")
        sorted_rows = dealt.repartition("deal").sortWithinPartitions("deal", "is_piece", F.desc("size"), "number")
        first_new, step_new = step * deals, len(steps) * deals
        swept = written(sorted_rows.mapInArrow(lambda it, a=first_new, b=step_new: sweep(it, capacity, a, b), "is_piece boolean, number long, sequence_id long, place long"), "pack-round")
        gaps = swept.filter("not is_piece").select("is_piece", F.col("place").alias("size"), F.col("sequence_id").alias("number"))
        own = swept.filter("is_piece").select(F.col("number").alias(number), "sequence_id", F.col("place").alias("offset"))
        placed = own if placed is None else placed.unionByName(own)
    # a sequence's number is (how many its deal opened before it, round, deal); a deal's ones are moved behind those of the deals before it
    opener, turn = F.pmod("sequence_id", F.lit(len(steps) * deals)), F.call_function("div", F.col("sequence_id"), F.lit(len(steps) * deals))
    opened = placed.groupBy(opener.alias("_opener")).agg((F.max(turn) + 1).alias("_n"))
    before = opened.withColumn("_before", F.sum("_n").over(Window.orderBy("_opener")) - F.col("_n")).drop("_n")
    numbered = placed.withColumn("_opener", opener).join(before, "_opener").select(number, (F.col("_before") + turn).alias("sequence_id"), "offset")
    return parted.join(numbered, number).select(*pieces.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """Placed pieces with ids to whole sequences: sequence_id and ids. A sequence has at most `capacity` ids."""
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
