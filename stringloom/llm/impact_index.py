"""Ranked lexical search by a bit-sliced impact index.

What a term adds to a document's score is a whole number, its impact. A block of documents holds, for each term of
the searched items, one bitmap for each binary digit of the impacts: bit d of slice b is digit b of what the term adds to
document d. The scores of all documents of a block for an item come from adding its terms' slices with bitwise carry
arithmetic, 64 documents a machine word and many items at once; its best documents come from walking the sums' slices
from the most significant one down: documents that have the digit are taken while they are no more than wanted, else
those without it leave. A task merges its blocks' best rows, and one ranking of these rows gives the result.

Texts are read once for each block of items; a posting list of each document (terms of the items and how often they
occur) is written to the shared folder, from which the counts and the blocks come.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stringloom.llm.common import text_of, written

TOP = 50
#: Bytes of the items' texts that are searched in one pass over the documents: what a task is given.
ITEM_BYTES = 4 << 20
#: Documents of a block, and bytes of its slices at most (a block has fewer documents where it has many terms).
BLOCK_DOCS, SLICE_BYTES = 4096, 48 << 20
#: Items whose sums are made at once.
ITEMS = 256
#: Bytes of a text that are cut into terms at once.
TEXT_BYTES = 1 << 20

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLDED = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def term_counts(text: bytes) -> Counter:
    """The terms of a text (UTF-8) and how often they occur."""
    folded, counts, at = text.translate(_FOLDED), Counter(), 0
    while at < len(folded):
        to = folded.find(b" ", at + TEXT_BYTES) if len(folded) - at > TEXT_BYTES else -1
        to = len(folded) if to < 0 else to
        counts.update(folded[at:to].split())
        at = to
    return counts


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per document with a term: doc_id, n (its terms with repeats), terms (numbers of the vocabulary) and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            columns = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(text.as_py())
                if counts:
                    found = [(k, c) for t, c in counts.items() if (k := number(t)) is not None]
                    for column, value in zip(columns, (doc_id, counts.total(), [k for k, _ in found], [c for _, c in found])):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


class Block:
    """The slices of a block of documents: `slices[t, b]` is the bitmap of digit b of what term t adds; the last t stands for no term."""

    def __init__(self, document: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int):
        use = np.flatnonzero(impact > 0)
        use = use[np.lexsort((document[use], term[use]))]
        document, term, impact = document[use], term[use], impact[use]
        self.terms, of = np.unique(term, return_inverse=True)
        self.words, self.digits = max(1, -(-n_docs // 64)), int(impact.max(initial=0)).bit_length()
        self.slices = np.zeros((len(self.terms) + 1, self.digits, self.words), np.uint64)
        if len(use):
            place = of * self.words + document // 64
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            bit, (row, word) = (document % 64).astype(np.uint64), np.divmod(place[first], self.words)
            for b in range(self.digits):
                digit = (impact >> b & 1).astype(np.uint64) << bit
                self.slices[row, b, word] = np.bitwise_or.reduceat(digit, first)

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """The rows of slices of those of the terms that the block has."""
        at = np.searchsorted(self.terms, terms)
        return at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]


def added(block: Block, rows: list[np.ndarray]) -> np.ndarray:
    """The slices (digit, item, word) of the sums over each item's rows: an adder that carries from digit to digit."""
    most = max(map(len, rows), default=0)
    table = np.full((most, len(rows)), len(block.terms))
    for k, own in enumerate(rows):
        table[: len(own), k] = own
    sums = np.zeros((block.digits + most.bit_length(), len(rows), block.words), np.uint64)
    for step in table:
        more = block.slices[step]
        carry = np.zeros(sums.shape[1:], np.uint64)
        for b, have in enumerate(sums):
            if b < block.digits:
                add = more[:, b]
                both = have ^ add
                over = (have & add) | (carry & both)
                np.bitwise_xor(both, carry, out=have)
                carry = over
            elif carry.any():
                over = have & carry
                have ^= carry
                carry = over
            else:
                break
    return sums


def best(sums: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (item, word) of the documents that surely are among an item's best, and of those that tie for the places left."""
    sure = np.zeros(sums.shape[1:], np.uint64)
    open_ = np.bitwise_or.reduce(sums, axis=0) if len(sums) else sure.copy()
    n_sure = np.zeros(len(sure), np.int64)
    for digit in sums[::-1]:
        have = open_ & digit
        n = np.bitwise_count(have).sum(axis=1, dtype=np.int64)
        take = n_sure + n <= top
        sure[take] |= have[take]
        n_sure[take] += n[take]
        open_ = np.where(take[:, None], open_ & ~digit, have)
    open_[n_sure >= top] = 0
    return sure, open_


def _positions(bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, document) of the bits that are set."""
    item, word = np.nonzero(bitmap)
    bits = np.unpackbits(bitmap[item, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return item[which], word[which] * 64 + bit


def _scores(sums: np.ndarray, item: np.ndarray, document: np.ndarray) -> np.ndarray:
    out = np.zeros(len(item), np.int64)
    for b, digit in enumerate(sums):
        out |= (digit[item, document // 64] >> (document % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << b
    return out


def _kept(rows: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Of rows (item, score, no id, id) the best of each item, in order."""
    item, score, no_id, key = rows
    order = np.lexsort((key, no_id, -score, item))
    item = item[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    order = order[place < top]
    return [r[order] for r in rows]


def best_of_block(block: Block, items: list[np.ndarray], ids: np.ndarray, no_id: np.ndarray, top: int) -> list[np.ndarray]:
    """Rows (item, score, no id, id) of the block's best documents for each item."""
    rows = [block.rows(t) for t in items]
    order = sorted((k for k in range(len(items)) if len(rows[k])), key=lambda k: len(rows[k]))
    found = []
    for s in range(0, len(order), ITEMS):
        own = order[s : s + ITEMS]
        sums = added(block, [rows[k] for k in own])
        for bitmap in best(sums, top):
            item, document = _positions(bitmap)
            found.append([np.array(own)[item], _scores(sums, item, document), no_id[document], ids[document]])
    return _kept([np.concatenate(c) for c in zip(*found)], top) if found else [np.zeros(0, np.int64)] * 4


def impacts(weight: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What terms of these weights add to documents that hold them `count` times, at their documents' length norms."""
    return weight * ((1_000_000_000 * count) // (1000 * count + 20 * length))


def _search(batches: Iterator[pa.RecordBatch], items: list[np.ndarray], names: list, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> Iterator[pa.RecordBatch]:
    have: list[list[np.ndarray]] = []

    def merged(rows: list[np.ndarray]) -> None:
        have.append(rows)
        if sum(len(r[0]) for r in have) > 8 * top * len(items):
            have[:] = [_kept([np.concatenate(c) for c in zip(*have)], top)]

    for batch in batches:
        ids, n, terms, counts = (batch.column(k) for k in range(4))
        ends, term, count = terms.offsets.to_numpy(), terms.flatten().to_numpy(), counts.flatten().to_numpy()
        ends = ends - ends[0]
        # 64-bit, but the product of three counts in whole numbers of any size
        norm = np.array([50 + (50 * x * n_docs) // n_terms for x in n.to_pylist()], np.int64)
        no_id, key = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        at = 0
        while at < len(norm):
            to = min(len(norm), at + BLOCK_DOCS)
            while to - at > 64 and len(np.unique(term[ends[at] : ends[to]])) * -(-(to - at) // 64) * 8 * 36 > SLICE_BYTES:
                to = at + (to - at) // 2
            own = slice(ends[at], ends[to])
            document = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
            block = Block(document, term[own], impacts(weights[term[own]], count[own], norm[at:to][document]), to - at)
            merged(best_of_block(block, items, key[at:to], no_id[at:to], top))
            at = to
    if have:
        item, score, no_id, key = _kept([np.concatenate(c) for c in zip(*have)], top)
        for s in range(0, len(item), 10_000):
            part = slice(s, s + 10_000)
            yield pa.record_batch([
                pa.array(item[part], pa.int64()), pa.array([names[k] for k in item[part]], pa.int64()), pa.array(key[part], pa.int64(), mask=no_id[part].astype(bool)), pa.array(score[part], pa.int64()),
            ], names=["item", "item_id", "doc_id", "score"])


def _found(docs: DataFrame, items: list[tuple[int | None, bytes]], top: int, block: int) -> DataFrame:
    """Ranked rows of one block of items."""
    texts = [sorted(term_counts(t)) for _, t in items]
    vocabulary = {t: k for k, t in enumerate(sorted(set().union(*texts)))}
    rows = written(postings(docs, vocabulary), "postings")
    totals = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # no more rows than the items have terms
        weights[r["term"]] = math.floor(1000 * math.log((2 * totals["n_docs"] + 2) / (2 * r["count"] + 1)))
    own, names = [np.array([vocabulary[t] for t in x], np.int64) for x in texts], [i for i, _ in items]
    found = rows.mapInArrow(lambda it: _search(it, own, names, weights, totals["n_docs"], totals["n_terms"], top), "item long, item_id long, doc_id long, score long")
    return found.withColumn("block", F.lit(block))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    out, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), text_of().cast("binary").alias("text")).toLocalIterator():
        text = bytes(r["text"])
        if out and size + len(text) > ITEM_BYTES:
            yield out
            out, size = [], 0
        out.append((r["item_id"], text))
        size += len(text)
    if out:
        yield out


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` highest-scoring documents of each row of items; equal scores rank by doc_id.

    Items are searched in blocks of ITEM_BYTES of text, each in a pass over all documents, so neither a task nor the
    driver holds more of them; a longer item is a block by itself. Each row of items is an item of its own, also if
    item_ids repeat; an item without terms (or null) has no rows. Null and empty texts of docs have no terms and don't
    count; repeated rows are documents of their own; a null doc_id ranks behind equal scores with one. Without
    documents or items there are no rows. Only doc_id, item_id and text are read.
    """
    found = [_found(docs, block, top, k) for k, block in enumerate(_blocks(items))]
    rows = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item long, item_id long, doc_id long, score long, block int")
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
