"""License scans: an exact set-similarity join of license templates with the text blocks of documents.

A template goes with blocks of 64 words, or of the next power of two that is twice its length; blocks start
every half block, so every run of half a block lies in one. A template matches a block that holds at least its
threshold's share of the template's distinct words, whatever the template's length. Words are ordered by their frequency in the whole corpus, rarest first.
A matching block must hold one of the first |T| - need + 1 words of the template (prefix filter) and at least
`need` words of any template (length filter). From the first word that they share on, both the template and the
block, in that order, must have `need` words (positional filter: the block's place is what prunes, a prefix word
leaves enough of the template by itself). What passes is counted exactly. The templates are a bounded set, so
they travel with the tasks: no text is shuffled.

Every block that meets the threshold is a match. Whether it names the license is a check of its own: the share of the
template that stands there in the template's order has to meet the threshold too, and the template's telling words, in
which licenses of one family differ, have to be there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import text_of

BLOCK = 64
THRESHOLD = 0.8
#: Phrases whose words have to stand consecutively, and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Labels, templates of common license notices, and telling words (fixed values, in words of the public license texts).
TEMPLATES = (
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the apache license version 2.0", "apache"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser"),
    ("agpl", "licensed under the gnu affero general public license", "affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla"),
    ("cc-by-4.0", "licensed under creative commons attribution 4.0 international license", "attribution"),
    ("cc-by-sa", "licensed under cc by sa 4.0", "sa"),
    ("cc-by-nc", "licensed under cc by nc 4.0", "nc"),
    ("cc-by-nd", "licensed under cc by nd 4.0", "nd"),
    ("cc0", "released under cc0 1.0 universal public domain dedication", "cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
#: A-Z to a-z; 0-9, a-z and all bytes of characters from 0x80 on stay; the rest separates words.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Template:
    """A template's distinct words in the global order, the overlap that it needs, and its size of blocks."""

    def __init__(self, label: str, words: list[bytes], threshold: float, frequency: dict[bytes, int], phrase: bool = False, telling: tuple[bytes, ...] = ()):
        self.label, self.sequence, self.phrase, self.threshold, self.telling = label, words, phrase, threshold, frozenset(telling)
        self.words = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        self.need = len(self.words) if phrase else -(-len(self.words) * round(threshold * 1000) // 1000)
        self.prefix = self.words[: len(self.words) - self.need + 1]
        self.block = max(BLOCK, 1 << (2 * len(words) - 1).bit_length())
        self.places: dict[bytes, int] = {}
        for at, w in enumerate(words):
            self.places[w] = self.places.get(w, 0) | 1 << at

    def in_order(self, words: list[bytes]) -> float:
        """The longest common subsequence of the template and some words, as a share of the template: one bit a template word."""
        whole = (1 << len(self.sequence)) - 1
        free = whole
        for w in words:
            if mask := self.places.get(w, 0) & free:
                free = (free + mask | free & ~mask) & whole
        return 1 - free.bit_count() / len(self.sequence)

    def named(self, words: list[bytes]) -> bool:
        return self.telling.issubset(words) and self.in_order(words) >= self.threshold


def global_frequencies(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How often each of the words (those of the templates, a fixed number) stands in the corpus."""
    wanted = frozenset(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(wanted.intersection(words_of(text.as_py())))
        yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(text_of().alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counts.collect()}


class Templates:
    """All templates, their words' places in the global order, and by size of blocks which ones a prefix word belongs to."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int]):
        self.all = templates
        order = sorted({w for t in templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(order)}
        self.phrases: dict[bytes, list[Template]] = {}
        self.by_block: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for k, t in enumerate(templates):
            for i, w in enumerate(t.prefix):
                if t.phrase:
                    self.phrases.setdefault(w, []).append(t)
                else:
                    self.by_block.setdefault(t.block, {}).setdefault(w, []).append((k, i))
        self.wanted = frozenset(self.phrases).union(*self.by_block.values())


def block_matches(own: list[bytes], templates: Templates, prefixes: dict[bytes, list[tuple[int, int]]], pruned: list[int] | None = None) -> list[tuple[int, int]]:
    """(template, overlap) of the templates that a block holds; own: its template words in the global order.

    pruned: counts what the length filter and the positional filter leave out.
    """
    held, seen, found = set(own), set(), []
    for j, w in enumerate(own):
        for k, i in prefixes.get(w, ()):
            if k in seen:
                continue
            seen.add(k)  # w is the first word that the two share
            t = templates.all[k]
            if len(own) < t.need:  # length filter
                which = 0
            elif min(len(t.words) - i, len(own) - j) < t.need:  # positional filter
                which = 1
            else:
                overlap = len(held.intersection(t.words))
                if overlap >= t.need:
                    found.append((k, overlap))
                continue
            if pruned is not None:
                pruned[which] += 1
    return found


def scan(words: list[bytes], templates: Templates):
    """(starts of phrases by label, [(label, first word of the block, containment, named)]) of a document's words."""
    hits: dict[bytes, list[int]] = {}
    wanted = templates.wanted
    for at, w in enumerate(words):
        if w in wanted:
            hits.setdefault(w, []).append(at)
    starts, found = {}, []
    for w, places in hits.items():
        for t in templates.phrases.get(w, ()):  # a phrase's rarest word alone is its prefix: the others must stand around it
            shift, n = t.sequence.index(w), len(t.sequence)
            own = [at - shift for at in places if at >= shift and words[at - shift : at - shift + n] == t.sequence]
            if own:
                starts.setdefault(t.label, []).extend(own)
    for block, prefixes in templates.by_block.items():
        step = block // 2
        last = max(0, (len(words) - 1) // step)
        blocks = {b for w, places in hits.items() if w in prefixes for at in places for b in (max(0, at // step - 1), min(last, at // step))}
        for b in sorted(blocks):
            own = sorted({w for w in words[b * step : b * step + block] if w in templates.order}, key=templates.order.__getitem__)
            for k, n in block_matches(own, templates, prefixes):
                t = templates.all[k]
                found.append((t.label, b * step, n / len(t.words), t.named(words[b * step : b * step + block])))
    return starts, found


def scanned(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, phrases (label, start) and blocks (label, start, containment, named).

    templates: (label, text) or (label, text, telling words), a bounded set that travels with the tasks. A null or empty text has no words;
    a text of any length is scanned whole, block by block. Repeated rows each have a row, a null doc_id stays
    null, an empty table gives no rows. Other columns of docs are not read, so their names may clash.
    """
    vocabulary = sorted({w for t in templates for w in words_of(t[1])} | {w for p in PHRASES for w in words_of(p)})
    frequency = global_frequencies(docs, vocabulary)
    known = [Template(label, words_of(p), 1.0, frequency, True) for p, label in PHRASES.items()]
    known += [Template(label, words_of(text), threshold, frequency, telling=tuple(words_of(" ".join(telling)))) for label, text, *telling in templates]
    ready = Templates(known, frequency)
    place = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    block = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("containment", pa.float64()), ("named", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, phrases, blocks = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                starts, found = scan(words, ready)
                n.append(len(words))
                phrases.append(sorted(({"label": k, "start": s} for k, own in starts.items() for s in own), key=lambda r: (r["start"], r["label"])))
                blocks.append([{"label": a, "start": s, "containment": c, "named": d} for a, s, c, d in sorted(found)])
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(phrases, place), pa.array(blocks, block)], names=["doc_id", "n_words", "phrases", "blocks"])

    schema = "doc_id long, n_words long, phrases array<struct<label: string, start: long>>, blocks array<struct<label: string, start: long, containment: double, named: boolean>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)
