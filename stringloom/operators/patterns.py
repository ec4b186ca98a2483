"""Patterns in aligned texts with a number of mismatches, over gaps and in all directions.

Each text is scanned once a pattern by a bit-parallel automaton over all its places at once: a bit mask for each
letter says where it stands; shifted by a letter's place in the pattern, the masks of the letters that do not fit are
counted in as many bit masks as mismatches are allowed. The work is linear in the text, in machine words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stringloom.operators.intervals import DNA, DNA_COMPLEMENT


@dataclass(frozen=True)
class Options:
    """What counts as equal, and in which directions patterns are searched.

    With `exact` only the given combination of complement and reverse is searched, without it also the plain pattern and each of
    the two alone.
    """

    least: int = 0
    most: int = 0
    gaps_in_text: bool = True
    gaps_in_pattern: bool = True
    t_is_u: bool = True
    ignore_case: bool = True
    complement: bool = False
    reverse: bool = False
    exact: bool = False
    gaps: str = "-."


def pattern_list(text: str) -> list[tuple[str, str]]:
    """(pattern, comment) of a text with patterns separated by line ends or commas; a comment goes from # to the line's end."""
    out = []
    for line in text.split("\n"):
        patterns, _, comment = line.partition("#")
        out += [(p.strip(), comment.strip()) for p in patterns.split(",") if p.strip()]
    return out


def _folded(text: str, options: Options) -> str:
    text = "".join(c.lower() if len(c.lower()) == 1 else c for c in text) if options.ignore_case else text
    return text.replace("T", "U").replace("t", "u") if options.t_is_u else text


def variants(pattern: str, options: Options) -> list[tuple[bool, bool, str]]:
    """(complement, reverse, pattern as it is compared) of each direction."""
    if options.gaps_in_pattern:
        pattern = "".join(c for c in pattern if c not in options.gaps)
    asked = [(options.complement, options.reverse)] if options.exact else [(c, r) for c in (False, True)[: 1 + options.complement] for r in (False, True)[: 1 + options.reverse]]
    out = []
    for complement, reverse in asked:
        own = pattern.translate(str.maketrans(DNA, DNA_COMPLEMENT)) if complement else pattern
        out.append((complement, reverse, _folded(own[::-1] if reverse else own, options)))
    return out


def places(masks: dict[str, int], n: int, pattern: str, least: int, most: int) -> tuple[int, list[int]]:
    """A bit mask of the places at which the pattern stands with least to most mismatches, and masks of more than 0, 1, ... mismatches.

    masks: of each letter the places at which it stands in a text of n letters.
    """
    whole = (1 << max(0, n - len(pattern) + 1)) - 1
    over = [0] * (most + 1)
    for at, letter in enumerate(pattern):
        if letter == "?":
            continue
        miss = whole & ~(masks.get(letter, 0) >> at)
        for k in range(most, 0, -1):
            over[k] |= over[k - 1] & miss
        over[0] |= miss
    hits = whole & ~over[most]
    return (hits & over[least - 1] if least else hits), over


def _set_bits(mask: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


def _hits(text: str, patterns: list[list[tuple[bool, bool, str]]], options: Options) -> Iterator[tuple]:
    """(pattern number, complement, reverse, start, stop, mismatches), places from 1 in the text with its gaps."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.flatnonzero(~np.isin(codes, [ord(c) for c in options.gaps])) if options.gaps_in_text else np.arange(len(codes))
    bare, n = codes[at], len(at)
    folded = np.frombuffer(_folded(bare.tobytes().decode("utf-32-le"), options).encode("utf-32-le"), np.uint32)
    letters = {c for own in patterns for _, _, p in own for c in p if c != "?"}
    masks = {c: int.from_bytes(np.packbits(folded == ord(c), bitorder="little").tobytes(), "little") for c in letters}
    for number, own in enumerate(patterns):
        for complement, reverse, pattern in own:
            if not pattern or len(pattern) > n:
                continue
            hits, over = places(masks, n, pattern, options.least, options.most)
            if hits:
                found = _set_bits(hits, n)
                count = sum(np.isin(found, _set_bits(o & hits, n)).astype(np.int32) for o in over[:-1]) if options.most else np.zeros(len(found), np.int32)
                yield from ((number, complement, reverse, int(at[f]) + 1, int(at[f + len(pattern) - 1]) + 1, int(c)) for f, c in zip(found, count))


def pattern_hits(items: DataFrame, key: str, data: str, patterns: str, options: Options = Options()) -> DataFrame:
    """key, pattern, comment, complement, reverse, start, stop and mismatches of all places of the patterns (see pattern_list).

    ? in a pattern is any letter. start and stop count the text's own characters, its gaps too. All places count, also
    those that overlap. Patterns longer than a text, and null and empty texts, have no place.
    """
    listed = pattern_list(patterns)
    compared = [variants(p, options) for p, _ in listed]
    arrow = items.select(key).limit(0).toArrow().schema.field(key).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, text in zip(batch.column(0), batch.column(1)):
                rows = list(_hits(text.as_py(), compared, options)) if text.is_valid else []
                for s in range(0, len(rows), 10_000):
                    number, complement, reverse, start, stop, count = (list(c) for c in zip(*rows[s : s + 10_000]))
                    columns = [(pa.array([own.as_py()] * len(number), arrow), key), ([listed[k][0] for k in number], "pattern"), ([listed[k][1] for k in number], "comment"), (complement, "complement"), (reverse, "reverse"), (pa.array(start, pa.int32()), "start"), (pa.array(stop, pa.int32()), "stop"), (pa.array(count, pa.int32()), "mismatches")]
                    yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c, _ in columns], names=[n for _, n in columns])

    kind = items.schema[key].dataType.simpleString()
    return items.select(key, F.col(data)).mapInArrow(run, f"`{key}` {kind}, pattern string, comment string, complement boolean, reverse boolean, start int, stop int, mismatches int")
