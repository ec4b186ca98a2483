"""Secondary structure of proteins from propensities: nucleation windows, extension both ways, turns, overlaps.

Many texts are settled at once, as one array of letters. Those that are longer than a block are cut into blocks of
residues, each with the ends of its neighbours, so that windows are settled within a block. How far an extension
goes depends on what lies before it in the whole text; of a block it is enough to know its last site or stop in either
direction, so the extensions are a prefix scan over the blocks. What comes out are runs of one structure; those that
reach an end of a block with a neighbour are merged with what they meet there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from stringloom.operators.storage import before, stored

# The published propensities of residues, in hundredths: helix former, strand former, helix breaker, strand breaker.
PROPENSITIES = {
    "A": (134, 0, 0, 0), "R": (0, 0, 0, 0), "D": (50, 0, 0, 139), "N": (0, 0, 103, 0), "C": (0, 113, 0, 0),
    "E": (142, 0, 0, 203), "Q": (105, 105, 0, 0), "G": (0, 0, 121, 100), "H": (50, 0, 0, 0), "I": (102, 152, 0, 0),
    "L": (114, 124, 0, 0), "K": (109, 0, 0, 101), "M": (137, 100, 0, 0), "F": (107, 131, 0, 0), "P": (0, 0, 121, 136),
    "S": (0, 0, 0, 100), "T": (0, 113, 0, 0), "W": (102, 130, 0, 0), "Y": (0, 140, 100, 0), "V": (100, 162, 0, 0),
}
# Helix, strand and turn in hundredths, then the frequencies at the four places of a turn in thousandths.
TURNS = {
    "A": (142, 83, 66, 60, 76, 35, 58), "R": (98, 93, 95, 70, 106, 99, 85), "D": (101, 54, 146, 147, 110, 179, 81),
    "N": (67, 89, 156, 161, 83, 191, 91), "C": (70, 119, 119, 149, 50, 117, 128), "E": (151, 37, 74, 56, 60, 77, 64),
    "Q": (111, 110, 98, 74, 98, 37, 98), "G": (57, 75, 156, 102, 85, 190, 152), "H": (100, 87, 95, 140, 47, 93, 54),
    "I": (108, 160, 47, 43, 34, 13, 56), "L": (121, 130, 59, 61, 25, 36, 70), "K": (116, 74, 101, 55, 115, 72, 95),
    "M": (145, 105, 60, 68, 82, 14, 55), "F": (113, 138, 60, 59, 41, 65, 65), "P": (57, 55, 152, 102, 301, 34, 68),
    "S": (77, 75, 143, 120, 139, 125, 106), "T": (83, 119, 96, 86, 108, 65, 79), "W": (108, 137, 96, 77, 13, 64, 167),
    "Y": (69, 147, 114, 82, 65, 114, 125), "V": (106, 170, 50, 62, 48, 28, 53),
}
#: Of helix and strand: residues of a window, those that break an extension by themselves, with another one, and those that break it behind one.
WINDOWS, STOPPERS, BREAKERS, INDIFFERENT = (6, 5), ("P", "PE"), ("NYPG", "PDESGK"), ("RTSC", "RNHA")
#: A turn's window, and its least product of frequencies in millionths.
TURN, LEAST_TURN = 4, 75
#: Residues of its neighbours that a block needs on each side, and letters that stand between blocks.
_HALO = 8
#: Letters that are settled at once, or one block.
_AT_ONCE = 1 << 17
_LETTERS = "".join(PROPENSITIES)
_PAD = "\0" * _HALO


def _table(values: dict[str, int], other: int = 0) -> bytes:
    """Of each byte its letter's value, for bytes.translate."""
    return bytes(values.get(chr(b), other) for b in range(256))


# unknown letters have the number behind the last letter's, and no values
_CODES = _table({c: i for i, c in enumerate(_LETTERS)}, len(_LETTERS))
_KNOWN = _table(dict.fromkeys(_LETTERS, 1))
_FORMERS, _BREAKS = ([_table({c: v[i + s] for c, v in PROPENSITIES.items()}) for s in (0, 1)] for i in (0, 2))
_SUMS = [_table({c: v[i] for c, v in TURNS.items()}) for i in range(3)]
_PRODUCTS = [np.array([*(v[3 + i] for v in TURNS.values()), 0]) for i in range(TURN)]
_HAS = {letters: _table(dict.fromkeys(letters, 1)) for s in (0, 1) for letters in (STOPPERS[s], BREAKERS[s], BREAKERS[s] + INDIFFERENT[s])}


def _ahead(values: np.ndarray, size: int, put=np.add) -> np.ndarray:
    """The values of the next `size` places, put together."""
    out = values.astype(np.uint16) if put is np.add else values.copy()
    for i in range(1, size):
        put(out[:-i], values[i:], out=out[:-i])
    return out


class _Blocks:
    """Residues of blocks and of their neighbours' ends in one array, with letters that belong to none between them.

    Blocks are (left, chunk, right, start, n): start is the place of chunk in its text, n the text's length.
    """

    def __init__(self, blocks: list[tuple]):
        text = _PAD + "".join(f"{left}{chunk}{right}{_PAD}" for left, chunk, right, *_ in blocks)
        self._raw = text.encode() if text.isascii() else np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127).astype(np.uint8).tobytes()
        lengths = np.array([(len(left), len(chunk), len(right), _HALO) for left, chunk, right, *_ in blocks])
        begins = _HALO + np.append(0, lengths.sum(1).cumsum()[:-1])
        self._begins, self._ends = begins, begins + lengths[:, :3].sum(1)
        self.firsts = begins + lengths[:, 0]
        self.stops_before = self.firsts + lengths[:, 1]
        start, n = (np.array([b[i] for b in blocks]) for i in (3, 4))
        #: where the texts' place 0 would stand, and whether blocks have neighbours
        self.zeros, self.has_left, self.has_right = self.firsts - start, start > 0, start + lengths[:, 1] < n
        self._over = self.zeros + n
        parts = np.concatenate([[_HALO], lengths.ravel()])
        self._inside = np.repeat(np.append(False, np.tile([True, True, True, False], len(blocks))), parts)
        self._own = np.repeat(np.append(False, np.tile([False, True, False, False], len(blocks))), parts)
        self.codes, self.known = self._of(_CODES), self._of(_KNOWN).view(bool)
        self._index = np.arange(len(self.codes), dtype=np.int32)
        gaps = np.flatnonzero(~self.known)
        before = np.diff(gaps, prepend=-1) - 1
        found = self._inside[gaps] & (before > 0)
        #: unknown letters behind known ones, and the number of these
        self._gaps, self._before = gaps[found], before[found]

    def _of(self, table: bytes) -> np.ndarray:
        return np.frombuffer(self._raw.translate(table), np.uint8)

    def _at(self, firsts: np.ndarray, count: int) -> np.ndarray:
        """`count` places from each block's first on, those that are the block's."""
        places = firsts[:, None] + np.arange(count)
        return places[(places >= self._begins[:, None]) & (places < self._ends[:, None])]

    def _in_windows(self, size: int, whole: np.ndarray, good) -> np.ndarray:
        """Places that a good window covers: one of `size` known residues (whole), or those that are left of one before an unknown letter."""
        covered = whole.copy()
        for i in range(1, size):
            covered[i:] |= whole[:-i]
        late = ~self._inside
        late[self._at(self._over - size + 1, size - 1)] = True
        k = np.minimum(self._before, size - 1)
        kept = ~late[self._gaps - k]
        k, starts = k[kept], self._gaps[kept] - k[kept]
        found = good(starts, k)
        k, starts = k[found], starts[found]
        for i in range(size - 1):
            covered[starts[k > i] + i] = True
        return covered

    def sites(self, s: int) -> np.ndarray:
        size, former, breaker = WINDOWS[s], self._of(_FORMERS[s]), self._of(_BREAKS[s])
        test = lambda formers, breakers: (formers > 100 * (size - 2)) & (breakers < 200)
        total = lambda values, at, k: sum(np.where(k > i, values[at + i], 0).astype(np.uint16) for i in range(size - 1))
        whole = _ahead(self.known, size, np.logical_and) & test(_ahead(former, size), _ahead(breaker, size))
        return self._in_windows(size, whole, lambda at, k: test(total(former, at, k), total(breaker, at, k)))

    def turns(self) -> np.ndarray:
        values = [self._of(t) for t in _SUMS]
        test = lambda helix, strand, turn, k: (turn > 100 * k) & (turn > helix) & (turn > strand)
        whole = _ahead(self.known, TURN, np.logical_and) & test(*(_ahead(v, TURN) for v in values), TURN)
        at = np.flatnonzero(whole)
        product = np.prod([_PRODUCTS[i][self.codes[at + i]] for i in range(TURN)], axis=0)
        whole[at] = product * 10**6 > LEAST_TURN * 1000**TURN

        def good(at, k):
            sums = (sum(np.where(k > i, v[at + i], 0).astype(np.int64) for i in range(TURN - 1)) for v in values)
            product = np.prod([np.where(k > i, _PRODUCTS[i][self.codes[at + i]], 1) for i in range(TURN - 1)], axis=0)
            return test(*sums, k) & (product * 10**6 > LEAST_TURN * 1000**k)

        return self._in_windows(TURN, whole, good)

    def stops(self, s: int, step: int) -> np.ndarray:
        """Places at which an extension that goes on by `step` ends; it needs a known residue behind, and takes neither of a text's outer two."""
        behind = lambda values: np.roll(values, -step)
        weak, other = self._of(_HAS[BREAKERS[s]]).view(bool), self._of(_HAS[BREAKERS[s] + INDIFFERENT[s]]).view(bool)
        stop = ~self.known | self._of(_HAS[STOPPERS[s]]).view(bool) | (weak & behind(other)) | ~behind(self.known)
        stop[self._at(self._over - 2 if step > 0 else self.zeros, 2)] = True
        return stop

    def marks(self, sites: np.ndarray, s: int, step: int) -> np.ndarray:
        """1 for a site, 0 for a stop, -1 for places that an extension passes."""
        return np.where(sites, np.int8(1), -(~self.stops(s, step)).astype(np.int8))

    def nearest(self, marks: np.ndarray, step: int) -> np.ndarray:
        """Of each place the last site or stop in the direction of the scan, itself included; beyond the ends without one."""
        if step > 0:
            return np.maximum.accumulate(np.where(marks >= 0, self._index, -1))
        return np.minimum.accumulate(np.where(marks >= 0, self._index, len(marks))[::-1])[::-1]

    def carried_out(self) -> list[list]:
        """Of each block and scan the last mark of its own places, None without any."""
        out = []
        for s in (0, 1):
            sites = self.sites(s)
            for step in (1, -1):
                marks = self.marks(sites, s, step)
                last = self.nearest(marks, step)[self.stops_before - 1 if step > 0 else self.firsts]
                own = (last >= self.firsts) & (last < self.stops_before)
                out.append([int(marks[i]) if ok else None for i, ok in zip(last, own)])
        return out

    def runs(self, carries: list[np.ndarray] | None = None) -> tuple[tuple, tuple]:
        """The settled runs (number of the block, line, stop, kind), and the open ones with their sums of formers.

        Runs that touch are a chain; one that reaches an end of the block with a neighbour may go on there, so its runs stay
        open. In the other chains overlaps get their structure, and runs that have the same one then become one.
        """
        kinds = np.zeros(len(self.codes), np.uint8)
        for s in (0, 1):
            sites, held = self.sites(s), np.zeros(len(kinds), bool)
            for step in (1, -1):
                marks = self.marks(sites, s, step)
                if carries:
                    marks[self.firsts - 1 if step > 0 else self.stops_before] = carries[2 * s + (step < 0)]
                held |= marks[self.nearest(marks, step)] == 1
            kinds += (held << s).astype(np.uint8)
        kinds[self.turns()] = 4
        # unknown letters belong to no structure
        kinds[~(self.known & self._own)] = 0
        edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
        starts, stops, kind = edges[:-1], edges[1:], kinds[edges[:-1]]
        starts, stops, kind = (x[kind > 0] for x in (starts, stops, kind))
        sums = [np.append(0, self._of(f).cumsum(dtype=np.int64)) for f in _FORMERS]
        a, b = (x[stops] - x[starts] for x in sums)
        block = np.searchsorted(self.firsts, starts, "right") - 1
        line, stop = starts - self.zeros[block] + 1, stops - self.zeros[block]
        open_ = np.zeros(len(starts), bool)
        if len(starts) and (self.has_left.any() or self.has_right.any()):
            reach = (starts == self.firsts[block]) & self.has_left[block] | (stops == self.stops_before[block]) & self.has_right[block]
            new = np.append(True, starts[1:] != stops[:-1])
            open_ = np.logical_or.reduceat(reach, np.flatnonzero(new))[new.cumsum() - 1]
        unsettled = tuple(x[open_] for x in (block, line, stop, kind, a, b))
        kind = np.where(kind != 3, kind, np.where(a > b, 1, 2))
        starts, stops, block, line, stop, kind = (x[~open_] for x in (starts, stops, block, line, stop, kind))
        new = np.flatnonzero((starts[1:] != stops[:-1]) | (kind[1:] != kind[:-1])) + 1
        firsts, lasts = np.append(0, new)[: len(starts)], np.append(new - 1, len(starts) - 1)[: len(starts)]
        return (block[firsts], line[firsts], stop[lasts], kind[firsts]), unsettled


_SCANS = [(s, step) for s in (0, 1) for step in (1, -1)]
_NAMES = ["helix_right", "helix_left", "strand_right", "strand_left"]
#: Structures of a run: X is a helix and a strand at once.
_KINDS = pa.array(["", "H", "E", "X", "T"])


def _parts(sizes: list[int]) -> Iterator[slice]:
    """Rows that are settled at once."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > _AT_ONCE:
            yield slice(first, i)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def _merged(runs: DataFrame) -> DataFrame:
    """Runs of one kind that touch become one; runs: text, block, line (the start), stop, kind, a and b."""
    last = before(runs, "_last", F.struct("stop", "kind"), F.max, "text")
    new = F.when((F.col("_last.stop") + 1 == F.col("line")) & (F.col("_last.kind") == F.col("kind")), 0).otherwise(1)
    islands = before(last.withColumn("_new", F.coalesce(new, F.lit(1))).drop("_last"), "_island", F.col("_new"), F.sum, "text")
    group = islands.groupBy("text", (F.col("_island") + F.col("_new")).alias("_island"))
    return group.agg(F.min("block").alias("block"), F.min("line").alias("line"), F.max("stop").alias("stop"), F.first("kind").alias("kind"), F.sum("a").alias("a"), F.sum("b").alias("b")).drop("_island")


def predicted(df: DataFrame, key: str, text: str, gaps: str = "-.", block: int = 1 << 16) -> DataFrame:
    """key, structure (H, E or T), start and stop of the runs of predicted structure; residues are numbered from 1 without gaps.

    A window of 6 (helix) or 5 (strand) residues with formers above its size less 2 and breakers below 2 is a site. Sites
    are extended both ways up to a proline (in strands also E), a breaker followed by a breaker or an indifferent residue,
    an unknown letter, or a text's outer two residues. Four residues with a product of turn frequencies over 0.000075 and
    more turn than 1, helix or strand in the mean are a turn, which comes first; where helix and strand overlap, the whole
    overlap is what its formers sum up to more for (a strand if equal). Letters that are no residues end windows; of
    those that reach one, the first counts without it. Rows of one key are texts of their own; null and empty texts have no runs.
    """
    if block < _HALO:
        raise ValueError(f"a block needs {_HALO} residues or more")
    residues = F.upper(F.translate(F.coalesce(text, F.lit("")), gaps, ""))
    cut = df.select(F.col(key).alias("key"), residues.alias("residues"))
    lines = [StructField(name, kind) for name, kind in (("structure", StringType()), ("start", LongType()), ("stop", LongType()))]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if len(x) <= block else "" for x in batch.column(1).to_pylist()]
            for part in _parts([len(x) for x in texts]):
                (row, line, stop, kind), _ = _Blocks([("", x, "", 0, len(x)) for x in texts[part]]).runs()
                yield pa.record_batch([batch.column(0).take(pa.array(row + part.start)), _KINDS.take(pa.array(kind)), pa.array(line), pa.array(stop)], names=["key", "structure", "start", "stop"])

    settled = cut.mapInArrow(short, StructType([StructField("key", cut.schema["key"].dataType), *lines]))
    # texts of several blocks
    cut = cut.filter(F.char_length("residues") > block).withColumn("chunks", F.regexp_extract_all("residues", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    other = lambda i: F.coalesce(F.get("chunks", i), F.lit(""))
    pieces = F.transform("chunks", lambda c, i: F.struct(i.alias("block"), F.right(other(i - 1), F.lit(_HALO)).alias("left"), c.alias("chunk"), F.left(other(i + 1), F.lit(_HALO)).alias("right")))
    rows = cut.select(F.monotonically_increasing_id().alias("text"), "key", F.length("residues").alias("n"), pieces.alias("p"))
    pieces = stored(rows.select("text", "key", "n", F.inline("p")), "protein-blocks")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Blocks]]:
        for batch in batches:
            number, n, left, chunk, right = (c.to_pylist() for c in batch.columns[1:6])
            for part in _parts([len(c) for c in chunk]):
                yield batch.slice(part.start, part.stop - part.start), _Blocks(list(zip(left[part], chunk[part], right[part], (k * block for k in number[part]), n[part])))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, b in blocks(batches):
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, pa.int32()) for c in b.carried_out())], names=["text", "block", *_NAMES])

    narrow = pieces.select("text", "block", "n", "left", "chunk", "right")
    flags = narrow.mapInArrow(ends, "text long, block int, " + ", ".join(f"{k} int" for k in _NAMES))
    order = Window.partitionBy("text").orderBy("block")
    passed = [order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)]
    nearest = [(F.last if step > 0 else F.first)(k, ignorenulls=True).over(passed[step < 0]) for k, (_, step) in zip(_NAMES, _SCANS)]
    carried = flags.select("text", "block", *[F.coalesce(w, F.lit(0)).alias(k) for k, w in zip(_NAMES, nearest)])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text", "block", "line", "stop", "kind", "a", "b", "open"]
        for batch, b in blocks(batches):
            closed, unsettled = b.runs([c.to_numpy() for c in batch.columns[6:]])
            for (row, line, stop, kind, *sums), is_open in ((closed, False), (unsettled, True)):
                row, a, b_ = pa.array(row), *(pa.array(x) for x in sums or [np.zeros(len(row), np.int64)] * 2)
                yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array(line), pa.array(stop), _KINDS.take(pa.array(kind)), a, b_, pa.array(np.full(len(row), is_open))], names=names)

    found = narrow.join(carried, ["text", "block"]).mapInArrow(runs, "text long, block int, line long, stop long, kind string, a long, b long, open boolean")
    found = stored(found, "protein-runs")
    whole = _merged(found.filter("open").drop("open"))
    whole = whole.withColumn("kind", F.when(F.col("kind") != "X", F.col("kind")).when(F.col("a") > F.col("b"), "H").otherwise("E"))
    keys = pieces.filter("block = 0").select("text", "key")
    long = _merged(whole).select("text", "line", "stop", "kind").unionByName(found.filter("not open").select("text", "line", "stop", "kind"))
    long = long.join(keys, "text").select("key", F.col("kind").alias("structure"), F.col("line").alias("start"), "stop")
    return settled.unionByName(long).withColumnRenamed("key", key)
