"""Features with positions: parts of locations, sequence extraction, merged and free regions, overlaps, base positions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from stringloom.operators.storage import before, stored

#: Letters and their complements, with ambiguity codes (fixed values).
DNA, DNA_COMPLEMENT = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"


def complement(c: Column, rna: bool = False) -> Column:
    return F.translate(F.translate(c, DNA, DNA_COMPLEMENT), "Tt", "Uu") if rna else F.translate(c, DNA, DNA_COMPLEMENT)


def reverse_complement(c: Column, rna: bool = False) -> Column:
    return F.reverse(complement(c, rna))


def location_parts(location: Column) -> Column:
    """array<struct<start, stop, complement, fuzzy_start, fuzzy_stop>> of a location such as complement(join(1..5,<8..9)).

    Parts of a complement() over several parts are listed in reverse, as they are read. `a^b` is the place between
    two neighbours (start = b, stop = a). Text that is no location gives no parts. A location may have any number
    of parts: the pattern's repeats are possessive, so that Java matches them in a loop.
    """
    pattern = r"(complement\()?([<>]?)(\d+)(?:(\.\.|\^)([<>]?)(\d+))?"
    flat = F.regexp_replace(location, "\\s+", "")
    valid = flat.rlike(r"^(?:complement\(|join\(|order\(|[<>]?\d++(?:(?:\.\.|\^)[<>]?\d++)?+|,|\))++$")
    pieces = F.when(valid, F.regexp_extract_all(flat, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # bound once for the text: what a function of an array takes from outside is worked out again for every element
    whole = F.array(F.struct(pieces.alias("pieces"), flat.rlike("^complement\\((join|order)\\(").alias("outer")))

    def part(p: Column, outer: Column) -> Column:
        get = lambda i: F.regexp_extract(p, pattern, i)
        first = get(3).try_cast("int")
        second = F.coalesce(get(6).try_cast("int"), first)
        between = get(4) == "^"
        return F.struct(
            F.when(between, second).otherwise(first).alias("start"), F.when(between, first).otherwise(second).alias("stop"),
            ((get(1) != "") != outer).alias("complement"), get(2).alias("fuzzy_start"), get(5).alias("fuzzy_stop"),
        )

    in_order = lambda w: F.transform(F.when(w["outer"], F.reverse(w["pieces"])).otherwise(w["pieces"]), lambda p: part(p, w["outer"]))
    return F.when(location.isNotNull(), F.transform(whole, in_order)[0])


def location_text(parts: Column, joinable: Column | None = None) -> Column:
    """The location of parts; several are joined, or ordered where joinable is false."""

    def one(p: Column) -> Column:
        ends = F.concat(p["fuzzy_start"], p["start"].cast("string"), F.lit(".."), p["fuzzy_stop"], p["stop"].cast("string"))
        between = F.concat(p["stop"].cast("string"), F.lit("^"), p["start"].cast("string"))
        body = F.when(p["start"] == p["stop"] + 1, between).when((p["start"] == p["stop"]) & (p["fuzzy_start"] == "") & (p["fuzzy_stop"] == ""), p["start"].cast("string")).otherwise(ends)
        return F.when(p["complement"], F.concat(F.lit("complement("), body, F.lit(")"))).otherwise(body)

    kind = F.lit("join(") if joinable is None else F.when(joinable, F.lit("join(")).otherwise(F.lit("order("))
    whole = lambda texts: F.when(F.size(texts) == 1, texts[0]).when(F.size(texts) > 1, F.concat(kind, F.array_join(texts, ","), F.lit(")")))
    return F.transform(F.array(F.transform(parts, one)), whole)[0]


def extracted(data: Column, parts: Column, separator: str = "", rna: bool = False) -> Column:
    """The parts' sequences in order, reverse-complemented where they are; null if a part lies outside the data.

    A part whose start is one behind its stop is empty.
    """
    inside = F.forall(parts, lambda p: (p["start"] >= 1) & (p["start"] <= p["stop"] + 1) & (p["stop"] <= F.char_length(data)))
    piece = lambda p: F.substring(data, p["start"], p["stop"] - p["start"] + 1)
    texts = F.transform(parts, lambda p: F.when(p["complement"], reverse_complement(piece(p), rna)).otherwise(piece(p)))
    return F.when(inside & (F.size(parts) > 0), F.array_join(texts, separator))


def _islands(rows: DataFrame, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(order))
    return island.groupBy(*groups, "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("parts").alias("parts")).drop("_island")


def merged(rows: DataFrame, *groups: str, start: str = "start", stop: str = "stop", bin_size: int | None = None) -> DataFrame:
    """Regions of each group with overlapping or directly following ones made one: groups, start, stop, parts.

    A region within another one doesn't shorten it: the union reaches as far as its farthest part.

    With a bin size the regions that start in one bin are merged first, so that a group with very many regions is
    spread over tasks, and only what is left of each bin meets in the end. Regions without a place are left out.
    """
    found = rows.filter(F.col(start).isNotNull() & F.col(stop).isNotNull()).select(*groups, F.col(start).alias("start"), F.col(stop).alias("stop"), F.lit(1).cast("long").alias("parts"))
    if bin_size:
        found = _islands(found.withColumn("_bin", F.floor(F.col("start") / bin_size)), *groups, "_bin").drop("_bin")
    return _islands(found, *groups)


def free_regions(rows: DataFrame, sizes: DataFrame, *groups: str, start: str = "start", stop: str = "stop", length: str = "length", bin_size: int | None = None) -> DataFrame:
    """What no region covers, from 1 to each group's length: groups, start, stop. sizes has one row a group."""
    order = Window.partitionBy(*groups).orderBy("start")
    ends = sizes.select(*groups, (F.col(length) + 1).cast("long").alias("start"), (F.col(length) + 1).cast("long").alias("stop"))
    solid = merged(rows, *groups, start=start, stop=stop, bin_size=bin_size).select(*groups, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).unionByName(ends)
    gaps = solid.select(*groups, (F.coalesce(F.lag("stop").over(order), F.lit(0)) + 1).alias("gap_start"), (F.col("start") - 1).alias("gap_stop"))
    return gaps.filter("gap_start <= gap_stop").select(*groups, F.col("gap_start").alias("start"), F.col("gap_stop").alias("stop"))


def containing(points: DataFrame, position: str, regions: DataFrame, bin_size: int, *groups: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """points joined with every region that holds their position.

    A region is copied into each bin that it touches and meets the points of the bin by an equi-join; bins that
    hold many points are split by adaptive execution.
    """
    bins = F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(stop) / bin_size))
    wide = regions.filter(F.col(start) <= F.col(stop)).withColumn("_bin", F.explode(bins))
    near = points.withColumn("_bin", F.floor(F.col(position) / bin_size)).join(wide, [*groups, "_bin"])
    return near.filter(F.col(position).between(F.col(start), F.col(stop))).drop("_bin")


def overlapping(left: DataFrame, right: DataFrame, bin_size: int, *groups: str) -> DataFrame:
    """Pairs of regions (start, stop, and start_2, stop_2 of right) that share a place; each pair once, in its first common bin."""
    cut = lambda df, a, b: df.filter(F.col(a) <= F.col(b)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(b) / bin_size))))
    pairs = cut(left, "start", "stop").join(cut(right, "start_2", "stop_2"), [*groups, "_bin"])
    first = F.floor(F.greatest("start", "start_2") / bin_size)
    return pairs.filter((F.col("start") <= F.col("stop_2")) & (F.col("start_2") <= F.col("stop")) & (F.col("_bin") == first)).drop("_bin")


def running_bases(letters: DataFrame, *groups: str, pos: str = "pos", ch: str = "ch", gaps: str = "-.") -> DataFrame:
    """Exploded characters with base: how many of their group up to there are not gaps."""
    is_base = F.when(F.instr(F.lit(gaps), F.col(ch)) > 0, 0).otherwise(1)
    return letters.withColumn("base", F.sum(is_base).over(Window.partitionBy(*groups).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))


def helix_pairs(strands: DataFrame, helix: str = "helix", side: str = "side", pos: str = "pos") -> DataFrame:
    """(helix, left, right): positions that pair: the n-th from the outside of the left strand with the n-th of the right."""
    left = strands.filter(F.col(side) == "left").withColumn("_n", F.row_number().over(Window.partitionBy(helix).orderBy(F.asc(pos))))
    right = strands.filter(F.col(side) == "right").withColumn("_n", F.row_number().over(Window.partitionBy(helix).orderBy(F.desc(pos))))
    return left.select(helix, "_n", F.col(pos).alias("left")).join(right.select(helix, "_n", F.col(pos).alias("right")), [helix, "_n"]).drop("_n")


#: Characters of a helix line that open and close a pair; letters of equal name form pairs of their own kind (fixed values).
LEFT_PAIRS, RIGHT_PAIRS = "{[<(", "}]>)"
LEFT_KINDS, RIGHT_KINDS = "#*abcdefghij", "ABCDEFGHIJ"
#: Columns of an alignment that one task scans.
HELIX_BLOCK = 1 << 16


#: Rows that a task holds before it passes them on.
_HELIX_ROWS = 1 << 18
_SIGNS, _NAMES = re.compile("[" + re.escape(LEFT_PAIRS + LEFT_KINDS + RIGHT_PAIRS + RIGHT_KINDS) + "]"), re.compile("[A-Za-z0-9]+")


def _line_pairs(numbers: str, line: str) -> Iterator[tuple]:
    """helix, left, right, kind and fault of one line's brackets."""
    names, open_ = [("0", 0), *((m[0].lower(), m.start()) for m in _NAMES.finditer(numbers))], {}
    at = 0
    for m in _SIGNS.finditer(line):
        pos, sign = m.start(), m[0]
        while at + 1 < len(names) and names[at + 1][1] <= pos:
            at += 1
        helix = names[at][0]
        own = open_.setdefault(helix, [])
        if sign in LEFT_PAIRS or sign in LEFT_KINDS:
            own.append((pos + 1, sign))
        elif not own:
            yield helix, None, pos + 1, None, "unpaired"
        else:
            left, other = own.pop()
            kind = "pair" if sign in RIGHT_PAIRS else sign.lower()
            yield (helix, left, pos + 1, kind, None) if kind in ("pair", other) else (helix, left, pos + 1, None, "kind")
    for helix, own in open_.items():
        for left, _ in own:
            yield helix, left, None, None, "unpaired"


def bracket_pairs(lines: DataFrame, key: str, numbers: str, helix: str) -> DataFrame:
    """Pairs of positions of helix lines: key, helix, left, right, kind (pair, or a letter) and fault.

    numbers has the name of a helix above its first columns, and a name holds until the next one; case doesn't count,
    and before the first one the name is 0. Brackets pair within their helix, so helices may cross. There is no
    stack: the running depth of a helix gives each bracket its level, and the n-th opening of a level pairs
    with its n-th end. What opens or closes nothing is a row of its own with the fault `unpaired`; a pair of two kinds has the
    fault `kind`. Only lines of more than HELIX_BLOCK columns, whose keys have to be unique, are cut up for that; within others
    the last open bracket of a helix is remembered. A bracket behind the end of numbers belongs to the last name. Null lines have no pairs.
    """
    wide = lines.select(key, F.coalesce(numbers, F.lit("")).alias("_nr"), F.coalesce(helix, F.lit("")).alias("_hx"))
    longer = F.greatest(F.char_length("_nr"), F.char_length("_hx")) > HELIX_BLOCK
    longest, types = HELIX_BLOCK, [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = ["helix", "left", "right", "kind", "fault"]

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            made = lambda out: pa.record_batch([batch.column(0).take(pa.array([r[0] for r in out], types[0])), *(pa.array([r[i] for r in out], types[i]) for i in range(1, 6))], names=[key, *names])  # noqa: B023, E731
            for i, (nr, hx) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if max(len(nr), len(hx)) <= longest:
                    out += [(i, *r) for r in _line_pairs(nr, hx)]
                if len(out) > _HELIX_ROWS:
                    yield made(out)
                    out = []
            yield made(out)

    kinds = {"left": IntegerType(), "right": IntegerType()}
    found = wide.mapInArrow(paired, StructType([wide.schema[key], *(StructField(n, kinds.get(n, StringType())) for n in names)]))
    long = stored(wide.filter(longer), "helix-lines")
    return found.unionByName(_pairs_of_blocks(long, key, "_nr", "_hx")) if long.head(1) else found


def _pairs_of_blocks(lines: DataFrame, key: str, numbers: str, helix: str) -> DataFrame:
    """bracket_pairs of lines that no task sees whole, by prefix scans over their columns."""
    letters = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    wide = lines.select(key, letters(F.col(numbers)).alias("_nr"), letters(F.col(helix)).alias("_hx"))
    named = lambda x: F.coalesce(x.rlike("^[A-Za-z0-9]$"), F.lit(False))
    # names as (first column, name), from the string itself
    cells = F.transform("_nr", lambda x, i: F.struct((i + 1).alias("pos"), x.alias("ch"), (named(x) & ~named(F.when(i > 0, F.get("_nr", i - 1)))).alias("first")))
    names = wide.select(key, F.inline(F.filter(cells, lambda c: named(c["ch"])))).withColumn("block", F.floor(F.col("pos") / HELIX_BLOCK)).withColumn("line", F.col("pos"))
    runs = before(names, "_run", F.col("first").cast("long"), F.sum, key).withColumn("_run", F.col("_run") + F.col("first").cast("long"))
    name = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), ""))
    runs = runs.groupBy(key, "_run").agg(F.min("pos").alias("pos"), name.alias("helix"))
    signs = F.transform("_hx", lambda x, i: F.struct((i + 1).alias("pos"), x.alias("ch")))
    known = LEFT_PAIRS + LEFT_KINDS + RIGHT_PAIRS + RIGHT_KINDS
    marks = wide.select(key, F.inline(F.filter(signs, lambda c: F.instr(F.lit(known), c["ch"]) > 0)))
    # the name that holds at a bracket: the last one that starts at or before it, as the largest (column, name)
    at = lambda df: df.withColumn("block", F.floor(F.col("pos") / HELIX_BLOCK))
    both = at(marks.select(key, "pos", "ch", (F.col("pos") * 2 + 1).alias("line"), F.lit(None).cast("struct<pos: int, helix: string>").alias("_name")).unionByName(
        runs.select(key, "pos", F.lit(None).cast("string").alias("ch"), (F.col("pos") * 2).alias("line"), F.struct("pos", "helix").alias("_name"))))
    rows = before(both, "_held", F.col("_name"), F.max, key).filter("ch is not null")
    rows = rows.select(key, "pos", "line", "block", "ch", F.coalesce("_held.helix", F.lit("0")).alias("helix"), (F.instr(F.lit(LEFT_PAIRS + LEFT_KINDS), F.col("ch")) > 0).alias("left"))
    rows = before(rows, "_sum", F.when(F.col("left"), 1).otherwise(-1), F.sum, key, "helix")
    after = F.col("_sum") + F.when(F.col("left"), 1).otherwise(-1)
    rows = before(rows, "_least", after, F.min, key, "helix")
    least = F.least(F.coalesce("_least", F.lit(0)), F.lit(0))
    rows = rows.withColumns({"_stray": ~F.col("left") & (after < least), "_level": F.col("_sum") - least + F.when(F.col("left"), 1).otherwise(0)})
    sound = before(rows.filter("not _stray").withColumn("_side", F.col("left").cast("int")), "_n", F.lit(1), F.sum, key, "helix", "_level", "_side")
    side = lambda left, own: sound.filter("left" if left else "not left").select(key, "helix", "_level", "_n", F.col("pos").alias("left" if left else "right"), F.col("ch").alias(own))
    pairs = side(True, "_open").join(side(False, "_close"), [key, "helix", "_level", "_n"], "full_outer")
    plain = F.instr(F.lit(RIGHT_PAIRS), F.col("_close")) > 0
    kind = F.when(plain, "pair").otherwise(F.lower("_close"))
    fault = F.when(F.col("left").isNull() | F.col("right").isNull(), "unpaired").when(~plain & (F.lower("_close") != F.col("_open")), "kind")
    stray = rows.filter("_stray").select(key, "helix", F.lit(None).cast("int").alias("left"), F.col("pos").alias("right"), F.lit(None).cast("string").alias("kind"), F.lit("unpaired").alias("fault"))
    return pairs.select(key, "helix", "left", "right", F.when(fault.isNull(), kind).alias("kind"), fault.alias("fault")).unionByName(stray)


#: Genetic codes by number: the amino acids of the 64 codons in TCAG order (fixed values).
GENETIC_CODES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
    3: "FFLLSSSSYY**CCWWTTTTPPPPHHQQRRRRIIMMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    4: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    5: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSSSVVVVAAAADDEEGGGG",
    6: "FFLLSSSSYYQQCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    9: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    10: "FFLLSSSSYY**CCCWLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    11: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    12: "FFLLSSSSYY**CC*WLLLSPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    13: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSSGGVVVVAAAADDEEGGGG",
    14: "FFLLSSSSYYY*CCWWLLLLPPPPHHQQRRRRIIIMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    15: "FFLLSSSSYY*QCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    16: "FFLLSSSSYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    21: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNNKSSSSVVVVAAAADDEEGGGG",
    22: "FFLLSS*SYY*LCC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    23: "FF*LSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
CODONS = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]


def genetic_code(table: int = 1) -> dict[str, str]:
    return dict(zip(CODONS, GENETIC_CODES[table]))


@cache
def ambiguous_code(table: int = 1) -> dict[str, str]:
    """Codons with ambiguity letters whose meanings all stand for one amino acid; B for D or N and Z for E or Q."""
    from itertools import product

    from stringloom.operators.columns import AMBIGUITY

    code, out = genetic_code(table), {}
    letters = [x for x in AMBIGUITY if x not in "UX"]
    for codon in product(letters, repeat=3):
        found = {code["".join(m)] for m in product(*(AMBIGUITY[x] for x in codon))}
        one = found.pop() if len(found) == 1 else "B" if found == {"D", "N"} else "Z" if found == {"E", "Q"} else None
        if one:
            out["".join(codon)] = one
    return out


def translated(c: Column, table: int = 1, frame: int = 0, gaps: str = "-.", ambiguous: bool = False) -> Column:
    """Protein letters of the codons from the frame (0 to 2) on; unclear codons are X, gap codons stay gaps, a rest of one or two letters goes.

    With `ambiguous`, codons with ambiguity letters that can only mean one amino acid (or D and N, E and Q) are clear.
    """
    known = ambiguous_code(table) if ambiguous else genetic_code(table)
    code = F.split(F.lit("".join(known.get(codon, "X") for codon in _NUMBERED)), "")
    letter = lambda x: F.when(F.translate(x, gaps, "") == "", F.left(x, F.lit(1))).otherwise(F.get(code, _codon_number(x)))
    return F.array_join(F.transform(_codons(c, frame), letter), "")


def _codons(c: Column, frame: int) -> Column:
    dna = F.translate(F.upper(c), "U", "T")
    return F.regexp_extract_all(F.substring(dna, F.lit(frame + 1), F.char_length(dna)), F.lit("(?s).{3}"), F.lit(0))


#: Letters that a clear codon may have, behind one for all others, and all codons of them in the order of their numbers.
_CODON_LETTERS = "TCAGMRWSYKVHDBN"
_NUMBERED = [a + b + c for a in "?" + _CODON_LETTERS for b in "?" + _CODON_LETTERS for c in "?" + _CODON_LETTERS]


def _codon_number(codon: Column) -> Column:
    """The place of a codon in _NUMBERED, so that what it means is an entry of an array; a map would be searched entry by entry."""
    number = lambda i: F.instr(F.lit(_CODON_LETTERS), F.substring(codon, i, 1))
    return (number(1) * 16 + number(2)) * 16 + number(3)


def ends_dotted(c: Column, gap: str = "-") -> Column:
    """Gaps at both ends become dots."""
    lead, trail = F.regexp_extract(c, f"^[{gap}.]*", 0), F.regexp_extract(c, f"[{gap}.]*$", 0)
    rest = F.greatest(F.char_length(c) - F.char_length(lead), F.lit(0))
    body = F.substring(c, F.char_length(lead) + 1, F.greatest(rest - F.char_length(trail), F.lit(0)))
    return F.when(rest == 0, F.repeat(F.lit("."), F.char_length(c))).otherwise(F.concat(F.repeat(F.lit("."), F.char_length(lead)), body, F.repeat(F.lit("."), F.char_length(trail))))


def inserted(c: Column, at: int, n: int, gap: str = "-") -> Column:
    """n gaps behind column `at`."""
    return F.concat(F.left(c, F.lit(at)), F.repeat(F.lit(gap), n), F.substring(c, F.lit(at + 1), F.char_length(c)))


def deleted(c: Column, start: int, stop: int) -> Column:
    """Without the columns from start to stop."""
    return F.concat(F.left(c, F.lit(start - 1)), F.substring(c, F.lit(stop + 1), F.char_length(c)))


def padded(c: Column, length: int, fill: str = ".") -> Column:
    """Filled up to the length; longer data stays."""
    return F.rpad(c, F.greatest(F.lit(length), F.char_length(c)), F.lit(fill))


def codes_that_fit(dna: Column, protein: Column, tables: list[int] | None = None, frame: int = 0) -> Column:
    """array<int>: the genetic codes under which each codon can give the protein's letter in its place; X and gaps fit all."""
    tables = sorted(GENETIC_CODES) if tables is None else tables
    codes = [ambiguous_code(k) for k in tables]
    letters = "X-." + "".join(sorted(set("".join("".join(code.values()) for code in codes))))
    # codons that mean the same under every code are one kind; kind 0 is no codon, the next one is those that are clear under none
    unclear = ("X",) * len(tables)
    meanings = [tuple(code.get(codon, "X") for code in codes) for codon in _NUMBERED]
    kinds = {meaning: i + 1 for i, meaning in enumerate(dict.fromkeys([unclear, *meanings]))}
    # of each kind and letter the codes that fit, as bits; letter 0 is any other one, or none
    everything = (1 << len(tables)) - 1
    bits = lambda meaning, letter: sum(1 << i for i, own in enumerate(meaning) if own in ("X", letter))
    none = [0] + [everything] * 3 + [0] * (len(letters) - 3)
    masks = none + [x for meaning in kinds for x in (bits(meaning, ""), *[everything] * 3, *(bits(meaning, y) for y in letters[3:]))]
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    kind_of = listed([kinds[m] for m in meanings], "int")

    def fits(codon: Column, letter: Column) -> Column:
        kind = F.coalesce(F.get(kind_of, _codon_number(codon)), F.lit(0))
        return F.get(listed(masks, "long"), kind * (len(letters) + 1) + F.coalesce(F.instr(F.lit(letters), letter), F.lit(0)))

    given = F.filter(F.split(F.upper(protein), ""), lambda x: x != "")
    both = F.aggregate(F.zip_with(_codons(dna, frame), given, fits), F.lit(everything).cast("long"), lambda found, x: found.bitwiseAND(x))
    # the bits are made once, then read
    return F.get(F.transform(F.array(both), lambda found: F.array_compact(F.array(*[F.when(found.bitwiseAND(1 << i) != 0, F.lit(k)) for i, k in enumerate(tables)]))), 0)


def with_redundant_translation(genes: DataFrame, data: str, protein: str, table: int = 1, frame: int = 0, name: str = "redundant") -> DataFrame:
    """genes with a flag: the stored protein is what the data translates to (a stop at the end may be left out)."""
    made = F.regexp_replace(translated(F.col(data), table, frame, ambiguous=True), "\\*$", "")
    return genes.withColumn(name, F.coalesce(F.regexp_replace(F.upper(F.col(protein)), "\\*$", "") == made, F.lit(False)))


def position_fields(parts: Column) -> Column:
    """parts of a location as the fields of a gene: start, stop, complement and certain, comma-joined, and how many parts there are.

    A certainty is two characters: < or > where an end is open, + and - for the place between two neighbours, else =.
    """
    between = lambda p: p["start"] == p["stop"] + 1
    sure = lambda p: F.when(between(p), F.lit("+-")).otherwise(F.concat(F.when(p["fuzzy_start"] == "", F.lit("=")).otherwise(p["fuzzy_start"]), F.when(p["fuzzy_stop"] == "", F.lit("=")).otherwise(p["fuzzy_stop"])))

    def fields(own: Column) -> Column:
        joined = lambda f: F.array_join(F.transform(own, f), ",")
        return F.struct(
            joined(lambda p: F.when(between(p), p["stop"]).otherwise(p["start"]).cast("string")).alias("pos_start"), joined(lambda p: F.when(between(p), p["start"]).otherwise(p["stop"]).cast("string")).alias("pos_stop"),
            joined(lambda p: F.when(p["complement"], "1").otherwise("0")).alias("pos_complement"), joined(sure).alias("pos_certain"), F.size(own).alias("pos_joined"),
        )

    return F.transform(F.array(parts), fields)[0]  # the parts are worked out once


def parts_of_fields(start: Column, stop: Column, complement: Column, certain: Column) -> Column:
    """The parts back from their fields; a missing certainty is ==. Fields of unequal length give null in the missing places."""
    cells = F.arrays_zip(F.split(start, ",").alias("a"), F.split(stop, ",").alias("b"), F.split(complement, ",").alias("c"), F.split(F.coalesce(certain, F.lit("")), ",").alias("d"))

    def part(x: Column) -> Column:
        sure = F.coalesce(F.nullif(x["d"], F.lit("")), F.lit("=="))
        a, b, between = x["a"].try_cast("int"), x["b"].try_cast("int"), sure == "+-"
        open_end = lambda k: F.when(F.substring(sure, k, 1).isin("<", ">"), F.substring(sure, k, 1)).otherwise("")
        return F.struct(F.when(between, b).otherwise(a).alias("start"), F.when(between, a).otherwise(b).alias("stop"), (x["c"] == "1").alias("complement"), open_end(1).alias("fuzzy_start"), open_end(2).alias("fuzzy_stop"))

    return F.transform(cells, part)


def gene_items(organisms: DataFrame, genes: DataFrame, key: str, gene: str, data: str, parts: str = "parts", rna: bool = False) -> DataFrame:
    """Genes as items of their own: name (organism/gene), origin, gene and the gene's piece of the organism's data.

    genes: key of the organism, gene and parts. Genes of unknown organisms, or with a part outside the data, are left out.
    """
    rows = genes.select(key, gene, parts).join(organisms.select(key, data), key)
    named = rows.select(F.concat_ws("/", F.col(key).cast("string"), F.col(gene).cast("string")).alias("name"), F.col(key).alias("origin"), F.col(gene).alias("gene"), extracted(F.col(data), F.col(parts), rna=rna).alias(data))
    return named.filter(F.col(data).isNotNull())
