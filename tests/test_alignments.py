"""Rule texts, patterns, helix lines, soft mapping and record readers against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stringloom.functions import streams as s
from stringloom.operators import intervals, merging, patterns
from stringloom.sources import import_rules, records

# rule texts

RULES = """
AUTODETECT "ID *"
KEYWIDTH 4
BEGIN "ID *"
IFNOTSET a "the id comes first"
SETGLOBAL z "zz"
MATCH "ID *"
  SRT "ID  ="
  SETVAR a
  WRITE "name"
AUTOTAG "X"
MATCH "TX *"
  SRT "TX  =:|=, "
  APPEND "text"
AUTOTAG
INCLUDE "numbers"
MATCH "FR *"
  SRT "FR *=from *1 in $a/$z$$"
  TAG "F $a"
  APPEND "from"
MATCH "FR*"
  ACI "upper"
  SETVAR z
SEQUENCESTART "SQ*"
SEQUENCECOLUMN 2
SEQUENCEACI "lower"
SEQUENCEEND "//"
CREATE_ACC_FROM_SEQUENCE
"""
NUMBERS = 'MATCH "NU *"\n WRITE_INT "nothing"\nMATCH "NU *"\n SRT "NU  ="\n WRITE_INT "number"\nMATCH "NF *"\n SRT "NF  ="\n WRITE_FLOAT "share"'


def plain_import(record):
    """What the rules above make of a record's lines, one line after the other."""
    fields, var, lines, data, inside = {}, {"z": "zz"}, [], [], False
    for line in record:
        if inside:
            data.append(line[2:])
            continue
        if line.startswith("    ") and lines:
            lines[-1] += "|" + line.lstrip()
        else:
            lines.append(line)
        inside = line.startswith("SQ")
    bare = lambda t: t.strip(" \t|")
    number = lambda t, r, f: f((re.match(r, bare(t)) or [0])[0])
    for line in lines:
        if line.startswith("ID "):
            var["a"] = line.replace("ID  ", "")
            if bare(var["a"]):
                fields["name"] = bare(var["a"])
        if line.startswith("TX ") and bare(t := line.replace("TX  ", "").replace("|", ", ")):
            fields["text"] = f"{fields['text']} {bare(t)}" if "text" in fields else f"[X] {bare(t)}"
        if line.startswith("NU "):
            fields["nothing"] = 0
            if bare(t := line.replace("NU  ", "")):
                fields["number"] = number(t, r"[+-]?\d+", int)
        if line.startswith("NF ") and bare(t := line.replace("NF  ", "")):
            fields["share"] = number(t, r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", float)
        if line.startswith("FR "):
            new = bare(re.sub(r"FR (.*)", rf"from \1 in {var['a']}/{var['z']}$", line, flags=re.S))
            tag = f"[F {var['a']}]"
            old = fields.get("from")
            fields["from"] = f"{tag} {new}" if old is None else f"{old} {new}" if tag.lower() in old.lower() else f"{old} {tag} {new}"
        if line.startswith("FR"):
            var["z"] = line.upper()
    return fields, re.sub(r"\s+", "", "".join(data)).lower()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_rule_text(spark, tmp_path, end):
    rng, texts = random.Random(3), []
    for k in range(40):
        lines = [f"ID  item{k}"]
        for _ in range(rng.randint(0, 8)):
            lines.append(rng.choice(["TX  some text", "TX  ", "TX  more", "    goes on", "NU  12x", "NU  word", "NF  3.5e2 m", "FR there", "FR", "?? other", "ID  again"]))
        lines += [rng.choice(["SQ", "SQ here"]), "  ACGT 12", "A CC"][: rng.choice([0, 1, 3])]
        texts.append(lines)
    for k, part in enumerate((texts[:25], texts[25:])):
        (tmp_path / f"f{k}.txt").write_bytes(("head of the file" + end + "".join(end.join([*t, "//", ""]) for t in part)).encode())
    form = import_rules.parsed_rules(RULES, {"numbers": NUMBERS})
    programs = {"upper": (s.upper,), "lower": (s.lower,)}
    rows = import_rules.imported_by(import_rules.records_of(spark, str(tmp_path), form), form, programs, "file", "place").collect()
    got = Counter((tuple(sorted((k, v) for k, v in r.asDict().items() if v is not None and k not in ("data", "acc", "file", "place"))), r.data) for r in rows)
    assert got == Counter((tuple(sorted(f.items())), d) for f, d in map(plain_import, texts))
    assert all(re.fullmatch("ACC_[0-9A-F]{8}", r.acc) for r in rows) and len(rows) == 40
    heads = spark.createDataFrame([("ID x\nTX",), (">x",)], "head string")
    assert [r.f for r in heads.select(import_rules.detected_format(F.col("head"), {"keyed": form}).alias("f")).collect()] == ["keyed", None]


def test_rule_text_errors(spark, tmp_path):
    for text, what in (("MATCH \"a\"\nWRITE \"x\"\nWRITE \"y\"", "line 3"), ("nonsense", "line 1"), ("INCLUDE \"none\"", "line 1"), ("KEYWIDTH x", "line 1"), ("SRT \"a=b\"", "line 1")):
        with pytest.raises(ValueError, match=what):
            import_rules.parsed_rules(text)
    (tmp_path / "x").write_text("FR x\nID  y\n//\n")
    form = import_rules.parsed_rules(RULES.replace('BEGIN "ID *"', 'BEGIN "*"'), {"numbers": NUMBERS})
    with pytest.raises(Exception, match="the id comes first"):
        import_rules.imported_by(import_rules.records_of(spark, str(tmp_path), form), form, {"upper": (s.upper,), "lower": (s.lower,)}).collect()
    wrong = import_rules.parsed_rules('SETGLOBAL a "b"\nMATCH "*"\nSRT "$a=c"\nWRITE "x"')
    with pytest.raises(ValueError, match="searches"):
        import_rules.imported_by(import_rules.records_of(spark, str(tmp_path), wrong), wrong)


# patterns


def test_patterns_in_all_directions(spark):
    rng = random.Random(5)
    texts = [(k, "".join(rng.choice("ACGTUacgtu-.N") for _ in range(rng.choice([0, 3, 70, 130])))) for k in range(25)] + [(99, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    listed = "AC-GT, u?a # twice\nGGCA"
    assert patterns.pattern_list(listed) == [("AC-GT", "twice"), ("u?a", "twice"), ("GGCA", "")]
    for o in (
        patterns.Options(), patterns.Options(most=2, complement=True, reverse=True), patterns.Options(least=1, most=1, gaps_in_text=False, reverse=True, t_is_u=False),
        patterns.Options(most=1, complement=True, exact=True, ignore_case=False), patterns.Options(gaps_in_pattern=False, gaps_in_text=False, reverse=True, complement=True, exact=True),
    ):
        expected = Counter()
        fold = lambda c, o=o: (c.lower() if o.ignore_case else c).replace("T", "U" if o.t_is_u else "T").replace("t", "u" if o.t_is_u else "t")
        for key, text in texts:
            at = [i for i, c in enumerate(text or "") if not o.gaps_in_text or c not in "-."]
            for pattern, _ in patterns.pattern_list(listed):
                bare = "".join(c for c in pattern if not o.gaps_in_pattern or c not in "-.")
                for c in (False, True):
                    for r in (False, True):
                        if (c, r) != (o.complement, o.reverse) if o.exact else c > o.complement or r > o.reverse:
                            continue
                        own = "".join(dict(zip(intervals.DNA, intervals.DNA_COMPLEMENT)).get(x, x) if c else x for x in bare)
                        own = own[::-1] if r else own
                        for i in range(len(at) - len(own) + 1):
                            n = sum(x != "?" and fold(x) != fold(text[at[i + j]]) for j, x in enumerate(own))
                            if o.least <= n <= o.most:
                                expected[key, pattern, c, r, at[i] + 1, at[i + len(own) - 1] + 1, n] += 1
        got = patterns.pattern_hits(df, "id", "text", listed, o).collect()
        assert Counter((r.id, r.pattern, r.complement, r.reverse, r.start, r.stop, r.mismatches) for r in got) == expected


def test_patterns_take_time_in_proportion_to_the_text():
    import time

    def seconds(n):
        text, compared = "ACGU" * n, [patterns.variants("GGGGGGGGGGGGGG?C", patterns.Options(most=3))]
        start = time.perf_counter()
        list(patterns._hits(text, compared, patterns.Options(most=3)))
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(1_000_000) < 60 * max(seconds(50_000), 0.01)


# helix lines


def plain_pairs(numbers, helix):
    """With one stack for each helix."""
    stacks, out, name, i = {}, [], "0", 0
    names = {}
    for m in re.finditer("[A-Za-z0-9]+", numbers):
        names[m.start()] = m[0].lower()
    for i, c in enumerate(helix):
        name = names.get(i, name)
        stack = stacks.setdefault(name, [])
        if c in "{[<(#*abcdefghij":
            stack.append((i, c))
        elif c in "}]>)ABCDEFGHIJ":
            if not stack:
                out.append((name, None, i + 1, None, "unpaired"))
                continue
            at, opened = stack.pop()
            wrong = c not in "}]>)" and c.lower() != opened
            out.append((name, at + 1, i + 1, None if wrong else "pair" if c in "}]>)" else c.lower(), "kind" if wrong else None))
    return out + [(name, at + 1, None, None, "unpaired") for name, stack in stacks.items() for at, _ in stack]


def test_helix_lines(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HELIX_BLOCK", 16)
    rng = random.Random(8)
    lines = [(0, "..1......2....1.....2..", "..(((....[[...)))...]].."), (1, "", "(())"), (2, None, None), (3, "1", "((#aA*")]
    for k in range(4, 40):
        n = rng.randint(1, 90)
        lines.append((k, "".join(rng.choice("....1a2B") for _ in range(n)), "".join(rng.choice("((<{[))>}]...aAbB") for _ in range(n + rng.randint(0, 5)))))
    got = intervals.bracket_pairs(spark.createDataFrame(lines, "id int, nr string, hx string"), "id", "nr", "hx").collect()
    expected = Counter((k, *p) for k, nr, hx in lines for p in plain_pairs(nr or "", hx or ""))
    assert Counter((r.id, r.helix, r.left, r.right, r.kind, r.fault) for r in got) == expected


def test_short_helix_lines_need_no_scans(spark, monkeypatch):
    """Lines within a block are paired where they are, rows of one key or none as lines of their own."""
    monkeypatch.setattr(intervals, "before", None)
    rng = random.Random(27)
    lines = [("ab"[k % 2] if k % 3 else None, "".join(rng.choice("..1aB") for _ in range(n)), "".join(rng.choice("((<[))]..#aAbB") for _ in range(n))) for k, n in enumerate(rng.choices(range(80), k=60))]
    got = intervals.bracket_pairs(spark.createDataFrame(lines, "id string, nr string, hx string"), "id", "nr", "hx").collect()
    assert Counter((r.id, r.helix, r.left, r.right, r.kind, r.fault) for r in got) == Counter((k, *p) for k, nr, hx in lines for p in plain_pairs(nr, hx))


# soft mapping


def plain_soft(mapping, text):
    """Places base by base: segments between mapped columns, then a push to the right."""
    fixed, gaps = dict(mapping), "-."
    s, wanted = sorted(fixed), []
    bases = [(i + 1, c) for i, c in enumerate(text) if c not in gaps]
    for a, b in [(None, s[0]), *zip(s, s[1:]), (s[-1], None)]:
        own = [x for x, _ in bases if (a is None or x > a) and (b is None or x < b)]
        if a is None:
            wanted += [(x, fixed[b] - len(own) + k) for k, x in enumerate(own)]
        elif b is None:
            wanted += [(x, fixed[a] + 1 + k) for k, x in enumerate(own)]
        else:
            n, room = b - a - 1, fixed[b] - fixed[a] - 1
            step = (room - 1) / (n - 1) if n > 1 and room > 1 else 0.0
            targets = []
            for x in own:
                off = x - a - 1
                targets.append(fixed[a] + 1 + off + (0 if off < n // 2 else room - n) if step >= 1 and room > n else int(fixed[a] + 1 + off * step + 0.5))
            if len(own) >= room:
                targets = [fixed[a] + 1 + k for k in range(len(own))]
            else:
                limit = fixed[b]
                for k in range(len(own) - 1, -1, -1):
                    limit = targets[k] = min(targets[k], limit - 1)
            wanted += list(zip(own, targets))
        if b is not None:
            wanted += [(b, fixed[b])] * any(x == b for x, _ in bases)
    out, by = "", dict(wanted)
    for x, c in bases:
        gap, k = "-", x - 1
        while k > 0 and text[k - 1] in gaps:
            gap, k = text[k - 1], k - 1
        out += (("." if not out else gap) * (max(by[x], len(out) + 1) - len(out) - 1)) + c
    return out.ljust(fixed[s[-1]], ".")


def test_soft_mapping(spark):
    rng = random.Random(9)
    for _ in range(4):
        s = sorted(rng.sample(range(1, 30), rng.randint(1, 9)))
        t = sorted(rng.sample(range(1, rng.choice([20, 60])), len(s)))
        texts = [(k, "".join(rng.choice("ACG---..") for _ in range(rng.randint(0, 40)))) for k in range(30)] + [(98, None), (99, "...")]
        got = merging.soft_remapped(spark.createDataFrame(texts, "id int, data string"), "id", "data", spark.createDataFrame(list(zip(s, t)), "source int, target int")).collect()
        assert {r.id: r.data for r in got} == {k: plain_soft(list(zip(s, t)), x or "") for k, x in texts}


# readers


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_readers_of_several_files(spark, tmp_path, end):
    def folder(name, *files):
        (tmp_path / name).mkdir()
        for k, text in enumerate(files):
            (tmp_path / name / f"{k}.txt").write_bytes(text.replace("\n", end).encode())
        return str(tmp_path / name)

    rows = lambda df: sorted((r.file[-5:], r.name, r.data) for r in df.collect())
    phylip = folder("phylip", " 2 4\none       ACGT\ntwo       AC-T\n", " 1 4\none       TTTT\n")
    assert rows(records.read_phylip(spark, phylip)) == [("0.txt", "one", "ACGT"), ("0.txt", "two", "AC-T"), ("1.txt", "one", "TTTT")]
    nexus = "#NEXUS\nbegin data;\n dimensions ntax=2;\n format gap=-;\n matrix\n one AC GT\n 'two''s' [first] AAAA\n one TT\n;\nend;\nbegin trees;\n translate\n 1 A,\n 2 B\n ;\n tree x = (1,2);\nend;\n"
    assert rows(records.read_nexus(spark, folder("nexus", nexus, nexus.replace("AC GT", "GGGG;")))) == [("0.txt", "one", "ACGTTT"), ("0.txt", "two's", "AAAA"), ("1.txt", "one", "GGGG")]
    macke = folder("macke", "#-\n#:one:key:a\n#:one:key:b\none 0 ACGU\none 4 AA\n", "#:one:key:c\none 0 CCCC\n")
    assert rows(records.read_macke(spark, macke)) == [("0.txt", "one", "ACGUAA"), ("1.txt", "one", "CCCC")]
    assert sorted(r.fields["key"] for r in records.read_macke(spark, macke).collect()) == ["a b", "c"]
    embl = folder("embl", "ID   one; x\nDE   first\nSQ   Sequence 4 BP;\n     acgt   4\n//\nID   two\nSQ   Sequence 4 BP;\n     gggg   4\n//\n")
    assert sorted((r["name"], r.full_name, r["data"]) for r in records.read_embl(spark, embl).collect()) == [("one", "first", "acgt"), ("two", None, "gggg")]
    genbank = folder("genbank", "LOCUS       one x\nORIGIN\n        1 acgt\n//\nLOCUS       two\nORIGIN\n        1 cccc\n//\n")
    assert sorted((r["name"], r["data"]) for r in records.read_genbank(spark, genbank).collect()) == [("one", "acgt"), ("two", "cccc")]
    swiss = folder("swiss", "ID   one\nSQ   SEQUENCE   4 AA;\n     MKLV\n//\nID   two\nSQ   SEQUENCE   2 AA;\n     MM\n//\n")
    assert sorted((r["name"], r["data"]) for r in records.read_swissprot(spark, swiss).collect()) == [("one", "MKLV"), ("two", "MM")]
