"""Predicted structures against a plain version that works on whole texts, residue by residue."""

import random

import pytest

from stringloom.operators import structure as st


def plain(text):
    x = text.upper().replace("-", "").replace(".", "")
    n, value = len(x), {c: v for c, v in st.PROPENSITIES.items()}

    def windows(size):
        at = 0
        while at <= n - size:
            part = x[at : at + size]
            unknown = next((i for i, c in enumerate(part) if c not in value), None)
            if unknown is None:
                yield at, part
                at += 1
            else:
                yield at, part[:unknown]
                at += unknown + 1

    found = []
    for s in (0, 1):
        own = [False] * n
        for at, part in windows(st.WINDOWS[s]):
            if sum(value[c][s] for c in part) > 100 * (st.WINDOWS[s] - 2) and sum(value[c][s + 2] for c in part) < 200:
                own[at : at + len(part)] = [True] * len(part)
        whole = list(own)
        for step in (1, -1):
            going = False
            for p in range(n)[::step]:
                if own[p]:
                    going = True
                    continue
                q = p + step
                stop = not 0 <= q < n or x[p] not in value or x[q] not in value or x[p] in st.STOPPERS[s]
                stop = stop or (p > n - 3 if step > 0 else p < 2)
                stop = stop or x[p] in st.BREAKERS[s] and x[q] in st.BREAKERS[s] + st.INDIFFERENT[s]
                going = going and not stop
                whole[p] = whole[p] or going
        found.append(whole)
    turn = [False] * n
    for at, part in windows(4):
        product = 1.0
        for i, c in enumerate(part):
            product *= st.TURNS[c][3 + i] / 1000
        a, b, t = (sum(st.TURNS[c][k] for c in part) for k in range(3))
        if part and product > 0.000075 and t > 100 * len(part) and t > a and t > b:
            turn[at : at + len(part)] = [True] * len(part)
    line, p = [" "] * n, 0
    while p < n:
        if turn[p]:
            line[p] = "T"
        elif found[0][p] and found[1][p]:
            q = p
            while q < n and found[0][q] and found[1][q] and not turn[q]:
                q += 1
            a, b = (sum(value[c][s] for c in x[p:q]) for s in (0, 1))
            line[p:q] = ("H" if a > b else "E") * (q - p)
            p = q - 1
        elif found[0][p] or found[1][p]:
            line[p] = "H" if found[0][p] else "E"
        p += 1
    return runs("".join(line))


def runs(line):
    out, start = [], 0
    for p in range(1, len(line) + 1):
        if p == len(line) or line[p] != line[start]:
            if line[start] != " ":
                out.append((line[start], start + 1, p))
            start = p
    return out


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_predicted(spark, block):
    rng = random.Random(block)
    if block < 8:  # a block needs as many residues as its neighbours look into
        with pytest.raises(ValueError, match="block"):
            st.predicted(spark.createDataFrame([("a", "ACD")], "name string, text string"), "name", "text", block=block)
        return
    letters = ["ARDNCEQGHILKMFPSTWYV", "AELMQKVIFYW", "AELMVIFP", "NGPDSAELX", "AELMVIX-b.", "VIYFTLé"]
    texts = [None, "", "-", "X", "A", "EEEEEE", "XXXXXXXXXX", "MMMMMMMMMMMMMMMMMMMM", "AEAAEX", "N" + "AELMAE" * 60 + "PP" + "VIVIY" * 40]
    texts += ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(120))) for _ in range(100)]
    texts += ["".join(rng.choice(own) for _ in range(rng.randrange(200))) for own in letters for _ in range(25)]
    df = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "name string, text string")
    got = {}
    for r in st.predicted(df, "name", "text", block=block).collect():
        got.setdefault(r.name, []).append((r.structure, r.start, r.stop))
    want = {f"t{k}": found for k, t in enumerate(texts) if (found := plain(t or ""))}
    assert {s for own in want.values() for s, *_ in own} == set("HET")
    assert {k: sorted(v, key=lambda r: r[1]) for k, v in got.items()} == want


def test_rows_of_one_key_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "AELMAELMAA"), (1, "AELMAELMAA"), (1, "AELMAELMAA")], "k long, t string")
    rows = [(r.k, r.structure, r.start, r.stop) for r in st.predicted(df, "k", "t").collect()]
    assert len(rows) == 3 * len(plain("AELMAELMAA")) and {r[1:] for r in rows} == set(plain("AELMAELMAA"))
    assert st.predicted(df.limit(0), "k", "t").collect() == []


def test_texts_within_a_block_are_settled_at_once(spark, monkeypatch):
    """Only texts of several blocks are written and joined; the others are settled many at a time, whatever letters they have."""
    written, stored = {}, st.stored
    monkeypatch.setattr(st, "stored", lambda df, name: written.setdefault(name, stored(df, name)))
    rng = random.Random(15)
    texts = ["".join(rng.choice("AELMVIYNGPDS\0é😀X") for _ in range(rng.randrange(40))) for _ in range(300)] + ["AELMKVIYVP" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {}
    for r in st.predicted(df, "k", "t", block=64).collect():
        got.setdefault(r.k, []).append((r.structure, r.start, r.stop))
    assert {k: sorted(v, key=lambda r: r[1]) for k, v in got.items()} == {k: found for k, t in enumerate(texts) if (found := plain(t))}
    assert written["protein-blocks"].count() == 5
