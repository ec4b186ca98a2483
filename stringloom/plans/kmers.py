"""Queries of k-mer similarity and of search with mismatches."""

from pyspark.sql import functions as F

from stringloom.operators import kmers as k
from stringloom.operators.storage import stored
from stringloom.plans.registry import Registry, spread

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql



def _kmers(table: str, key: str, k: int) -> str:
    """SQL for the k-mers of whole texts: key columns and kmer, from neighbouring characters."""
    following = " || ".join(f"lead(ch, {i}) OVER w" for i in range(1, k))
    return f"""SELECT * EXCLUDE (ch, pos) FROM (SELECT *, ch || {following} AS kmer
        FROM (SELECT {key}, unnest(range(1, length(text) + 1)) AS pos, unnest(string_split(text, '')) AS ch FROM {table}) WINDOW w AS (PARTITION BY {key} ORDER BY pos)) WHERE kmer IS NOT NULL"""


_COUNTS = f"""
    a AS (SELECT item_id, kmer, count(*) AS n FROM ({_kmers('benchmark', 'item_id', 12)}) GROUP BY ALL),
    b AS (SELECT doc_id, kmer, count(*) AS n FROM ({_kmers('documents', 'doc_id', 12)}) GROUP BY ALL),
    s AS (SELECT item_id AS source, doc_id AS target, sum(least(a.n, b.n))::BIGINT AS score FROM a JOIN b USING (kmer) GROUP BY ALL)
"""


def _scored(table):
    items = table("benchmark").select(F.col("item_id").alias("id"), "text")
    return k.relatives(items, spread(table("documents")).select(F.col("doc_id").alias("id"), "text"), "id", "text", 12)


@_r.query(f"""
    WITH {_COUNTS} SELECT source, target, score, round(score / (length(text) - 11), 9) AS relative FROM s JOIN benchmark ON source = item_id
""")
def relatives(table):
    """12-mers that benchmark items share with each document."""
    return _scored(table).withColumn("relative", F.round("relative", 9))


@_r.query(f"""
    WITH {_COUNTS}, r AS (SELECT source, target, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, target DESC) AS rank FROM s)
    SELECT source, target, score, rank FROM r WHERE rank <= 3
""")
def best_relatives(table):
    return k.best_relatives(_scored(table), 3).select("source", "target", "score", F.col("rank").cast("long").alias("rank"))


_AT = "(({i} * length(probe)) // 6)"
_PIECES = [f"substr(probe, {_AT.format(i=i)} + 1, {_AT.format(i=i + 1)} - {_AT.format(i=i)})" for i in range(6)]


@_r.query(f"""
    WITH p AS (SELECT item_id, text AS probe FROM benchmark), near AS (SELECT item_id, probe, doc_id, d.text FROM p JOIN documents d ON {" OR ".join(f"contains(d.text, {x})" for x in _PIECES)}),
         places AS (SELECT *, unnest(range(1, length(text) - length(probe) + 2)) AS position FROM near WHERE length(text) >= length(probe)),
         seeded AS (SELECT * FROM places WHERE {" OR ".join(f"substr(text, position + {_AT.format(i=i)}, length({x})) = {x}" for i, x in enumerate(_PIECES))}),
         rated AS (SELECT *, len(list_filter(range(0, length(probe)), lambda i: substr(probe, i + 1, 1) <> substr(text, position + i, 1))) AS mismatches FROM seeded)
    SELECT item_id AS probe_id, doc_id, position, mismatches FROM rated WHERE mismatches <= 5
""")
def probe_matches(table):
    """Every place where a whole benchmark item stands in a document with at most 5 differing characters."""
    found = k.probe_match(table("benchmark"), "item_id", "text", spread(table("documents")), "doc_id", "text", 5)
    return found.select("probe_id", "doc_id", F.col("position").cast("long").alias("position"), F.col("mismatches").cast("long").alias("mismatches"))


@_r.query(f"""
    WITH t AS (SELECT count(*) AS total FROM documents WHERE lang = 'de'),
         m AS (SELECT DISTINCT * FROM ({_kmers('documents', 'doc_id, lang', 8)})),
         n AS (SELECT kmer, count(*) FILTER (lang = 'de') AS targets, count(*) FILTER (lang IS DISTINCT FROM 'de') AS others FROM m GROUP BY kmer)
    SELECT kmer, targets, others, length(regexp_replace(upper(kmer), '[^GC]', '', 'g')) AS gc,
           4 * length(regexp_replace(upper(kmer), '[^GC]', '', 'g')) + 2 * length(regexp_replace(upper(kmer), '[^ATU]', '', 'g')) AS temperature
    FROM n, t WHERE targets >= total * 0.2 AND others <= 3
""")
def probe_design(table):
    """8-mers of a fifth of the German texts that hardly any other text holds."""
    found = k.probe_design(spread(table("documents")), "doc_id", "text", F.col("lang") == "de", 8, 0.2, 3)
    return found.select("kmer", "targets", "others", F.col("gc").cast("long").alias("gc"), F.col("temperature").cast("long").alias("temperature"))


@_r.query("""
    SELECT p_partkey, length(regexp_replace(upper(p_name), '[^GC]', '', 'g')) AS gc,
           4 * length(regexp_replace(upper(p_name), '[^GC]', '', 'g')) + 2 * length(regexp_replace(upper(p_name), '[^ATU]', '', 'g')) AS temperature FROM part
""")
def gc_and_temperature(table):
    c = F.col("p_name")
    return table("part").select("p_partkey", k.gc_content(c).cast("long").alias("gc"), k.melting_temperature(c).cast("long").alias("temperature"))


@_r.query(f"""
    WITH m AS (SELECT DISTINCT * FROM ({_kmers('benchmark', 'item_id', 6)})),
         p AS (SELECT a.item_id AS a, b.item_id AS b FROM benchmark a JOIN benchmark b ON a.item_id % 20 = 0 AND a.item_id <> b.item_id AND (b.item_id % 20 <> 0 OR a.item_id < b.item_id)),
         s AS (SELECT a, b, kmer FROM p JOIN m ON item_id = a UNION ALL SELECT a, b, kmer FROM p JOIN m ON item_id = b)
    SELECT a, b, min(kmer) AS kmer FROM (SELECT a, b, kmer FROM s GROUP BY ALL HAVING count(*) = 1) GROUP BY a, b
""")
def separating_probes(table):
    """For the query items (ids divisible by 20) and every other one a 6-mer that tells the two apart, each pair once."""
    items = table("benchmark")
    found = k.kmer_counts(items, "item_id", "text", 6).select("item_id", "kmer")
    ids = items.select("item_id")
    pairs = ids.filter("item_id % 20 = 0").select(F.col("item_id").alias("a")).join(ids.select(F.col("item_id").alias("b")), (F.col("a") != F.col("b")) & ((F.col("b") % 20 != 0) | (F.col("a") < F.col("b"))))
    return k.separating_probes(found, "item_id", pairs)


@_r.query("""
    WITH e AS (SELECT event_id, user_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS position, event_type AS kmer FROM events),
         t AS (SELECT *, 4 * length(regexp_replace(upper(kmer), '[^GC]', '', 'g')) + 2 * length(regexp_replace(upper(kmer), '[^ATU]', '', 'g')) AS temperature FROM e)
    SELECT x.user_id, x.position AS position_1, y.position AS position_2, x.kmer AS kmer_1, y.kmer AS kmer_2 FROM t x JOIN t y ON x.user_id = y.user_id
    WHERE y.position - x.position BETWEEN 600 AND 7200 AND abs(x.temperature - y.temperature) <= 4
""")
def primer_pairs(table):
    """Pairs within a window of distance, on events as places along a user's time."""
    at = (F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))).alias("position")
    found = k.primer_pairs(table("events").select("user_id", at, F.col("event_type").alias("kmer")), "user_id", 600, 7200)
    return found.select("user_id", "position_1", "position_2", "kmer_1", "kmer_2")


@_r.query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS n FROM lineitem),
         o AS (SELECT l_orderkey, list(n ORDER BY l_linenumber, n) AS buckets FROM b GROUP BY l_orderkey),
         s AS (SELECT *, list_transform(range(1, len(buckets) + 1), lambda i: list_sum(buckets[1:i])) AS sums FROM o),
         i AS (SELECT *, coalesce(list_position(list_transform(sums, lambda x: x > 40), true), len(buckets)) - 1 AS i FROM s)
    SELECT l_orderkey, round(3 * i + 1000.0 / (1000.0 + buckets[i + 1]), 9) AS quality FROM i
""")
def probe_quality(table):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("n"))))
    orders = table("lineitem").groupBy("l_orderkey").agg(F.transform(lines, lambda x: x["n"]).alias("buckets"))
    return orders.select("l_orderkey", F.round(k.probe_quality(F.col("buckets"), F.lit(20), F.lit(3)), 9).alias("quality"))


@_r.query()
def covering_probes(table):
    """8-mers that together stand in all turns of conversations and in no benchmark item; each round depends on those before it."""
    item = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item")
    # texts of one turn are one item
    texts = table("conversations").select(item, "text").groupBy("item").agg(F.collect_set("text").alias("texts"))
    sets = spread(texts).select(k.kmer_set(F.col("texts"), 8).alias("kmers"))
    return k.covering_sets(sets, k.kmer_counts(table("benchmark"), "item_id", "text", 8))


#: Lines of a supplier as a string of bases with gaps and unclear letters, in the order of the lines.
_READS = """reads AS (SELECT l_suppkey AS item, string_agg(CASE WHEN l_discount = 0 THEN '-' WHEN l_quantity = 50 THEN 'N' ELSE substr('ACGT', l_partkey::INT % 4 + 1, 1) END, ''
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount) AS data FROM lineitem GROUP BY 1),
    bases AS (SELECT item, replace(data, '-', '') AS bases FROM reads)"""


def reads(table):
    letter = F.when(F.col("l_discount") == 0, "-").when(F.col("l_quantity") == 50, "N").otherwise(F.substring(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)))
    lines = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", letter.alias("ch"))))
    return table("lineitem").groupBy(F.col("l_suppkey").alias("item")).agg(F.array_join(F.transform(lines, lambda x: x["ch"]), "").alias("data"))


@_r.query(f"""
    WITH {_READS}, c AS (SELECT item, unnest(range(1, length(data) + 1)) AS i, unnest(string_split(data, '')) AS ch FROM reads)
    SELECT item, string_agg(ch, '' ORDER BY i) AS bases, string_agg(i::VARCHAR, ',' ORDER BY i) AS columns FROM c WHERE ch <> '-' GROUP BY item
""")
def prepared_sequences(table):
    """Aligned data without its gaps, with the column of each base."""
    found = k.prepared(reads(table), "item", "data")
    return found.select("item", "bases", F.array_join(F.transform("columns", lambda c: c.cast("string")), ",").alias("columns"))


_WEIGHT = "({p} * (13 - {p}) / 169.0 * 4 + 0.3)"
_LOSS = "CASE x || y " + " ".join(f"WHEN '{pair}' THEN {loss}" for pair, loss in k.bond_loss().items() if loss) + " WHEN 'XN' THEN 1.0 ELSE CASE WHEN x <> y AND (y = 'N' OR x = 'N') THEN 1.0 ELSE 0.0 END END"
_HITS = f"""
    {_READS}, q AS (SELECT item AS probe_id, substr(bases, 5, 14) AS probe FROM bases WHERE item % 20 = 0 AND length(bases) >= 18),
    p AS (SELECT probe_id, false AS reverse, probe FROM q UNION ALL SELECT probe_id, true, translate(reverse(probe), 'ACGT', 'TGCA') FROM q),
    w AS (SELECT *, unnest(range(1, length(bases) - 12)) AS position FROM bases WHERE length(bases) >= 14),
    m AS (SELECT probe_id, reverse, item, position, probe, substr(bases, position, 14) AS piece FROM w, p),
    c AS (SELECT probe_id, reverse, item, position, probe, piece, i, substr(probe, i, 1) AS x, substr(piece, i, 1) AS y FROM m, range(1, 15) AS r(i)),
    h AS (SELECT probe_id, reverse, item, position, probe, piece, count(*) FILTER (x <> y AND y <> 'N') AS mismatches, count(*) FILTER (x <> y AND y = 'N') AS n_mismatches,
                 sum(CASE WHEN x = y THEN 0.0 ELSE ({_LOSS}) * {_WEIGHT.format(p='(i - 1)')} END) AS weighted FROM c GROUP BY ALL),
    hits AS (SELECT * FROM h WHERE mismatches + CASE WHEN n_mismatches < 4 THEN greatest(n_mismatches - 1, 0) ELSE n_mismatches END <= 3)
"""


def _hits(table):
    # written, since they are read to be counted and to be dealt out, as probes and as items
    items = stored(k.prepared(reads(table), "item", "data").select("item", "bases"), "reads")
    probes = items.filter("item % 20 = 0 and length(bases) >= 18").select(F.col("item").alias("probe_id"), F.substring("bases", 5, 14).alias("probe"))
    return items, k.probe_hits(probes, "probe_id", "probe", items, "item", "bases", 3, reverse=True, ignored=1)


@_r.query(f"""
    WITH {_HITS} SELECT probe_id, reverse, item, position, mismatches, n_mismatches, round(weighted, 6) + 0.0 AS weighted,
        array_to_string(list_transform(range(1, 15), lambda i: CASE WHEN substr(probe, i, 1) = substr(piece, i, 1) THEN '=' ELSE substr(piece, i, 1) END), '') AS overlay FROM hits
""")
def probe_hits(table):
    """Probes of the query set and their reverse complements in all sequences: mismatches, unclear letters, weight of the bonds, and how it looks."""
    _, found = _hits(table)
    return found.select("probe_id", "reverse", "item", F.col("position").cast("long").alias("position"), F.col("mismatches").cast("long").alias("mismatches"), F.col("n_mismatches").cast("long").alias("n_mismatches"), (F.round("weighted", 6) + 0.0).alias("weighted"), k.hit_overlay(F.col("probe"), F.col("piece")).alias("overlay"))


@_r.query(f"""
    WITH {_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY probe_id, reverse ORDER BY mismatches, n_mismatches, round(weighted, 6), position, item) AS rank FROM hits)
    SELECT probe_id, reverse, rank, item, position FROM o WHERE rank <= 5
""")
def ordered_hits(table):
    """The five best hits of each probe in the order in which they are listed."""
    from pyspark.sql.window import Window

    _, found = _hits(table)
    found = found.withColumn("weighted", F.round("weighted", 6))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("probe_id", "reverse").orderBy(*k.hit_order("item"))))
    return ranked.filter("rank <= 5").select("probe_id", "reverse", F.col("rank").cast("long").alias("rank"), "item", F.col("position").cast("long").alias("position"))


@_r.query(f"""
    WITH {_HITS}, s AS (SELECT DISTINCT item, position FROM hits),
         l AS (SELECT item, i, bool_or(i BETWEEN position AND position + 13) AS hit FROM (SELECT item, unnest(range(1, length(bases) + 1)) AS i FROM bases) JOIN s USING (item) GROUP BY item, i)
    SELECT item, string_agg(CASE WHEN hit THEN 'x' ELSE '.' END, '' ORDER BY i) AS overlay FROM l GROUP BY item
""")
def hit_overlays(table):
    """All hits of an item as one line over its bases."""
    items, found = _hits(table)
    return k.overlaid(items, "item", "bases", found)


@_r.query(f"""
    WITH t AS (SELECT count(*) AS total FROM documents WHERE lang = 'de'),
         w AS (SELECT doc_id, lang, text, unnest(range(1, length(text) - 6)) AS place FROM documents WHERE length(text) >= 8), m AS (SELECT doc_id, lang, place, substr(text, place, 8) AS kmer FROM w),
         n AS (SELECT kmer, count(DISTINCT doc_id) FILTER (lang = 'de') AS targets, count(DISTINCT doc_id) FILTER (lang IS DISTINCT FROM 'de') AS others, min(place) FILTER (lang = 'de') AS first FROM m GROUP BY kmer),
         g AS (SELECT *, length(regexp_replace(upper(kmer), '[^GC]', '', 'g')) AS gc, 4 * length(regexp_replace(upper(kmer), '[^GC]', '', 'g')) + 2 * length(regexp_replace(upper(kmer), '[^ATU]', '', 'g')) AS temperature FROM n, t
               WHERE targets >= total * 0.05 AND others <= 3 AND first BETWEEN 1 AND 400),
         r AS (SELECT *, row_number() OVER (ORDER BY targets DESC, others, temperature DESC, kmer) AS rank FROM g WHERE gc * 100 / 8.0 BETWEEN 10 AND 60)
    SELECT kmer, targets, others, gc, temperature, first, rank FROM r WHERE rank <= 20
""")
def ranked_probes(table):
    """The 20 best probes for German texts within a window of places and of the share of G and C."""
    found = k.ranked_design(spread(table("documents")), "doc_id", "text", F.col("lang") == "de", 8, 0.05, 3, 20, (1, 400), (10, 60))
    return found.select("kmer", "targets", "others", *[F.col(c).cast("long").alias(c) for c in ("gc", "temperature", "first", "rank")])
