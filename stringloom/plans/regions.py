"""Queries of locations, extraction, and regions."""

from pyspark.sql import functions as F

from stringloom.operators import intervals as iv
from stringloom.operators import merging
from stringloom.operators.columns import characters
from stringloom.plans.registry import Registry, spread

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_DNA, _COMPLEMENT = iv.DNA, iv.DNA_COMPLEMENT


def _parts():
    """Two parts of a text, the second one complemented, made from a line item."""
    start, n = (F.col("l_linenumber") * 10).cast("int"), F.col("l_quantity").cast("int")
    part = lambda a, b, c: F.struct(a.alias("start"), b.alias("stop"), F.lit(c).alias("complement"), F.lit("").alias("fuzzy_start"), F.lit("").alias("fuzzy_stop"))
    return F.array(part(start, start + n, False), part(start + 100, start + 100 + n, True))


@_r.query(f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber * 10 + 100 + l_quantity::INT <= length(text) THEN substr(text, l_linenumber * 10, l_quantity::INT + 1)
           || reverse(translate(substr(text, l_linenumber * 10 + 100, l_quantity::INT + 1), '{_DNA}', '{_COMPLEMENT}')) END AS data
    FROM lineitem JOIN documents ON l_orderkey = doc_id
""")
def extracted_features(table):
    rows = table("lineitem").join(table("documents"), F.col("l_orderkey") == F.col("doc_id"))
    return rows.select("l_orderkey", "l_linenumber", iv.extracted(F.col("text"), _parts()).alias("data"))


@_r.query("""
    SELECT l_orderkey, l_linenumber, 'join(' || l_linenumber * 10 || '..' || l_linenumber * 10 + l_quantity::INT || ',complement(' || l_linenumber * 10 + 100 || '..' || l_linenumber * 10 + 100 + l_quantity::INT || '))' AS location,
           2 AS parts, l_quantity::BIGINT * 2 + 2 AS bases, l_linenumber * 10 + 100 AS last_start
    FROM lineitem
""")
def parsed_locations(table):
    """Locations as text and back."""
    rows = table("lineitem").select("l_orderkey", "l_linenumber", iv.location_text(_parts()).alias("location"))
    parsed = rows.withColumn("_parts", iv.location_parts(F.col("location")))
    bases = F.aggregate(F.transform("_parts", lambda p: (p["stop"] - p["start"] + 1).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return parsed.select("l_orderkey", "l_linenumber", iv.location_text(F.col("_parts")).alias("location"), F.size("_parts").alias("parts"), bases.alias("bases"), F.element_at("_parts", -1)["start"].alias("last_start"))


@_r.query(f"SELECT doc_id, reverse(translate(text, '{_DNA}', '{_COMPLEMENT}')) AS data FROM documents")
def reverse_complements(table):
    return table("documents").select("doc_id", iv.reverse_complement(F.col("text")).alias("data"))


_CODE = ", ".join(f"'{codon}': '{letter}'" for codon, letter in iv.genetic_code(1).items())


@_r.query(f"""
    WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^acgtACGT]', '', 'g')) AS dna FROM documents)
    SELECT doc_id, array_to_string(list_transform(range(0, (length(dna) // 3)::BIGINT), lambda i: MAP {{{_CODE}}}[substr(dna, i * 3 + 1, 3)]), '') AS protein FROM d
""")
def translated_texts(table):
    """The letters ACGT of whole texts, read as codons."""
    return spread(table("documents")).select("doc_id", iv.translated(F.regexp_replace("text", "[^acgtACGT]", "")).alias("protein"))


_SPANS = "SELECT user_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) + 1 AS start, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) + 1 + (value * 60)::BIGINT AS stop, event_id, event_type FROM events"


def _spans(table):
    at = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + 1
    return table("events").select("user_id", at.alias("start"), (at + F.round(F.col("value") * 60).cast("long")).alias("stop"), "event_id", "event_type")


_MERGED = f"""
    e AS ({_SPANS}), m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM m),
    r AS (SELECT user_id, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM i GROUP BY user_id, island)
"""


@_r.query(f"WITH {_MERGED} SELECT * FROM r")
def merged_regions(table):
    return iv.merged(_spans(table), "user_id", bin_size=86_400)


@_r.query(f"""
    WITH {_MERGED}, l AS (SELECT user_id, max(stop) + 1000 AS length FROM e GROUP BY user_id),
         x AS (SELECT user_id, start, stop FROM r UNION ALL SELECT user_id, length + 1, length + 1 FROM l),
         g AS (SELECT user_id, coalesce(lag(stop) OVER (PARTITION BY user_id ORDER BY start), 0) + 1 AS start, start - 1 AS stop FROM x)
    SELECT * FROM g WHERE start <= stop
""")
def free_regions(table):
    spans = _spans(table)
    sizes = spans.groupBy("user_id").agg((F.max("stop") + 1000).alias("length"))
    return iv.free_regions(spans, sizes, "user_id", bin_size=86_400)


@_r.query(f"""
    WITH e AS ({_SPANS}) SELECT p.event_id, r.event_id AS region_id FROM e p JOIN e r ON p.user_id = r.user_id AND p.event_type = 'click' AND r.event_type = 'purchase' AND p.start BETWEEN r.start AND r.stop
""")
def points_in_regions(table):
    spans = _spans(table)
    points = spans.filter("event_type = 'click'").select("user_id", "event_id", F.col("start").alias("at"))
    regions = spans.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("region_id"), "start", "stop")
    return iv.containing(points, "at", regions, 3600, "user_id").select("event_id", "region_id")


@_r.query(f"""
    WITH e AS ({_SPANS}) SELECT a.event_id, b.event_id AS other FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'signup' AND a.start <= b.stop AND b.start <= a.stop
""")
def overlapping_regions(table):
    spans = _spans(table)
    right = spans.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("other"), F.col("start").alias("start_2"), F.col("stop").alias("stop_2"))
    return iv.overlapping(spans.filter("event_type = 'view'").select("user_id", "event_id", "start", "stop"), right, 3600, "user_id").select("event_id", "other")


@_r.query("""
    SELECT p_partkey, i + 1 AS pos, substr(p_name, i + 1, 1) AS ch, sum(CASE WHEN substr(p_name, i + 1, 1) IN (' ', 'e') THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY i)::BIGINT AS base
    FROM part, unnest(range(0, length(p_name))) AS x(i)
""")
def base_positions(table):
    return iv.running_bases(characters(table("part"), "p_name", "p_partkey"), "p_partkey", gaps=" e")


@_r.query("""
    WITH x AS (SELECT p_partkey, i + 1 AS pos, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS base FROM part, unnest(range(0, length(p_name))) AS u(i) WHERE substr(p_name, i + 1, 1) <> ' '),
         y AS (SELECT p_partkey, i + 1 AS pos, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS base FROM part, unnest(range(0, length(p_type))) AS u(i) WHERE substr(p_type, i + 1, 1) <> ' ')
    SELECT x.pos AS source, min(y.pos) AS target FROM x JOIN y USING (p_partkey, base) GROUP BY x.pos
""")
def mapped_columns(table):
    """Columns of two alignments that hold the same base number of the same reference."""
    p = table("part")
    return merging.column_map(p.select("p_partkey", F.col("p_name").alias("data")), p.select("p_partkey", F.col("p_type").alias("data")), "p_partkey", "data", gaps=" ")


@_r.query("""
    WITH s AS (SELECT l_orderkey AS helix, l_partkey AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL)),
         l AS (SELECT helix, pos, row_number() OVER (PARTITION BY helix ORDER BY pos) AS n FROM s WHERE side = 'left'), r AS (SELECT helix, pos, row_number() OVER (PARTITION BY helix ORDER BY pos DESC) AS n FROM s WHERE side = 'right')
    SELECT helix, l.pos AS "left", r.pos AS "right" FROM l JOIN r USING (helix, n)
""")
def helix_pairs(table):
    strands = table("lineitem").groupBy(F.col("l_orderkey").alias("helix"), F.col("l_partkey").alias("pos")).agg(F.min("l_linenumber").alias("n"))
    return iv.helix_pairs(strands.select("helix", "pos", F.when(F.col("n") % 2 == 0, "left").otherwise("right").alias("side")))


@_r.query("""
    WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey % 100 + 1 AS a, l_partkey % 100 + 1 + l_suppkey % 10 AS b, l_returnflag = 'R' AS c FROM lineitem)
    SELECT l_orderkey, l_linenumber, a::VARCHAR AS pos_start, b::VARCHAR AS pos_stop, CASE WHEN c THEN '1' ELSE '0' END AS pos_complement, CASE WHEN a = b THEN '==' ELSE '<=' END AS pos_certain,
           CASE WHEN c THEN 'complement(' ELSE '' END || CASE WHEN a = b THEN a::VARCHAR ELSE '<' || a || '..' || b END || CASE WHEN c THEN ')' ELSE '' END AS again FROM g
""")
def position_fields(table):
    """Locations as fields of a gene and back as text."""
    a, b = F.col("l_partkey") % 100 + 1, F.col("l_partkey") % 100 + 1 + F.col("l_suppkey") % 10
    body = F.when(a == b, a.cast("string")).otherwise(F.concat(F.lit("<"), a.cast("string"), F.lit(".."), b.cast("string")))
    text = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("complement("), body, F.lit(")"))).otherwise(body)
    rows = table("lineitem").select("l_orderkey", "l_linenumber", iv.position_fields(iv.location_parts(text)).alias("f")).select("l_orderkey", "l_linenumber", "f.*")
    again = iv.location_text(iv.parts_of_fields(F.col("pos_start"), F.col("pos_stop"), F.col("pos_complement"), F.col("pos_certain")))
    return rows.select("l_orderkey", "l_linenumber", "pos_start", "pos_stop", "pos_complement", "pos_certain", again.alias("again"))


@_r.query("""
    WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 40), g AS (SELECT doc_id, k, k * 10 + 1 AS a, k * 10 + 6 AS b FROM d, range(0, 4) AS r(k))
    SELECT doc_id || '/' || k AS name, doc_id AS origin, k AS gene, CASE WHEN k % 2 = 1 THEN translate(reverse(substr(text, (a)::INT, 6)), 'ACGTUMRWSYKVHDBNacgtumrwsykvhdbn', 'TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn') ELSE substr(text, (a)::INT, 6) END AS data FROM d JOIN g USING (doc_id)
""")
def gene_items(table):
    """Genes of texts as items of their own, with the piece of the text that is theirs."""
    docs = table("documents").select("doc_id", F.col("text").alias("data"))
    k = F.explode(F.array(*[F.lit(x).cast("long") for x in range(4)])).alias("gene")
    genes = docs.filter(F.char_length("data") >= 40).select("doc_id", k)
    at = F.concat((F.col("gene") * 10 + 1).cast("string"), F.lit(".."), (F.col("gene") * 10 + 6).cast("string"))
    genes = genes.withColumn("parts", iv.location_parts(F.when(F.col("gene") % 2 == 1, F.concat(F.lit("complement("), at, F.lit(")"))).otherwise(at)))
    return iv.gene_items(docs, genes, "doc_id", "gene", "data").select("name", "origin", "gene", "data")


def _coding(table):
    """Orders as short coding sequences: one codon a line, made of the line's numbers."""
    letter = lambda c: F.substring(F.lit("TCAG"), (c % 4 + 1).cast("int"), F.lit(1))
    codon = F.concat(letter(F.col("l_partkey")), letter(F.col("l_suppkey")), letter(F.col("l_quantity").cast("long")))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", codon.alias("codon"))))
    return table("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(lines, lambda x: x["codon"]), "").alias("dna"))


_CODE = lambda table: "substr('" + iv.GENETIC_CODES[table] + "', ((l_partkey % 4) * 16 + (l_suppkey % 4) * 4 + l_quantity::BIGINT % 4 + 1)::INT, 1)"


@_r.query(f"""
    WITH t AS (SELECT l_orderkey, {", ".join(f"string_agg({_CODE(k)}, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS t{k}" for k in sorted(iv.GENETIC_CODES))} FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_filter([{", ".join(f"CASE WHEN t{k} = t4 THEN '{k}' END" for k in sorted(iv.GENETIC_CODES))}], lambda x: x IS NOT NULL), ',') AS codes, regexp_replace(t1, '[*]$', '') = regexp_replace(t4, '[*]$', '') AS redundant FROM t
""")
def fitting_codes(table):
    """The genetic codes under which a protein fits its codons, and whether the standard code gives it anyway."""
    rows = _coding(table).withColumn("protein", iv.translated(F.col("dna"), 4))
    rows = iv.with_redundant_translation(rows, "dna", "protein")
    return rows.select("l_orderkey", F.array_join(F.transform(iv.codes_that_fit(F.col("dna"), F.col("protein")), lambda k: k.cast("string")), ",").alias("codes"), "redundant")
