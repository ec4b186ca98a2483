"""Queries of node dumps, imports by rule texts, patterns with mismatches, helix lines and soft mapping."""

import uuid

from pyspark.sql import functions as F

from stringloom.functions import streams as s
from stringloom.operators import intervals, merging, patterns
from stringloom.operators.storage import shared_folder
from stringloom.plans.registry import Registry, spread
from stringloom.sources import import_rules, nodes

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _text_files(df, name):
    """The column value as text files of the shared folder, and their path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.select("value").write.text(path)
    return path


@_r.query("""
    SELECT t.path, t.type, CASE f WHEN 'n' THEN 'a "' || c_name || '"' || chr(10) || '\\' WHEN 'b' THEN printf('%.2f', c_acctbal) WHEN 'a' THEN c_nationkey::VARCHAR WHEN 's' THEN c_mktsegment WHEN 'x' THEN 'lost ' || c_custkey END AS value,
           t.path = '/customer' AND c_acctbal < 0 AS marked, CASE WHEN ord < 0 THEN NULL ELSE ord END AS ord
    FROM customer, (VALUES ('/customer', 'container', NULL, -1), ('/customer/name', 'string', 'n', 0), ('/customer/account', 'container', NULL, 1), ('/customer/account/balance', 'float', 'b', 0),
         ('/customer/account/nation', 'int', 'a', 1), ('/customer/account/', 'corrupt', 'x', 2), ('/customer/segment', 'string', 's', 2)) t(path, type, f, ord)
""")
def dump_nodes(table):
    """Customers written as node dumps, one damaged line each, and read again in byte ranges; ord of the outermost nodes depends on the files."""
    c = table("customer")
    escaped = F.concat(F.lit('"a \\"'), "c_name", F.lit('\\"\\n\\\\"'))
    lines = [
        F.concat(F.lit("customer\t\t%"), F.when(F.col("c_acctbal") < 0, "$").otherwise("%"), F.lit(" (%")), F.concat(F.lit("\tname\t\t:7600\t"), escaped), F.lit("\taccount\t\t%% (%"),
        F.concat(F.lit("\t\tbalance\t%f "), F.format_string("%.2f", F.col("c_acctbal"))), F.concat(F.lit("\t\tnation\t%i "), F.col("c_nationkey").cast("string")),
        F.concat(F.lit("\t\tlost "), F.col("c_custkey").cast("string")), F.lit("\t\t%) /*account*/\n"), F.concat(F.lit('\tsegment\t\t%s "'), "c_mktsegment", F.lit('"')), F.lit("\t%)"),
    ]
    path = _text_files(c.select(F.concat_ws("\n", *lines).alias("value")), "dumps")
    read = nodes.read_nodes(c.sparkSession, path)
    return read.select("path", "type", "value", "marked", F.when(F.col("parent").isNotNull(), F.col("ord")).alias("ord"))


KEYED = """
AUTODETECT  "ID   *"
KEYWIDTH    5
BEGIN       "ID   *"
IFNOTSET    n "no nation before the place"
SETGLOBAL   s "!"
MATCH       "ID   *"
    SRT     "ID   =:;*="
    WRITE   "name"
MATCH       "NA   *"
    SRT     "NA   ="
    SETVAR  n
AUTOTAG     "DB"
MATCH       "DE   *"
    SRT     "DE   =:|= "
    APPEND  "description"
AUTOTAG
INCLUDE     "balance"
MATCH       "XX*"
    SRT     "*=nation $n$s"
    WRITE   "place"
SEQUENCESTART   "SQ*"
SEQUENCECOLUMN  5
SEQUENCESRT     "0=A:1=C"
SEQUENCEEND     "//"
END         ""
"""
BALANCE = """
# a part that several rule texts share
MATCH       "BA   *"
    SRT     "BA   ="
    WRITE_FLOAT "balance"
"""
TITLED = """
BEGIN       ">*"
MATCH       ">*"
    ACI     "first word"
    SETVAR  a
    WRITE   "name"
MATCH       ">* *"
    SRT     ">* *=*2 of $a"
    TAG     "T"
    WRITE   "place"
SEQUENCESTART ">*"
SEQUENCEEND ">*"
"""


@_r.query("""
    SELECT 'keyed' AS format, c_name AS name, '[DB] ' || c_mktsegment || ' goes on; and' || CASE WHEN c_custkey % 2 = 0 THEN ' again' ELSE '' END AS description, round(c_acctbal, 2) AS balance,
           'nation ' || c_nationkey || '!' AS place, translate('acgu' || c_custkey, '01', 'AC') AS data FROM customer
    UNION ALL SELECT 'titled', 's' || s_suppkey, NULL, NULL, '[T] supplier ' || s_nationkey || ' of s' || s_suppkey, 'ACGT' || s_suppkey || '-ACGT' FROM supplier
""")
def ruled_imports(table):
    """Records in two formats read by two rule texts: variables, tags, an included part, joined lines, sequences."""
    c, sup = table("customer"), table("supplier")
    text = lambda name: F.col(name).cast("string")
    again = F.when(F.col("c_custkey") % 2 == 0, F.lit("DE   again"))
    keyed = F.concat_ws("\n", F.concat(F.lit("ID   "), "c_name", F.lit(";")), F.concat(F.lit("NA   "), text("c_nationkey")), F.concat(F.lit("DE   "), "c_mktsegment"), F.lit("     goes on; and"), F.concat(F.lit("BA   "), F.format_string("%.2f", F.col("c_acctbal"))), F.lit("XX"), again, F.lit("SQ   sequence"), F.concat(F.lit("   1 acgu "), text("c_custkey")), F.lit("//"))
    titled = F.concat(F.lit(">s"), text("s_suppkey"), F.lit(" supplier "), text("s_nationkey"), F.lit("\nACGT "), text("s_suppkey"), F.lit("\n-ACGT"))
    spark, form, short = c.sparkSession, import_rules.parsed_rules(KEYED, {"balance": BALANCE}), import_rules.parsed_rules(TITLED)
    one = import_rules.imported_by(import_rules.records_of(spark, _text_files(c.select(keyed.alias("value")), "keyed"), form), form)
    two = import_rules.imported_by(import_rules.records_of(spark, _text_files(sup.select(titled.alias("value")), "titled"), short), short, {"first word": (s.replaced(r"(?s)^>(\S+).*$", r"\1"),)})
    row = lambda kind, df: df.select(F.lit(kind).alias("format"), "name", *[(df[k] if k in df.columns else F.lit(None).cast(t)).alias(k) for k, t in (("description", "string"), ("balance", "double"), ("place", "string"))], "data")
    return row("keyed", one).unionByName(row("titled", two))


_PATTERNS = "th-e, r?st # a comment\naccu"


@_r.query(f"""
    WITH p AS (SELECT * FROM (VALUES ('th-e', 'a comment', 'the'), ('r?st', 'a comment', 'r?st'), ('accu', '', 'accu')) v(pattern, comment, bare)),
    v AS (SELECT pattern, comment, c AS complement, r AS reverse, replace(lower(CASE WHEN r THEN reverse(x) ELSE x END), 't', 'u') AS w
          FROM (SELECT *, CASE WHEN c THEN translate(bare, '{intervals.DNA}', '{intervals.DNA_COMPLEMENT}') ELSE bare END AS x FROM p, (VALUES (true), (false)) a(c), (VALUES (true), (false)) b(r))),
    t AS (SELECT conv_id, turn, text, list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 1) NOT IN ('-', '.')) AS places, string_split(translate(replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 't', 'u'), '-.', ''), '') AS ch FROM conversations),
    o AS (SELECT conv_id, turn, places, ch, pattern, comment, complement, reverse, w, unnest(range(0, len(places) - length(w) + 1)) AS i FROM t, v),
    m AS (SELECT *, CASE WHEN substr(w, 1, 1) NOT IN ('?', ch[i + 1]) THEN 1 ELSE 0 END + CASE WHEN substr(w, 2, 1) NOT IN ('?', ch[i + 2]) THEN 1 ELSE 0 END + CASE WHEN substr(w, 3, 1) NOT IN ('?', ch[i + 3]) THEN 1 ELSE 0 END
          + CASE WHEN length(w) > 3 AND substr(w, 4, 1) NOT IN ('?', ch[i + 4]) THEN 1 ELSE 0 END AS n FROM o)
    SELECT conv_id || '/' || turn AS id, pattern, comment, complement, reverse, places[i + 1]::INTEGER AS start, places[i + length(w)]::INTEGER AS stop, n::INTEGER AS mismatches FROM m WHERE n <= 1
""")
def pattern_places(table):
    """Three patterns in all turns, over gaps, with up to one mismatch, in all four directions."""
    turns = spread(table("conversations")).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    return patterns.pattern_hits(turns, "id", "text", _PATTERNS, patterns.Options(most=1, complement=True, reverse=True))


_LETTERS, _BRACKETS = "aeoidD", "()[]dD"


@_r.query("""
    WITH t AS (SELECT conv_id || '/' || turn AS id, text FROM conversations),
    c AS (SELECT id, unnest(range(1, length(text) + 1)) AS pos, text FROM t), x AS (SELECT id, pos, substr(text, pos, 1) AS ch, pos > 1 AND substr(text, pos - 1, 1) IN ('t', 'n') AS inner_ FROM c),
    y AS (SELECT *, sum(CASE WHEN ch IN ('t', 'n') AND NOT inner_ THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS run FROM x),
    nm AS (SELECT id, run, string_agg(ch, '' ORDER BY pos) AS helix FROM y WHERE ch IN ('t', 'n') GROUP BY id, run),
    b AS (SELECT y.id, pos, ch, coalesce(helix, '0') AS helix, ch IN ('a', 'o', 'd') AS opens FROM y LEFT JOIN nm USING (id, run) WHERE ch IN ('a', 'e', 'o', 'i', 'd', 'D')),
    d AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY id, helix ORDER BY pos) AS after FROM b),
    e AS (SELECT *, least(0, coalesce(min(after) OVER (PARTITION BY id, helix ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM d),
    l AS (SELECT *, NOT opens AND after < low AS stray, CASE WHEN opens THEN after - low ELSE after + 1 - low END AS level FROM e),
    n AS (SELECT *, row_number() OVER (PARTITION BY id, helix, level, opens ORDER BY pos) AS k FROM l WHERE NOT stray),
    p AS (SELECT coalesce(a.id, z.id) AS id, coalesce(a.helix, z.helix) AS helix, a.pos AS "left", z.pos AS "right", a.ch AS o, z.ch AS c
          FROM (SELECT * FROM n WHERE opens) a FULL JOIN (SELECT * FROM n WHERE NOT opens) z ON a.id = z.id AND a.helix = z.helix AND a.level = z.level AND a.k = z.k)
    SELECT id, helix, "left"::INTEGER AS "left", "right"::INTEGER AS "right", CASE WHEN "left" IS NULL OR "right" IS NULL OR (c = 'D' AND o <> 'd') THEN NULL WHEN c = 'D' THEN 'd' ELSE 'pair' END AS kind,
           CASE WHEN "left" IS NULL OR "right" IS NULL THEN 'unpaired' WHEN c = 'D' AND o <> 'd' THEN 'kind' END AS fault FROM p
    UNION ALL SELECT id, helix, NULL, pos::INTEGER, NULL, 'unpaired' FROM l WHERE stray
""")
def helix_brackets(table):
    """Helix lines made from all turns: vowels are brackets, runs of t and n the helices' names, which may cross."""
    turns = table("conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    made = turns.select("id", F.regexp_replace("text", "(?s)[^tn]", ".").alias("numbers"), F.translate(F.regexp_replace("text", f"(?s)[^{_LETTERS}]", "."), _LETTERS, _BRACKETS).alias("helix_line"))
    return intervals.bracket_pairs(made, "id", "numbers", "helix_line")


@_r.query("""
    WITH m AS (SELECT * FROM (VALUES (3, 4), (4, 5), (8, 20), (12, 22), (13, 23)) v(s, t)), n AS (SELECT s, t, lead(s) OVER (ORDER BY s) AS s2, lead(t) OVER (ORDER BY s) AS t2 FROM m),
    i AS (SELECT s, t, s2, t2, unnest(range(0, s2 - s - 1)) AS o, s2 - s - 1 AS n, t2 - t - 1 AS r FROM n WHERE s2 - s > 1),
    soft AS (SELECT s + 1 + o AS src, s AS l, s2 AS rr, t AS f, t2 AS la, CASE WHEN (CASE WHEN n > 1 AND r > 1 THEN (r - 1) / (n - 1) ELSE 0.0 END) >= 1 AND r > n THEN t + 1 + o + CASE WHEN o < n // 2 THEN 0 ELSE r - n END
                  ELSE floor(t + 1 + o * (CASE WHEN n > 1 AND r > 1 THEN (r - 1) / (n - 1) ELSE 0.0 END) + 0.5)::INT END AS tgt FROM i
             UNION ALL SELECT s, s, s, t, t, t FROM m),
    c AS (SELECT p_partkey, unnest(range(1, length(d) + 1)) AS src, d FROM (SELECT p_partkey, translate(p_name || '-' || p_type, ' i', '-.') AS d FROM part)),
    g AS (SELECT p_partkey, src, substr(d, src, 1) AS ch FROM c), k AS (SELECT *, ch IN ('-', '.') AS gap FROM g),
    q AS (SELECT *, max(CASE WHEN NOT gap THEN src END) OVER (PARTITION BY p_partkey ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst FROM k),
    h AS (SELECT a.p_partkey, a.src, a.ch, coalesce((SELECT z.ch FROM k z WHERE z.p_partkey = a.p_partkey AND z.gap AND z.src = coalesce(a.lst, 0) + 1 AND z.src < a.src), '-') AS gp FROM q a WHERE NOT a.gap),
    b AS (SELECT h.*, l, rr, f, la, tgt, CASE WHEN h.src < 3 THEN -1 WHEN h.src > 13 THEN 13 ELSE coalesce(l, 0) END AS seg, coalesce(l = rr, false) AS fixed FROM h LEFT JOIN soft ON soft.src = h.src),
    u AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, seg, fixed ORDER BY src) AS kk, count(*) OVER (PARTITION BY p_partkey, seg, fixed) AS nn FROM b),
    w AS (SELECT *, nn >= la - f - 1 AS tight, CASE WHEN src < 3 THEN 4 - nn + kk - 1 WHEN src > 13 THEN 23 + kk WHEN fixed THEN tgt WHEN nn >= la - f - 1 THEN f + kk ELSE tgt END AS want FROM u),
    v AS (SELECT *, CASE WHEN NOT fixed AND src > 3 AND src < 13 AND NOT tight THEN least(min(want - kk) OVER (PARTITION BY p_partkey, seg, fixed ORDER BY src DESC), la - 1 - nn) + kk ELSE want END AS wish FROM w),
    x AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY src) AS i FROM v), y AS (SELECT *, greatest(max(wish - i) OVER (PARTITION BY p_partkey ORDER BY src), 0) + i AS place FROM x),
    e AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY p_partkey ORDER BY src), 0) AS before FROM y)
    SELECT p_partkey, rpad(string_agg(repeat(CASE WHEN i = 1 THEN '.' ELSE gp END, (place - before - 1)::INT) || ch, '' ORDER BY i), greatest(max(place), 23)::INT, '.') AS data FROM e GROUP BY p_partkey
""")
def soft_remapped_data(table):
    """Strings moved to another alignment of which five columns are known: bases between them share the places there."""
    part = table("part").select("p_partkey", F.translate(F.concat_ws("-", "p_name", "p_type"), " i", "-.").alias("data"))
    mapping = part.sparkSession.createDataFrame([(3, 4), (4, 5), (8, 20), (12, 22), (13, 23)], "source int, target int")
    return merging.soft_remapped(part, "p_partkey", "data", mapping)


@_r.query("""
    SELECT c_name AS name, 'DB' AS source, c_acctbal < 0 AS marked, c_mktsegment AS first_tag, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS tags, '/customer/account/balance=' || printf('%.2f', c_acctbal) AS child FROM customer
""")
def dump_items(table):
    """Customers from dumps: one row an item, its repeated fields in order, and the children of a container of it."""
    c = table("customer")
    lines = [
        F.concat(F.lit("customer\t\t%"), F.when(F.col("c_acctbal") < 0, "$").otherwise("%"), F.lit(" (%")), F.concat(F.lit('\tname\t\t"'), "c_name", F.lit('"')), F.concat(F.lit('\ttag\t\t"'), "c_mktsegment", F.lit('"')),
        F.lit("\taccount\t\t%% (%"), F.concat(F.lit("\t\tbalance\t%f "), F.format_string("%.2f", F.col("c_acctbal"))), F.lit("\t\t%)"), F.when(F.col("c_custkey") % 2 == 0, '\ttag\t\t"more"'), F.lit('\tsource\t\t"DB"'), F.lit("\t%)"),
    ]
    read = nodes.read_nodes(c.sparkSession, _text_files(c.select(F.concat_ws("\n", *lines).alias("value")), "dump-items"))
    items = nodes.items_of(read, "/customer", ["name", "source", "tag"])
    tags = nodes.children(read, nodes.at_path(read, "/customer"), "tag").groupBy("file", F.col("parent").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("tags"))
    account = nodes.at_path(read, "/*/account")
    below = nodes.children(read, account).select("file", F.col("parent").alias("_a"), F.concat_ws("=", "path", "value").alias("child")).join(account.select("file", F.col("id").alias("_a"), F.col("parent").alias("id")), ["file", "_a"])
    return items.join(tags, ["file", "id"]).join(below, ["file", "id"]).select("name", "source", "marked", F.col("tag").alias("first_tag"), "tags", "child")


@_r.query("""
    SELECT p_partkey, p_name AS sequence, 'dna/' || p_brand AS kind_and_field, regexp_replace(p_name, '[A-Za-z]', 'N', 'g') AS changed, CASE WHEN p_partkey % 2 = 0 THEN left(p_name, 3) ELSE p_name END AS piece FROM part
""")
def sequence_commands(table):
    """An item's sequence, its kind and fields as streams, letters changed by another sequence, and a gene's own piece."""
    part = table("part")
    spot = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"), F.lit(False).alias("complement"), F.lit("").alias("fuzzy_start"), F.lit("").alias("fuzzy_stop"))
    stop = F.when(F.col("p_partkey") % 2 == 0, F.lit(3)).otherwise(F.char_length("p_name"))
    return part.select(
        "p_partkey", s.apply(F.lit(""), s.sequence("p_name")).alias("sequence"), s.apply(F.lit(""), s.fork(s.sequence_type("dna"), s.read("p_brand")), s.merge("/")).alias("kind_and_field"),
        s.changed(F.col("p_name"), F.repeat(F.lit("x"), F.char_length("p_name")), "x", "N").alias("changed"), s.apply(F.lit(""), s.sequence("p_name", F.array(spot(F.lit(1), stop)))).alias("piece"),
    )
