"""Queries of string functions and streams."""

from pyspark.sql import functions as F

from stringloom.functions import streams as s
from stringloom.functions import text as t
from stringloom.operators import search
from stringloom.plans.registry import Registry, spread

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.query("""
    SELECT p_partkey, left(p_name, 3) AS head3, right(p_name, 4) AS tail4, substr(p_name, 2, 4) AS mid, right(p_name, 3) AS last3,
           upper(p_name) AS up, trim(p_name, 'sr') AS cropped, regexp_replace(p_name, '[aeiou]', '', 'g') AS removed,
           regexp_replace(p_name, '[^aeiou]', '', 'g') AS kept, length(regexp_replace(p_name, '[^aeiou]', '', 'g'))::VARCHAR AS vowels,
           length(replace(p_name, ' ', ''))::VARCHAR AS letters, rpad(p_name, greatest(14, length(p_name))::INT, ' ') AS tabbed,
           lpad(p_name, greatest(14, length(p_name))::INT, ' ') AS pretabbed, translate(p_name, 'abc', 'xyz') AS translated
    FROM part
""")
def string_commands(table):
    run = lambda *c: s.apply(F.col("p_name"), *c)
    return table("part").select(
        "p_partkey", run(s.head(3)).alias("head3"), run(s.tail(4)).alias("tail4"), run(s.mid(2, 5)).alias("mid"), run(s.mid(-2, 0)).alias("last3"),
        run(s.upper).alias("up"), run(s.crop("sr")).alias("cropped"), run(s.remove("aeiou")).alias("removed"), run(s.keep("aeiou")).alias("kept"),
        run(s.count("aeiou")).alias("vowels"), run(s.length(" ")).alias("letters"), run(s.tab(14)).alias("tabbed"), run(s.pretab(14)).alias("pretabbed"),
        run(s.translate("abc", "xyz")).alias("translated"),
    )


@_r.query("""
    SELECT p_partkey, split_part(p_name, ' ', 2) || split_part(p_name, ' ', 1) AS swapped, p_name || '-' || p_name AS doubled,
           len(string_split(p_name, ' '))::VARCHAR AS words, split_part(p_name, ' ', 2) AS second, replace(p_name, ' ', '+') AS merged,
           p_brand || ': ' || p_name AS labelled
    FROM part
""")
def stream_commands(table):
    run = lambda *c: s.apply(F.col("p_name"), *c)
    return table("part").select(
        "p_partkey", run(s.split(" "), s.swap()).alias("swapped"), run(s.fork(s.dd, s.echo("-"), s.dd)).alias("doubled"),
        run(s.split(" "), s.streams).alias("words"), run(s.split(" "), s.cut(2)).alias("second"), run(s.split(" "), s.merge("+")).alias("merged"),
        run(s.fork(s.read("p_brand"), s.echo(": "), s.dd)).alias("labelled"),
    )


@_r.query("""
    SELECT p_partkey, CASE WHEN p_name < p_type THEN '-1' WHEN p_name > p_type THEN '1' ELSE '0' END AS compared,
           CASE WHEN lower(p_name) < lower(p_type) THEN '-1' WHEN lower(p_name) > lower(p_type) THEN '1' ELSE '0' END AS caseless,
           (p_name = p_type)::INT::VARCHAR AS equal, instr(p_name, 'ed')::VARCHAR AS contained, instr(lower(p_type), 'nom')::VARCHAR AS caseless_contained,
           instr('small ring and more', p_name)::VARCHAR AS part_of
    FROM part
""")
def compare_commands(table):
    both = lambda c: s.apply(F.lit(""), s.fork(s.read("p_name"), s.read("p_type")), c)
    return table("part").select(
        "p_partkey", both(s.compare()).alias("compared"), both(s.icompare()).alias("caseless"), both(s.equals()).alias("equal"),
        s.apply(F.col("p_name"), s.contains("ed")).alias("contained"), s.apply(F.col("p_type"), s.icontains("NOM")).alias("caseless_contained"),
        s.apply(F.col("p_name"), s.partof("small ring and more")).alias("part_of"),
    )


@_r.query("""
    SELECT p_partkey, (p_size + p_partkey)::VARCHAR AS plus, (p_size - p_partkey)::VARCHAR AS minus, (p_size * 42)::VARCHAR AS mult,
           (CASE WHEN p_partkey = 0 THEN 0 ELSE p_size // p_partkey END)::VARCHAR AS div, (p_size % 7)::VARCHAR AS rest,
           (CASE WHEN p_partkey = 0 THEN 0 ELSE (p_size * 100) // p_partkey END)::VARCHAR AS per_cent,
           CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'two' END AS selected
    FROM part
""")
def calculator_commands(table):
    both = lambda c: s.apply(F.lit(""), s.fork(s.read("p_size"), s.read("p_partkey")), c)
    size = lambda *c: s.apply(F.col("p_size"), *c)
    return table("part").select(
        "p_partkey", both(s.plus()).alias("plus"), both(s.minus()).alias("minus"), size(s.mult("42")).alias("mult"), both(s.div()).alias("div"),
        size(s.rest("7")).alias("rest"), both(s.per_cent()).alias("per_cent"),
        size(s.rest("3"), s.select(s.echo("none"), s.echo("one"), s.echo("two"))).alias("selected"),
    )


@_r.query(r"""
    SELECT p_partkey, replace(replace(p_name, 'red', 'crimson'), 'ring', 'loop') AS words, regexp_replace(p_name, 'r(.)', 'R-\1', 'g') AS one,
           regexp_replace(p_name, '^(.)(.*?) (.*)$', '\1. \3') AS short, regexp_replace(p_brand, '#([0-9])', ' no. \1') AS brand
    FROM part
""")
def replacement_rules(table):
    return table("part").select(
        "p_partkey", t.replace_rules(F.col("p_name"), ("red", "crimson"), ("ring", "loop")).alias("words"), t.replace_rules(F.col("p_name"), ("r?", "R-?")).alias("one"),
        t.replace_rules(F.col("p_name"), ("?* *", "?. *2")).alias("short"), t.replaced(F.col("p_brand"), "#([0-9])", " no. \\1").alias("brand"),
    )


@_r.query(r"""
    SELECT o_orderkey, regexp_extract(o_orderpriority, '[A-Z ]+') AS name, regexp_extract(o_orderpriority, '^[0-9]') AS level,
           replace(replace(o_orderpriority, '\', '\\'), '"', '\"') AS escaped, '"' || o_orderpriority || '"' AS quoted,
           CASE WHEN o_totalprice > 100000 THEN o_orderpriority ELSE '' END AS big
    FROM orders
""")
def regex_and_quotes(table):
    c = F.col("o_orderpriority")
    return table("orders").select(
        "o_orderkey", t.matched(c, "[A-Z ]+").alias("name"), t.matched(c, "^[0-9]").alias("level"), t.escape(c).alias("escaped"),
        s.apply(c, s.quote).alias("quoted"), F.when(F.col("o_totalprice") > 100000, t.unquote(t.quote(c))).otherwise("").alias("big"),
    )


@_r.query("""
    SELECT doc_id, array_to_string(list_sort(list_filter(regexp_split_to_array(text, '[ \\t,;:|]'), lambda w: length(regexp_replace(w, '[^aeiou]', '', 'g')) >= 5 AND w <> '')), ' ') AS words,
           array_to_string(list_filter(regexp_split_to_array(text, '[ \\t,;:|]'), lambda w: length(w) >= 3 AND length(regexp_replace(w, '[^aeinrst]', '', 'g')) >= length(w) * 0.9), ' ') AS mostly
    FROM documents
""".replace("\\\\t", "\\t"))
def extracted_words(table):
    return spread(table("documents")).select("doc_id", t.extract_words(F.col("text"), "aeiou", 5).alias("words"), t.extract_sequence(F.col("text"), "aeinrst", 0.9).alias("mostly"))


@_r.query("""
    SELECT c_custkey, array_to_string(list_transform(range(0, ((length(c_name) - 1) // 8 + 1)::BIGINT), lambda i: '  ' || rpad(trim(substr(c_name, i * 8 + 1, 4) || ' ' || substr(c_name, i * 8 + 5, 4)), 9, ' ') || ' ' || lpad(least((i + 1) * 8, length(c_name))::VARCHAR, 4, ' ')), chr(10)) AS lines
    FROM customer
""")
def formatted_sequences(table):
    return table("customer").select("c_custkey", t.format_sequence(F.col("c_name"), width=8, first_tab=2, tab=2, gap=4, number_right=4).alias("lines"))


@_r.query("""
    SELECT event_id, list_reduce(list_concat([0::BIGINT], list_transform(range(0, length(props)), lambda i: (ascii(upper(substr(props, i + 1, 1))) * (i % 57 + 1))::BIGINT)), lambda a, b: a + b) % 10000 AS checksum
    FROM events
""")
def sequence_checksums(table):
    return table("events").select("event_id", t.gcg_checksum(F.col("props")).alias("checksum"))


@_r.query()
def text_checksums(table):
    """CRC-32 of whole texts; DuckDB has no CRC."""
    return table("documents").select("doc_id", t.checksum(F.col("text"), exclude=" \n", upper=True).alias("checksum"))


@_r.query()
def wrapped_texts(table):
    """Whole texts in lines of 60; the character machine of the wrapping isn't SQL."""
    return table("documents").select("doc_id", t.format_text(F.col("text"), width=60, first_tab=0, tab=2).alias("lines"))


@_r.query("""
    SELECT p_partkey, '[BRAND] ' || CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || ' ' || p_name END || ' [TYPE] ' || p_type AS merged, p_brand AS brand
    FROM part
""")
def merged_tags(table):
    a = F.concat(F.lit("[BRAND] "), "p_brand", F.lit(" [TYPE] "), "p_type")
    b = F.concat(F.lit("[TYPE] "), "p_type", F.lit(" [BRAND] "), "p_name")
    return table("part").select("p_partkey", t.merge_tags(a, b).alias("merged"), F.try_element_at(t.tags(a), F.lit("BRAND")).alias("brand"))


@_r.query("""
    SELECT o_orderkey, upper(strftime(o_orderdate, '%d-%b-%Y')) AS record_date FROM orders
""")
def record_dates(table):
    return table("orders").select("o_orderkey", t.record_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("record_date"))


@_r.query(r"""
    SELECT p_partkey, array_to_string(list_transform(range(1, length(p_name) + 1), lambda i: CASE WHEN i <= length(p_type) AND lower(substr(p_type, i, 1)) = substr(p_name, i, 1) THEN '.' ELSE substr(p_name, i, 1) END), '') AS difference,
           array_to_string(list_filter(list_transform(range(1, length(p_name) + 1), lambda i: CASE WHEN i <= length(p_type) AND substr(p_type, i, 1) IN ('E', 'O', 'A') THEN substr(p_name, i, 1) ELSE '' END), lambda c: c <> ''), '') AS filtered
    FROM part
""")
def compared_columns(table):
    return table("part").select("p_partkey", s.difference(F.col("p_name"), F.lower("p_type")).alias("difference"), s.filtered(F.col("p_name"), F.col("p_type"), include="EOA").alias("filtered"))


@_r.query("""
    SELECT c_custkey, rpad(left(c_name, 20), 20, ' ') || ' ' || rpad(left(c_mktsegment, 8), 8, ' ') AS padded,
           c_name || ',' || c_nationkey || ',' || c_mktsegment AS csv
    FROM customer
""")
def display_lines(table):
    columns = [("name", F.col("c_name"), 20), ("segment", F.col("c_mktsegment"), 8)]
    csv = [("name", F.col("c_name"), 20), ("nation", F.col("c_nationkey"), 4), ("segment", F.col("c_mktsegment"), 8)]
    c = table("customer")
    return c.select("c_custkey", search.display(c, columns).alias("padded"), search.display(c, csv, "csv").alias("csv"))


@_r.query("""
    WITH l AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_size || ' 0', ' ') AS w FROM part)
    SELECT p_partkey, array_to_string(w[1:1] || w[3:], ',') AS dropped, array_to_string(w[1:1] || w[3:] || w[2:2], ',') AS back, array_to_string(w[3:3] || w[1:2] || w[4:], ',') AS front,
           array_to_string(list_filter(w, lambda x: coalesce(try_cast(x AS BIGINT), 0) <> 0), ',') AS numbers, array_to_string(list_filter(string_split(replace(array_to_string(w, ','), 'e', ','), ','), lambda x: x <> ''), ',') AS filled,
           array_to_string(w, '') || '/' || array_to_string(w, '') AS twice FROM l
""")
def list_commands(table):
    """Commands on lists of streams: drop, toback, tofront, dropzero, dropempty, do."""
    words = F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string"), F.lit("0"))
    run = lambda *commands: s.apply(words, s.split(" "), *commands, s.merge(","))
    both = s.apply(words, s.split(" "), s.fork(s.do(s.dd), s.echo("/"), s.do(s.dd)))
    return table("part").select(
        "p_partkey", run(s.drop(2)).alias("dropped"), run(s.toback(2)).alias("back"), run(s.tofront(3)).alias("front"), run(s.dropzero).alias("numbers"),
        s.apply(words, s.split(" "), s.merge(","), s.split("e"), s.merge(","), s.split(","), s.dropempty, s.merge(",")).alias("filled"), both.alias("twice"),
    )


@_r.query("""
    SELECT o_orderkey, (o_totalprice::DECIMAL(18, 2)::VARCHAR) AS price, (4000000000 + o_orderkey)::VARCHAR AS big, CASE WHEN o_custkey % 4 = 0 THEN (o_custkey // 4)::VARCHAR ELSE rtrim(printf('%.2f', o_custkey / 4.0), '0') END AS quarter,
           CASE WHEN o_orderkey % 50 = 0 THEN 0.0 ELSE round(list_sum(list_transform(range(1, o_orderkey % 50 + 1), lambda i: ln(i))), 9) + 0.0 END AS log_factorial
    FROM orders
""")
def numbers_as_texts(table):
    """Numbers of more digits than 32 bits hold in calculations, numbers as texts, and logarithms of factorials."""
    big = s.apply(F.lit("4000000000"), s.fork(s.dd, s.read("o_orderkey")), s.plus())
    return table("orders").select(
        "o_orderkey", F.format_string("%.2f", "o_totalprice").alias("price"), big.alias("big"), t.number_text(F.col("o_custkey") / 4, 2).alias("quarter"),
        (F.round(t.log_factorial((F.col("o_orderkey") % 50).cast("int")), 9) + 0.0).alias("log_factorial"),
    )


@_r.query("""
    WITH x AS (SELECT p_partkey, p_name AS a, p_type AS b, p_brand AS c FROM part)
    SELECT p_partkey, rpad(a, (length(a) // 8 + 1)::INT * 8, ' ') || b || chr(10) || rpad(c, (length(c) // 8 + 1)::INT * 8, ' ') || a AS expanded,
           replace(replace(a, ' ', ', '), ', ', ' and ') AS authors, replace(a, 'e', CASE WHEN p_partkey % 2 = 0 THEN '[' || b || ']' ELSE '[none]' END) AS filled, CASE WHEN length(c) < 9 THEN 'short' WHEN c LIKE '%#%' THEN 'character' END AS fault FROM x
""")
def record_texts(table):
    """Tabs filled up, lists of authors, rules that insert a field or its default, and names that are no keys."""
    tabbed = F.concat("p_name", F.lit("\t"), "p_type", F.lit("\n"), "p_brand", F.lit("\t"), "p_name")
    optional = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
    value = t.field(optional, "none")
    return table("part").select(
        "p_partkey", t.expand_tabs(tabbed).alias("expanded"), t.author_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" ;"))).alias("authors"),
        t.replace_rules(F.col("p_name"), ("e", F.concat(F.lit("["), value, F.lit("]")))).alias("filled"), t.key_fault(F.col("p_brand"), 9).alias("fault"),
    )
