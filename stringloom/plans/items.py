"""Queries of searches, hit sets, marks, merges and change feeds."""

import uuid

from pyspark.sql import functions as F

from stringloom.functions import predicates as p
from stringloom.functions import streams as s
from stringloom.functions import text as t
from stringloom.operators import merging, search
from stringloom.operators.columns import smoothed
from stringloom.operators.storage import ranked, shared_folder
from stringloom.plans.registry import Registry
from stringloom.sources import records
from stringloom.streaming import changes

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.query(r"""
    SELECT doc_id, n_chars, length(replace(text, ' ', '')) AS n_solid, left(text, 40) AS beginning FROM documents
    WHERE regexp_matches(text, '(?is)^.*license.*$')
""")
def search_report(table):
    """Texts that match a wildcard, with what programs make of them, longest first."""
    found = table("documents").filter(p.matches(F.col("text"), "*license*"))
    shown = found.select("doc_id", "n_chars", s.apply(F.col("text"), s.length(" ")).cast("long").alias("n_solid"), s.apply(F.col("text"), s.head(40)).alias("beginning"))
    return shown.orderBy(search.missing_last("n_chars", True), "doc_id")


@_r.query(r"""
    SELECT p_partkey, regexp_matches(p_name, '(?i)^s.*ing$') AS star, regexp_matches(p_name, '(?i)^.ed .*$') AS one_char, regexp_matches(p_brand, '^Brand#1[0-9]$') AS regex,
           p_size < 10 AS small, NOT coalesce(try_cast(p_type AS DOUBLE) < 7, false) AS not_small, p_name IS NULL AS missing, instr(lower(p_name), 'in') AS place
    FROM part
""")
def predicates(table):
    c = F.col
    return table("part").select(
        "p_partkey", p.matches(c("p_name"), "S*ing").alias("star"), p.matches(c("p_name"), "?ed *").alias("one_char"), p.matches(c("p_brand"), "/^Brand#1[0-9]$/").alias("regex"),
        p.matches(c("p_size"), "<10").alias("small"), (~p.matches(c("p_type"), "<7")).alias("not_small"), p.matches(c("p_name"), "").alias("missing"), p.position(c("p_name"), "IN", ignore_case=True).alias("place"),
    )


@_r.query("""
    SELECT c_custkey FROM customer WHERE ((c_mktsegment ILIKE 'build%' OR c_acctbal < 0) AND NOT c_nationkey > 15)
""")
def search_lines(table):
    c = F.col
    found = p.combined(p.Line(p.matches(c("c_mktsegment"), "build*")), p.Line(p.matches(c("c_acctbal"), "<0"), "or"), p.Line(p.matches(c("c_nationkey"), ">15"), "and", True))
    return search.generate(table("customer"), "c_custkey", found)


@_r.query("SELECT p_partkey FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%' OR p_size::VARCHAR ILIKE '%ring%'")
def search_any_field(table):
    return table("part").filter(search.in_fields(table("part"), ["p_name", "p_brand", "p_type", "p_size"], "*ring*")).select("p_partkey")


@_r.query("SELECT p_partkey FROM part WHERE (length(regexp_replace(p_name, '[^aeiou]', '', 'g')) // 3)::VARCHAR <> '0'")
def search_by_program(table):
    return table("part").filter(p.program_hits(s.apply(F.col("p_name"), s.count("aeiou"), s.div("3")))).select("p_partkey")


@_r.query("""
    WITH a AS (SELECT doc_id FROM documents WHERE lang = 'de'), b AS (SELECT doc_id FROM documents WHERE n_chars > 3000),
         labelled AS (SELECT DISTINCT doc_id FROM labels), toxic AS (SELECT doc_id FROM labels WHERE toxic = 1)
    SELECT DISTINCT doc_id FROM (SELECT * FROM a UNION SELECT * FROM b) WHERE doc_id IN (SELECT doc_id FROM labelled) AND doc_id NOT IN (SELECT doc_id FROM toxic)
""")
def hit_sets(table):
    """Generate, enlarge, reduce, then leave out."""
    docs, labels = table("documents"), table("labels")
    hits = search.enlarge(search.generate(docs, "doc_id", F.col("lang") == "de"), search.generate(docs, "doc_id", F.col("n_chars") > 3000))
    return search.without(search.reduce(hits, labels.select("doc_id")), labels.filter("toxic = 1").select("doc_id"))


@_r.query("""
    SELECT doc_id, CASE WHEN count(*) OVER w = 1 THEN 'unique' WHEN doc_id = min(doc_id) OVER w THEN '1st' ELSE 'dup' END AS state,
           min(doc_id) OVER w AS first, count(*) OVER w AS copies
    FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text)
""")
def duplicate_texts(table):
    return search.duplicates(table("documents"), "doc_id", "text")


@_r.query(r"""
    SELECT word, count(*) AS items, min(item_id) AS first FROM (SELECT DISTINCT item_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS word FROM benchmark)
    WHERE word <> '' GROUP BY word HAVING count(*) > 1
""")
def shared_words(table):
    return search.word_duplicates(table("benchmark"), "item_id", "text")


@_r.query("""
    SELECT o_orderkey, row_number() OVER (ORDER BY c_mktsegment DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey) AS rank
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
""")
def sorted_orders(table):
    """A cascade of keys, missing last in both directions, as ranks; no task sees all rows."""
    rows = table("orders").join(table("customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    order = [search.missing_last("c_mktsegment", True), search.missing_last("o_totalprice"), F.col("o_orderkey").asc()]
    return ranked(rows.select("o_orderkey", "c_mktsegment", "o_totalprice"), order).select("o_orderkey", "rank")


@_r.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def top_orders(table):
    return table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(50)


@_r.query("SELECT c_custkey, NOT (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) AS marked FROM customer")
def inverted_marks(table):
    hits = table("orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return search.inverted(search.marked(table("customer"), hits, "c_custkey")).select("c_custkey", "marked")


@_r.query("SELECT p_partkey, (split_part(p_name, ' ', 1) IN (SELECT DISTINCT lower(p_type) FROM part) OR split_part(p_name, ' ', 2) IN ('ring', 'widget')) AS marked FROM part")
def marked_by_list(table):
    words = table("part").select(F.lower("p_type").alias("word")).distinct().unionByName(table("part").sparkSession.createDataFrame([("ring",), ("widget",)], "word string"))
    return search.mark_by_list(table("part"), "p_partkey", "p_name", words, "word").select("p_partkey", "marked")


@_r.query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment || '; debtor' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def appended_field(table):
    c = table("customer")
    return search.written(c, search.generate(c, "c_custkey", F.col("c_acctbal") < 0), "c_custkey", "c_mktsegment", F.lit("debtor"), "; ").select("c_custkey", "c_mktsegment")


@_r.query("""
    SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) = 1 THEN p_name ELSE p_name || lpad(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey)::VARCHAR, 3, '0') END AS unique_name
    FROM part
""")
def unique_names(table):
    return search.numbered_names(table("part"), "p_partkey", "p_name")


@_r.query("""
    SELECT 'c_custkey' AS field, 'bigint' AS type, count(c_custkey) AS items FROM customer UNION ALL SELECT 'c_name', 'string', count(c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment) FROM customer
""")
def scanned_fields(table):
    return search.field_scan(table("customer"))


@_r.query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def values_missing_elsewhere(table):
    return merging.equal_values(table("customer"), table("orders"), "c_custkey", "o_custkey", exists=False)


@_r.query(r"""
    WITH known AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS word FROM benchmark),
         words AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS word FROM documents)
    SELECT doc_id, count(*) AS common FROM words JOIN known USING (word) WHERE word <> '' GROUP BY doc_id
""")
def words_in_both(table):
    return merging.word_overlap(table("documents"), "doc_id", "text", table("benchmark"), "text")


@_r.query("""
    WITH changed AS (SELECT c_custkey + 100 AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS c_acctbal FROM customer)
    SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, c_name, coalesce(b.c_acctbal, a.c_acctbal) AS c_acctbal
    FROM (SELECT c_custkey, c_name, c_acctbal FROM customer) a FULL JOIN changed b ON a.c_custkey = b.c_custkey
""")
def upserted_customers(table):
    base = table("customer").select("c_custkey", "c_name", "c_acctbal")
    changed = base.select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return merging.upserted(base, changed, "c_custkey")


@_r.query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0 OR s_suppkey % 3 <> 0
""")
def replayed_delta(table):
    base = table("supplier").select("s_suppkey", "s_acctbal")
    delta = base.filter("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_acctbal") * 2).alias("s_acctbal"), (F.col("s_suppkey") % 5 == 0).alias("deleted"))
    return merging.fresh_delta(base, delta, "s_suppkey", "deleted")


@_r.query("""
    SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END END AS c_acctbal, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment, c_custkey % 5 = 0 AS deleted
    FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0 OR c_custkey % 7 = 0 OR c_custkey % 4 = 0
""")
def saved_deltas(table):
    """Only what changed: new customers, some with another balance or without a segment, and those that are gone."""
    c = table("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    before = c.filter("c_custkey % 4 != 0 or c_custkey % 5 = 0")
    now = c.filter("c_custkey % 5 != 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return merging.saved_delta(before, now, "c_custkey")


@_r.query("""
    SELECT o_orderkey, coalesce(c_name, '') AS organism, (length(coalesce(c_mktsegment, '')) - length(replace(coalesce(c_mktsegment, ''), 'E', '')))::VARCHAR AS letters FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 20
""")
def origin_fields(table):
    """Orders as items taken from customers: commands on fields of the origin, of which some are absent."""
    found = merging.with_origin(table("orders"), "o_custkey", table("customer").filter("c_nationkey < 20"), "c_custkey")
    return found.select("o_orderkey", s.apply(t.empty_if_null(F.col("origin.c_name"))).alias("organism"), s.apply(t.empty_if_null(F.col("origin.c_mktsegment")), s.count("E")).alias("letters"))


@_r.query("""SELECT conv_id, string_agg(text, ' / ' ORDER BY turn) AS text, count(*) AS rows FROM conversations GROUP BY conv_id""")
def joined_turns(table):
    return merging.joined_items(table("conversations"), "conv_id", "turn", "text", " / ")


@_r.query("""
    WITH a AS (SELECT c_custkey AS id, c_mktsegment AS data FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, c_name AS data FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(a.id, b.id) AS id, coalesce(a.data, repeat('.', (SELECT max(length(data)) FROM a))) || '+' || coalesce(b.data, repeat('.', (SELECT max(length(data)) FROM b))) AS data
    FROM a FULL JOIN b ON a.id = b.id
""")
def concatenated_alignments(table):
    c = table("customer")
    a = c.filter("c_custkey % 3 != 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("data"))
    b = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("data"))
    return merging.concatenated([a, b], "id", "data", "+")


@_r.query("""
    SELECT c_name AS name, '>' || c_name || ' ' || c_mktsegment || chr(10) || c_name || c_mktsegment AS record FROM customer
""")
def fasta_records(table):
    c = table("customer")
    return c.select(F.col("c_name").alias("name"), records.fasta(F.col("c_name"), F.col("c_mktsegment"), F.concat("c_name", "c_mktsegment")).alias("record"))


@_r.query("""
    SELECT n_nationkey, upper(n_name) AS name, 'nation ' || n_name || ' of region' AS title, n_regionkey AS region FROM nation
""")
def imported_records(table):
    """Records of keyed lines, as an import filter reads them."""
    lines = F.concat(F.lit("ID   "), "n_name", F.lit("\nDE   nation "), "n_name", F.lit("\n     of region\nRN   "), F.col("n_regionkey").cast("string"))
    entries = table("nation").select("n_nationkey", records.keyed_lines(lines, 5).alias("lines"))
    rules = [records.Rule("ID", "name", (s.upper,)), records.Rule("D?", "title"), records.Rule("RN", "region", kind="int")]
    return records.imported(entries, rules, "n_nationkey")


@_r.query("""
    WITH last AS (SELECT user_id, event_type, max_by(value, event_id) AS value, max_by(event_type = 'error', event_id) AS gone FROM events GROUP BY user_id, event_type)
    SELECT '/user/' || user_id || '/' || event_type AS path, CASE WHEN gone THEN NULL ELSE value::DECIMAL(12, 2)::VARCHAR END AS value FROM last
""")
def streamed_latest_state(table):
    """The events as a change feed, run through a streaming query: the newest value of every path."""
    events = table("events")
    feed = _feed(events)
    rows = feed.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("/user/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"),
        F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), F.col("value").cast("decimal(12,2)").cast("string").alias("new"),
    )
    return _collected(changes.latest(rows), "latest")


@_r.query(r"""
    SELECT i + 1 AS pos, substr(props, i + 1, 1) AS ch, count(*)::BIGINT AS n FROM events, unnest(range(0, length(props))) AS x(i) GROUP BY ALL
""")
def streamed_column_counts(table):
    """Column counts kept by a streaming query over inserts."""
    events = table("events")
    feed = _feed(events)
    rows = feed.select(F.lit(None).cast("string").alias("old"), F.col("props").alias("new"))
    return _collected(changes.column_counts(rows), "counts")


@_r.query("""
    SELECT '/user/' || user_id || '/' || event_type AS path, CASE WHEN event_id % 3 = 0 THEN 'insert' ELSE 'update' END AS op, count(*)::BIGINT AS n, max(event_id) AS last
    FROM events WHERE event_type LIKE 'c%' AND event_id % 3 <> 2 GROUP BY ALL
""")
def streamed_commits(table):
    """A callback on every batch of changes at watched paths; what it wrote under each batch's number, counted by path."""
    events = table("events")
    spark, out = events.sparkSession, f"{shared_folder(events.sparkSession)}/commits-{uuid.uuid4().hex}"
    op = F.when(F.col("event_id") % 3 == 0, "insert").when(F.col("event_id") % 3 == 1, "update").otherwise("delete")
    rows = _feed(events).select(F.col("event_id").alias("seq"), F.concat(F.lit("/user/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"), op.alias("op"))
    kept = changes.watched(rows, "/user/*/c*", "insert", "update")
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/data/batch={batch}")
    changes.on_commit(kept, write, f"{out}/state").awaitTermination()
    done = spark.read.schema(kept.schema).parquet(f"{out}/data")
    return done.groupBy("path", "op").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


def _feed(table):
    """A table's files as a stream; the table is a folder of files or one file."""
    reader = table.sparkSession.readStream.schema(table.schema).option("maxFilesPerTrigger", 100)
    files = table.inputFiles()
    folder, _, name = files[0].rpartition("/")
    return reader.parquet(folder) if folder.endswith(".parquet") else reader.option("pathGlobFilter", name).parquet(folder)


def _collected(stream, name: str):
    """Runs an aggregating stream over what is there; the last batch's whole result is the answer."""
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/result")
    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/result")


@_r.query("""
    SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, avg(count(*)) OVER (PARTITION BY event_type ORDER BY time_bucket(INTERVAL 1 HOUR, ts) ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n_smoothed
    FROM events GROUP BY 1, 2
""")
def smoothed_series(table):
    hours = table("events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return smoothed(hours, "n", 2, "event_type", order="hour")


@_r.query("""
    SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), -1) AS k, CASE WHEN value::INTEGER::DOUBLE = value THEN value::INTEGER END AS whole FROM events
""")
def typed_fields(table):
    e = table("events").withColumn("k", F.get_json_object("props", "$.k"))
    whole = F.when(F.round("value") == F.col("value"), F.round("value").cast("int"))
    return e.select("event_id", F.coalesce(search.lossless(F.col("k"), "int"), F.lit(-1)).alias("k"), whole.alias("whole"))


@_r.query("SELECT c_custkey, c_acctbal < 0 AS marked FROM customer")
def restored_marks(table):
    """Marks that were stored under a name come back on items that lost them."""
    c = table("customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("marked"))
    kept = search.stored_marks(c, "c_custkey", slot="debt").unionByName(search.stored_marks(search.inverted(c), "c_custkey", slot="rest"))
    return search.restored_marks(c.withColumn("marked", F.lit(False)), kept, "c_custkey", "debt").select("c_custkey", "marked")


@_r.query("""
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN c_name WHEN 1 THEN s_name END AS name, CASE o_orderkey % 3 WHEN 0 THEN c_nationkey WHEN 1 THEN s_nationkey END::VARCHAR AS nation
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON o_custkey = s_suppkey
""")
def followed_links(table):
    """Links `type:id` to tables of several types; links to nothing give null."""
    link = F.concat(F.element_at(F.array(F.lit("customer"), F.lit("supplier"), F.lit("gone")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit(":"), F.col("o_custkey").cast("string"))
    c = table("customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    sup = table("supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    found = search.followed(table("orders").select("o_orderkey", link.alias("link")), "link", {"customer": (c, "c_custkey"), "supplier": (sup, "s_suppkey")}, "name", "nation")
    return found.select("o_orderkey", "name", "nation")


@_r.query("SELECT doc_id, CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 ELSE 1 END AS partial FROM documents")
def partial_flags(table):
    flag = F.when(F.col("lang") == "en", "0").when(F.col("lang") == "de", "1")
    return table("documents").select("doc_id", search.partial_flag(flag, 1).alias("partial"))


@_r.query("""
    WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) > 25 AS truncated FROM o WHERE k <= 25
""")
def limited_orders(table):
    """The first rows of an order, and whether there were more."""
    return search.limited(table("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


@_r.query("""
    SELECT p_partkey, unnest(list_filter([CASE WHEN NOT regexp_matches(p_name, '^[a-z]+ [a-z]+$') THEN 'two words' END, CASE WHEN p_size > 45 THEN 'size' END, CASE WHEN p_brand LIKE '%1%' THEN 'brand' END], lambda x: x IS NOT NULL)) AS fault FROM part
""")
def name_faults(table):
    """Rules that names and fields have to keep, and which of them a row breaks."""
    rules = {"two words": F.col("p_name").rlike("^[a-z]+ [a-z]+$"), "size": F.col("p_size") <= 45, "brand": ~F.col("p_brand").contains("1")}
    return search.faults(table("part"), "p_partkey", rules)


@_r.query("""
    SELECT p_partkey, CASE WHEN p_size % 3 < 1 THEN upper(p_name) ELSE p_name END || CASE WHEN p_size % 3 < 2 THEN '!' ELSE '' END AS p_name, greatest(p_size % 3, 2) AS version FROM part
""")
def repaired_items(table):
    """Passes with numbers, of which each row gets those that its version lacks; a second run changes nothing."""
    passes = [(2, lambda df: df.withColumn("p_name", F.concat("p_name", F.lit("!")))), (1, lambda df: df.withColumn("p_name", F.upper("p_name")))]
    once = search.repaired(table("part").select("p_partkey", "p_name", (F.col("p_size") % 3).alias("version")), "version", passes)
    return search.repaired(once, "version", passes)


@_r.query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%A%' AND n_regionkey < 3)")
def items_of_parents(table):
    """The items below the parents of a hit set."""
    hits = search.generate(table("nation"), "n_nationkey", p.matches(F.col("n_name"), "*A*") & (F.col("n_regionkey") < 3))
    return search.of_parents(table("customer"), hits.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey")


@_r.query("SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unknown_names(table):
    """Names in another table that no item has."""
    return merging.zombies(table("orders").select(F.col("o_custkey").alias("c_custkey")), table("customer").filter("c_acctbal > 0"), "c_custkey")


@_r.query("SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'new' || o_custkey ELSE o_custkey::VARCHAR END AS name FROM orders")
def renamed_references(table):
    """A dependent table after some of the names in it were changed."""
    mapping = table("customer").filter("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("old"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("new"))
    names = table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("name"))
    return search.renamed(names, "name", mapping)


@_r.query("""
    WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part GROUP BY ALL), t AS (SELECT p_brand, string_agg(p_type, ' ' ORDER BY k, p_type) AS types FROM f GROUP BY 1)
    SELECT p_brand, types AS p_type, count(*) AS rows, arg_min(p_size, p_partkey) AS p_size FROM part JOIN t USING (p_brand) GROUP BY p_brand, types
""")
def group_joined_items(table):
    """Rows of a group as one: different texts joined in order, equal ones once, other fields from the first row."""
    return merging.group_joined(table("part"), "p_brand", "p_partkey", ["p_type"], ["p_size"])


@_r.query("""
    SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 10) UNION ALL SELECT s_suppkey::INT, s_name FROM supplier WHERE s_suppkey < 10
""")
def transferred_objects(table):
    """Whole objects of another table, which replace those of the same key."""
    more = table("supplier").filter("s_suppkey < 10").select(F.col("s_suppkey").cast("int").alias("n_nationkey"), F.col("s_name").alias("n_name"))
    return merging.transferred(table("nation").select("n_nationkey", "n_name"), more, "n_nationkey")


@_r.query("""
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_partkey % 5 = 1 THEN 'gone' WHEN p_partkey % 5 = 2 AND p_name LIKE '%a%' THEN 'changed' ELSE 'same' END AS change,
           CASE WHEN p_partkey % 5 = 0 THEN 'made' || chr(10) || '2024-02-03 new' WHEN p_partkey % 5 = 1 THEN 'made' || chr(10) || '2024-02-03 gone' WHEN p_partkey % 5 = 2 AND p_name LIKE '%a%' THEN 'made' || chr(10) || '2024-02-03 changed' ELSE 'made' END AS history FROM part
""")
def tracked_changes(table):
    """What happened to each item's data since an earlier version, and its history with a line for it."""
    part = table("part").select("p_partkey", "p_name")
    now = part.filter("p_partkey % 5 <> 1").withColumn("p_name", F.when(F.col("p_partkey") % 5 == 2, F.translate("p_name", "a", "b")).otherwise(F.col("p_name")))
    found = merging.data_changes(now, part.filter("p_partkey % 5 <> 0"), "p_partkey", "p_name")
    return found.select("p_partkey", "change", merging.stamped(F.lit("made"), F.col("change"), F.lit("2024-02-03").cast("date")).alias("history"))


@_r.query("""
    WITH r AS (SELECT p_partkey, p_name AS src, left(p_name, 2) || '--' || substr(p_name, 3) AS dst FROM part WHERE p_partkey = 1), m AS (SELECT unnest(range(1, length(src) + 1)) AS s, length(src) AS n FROM r)
    SELECT p_partkey, rpad(left(p_name, least(2, n::INT)) || '--' || substr(p_name, 3, n - 2), n::INT + 2, '-') AS data FROM part, (SELECT max(n) AS n FROM m)
""")
def remapped_data(table):
    """All strings moved to the columns that a reference has in another alignment."""
    part = table("part").select("p_partkey", F.col("p_name").alias("data"))
    source = part.filter("p_partkey = 1")
    target = source.withColumn("data", F.concat(F.left("data", F.lit(2)), F.lit("--"), F.substring("data", 3, 1000)))
    length = source.agg(F.max(F.char_length("data"))).first()[0] + 2
    return merging.remapped(part, "data", merging.column_map(source, target, "p_partkey", "data"), length).select("p_partkey", "data")


def _file_of(df, value, name):
    """value written as a text file of the shared folder, and its path."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    records.write_text(df, value, path)
    return path


@_r.query("""
    SELECT 'macke' AS format, s_name AS name, replace(s_name, '#', '') || repeat('ACGU', 20) AS data, 'supplier ' || s_suppkey AS title FROM supplier
    UNION ALL SELECT 'swissprot', s_name, replace(s_name, '#', 'X').replace('0', 'A').replace('1', 'C') || repeat('MKLV', 20), 'supplier ' || s_suppkey FROM supplier WHERE NOT regexp_matches(replace(replace(s_name, '0', ''), '1', ''), '[0-9]')
    UNION ALL SELECT 'phylip', 's' || s_suppkey, repeat('ACGU', 20), NULL FROM supplier UNION ALL SELECT 'nexus', s_name || chr(39) || 's', repeat('ACGU', 20), NULL FROM supplier
""".replace("replace(s_name, '#', 'X').replace('0', 'A').replace('1', 'C')", "replace(replace(replace(s_name, '#', 'X'), '0', 'A'), '1', 'C')"))
def format_round_trips(table):
    """Items written in several formats and read again."""
    sup = table("supplier").withColumn("title", F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")))
    spark, bases = sup.sparkSession, F.repeat(F.lit("ACGU"), 20)
    name = F.col("s_name")
    m = records.read_macke(spark, _file_of(sup, records.macke(name, {"title": F.col("title"), "none": F.lit(None).cast("string")}, F.concat(F.replace(name, F.lit("#"), F.lit("")), bases)), "macke"))
    lettered = F.concat(F.translate(name, "#01", "XAC"), F.repeat(F.lit("MKLV"), 20))
    few = sup.filter(~F.translate(name, "01", "").rlike("[0-9]"))
    p_ = records.read_swissprot(spark, _file_of(few, records.swissprot({"ID": name, "DE": F.col("title")}, lettered), "swissprot"))
    short = sup.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), bases.alias("data"))
    h = records.read_phylip(spark, _file_of(records.phylip(short, "name", "data"), F.col("value"), "phylip"))
    n = records.read_nexus(spark, _file_of(records.nexus(sup.select(F.concat(name, F.lit("'s")).alias("name"), bases.alias("data")), "name", "data"), F.col("value"), "nexus"))
    row = lambda kind, df, title: df.select(F.lit(kind).alias("format"), "name", "data", title.cast("string").alias("title"))
    return row("macke", m, F.col("fields")["title"]).unionByName(row("swissprot", p_, F.col("full_name"))).unionByName(row("phylip", h, F.lit(None))).unionByName(row("nexus", n, F.lit(None)))


@_r.query("""
    SELECT p_partkey, '<' || upper(p_name) || '> ' || CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE 'small' END || chr(10) || p_brand || ' end' AS record FROM part
""")
def exported_records(table):
    """Items after a template with fields, a default, and a program on a field."""
    fields = {"name": F.col("p_name"), "size": F.when(F.col("p_size") > 25, F.col("p_size")), "brand": F.col("p_brand")}
    text = records.exported("<$(name)> $(size|small)\n$(brand) end", fields, {"name": lambda c: s.apply(c, s.upper)})
    return table("part").select("p_partkey", text.alias("record"))


@_r.query("""
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'fasta' WHEN p_partkey % 4 = 1 THEN 'embl' WHEN p_partkey % 4 = 2 THEN 'genbank' END AS format, p_size AS size, 'none' AS nothing,
           'Tue Jan 02 03:04:05 2024 ' || p_name || chr(10) || 'before' AS log FROM part
""")
def detected_formats(table):
    """The format of a file by its beginning, the first of several fields that is there, and a log with a dated line put before it."""
    part = table("part")
    head = F.element_at(F.array(F.concat(F.lit(">"), "p_name"), F.concat(F.lit("ID   "), "p_name"), F.concat(F.lit("LOCUS "), "p_name"), F.lit("something else")), (F.col("p_partkey") % 4 + 1).cast("int"))
    formats = {"fasta": ">*", "embl": "ID   *", "genbank": "LOCUS*"}
    return part.select(
        "p_partkey", records.detected(head, formats).alias("format"), search.first_field(part, ["absent", "p_size"], 0).alias("size"), search.first_field(part, ["absent"], "none").alias("nothing"),
        t.dated_line(F.lit("before"), F.col("p_name"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("log"),
    )


@_r.query("""
    WITH sheet AS (SELECT o_custkey AS c_custkey, min(o_orderpriority) AS priority, 'from sheet' AS c_mktsegment FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
    SELECT c_custkey, coalesce(sheet.c_mktsegment, customer.c_mktsegment) AS c_mktsegment, priority FROM customer LEFT JOIN sheet USING (c_custkey)
""")
def imported_sheet(table):
    """Items with the columns of a sheet of the same key: new columns are added, values of known ones win."""
    sheet = table("orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("priority")).withColumn("c_mktsegment", F.lit("from sheet"))
    return records.import_sheet(table("customer").select("c_custkey", "c_mktsegment"), sheet, "c_custkey")
