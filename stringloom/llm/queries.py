"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stringloom.llm import exact_dedup, filter_audit, fingerprint, impact_index, license_scan, packing, pii, quality, record_files, simhash, source_mixing, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scanned(_table(spark, sf_dir, "documents"))
    starts = F.transform("phrases", lambda p: p["start"])
    base, own = F.transform("phrases", lambda p: p["label"]), F.transform(F.filter("blocks", lambda b: b["named"]), lambda b: b["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.when(F.size("phrases") > 0, 1.0).otherwise(best).alias("score"),
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_mixing.allotted(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised_pieces(_table(spark, sf_dir, "documents"), keep_ids=False)
    return packing.packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(_table(spark, sf_dir, "documents"), width=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_tokens(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared_with_next(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.scored(docs.select("doc_id", "text"), quality.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    rows = rows.select("doc_id", "spans", pii.scores(F.col("spans")).alias("_scores"))
    return rows.select(
        "doc_id", *counts, F.sha2(pii.listed(of(*pii.BASE)), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
        F.col("_scores.listed").alias("scores"), F.col("_scores.highest").alias("score"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.scored(docs.select("doc_id", "text"), toxicity.train(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op11_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_files.round_trip(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_source_mixing, op3_best_fit_packing, op4_simhash, op5_token_counts, op6_fingerprint, op7_quality, op8_pii, op9_toxicity, op10_exact_dedup, op11_binary_records, op12_filter_audit, op13_ranked_search)}

ORACLE_SQL = {
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               first_value(doc_id) OVER w = doc_id AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
    """,
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS again FROM t),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                     + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
                     + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN again THEN 16 ELSE 0 END AS mask
              FROM w LEFT JOIN l USING (doc_id)),
        x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
        o AS (SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
              FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        s AS (SELECT filter_order, i::INTEGER AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS before FROM o, generate_series(1, 5) g(i)),
        m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
        r AS (SELECT part, filter_order, step, own,
                     coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
                     coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
                     coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
              FROM m, s GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
    """,
    "op13_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        p AS (SELECT r, doc_id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY r)::BIGINT AS n FROM d GROUP BY r, doc_id, term),
        t AS (SELECT count(DISTINCT r) AS n_docs, sum(tf)::BIGINT AS n_terms FROM p),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, t),
        i AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
        j AS (SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
        s AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
              FROM j JOIN p USING (term) JOIN w USING (term), t GROUP BY q, item_id, r, doc_id)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
    """,
}
