"""Queries of predicted structures. The letters of documents are read as residues; those that are none are unknown."""

from pyspark.sql import functions as F

from stringloom.operators import structure as st
from stringloom.plans.registry import Registry, spread

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_RESIDUES = "".join(st.PROPENSITIES)
_TABLE = ", ".join(f"('{c}', {', '.join(map(str, st.PROPENSITIES[c] + st.TURNS[c]))})" for c in _RESIDUES)
_VALUES = ("former0", "former1", "breaker0", "breaker1", "helix", "strand", "turn", "f0", "f1", "f2", "f3")


def _ahead(value: str, size: int, put: str, rest: str) -> str:
    """The values of the k places from here on, put together."""
    return "(" + f" {put} ".join(f"CASE WHEN k > {i} THEN lead({value.replace('#', str(i))}, {i}) OVER w ELSE {rest} END" for i in range(size)) + ")"


def _windows_sql(name: str, size: int, test: str) -> str:
    """Of each place whether a window that passes the test covers it, as name (doc_id, pos, covered)."""
    return f"""
    {name}_k AS (SELECT *, least({size}, next_unknown - pos) AS k FROM u),
    {name}_t AS (SELECT doc_id, pos, k, pos <= n - {size} AND (k = {size} OR next_unknown < n AND k > 0 AND (k = {size - 1} OR NOT coalesce(known_before, false))) AND {test} AS good
        FROM {name}_k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    {name} AS (SELECT doc_id, pos, coalesce(max(CASE WHEN good THEN pos + k END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) > pos, false) AS covered FROM {name}_t)"""


def _structure_sql(name: str, s: int) -> str:
    size = st.WINDOWS[s]
    test = f"{_ahead(f'former{s}', size, '+', '0')} > {100 * (size - 2)} AND {_ahead(f'breaker{s}', size, '+', '0')} < 200"
    has = lambda letters, ch: f"coalesce(strpos('{letters}', {ch}) > 0, false)"
    stop = lambda other, known, edge: f"NOT known OR {has(st.STOPPERS[s], 'ch')} OR NOT coalesce({known}, false) OR {edge} OR {has(st.BREAKERS[s], 'ch')} AND {has(st.BREAKERS[s] + st.INDIFFERENT[s], other)}"
    return _windows_sql(f"site{s}", size, test) + f""",
    stop{s} AS (SELECT u.doc_id, u.pos, covered, {stop("ch_after", "known_after", "u.pos > n - 3")} AS ends_right, {stop("ch_before", "known_before", "u.pos < 2")} AS ends_left FROM u JOIN site{s} USING (doc_id, pos)),
    {name} AS (SELECT doc_id, pos, coalesce(max(CASE WHEN covered THEN pos END) OVER r > coalesce(max(CASE WHEN ends_right AND NOT covered THEN pos END) OVER r, -1), false)
            OR coalesce(min(CASE WHEN covered THEN pos END) OVER l < coalesce(min(CASE WHEN ends_left AND NOT covered THEN pos END) OVER l, 1099511627776), false) AS held
        FROM stop{s} WINDOW r AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


_TURN = f"{_ahead('f#', 4, '*', '1')} * 1000000 > {st.LEAST_TURN} * pow(1000, k)::BIGINT AND {_ahead('turn', 4, '+', '0')} > 100 * k AND {_ahead('turn', 4, '+', '0')} > {_ahead('helix', 4, '+', '0')} AND {_ahead('turn', 4, '+', '0')} > {_ahead('strand', 4, '+', '0')}"
_ISLANDS = "sum(CASE WHEN kind IS DISTINCT FROM kind_before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos)"


@_r.query(f"""
    WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS x FROM documents),
    v AS (SELECT * FROM (VALUES {_TABLE}) t(ch, {", ".join(_VALUES)})),
    p AS (SELECT doc_id, length(x) AS n, unnest(string_split(x, '')) AS ch, unnest(range(length(x))) AS pos FROM d WHERE length(x) > 0),
    o AS (SELECT p.*, former0 IS NOT NULL AS known, {", ".join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in _VALUES)} FROM p LEFT JOIN v USING (ch)),
    u AS (SELECT *, lag(known) OVER w AS known_before, lead(known) OVER w AS known_after, lag(ch) OVER w AS ch_before, lead(ch) OVER w AS ch_after,
        coalesce(min(CASE WHEN NOT known THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) AS next_unknown FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    {_structure_sql("helices", 0)}, {_structure_sql("strands", 1)}, {_windows_sql("turns", 4, _TURN)},
    c AS (SELECT u.doc_id, pos, former0, former1, CASE WHEN NOT known THEN '' WHEN t.covered THEN 'T' WHEN h.held AND s.held THEN 'X' WHEN h.held THEN 'H' WHEN s.held THEN 'E' ELSE '' END AS kind
        FROM u JOIN helices h USING (doc_id, pos) JOIN strands s USING (doc_id, pos) JOIN turns t USING (doc_id, pos)),
    i AS (SELECT *, {_ISLANDS} AS island FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS kind_before FROM c)),
    x AS (SELECT doc_id, pos, CASE WHEN kind <> 'X' THEN kind WHEN sum(former0) OVER w > sum(former1) OVER w THEN 'H' ELSE 'E' END AS kind FROM i WINDOW w AS (PARTITION BY doc_id, island)),
    j AS (SELECT *, {_ISLANDS} AS island FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS kind_before FROM x))
    SELECT doc_id, any_value(kind) AS structure, min(pos) + 1 AS start, max(pos) + 1 AS stop FROM j WHERE kind <> '' GROUP BY doc_id, island
""")
def predicted_structures(table):
    letters = spread(table("documents")).select("doc_id", F.regexp_replace("text", "[^A-Za-z]+", "").alias("text"))
    return st.predicted(letters, "doc_id", "text")
