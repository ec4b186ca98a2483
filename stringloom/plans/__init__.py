"""The registered queries: each operator on the tables, with the SQL that gives the same rows."""

from stringloom.plans import alignments, columns, items, kmers, proteins, regions, texts, trees

QUERIES, ORACLE_SQL = {}, {}
for module in (texts, items, columns, kmers, regions, proteins, trees, alignments):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
