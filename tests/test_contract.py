from __future__ import annotations

import re

import __spark_entry__ as entry

# Queries that SQL cannot express or that give other rows by design.
WITHOUT_SQL: set[str] = set()


def own_names(names) -> set[str]:
    """Names without those of the optional subpackage."""
    return {n for n in names if not re.match(r"op\d+_|pipeline$", n)}


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert own_names(queries) - own_names(sql) == WITHOUT_SQL


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0


def test_no_query_takes_a_part_of_a_table():
    banned = ("LIMIT 1000", "TABLESAMPLE", "USING SAMPLE")
    for name, text in entry.oracle_sql().items():
        assert not any(b in text for b in banned), name
