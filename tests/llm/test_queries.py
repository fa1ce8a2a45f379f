from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as registered
from ballast.llm.queries import oracle_sql, queries
from ballast.sources.tables import table


def as_set(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cursor = con.execute(oracle_sql()[name])
    got = queries()[name](spark, data)
    assert as_set(got.columns, [tuple(r) for r in got.collect()]) == as_set([c[0] for c in cursor.description], cursor.fetchall())


def test_all_are_registered():
    names = set(registered.queries())
    assert set(queries()) | {"pipeline"} <= names
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(registered.oracle_sql()) <= names


def test_every_document_has_a_row(spark, data):
    n = table(spark, data, "documents").count()
    for name in ("op1_personal_data", "op4_language_id", "op10_quality"):
        assert queries()[name](spark, data).count() == n
