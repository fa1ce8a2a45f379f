"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from ballast.oracles import oracle_sql
from ballast.queries import queries

TABLES = ("customer", "supplier", "part", "orders", "lineitem")
QUERIES = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    yield con
    con.close()


def as_set(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr([row[i] for i in order]) for row in rows)


def test_every_statement_belongs_to_a_query():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, tables, name):
    got = QUERIES[name](spark, data)
    cursor = tables.execute(SQL[name])
    expected = as_set([c[0] for c in cursor.description], cursor.fetchall())
    assert as_set(got.columns, [tuple(r) for r in got.collect()]) == expected


def test_round_limit_leaves_feasible_choices(spark, data, tables):
    full = dict(tables.execute("SELECT instance_id, objective FROM (" + SQL["best_subset_max"] + ")").fetchall())
    limited = QUERIES["solution_report_after_one_round"](spark, data).collect()
    assert {r.instance_id for r in limited} == set(full)
    assert {r.status for r in limited} == {"optimal", "feasible"}
    for row in limited:
        assert row.objective <= full[row.instance_id]
        assert (row.n_open > 0) == (row.status == "feasible")
        if row.status == "optimal":
            assert row.objective == full[row.instance_id]
