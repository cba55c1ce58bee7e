"""Every query that SQL can express gives the rows of its DuckDB statement."""

from __future__ import annotations

import math

import duckdb
import pytest

from massif.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5f}"
    return str(v)


def rows(table, columns):
    return sorted(tuple(cell(v) for v in r) for r in table), columns


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = rows((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    sql = registry.oracle_sql()[name]
    assert sorted(duck.sql(sql).columns) == columns
    theirs = rows(duck.sql(f"SELECT {quoted} FROM ({sql})").fetchall(), columns)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_run(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() >= 0


def test_no_cartesian_product_of_large_tables(spark, sf_dir):
    plan = registry.queries()["range_join_ppm"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
