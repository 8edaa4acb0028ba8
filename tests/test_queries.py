"""Every registered query at the smallest scale against its SQL in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        return "nan" if isinstance(x, float) and math.isnan(x) else repr(x)
    return [columns[i] for i in order], sorted("|".join(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    d = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    kinds = {c[0]: str(c[1]) for c in cur.description}
    assert normal(d.columns, [tuple(r) for r in d.collect()]) == normal([c[0] for c in cur.description], cur.fetchall())
    assert {c: KINDS[k] for c, k in d.dtypes} == kinds


# training and routes are covered by their own tests; the rest must at least run
@pytest.mark.parametrize("name", ["snapshot_json", "live_snapshot", "step_timings", "day_bootstrap_range", "transfer_eval"])
def test_rows_only_query_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() >= 1


def test_flagship(spark):
    got = {r.k: r.n for r in entry.entry(spark).collect()}
    assert sum(got.values()) == 892      # 893 rentals are not retries; one has a chain of five
