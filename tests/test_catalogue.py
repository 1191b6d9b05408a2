"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from docloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool):
        return str(value)
    try:
        return repr(round(float(value), 6))
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    assert rows
    if name in catalogue.ORACLES:
        want = duck.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows_of(got.columns, rows) == rows_of(columns, want.fetchall())


def test_oracles_belong_to_queries():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)


def test_entry_without_the_training_data_part():
    code = "import sys; sys.modules['docloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


@needs_data
def test_filters_reach_the_scan(spark):
    plan = catalogue.scan_filter_scope(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(source,src3)" in plan and "text" not in plan.split("ReadSchema")[1]


@needs_data
def test_topk_does_not_sort_everything(spark):
    plan = catalogue.dense_topk(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
