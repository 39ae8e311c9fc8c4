"""Each query with SQL gives what DuckDB gives for it, over the smallest test data, when these are there."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from corpuswerk.plans import corpus_queries, corpus_sql, problems, problems_sql

DATA = os.environ.get("CORPUSWERK_TEST_DATA", "/root/testdata/sf0.001")
QUERIES = problems.QUERIES | corpus_queries.QUERIES
ORACLES = problems_sql.ORACLES | corpus_sql.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return tuple(map(_plain, x)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    sql = Counter(tuple(_plain(row[columns.index(c)]) for c in order) for row in result.fetchall())
    assert Counter(tuple(_plain(row[c]) for c in order) for row in frame.collect()) == sql


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert len(frame.columns) == len(set(frame.columns))
    frame.write.format("noop").mode("overwrite").save()
