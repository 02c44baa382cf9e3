"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(rows):
    return sorted(tuple("inf" if isinstance(v, float) and math.isinf(v) else round(v, 5) if isinstance(v, float) else v for v in r) for r in rows)


def near(a, b):
    return len(a) == len(b) and all(abs(x - y) < 2e-5 if isinstance(x, float) and isinstance(y, float) else x == y for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalogue.SQL[name]).df()
    columns = sorted(want.columns)
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert near(plain(map(tuple, got.select(*columns).collect())), plain(want[columns].itertuples(index=False, name=None)))


def test_rows_only_queries(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.SQL)):
        assert catalogue.QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "rank", "vec_id", "dist"] and rows.count() == 200
