"""Queries on the smallest tables against their SQL in DuckDB."""

import math

import duckdb
import pytest

import gritstone.plans.activity
import gritstone.plans.code
import gritstone.plans.evaluation
import gritstone.plans.examples
import gritstone.plans.storage
import gritstone.plans.training
import gritstone.plans.work  # noqa: F401  (all register their queries in the catalogue)
from gritstone.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return v


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = oracle.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    got = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    want = sorted(str(tuple(plain(dict(zip(rel.columns, r))[c]) for c in cols)) for r in rel.fetchall())
    assert [x.replace(".0,", ",").replace(".0)", ")") for x in got] == [x.replace(".0,", ",").replace(".0)", ")") for x in want]


def test_entry_has_every_query(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
