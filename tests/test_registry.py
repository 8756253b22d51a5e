"""Every registered query against its SQL in DuckDB, over the smallest tables; results do not depend
on the number of partitions."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from marlstone.plans import registry
from marlstone.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    def one(v):
        if isinstance(v, np.ndarray):
            return tuple(v.tolist())
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) or v is pd.NA:
            return None
        return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(one(v) for v in r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_partitions_do_not_matter(spark):
    for name in ("ask_rrf_fusion", "digest_per_job_cap", "concept_cooccurrence_graph"):
        first = rows(registry.queries()[name](spark, SF).toPandas())
        before = spark.conf.get("spark.sql.shuffle.partitions")
        try:
            spark.conf.set("spark.sql.shuffle.partitions", "13")
            assert rows(registry.queries()[name](spark, SF).toPandas()) == first
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
