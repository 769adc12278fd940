"""Every panel query against its SQL in an independent engine, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessella.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)[:10] if isinstance(v, pd.Timestamp) else str(v)

    out = df[sorted(df.columns)].map(one) if len(df) else df[sorted(df.columns)]
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    rel = duck.sql(ORACLES[name])
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns)
    a, b = normal(got), normal(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert not len(a) or a.equals(b), a[(a != b).any(axis=1)].head(3).to_string() + "\n" + b[(a != b).any(axis=1)].head(3).to_string()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
