"""Every registered query with SQL gives what the SQL gives, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from tidemill.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        one = []
        for v in r:
            if v is None or v is pd.NA or v is pd.NaT or v != v:
                one.append("")
            elif isinstance(v, pd.Timestamp):
                one.append(str(v.tz_localize(None)))
            elif isinstance(v, (int, float)) and not isinstance(v, bool):
                one.append(f"{float(v):.6f}")
            else:
                one.append(str(v))
        out.append(tuple(one))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sql, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), sql.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
