"""Every query with SQL gives the same rows as DuckDB does on the same tables."""

import duckdb
import pandas as pd
import pytest

from graphweave import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(db.sql(registry.oracle_sql()[name]).df())
