"""The operators with SQL give the same rows as DuckDB does on the same tables."""

import duckdb
import pandas as pd
import pytest

from graphweave.llm import registry

DATA = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[str]:
    """A null number makes pandas turn its column into doubles."""
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(str(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(db.sql(registry.oracle_sql()[name]).df())
