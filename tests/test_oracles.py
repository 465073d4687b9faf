"""Every query of the library that has a DuckDB equivalent against it, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from millrace import plans

SF = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and hasattr(v, "item"):
            return f"{float(v):.8g}"
        return str(v)

    out = df[sorted(df.columns)].map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    got = normal(plans.QUERIES[name](spark, SF).toPandas())
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    want = normal(con.execute(plans.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want), got[(got != want).any(axis=1)].head(3).to_dict("records")
