"""Every query of the catalogue against its SQL counterpart, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandline.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in NAMES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return ""
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        return f"{float(x) + 0.0:.5f}" if isinstance(x, (int, float, np.number)) else str(x)

    return sorted(tuple(one(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        # The points are on a sphere, which holds no plane; p6_room_planes has planes and SQL.
        assert name == "p6_planes" and got.columns == ["plane", "a", "b", "c", "d", "points"] and got.collect() == []
        return
    want = db.execute(catalog.ORACLE_SQL[name]).fetchdf()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
