"""Every registered query against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from epochweave.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr) == want
