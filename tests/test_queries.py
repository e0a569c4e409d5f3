"""Every registered query against its SQL on a second engine, on the smallest tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from rosterlake.plans import all_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def second_engine():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v if isinstance(v, bool | int | type(None)) else str(v)


@pytest.mark.parametrize("name", sorted(all_queries.QUERIES))
def test_query(spark, second_engine, name):
    df = all_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in all_queries.ORACLE:
        assert got
        return
    cursor = second_engine.execute(all_queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want
