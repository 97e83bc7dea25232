"""Every query of the registry against its SQL, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomspan.plans import registry

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, str(DATA))
    order = sorted(df.columns)
    got = sorted([plain(v) for v in r] for r in df.select(*order).collect())
    if name in registry.ORACLE_SQL:
        found = tables.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == order
        assert got == sorted([plain(r[names.index(c)]) for c in order] for r in found.fetchall())
    else:
        assert got
