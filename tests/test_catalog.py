import math
from pathlib import Path

import duckdb
import pytest

from glossaflow.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.oracle_sql():
        return
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    q = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == columns
    want = ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in q.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9) for x, y in zip(a, b)), (a, b)
