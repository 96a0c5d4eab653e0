"""Some queries beside their SQL in DuckDB, on the smallest tables if they are there."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = ["p2_found", "p5_found", "c11_range_overlap", "d1_callers_of", "d16_calls_by_pair", "g6_risk_index", "f12_criticality", "k1_risk_scores", "i1_bm25", "n7_exchanges", "h5_cohesion"]


def text(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted("|".join(text(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    assert sorted("|".join(text(r[c]) for c in sorted(cols)) for r in df.collect()) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
