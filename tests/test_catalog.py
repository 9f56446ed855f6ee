"""Every query of the catalog against its SQL on the smallest tables."""

import duckdb
import pytest

from tabdrift import catalog, sheet_catalog  # noqa: F401  both register their queries
from tabdrift.operators import keyed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(v[i] for i in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLES:
        out = db.execute(catalog.ORACLES[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, out.fetchall())
    else:
        assert got


def test_self_diff_is_empty(spark):
    old, _ = catalog.orders(spark, SF)
    assert keyed.keyed_diff(old, old, ["o_orderkey"], catalog.COMPARE).isEmpty()


def test_offset_islands_across_blocks(spark, monkeypatch):
    """Runs over the edges of blocks of 100,000 rows stay whole, also one of just two rows."""
    runs = [(0, 5, 50), (3, 99_999, 100_000), (5, 99_990, 100_010), (5, 299_995, 299_999), (5, 300_001, 300_004), (-2, 0, 9), (7, 199_000, 400_001), (9, 100_000, 100_000)]
    anchors = spark.createDataFrame([(r, r + o) for o, a, b in runs for r in range(a, b + 1)], "row_a long, row_b long")
    monkeypatch.setattr(catalog, "unique_anchors", lambda spark, d: anchors)
    got = sorted((r["offset"], r["first"], r["last"], r["n"]) for r in catalog.offset_islands(spark, SF).collect())
    assert got == sorted((o, a, b, b - a + 1) for o, a, b in runs if b > a and o)
