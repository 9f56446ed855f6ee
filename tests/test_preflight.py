"""How large sheets are compared, judged over all their rows, against the query's SQL."""

from functools import partial

import duckdb
import pytest

from tabdrift import catalog, sheet_catalog
from tabdrift.config import DiffConfig
from tabdrift.plans import workbook


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four sheets of 12,300 rows: every third row of one is edited, and so is every third row that a sample of 4,096 would see."""
    d = str(tmp_path_factory.mktemp("orders"))
    spark.range(4 * 12_300).selectExpr("id as o_orderkey", "id % 700 as o_custkey").write.parquet(f"{d}/orders.parquet")
    return d


def in_sql(d):
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{d}/orders.parquet/*.parquet'")
    return dict(con.execute(catalog.ORACLES["preflight_strategy"]).fetchall())


def test_edits_at_a_distance(spark, folder):
    got = {r.sheet: r.strategy for r in catalog.QUERIES["preflight_strategy"](spark, folder).collect()}
    assert got == in_sql(folder) == {0: "near", 1: "dissimilar", 2: "full", 3: "identical"}


def test_limits_are_not_the_preflights(spark, folder, monkeypatch):
    """Sheets beyond max_align_rows are judged too; only the diff's plan goes by its limits."""
    small = partial(DiffConfig, max_align_rows=12_299)
    monkeypatch.setattr(sheet_catalog, "DiffConfig", small)
    got = {r.sheet: r.strategy for r in catalog.QUERIES["preflight_strategy"](spark, folder).collect()}
    assert got == in_sql(folder)
    planned = workbook.strategies(*sheet_catalog._rows(spark, folder), small()).collect()
    assert len(planned) == 4 and {r.strategy for r in planned} == {"limits"}
