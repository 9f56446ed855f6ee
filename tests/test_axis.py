"""Aligned axes of any length, against a walk through the lines and against the query's SQL."""

import random

import duckdb

from tabdrift import catalog, sheet_catalog  # noqa: F401  registers its queries
from tabdrift.operators import views
from tabdrift.schema import OPS, ops

SHAPES = "pair_id string, sheet string, old_n long, new_n long"
FOUND = "pair_id string, sheet string, kind string, row long, row_end long, dst_row long"


def walked(old_n, new_n, gone, come):
    """Both sides line by line: new lines without a match, then old ones, then the next match."""
    out, a, b = [], 0, 0
    while a < old_n or b < new_n:
        if b in come:
            out.append((None, b, come[b]))
            b += 1
        elif a in gone:
            out.append((a, None, gone[a]))
            a += 1
        else:
            out.append((a, b, "match"))
            a, b = a + 1, b + 1
    return out


def test_axis_is_whole(spark, monkeypatch):
    """Blocks of 4 lines: removed, added and moved lines within and across them, long ones, none, and a sheet that doesn't add up."""
    monkeypatch.setattr(views, "BLOCK", 4)
    rng, found, shapes, want = random.Random(3), [], [], {}
    for i in range(40):
        old_n, share = rng.choice((0, 1, 4, 9, 40)), rng.choice((0, 0.2, 0.7, 1))
        gone = {k: "delete" for k in range(old_n) if rng.random() < share}
        new_n = old_n - len(gone) + (added := rng.choice((0, 1, 5, 30)))
        come = {k: "insert" for k in rng.sample(range(new_n), added)}
        pair = str(i)
        moved = next(((a, b) for a in gone for b in come if a + 1 in gone and b + 1 in come), None) if i % 2 else None
        if moved:
            a, b = moved
            found.append((pair, "s", "BlockMovedRows", a, a + 1, b))
            gone |= {a: "move_src", a + 1: "move_src"}
            come |= {b: "move_dst", b + 1: "move_dst"}
        found += [(pair, "s", "RowRemoved", k, k, None) for k, v in gone.items() if v == "delete"] + [(pair, "s", "RowAdded", k, k, None) for k, v in come.items() if v == "insert"]
        shapes.append((pair, "s", old_n, new_n))
        want[pair] = walked(old_n, new_n, gone, come)
    found += [("uneven", "s", "RowRemoved", 1, 1, None), ("outside", "s", "RowRemoved", 7, 7, None), ("outside", "s", "RowAdded", 2, 2, None)]
    shapes += [("uneven", "s", 5, 5), ("outside", "s", 5, 5)]
    got = {}
    made = ops(spark.createDataFrame(found, FOUND))
    assert len(made.columns) == len(OPS)
    shapes = spark.createDataFrame(shapes, SHAPES)
    for r in views.axis(made, shapes).collect():
        got.setdefault(r.pair_id, []).append((r.view, (r.old, r.new, r.kind)))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: list(enumerate(v)) for k, v in want.items() if v}
    assert {(r.pair_id, r.reason) for r in views.skipped(made, shapes).collect()} == {("uneven", "inconsistent"), ("outside", "inconsistent")}
    short = {r.pair_id for r in views.axis(made, shapes, most=8).select("pair_id").distinct().collect()}
    assert short == {k for k, v in want.items() if v and len(v) <= 8}


def test_axis_query_beyond_a_viewer(spark, tmp_path):
    """12,000 rows in the sheet, more than a viewer shows; and 12, where the block to remove is cut short."""
    for n in (60_000, 60, 0):
        d = f"{tmp_path}/{n}"
        spark.range(n).selectExpr("id as c_custkey", "concat('c', id) as c_name", "cast(id % 100 as double) as c_acctbal").write.parquet(f"{d}/customer.parquet")
        df = catalog.QUERIES["axis_alignment"](spark, d)
        got = sorted(tuple(r) for r in df.select("view", "old", "new", "kind").collect())
        con = duckdb.connect()
        con.sql(f"create view customer as select * from '{d}/customer.parquet/*.parquet'")
        assert got == sorted(con.execute(catalog.ORACLES["axis_alignment"]).fetchall()) and len(got) == n // 5
