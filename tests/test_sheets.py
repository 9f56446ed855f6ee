"""Whole diffs of small sheets, built from rows, against the operations that they should give."""

import copy
import json
import random

import pytest

from tabdrift.config import DiffConfig
from tabdrift.functions import formula
from tabdrift.operators import keyed, views
from tabdrift.plans import database, workbook
from tabdrift.schema import numbered
from tabdrift.store import Store

CELLS = "pair_id string, side string, sheet string, row long, col long, vkind string, num double, txt string, flag boolean, formula string"
SHEETS = "pair_id string, side string, sheet string, sheet_id int, kind string, nrows int, ncols int, position int"


def tables(spark, cases):
    """cases: pair to (old, new), each a list of rows; texts that start with = are formulas."""
    cells, sheets = [], []
    for pair, sides in cases.items():
        for side, rows in zip(("old", "new"), sides):
            sheets.append((pair, side, "S", 1, "Worksheet", len(rows), max(map(len, rows), default=0), 0))
            for r, row in enumerate(rows):
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    if isinstance(v, str) and v.startswith("="):
                        cells.append((pair, side, "S", r, c, None, None, None, None, v[1:]))
                    elif isinstance(v, str):
                        cells.append((pair, side, "S", r, c, "text", None, v, None, None))
                    else:
                        cells.append((pair, side, "S", r, c, "number", float(v), None, None, None))
    return spark.createDataFrame(cells, CELLS), spark.createDataFrame(sheets, SHEETS)


def test_sheets(spark):
    rng = random.Random(3)
    base = [[rng.randint(1, 10**6) for _ in range(6)] for _ in range(12)]
    edited = copy.deepcopy(base)
    edited[2][2] = 2.5
    fuzzy = copy.deepcopy(base[:2] + base[7:] + base[2:7])
    fuzzy[8][1] = 99
    wide = [[rng.randint(1, 10**6) for _ in range(70)] for _ in range(9)]
    replaced = [[x + 1 for x in row] if r in (2, 3, 4, 5, 7) else row for r, row in enumerate(wide)]
    long = [[rng.randint(1, 10**6) for _ in range(3)] for _ in range(260)]  # too long for the move search
    cases = {
        "edit": ((base, edited), [("CellEdited", 2, 2, 2, None)]),
        "same": ((base, base), []),
        "insert": ((base, base[:4] + [[1, 2, 3, 4, 5, 6], [9, 8, 7, 6, 5, 4]] + base[4:]), [("RowAdded", 4, None, 4, None), ("RowAdded", 5, None, 5, None)]),
        "delete": ((base, base[:4] + base[6:]), [("RowRemoved", 4, None, 4, None), ("RowRemoved", 5, None, 5, None)]),
        "move": ((base, base[:2] + base[6:] + base[2:6]), [("BlockMovedRows", 2, None, 5, 8)]),
        "column": ((base, [r[:2] + [7] + r[2:] for r in base]), [("ColumnAdded", None, 2, None, None)]),
        "columns": ((base, [[r[k] for k in (0, 3, 4, 1, 2, 5)] for r in base]), [("BlockMovedColumns", None, 3, None, None)]),
        "fuzzy": ((base, fuzzy), [("BlockMovedRows", 2, None, 6, 7), ("CellEdited", 8, 1, 8, None)]),
        "tail": ((base[:10], base), [("RowAdded", 10, None, 10, None), ("RowAdded", 11, None, 11, None)]),
        "empty": (([], []), []),
        "from nothing": (([], [[1]]), [("RowAdded", 0, None, 0, None), ("ColumnAdded", None, 0, None, None)]),
        "dense": ((wide, replaced), [("RectReplaced", 2, 0, 5, None), ("RowReplaced", 7, None, 7, None)]),
        "long insert": ((long, long[:100] + [[1, 2, 3]] + long[100:]), [("RowAdded", 100, None, 100, None)]),
        "long move": ((long, long[:50] + long[60:200] + long[50:60] + long[200:]), [("BlockMovedRows", 50, None, 59, 190)]),
        "formula": (([["=A1+B1", 1, 2], [1, 2, 3], [4, 5, 6]], [["=B1 + a1", 1, 2], [1, 2, 3], [4, 5, 6]]), [("CellEdited", 0, 0, 0, None)]),
        "tiny": (([[1.0, 0.1 + 0.2]], [[1.0, 0.3]]), []),
    }
    cells, sheets = tables(spark, {k: v[0] for k, v in cases.items()})
    cells = cells.withColumnRenamed("side", "side").crossJoin(spark.range(1).withColumnRenamed("id", "h"))  # a further column
    store = Store(spark)
    found, warnings = workbook.grid_diff(cells, sheets, DiffConfig(enable_formula_semantic_diff=True), store)
    found = store.save(found, "ops")
    got = {}
    for r in numbered(found).orderBy("pair_id", "op_idx").collect():
        got.setdefault(r.pair_id, []).append((r.kind, r.row, r.col, r.row_end, r.dst_row))
        if r.pair_id == "formula":
            assert r.formula_diff == "FormattingOnly"
    assert {k: got.get(k, []) for k in cases} == {k: v[1] for k, v in cases.items()}
    assert warnings.isEmpty()
    at = views.explain(found.where("pair_id = 'edit'"), "s", 2, 2).collect()
    assert [(r.strength, r.addr) for r in at] == [(0, "C3")]
    shapes = spark.createDataFrame([("insert", "S", 12, 14)], "pair_id string, sheet string, old_n int, new_n int")
    view = [(r.old, r.new, r.kind) for r in views.axis(found, shapes).orderBy("view").collect()]
    assert view == [(k, k, "match") for k in range(4)] + [(None, 4, "insert"), (None, 5, "insert")] + [(k, k + 2, "match") for k in range(4, 12)]


def test_sheet_matching(spark):
    rows = [
        ("p", "old", "A", 1, "Worksheet", 1, 1, 0), ("p", "new", "B", 1, "Worksheet", 1, 1, 0), ("p", "old", "C", None, "Worksheet", 1, 1, 1), ("p", "new", "c", None, "Worksheet", 1, 1, 1),
        ("p", "old", "D", 2, "Worksheet", 1, 1, 2), ("p", "old", "E", 2, "Worksheet", 1, 1, 3), ("p", "new", "D", 2, "Worksheet", 1, 1, 2), ("p", "new", "F", 9, "Chart", 1, 1, 4),
    ]
    sheets = spark.createDataFrame(rows, SHEETS)
    got = {(r.old_sheet, r.new_sheet, r.by_id) for r in workbook.match_sheets(sheets).collect()}
    assert got == {("A", "B", True), ("C", "c", False), ("D", None, False), ("E", None, False), (None, "D", True), (None, "F", True)}
    assert {(r.kind, r.name, r.name_to) for r in workbook.sheet_ops(workbook.match_sheets(sheets)).collect()} >= {("SheetRenamed", "A", "B"), ("SheetAdded", None, None)}
    assert workbook.sheet_warnings(sheets).count() == 1


def test_limits(spark):
    cells, sheets = tables(spark, {"p": ([[1], [2], [3]], [[1], [9], [3]])})
    small = dict(max_align_rows=2)
    found, _ = workbook.grid_diff(cells, sheets, DiffConfig(**small))
    assert [(r.kind, r.row) for r in found.collect()] == [("CellEdited", 1)]
    _, warnings = workbook.grid_diff(cells, sheets, DiffConfig(on_limit_exceeded="ReturnPartialResult", **small))
    assert warnings.count() == 1
    with pytest.raises(workbook.LimitsExceeded):
        workbook.grid_diff(cells, sheets, DiffConfig(on_limit_exceeded="ReturnError", **small))


def test_database(spark):
    old = [["id", "v", "w"], [1, 10, "a"], [2, 20, "b"], [3, 30, "c"], [3, 31, "d"], [None, None, None], ["note", None, None, None, "x"]]
    new = [["id", "v", "w"], [2, 21, "b"], [1, 10, "a"], [3, 31, "d"], [3, 35, "c"], [4, 40, "e"], ["note", None, None, None, "y"]]
    cells, _ = tables(spark, {"p": (old, new)})
    got = [(r.kind, r.row, r.col, r.left_rows, r.right_rows) for r in numbered(database.database_diff(cells, [0])).orderBy("op_idx").collect()]
    assert got == [
        ("RowAdded", 5, None, None, None), ("CellEdited", 1, 1, None, None), ("DuplicateKeyCluster", 3, None, [3, 4], [3, 4]), ("CellEdited", 4, 1, None, None), ("CellEdited", 6, 4, None, None),
    ]


def test_inside_a_key(spark, monkeypatch):
    """Rows of one key against the plain matching of all of them; rows beyond the limit are told one by one."""
    rng = random.Random(5)
    keys = {f"k{n}": [[(str(rng.randrange(4)), str(rng.randrange(3)), None) for _ in range(rng.randrange(1, n))] for _ in "ab"] for n in (3, 8, 16, 60)}
    keys["hot"] = [[("x", str(r % 5), None) for r in range(4000)], [("x", str(r % 5), None) if r % 1000 else ("y", "y", None) for r in range(4000)]]
    place = lambda r: r * 30_000  # noqa: E731  rows in several blocks
    rows = [("p", "S", [k], max(map(len, sides)), s, place(r), json.dumps(v)) for k, sides in keys.items() for s, vs in zip(("old", "new"), sides) for r, v in enumerate(vs)]
    listed = spark.createDataFrame(rows, "pair_id string, sheet string, key array<string>, size long, side string, row long, v string")
    got = {k: [] for k in keys}
    for r in database.match_inside(listed, Store(spark)).collect():
        got[r.key[0]].append((r.row_a, r.row_b))
    for k, (a, b) in keys.items():
        pairs = keyed.match_cluster(a, b)
        gone, come = set(range(len(a))) - {i for i, _ in pairs}, set(range(len(b))) - {j for _, j in pairs}
        want = [(place(i), place(j)) for i, j in pairs] + [(place(i), None) for i in gone] + [(None, place(j)) for j in come]
        # at least cost there can be several best matchings; a greedy one is unique
        if max(len(a), len(b)) > keyed.EXACT:
            assert sorted(got[k], key=repr) == sorted(want, key=repr)
        at = lambda side, r: side[r // 30_000]
        cost = lambda found: sum(keyed.unmatched_cost(3) if x is None or y is None else 2 * sum(p != q for p, q in zip(at(a, x), at(b, y))) for x, y in found)  # noqa: B023, E731
        assert cost(got[k]) == cost(want) and len(got[k]) == len(want)
    monkeypatch.setattr(database, "LARGEST", 2)
    few = database.match_inside(listed.where("key[0] = 'hot'"), Store(spark)).collect()
    assert sum(r.row_a is not None for r in few) == sum(r.row_b is not None for r in few) == 4000 and sum(None in (r.row_a, r.row_b) for r in few) == 8


def test_keyed_clusters(spark):
    schema = "k long, t string, v double"
    old = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0), (2, "x", 1.0), (4, "z", 1.0), (4, "z", 1.0), (None, "n", 1.0)], schema)
    new = spark.createDataFrame([(1, "b", 2.5), (1, "a", 1.0), (2, "x", 9.0), (5, "q", 1.0), (4, "z", 1.0), (4, "w", 1.0), (4, "z", 1.0), (None, "m", 1.0)], schema)
    got = sorted(((r.k, r.kind, r.field) for r in keyed.keyed_diff(old, new, ["k"], ["t", "v"]).collect()), key=repr)
    assert got == sorted([
        (1, "DuplicateKeyCluster", None), (1, "CellEdited", "v"), (1, "RowRemoved", None), (2, "CellEdited", "v"), (4, "DuplicateKeyCluster", None), (4, "RowAdded", None),
        (5, "RowAdded", None), (None, "CellEdited", "t"),
    ], key=repr)
    many = spark.range(3000).selectExpr("1L as k", "cast(id as string) as t", "cast(id as double) as v")
    kinds = {r.kind: r["count"] for r in keyed.keyed_diff(many, many.where("t % 2 = 0"), ["k"], ["t", "v"]).groupBy("kind").count().collect()}
    assert kinds == {"DuplicateKeyCluster": 1, "RowRemoved": 1500}
    assert keyed.choose_keys(old.where("k in (1, 2)"), ["k", "t", "v"]) == ["t"] and keyed.choose_keys(many, ["k", "t", "v"]) == []


@pytest.mark.parametrize(
    "a, b, rows, want",
    [
        ("=SUM(A1,B1)", "= sum( B1 , A1 )", 0, "FormattingOnly"), ("A1", "A2", 1, "Filled"), ("$A$1", "$A$2", 1, "SemanticChange"), ("A1:B2", "B2:A1", 0, "FormattingOnly"),
        ("-2^2", "(-2)^2", 0, "FormattingOnly"), ("2^3^2", "2^(3^2)", 0, "FormattingOnly"), ("'My Sheet'!A1", "'my sheet'!a1", 0, "FormattingOnly"), ("1<>2%", "2% <> 1", 0, "FormattingOnly"),
        ("A1-B1", "B1-A1", 0, "SemanticChange"), ("R[1]C[-1]+R1C1", "R1C1+R[1]C[-1]", 0, "FormattingOnly"), ("Table1[[#All],[x]]", "table1[[#All],[x]]", 0, "FormattingOnly"), ("((", "A", 0, "TextChange"),
        (None, "1", 0, "Added"), ("1", None, 0, "Removed"), ("1", "1", 0, "Unchanged"), ('IF(A1>0,"x""y",{1,2;3,4})', 'if(a1>0, "x""y", {1,2;3,4})', 0, "FormattingOnly"), ("A:C", "$A:C", 0, "SemanticChange"),
    ],
)
def test_formulas(a, b, rows, want):
    assert formula.change(a, b, rows) == want
