"""Queries over whole diffs of sheets, objects and scripts, each with its SQL. Sheets are derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query, table
from .config import DiffConfig
from .functions import formula
from .operators import analysis, keyed, objects, views
from .plans import database, workbook
from .schema import ops
from .store import Store

_VALUES = (("c_custkey", True), ("c_name", False), ("c_acctbal", True))


def _cells(rows: DataFrame, side: str) -> DataFrame:
    """rows(sheet, row, and the columns of _VALUES) as cells."""
    one = F.array(*[
        F.struct(F.lit(i).alias("col"), F.lit("number" if num else "text").alias("vkind"), (F.col(c).cast("double") if num else F.lit(None).cast("double")).alias("num"), (F.lit(None).cast("string") if num else F.col(c)).alias("txt"))
        for i, (c, num) in enumerate(_VALUES)
    ])
    each = rows.select("sheet", "row", F.explode(one).alias("c")).select("sheet", "row", "c.*")
    return each.select(F.lit("").alias("pair_id"), F.lit(side).alias("side"), "sheet", F.col("row").cast("bigint").alias("row"), "col", "vkind", "num", "txt", F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("formula"))


def _shapes(rows: DataFrame, side: str) -> DataFrame:
    n = rows.groupBy("sheet").agg((F.max("row") + 1).alias("nrows"))
    return n.select(F.lit("").alias("pair_id"), F.lit(side).alias("side"), "sheet", F.lit(None).cast("int").alias("sheet_id"), F.lit("Worksheet").alias("kind"), "nrows", F.lit(len(_VALUES)).alias("ncols"), F.lit(0).alias("position"))


def sheets(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Five sheets of customers: one with edits, one without a block, one with a new block, one with a block moved down, one
    that only the old side has; a sixth only the new side has. Rows go by custkey within the sheet."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", F.concat(F.lit("s"), (F.col("c_custkey") % 5).cast("string")).alias("sheet"))
    at = F.row_number().over(Window.partitionBy("sheet").orderBy("c_custkey")) - 1
    old = c.withColumn("row", at)
    r = F.col("row")
    edited = old.where("sheet = 's0'").withColumn("c_acctbal", F.when(r % 7 == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    cut = old.where("sheet = 's1' and not row between 10 and 14").withColumn("row", F.when(r > 14, r - 5).otherwise(r))
    grown = old.where("sheet = 's2'").withColumn("row", F.when(r >= 6, r + 2).otherwise(r)).unionByName(
        old.where("sheet = 's2' and row < 2").withColumn("row", r + 6).withColumn("c_custkey", -F.col("c_custkey")).withColumn("c_name", F.lit("new"))
    )
    moved = old.where("sheet = 's3'").withColumn("row", F.when(r.between(4, 8), r + 6).when(r.between(9, 14), r - 5).otherwise(r))
    added = old.where("sheet = 's4' and row < 3").withColumn("sheet", F.lit("s5"))
    return old, edited.unionByName(cut).unionByName(grown).unionByName(moved).unionByName(added)


def _diff(spark, d: str) -> DataFrame:
    old, new = sheets(spark, d)
    cells, shapes = _cells(old, "old").unionByName(_cells(new, "new")), _shapes(old, "old").unionByName(_shapes(new, "new"))
    store = Store(spark)
    found, _ = workbook.grid_diff(cells, shapes, DiffConfig(), store)
    return store.save(found, "ops")


_OLD = """old AS (SELECT c_custkey, c_acctbal, 's' || (c_custkey % 5) AS sheet, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey) - 1 AS r FROM customer)"""


@query(f"""WITH {_OLD}
 SELECT 'CellEdited' AS kind, sheet, r AS "row", 2 AS col, r AS row_end, CAST(NULL AS BIGINT) AS dst_row, c_acctbal AS from_num, c_acctbal + 1 AS to_num FROM old WHERE sheet = 's0' AND r % 7 = 3
 UNION ALL SELECT 'RowRemoved', 's1', r, NULL, r, NULL, NULL, NULL FROM old WHERE sheet = 's1' AND r BETWEEN 10 AND 14
 UNION ALL SELECT 'RowAdded', 's2', v, NULL, v, NULL, NULL, NULL FROM (VALUES (6), (7)) t(v)
 UNION ALL SELECT 'BlockMovedRows', 's3', 4, NULL, 8, 10, NULL, NULL
 UNION ALL SELECT 'SheetRemoved', 's4', NULL, NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'SheetAdded', 's5', NULL, NULL, NULL, NULL, NULL, NULL""")
def sheet_diff_ops(spark, d):
    found = _diff(spark, d)
    return found.select("kind", "sheet", "row", F.col("col").cast("int").alias("col"), "row_end", "dst_row", F.col("from.num").alias("from_num"), F.col("to.num").alias("to_num"))


@query(f"""WITH {_OLD}, n AS (SELECT count(*) AS n FROM old WHERE sheet = 's1'), v AS (SELECT unnest(range((SELECT n FROM n))) AS v)
 SELECT v AS view, v AS old, CASE WHEN v < 10 THEN v WHEN v > 14 THEN v - 5 END AS new, CASE WHEN v BETWEEN 10 AND 14 THEN 'delete' ELSE 'match' END AS kind FROM v""")
def axis_alignment(spark, d):
    old, _ = sheets(spark, d)
    cut = F.greatest(F.least("old_n", F.lit(15)) - 10, F.lit(0))  # rows 10 to 14, as far as the sheet has them
    n = old.where("sheet = 's1'").agg(F.count("*").alias("old_n")).select(F.lit("").alias("pair_id"), F.lit("s1").alias("sheet"), "old_n", (F.col("old_n") - cut).alias("new_n"))
    at = F.explode(F.sequence(F.lit(10).cast("bigint"), 9 + F.col("old_n") - F.col("new_n"))).alias("row")
    gone = n.where("new_n < old_n").select("pair_id", "sheet", F.lit("RowRemoved").alias("kind"), at).withColumn("row_end", F.col("row"))
    return views.axis(ops(gone), n).select("view", "old", "new", "kind")


_ORDERS_BY_SHEET = """a AS (SELECT o_orderkey % 4 AS sheet, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS r, o_custkey * 1000000 + o_orderkey AS sig FROM orders),
 b AS (SELECT sheet, r, CASE WHEN sheet = 0 AND r % 500 = 7 AND r < 5000 THEN -sig WHEN sheet = 1 THEN -sig WHEN sheet = 2 AND r % 3 = 0 THEN -sig ELSE sig END AS sig FROM a)"""


def _orders(spark, d: str) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy(F.col("o_orderkey") % 4).orderBy("o_orderkey")
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("sheet"), (F.row_number().over(w) - 1).cast("bigint").alias("r"), (F.col("o_custkey") * 1_000_000 + F.col("o_orderkey")).alias("sig"))
    changed = F.expr("sheet = 0 and r % 500 = 7 and r < 5000 or sheet = 1 or sheet = 2 and r % 3 = 0")
    return o, o.withColumn("sig", F.when(changed, -F.col("sig")).otherwise(F.col("sig")))


def _rows(spark, d: str) -> tuple[DataFrame, DataFrame]:
    """Row records as the plan makes them, and sheets of equal shapes."""
    sides = []
    for side, df in zip(("old", "new"), _orders(spark, d)):
        sides.append(df.select(F.lit("").alias("pair_id"), F.col("sheet").cast("int").alias("sheet_ord"), F.lit(side).alias("side"), F.col("r").alias("at"), "sig", F.col("sig").alias("pos"), F.lit(1).alias("filled"), F.lit(False).alias("bare")))
    rows = sides[0].unionByName(sides[1])
    n = sides[0].groupBy("pair_id", "sheet_ord").agg(F.count("*").alias("n"))
    name = F.col("sheet_ord").cast("string")
    matched = n.select("pair_id", "sheet_ord", name.alias("old_sheet"), name.alias("new_sheet"), name.alias("sheet"), F.col("n").alias("old_nrows"), F.lit(1).alias("old_ncols"), F.col("n").alias("new_nrows"), F.lit(1).alias("new_ncols"))
    return matched, rows


@query(f"""WITH {_ORDERS_BY_SHEET}, f AS (SELECT sheet, sig, count_if(s = 0) AS fa, count_if(s = 1) AS fb FROM (SELECT sheet, sig, 0 AS s FROM a UNION ALL SELECT sheet, sig, 1 FROM b) GROUP BY ALL),
 m AS (SELECT a.sheet, count(*) AS n, count_if(a.sig <> b.sig) AS bad FROM a JOIN b USING (sheet, r) GROUP BY a.sheet),
 j AS (SELECT sheet, sum(abs(fa - fb)) / 2 AS distance, count_if(fa > 0 AND fb > 0) / count(*) AS jaccard FROM f GROUP BY sheet)
 SELECT CAST(sheet AS INTEGER) AS sheet, CASE WHEN bad = 0 THEN 'identical' WHEN n < 200 THEN 'full' WHEN bad <= 32 AND 1 - bad / n >= 0.99 AND distance > 0 AND bad <= distance THEN 'near'
   WHEN jaccard < 0.05 THEN 'dissimilar' ELSE 'full' END AS strategy FROM m JOIN j USING (sheet)""")
def preflight_strategy(spark, d):
    matched, rows = _rows(spark, d)
    cfg = DiffConfig(preflight_min_rows=200, preflight_in_order_match_ratio_min=0.99)
    return workbook.preflight(matched, rows, cfg).select(F.col("sheet_ord").alias("sheet"), "strategy")


@query(f"""WITH {_ORDERS_BY_SHEET}, n AS (SELECT sheet, count(*) AS n FROM a GROUP BY sheet), p AS (SELECT sheet, n, greatest(n // least(n, 500), 1) AS step FROM n),
 s AS (SELECT x.sheet, x.sig, x.side FROM (SELECT *, 0 AS side FROM a UNION ALL SELECT *, 1 FROM b) x JOIN p ON p.sheet = x.sheet WHERE (r % step = 0 AND r // step < 500) OR r = n - 1),
 f AS (SELECT sheet, sig, count_if(side = 0) AS fa, count_if(side = 1) AS fb FROM s GROUP BY ALL)
 SELECT sheet, count_if(fa > 0 AND fb > 0) AS n_both, count(*) AS n_either FROM f GROUP BY sheet""")
def sampled_jaccard(spark, d):
    from .operators.grid import sampled_sets

    a, b = _orders(spark, d)
    return sampled_sets(a, b, "sheet", "r", "sig", 500)


# ---- scripts


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Unchanged' WHEN 1 THEN 'FormattingOnly' WHEN 2 THEN 'Filled' WHEN 3 THEN 'SemanticChange' WHEN 4 THEN 'Added' WHEN 5 THEN 'Removed' ELSE 'TextChange' END AS change FROM orders""")
def formula_class(spark, d):
    k = F.col("o_orderkey")
    n = (k % 50 + 1).cast("string")
    next_ = (k % 50 + 2).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    base = text("SUM(A", n, ",$B$2)*2")
    case = k % 7
    df = table(spark, d, "orders").select(
        "o_orderkey", F.when(case == 4, None).otherwise(base).alias("a"),
        F.when(case == 0, base).when(case == 1, text("2 * sum( $B$2 , a", n, " )")).when(case == 2, text("SUM(A", next_, ",$B$2)*2")).when(case == 3, text("SUM(A", n, ",$B$3)*2"))
        .when(case == 4, base).when(case == 5, None).otherwise(F.lit("SUM((A1")).alias("b"),
    )
    return formula.with_change(df, "a", "b", F.lit(1), F.lit(0), "change").select("o_orderkey", "change")


@query("""WITH q AS (SELECT n_name AS name, n_nationkey AS k FROM nation)
 SELECT name, 'QueryAdded' AS kind, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS change_kind, CAST(NULL AS VARCHAR) AS name_to FROM q WHERE k % 6 = 0
 UNION ALL SELECT name, 'QueryRemoved', NULL, NULL, NULL FROM q WHERE k % 6 = 1
 UNION ALL SELECT name, 'QueryRenamed', NULL, NULL, name || '_2' FROM q WHERE k % 6 = 2
 UNION ALL SELECT name, 'QueryDefinitionChanged', NULL, 'FormattingOnly', NULL FROM q WHERE k % 6 = 3
 UNION ALL SELECT name, 'QueryDefinitionChanged', NULL, 'Semantic', NULL FROM q WHERE k % 6 = 4
 UNION ALL SELECT name, 'QueryMetadataChanged', f, NULL, NULL FROM q, (VALUES ('LoadToSheet'), ('ConnectionOnly')) t(f) WHERE k % 6 = 5""")
def query_diff(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    case = F.col("k") % 6
    key = F.col("k").cast("string")
    old = F.concat(F.lit("let a = "), key, F.lit(", b = Table.SelectRows(a, each [x] > "), key, F.lit(") in b"))
    new = F.when(case == 3, F.concat(F.lit("let a="), key, F.lit(",\n b = Table.SelectRows( a, each [x]>"), key, F.lit(") in b // done"))).when(case == 4, F.concat(F.lit("let a = "), key, F.lit(" in a"))).otherwise(old)
    side = lambda df, s, name, text, sheet: df.select(F.lit("").alias("pair_id"), F.lit(s).alias("side"), name.alias("name"), text.alias("expression"), sheet.alias("load_to_sheet"), F.lit(False).alias("load_to_model"), (~sheet).alias("connection_only"), F.lit(None).cast("string").alias("group_path"))
    a = side(n.where(case != 0), "old", F.col("name"), old, F.lit(False))
    b = side(n.where(case != 1), "new", F.when(case == 2, F.concat("name", F.lit("_2"))).otherwise(F.col("name")), new, case == 5)
    return objects.queries(a.unionByName(b)).select("name", "kind", "field", "change_kind", "name_to")


@query("""WITH n AS (SELECT lower(n_name) AS name, n_nationkey AS k FROM nation)
 SELECT 'NamedRangeAdded' AS kind, name FROM n WHERE k % 5 = 0 UNION ALL SELECT 'NamedRangeRemoved', name FROM n WHERE k % 5 = 1 UNION ALL SELECT 'NamedRangeChanged', name FROM n WHERE k % 5 = 2
 UNION ALL SELECT 'ChartAdded', name FROM n WHERE k % 4 = 0 UNION ALL SELECT 'ChartRemoved', name FROM n WHERE k % 4 = 1 UNION ALL SELECT 'ChartChanged', name FROM n WHERE k % 4 = 2
 UNION ALL SELECT 'VbaModuleAdded', name FROM n WHERE k % 3 = 0 UNION ALL SELECT 'VbaModuleChanged', name FROM n WHERE k % 3 = 1""")
def object_diff(spark, d):
    n = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("k"))
    both = lambda df, only_new, only_old: df.where(f"not ({only_new})").withColumn("side", F.lit("old")).unionByName(df.where(f"not ({only_old})").withColumn("side", F.lit("new"))).withColumn("pair_id", F.lit(""))
    new = F.col("side") == "new"
    # a duplicate that comes first must not count
    names = both(n, "k % 5 = 0", "k % 5 = 1").select("pair_id", "side", F.when(new, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"), F.when(new & (F.col("k") % 5 == 2), "y").otherwise("x").alias("refers_to"), F.lit(1).alias("position"))
    names = names.unionByName(names.withColumn("refers_to", F.lit("other")).withColumn("position", F.lit(0)))
    charts = both(n, "k % 4 = 0", "k % 4 = 1").select("pair_id", "side", F.when(new, "renamed").otherwise("first").alias("sheet"), F.lit(1).alias("sheet_id"), F.col("n_name").alias("name"), F.when(new & (F.col("k") % 4 == 2), "h2").otherwise("h1").alias("hash"), F.lit(0).alias("position"))
    modules = both(n, "k % 3 = 0", "false").select("pair_id", "side", F.col("n_name").alias("name"), F.when(new & (F.col("k") % 3 == 1), "a\nb").when(new, "a\rc").otherwise("a\r\nc").alias("code"), F.lit(0).alias("position"))
    found = objects.named_ranges(names).unionByName(objects.charts(charts)).unionByName(objects.modules(modules))
    return found.select("kind", F.lower("name").alias("name"))


@query("""WITH t AS (SELECT r_name AS name, r_regionkey AS k FROM region), c AS (SELECT n_name AS name, n_nationkey AS k, n_regionkey AS t FROM nation)
 SELECT 'TableRemoved' AS kind, name, CAST(NULL AS VARCHAR) AS field FROM t WHERE k = 0
 UNION ALL SELECT 'ModelColumnAdded', name, NULL FROM c WHERE t <> 0 AND k % 4 = 0 UNION ALL SELECT 'ModelColumnRemoved', name, NULL FROM c WHERE t <> 0 AND k % 4 = 1
 UNION ALL SELECT 'ModelColumnTypeChanged', name, NULL FROM c WHERE t <> 0 AND k % 4 = 2
 UNION ALL SELECT 'ModelColumnPropertyChanged', name, 'Hidden' FROM c WHERE t <> 0 AND k % 4 = 3 UNION ALL SELECT 'CalculatedColumnDefinitionChanged', name, NULL FROM c WHERE t <> 0 AND k % 4 = 3
 UNION ALL SELECT 'RelationshipPropertyChanged', 'a[' || name || '] -> b[x]', 'IsActive' FROM c WHERE k % 3 = 0
 UNION ALL SELECT 'MeasureDefinitionChanged', name, NULL FROM c WHERE k % 2 = 0 UNION ALL SELECT 'MeasureAdded', 'm', NULL""")
def model_diff(spark, d):
    t = table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))
    c = table(spark, d, "nation").join(t.select(F.col("k").alias("n_regionkey"), F.col("name").alias("table")), "n_regionkey").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"), "table")
    both = lambda df, only_new="false", only_old="false": df.where(f"not ({only_new})").withColumn("side", F.lit("old")).unionByName(df.where(f"not ({only_old})").withColumn("side", F.lit("new"))).withColumn("pair_id", F.lit("")).withColumn("position", F.lit(0))
    new, null = F.col("side") == "new", F.lit(None).cast("string")
    columns = both(c, "k % 4 = 0", "k % 4 = 1").select(
        "pair_id", "side", "position", "table", "name", F.when(new & (F.col("k") % 4 == 2), "string").otherwise("int64").alias("data_type"), (new & (F.col("k") % 4 == 3)).alias("is_hidden"),
        null.alias("format_string"), null.alias("sort_by"), null.alias("summarize_by"), F.when(new & (F.col("k") % 4 == 3), "SUM ( [x] ) + 1").otherwise("sum([x])").alias("expression"),
    )
    rel = both(c).select("pair_id", "side", "position", F.lit("a").alias("from_table"), F.col("name").alias("from_column"), F.lit("b").alias("to_table"), F.lit("x").alias("to_column"), null.alias("cross_filtering_behavior"), null.alias("cardinality"), (new & (F.col("k") % 3 == 0)).alias("is_active"))
    measures = both(c).select("pair_id", "side", "position", "name", F.when(new & (F.col("k") % 2 == 0), "1").otherwise("2").alias("expression"))
    measures = measures.unionByName(spark.createDataFrame([("", "new", 0, "m", "1")], "pair_id string, side string, position int, name string, expression string"))
    return objects.model(both(t, only_old="k = 0"), columns, measures, rel).select("kind", "name", "field")


# ---- tables inside sheets, keys that are there twice


@query("""WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS r, o_custkey AS c, o_totalprice AS p FROM orders),
 n AS (SELECT k, (SELECT count(*) FROM o) - r + 1 AS r, CASE WHEN k % 10 = 3 THEN c + 1 ELSE c END AS c, p FROM o WHERE k % 97 <> 0)
 SELECT 'RowRemoved' AS kind, r AS "row", CAST(NULL AS BIGINT) AS col, CAST(NULL AS DOUBLE) AS to_num FROM o WHERE k % 97 = 0
 UNION ALL SELECT 'CellEdited', r, 1, CAST(c AS DOUBLE) FROM n WHERE k % 10 = 3 UNION ALL SELECT 'CellEdited', 0, 3, 2""")
def database_mode(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_totalprice").alias("p"))
    # numbered by counts of ranges, so no task orders the whole table
    n = F.col("k")
    ranked = o.join(o.groupBy(F.floor(n / 4096).alias("b")).agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), F.floor(n / 4096) == F.col("b"))
    ranked = ranked.withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("k"))).select("k", "c", "p", "r")
    total = ranked.agg(F.count("*").alias("n"))
    new = ranked.where("k % 97 <> 0").withColumn("c", F.when(n % 10 == 3, F.col("c") + 1).otherwise(F.col("c"))).join(F.broadcast(total)).withColumn("r", F.col("n") - F.col("r") + 1)  # one row

    def side(df: DataFrame, s: str, note: float) -> DataFrame:
        one = F.array(*[F.struct(F.lit(i).alias("col"), F.col(c).cast("double").alias("num")) for i, c in enumerate(("k", "c", "p"))])
        cells = df.select(F.col("r").alias("row"), F.explode(one).alias("x")).select("row", "x.*").unionByName(spark.createDataFrame([(0, 3, note)], "row long, col int, num double"))
        return cells.select(F.lit("").alias("pair_id"), F.lit(s).alias("side"), F.lit("t").alias("sheet"), "row", "col", F.lit("number").alias("vkind"), "num", F.lit(None).cast("string").alias("txt"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("formula"))

    found = database.database_diff(side(ranked, "old", 1.0).unionByName(side(new, "new", 2.0)), [0])
    return found.select("kind", "row", "col", F.col("to.num").alias("to_num"))


_TWICE = """l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_quantity AS q, l_returnflag AS f FROM lineitem),
 b AS (SELECT k, n, CASE WHEN p % 7 = 2 THEN p + 1 ELSE p END AS p, q, f FROM l WHERE p % 53 <> 0)"""


@query(f"""WITH {_TWICE}, c AS (SELECT k, n, count_if(s = 0) AS a, count_if(s = 1) AS z FROM (SELECT k, n, 0 AS s FROM l UNION ALL SELECT k, n, 1 FROM b) GROUP BY ALL)
 SELECT k AS l_orderkey, n AS l_linenumber, 1 AS clusters, CAST(z - a AS BIGINT) AS net FROM c WHERE a > 1 OR z > 1""")
def cluster_net(spark, d):
    old = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    new = old.where("l_partkey % 53 <> 0").withColumn("l_partkey", F.when(F.col("l_partkey") % 7 == 2, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")))
    keys = ["l_orderkey", "l_linenumber"]
    found = keyed.cluster_diff(old, new, keys, ["l_partkey", "l_quantity", "l_returnflag"])
    kind = F.col("kind")
    return found.groupBy(*keys).agg(F.count_if(kind == "DuplicateKeyCluster").cast("int").alias("clusters"), (F.count_if(kind == "RowAdded") - F.count_if(kind == "RowRemoved")).alias("net"))


# ---- what operations mean


_OPS = """o AS (SELECT o_orderkey AS k, o_custkey % 7 AS s, CASE o_orderkey % 8 WHEN 0 THEN 'RowAdded' WHEN 1 THEN 'RowRemoved' WHEN 2 THEN 'BlockMovedRows' WHEN 3 THEN 'QueryAdded'
   WHEN 4 THEN 'QueryDefinitionChanged' WHEN 5 THEN 'MeasureDefinitionChanged' WHEN 6 THEN 'SheetRenamed' ELSE 'CellEdited' END AS kind,
   CASE WHEN o_orderkey % 8 IN (4, 5) THEN CASE o_orderkey % 3 WHEN 0 THEN 'Semantic' WHEN 1 THEN 'FormattingOnly' ELSE 'Unknown' END END AS how,
   CASE WHEN o_orderkey % 8 = 7 THEN CASE o_orderkey % 5 WHEN 0 THEN 'SemanticChange' WHEN 1 THEN 'FormattingOnly' ELSE 'Unchanged' END END AS formula FROM orders),
 c AS (SELECT *, CASE WHEN kind = 'QueryAdded' THEN 'high' WHEN kind LIKE '%DefinitionChanged' THEN CASE how WHEN 'Semantic' THEN 'high' WHEN 'FormattingOnly' THEN 'low' ELSE 'medium' END
   WHEN kind = 'CellEdited' THEN CASE formula WHEN 'SemanticChange' THEN 'high' WHEN 'FormattingOnly' THEN 'low' ELSE 'medium' END WHEN kind = 'SheetRenamed' THEN 'low' ELSE 'medium' END AS severity,
   CASE WHEN kind LIKE '%Added' THEN 'added' WHEN kind LIKE '%Removed' THEN 'removed' WHEN kind LIKE 'BlockMoved%' THEN 'moved' ELSE 'modified' END AS change,
   CASE WHEN kind LIKE 'Query%' THEN 'PowerQuery' WHEN kind LIKE 'Measure%' THEN 'Model' ELSE 'Grid' END AS category FROM o)"""


def _made_ops(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda by, values: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    o = table(spark, d, "orders").select(k.alias("k"), (F.col("o_custkey") % 7).alias("s"))
    k = F.col("k")
    kind = pick(k % 8, ["RowAdded", "RowRemoved", "BlockMovedRows", "QueryAdded", "QueryDefinitionChanged", "MeasureDefinitionChanged", "SheetRenamed", "CellEdited"])
    return ops(
        o, pair_id=F.lit(""), kind=kind, sheet=F.when((k % 8).isin(0, 1, 2, 6, 7), F.concat(F.lit("s"), F.col("s").cast("string"))), row=k % 100, row_end=k % 100 + 2, dst_row=k % 10,
        change_kind=F.when((k % 8).isin(4, 5), pick(k % 3, ["Semantic", "FormattingOnly", "Unknown"])), formula_diff=F.when(k % 8 == 7, pick(k % 5, ["SemanticChange", "FormattingOnly", "Unchanged", "Unchanged", "Unchanged"])),
    )


@query(f"WITH {_OPS} SELECT category, severity, count(*) AS n FROM c GROUP BY ROLLUP (category, severity)")
def op_rollup(spark, d):
    return analysis.by_category(_made_ops(spark, d))


@query(f"""WITH {_OPS}, g AS (SELECT 's' || s AS sheet, count(*) AS op_count, count_if(severity = 'high') AS high, count_if(change = 'moved') AS moved FROM c WHERE category = 'Grid' GROUP BY s)
 SELECT *, CAST(row_number() OVER (ORDER BY high DESC, op_count DESC, sheet) AS INTEGER) AS sheet_rank FROM g""")
def severity_by_sheet(spark, d):
    return analysis.by_sheet(_made_ops(spark, d)).select("sheet", "op_count", "high", "moved", "sheet_rank")


@query(f"""WITH {_OPS} SELECT 's' || s AS sheet, 'r:' || (k % 100) || '+3->' || (k % 10) AS move_id, count(*) AS n FROM o WHERE kind = 'BlockMovedRows' GROUP BY ALL""")
def move_ids(spark, d):
    return analysis.store_analysis(_made_ops(spark, d)).where("move_id is not null").groupBy("sheet", "move_id").agg(F.sum("n").alias("n"))


@query(f"""WITH {_OPS} SELECT k % 8 AS kind_no, count(*) AS n FROM c WHERE NOT (kind = 'QueryDefinitionChanged' AND how = 'FormattingOnly') AND NOT coalesce(formula = 'FormattingOnly', false) GROUP BY ALL""")
def noise_filters(spark, d):
    kinds = ["RowAdded", "RowRemoved", "BlockMovedRows", "QueryAdded", "QueryDefinitionChanged", "MeasureDefinitionChanged", "SheetRenamed", "CellEdited"]
    left = analysis.without_noise(_made_ops(spark, d), queries=True, formulas=True)
    return left.groupBy((F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1).alias("kind_no")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_custkey % 10 AS sheet, c_custkey // 10 AS r FROM customer), n AS (SELECT sheet, count(*) AS n, count_if(r % 3 <> 0) + 7 AS m FROM c GROUP BY sheet) SELECT sum(greatest(n, m)) AS cells FROM n""")
def cell_volume(spark, d):
    c = table(spark, d, "customer").select((F.col("c_custkey") % 10).cast("string").alias("sheet"), F.floor(F.col("c_custkey") / 10).alias("r"))
    side = lambda s, n: c.groupBy("sheet").agg(n.alias("n_cells")).select(F.lit("").alias("pair_id"), F.lit(s).alias("side"), "sheet", "n_cells")
    return analysis.cell_volume(side("old", F.count("*")).unionByName(side("new", F.count_if(F.col("r") % 3 != 0) + 7))).select("cells")


@query("""SELECT 'cell' AS kind, 'both' AS side, greatest(r - 1, 0) AS row_start, least(r + 1, 99) AS row_end, greatest(c - 1, 0) AS col_start, least(c + 1, 9) AS col_end
 FROM (SELECT DISTINCT o_orderkey % 120 AS r, o_custkey % 12 AS c FROM orders) WHERE r < 100 AND c < 10""")
def interest_rects(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 120).alias("r"), (F.col("o_custkey") % 12).alias("c")).distinct()
    edits = ops(o, pair_id=F.lit(""), sheet=F.lit("s"), kind=F.lit("CellEdited"), row=F.col("r"), row_end=F.col("r"), col=F.col("c"), col_end=F.col("c"))
    shape = spark.createDataFrame([("", "s", 100, 10, 110, 12)], "pair_id string, sheet string, old_nrows int, old_ncols int, new_nrows int, new_ncols int")
    return views.interest(edits, shape).select("kind", "side", *[F.col(c).cast("bigint").alias(c) for c in ("row_start", "row_end", "col_start", "col_end")])
