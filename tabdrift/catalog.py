"""Queries over the test tables, each with its SQL. New versions of tables are derived from the old by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import a1, norm15, normal_text
from .operators import analysis, grid, keyed, objects

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


COMPARE = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def orders(spark, d) -> tuple[DataFrame, DataFrame]:
    old = table(spark, d, "orders").select("o_orderkey", *COMPARE)
    k = F.col("o_orderkey")
    new = old.where(k % 97 != 0).select(
        F.when(k % 89 == 1, k + 10_000_000).otherwise(k).alias("o_orderkey"),
        F.when(k % 10 == 3, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 31 == 5, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        (F.col("o_totalprice") * (1 + 2e-16)).alias("o_totalprice"),
        F.when(k % 50 == 7, F.concat(F.lit("x"), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return old, new


_ORDERS = """
old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders),
new AS (SELECT CASE WHEN o_orderkey % 89 = 1 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey,
  CASE WHEN o_orderkey % 10 = 3 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 31 = 5 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
  CASE WHEN o_orderkey % 50 = 7 THEN 'x' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority
  FROM old WHERE o_orderkey % 97 <> 0),
both_ AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey IS NOT NULL AS has_a, b.o_orderkey IS NOT NULL AS has_b,
  a.o_custkey AS ac, b.o_custkey AS bc, a.o_orderstatus AS ast, b.o_orderstatus AS bst, a.o_orderpriority AS ap, b.o_orderpriority AS bp
  FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey),
ops AS (
  SELECT o_orderkey, CASE WHEN has_a THEN 'RowRemoved' ELSE 'RowAdded' END AS kind, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS DOUBLE) AS from_num,
    CAST(NULL AS VARCHAR) AS from_txt, CAST(NULL AS DOUBLE) AS to_num, CAST(NULL AS VARCHAR) AS to_txt FROM both_ WHERE has_a <> has_b
  UNION ALL SELECT o_orderkey, 'CellEdited', 'o_custkey', CAST(ac AS DOUBLE), NULL, CAST(bc AS DOUBLE), NULL FROM both_ WHERE has_a AND has_b AND ac IS DISTINCT FROM bc
  UNION ALL SELECT o_orderkey, 'CellEdited', 'o_orderstatus', NULL, ast, NULL, bst FROM both_ WHERE has_a AND has_b AND ast IS DISTINCT FROM bst
  UNION ALL SELECT o_orderkey, 'CellEdited', 'o_orderpriority', NULL, ap, NULL, bp FROM both_ WHERE has_a AND has_b AND ap IS DISTINCT FROM bp)
"""


@query(f"WITH {_ORDERS} SELECT * FROM ops")
def keyed_diff_ops(spark, d):
    return keyed.keyed_diff(*orders(spark, d), ["o_orderkey"], COMPARE, clusters=False)  # the table's primary key


@query(f"WITH {_ORDERS} SELECT kind, coalesce(field, '') AS field, count(*) AS n FROM ops GROUP BY ALL")
def keyed_diff_summary(spark, d):
    return keyed_diff_ops(spark, d).groupBy("kind", F.coalesce("field", F.lit("")).alias("field")).agg(F.count("*").alias("n"))


@query(f"""WITH {_ORDERS} SELECT CASE WHEN kind LIKE '%Added' THEN 'added' WHEN kind LIKE '%Removed' THEN 'removed' ELSE 'modified' END AS change,
  'medium' AS severity, count(*) AS n FROM ops GROUP BY ALL""")
def change_counts(spark, d):
    ops = keyed_diff_ops(spark, d)
    return ops.groupBy(analysis.change_class(F.col("kind")).alias("change"), analysis.severity(F.col("kind")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"WITH {_ORDERS} SELECT o_orderkey, kind, field FROM ops WHERE o_orderkey BETWEEN 100 AND 400")
def ops_in_range(spark, d):
    ops = keyed_diff_ops(spark, d).withColumn("row", F.col("o_orderkey")).withColumn("row_end", F.lit(None).cast("long"))
    return analysis.touching(ops, 100, 400).select("o_orderkey", "kind", "field")


@query(f"WITH {_ORDERS} SELECT o_orderkey, field, to_txt FROM ops WHERE contains(lower(coalesce(to_txt, '')), 'xhigh') OR contains(lower(coalesce(to_txt, '')), 'x2-h')")
def search_ops(spark, d):
    return analysis.search(keyed_diff_ops(spark, d), ["to_txt"], ["xHigh", "x2-h"]).select("o_orderkey", "field", "to_txt")


_LINES = """
old AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem),
new AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 2 THEN l_partkey + 1 ELSE l_partkey END AS l_partkey,
  CASE WHEN l_orderkey % 11 = 4 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem WHERE l_partkey % 53 <> 0),
k AS (SELECT l_orderkey, l_linenumber, sum(a) AS n_old, sum(b) AS n_new FROM (SELECT l_orderkey, l_linenumber, 1 AS a, 0 AS b FROM old UNION ALL
  SELECT l_orderkey, l_linenumber, 0, 1 FROM new) GROUP BY ALL)
"""
LINE_KEYS, LINE_COMPARE = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_quantity", "l_returnflag"]


def lines(spark, d):
    old = table(spark, d, "lineitem").select(*LINE_KEYS, *LINE_COMPARE)
    new = old.where("l_partkey % 53 <> 0").select(
        *LINE_KEYS,
        F.when(F.col("l_partkey") % 7 == 2, F.col("l_partkey") + 1).otherwise(F.col("l_partkey")).alias("l_partkey"),
        F.when(F.col("l_orderkey") % 11 == 4, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_returnflag",
    )
    return old, new


@query(f"WITH {_LINES} SELECT l_orderkey, l_linenumber, CAST(n_old AS BIGINT) AS n_old, CAST(n_new AS BIGINT) AS n_new FROM k WHERE n_old > 1 OR n_new > 1")
def duplicate_clusters(spark, d):
    return keyed.matched(*lines(spark, d), LINE_KEYS, LINE_COMPARE).where("n_old > 1 or n_new > 1").select(*LINE_KEYS, "n_old", "n_new")


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, CAST((a.l_partkey IS DISTINCT FROM b.l_partkey)::INT + (a.l_quantity IS DISTINCT FROM b.l_quantity)::INT
  + (a.l_returnflag IS DISTINCT FROM b.l_returnflag)::INT AS BIGINT) AS cost, count(*) AS n_pairs
  FROM old a JOIN new b USING (l_orderkey, l_linenumber) JOIN k USING (l_orderkey, l_linenumber) WHERE n_old > 1 OR n_new > 1 GROUP BY ALL""")
def duplicate_pair_costs(spark, d):
    return keyed.cluster_costs(*lines(spark, d), LINE_KEYS, LINE_COMPARE)


@query(f"""WITH {_LINES} SELECT CASE WHEN n_old > 1 OR n_new > 1 THEN 'cluster' WHEN n_new = 0 THEN 'removed' WHEN n_old = 0 THEN 'added' ELSE 'matched' END AS what,
  count(*) AS n FROM k GROUP BY ALL""")
def keyed_composite(spark, d):
    m = keyed.matched(*lines(spark, d), LINE_KEYS, LINE_COMPARE)
    what = F.expr("case when n_old > 1 or n_new > 1 then 'cluster' when n_new = 0 then 'removed' when n_old = 0 then 'added' else 'matched' end")
    return m.groupBy(what.alias("what")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey FROM orders),
 o AS (SELECT k, count(*) AS n FROM a GROUP BY k), b AS (SELECT k, count(*) AS n FROM a WHERE o_orderkey % 3 <> 0 GROUP BY k)
 SELECT o.k AS k, CAST(o.n AS BIGINT) AS n_old, CAST(coalesce(b.n, 0) AS BIGINT) AS n_new FROM o LEFT JOIN b ON o.k IS NOT DISTINCT FROM b.k""")
def keyed_null_safe(spark, d):
    old = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 5 == 0, None).otherwise(F.col("o_custkey")).alias("k"), "o_orderkey")
    return keyed.matched(old, old.where("o_orderkey % 3 <> 0"), ["k"], ["o_orderkey"]).select("k", "n_old", "n_new")


@query("""WITH s AS (SELECT count(*) AS n, count(o_orderkey) a1, count(DISTINCT o_orderkey) d1, count(o_custkey) a2, count(DISTINCT o_custkey) d2,
  count(o_orderstatus) a3, count(DISTINCT o_orderstatus) d3 FROM orders),
 e AS (SELECT 'o_orderkey' AS field, n AS n_rows, n - a1 AS n_null, d1 AS n_distinct FROM s UNION ALL SELECT 'o_custkey', n, n - a2, d2 FROM s UNION ALL
  SELECT 'o_orderstatus', n, n - a3, d3 FROM s)
 SELECT *, n_null = 0 AND n_distinct = n_rows AS unique_key, field LIKE '%key' AS named_like_key FROM e""")
def suggest_keys(spark, d):
    return keyed.suggest_keys(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("""SELECT c.name AS field, count(*) AS n_rows, CAST(count(v) AS BIGINT) AS n_filled, count(v) * 2 >= count(*) AS in_scope FROM (
  SELECT unnest(['o_custkey', 'o_orderstatus', 'rarely']) AS name, unnest([CAST(o_custkey AS VARCHAR), o_orderstatus,
  CASE WHEN o_orderkey % 3 = 0 THEN 'x' END]) AS v FROM orders WHERE o_orderkey IS NOT NULL) c GROUP BY c.name""")
def table_scope(spark, d):
    o = table(spark, d, "orders").withColumn("rarely", F.when(F.col("o_orderkey") % 3 == 0, "x"))
    return keyed.table_scope(o, ["o_orderkey"], ["o_custkey", "o_orderstatus", "rarely"])


# ---- cells: customer by custkey; the new version edits some cells and moves or drops rows

CELLS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CUSTOMERS = """
old AS (SELECT c_custkey AS r, c_name, CAST(c_nationkey AS DOUBLE) AS nk, c_acctbal, c_mktsegment FROM customer),
new AS (SELECT r, CASE WHEN r % 40 BETWEEN 8 AND 13 THEN 'n' || c_name ELSE c_name END AS c_name,
  CASE WHEN r % 40 BETWEEN 8 AND 13 OR r % 17 = 3 THEN nk + 1 ELSE nk END AS nk, CASE WHEN r % 40 BETWEEN 8 AND 13 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN r % 40 BETWEEN 8 AND 13 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM old WHERE r < (SELECT max(c_custkey) FROM customer) - 9),
cells_a AS (SELECT r, 0 AS c, NULL::DOUBLE AS num, c_name AS txt FROM old UNION ALL SELECT r, 1, nk, NULL FROM old UNION ALL SELECT r, 2, c_acctbal, NULL FROM old UNION ALL SELECT r, 3, NULL, c_mktsegment FROM old),
cells_b AS (SELECT r, 0 AS c, NULL::DOUBLE AS num, c_name AS txt FROM new UNION ALL SELECT r, 1, nk, NULL FROM new UNION ALL SELECT r, 2, c_acctbal, NULL FROM new UNION ALL SELECT r, 3, NULL, c_mktsegment FROM new),
diff AS (SELECT coalesce(a.r, b.r) AS "row", coalesce(a.c, b.c) AS col, a.num AS from_num, a.txt AS from_txt, b.num AS to_num, b.txt AS to_txt
  FROM (SELECT * FROM cells_a WHERE num IS NOT NULL OR txt IS NOT NULL) a FULL JOIN (SELECT * FROM cells_b WHERE num IS NOT NULL OR txt IS NOT NULL) b ON a.r = b.r AND a.c = b.c
  WHERE a.num IS DISTINCT FROM b.num OR a.txt IS DISTINCT FROM b.txt),
dense AS (SELECT "row" FROM diff JOIN new ON "row" = r GROUP BY "row" HAVING count(*) >= 4)
"""


def customers(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("r"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    last = old.agg(F.max("r").alias("last"))
    dense, edit = F.expr("r % 40 between 8 and 13"), F.expr("r % 40 between 8 and 13 or r % 17 = 3")
    new = old.join(F.broadcast(last)).where("r < last - 9").select(  # one row
        "r",
        F.when(dense, F.concat(F.lit("n"), "c_name")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(edit, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(dense, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(dense, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return old, new


def _diff(spark, d):
    old, new = customers(spark, d)
    return grid.positional(grid.cells(old, "r", CELLS), grid.cells(new, "r", CELLS))


@query(f"WITH {_CUSTOMERS} SELECT * FROM diff")
def positional_cells(spark, d):
    return _diff(spark, d)


@query(f"WITH {_CUSTOMERS} SELECT r AS \"row\", 'RowRemoved' AS kind FROM old WHERE r NOT IN (SELECT r FROM new)")
def positional_tail_rows(spark, d):
    old, new = customers(spark, d)
    return old.join(new, "r", "left_anti").select(F.col("r").alias("row"), F.lit("RowRemoved").alias("kind"))


def _dense(spark, d):
    _, new = customers(spark, d)
    rows = _diff(spark, d).groupBy("row").agg(F.count("*").alias("n")).where(F.col("n") >= 4)
    return rows.join(new.select(F.col("r").alias("row")), "row", "left_semi").select("row")


@query(f'WITH {_CUSTOMERS} SELECT "row" FROM dense')
def dense_row_replaced(spark, d):
    return _dense(spark, d)


@query(f"""WITH {_CUSTOMERS} SELECT min("row") AS "first", max("row") AS "last", count(*) AS n FROM (SELECT "row", "row" - row_number() OVER (ORDER BY "row") AS g FROM dense)
  GROUP BY g HAVING count(*) >= 4""")
def rect_replaced(spark, d):
    return grid.joined_islands(_dense(spark, d), [], "row", 1 << 16).where("n >= 4")


# ---- signatures: orders as rows, the signature being status and priority, or customer

_SIGS = """
old AS (SELECT o_orderkey AS r, o_custkey % 40 AS sheet, o_custkey AS sig FROM orders),
new AS (SELECT CASE WHEN o_orderkey % 100 BETWEEN 10 AND 29 THEN o_orderkey + 1000000 ELSE o_orderkey END AS r, o_custkey % 40 AS sheet, o_custkey AS sig
  FROM orders WHERE o_orderkey % 13 <> 5),
f AS (SELECT sig, sum(a) AS freq_a, sum(b) AS freq_b FROM (SELECT sig, 1 AS a, 0 AS b FROM old UNION ALL SELECT sig, 0, 1 FROM new) GROUP BY sig)
"""


def signatures(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("r"), (F.col("o_custkey") % 40).alias("sheet"), F.col("o_custkey").alias("sig"))
    moved = F.expr("r % 100 between 10 and 29")
    return old, old.where("r % 13 <> 5").select(F.when(moved, F.col("r") + 1_000_000).otherwise(F.col("r")).alias("r"), "sheet", "sig")


@query(f"WITH {_SIGS} SELECT sig, CAST(freq_a AS BIGINT) AS freq_a, CAST(freq_b AS BIGINT) AS freq_b FROM f")
def hash_stats(spark, d):
    return grid.both_counts(*signatures(spark, d), ["sig"])


@query(f"""WITH {_SIGS}, c AS (SELECT sig, count(*) AS n FROM old GROUP BY sig) SELECT CASE WHEN n = 1 THEN 'Unique' WHEN n <= 5 THEN 'Rare' ELSE 'Common' END AS class,
  count(*) AS n_signatures, CAST(sum(n) AS BIGINT) AS n_rows FROM c GROUP BY ALL""")
def frequency_classes(spark, d):
    n = signatures(spark, d)[0].groupBy("sig").agg(F.count("*").alias("n"))
    return n.groupBy(grid.frequency_class(F.col("n")).alias("class")).agg(F.count("*").alias("n_signatures"), F.sum("n").alias("n_rows"))


@query(f"WITH {_SIGS} SELECT CAST(sum(abs(freq_a - freq_b)) AS BIGINT) AS differing, CAST(sum(abs(freq_a - freq_b)) // 2 AS BIGINT) AS distance FROM f")
def multiset_distance(spark, d):
    return grid.multiset_distance(*signatures(spark, d), ["sig"])


@query(f"WITH {_SIGS} SELECT count(*) AS n, count_if(a.sig = b.sig) AS n_match FROM old a JOIN new b USING (r)")
def in_order_ratio(spark, d):
    return grid.in_order(*signatures(spark, d), "r", "sig").select("n", "n_match")


_UNIQ = """
ua AS (SELECT o_orderkey AS r, o_orderkey % 25 AS sheet, o_custkey * 10 + length(o_orderstatus) + CAST(round(o_totalprice) AS BIGINT) AS sig FROM orders),
ub AS (SELECT CASE WHEN r % 100 BETWEEN 10 AND 29 THEN r + 1000000 ELSE r + 3 END AS r, sheet, sig FROM ua WHERE r % 13 <> 5),
anchors AS (SELECT a.sig, a.row_a, b.row_b FROM (SELECT sig, min(r) AS row_a FROM ua GROUP BY sig HAVING count(*) = 1) a
  JOIN (SELECT sig, min(r) AS row_b FROM ub GROUP BY sig HAVING count(*) = 1) b USING (sig))
"""


def uniques(spark, d):
    a = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("r"), (F.col("o_orderkey") % 25).alias("sheet"),
        (F.col("o_custkey") * 10 + F.length("o_orderstatus") + F.round("o_totalprice").cast("long")).alias("sig"),
    )
    moved = F.expr("r % 100 between 10 and 29")
    return a, a.where("r % 13 <> 5").select(F.when(moved, F.col("r") + 1_000_000).otherwise(F.col("r") + 3).alias("r"), "sheet", "sig")


@query(f"WITH {_UNIQ} SELECT * FROM anchors")
def unique_anchors(spark, d):
    return grid.anchors(*uniques(spark, d), "sig", "r")


@query(f"""WITH {_UNIQ} SELECT "offset", min(row_a) AS "first", max(row_a) AS "last", count(*) AS n FROM
  (SELECT row_b - row_a AS "offset", row_a, row_a - row_number() OVER (PARTITION BY row_b - row_a ORDER BY row_a) AS g FROM anchors)
  WHERE "offset" <> 0 GROUP BY "offset", g HAVING count(*) > 1""")
def offset_islands(spark, d):
    return grid.shifted(unique_anchors(spark, d), "row_a", "row_b")


@query(f"""WITH {_UNIQ} SELECT sig, a.row_a, b.row_b FROM (SELECT sig, min(r) AS row_a FROM ua WHERE r NOT IN (SELECT r FROM ub) GROUP BY sig HAVING count(*) = 1) a
  JOIN (SELECT sig, min(r) AS row_b FROM ub WHERE r NOT IN (SELECT r FROM ua) GROUP BY sig HAVING count(*) = 1) b USING (sig)""")
def insert_delete_moves(spark, d):
    a, b = uniques(spark, d)
    return grid.anchors(a.join(b, "r", "left_anti"), b.join(a, "r", "left_anti"), "sig", "r")


@query(f"""WITH {_SIGS} SELECT sig, CAST(k AS INTEGER) AS k, a.r AS row_a, b.r AS row_b FROM (SELECT sig, r, row_number() OVER (PARTITION BY sig ORDER BY r) AS k FROM old) a
  JOIN (SELECT sig, r, row_number() OVER (PARTITION BY sig ORDER BY r) AS k FROM new) b USING (sig, k)""")
def fifo_pairs(spark, d):
    return grid.fifo(*signatures(spark, d), "sig", "r").select("sig", "k", "row_a", "row_b")


@query("""WITH s AS (SELECT o_custkey % 40 AS sheet, o_orderkey AS r, o_orderstatus AS sig FROM orders),
 m AS (SELECT *, CASE WHEN sig IS DISTINCT FROM lag(sig) OVER w OR lag(r) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM s WINDOW w AS (PARTITION BY sheet ORDER BY r)),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY sheet ORDER BY r) AS run FROM m)
 SELECT sheet, sig, min(r) AS "first", max(r) AS "last", count(*) AS n FROM g GROUP BY sheet, run, sig""")
def row_runs(spark, d):
    s = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("sheet"), F.col("o_orderkey").alias("r"), F.col("o_orderstatus").alias("sig"))
    return grid.runs(s, ["sheet"], "r", "sig")


@query(None)
def anchor_chain(spark, d):
    a, b = uniques(spark, d)
    return grid.anchor_chain(grid.anchors(a, b, "sig", "r", ["sheet"]), "sheet")


@query("""WITH a AS (SELECT o_custkey % 40 AS sheet, o_orderkey AS r, o_orderstatus AS sig FROM orders),
 b AS (SELECT sheet, r, CASE WHEN r % 1000 BETWEEN 300 AND 600 THEN 'Z' ELSE sig END AS sig FROM a),
 j AS (SELECT a.sheet, a.r, a.sig IS DISTINCT FROM b.sig AS differs FROM a JOIN b ON a.r = b.r)
 SELECT sheet, count(*) AS n, min(CASE WHEN differs THEN r END) AS first_differing, max(CASE WHEN differs THEN r END) AS last_differing FROM j GROUP BY sheet""")
def prefix_suffix(spark, d):
    a = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("sheet"), F.col("o_orderkey").alias("r"), F.col("o_orderstatus").alias("sig"))
    b = a.select("r", F.when(F.expr("r % 1000 between 300 and 600"), "Z").otherwise(F.col("sig")).alias("sig_b"))
    return grid.first_and_last_difference(a.join(b, "r"), ["sheet"], "r", "sig", "sig_b")


@query("""WITH s AS (SELECT o_custkey % 40 AS sheet, o_orderkey AS r, o_orderstatus AS sig FROM orders),
 w AS (SELECT sheet, r, sig, lead(sig, 1) OVER v AS s1, lead(sig, 2) OVER v AS s2, lead(sig, 3) OVER v AS s3 FROM s WINDOW v AS (PARTITION BY sheet ORDER BY r))
 SELECT sheet, sig || s1 || s2 || s3 AS context, count(*) AS n, min(r) AS "first" FROM w WHERE s3 IS NOT NULL GROUP BY ALL""")
def context_anchors(spark, d):
    s = table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("sheet"), F.col("o_orderkey").alias("r"), F.col("o_orderstatus").alias("sig"))
    c = grid.contexts(s, ["sheet"], "r", "sig", 4)
    return c.groupBy("sheet", "context").agg(F.count("*").alias("n"), F.min("r").alias("first"))


# ---- objects, documents, scalars


@query("""WITH a AS (SELECT lower(n_name) AS name, n_regionkey AS v FROM nation WHERE n_nationkey % 7 <> 2),
 b AS (SELECT lower(n_name) AS name, CASE WHEN n_nationkey % 4 = 1 THEN n_regionkey + 1 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey % 6 <> 3)
 SELECT * FROM (SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'NamedRangeAdded' WHEN b.name IS NULL THEN 'NamedRangeRemoved'
  WHEN a.v IS DISTINCT FROM b.v THEN 'NamedRangeChanged' END AS kind FROM a FULL JOIN b ON a.name = b.name) WHERE kind IS NOT NULL""")
def named_object_diff(spark, d):
    n = table(spark, d, "nation")
    new = n.where("n_nationkey % 6 <> 3").withColumn("n_regionkey", F.when(F.col("n_nationkey") % 4 == 1, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")))
    return objects.named_diff(n.where("n_nationkey % 7 <> 2"), new, F.lower("n_name"), "n_regionkey", "NamedRange")


@query("""WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 4), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 2 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 13 <> 6)
 SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS name, CASE WHEN a.doc_id IS NULL THEN 'DocumentAdded' WHEN b.doc_id IS NULL THEN 'DocumentRemoved'
  WHEN a.text IS DISTINCT FROM b.text THEN 'DocumentChanged' END AS kind FROM a FULL JOIN b ON a.doc_id = b.doc_id) WHERE kind IS NOT NULL""")
def doc_diff(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    new = t.where("doc_id % 13 <> 6").withColumn("text", F.when(F.col("doc_id") % 9 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    hashed = lambda x: x.select("doc_id", F.sha2("text", 256).alias("h"))  # noqa: E731  texts stay where they are
    return objects.named_diff(hashed(t.where("doc_id % 11 <> 4")), hashed(new), F.col("doc_id"), "h", "Document")


@query("""SELECT o_orderkey, regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '[ \\t\\n]+$', '') || chr(10) AS text
 FROM (SELECT o_orderkey, o_orderstatus || '  ' || chr(13) || chr(10) || o_orderpriority || chr(9) || chr(13) || 'x ' || chr(10) || chr(10) AS t FROM orders)""")
def text_normalise(spark, d):
    t = F.concat("o_orderstatus", F.lit("  \r\n"), "o_orderpriority", F.lit("\t\rx \n\n"))
    return table(spark, d, "orders").select("o_orderkey", normal_text(t).alias("text"))


@query("""WITH f AS (SELECT lower(c_name) AS path, 0 AS side FROM customer WHERE c_custkey % 5 <> 1 UNION ALL SELECT lower(c_name), 1 FROM customer WHERE c_custkey % 7 <> 2
  UNION ALL SELECT lower(c_name), 1 FROM customer WHERE c_custkey % 50 = 8),
 n AS (SELECT path, count_if(side = 0) AS n_old, count_if(side = 1) AS n_new FROM f GROUP BY path)
 SELECT path, CAST(n_old AS BIGINT) AS n_old, CAST(n_new AS BIGINT) AS n_new, CASE WHEN n_old > 1 OR n_new > 1 THEN 'duplicate' WHEN n_old = 0 THEN 'missing_old' WHEN n_new = 0 THEN 'missing_new' ELSE 'pending' END AS status FROM n""")
def file_pairing(spark, d):
    c = table(spark, d, "customer")
    side = lambda cond, s: c.where(cond).select(F.lower("c_name").alias("path"), F.lit(s).alias("side"))
    return objects.pairing(side("c_custkey % 5 <> 1", 0).union(side("c_custkey % 7 <> 2", 1)).union(side("c_custkey % 50 = 8", 1)), "path", "side")


@query("""SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM benchmark) WHERE token LIKE 'th%' GROUP BY ALL""")
def token_prefix_search(spark, d):
    return analysis.token_search(table(spark, d, "benchmark"), "item_id", "text", "th")


@query("""SELECT o_orderkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT))
  ELSE chr(CAST(65 + (n - 703) // 676 AS INT)) || chr(CAST(65 + ((n - 27) // 26) % 26 AS INT)) || chr(CAST(65 + (n - 1) % 26 AS INT)) END || CAST(o_orderkey + 1 AS VARCHAR) AS addr
  FROM (SELECT o_orderkey, o_orderkey % 16000 + 1 AS n FROM orders)""")
def a1_addresses(spark, d):
    return table(spark, d, "orders").select("o_orderkey", a1(F.col("o_orderkey"), F.col("o_orderkey") % 16000).alias("addr"))


@query("""WITH v AS (SELECT o_orderkey, o_totalprice AS a, o_totalprice * (1 + CAST(4e-16 AS DOUBLE)) AS b FROM orders),
 n AS (SELECT o_orderkey, round(a * pow(10.0, 14 - floor(log10(abs(a))))) / pow(10.0, 14 - floor(log10(abs(a)))) AS na,
  round(b * pow(10.0, 14 - floor(log10(abs(b))))) / pow(10.0, 14 - floor(log10(abs(b)))) AS nb, a = b AS same_bits FROM v)
 SELECT o_orderkey, same_bits, na = nb AS equal15 FROM n""")
def number_equality(spark, d):
    v = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_totalprice") * (1 + 4e-16)).alias("b"))
    return v.select("o_orderkey", (F.col("a") == F.col("b")).alias("same_bits"), (norm15(F.col("a")) == norm15(F.col("b"))).alias("equal15"))
