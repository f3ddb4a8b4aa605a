"""Registered queries: joins, grouping, subqueries, windows, set operations, ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeweft.engine import Compat
from lakeweft.operators import aggregates, joins, recset, scan, windows
from lakeweft.plans.kit import Query, table, text

#: name -> (dialect text, oracle SQL); an oracle of None means the text itself is portable.
TEXTS: dict[str, tuple[str, str | None]] = {
    "q1_multi_agg": ("""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""", None),
    "q3_topk_join": ("""SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""", None),
    "q4_exists_group": ("""SELECT o_orderpriority, COUNT(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) GROUP BY o_orderpriority""", None),
    "q5_wide_join": ("""SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""", None),
    "q6_filter_agg": ("""SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""", None),
    "q7_or_join": ("""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1') GROUP BY n1.n_name, n2.n_name""", None),
    "q8_cond_agg": ("""SELECT YEAR(o_orderdate) AS o_year, ROUND(SUM(CASE WHEN n_name = 'NATION_3' THEN l_extendedprice ELSE 0 END) / SUM(l_extendedprice), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY YEAR(o_orderdate)""", """SELECT CAST(YEAR(o_orderdate) AS INT) AS o_year, ROUND(SUM(CASE WHEN n_name = 'NATION_3' THEN l_extendedprice ELSE 0 END) / SUM(l_extendedprice), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY YEAR(o_orderdate)"""),
    "q9_profit": ("""SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity), 2) AS profit FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%widget%' GROUP BY n_name""", None),
    "q10_returned": ("""SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20""", None),
    "q11_having_scalar": ("""SELECT l_partkey, ROUND(SUM(l_extendedprice), 2) AS value FROM lineitem GROUP BY l_partkey HAVING SUM(l_extendedprice) > (SELECT SUM(l_extendedprice) * 0.0008 FROM lineitem)""", None),
    "q12_case_count": ("""SELECT l_linestatus, SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_count, SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus""", """SELECT l_linestatus, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_count, CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus"""),
    "q13_left_distribution": ("""SELECT c_count, COUNT(*) AS custdist FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) AS c_orders GROUP BY c_count""", None),
    "q15_max_of_group": ("""SELECT s_suppkey, s_name, r.total FROM supplier JOIN (SELECT l_suppkey AS k, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey) r ON s_suppkey = r.k WHERE r.total = (SELECT MAX(t) FROM (SELECT ROUND(SUM(l_extendedprice), 2) AS t FROM lineitem GROUP BY l_suppkey) m)""", None),
    "q16_anti_count_distinct": ("""SELECT p_brand, p_type, COUNT(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#2' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000) GROUP BY p_brand, p_type""", None),
    "q17_corr_avg": ("""SELECT ROUND(SUM(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#4' AND l_quantity < (SELECT 0.4 * AVG(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""", None),
    "q18_grouped_in": ("""SELECT c_name, o_orderkey, ROUND(SUM(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200) GROUP BY c_name, o_orderkey""", None),
    "q19_or_branches": ("""SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30)""", None),
    "q20_in_exists": ("""SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') AND l_quantity > 45) AND n_regionkey = 1""", None),
    "q21_exists_not_exists": ("""SELECT s_name, COUNT(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name""", None),
    "q22_corr_not_exists": ("""SELECT c_nationkey, COUNT(*) AS numcust, ROUND(SUM(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey""", None),
    "correlated_count_zero": ("""SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS n FROM customer""", None),
    "scalar_subquery_select": ("""SELECT n_name, (SELECT MAX(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS top_balance FROM nation""", None),
    "derived_alias_columns": ("""SELECT t.k, COUNT(*) AS n FROM (SELECT c_nationkey, c_custkey FROM customer) AS t(k, id) GROUP BY t.k""", None),
    "aggregate_of_aggregate": ("""SELECT ROUND(AVG(total), 2) AS avg_total, MAX(n) AS max_n FROM (SELECT o_custkey, SUM(o_totalprice) AS total, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS per_customer""", None),
    "global_agg_empty": ("""SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MAX(o_orderpriority) AS m FROM orders WHERE o_totalprice < 0""", None),
    "having_expression": ("""SELECT o_orderstatus, YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, YEAR(o_orderdate) HAVING COUNT(*) > 100 AND AVG(o_totalprice) > 100000""", """SELECT o_orderstatus, CAST(YEAR(o_orderdate) AS INT) AS y, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, YEAR(o_orderdate) HAVING COUNT(*) > 100 AND AVG(o_totalprice) > 100000"""),
    "aggregate_in_order_by": ("""SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY SUM(c_acctbal) DESC LIMIT 3""", None),
    "count_distinct": ("""SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag""", None),
    "group_concat_ordered": ("""SELECT r_name, GROUP_CONCAT(n_name SEPARATOR '; ') AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""", """SELECT r_name, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""),
    "min_max_strings_dates": ("""SELECT MIN(n_name) AS first_name, MAX(n_name) AS last_name FROM nation""", None),
    "decimal_rounding": ("""SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS s, ROUND(AVG(c_acctbal), 2) AS a FROM customer GROUP BY c_mktsegment""", None),
    "right_join": ("""SELECT n_name, COUNT(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""", None),
    "left_join_filtered_on": ("""SELECT n_name, COUNT(c_custkey) AS rich FROM nation LEFT OUTER JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_name""", None),
    "cross_join": ("""SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey <> n_regionkey""", None),
    "theta_join": ("""SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""", None),
    "semi_join": ("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""", None),
    "anti_join": ("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""", None),
    "not_in_null_aware": ("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 7 THEN NULL ELSE o_custkey END FROM orders)""", None),
    "in_over_union": ("""SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500)""", None),
    "union_all": ("""SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_nationkey AS k FROM supplier""", None),
    "union_distinct": ("""SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier""", None),
    "ordered_union_limit": ("""SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name AS name, s_acctbal AS bal FROM supplier ORDER BY bal DESC, name LIMIT 15""", None),
    "count_over_union": ("""SELECT COUNT(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier) AS u""", None),
    "intersect_except": ("""SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey AS k FROM supplier""", None),
    "select_distinct": ("""SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""", None),
    "order_limit_offset": ("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20, 10""", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20"""),
    "order_collation": ("""SELECT p_partkey, p_name FROM part ORDER BY p_name COLLATE utf8mb4_general_ci DESC, p_partkey LIMIT 25""", """SELECT p_partkey, p_name FROM part ORDER BY lower(p_name) DESC, p_partkey LIMIT 25"""),
    "row_number_topk": ("""SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3""", """SELECT c_nationkey, c_custkey, CAST(rn AS INT) AS rn FROM (SELECT c_nationkey, c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) t WHERE rn <= 3"""),
    "rank_dense": ("""SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part""", """SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS INT) AS d FROM part"""),
    "lag_lead": ("""SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, LEAD(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next2 FROM orders""", None),
    "running_sum": ("""SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS run FROM orders""", None),
    "window_group_concat": ("""SELECT n_nationkey, GROUP_CONCAT(n_name SEPARATOR '|') OVER (PARTITION BY n_regionkey) AS peers FROM nation""", """SELECT n_nationkey, string_agg(n_name, '|') OVER (PARTITION BY n_regionkey ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS peers FROM nation"""),
    "window_over_group": ("""SELECT o_orderstatus, y, n, LEAD(n) OVER (PARTITION BY o_orderstatus ORDER BY y) AS next_n FROM (SELECT o_orderstatus, YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, YEAR(o_orderdate)) t""", """SELECT o_orderstatus, CAST(y AS INT) AS y, n, LEAD(n) OVER (PARTITION BY o_orderstatus ORDER BY y) AS next_n FROM (SELECT o_orderstatus, YEAR(o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, YEAR(o_orderdate)) t"""),
    "first_last_value": ("""SELECT c_custkey, FIRST_VALUE(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS poorest, LAST_VALUE(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS richest FROM customer""", None),
    "pivot_conditional": ("""SELECT YEAR(o_orderdate) AS y, COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, COUNT(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, COUNT(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY YEAR(o_orderdate)""", """SELECT CAST(YEAR(o_orderdate) AS INT) AS y, COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, COUNT(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, COUNT(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders GROUP BY YEAR(o_orderdate)"""),
    "point_lookup": ("""SELECT * FROM orders WHERE o_orderkey = 1""", None),
    "zero_source_select": ("""SELECT 1 + 1 AS two, 'a' AS letter, NULL IS NULL AS unknown""", None),
    "view_expansion": ("""SELECT n_name, total FROM (SELECT n_name, ROUND(SUM(c_acctbal), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name) AS v WHERE total > 100000""", None),
    "multi_level_correlation": ("""SELECT r_name, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000)) AS n FROM region""", None),
    "recursive_cte": ("""WITH RECURSIVE up(k, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, depth + 1 FROM nation JOIN up ON n_nationkey = k + 5) SELECT k, depth FROM up""", None),
    "grouping_sets": ("""SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""", None),
}


def _bound(sql: str, oracle: str, args) -> tuple[Query, str]:
    return text(sql, args=args), oracle


def _range_join(spark, d):
    bands = spark.createDataFrame([(i, i * 50_000.0, i * 50_000.0 + 49_999.99) for i in range(12)], "band int, low double, high double")
    got = joins.range_join(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high")
    return got.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _disjunctive(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    got = joins.disjunctive_join(c, s, [[("c_custkey", "s_suppkey")], [("c_nationkey", "s_nationkey")]])
    return got.select("c_custkey", "s_suppkey")


def _in_value(spark, d):
    orders = table(spark, d, "orders").select(F.when(F.col("o_orderkey") != 7, F.col("o_custkey")).alias("k"))
    return joins.in_value(table(spark, d, "customer").select("c_custkey"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")), orders, "k", "found")


def _single(spark, d):
    return joins.single_join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), [("c_custkey", "o_custkey")], "o_totalprice", "latest", [F.desc("o_orderdate"), F.asc("o_orderkey")])


def _asof(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("value").alias("seen_value"))
    return joins.asof_join(left, right, "ts", "seen", ["user_id"]).select("event_id", "seen", "seen_value")


def _recset(spark, d):
    t = table(spark, d, "part")
    a, b, c = (recset.RecordSet(t, x) for x in ("p_size < 20", "p_brand = 'Brand#1'", "p_type = 'ECONOMY'"))
    return ((a | b) - c & ~recset.RecordSet(t, "p_retailprice > 1500")).rows().select("p_partkey", "p_size", "p_brand")


def _recset_project(spark, d):
    rich = recset.RecordSet(table(spark, d, "customer"), "c_acctbal > 9000")
    return rich.project_join(["c_custkey"], table(spark, d, "orders"), ["o_custkey"]).select("o_orderkey", "o_custkey")


def _late_filter(spark, d):
    accepted = table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return scan.scan_order_batch_accept(table(spark, d, "orders"), accepted, ["o_orderkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 12).select("o_orderkey", "o_totalprice")


def _order_multi(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return scan.scan_order_multi([c, s], [F.asc("bal"), F.asc("name")], 20, 5)


def _per_partition(spark, d):
    return scan.scan_order(table(spark, d, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], limit=2, offset=1, per=["o_orderpriority"], columns=["o_orderpriority", "o_orderkey"])


def _outer_scan(spark, d):
    return scan.scan(table(spark, d, "nation"), "n_nationkey > 1000", ["n_nationkey", "n_name"], outer=True)


def _statistics(spark, d):
    return scan.planner_statistics(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"]).drop("n_distinct")


def _ordered_fold(spark, d):
    """Balance that never falls under zero: no window function expresses it."""

    def step(state, row):
        state = max(0.0, state + (row["value"] if row["event_type"] != "purchase" else -row["value"]))
        return state, round(state, 2)

    return windows.ordered_fold(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), ["user_id"], ["ts", "event_id"], "balance", "double", lambda: 0.0, step).select("event_id", "balance")


def _custom_agg(spark, d):
    x = table(spark, d, "nation")
    code = aggregates.reduce_aggregate(F.col("n_nationkey").cast("long"), F.lit(0).cast("long"), lambda s, v: s * 31 % 1000003 + v, F.col("n_nationkey"))
    return x.groupBy("n_regionkey").agg(code.alias("code"))


def _whole_window(spark, d):
    w = Window.partitionBy("c_nationkey")
    return table(spark, d, "customer").select("c_custkey", F.round(F.sum("c_acctbal").over(w), 2).alias("total"), F.count("*").over(w).alias("n"), F.max("c_acctbal").over(w).alias("top"))


DIRECT: dict[str, tuple[Query, str | None]] = {
    "range_join": (_range_join, "WITH bands AS (SELECT CAST(i AS INT) AS band, i * 50000.0 AS low, i * 50000.0 + 49999.99 AS high FROM range(12) t(i)) SELECT band, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN bands ON o_totalprice BETWEEN low AND high GROUP BY band"),
    "disjunctive_join": (_disjunctive, "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_nationkey = s_nationkey"),
    "in_value_three_valued": (_in_value, "SELECT c_custkey, (CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END) IN (SELECT CASE WHEN o_orderkey <> 7 THEN o_custkey END FROM orders) AS found FROM customer"),
    "single_join": (_single, "SELECT c_custkey, (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) AS latest FROM customer"),
    "asof_join": (_asof, "SELECT l.event_id, r.ts AS seen, r.value AS seen_value FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts"),
    "recset_algebra": (_recset, "SELECT p_partkey, p_size, p_brand FROM part WHERE (p_size < 20 OR p_brand = 'Brand#1') AND NOT p_type = 'ECONOMY' AND NOT p_retailprice > 1500"),
    "recset_project_join": (_recset_project, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)"),
    "late_filter_limit": (_late_filter, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) ORDER BY o_totalprice DESC, o_orderkey LIMIT 12"),
    "scan_order_multi": (_order_multi, "SELECT name, bal FROM (SELECT c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier) ORDER BY bal, name LIMIT 20 OFFSET 5"),
    "per_partition_limit": (_per_partition, "SELECT o_orderpriority, o_orderkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r BETWEEN 2 AND 3"),
    "outer_scan_null_row": (_outer_scan, "SELECT n_nationkey, n_name FROM (SELECT 1) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 1000) ON TRUE"),
    "planner_statistics": (_statistics, "SELECT 'n_nationkey' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT(n_nationkey) AS n_nulls, CAST(MIN(n_nationkey) AS VARCHAR) AS min_value, CAST(MAX(n_nationkey) AS VARCHAR) AS max_value FROM nation UNION ALL SELECT 'n_name', COUNT(*), COUNT(*) - COUNT(n_name), MIN(n_name), MAX(n_name) FROM nation UNION ALL SELECT 'n_regionkey', COUNT(*), COUNT(*) - COUNT(n_regionkey), CAST(MIN(n_regionkey) AS VARCHAR), CAST(MAX(n_regionkey) AS VARCHAR) FROM nation"),
    "ordered_fold": (_ordered_fold, "SELECT event_id, ROUND(s - LEAST(0, MIN(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 2) AS balance FROM (SELECT event_id, user_id, ts, SUM(CASE WHEN event_type <> 'purchase' THEN value ELSE -value END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events)"),
    "custom_aggregate": (_custom_agg, "SELECT n_regionkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey)), lambda s, v: s * 31 % 1000003 + v) AS BIGINT) AS code FROM nation GROUP BY n_regionkey"),
    "window_total": (_whole_window, "SELECT c_custkey, ROUND(SUM(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS total, COUNT(*) OVER (PARTITION BY c_nationkey) AS n, MAX(c_acctbal) OVER (PARTITION BY c_nationkey) AS top FROM customer"),
    "window_order_compat": (text("SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate), 2) AS total FROM orders", compat=Compat(window_order_ignored=True)), "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_orderstatus), 2) AS total FROM orders"),
    "ci_equality_compat": (text("SELECT r_regionkey FROM region WHERE r_name = 'asia' OR r_name IN ('Europe')", compat=Compat(ci_equality=True)), "SELECT r_regionkey FROM region WHERE lower(r_name) IN ('asia', 'europe')"),
    "placeholders_mysql": _bound("SELECT o_orderkey FROM orders WHERE o_orderpriority = ? AND o_totalprice > ? ORDER BY o_orderkey LIMIT ?", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 300000 ORDER BY o_orderkey LIMIT 30", ["2-HIGH", 300000, 30]),
    "placeholders_psql": (text("SELECT o_orderkey FROM orders WHERE o_orderpriority = $2 AND o_totalprice > $1::numeric", "psql", [300000, "2-HIGH"]), "SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 300000"),
}


def queries() -> dict[str, Query]:
    return {n: text(sql) for n, (sql, _) in TEXTS.items()} | {n: q for n, (q, _) in DIRECT.items()}


def oracle_sql() -> dict[str, str]:
    out = {n: oracle or sql for n, (sql, oracle) in TEXTS.items()}
    return out | {n: o for n, (_, o) in DIRECT.items() if o}
