"""Queries: SQL capabilities over hydrated matches.

The relation ``hm`` is the match customer-PLACED->orders hydrated with the
wide customer file (segment, nation key, balance); Spark SQL runs over it as
a temp view, so match + hydration + SQL is one optimised plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hydrate as H
from ..operators import joins as JN
from ..operators import windows as W
from ..operators import match as M
from ..operators.match import E, N
from .registry import query
from .tpch import read, tpch_graph, with_graph


def hm_frame(spark, sf):
    g = tpch_graph(spark, sf)
    m = M.match(g, [N("c", "customer"), E(type="PLACED"),
                    N("o", "orders", props=["o_totalprice", "o_orderstatus", "o_orderdate"])])
    res = m.select(F.col("c.NODE").alias("NODE"), F.col("o.NODE").alias("o_node"),
                   F.col("o.o_totalprice").alias("price"), F.col("o.o_orderstatus").alias("status"),
                   F.col("o.o_orderdate").alias("odate"))
    wide = read(spark, sf, "customer").select(
        F.concat(F.lit("c:"), F.col("c_custkey")).alias("NODE"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    return H.hydrate(res, wide, key="NODE")


def views(spark, sf):
    hm_frame(spark, sf).createOrReplaceTempView("hm")
    for t in ("nation", "customer", "events"):
        read(spark, sf, t).createOrReplaceTempView(t)


HM_SQL = """
hm AS (SELECT c.NODE AS NODE, o.NODE AS o_node, o.o_totalprice AS price, o.o_orderstatus AS status,
              o.o_orderdate AS odate, w.c_mktsegment AS segment, w.c_nationkey AS nationkey, w.c_acctbal AS acctbal
       FROM nodes c JOIN edges e ON e.src = c.NODE AND e.type = 'PLACED' JOIN nodes o ON o.NODE = e.dst
       LEFT JOIN customer w ON 'c:' || w.c_custkey = c.NODE
       WHERE list_contains(c.labels, 'customer') AND list_contains(o.labels, 'orders'))
"""


def _duck(body: str) -> str:
    return with_graph("WITH " + HM_SQL + ("," + body[5:] if body.strip().upper().startswith("WITH ") else "\n" + body))


def sql_query(key: str, spark_sql: str, duck_sql: str | None = None):
    """Register a J query whose Spark SQL runs over the ``hm`` view."""
    def fn(spark, sf):
        views(spark, sf)
        return spark.sql(spark_sql)
    fn.__name__ = f"q_{key}"
    query(key, _duck(duck_sql or spark_sql))(fn)


sql_query("sql_filter_project", """
SELECT o_node, price, CASE WHEN price > 200000 THEN 'large' WHEN price > 100000 THEN 'medium' ELSE 'small' END AS size_class,
       segment AS `seg ment`
FROM hm WHERE status = 'F' AND acctbal > 0
""", """
SELECT o_node, price, CASE WHEN price > 200000 THEN 'large' WHEN price > 100000 THEN 'medium' ELSE 'small' END AS size_class,
       segment AS "seg ment"
FROM hm WHERE status = 'F' AND acctbal > 0
""")

sql_query("sql_inner_join", """
SELECT n.n_name AS nation, COUNT(*) AS orders, ROUND(SUM(hm.price), 2) AS total
FROM hm JOIN nation n ON n.n_nationkey = hm.nationkey GROUP BY n.n_name
""")

sql_query("sql_outer_join", """
SELECT coalesce(a.segment, b.segment) AS segment, a.n_f AS n_f, b.n_big_o AS n_big_o
FROM (SELECT segment, COUNT(*) AS n_f FROM hm WHERE status = 'F' GROUP BY segment) a
FULL OUTER JOIN (SELECT segment, COUNT(*) AS n_big_o FROM hm WHERE status = 'O' AND price > 400000 GROUP BY segment) b
ON a.segment = b.segment
UNION ALL
SELECT CAST(c.c_custkey AS STRING), COUNT(hm.o_node), NULL
FROM customer c LEFT JOIN hm ON hm.NODE = concat('c:', CAST(c.c_custkey AS STRING))
GROUP BY c.c_custkey HAVING COUNT(hm.o_node) < 3
""", """
SELECT coalesce(a.segment, b.segment) AS segment, a.n_f AS n_f, b.n_big_o AS n_big_o
FROM (SELECT segment, COUNT(*) AS n_f FROM hm WHERE status = 'F' GROUP BY segment) a
FULL OUTER JOIN (SELECT segment, COUNT(*) AS n_big_o FROM hm WHERE status = 'O' AND price > 400000 GROUP BY segment) b
ON a.segment = b.segment
UNION ALL
SELECT CAST(c.c_custkey AS VARCHAR), COUNT(hm.o_node), NULL
FROM customer c LEFT JOIN hm ON hm.NODE = 'c:' || CAST(c.c_custkey AS VARCHAR)
GROUP BY c.c_custkey HAVING COUNT(hm.o_node) < 3
""")

sql_query("sql_semi_anti", """
SELECT 'in' AS kind, c_custkey FROM customer WHERE concat('c:', CAST(c_custkey AS STRING)) IN (SELECT NODE FROM hm WHERE price > 400000)
UNION ALL
SELECT 'not_exists', c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.NODE = concat('c:', CAST(c.c_custkey AS STRING)) AND hm.status = 'P')
""", """
SELECT 'in' AS kind, c_custkey FROM customer WHERE 'c:' || c_custkey IN (SELECT NODE FROM hm WHERE price > 400000)
UNION ALL
SELECT 'not_exists', c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.NODE = 'c:' || c.c_custkey AND hm.status = 'P')
""")


@query("sql_theta_range", _duck("""
SELECT n.n_name AS nation, COUNT(*) AS orders
FROM hm JOIN nation n ON hm.price >= n.n_nationkey * 20000 AND hm.price < n.n_nationkey * 20000 + 20000
GROUP BY n.n_name
"""))
def q_sql_theta_range(spark, sf):
    """Range join through tree nodes (no nested loop): each order joins the
    nation whose price band contains its total."""
    hm = hm_frame(spark, sf)
    bands = read(spark, sf, "nation").select(
        F.col("n_name").alias("nation"), (F.col("n_nationkey") * 20000).cast("double").alias("lo"),
        (F.col("n_nationkey") * 20000 + 20000).cast("double").alias("hi"))
    j = JN.range_join(hm, "price", bands, "lo", "hi")
    return j.groupBy("nation").agg(F.count(F.lit(1)).alias("orders"))


@query("sql_asof", """
SELECT p.event_id AS event_id, v.event_id AS view_event_id, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def q_sql_asof(spark, sf):
    """As-of: for each purchase, the user's latest view at or before it."""
    ev = read(spark, sf, "events")
    p = ev.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    v = ev.filter(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("vts"), F.col("event_id").alias("view_event_id"),
        F.col("value").alias("view_value"))
    out = JN.asof_join(p, v, "user_id", "ts", "vts", ["view_event_id", "view_value"], time_bucket=7 * 86400)
    return out.select("event_id", "view_event_id", "view_value")


sql_query("sql_group_agg", """
SELECT segment, COUNT(*) AS n, ROUND(SUM(price), 2) AS total, MIN(price) AS mn, MAX(price) AS mx,
       ROUND(AVG(price), 2) AS avg_price
FROM hm GROUP BY segment
""")

sql_query("sql_count_distinct", """
SELECT status, COUNT(DISTINCT NODE) AS customers, COUNT(DISTINCT nationkey) AS nations, COUNT(*) AS orders
FROM hm GROUP BY status
""")

sql_query("sql_rollup_cube", """
SELECT 'rollup' AS kind, segment, status, grouping_id(segment, status) AS gid, COUNT(*) AS n
FROM hm GROUP BY ROLLUP(segment, status)
UNION ALL
SELECT 'cube', segment, status, grouping_id(segment, status), COUNT(*) FROM hm GROUP BY CUBE(segment, status)
UNION ALL
SELECT 'sets', segment, status, grouping_id(segment, status), COUNT(*) FROM hm
GROUP BY GROUPING SETS ((segment), (status), ())
""", """
SELECT 'rollup' AS kind, segment, status, GROUPING(segment, status) AS gid, COUNT(*) AS n
FROM hm GROUP BY ROLLUP(segment, status)
UNION ALL
SELECT 'cube', segment, status, GROUPING(segment, status), COUNT(*) FROM hm GROUP BY CUBE(segment, status)
UNION ALL
SELECT 'sets', segment, status, GROUPING(segment, status), COUNT(*) FROM hm
GROUP BY GROUPING SETS ((segment), (status), ())
""")

@query("sql_window_rank", _duck("""
SELECT o_node, NODE,
       CAST(row_number() OVER (PARTITION BY NODE ORDER BY price DESC, o_node) AS BIGINT) AS rn,
       CAST(rank() OVER (PARTITION BY NODE ORDER BY status) AS BIGINT) AS rk,
       CAST(dense_rank() OVER (PARTITION BY NODE ORDER BY status) AS BIGINT) AS drk,
       CAST(ntile(3) OVER (PARTITION BY NODE ORDER BY price DESC, o_node) AS BIGINT) AS tile
FROM hm
"""))
def q_sql_window_rank(spark, sf):
    """Ranks; a customer with very many orders is not sorted by one task."""
    hm = hm_frame(spark, sf).select("o_node", "NODE", "price", "status")
    hot = W.hot_keys(hm, ["NODE"])
    out = W.scan(hm, ["NODE"], [F.col("price").desc(), F.col("o_node")], row_number="rn", ntile=("tile", 3), hot=hot)
    out = W.ranks(out, ["NODE"], ["status"], rank="rk", dense_rank="drk", hot=hot)
    return out.select("o_node", "NODE", "rn", "rk", "drk", "tile")


@query("sql_window_frame", _duck("""
SELECT o_node, NODE,
       CAST(SUM(CAST(ROUND(price * 100) AS BIGINT)) OVER (PARTITION BY NODE ORDER BY odate, o_node
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_cents,
       AVG(CAST(ROUND(price * 100) AS BIGINT)) OVER (PARTITION BY NODE ORDER BY odate, o_node
           ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_cents,
       lag(price) OVER (PARTITION BY NODE ORDER BY odate, o_node) AS prev_price,
       lead(o_node, 1) OVER (PARTITION BY NODE ORDER BY odate, o_node) AS next_order
FROM hm
"""))
def q_sql_window_frame(spark, sf):
    """Running sum, moving average, lag and lead; a customer with very many orders is not sorted by one task."""
    hm = hm_frame(spark, sf).select("o_node", "NODE", "odate", "price", F.round(F.col("price") * 100).cast("long").alias("cents"))
    out = W.scan(hm, ["NODE"], [F.col("odate"), F.col("o_node")], sums={"running_cents": "cents"},
                 near={"p1": ("cents", -1), "p2": ("cents", -2), "prev_price": ("price", -1), "next_order": ("o_node", 1)})
    seen = [F.col(c) for c in ("cents", "p1", "p2")]
    total = sum((F.coalesce(c, F.lit(0)) for c in seen[1:]), F.coalesce(seen[0], F.lit(0)))
    n = sum((c.isNotNull().cast("int") for c in seen[1:]), seen[0].isNotNull().cast("int"))
    return out.select("o_node", "NODE", "running_cents", (total / n).alias("moving_cents"), "prev_price", "next_order")


sql_query("sql_set_ops", """
SELECT 'union' AS kind, COUNT(*) AS n FROM (SELECT NODE FROM hm WHERE status = 'F' UNION SELECT NODE FROM hm WHERE price > 300000) u
UNION ALL SELECT 'union_all', COUNT(*) FROM (SELECT NODE FROM hm WHERE status = 'F' UNION ALL SELECT NODE FROM hm WHERE price > 300000) u
UNION ALL SELECT 'intersect', COUNT(*) FROM (SELECT NODE FROM hm WHERE status = 'F' INTERSECT SELECT NODE FROM hm WHERE price > 300000) u
UNION ALL SELECT 'intersect_all', COUNT(*) FROM (SELECT NODE FROM hm WHERE status = 'F' INTERSECT ALL SELECT NODE FROM hm WHERE price > 300000) u
UNION ALL SELECT 'except', COUNT(*) FROM (SELECT NODE FROM hm WHERE status = 'F' EXCEPT SELECT NODE FROM hm WHERE price > 300000) u
UNION ALL SELECT 'except_all', COUNT(*) FROM (SELECT NODE FROM hm WHERE status = 'F' EXCEPT ALL SELECT NODE FROM hm WHERE price > 300000) u
""")

sql_query("sql_sort_limit", """
SELECT o_node, price AS p FROM hm ORDER BY p DESC, o_node LIMIT 10 OFFSET 5
""")

sql_query("sql_cte_subquery", """
WITH seg_avg AS (SELECT segment, AVG(price) AS a FROM hm GROUP BY segment)
SELECT h.NODE AS NODE, COUNT(*) AS above_avg
FROM hm h
WHERE EXISTS (SELECT 1 FROM seg_avg s WHERE s.segment = h.segment AND h.price > s.a)
  AND EXISTS (SELECT 1 FROM hm h2 WHERE h2.NODE = h.NODE AND h2.status = 'O')
GROUP BY h.NODE
HAVING COUNT(*) >= (SELECT MAX(cnt) FROM (SELECT COUNT(*) AS cnt FROM hm GROUP BY NODE) t) / 3
""")

sql_query("sql_string_date_math", """
SELECT o_node, upper(segment) AS seg, substring(o_node, 3) AS okey, CAST(length(o_node) AS BIGINT) AS len,
       CAST(year(odate) AS BIGINT) AS yr, CAST(month(odate) AS BIGINT) AS mo, ROUND(sqrt(price), 4) AS sq,
       CAST(floor(price / 1000) AS BIGINT) AS k, abs(acctbal) AS aa, concat(segment, '-', status) AS tag,
       replace(lower(segment), 'e', '3') AS leet, lpad(CAST(nationkey AS STRING), 3, '0') AS nk
FROM hm
""", """
SELECT o_node, upper(segment) AS seg, substring(o_node, 3) AS okey, CAST(length(o_node) AS BIGINT) AS len,
       CAST(year(odate) AS BIGINT) AS yr, CAST(month(odate) AS BIGINT) AS mo, ROUND(sqrt(price), 4) AS sq,
       CAST(floor(price / 1000) AS BIGINT) AS k, abs(acctbal) AS aa, concat(segment, '-', status) AS tag,
       replace(lower(segment), 'e', '3') AS leet, lpad(CAST(nationkey AS VARCHAR), 3, '0') AS nk
FROM hm
""")

sql_query("sql_json_array_map", """
SELECT 'json' AS kind, event_type AS k, CAST(SUM(CAST(get_json_object(props, '$.k') AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY event_type
UNION ALL
SELECT 'unnest', lbl, COUNT(*) FROM (SELECT explode(array(segment, status)) AS lbl FROM hm) t GROUP BY lbl
UNION ALL
SELECT 'array', segment, CAST(SUM(size(filter(array(price, acctbal), x -> x > 1000))) AS BIGINT) FROM hm GROUP BY segment
UNION ALL
SELECT 'map', status, CAST(SUM(element_at(map('F', 1, 'O', 2, 'P', 3), status)) AS BIGINT) FROM hm GROUP BY status
""", """
SELECT 'json' AS kind, event_type AS k, CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY event_type
UNION ALL
SELECT 'unnest', lbl, COUNT(*) FROM (SELECT unnest([segment, status]) AS lbl FROM hm) t GROUP BY lbl
UNION ALL
SELECT 'array', segment, CAST(SUM(len(list_filter([price, acctbal], lambda x: x > 1000))) AS BIGINT) FROM hm GROUP BY segment
UNION ALL
SELECT 'map', status, CAST(SUM(MAP {'F': 1, 'O': 2, 'P': 3}[status]) AS BIGINT) FROM hm GROUP BY status
""")
