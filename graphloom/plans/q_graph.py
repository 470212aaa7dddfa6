"""Queries over the §7.2 graph: sources, build, matching, summaries, hydration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import normalize_labels
from ..functions.types import decimals_to_double
from ..operators import build as B
from ..operators import hydrate as H
from ..operators import match as M
from ..operators import name_index as NI
from ..operators import ontology as O
from ..operators.match import E, N
from ..operators.paths import count_paths
from ..sources import files as S
from ..sources import fs, store
from .registry import query
from .tpch import edge_specs, node_specs, read, tpch_graph, tpch_ontology, with_graph


def _j(c):
    return F.array_join(c, "|")


# ------------------------------------------------------------------ 2.1 sources

@query("scan_parquet", """
SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def q_scan_parquet(spark, sf):
    n = S.scan(spark, f"{sf}/nation.parquet")
    r = S.scan(spark, f"{sf}/region")          # bare name resolves to .parquet
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")


@query("scan_csv_json", """
SELECT 'csv' AS fmt, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation
UNION ALL SELECT 'json', CAST(n_nationkey AS BIGINT), n_name, CAST(n_regionkey AS BIGINT) FROM nation
""")
def q_scan_csv_json(spark, sf):
    from ..session import scratch_path
    base = scratch_path(spark, "nation-copy")
    nat = read(spark, sf, "nation")
    nat.write.mode("overwrite").option("header", True).csv(base + "/nation.csv")
    nat.write.mode("overwrite").json(base + "/nation.jsonl")
    c = S.scan(spark, base + "/nation.csv")
    j = S.scan(spark, base + "/nation.jsonl")
    cols = ["n_nationkey", "n_name", "n_regionkey"]
    return (c.select(F.lit("csv").alias("fmt"), *[F.col(x).cast("long" if x != "n_name" else "string").alias(x) for x in cols])
            .unionByName(j.select(F.lit("json").alias("fmt"),
                                  *[F.col(x).cast("long" if x != "n_name" else "string").alias(x) for x in cols])))


@query("register_tables", """
SELECT r.r_name AS r_name, COUNT(*) AS n_nations
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name
""")
def q_register_tables(spark, sf):
    S.register_tables(spark, {"tpch.nation": f"{sf}/nation.parquet", "region": f"{sf}/region.parquet"})
    return spark.sql("SELECT r.r_name AS r_name, COUNT(*) AS n_nations FROM tpch.nation n "
                     "JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")


@query("run_sql", """
SELECT n.n_name AS n_name, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name
""")
def q_run_sql(spark, sf):
    S.register_tables(spark, {t: f"{sf}/{t}.parquet" for t in ("orders", "customer", "nation")})
    return H.run_sql(spark, """
        SELECT n.n_name AS n_name, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS total
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name""")


@query("load_table", """
SELECT n_nationkey, n_name, COUNT(*) AS copies FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation)
GROUP BY n_nationkey, n_name
""")
def q_load_table(spark, sf):
    from ..session import scratch_path
    root = scratch_path(spark, "tables")
    S.load_table(spark, f"{sf}/nation.parquet", root=root)
    t = S.load_table(spark, f"{sf}/nation.parquet", root=root)      # re-import appends
    return t.groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("copies"))


@query("preview_tables", """
SELECT * FROM (SELECT 'customer' AS tbl, CAST(c_custkey AS VARCHAR) AS key FROM customer ORDER BY c_custkey LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders ORDER BY o_orderkey LIMIT 25)
UNION ALL SELECT * FROM (SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation ORDER BY n_nationkey LIMIT 25)
""")
def q_preview_tables(spark, sf):
    srcs = {"customer": f"{sf}/customer.parquet", "orders": f"{sf}/orders.parquet",
            "nation": f"{sf}/nation.parquet", "missing": f"{sf}/no_such_table.parquet"}
    return S.preview_tables(spark, srcs, n=25)


@query("read_columns", """
SELECT 'c:' || c_custkey AS NODE, c_mktsegment, c_acctbal FROM customer
""")
def q_read_columns(spark, sf):
    wide = read(spark, sf, "customer").withColumn("NODE", F.concat(F.lit("c:"), F.col("c_custkey")))
    return S.read_columns(wide, key="NODE", columns=["c_mktsegment", "NODE", "c_acctbal"])


EVENTS_GRAPH_SQL = """
ev_nodes AS (SELECT DISTINCT 'u:' || user_id AS NODE FROM events
             UNION ALL SELECT DISTINCT 'et:' || event_type FROM events),
ev_edges AS (SELECT 'ev:' || event_id AS ID FROM events)
"""


def events_graph(spark, sf):
    ev = read(spark, sf, "events")
    nodes = B.build_nodes(spark, [
        B.NodeSpec(ev.select(F.concat(F.lit("u:"), F.col("user_id")).alias("id")), id="id", label="user"),
        B.NodeSpec(ev.select(F.concat(F.lit("et:"), F.col("event_type")).alias("id")), id="id",
                   label="event_type")])
    edges = B.build_edges(spark, [B.EdgeSpec(
        ev.select(F.concat(F.lit("ev:"), F.col("event_id")).alias("id"),
                  F.concat(F.lit("u:"), F.col("user_id")).alias("s"),
                  F.concat(F.lit("et:"), F.col("event_type")).alias("d"), "value"),
        id="id", source_key="s", target_key="d", type="DID", properties=["value"])], nodes)
    from ..graph import PropertyGraph
    return PropertyGraph(nodes, edges, name="events")


@query("graph_sizes", with_graph("WITH " + EVENTS_GRAPH_SQL + """
SELECT 'tpch' AS graph, (SELECT COUNT(*) FROM nodes) AS nodes, (SELECT COUNT(*) FROM edges) AS edges
UNION ALL SELECT 'events', (SELECT COUNT(*) FROM ev_nodes), (SELECT COUNT(*) FROM ev_edges)
UNION ALL SELECT 'empty', 0, 0
"""))
def q_graph_sizes(spark, sf):
    from ..sources import store
    g1, g2 = tpch_graph(spark, sf), events_graph(spark, sf)
    empty = spark.createDataFrame([("empty",)], "graph string")
    return store.graph_sizes([("tpch", g1), ("events", g2)], known=empty)


@query("write_graph", with_graph("""
SELECT 'tpch_nodes' AS tbl, COUNT(*) AS n FROM nodes
UNION ALL SELECT 'tpch_edges', COUNT(*) FROM edges
UNION ALL SELECT 'tpch_label_keys:EntityType', COUNT(DISTINCT LABEL) FROM nodes HAVING COUNT(*) > 0
UNION ALL SELECT 'tpch_label_keys:Segment', COUNT(DISTINCT c_mktsegment) FROM customer HAVING COUNT(c_mktsegment) > 0
UNION ALL SELECT 'tpch_label_keys:Brand', COUNT(DISTINCT p_brand) FROM part HAVING COUNT(p_brand) > 0
"""))
def q_write_graph(spark, sf):
    from ..session import scratch_path
    from ..sources import store
    root = scratch_path(spark, "store")
    back = store.build_and_store(spark, node_specs(spark, sf), edge_specs(spark, sf), root, "tpch",
                                 ontology=tpch_ontology(spark, sf))
    lk = spark.read.parquet(store.table_path(root, "tpch", "label_keys"))
    return (back.nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("tpch_nodes").alias("tbl"), "n")
            .unionByName(back.edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("tpch_edges").alias("tbl"), "n"))
            .unionByName(lk.select(F.concat(F.lit("tpch_label_keys:"), "label_key").alias("tbl"), F.size("label").cast("long").alias("n"))))


@query("delete_graph", "WITH " + EVENTS_GRAPH_SQL + """
SELECT 'events' AS graph, (SELECT COUNT(*) FROM ev_nodes) AS nodes, (SELECT COUNT(*) FROM ev_edges) AS edges
""")
def q_delete_graph(spark, sf):
    from ..session import scratch_path
    from ..sources import store
    root = scratch_path(spark, "store")
    store.write_graph(spark, tpch_graph(spark, sf), root, "tpch")
    store.write_graph(spark, events_graph(spark, sf), root, "events")
    store.delete_graph(spark, root, "tpch")
    store.delete_graph(spark, root, "tpch")            # idempotent
    return store.stored_graph_sizes(spark, root)


@query("source_lineage", """
WITH r AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer),
t AS (SELECT 'g' || k AS graph, 'db.t' || k AS name, '/d/' || k || '.parquet' AS path, n % 3 = 0 AS in_nodes, n % 2 = 1 AS in_edges FROM r
      UNION ALL SELECT 'g' || k, 'u' || k, '', n % 3 <> 0, n % 2 = 0 FROM r)
SELECT graph, name, path, CASE WHEN in_nodes AND NOT in_edges THEN 'nodes' WHEN in_edges AND NOT in_nodes THEN 'edges' END AS role FROM t
UNION ALL SELECT 'old' || s_suppkey, 's' || s_suppkey, '/d/s' || s_suppkey, NULL FROM supplier
""")
def q_source_lineage(spark, sf):
    """A recipe per customer (a qualified and a plain table name, used by
    node or edge statements) and an old-style recipe per supplier."""
    from ..sources.lineage import source_lineage
    new = read(spark, sf, "customer").select(
        F.concat(F.lit("g"), "c_custkey").alias("graph"),
        F.expr("""concat('{"tables":{"db.t', c_custkey, '":"/d/', c_custkey, '.parquet","u', c_custkey, '":""},"nodes":[{"sql":"SELECT * FROM ',
                 CASE WHEN c_nationkey % 3 = 0 THEN 'db.t' ELSE 'u' END, c_custkey, '"}],"edges":[{"sql":"SELECT x FROM ',
                 CASE WHEN c_nationkey % 2 = 0 THEN 'u' ELSE 'db.t' END, c_custkey, ' WHERE true"}]}')""").alias("spec_json"),
        F.lit("").alias("statement"))
    old = read(spark, sf, "supplier").select(
        F.concat(F.lit("old"), "s_suppkey").alias("graph"), F.lit(None).cast("string").alias("spec_json"),
        F.concat(F.lit("CREATE\n-- source tables: s"), "s_suppkey", F.lit(" = /d/s"), "s_suppkey").alias("statement"))
    return source_lineage(new.unionByName(old))


# ------------------------------------------------------------------ 2.2 build

def _buyer_spec(spark, sf):
    c = read(spark, sf, "customer")
    return B.NodeSpec(c.select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("id"),
                               F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") + 1).alias("c_acctbal"),
                               F.upper(F.col("c_name")).alias("name")),
                      id="id", label="buyer", properties=["name", "c_acctbal"])


@query("build_nodes", with_graph("""
SELECT NODE,
       CASE WHEN LABEL = 'customer' THEN 'buyer' ELSE LABEL END AS LABEL,
       array_to_string(CASE WHEN LABEL = 'customer'
            THEN list_concat(['buyer'], list_sort(list_distinct(list_concat(['customer'], list_filter(labels, lambda x: x <> 'customer')))))
            ELSE labels END, '|') AS labels,
       CASE WHEN LABEL = 'customer' THEN upper(name) ELSE name END AS name,
       CASE WHEN LABEL = 'customer' THEN (CASE WHEN c_acctbal >= 0 THEN c_acctbal + 1 ELSE c_acctbal END) END AS c_acctbal,
       p_size
FROM nodes
"""))
def q_build_nodes(spark, sf):
    specs = node_specs(spark, sf) + [_buyer_spec(spark, sf)]
    n = B.build_nodes(spark, specs)
    return n.select("NODE", "LABEL", _j("labels").alias("labels"), "name", "c_acctbal", "p_size")


@query("build_edges", with_graph("""
SELECT ID, src, dst, type, l_quantity FROM edges
"""))
def q_build_edges(spark, sf):
    g = tpch_graph(spark, sf)
    return g.edges.select("ID", "src", "dst", "type", "l_quantity")


@query("build_counts", with_graph("""
SELECT 'node' AS kind, LABEL AS name, COUNT(*) AS n FROM nodes GROUP BY LABEL
UNION ALL SELECT 'edge', type, COUNT(*) FROM edges GROUP BY type
"""))
def q_build_counts(spark, sf):
    specs = node_specs(spark, sf) + [_buyer_spec(spark, sf)]
    return B.build_counts(spark, specs, edge_specs(spark, sf))


def _small_part_specs(spark, sf):
    ns = node_specs(spark, sf)
    p = read(spark, sf, "part").filter(F.col("p_size") <= 25)
    ns[2] = B.NodeSpec(p.select(F.concat(F.lit("p:"), F.col("p_partkey")).alias("id"), "p_size"),
                       id="id", label="part", properties=["p_size"])
    li = read(spark, sf, "lineitem")
    es = [B.EdgeSpec(li.select(F.concat(F.lit("li:"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("id"),
                               F.concat(F.lit("o:"), F.col("l_orderkey")).alias("s"),
                               F.concat(F.lit("p:"), F.col("l_partkey")).alias("d")),
                     id="id", source_key="s", target_key="d", type="CONTAINS"),
          B.EdgeSpec(read(spark, sf, "orders").select(
              F.concat(F.lit("pl:"), F.col("o_orderkey")).alias("id"),
              F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("c:"), F.col("o_custkey"))).alias("s"),
              F.concat(F.lit("o:"), F.col("o_orderkey")).alias("d")),
              id="id", source_key="s", target_key="d", type="PLACED")]
    return ns, es


@query("dropped_rows_report", """
WITH parts AS (SELECT 'p:' || p_partkey AS NODE FROM part WHERE p_size <= 25),
ids AS (SELECT 'c:' || c_custkey AS NODE FROM customer UNION ALL SELECT 's:' || s_suppkey FROM supplier
        UNION ALL SELECT NODE FROM parts UNION ALL SELECT 'o:' || o_orderkey FROM orders
        UNION ALL SELECT 'n:' || n_nationkey FROM nation UNION ALL SELECT 'r:' || r_regionkey FROM region),
e AS (SELECT 'li:' || l_orderkey || '-' || l_linenumber AS ID, 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, 'CONTAINS' AS type FROM lineitem
      UNION ALL SELECT 'pl:' || o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'c:' || o_custkey END, 'o:' || o_orderkey, 'PLACED' FROM orders),
good AS (SELECT * FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND ID IS NOT NULL),
kept AS (SELECT * FROM good WHERE src IN (SELECT NODE FROM ids) AND dst IN (SELECT NODE FROM ids))
SELECT 'node' AS kind, 'null_id' AS reason, 0::BIGINT AS n
UNION ALL SELECT 'node', 'duplicate', (SELECT COUNT(*) - COUNT(DISTINCT NODE) FROM ids)
UNION ALL SELECT 'edge', 'null_id_or_endpoint', (SELECT COUNT(*) FROM e) - (SELECT COUNT(*) FROM good)
UNION ALL SELECT 'edge', 'missing_endpoint', (SELECT COUNT(*) FROM good) - (SELECT COUNT(*) FROM kept)
UNION ALL SELECT 'edge', 'duplicate', (SELECT COUNT(*) - COUNT(DISTINCT (src, dst, type, ID)) FROM kept)
""")
def q_dropped_rows_report(spark, sf):
    ns, es = _small_part_specs(spark, sf)
    return B.dropped_rows_report(spark, ns, es)


@query("check_identifiers", """
SELECT 'node_label' AS kind, p_name AS value, COUNT(*) AS n FROM part
WHERE p_name IS NULL OR NOT regexp_matches(p_name, '^[A-Za-z0-9_]+$') GROUP BY p_name
""")
def q_check_identifiers(spark, sf):
    p = read(spark, sf, "part")
    spec = B.NodeSpec(p.select(F.concat(F.lit("p:"), F.col("p_partkey")).alias("id"), "p_name"),
                      id="id", label_column="p_name")
    return B.check_identifiers(spark, [spec], [])


@query("create_graph_sql", """
SELECT 'node' AS kind, 'c:' || c_custkey AS id, 'customer' AS label, c_name AS entity_name FROM customer
UNION ALL SELECT 'node', 'n:' || n_nationkey, 'nation', n_name FROM nation
UNION ALL SELECT 'edge', 'c:' || c_custkey || '->n:' || c_nationkey || '|LOCATED_IN', 'LOCATED_IN', NULL FROM customer
""")
def q_create_graph_sql(spark, sf):
    read(spark, sf, "customer").createOrReplaceTempView("gl_customer")
    read(spark, sf, "nation").createOrReplaceTempView("gl_nation")
    g = B.create_graph_sql(
        spark,
        nodes_sql=["SELECT concat('c:', c_custkey) AS NODE, 'customer' AS LABEL, c_name AS name, c_acctbal FROM gl_customer",
                   "SELECT concat('n:', n_nationkey) AS NODE, 'nation' AS LABEL, n_name AS name FROM gl_nation"],
        edges_sql=["SELECT concat('c:', c_custkey) AS NODE1, concat('n:', c_nationkey) AS NODE2, "
                   "'LOCATED_IN' AS LABEL FROM gl_customer"])
    n = g.nodes.select(F.lit("node").alias("kind"), F.col("NODE").alias("id"), F.col("LABEL").alias("label"),
                       "entity_name")
    e = g.edges.select(F.lit("edge").alias("kind"), F.col("ID").alias("id"), F.col("type").alias("label"),
                       F.lit(None).cast("string").alias("entity_name"))
    return n.unionByName(e)


@query("creation_ledger", """
SELECT event_type AS graph, 'u' || user_id AS engine,
       arg_max(event_id, (ts, event_id)) AS statement,
       CAST(json_extract(arg_max(props, (ts, event_id)), '$.k') AS BIGINT) AS k
FROM events GROUP BY event_type, user_id
""")
def q_creation_ledger(spark, sf):
    ev = read(spark, sf, "events")
    recipes = ev.select(F.col("event_type").alias("graph"),
                        F.concat(F.lit("u"), F.col("user_id")).alias("engine"),
                        F.col("event_id").alias("statement"), F.lit("events").alias("source"),
                        "ts", F.col("props").alias("spec_json"))
    out = B.creation_ledger_latest(recipes)
    return out.select("graph", "engine", "statement",
                      F.expr("variant_get(spec, '$.k', 'bigint')").alias("k"))


# ------------------------------------------------------------------ 2.4 matching

@query("match_nodes", with_graph("""
SELECT NODE, name, c_acctbal FROM nodes WHERE list_contains(labels, 'customer')
"""))
def q_match_nodes(spark, sf):
    g = tpch_graph(spark, sf)
    return M.match_nodes(g, "customer", props=["name", "c_acctbal"]).drop("LABEL")


@query("match_path", with_graph("""
SELECT s.NODE AS s_node, p.NODE AS p_node, o.NODE AS o_node, c.NODE AS c_node
FROM nodes s
JOIN edges e1 ON e1.dst = s.NODE AND e1.type = 'SUPPLIED_BY'
JOIN nodes p ON p.NODE = e1.src
JOIN edges e2 ON e2.dst = p.NODE AND e2.type = 'CONTAINS'
JOIN nodes o ON o.NODE = e2.src
JOIN edges e3 ON e3.dst = o.NODE AND e3.type = 'PLACED'
JOIN nodes c ON c.NODE = e3.src
WHERE list_contains(s.labels, 'supplier') AND list_contains(p.labels, 'part') AND p.p_size = 10
  AND list_contains(o.labels, 'orders') AND o.o_totalprice > 300000 AND list_contains(c.labels, 'customer')
"""))
def q_match_path(spark, sf):
    g = tpch_graph(spark, sf)
    m = M.match(g, [N("s", "supplier"), E(type="SUPPLIED_BY", direction="<-"),
                    N("p", "part", F.col("p_size") == 10), E(type="CONTAINS", direction="<-"),
                    N("o", "orders", F.col("o_totalprice") > 300000), E(type="PLACED", direction="<-"),
                    N("c", "customer")], start="p")
    return m.select(F.col("s.NODE").alias("s_node"), F.col("p.NODE").alias("p_node"),
                    F.col("o.NODE").alias("o_node"), F.col("c.NODE").alias("c_node"))


@query("match_undirected", with_graph("""
SELECT e.dst AS b_node, e.type AS type, e.ID AS r_id FROM edges e WHERE e.src = 'n:3'
UNION ALL SELECT e.src, e.type, e.ID FROM edges e WHERE e.dst = 'n:3' AND e.src <> e.dst
"""))
def q_match_undirected(spark, sf):
    g = tpch_graph(spark, sf)
    m = M.match(g, [N("a", where=F.col("NODE") == "n:3"), E("r", direction="-"), N("b")])
    return m.select(F.col("b.NODE").alias("b_node"), F.col("r.type").alias("type"), F.col("r.ID").alias("r_id"))


@query("match_where", with_graph("""
SELECT c.NODE AS c_node, o.NODE AS o_node, o.o_totalprice AS o_totalprice
FROM nodes c JOIN edges e ON e.src = c.NODE AND e.type = 'PLACED' JOIN nodes o ON o.NODE = e.dst
WHERE list_contains(c.labels, 'customer') AND c.c_acctbal > 5000 AND list_contains(o.labels, 'orders')
  AND o.o_orderstatus = 'F' AND o.o_totalprice > c.c_acctbal * 20
"""))
def q_match_where(spark, sf):
    g = tpch_graph(spark, sf)
    m = M.match(g, [N("c", "customer", F.col("c_acctbal") > 5000, props=["c_acctbal"]), E(type="PLACED"),
                    N("o", "orders", F.col("o_orderstatus") == "F", props=["o_totalprice"])],
                where=F.col("o.o_totalprice") > F.col("c.c_acctbal") * 20)
    return m.select(F.col("c.NODE").alias("c_node"), F.col("o.NODE").alias("o_node"),
                    F.col("o.o_totalprice").alias("o_totalprice"))


@query("match_name_loose", with_graph("""
SELECT NODE, name FROM nodes WHERE list_contains(labels, 'nation')
  AND contains(lower(coalesce(name, NODE)), lower('Nation_1'))
"""))
def q_match_name_loose(spark, sf):
    root, graph = tpch_graph(spark, sf).meta["store"]
    if not fs.exists(spark, store.table_path(root, graph, store.NAMES)):
        NI.write_names(spark, root, graph)
    return NI.find_names(spark, root, graph, "Nation_1", "nation", ["name"]).drop("LABEL")


@query("match_not_exists", with_graph("""
SELECT NODE FROM nodes c WHERE list_contains(labels, 'customer')
AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes o ON o.NODE = e.dst
                WHERE e.src = c.NODE AND e.type = 'PLACED' AND list_contains(o.labels, 'orders'))
"""))
def q_match_not_exists(spark, sf):
    g = tpch_graph(spark, sf)
    out = M.not_exists(g, N("c", "customer"), [E(type="PLACED"), N("o", "orders")])
    return out.select(F.col("c.NODE").alias("NODE"))


@query("match_scalar_negation", with_graph("""
SELECT c.NODE AS c_node, n.NODE AS n_node FROM nodes c
JOIN edges e ON e.src = c.NODE AND e.type = 'LOCATED_IN' JOIN nodes n ON n.NODE = e.dst
WHERE list_contains(c.labels, 'customer') AND n.NODE <> 'n:3'
"""))
def q_match_scalar_negation(spark, sf):
    g = tpch_graph(spark, sf)
    m = M.match(g, [N("c", "customer"), E(type="LOCATED_IN"), N("n")], where=F.col("n.NODE") != "n:3")
    return m.select(F.col("c.NODE").alias("c_node"), F.col("n.NODE").alias("n_node"))


NATION_ORDERS_SQL = """
SELECT n.name AS nation, o.NODE AS o_node, o.o_totalprice AS o_totalprice, c.NODE AS c_node
FROM nodes n JOIN edges e1 ON e1.dst = n.NODE AND e1.type = 'LOCATED_IN'
JOIN nodes c ON c.NODE = e1.src JOIN edges e2 ON e2.src = c.NODE AND e2.type = 'PLACED'
JOIN nodes o ON o.NODE = e2.dst
WHERE list_contains(n.labels, 'nation') AND list_contains(c.labels, 'customer') AND list_contains(o.labels, 'orders')
"""


def _nation_orders(g):
    return M.match(g, [N("n", "nation", props=["name"]), E(type="LOCATED_IN", direction="<-"),
                       N("c", "customer"), E(type="PLACED"), N("o", "orders", props=["o_totalprice"])])


@query("match_aggregate", with_graph(f"""
SELECT nation, COUNT(o_node) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total
FROM ({NATION_ORDERS_SQL}) GROUP BY nation
"""))
def q_match_aggregate(spark, sf):
    g = tpch_graph(spark, sf)
    c = count_paths(g, [N("n", "nation"), E(type="LOCATED_IN", direction="<-"), N("c", "customer"), E(type="PLACED"), N("o", "orders")],
                    at="n", values={"total": ("o", "o_totalprice")}, props=["name"])
    return c.groupBy(F.col("name").alias("nation")).agg(F.sum("n").alias("n_orders"), F.round(F.sum("total"), 2).alias("total"))


@query("graph_table", with_graph(f"""
SELECT nation, COUNT(DISTINCT c_node) AS customers, COUNT(*) AS orders
FROM ({NATION_ORDERS_SQL}) WHERE o_totalprice > 100000 GROUP BY nation HAVING COUNT(*) > 10
"""))
def q_graph_table(spark, sf):
    g = tpch_graph(spark, sf)
    M.graph_table(_nation_orders(g), {"nation": "n.name", "c_node": "c.NODE", "o_node": "o.NODE",
                                      "o_totalprice": "o.o_totalprice"}, "gt_nation_orders")
    return spark.sql("SELECT nation, COUNT(DISTINCT c_node) AS customers, COUNT(*) AS orders "
                     "FROM gt_nation_orders WHERE o_totalprice > 100000 GROUP BY nation HAVING COUNT(*) > 10")


@query("match_topk", with_graph("""
SELECT c.NODE AS c_node, ROUND(SUM(o.o_totalprice), 2) AS total
FROM nodes c JOIN edges e ON e.src = c.NODE AND e.type = 'PLACED' JOIN nodes o ON o.NODE = e.dst
WHERE list_contains(c.labels, 'customer') AND list_contains(o.labels, 'orders')
GROUP BY c.NODE ORDER BY total DESC, c_node ASC LIMIT 25
"""))
def q_match_topk(spark, sf):
    g = tpch_graph(spark, sf)
    m = M.match(g, [N("c", "customer"), E(type="PLACED"), N("o", "orders", props=["o_totalprice"])])
    agg = m.groupBy(F.col("c.NODE").alias("c_node")).agg(F.round(F.sum("o.o_totalprice"), 2).alias("total"))
    return M.top_k(agg, 25, [F.col("total").desc(), F.col("c_node").asc()])


@query("match_distinct", with_graph("""
SELECT DISTINCT p.labels[2] AS brand, n.name AS nation
FROM nodes p JOIN edges e1 ON e1.src = p.NODE AND e1.type = 'SUPPLIED_BY' JOIN nodes s ON s.NODE = e1.dst
JOIN edges e2 ON e2.src = s.NODE AND e2.type = 'LOCATED_IN' JOIN nodes n ON n.NODE = e2.dst
WHERE list_contains(p.labels, 'part') AND list_contains(s.labels, 'supplier') AND list_contains(n.labels, 'nation')
"""))
def q_match_distinct(spark, sf):
    g = tpch_graph(spark, sf)
    m = M.match(g, [N("p", "part", props=["labels"]), E(type="SUPPLIED_BY"), N("s", "supplier"),
                    E(type="LOCATED_IN"), N("n", "nation", props=["name"])])
    return m.select(F.try_element_at("p.labels", F.lit(2)).alias("brand"), F.col("n.name").alias("nation")).distinct()


@query("match_optional_attr", with_graph("""
SELECT NODE, p_size FROM nodes WHERE p_size > 45
"""))
def q_match_optional_attr(spark, sf):
    g = tpch_graph(spark, sf)
    return M.match_nodes(g, where=F.col("p_size") > 45, props=["p_size"]).drop("LABEL")


PATHS_SQL = """
SELECT c.NODE AS c_node, o.NODE AS o_node, p.NODE AS p_node, e1.ID AS e1_id, e2.ID AS e2_id,
       c.LABEL AS c_label, o.LABEL AS o_label, p.LABEL AS p_label, e1.src AS e1_src, e1.dst AS e1_dst,
       e2.src AS e2_src, e2.dst AS e2_dst, c.labels AS c_labels, o.labels AS o_labels, p.labels AS p_labels
FROM nodes c JOIN edges e1 ON e1.src = c.NODE AND e1.type = 'PLACED' JOIN nodes o ON o.NODE = e1.dst
JOIN edges e2 ON e2.src = o.NODE AND e2.type = 'CONTAINS' JOIN nodes p ON p.NODE = e2.dst
WHERE list_contains(c.labels, 'customer') AND list_contains(o.labels, 'orders') AND list_contains(p.labels, 'part')
"""


def _paths(g):
    return M.match(g, [N("c", "customer", props=["labels"]), E("e1", "PLACED"),
                       N("o", "orders", props=["labels"]), E("e2", "CONTAINS"),
                       N("p", "part", props=["labels"])])


@query("match_path_value", with_graph(f"""
SELECT c_node, c_node || ',' || o_node || ',' || p_node AS path_nodes, e1_id || ',' || e2_id AS path_edges
FROM ({PATHS_SQL})
"""))
def q_match_path_value(spark, sf):
    g = tpch_graph(spark, sf)
    m = _paths(g).select(F.col("c.NODE").alias("c_node"),
                         M.path_value(["c", "o", "p"], ["e1", "e2"]).alias("p"))
    return m.select("c_node", F.array_join("p.nodes.NODE", ",").alias("path_nodes"),
                    F.array_join("p.edges.ID", ",").alias("path_edges"))


SUBGRAPH_SQL = f"""
SELECT DISTINCT 'node' AS kind, id, label, NULL AS src, NULL AS dst FROM (
  SELECT c_node AS id, c_label AS label FROM ({PATHS_SQL}) UNION ALL
  SELECT o_node, o_label FROM ({PATHS_SQL}) UNION ALL SELECT p_node, p_label FROM ({PATHS_SQL}))
UNION ALL
SELECT DISTINCT 'edge', id, type, src, dst FROM (
  SELECT e1_id AS id, 'PLACED' AS type, e1_src AS src, e1_dst AS dst FROM ({PATHS_SQL}) UNION ALL
  SELECT e2_id, 'CONTAINS', e2_src, e2_dst FROM ({PATHS_SQL}))
"""


@query("result_subgraph", with_graph(SUBGRAPH_SQL))
def q_result_subgraph(spark, sf):
    g = tpch_graph(spark, sf)
    res = _paths(g).select(F.col("c.NODE").alias("c_node"), M.path_value(["c", "o", "p"], ["e1", "e2"]).alias("p"))
    nodes, edges = M.result_subgraph(res)
    return (nodes.select(F.lit("node").alias("kind"), "id", "label", F.lit(None).cast("string").alias("src"),
                         F.lit(None).cast("string").alias("dst"))
            .unionByName(edges.select(F.lit("edge").alias("kind"), "id", F.col("type").alias("label"), "src", "dst")))


@query("hops_to_graph", with_graph(f"""
SELECT DISTINCT 'node' AS kind, id, label, NULL AS src, NULL AS dst FROM (
  SELECT c_node AS id, c_labels[1] AS label FROM ({PATHS_SQL}) UNION ALL
  SELECT o_node, o_labels[1] FROM ({PATHS_SQL}) UNION ALL SELECT p_node, p_labels[1] FROM ({PATHS_SQL}))
UNION ALL
SELECT DISTINCT 'edge', src || '->' || dst || '|' || type, type, src, dst FROM (
  SELECT 'PLACED' AS type, e1_src AS src, e1_dst AS dst FROM ({PATHS_SQL}) UNION ALL
  SELECT 'CONTAINS', e2_src, e2_dst FROM ({PATHS_SQL}))
"""))
def q_hops_to_graph(spark, sf):
    g = tpch_graph(spark, sf)
    m = _paths(g)
    hops = m.select(F.col("c.NODE").alias("NODE1_HOP_1"), F.col("o.NODE").alias("NODE2_HOP_1"),
                    F.to_json("c.labels").alias("NODE1_LABELS_HOP_1"), F.to_json("o.labels").alias("NODE2_LABELS_HOP_1"),
                    F.to_json(F.array(F.col("e1.type"))).alias("EDGE_LABELS_HOP_1"),
                    F.col("o.NODE").alias("NODE1_HOP_2"), F.col("p.NODE").alias("NODE2_HOP_2"),
                    F.to_json("o.labels").alias("NODE1_LABELS_HOP_2"), F.to_json("p.labels").alias("NODE2_LABELS_HOP_2"),
                    F.col("e2.type").alias("EDGE_LABELS_HOP_2"))
    nodes, edges = M.hops_to_graph(hops, 2)
    return (nodes.select(F.lit("node").alias("kind"), "id", "label", F.lit(None).cast("string").alias("src"),
                         F.lit(None).cast("string").alias("dst"))
            .unionByName(edges.select(F.lit("edge").alias("kind"), "id", F.col("type").alias("label"), "src", "dst")))


@query("node_attrs", with_graph("""
SELECT NODE, name, c_acctbal FROM nodes WHERE NODE IN (
  SELECT e.src FROM edges e WHERE e.type = 'LOCATED_IN' AND e.dst = 'n:3')
"""))
def q_node_attrs(spark, sf):
    g = tpch_graph(spark, sf)
    m = M.match(g, [N("c"), E(type="LOCATED_IN"), N("n", where=F.col("NODE") == "n:3")])
    ids = m.select(F.col("c.NODE").alias("NODE"))
    return M.node_attrs(g, ids).select("NODE", "name", "c_acctbal")


@query("get_record", with_graph("""
SELECT NODE, LABEL, array_to_string(labels, '|') AS labels, name, p_size, p_retailprice
FROM nodes WHERE list_contains(labels, 'part') AND p_size = 10
"""))
def q_get_record(spark, sf):
    g = tpch_graph(spark, sf)
    ids = M.match_nodes(g, "part", where=F.col("p_size") == 10)
    r = M.get_records(g, ids)
    return r.select("NODE", "LABEL", _j("labels").alias("labels"), "name", "p_size", "p_retailprice")


# ------------------------------------------------------------------ 2.6 summaries

@query("schema_labels", with_graph("""
SELECT DISTINCT unnest(labels) AS label FROM nodes
"""))
def q_schema_labels(spark, sf):
    return O.schema_labels(tpch_graph(spark, sf).nodes)


@query("normalize_labels", with_graph("""
WITH forms AS (
  SELECT NODE, 'plain' AS form, LABEL AS v FROM nodes
  UNION ALL SELECT NODE, 'json', to_json(labels)::VARCHAR FROM nodes
  UNION ALL SELECT NODE, 'empty', '' FROM nodes
  UNION ALL SELECT NODE, 'null', NULL FROM nodes
  UNION ALL SELECT NODE, 'badjson', '[' || LABEL FROM nodes)
SELECT NODE, form, array_to_string(CASE
  WHEN v IS NULL OR v = '' THEN []
  WHEN starts_with(ltrim(v), '[') THEN (CASE WHEN json_valid(v) THEN from_json(v, '["VARCHAR"]') ELSE [v] END)
  ELSE [v] END, '|') AS labels
FROM forms
"""))
def q_normalize_labels(spark, sf):
    n = tpch_graph(spark, sf).nodes
    forms = (n.select("NODE", F.lit("plain").alias("form"), F.col("LABEL").alias("v"))
             .unionByName(n.select("NODE", F.lit("json").alias("form"), F.to_json("labels").alias("v")))
             .unionByName(n.select("NODE", F.lit("empty").alias("form"), F.lit("").alias("v")))
             .unionByName(n.select("NODE", F.lit("null").alias("form"), F.lit(None).cast("string").alias("v")))
             .unionByName(n.select("NODE", F.lit("badjson").alias("form"),
                                   F.concat(F.lit("["), F.col("LABEL")).alias("v"))))
    return forms.select("NODE", "form", _j(normalize_labels("v")).alias("labels"))


@query("label_counts", with_graph("""
SELECT labels[1] AS label, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM nodes), 2) AS pct
FROM nodes WHERE len(labels) > 0 GROUP BY labels[1]
"""))
def q_label_counts(spark, sf):
    return O.label_counts(tpch_graph(spark, sf).nodes)


@query("rel_counts", with_graph("""
SELECT type, COUNT(*) AS n, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM edges), 2) AS pct
FROM edges GROUP BY type
"""))
def q_rel_counts(spark, sf):
    return O.rel_counts(tpch_graph(spark, sf).edges)


@query("schema_triples", with_graph("""
SELECT DISTINCT s.labels[1] AS src_label, e.type AS type, d.labels[1] AS dst_label
FROM edges e JOIN nodes s ON s.NODE = e.src JOIN nodes d ON d.NODE = e.dst
WHERE len(s.labels) > 0 AND len(d.labels) > 0
"""))
def q_schema_triples(spark, sf):
    g = tpch_graph(spark, sf)
    return O.schema_triples(g)


@query("label_properties", with_graph("""
WITH kv AS (
  SELECT labels[1] AS label, 'name' AS k FROM nodes WHERE name IS NOT NULL
  UNION ALL SELECT labels[1], 'c_acctbal' FROM nodes WHERE c_acctbal IS NOT NULL
  UNION ALL SELECT labels[1], 's_acctbal' FROM nodes WHERE s_acctbal IS NOT NULL
  UNION ALL SELECT labels[1], 'p_size' FROM nodes WHERE p_size IS NOT NULL
  UNION ALL SELECT labels[1], 'p_retailprice' FROM nodes WHERE p_retailprice IS NOT NULL
  UNION ALL SELECT labels[1], 'o_totalprice' FROM nodes WHERE o_totalprice IS NOT NULL
  UNION ALL SELECT labels[1], 'o_orderstatus' FROM nodes WHERE o_orderstatus IS NOT NULL
  UNION ALL SELECT labels[1], 'o_orderdate' FROM nodes WHERE o_orderdate IS NOT NULL)
SELECT label, array_to_string(list_sort(list_distinct(list(k))), ',') AS keys FROM kv GROUP BY label
"""))
def q_label_properties(spark, sf):
    out = O.label_properties(tpch_graph(spark, sf))
    return out.select("label", F.array_join("keys", ",").alias("keys"))


@query("graph_counts", with_graph("""
SELECT (SELECT COUNT(*) FROM nodes) AS nodes, (SELECT COUNT(*) FROM edges) AS edges
"""))
def q_graph_counts(spark, sf):
    return O.graph_counts(tpch_graph(spark, sf))


ONTO_SQL = """
onto AS (
  SELECT DISTINCT 'entity' AS type_kind, x AS type_name, 'EntityType' AS axis
  FROM (SELECT unnest(['customer','supplier','part','orders','nation','region']) AS x)
  UNION SELECT 'entity', c_mktsegment, 'Segment' FROM customer WHERE c_mktsegment IS NOT NULL
  UNION SELECT 'entity', p_brand, 'Brand' FROM part WHERE p_brand IS NOT NULL)
"""


@query("schema_axes", with_graph("WITH " + ONTO_SQL + """
SELECT coalesce(o.axis, 'EntityType') AS axis, array_to_string(list_sort(list_distinct(list(l.label))), '|') AS labels
FROM (SELECT DISTINCT unnest(labels) AS label FROM nodes) l
LEFT JOIN onto o ON o.type_kind = 'entity' AND o.type_name = l.label
GROUP BY coalesce(o.axis, 'EntityType')
"""))
def q_schema_axes(spark, sf):
    out = O.schema_axes(tpch_graph(spark, sf).nodes, tpch_ontology(spark, sf))
    return out.select("axis", _j("labels").alias("labels"))


@query("rel_axes", with_graph("""
SELECT CASE WHEN type IN ('PLACED', 'CONTAINS') THEN 'COMMERCE' ELSE 'RelationType' END AS axis,
       array_to_string(list_sort(list_distinct(list(type))), '|') AS types
FROM edges GROUP BY 1
"""))
def q_rel_axes(spark, sf):
    onto = spark.createDataFrame([("relation", "PLACED", "PLACED", "COMMERCE"),
                                  ("relation", "CONTAINS", "CONTAINS", "COMMERCE")],
                                 "type_kind string, type_name string, canonical_name string, axis string")
    out = O.rel_axes(tpch_graph(spark, sf).edges, onto)
    return out.select("axis", _j("types").alias("types"))


@query("label_distribution", with_graph("""
SELECT 'node' AS kind, array_to_string(labels, '|') AS labels, COUNT(*) AS n FROM nodes GROUP BY labels
UNION ALL SELECT 'edge', type, COUNT(*) FROM edges GROUP BY type
UNION ALL SELECT 'node_total', CASE WHEN len(labels) > 0 THEN 'labeled' ELSE 'unlabeled' END, COUNT(*) FROM nodes GROUP BY 2
UNION ALL SELECT 'edge_total', 'labeled', COUNT(*) FROM edges
"""))
def q_label_distribution(spark, sf):
    g = tpch_graph(spark, sf)
    out = O.label_distribution(g)
    return out.select("kind", _j("labels").alias("labels"), "n")


@query("schema_by_axis", with_graph("WITH " + ONTO_SQL + """,
lab AS (SELECT NODE, labels[1] AS l0, labels[len(labels)] AS lz FROM nodes WHERE len(labels) > 0),
ax AS (SELECT lab.NODE, lab.l0, coalesce(o.axis, 'EntityType') AS axis FROM lab
       LEFT JOIN onto o ON o.type_name = lab.lz)
SELECT DISTINCT 'full' AS mode, s.l0 AS src, e.type AS type, d.l0 AS dst
FROM edges e JOIN ax s ON s.NODE = e.src JOIN ax d ON d.NODE = e.dst
UNION ALL SELECT DISTINCT 'nkey', s.axis, e.type, d.axis
FROM edges e JOIN ax s ON s.NODE = e.src JOIN ax d ON d.NODE = e.dst
UNION ALL SELECT DISTINCT 'ekey', s.l0, 'RelationType', d.l0
FROM edges e JOIN ax s ON s.NODE = e.src JOIN ax d ON d.NODE = e.dst
"""))
def q_schema_by_axis(spark, sf):
    g = tpch_graph(spark, sf)
    return O.schema_by_axis(g, tpch_ontology(spark, sf))


# ------------------------------------------------------------------ 2.7 hydrate

def _wide_customers(spark, sf):
    """Wide customer source keyed by NODE, with duplicate keys (ver 2 of
    customers with negative balance: last wins) and unmatched keys."""
    c = read(spark, sf, "customer")
    base = c.select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("NODE"), "c_mktsegment", "c_acctbal",
                    F.lit(1).alias("ver"))
    dup = c.filter(F.col("c_acctbal") < 0).select(
        F.concat(F.lit("c:"), F.col("c_custkey")).alias("NODE"), F.lit("DEBTOR").alias("c_mktsegment"),
        F.lit(None).cast("double").alias("c_acctbal"), F.lit(2).alias("ver"))
    extra = c.select(F.concat(F.lit("c:x"), F.col("c_custkey")).alias("NODE"), "c_mktsegment", "c_acctbal",
                     F.lit(1).alias("ver"))
    return base.unionByName(dup).unionByName(extra)


WIDE_SQL = """
wide AS (
  SELECT NODE, c_mktsegment, c_acctbal, ver FROM (
    SELECT *, row_number() OVER (PARTITION BY NODE ORDER BY ver DESC) AS rn FROM (
      SELECT 'c:' || c_custkey AS NODE, c_mktsegment, c_acctbal, 1 AS ver FROM customer
      UNION ALL SELECT 'c:' || c_custkey, 'DEBTOR', NULL, 2 FROM customer WHERE c_acctbal < 0)) WHERE rn = 1
  UNION ALL SELECT 'c:x' || c_custkey, c_mktsegment, c_acctbal, 1 FROM customer)
"""

LOCATED_SQL = """
located AS (
  SELECT c.NODE AS NODE, n.NODE AS n_node, n.name AS c_mktsegment
  FROM nodes c JOIN edges e ON e.src = c.NODE AND e.type = 'LOCATED_IN' JOIN nodes n ON n.NODE = e.dst
  WHERE list_contains(c.labels, 'customer'))
"""


def _located(g):
    m = M.match(g, [N("c", "customer"), E(type="LOCATED_IN"), N("n", props=["name"])])
    # ``c_mktsegment`` here is a stand-in column the wide source overwrites.
    return m.select(F.col("c.NODE").alias("NODE"), F.col("n.NODE").alias("n_node"),
                    F.col("n.name").alias("c_mktsegment"))


@query("hydrate", with_graph("WITH " + WIDE_SQL + "," + LOCATED_SQL + """
SELECT l.NODE, l.n_node, CASE WHEN w.NODE IS NOT NULL THEN w.c_mktsegment ELSE l.c_mktsegment END AS c_mktsegment,
       w.c_acctbal, w.ver
FROM located l LEFT JOIN wide w ON w.NODE = l.NODE
"""))
def q_hydrate(spark, sf):
    g = tpch_graph(spark, sf)
    return H.hydrate(_located(g), _wide_customers(spark, sf), key="NODE", order_by=["ver"])


PLACED_PATHS_SQL = """
paths AS (
  SELECT c.NODE AS NODE, o.NODE AS o_node FROM nodes c JOIN edges e1 ON e1.src = c.NODE AND e1.type = 'PLACED'
  JOIN nodes o ON o.NODE = e1.dst JOIN edges e2 ON e2.src = o.NODE AND e2.type = 'CONTAINS'
  JOIN nodes p ON p.NODE = e2.dst
  WHERE list_contains(c.labels, 'customer') AND list_contains(o.labels, 'orders') AND list_contains(p.labels, 'part'))
"""


def _placed_paths(g):
    m = M.match(g, [N("c", "customer"), E(type="PLACED"), N("o", "orders"), E(type="CONTAINS"), N("p", "part")])
    return m.select(F.col("c.NODE").alias("NODE"), F.col("o.NODE").alias("o_node"))


POST_JOIN_SQL = ("SELECT w.c_mktsegment AS segment, COUNT(*) AS n FROM cypher c "
                 "JOIN wide w ON c.NODE = w.NODE GROUP BY w.c_mktsegment")


@query("post_join", with_graph("WITH " + PLACED_PATHS_SQL + ", wide AS (SELECT 'c:' || c_custkey AS NODE, c_mktsegment FROM customer)\n"
                               + POST_JOIN_SQL.replace("cypher c", "paths c")))
def q_post_join(spark, sf):
    g = tpch_graph(spark, sf)
    wide = read(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("NODE"), "c_mktsegment")
    return H.post_join(_placed_paths(g), wide, POST_JOIN_SQL)


@query("post_join_rows", with_graph("WITH " + LOCATED_SQL + """
SELECT n.name AS nation, COUNT(*) AS customers FROM located l JOIN nodes n ON n.NODE = l.n_node GROUP BY n.name
"""))
def q_post_join_rows(spark, sf):
    g = tpch_graph(spark, sf)
    res = _located(g).select("NODE", "n_node")
    return H.post_join_rows(g, res, "SELECT w.name AS nation, COUNT(*) AS customers FROM cypher c "
                                    "JOIN wide w ON w.NODE = c.n_node GROUP BY w.name")


@query("match_then_post_join", with_graph("WITH " + PLACED_PATHS_SQL + """,
wide AS (SELECT 'c:' || c_custkey AS NODE, c_mktsegment, c_acctbal FROM customer)
SELECT w.c_mktsegment AS segment, COUNT(DISTINCT c.o_node) AS orders, ROUND(AVG(w.c_acctbal), 2) AS avg_bal
FROM paths c JOIN wide w ON c.NODE = w.NODE GROUP BY w.c_mktsegment
"""))
def q_match_then_post_join(spark, sf):
    g = tpch_graph(spark, sf)
    wide = read(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("NODE"),
                                              "c_mktsegment", "c_acctbal")
    return H.match_then_post_join(
        _placed_paths(g), wide,
        "SELECT w.c_mktsegment AS segment, COUNT(DISTINCT c.o_node) AS orders, ROUND(AVG(w.c_acctbal), 2) AS avg_bal "
        "FROM cypher c JOIN wide w ON c.NODE = w.NODE GROUP BY w.c_mktsegment", key="NODE")


RANK_SQL = with_graph("WITH " + PLACED_PATHS_SQL + """
SELECT w.c_mktsegment AS c_mktsegment, COUNT(*) AS n
FROM paths p LEFT JOIN (SELECT 'c:' || c_custkey AS NODE, c_mktsegment FROM customer) w ON w.NODE = p.NODE
GROUP BY w.c_mktsegment
""")


def rank_segments(spark, sf, g=None):
    """Flagship (G5): paths customer-PLACED->orders-CONTAINS->part counted
    per customer segment taken from the wide customer file, ranked."""
    g = g or tpch_graph(spark, sf)
    wide = read(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("NODE"),
                                              "c_mktsegment")
    c = count_paths(g, [N("c", "customer"), E(type="PLACED"), N("o", "orders"), E(type="CONTAINS"), N("p", "part")], at="c")
    return H.rank_by_path_count(c, wide, key="NODE", attr="c_mktsegment", weight="n")


@query("rank_by_path_count", RANK_SQL)
def q_rank_by_path_count(spark, sf):
    return rank_segments(spark, sf)


@query("post_join_cascade", with_graph("WITH " + PLACED_PATHS_SQL + """
SELECT w.c_mktsegment AS segment, COUNT(*) AS n, 'source' AS hydrate_from
FROM paths c JOIN (SELECT 'c:' || c_custkey AS NODE, c_mktsegment FROM customer) w ON c.NODE = w.NODE
GROUP BY w.c_mktsegment
"""))
def q_post_join_cascade(spark, sf):
    g = tpch_graph(spark, sf)
    res = _placed_paths(g)
    # The skinny graph has no c_mktsegment attribute: step 1 yields no rows
    # and the cascade falls through to the file.
    graph_wide = H.graph_attr_source(g, res, ["c_mktsegment"])
    file_wide = read(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("NODE"),
                                                   "c_mktsegment")
    return H.post_join_cascade(res, [("graph", graph_wide), ("source", file_wide)], POST_JOIN_SQL)


@query("candidate_ids", with_graph("WITH " + LOCATED_SQL + """
SELECT DISTINCT id FROM (SELECT NODE AS id FROM located UNION ALL SELECT n_node FROM located
                         UNION ALL SELECT c_mktsegment FROM located) WHERE id IS NOT NULL
"""))
def q_candidate_ids(spark, sf):
    return H.candidate_ids(_located(tpch_graph(spark, sf)))


@query("decimals_to_double", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM orders
""")
def q_decimals_to_double(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return decimals_to_double(o)


INFER_JSON_SPARK = """concat(
  '{"k":', get_json_object(props, '$.k'),
  ',"n":', CASE WHEN value > 50 THEN CAST(value AS STRING) ELSE get_json_object(props, '$.k') END,
  ',"flag":', CASE WHEN value > 10 THEN 'true' ELSE 'false' END,
  ',"mixed":', CASE WHEN value > 50 THEN '"x"' ELSE get_json_object(props, '$.k') END,
  ',"nothing":null}')"""


@query("infer_column_types", """
SELECT 'k' AS "column", 'BIGINT' AS type FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'n', CASE WHEN bool_or(value > 50) THEN 'DOUBLE' ELSE 'BIGINT' END FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'flag', 'BOOLEAN' FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'mixed', CASE WHEN bool_or(value > 50) THEN 'VARCHAR' ELSE 'BIGINT' END FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'nothing', 'VARCHAR' FROM events HAVING COUNT(*) > 0
""")
def q_infer_column_types(spark, sf):
    ev = read(spark, sf, "events").select(F.expr(INFER_JSON_SPARK).alias("j"))
    return H.infer_column_types(ev, "j")


@query("read_text_documents", """
SELECT doc_id // 100 AS part, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS sha256
FROM (SELECT doc_id // 100 * 100 AS doc_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)
""")
def q_read_text_documents(spark, sf):
    """A10: the documents are written as text files of a hundred each, then
    read back as whole files, decoded as UTF-8 and fingerprinted."""
    from ..session import scratch_path
    base = scratch_path(spark, "texts")
    d = read(spark, sf, "documents").select((F.floor(F.col("doc_id") / 100)).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    (d.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text")
     .write.partitionBy("part").option("compression", "none").text(base))
    docs = S.read_text_documents(spark, base)
    return docs.select(F.regexp_extract("doc_uri", r"part=(-?\d+)", 1).cast("long").alias("part"),
                       F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))
