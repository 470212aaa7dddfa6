"""Queries: incremental ingest (C1-C8) driven by the events table.

Batch 1 = users and event types of events with an even event_id, batch 2 =
the odd ones; batch 2 then comes again (it must create nothing). Every batch
is appended to the logs on shared storage and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.types import TYPE_BIGINT, TYPE_BOOLEAN, TYPE_DOUBLE
from ..operators import ingest as I
from ..session import cut_lineage, scratch_path
from .registry import query
from .tpch import read, tpch_graph, tpch_ontology, with_graph

NOW = ["2025-01-01 00:00:00", "2025-01-02 00:00:00", "2025-01-03 00:00:00"]


def _batches(spark, sf):
    ev = read(spark, sf, "events")
    seq = F.struct("ts", "event_id")
    users = ev.select(F.concat(F.lit("u:"), F.col("user_id")).alias("id"), F.lit("user").alias("label"),
                      F.create_map(F.lit("k"), F.get_json_object("props", "$.k"),
                                   F.lit("value"), F.col("value").cast("string")).alias("attrs"),
                      seq.alias("_seq"), (F.col("event_id") % 2).alias("_b"))
    types = ev.select(F.concat(F.lit("et:"), F.col("event_type")).alias("id"), F.lit("event_type").alias("label"),
                      F.create_map().cast("map<string,string>").alias("attrs"),
                      seq.alias("_seq"), (F.col("event_id") % 2).alias("_b"))
    nodes = users.unionByName(types)
    edges = ev.select(F.concat(F.lit("ev:"), F.col("event_id")).alias("id"),
                      F.concat(F.lit("u:"), F.col("user_id")).alias("src"),
                      F.concat(F.lit("et:"), F.col("event_type")).alias("dst"), F.lit("DID").alias("label"),
                      F.create_map(F.lit("value"), F.col("value").cast("string")).alias("attrs"),
                      seq.alias("_seq"), (F.col("event_id") % 2).alias("_b"))
    return nodes, edges


def run_ingest(spark, sf, with_reports=False):
    """Three ingest runs (batch 1, batch 2, batch 2 again) -> final states
    (and one report row per run)."""
    nodes, edges = _batches(spark, sf)
    root = scratch_path(spark, "ingest")
    nt, et = I.node_log(spark, root + "/nodes"), I.edge_log(spark, root + "/edges")
    reports = []
    for run, (b, now) in enumerate([(0, NOW[0]), (1, NOW[1]), (1, NOW[2])], start=1):
        bn = nodes.filter(F.col("_b") == b).drop("_b")
        be = edges.filter(F.col("_b") == b).drop("_b")
        sn, se, at = nt.rows().select("NODE"), et.rows().select(*I.EDGE_KEY), f"{run:04d}"
        nt.append(I.node_rows(bn, now, at, seq=F.col("_seq")), at)
        new_n = nt.rows().select("NODE").distinct()
        et.append(I.edge_rows(be, now, at, seq=F.col("_seq"), nodes=new_n), at)
        if with_reports:
            reports.append(cut_lineage(I.ingest_report(sn, se, bn, be, new_n).withColumn("run", F.lit(run))))
    return nt.current(), et.current(), reports


EV_SQL = """
ev AS (SELECT *, event_id % 2 AS b FROM events),
u AS (SELECT 'u:' || user_id AS NODE, 'user' AS labels, min(b) AS minb, max(b) AS maxb,
             CAST(coalesce(arg_max(CASE WHEN b = 1 THEN json_extract_string(props, '$.k') END, (ts, event_id)),
                           arg_max(json_extract_string(props, '$.k'), (ts, event_id))) AS VARCHAR) AS k
      FROM ev GROUP BY user_id),
t AS (SELECT 'et:' || event_type AS NODE, 'event_type' AS labels, min(b) AS minb, max(b) AS maxb, NULL AS k
      FROM ev GROUP BY event_type)
"""


@query("merge_nodes", "WITH " + EV_SQL + """
SELECT NODE, labels, CASE WHEN minb = 0 THEN '2025-01-01' ELSE '2025-01-02' END AS first_seen,
       CASE WHEN maxb = 1 THEN '2025-01-03' ELSE '2025-01-01' END AS last_seen, k
FROM (SELECT * FROM u UNION ALL SELECT * FROM t)
""")
def q_merge_nodes(spark, sf):
    n, _, _ = run_ingest(spark, sf)
    return n.select("NODE", F.array_join("labels", "|").alias("labels"),
                    F.date_format("first_seen_ts", "yyyy-MM-dd").alias("first_seen"),
                    F.date_format("last_seen_ts", "yyyy-MM-dd").alias("last_seen"),
                    F.col("attrs")["k"].alias("k"))


@query("merge_edges", """
SELECT 'ev:' || event_id AS ID, 'u:' || user_id AS src, 'et:' || event_type AS dst,
       CASE WHEN event_id % 2 = 0 THEN '2025-01-01' ELSE '2025-01-02' END AS first_seen,
       CASE WHEN event_id % 2 = 0 THEN '2025-01-01' ELSE '2025-01-03' END AS last_seen, value
FROM events
""")
def q_merge_edges(spark, sf):
    _, e, _ = run_ingest(spark, sf)
    return e.select("ID", "src", "dst", F.date_format("first_seen_ts", "yyyy-MM-dd").alias("first_seen"),
                    F.date_format("last_seen_ts", "yyyy-MM-dd").alias("last_seen"),
                    F.col("attrs")["value"].cast("double").alias("value"))


@query("ingest_report", """
WITH ev AS (SELECT *, event_id % 2 AS b FROM events),
n AS (SELECT DISTINCT 'u:' || user_id AS id, b FROM ev UNION SELECT DISTINCT 'et:' || event_type, b FROM ev),
r1 AS (SELECT 1 AS run, (SELECT COUNT(*) FROM n WHERE b = 0) AS nodes, (SELECT COUNT(*) FROM n WHERE b = 0) AS nodes_created,
              (SELECT COUNT(*) FROM ev WHERE b = 0) AS edges, (SELECT COUNT(*) FROM ev WHERE b = 0) AS edges_created),
r2 AS (SELECT 2, (SELECT COUNT(*) FROM n WHERE b = 1),
              (SELECT COUNT(*) FROM n x WHERE b = 1 AND NOT EXISTS (SELECT 1 FROM n y WHERE y.b = 0 AND y.id = x.id)),
              (SELECT COUNT(*) FROM ev WHERE b = 1), (SELECT COUNT(*) FROM ev WHERE b = 1)),
r3 AS (SELECT 3, (SELECT COUNT(*) FROM n WHERE b = 1), 0, (SELECT COUNT(*) FROM ev WHERE b = 1), 0)
SELECT run, nodes, nodes_created, edges, edges_created, 'event_type|user' AS labels
FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
""")
def q_ingest_report(spark, sf):
    _, _, reps = run_ingest(spark, sf, with_reports=True)
    out = reps[0]
    for r in reps[1:]:
        out = out.unionByName(r)
    return out.select("run", "nodes", "nodes_created", "edges", "edges_created",
                      F.array_join("labels", "|").alias("labels"))


def _attr_elements(spark, sf):
    ev = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    attrs = F.create_map(
        F.lit("k"), k, F.lit("value"), F.col("value").cast("string"),
        F.lit("big"), F.concat(F.lit('"'), k, F.lit('000000"')),
        F.lit("flag"), F.when(F.col("value") > 10, F.lit('"yes"')).otherwise(F.lit('"no"')),
        F.lit("mixed"), F.when(F.col("value") > 50, F.lit('"x"')).otherwise(k),
        F.lit("kf"), F.concat(F.lit('"'), k, F.lit('.5"')),
        F.lit("NODE"), F.lit('"shadow"'), F.lit("bad key"), F.lit("1"),
        F.lit("nul"), F.lit("null"))
    return ev.select(F.concat(F.lit("ev:"), F.col("event_id")).alias("NODE"), "ts", "event_id",
                     attrs.alias("attrs"))


@query("discover_attr_columns", """
SELECT 'k' AS "column", 'BIGINT' AS type FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'value', 'DOUBLE' FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'big', 'VARCHAR' FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'flag', 'VARCHAR' FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'kf', 'VARCHAR' FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'nul', 'VARCHAR' FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'mixed', CASE WHEN arg_min(value, (ts, event_id)) > 50 THEN 'VARCHAR' ELSE 'BIGINT' END
FROM events HAVING COUNT(*) > 0
""")
def q_discover_attr_columns(spark, sf):
    el = _attr_elements(spark, sf)
    return I.discover_attr_columns(el.select("attrs", "ts", "event_id"), seq=F.struct("ts", "event_id"))


@query("evolve_columns", """
SELECT 'k' AS "column", 'BIGINT' AS type FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'value', 'DOUBLE' FROM events HAVING COUNT(*) > 0
UNION ALL SELECT 'extra', 'VARCHAR' FROM events HAVING COUNT(*) > 0
""")
def q_evolve_columns(spark, sf):
    ev = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    b1 = ev.filter(F.col("event_id") % 2 == 0).select(
        "ts", "event_id", F.create_map(F.lit("k"), k, F.lit("value"), F.col("value").cast("string")).alias("attrs"))
    b2 = ev.filter(F.col("event_id") % 2 == 1).select(
        "ts", "event_id", F.create_map(F.lit("k"), F.concat(F.lit('"'), k, F.lit('"')),
                                       F.lit("extra"), F.lit('"e"')).alias("attrs"))
    seq = F.struct("ts", "event_id")
    declared = I.discover_attr_columns(b1, seq=seq)
    return I.evolve_columns(declared, I.discover_attr_columns(b2, seq=seq))


@query("coerce_attrs", """
SELECT 'ev:' || event_id AS NODE, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value,
       CAST(json_extract(props, '$.k') AS BIGINT) * 1000000 AS big, value > 10 AS flag,
       CASE WHEN value > 50 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS mixed,
       CAST(NULL AS BIGINT) AS kf, CAST(json_extract(props, '$.k') AS DOUBLE) + 0.5 AS kd
FROM events
""")
def q_coerce_attrs(spark, sf):
    el = _attr_elements(spark, sf)
    el = el.withColumn("attrs", F.map_concat("attrs", F.create_map(F.lit("kd"), el.attrs["kf"])))
    cols = {"k": TYPE_BIGINT, "value": TYPE_DOUBLE, "big": TYPE_BIGINT, "flag": TYPE_BOOLEAN,
            "mixed": TYPE_BIGINT, "kf": TYPE_BIGINT, "kd": TYPE_DOUBLE}
    return I.coerce_attrs(el, cols, key="NODE")


@query("materialize_label_keys", with_graph("""
WITH onto AS (
  SELECT DISTINCT 'entity' AS type_kind, x AS type_name, 'EntityType' AS axis
  FROM (SELECT unnest(['customer','supplier','part','orders','nation','region']) AS x)
  UNION SELECT 'entity', c_mktsegment, 'Segment' FROM customer WHERE c_mktsegment IS NOT NULL
  UNION SELECT 'entity', p_brand, 'Brand' FROM part WHERE p_brand IS NOT NULL)
SELECT coalesce(o.axis, 'EntityType') AS label_key, array_to_string(list_sort(list_distinct(list(l.label))), '|') AS label
FROM (SELECT DISTINCT unnest(labels) AS label FROM nodes) l
LEFT JOIN onto o ON o.type_name = l.label
GROUP BY coalesce(o.axis, 'EntityType')
"""))
def q_materialize_label_keys(spark, sf):
    out = I.materialize_label_keys(tpch_graph(spark, sf).nodes, tpch_ontology(spark, sf))
    return out.select("label_key", F.array_join("label", "|").alias("label"))


@query("promote_columns", """
SELECT 'nodes_matched' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM customer
UNION ALL SELECT 'properties_set', CAST(COUNT(*) + COUNT(CASE WHEN c_acctbal >= 0 THEN 1 END) AS DOUBLE) FROM customer
UNION ALL SELECT 'n_with_seg', CAST(COUNT(*) AS DOUBLE) FROM customer
UNION ALL SELECT 'sum_acctbal', ROUND(SUM(c_acctbal), 2) FROM customer
""")
def q_promote_columns(spark, sf):
    g = tpch_graph(spark, sf)
    c = read(spark, sf, "customer")
    wide = c.select(F.concat(F.lit("c:"), F.col("c_custkey")).alias("NODE"),
                    F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"),
                    F.col("c_mktsegment").alias("party:segment"))
    wide = wide.unionByName(c.select(F.concat(F.lit("c:x"), F.col("c_custkey")).alias("NODE"), "c_acctbal",
                                     F.col("c_mktsegment").alias("party:segment")))
    new_nodes, stats = I.promote_columns(g.nodes, wide, key="NODE", columns=["c_acctbal", "party:segment"])
    chk = new_nodes.agg(F.count("`party:segment`").alias("n_with_seg"),
                        F.round(F.sum("c_acctbal"), 2).alias("sum_acctbal"))
    long_ = lambda df: df.select(F.explode(F.create_map(
        *[x for c in df.columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
    return long_(stats).unionByName(long_(chk))
