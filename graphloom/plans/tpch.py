"""The property graph over the driver's TPC-H-ish tables.

Nodes: customer, supplier, part, orders, nation, region (ids ``c:<key>`` …);
edges PLACED, CONTAINS, SUPPLIED_BY, LOCATED_IN, PART_OF. Customers carry
their market segment as a facet label (axis Segment), parts their brand
(axis Brand). The same graph is written as DuckDB SQL (``NODES_SQL`` /
``EDGES_SQL``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.build import EdgeSpec, NodeSpec
from ..session import scratch_path
from ..sources import store

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "conversations", "labels"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, *cols) -> F.Column:
    parts = [F.lit(prefix)]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("-"))
        parts.append(F.col(c).cast("string"))
    return F.concat(*parts)


def node_specs(spark: SparkSession, sf_dir: str) -> list[NodeSpec]:
    r = lambda n: read(spark, sf_dir, n)
    return [
        NodeSpec(r("customer").select(_id("c:", "c_custkey").alias("id"),
                                      F.col("c_name").alias("name"), "c_acctbal", "c_mktsegment"),
                 id="id", label="customer", properties=["name", "c_acctbal"],
                 facets={"c_mktsegment": "Segment"}),
        NodeSpec(r("supplier").select(_id("s:", "s_suppkey").alias("id"),
                                      F.col("s_name").alias("name"), "s_acctbal"),
                 id="id", label="supplier", properties=["name", "s_acctbal"]),
        NodeSpec(r("part").select(_id("p:", "p_partkey").alias("id"), F.col("p_name").alias("name"),
                                  "p_size", "p_retailprice", "p_brand"),
                 id="id", label="part", properties=["name", "p_size", "p_retailprice"],
                 facets={"p_brand": "Brand"}),
        NodeSpec(r("orders").select(_id("o:", "o_orderkey").alias("id"), "o_totalprice",
                                    "o_orderstatus", "o_orderdate"),
                 id="id", label="orders", properties=["o_totalprice", "o_orderstatus", "o_orderdate"]),
        NodeSpec(r("nation").select(_id("n:", "n_nationkey").alias("id"), F.col("n_name").alias("name")),
                 id="id", label="nation", properties=["name"]),
        NodeSpec(r("region").select(_id("r:", "r_regionkey").alias("id"), F.col("r_name").alias("name")),
                 id="id", label="region", properties=["name"]),
    ]


def edge_specs(spark: SparkSession, sf_dir: str) -> list[EdgeSpec]:
    r = lambda n: read(spark, sf_dir, n)
    li = r("lineitem")
    return [
        EdgeSpec(r("orders").select(_id("pl:", "o_orderkey").alias("id"), _id("c:", "o_custkey").alias("s"),
                                    _id("o:", "o_orderkey").alias("d")),
                 id="id", source_key="s", target_key="d", type="PLACED"),
        EdgeSpec(li.select(_id("li:", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
                           _id("o:", "l_orderkey").alias("s"), _id("p:", "l_partkey").alias("d"),
                           "l_quantity", "l_extendedprice", "l_shipdate"),
                 id="id", source_key="s", target_key="d", type="CONTAINS",
                 properties=["l_quantity", "l_extendedprice"],
                 order_by=["l_shipdate", "l_extendedprice", "l_quantity"]),
        EdgeSpec(li.select(_id("sb:", "l_partkey", "l_suppkey").alias("id"), _id("p:", "l_partkey").alias("s"),
                           _id("s:", "l_suppkey").alias("d")),
                 id="id", source_key="s", target_key="d", type="SUPPLIED_BY"),
        EdgeSpec(r("customer").select(_id("lc:c:", "c_custkey").alias("id"), _id("c:", "c_custkey").alias("s"),
                                      _id("n:", "c_nationkey").alias("d")),
                 id="id", source_key="s", target_key="d", type="LOCATED_IN"),
        EdgeSpec(r("supplier").select(_id("lc:s:", "s_suppkey").alias("id"), _id("s:", "s_suppkey").alias("s"),
                                      _id("n:", "s_nationkey").alias("d")),
                 id="id", source_key="s", target_key="d", type="LOCATED_IN"),
        EdgeSpec(r("nation").select(_id("po:", "n_nationkey").alias("id"), _id("n:", "n_nationkey").alias("s"),
                                    _id("r:", "n_regionkey").alias("d")),
                 id="id", source_key="s", target_key="d", type="PART_OF"),
    ]


_stored: dict[tuple[str, str], str] = {}


def tpch_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of ``sf_dir``, built and stored once per session (in the
    shared folder), so that queries scan its node and edge files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        root = scratch_path(spark, "tpch")
        store.build_and_store(spark, node_specs(spark, sf_dir), edge_specs(spark, sf_dir), root, "tpch")
        _stored[key] = root
    return store.read_graph(spark, _stored[key], "tpch")


def tpch_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ontology rows of the graph: structural labels on EntityType, segments
    on Segment, brands on Brand, relation types on RelationType. Columns
    type_kind, type_name, canonical_name, axis."""
    r = lambda n: read(spark, sf_dir, n)
    ent = spark.createDataFrame(
        [(x,) for x in ["customer", "supplier", "part", "orders", "nation", "region"]], "type_name string")
    ent = ent.select(F.lit("entity").alias("type_kind"), "type_name", F.lit("EntityType").alias("axis"))
    seg = r("customer").select(F.lit("entity").alias("type_kind"), F.col("c_mktsegment").alias("type_name"),
                               F.lit("Segment").alias("axis"))
    brand = r("part").select(F.lit("entity").alias("type_kind"), F.col("p_brand").alias("type_name"),
                             F.lit("Brand").alias("axis"))
    out = ent.unionByName(seg).unionByName(brand).filter(F.col("type_name").isNotNull()).distinct()
    return out.withColumn("canonical_name", F.col("type_name"))


# ---------------------------------------------------------------- oracle SQL
# The same graph in DuckDB SQL (keys are unique in the driver tables, so the
# merge reduces to a union; CONTAINS keeps the last row per id by the same
# order as the Spark build).
NODES_SQL = """
nodes AS (
  SELECT 'c:' || c_custkey AS NODE, 'customer' AS LABEL,
         list_concat(['customer'], list_sort(list_filter([c_mktsegment], lambda x: x IS NOT NULL AND x <> 'customer'))) AS labels,
         c_name AS name, c_acctbal, NULL::DOUBLE AS s_acctbal, NULL::INTEGER AS p_size,
         NULL::DOUBLE AS p_retailprice, NULL::DOUBLE AS o_totalprice, NULL::VARCHAR AS o_orderstatus,
         NULL::TIMESTAMP AS o_orderdate
  FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'supplier', ['supplier'], s_name, NULL, s_acctbal, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'p:' || p_partkey, 'part',
         list_concat(['part'], list_sort(list_filter([p_brand], lambda x: x IS NOT NULL AND x <> 'part'))),
         p_name, NULL, NULL, p_size, p_retailprice, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'o:' || o_orderkey, 'orders', ['orders'], NULL, NULL, NULL, NULL, NULL, o_totalprice, o_orderstatus, o_orderdate FROM orders
  UNION ALL SELECT 'n:' || n_nationkey, 'nation', ['nation'], n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'region', ['region'], r_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM region
)"""

EDGES_SQL = """
raw_edges AS (
  SELECT 'pl:' || o_orderkey AS ID, 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst, 'PLACED' AS type,
         NULL::DOUBLE AS l_quantity, NULL::DOUBLE AS l_extendedprice FROM orders
  UNION ALL
  SELECT ID, src, dst, 'CONTAINS', arg_max(l_quantity, (l_shipdate, l_extendedprice, l_quantity)),
         arg_max(l_extendedprice, (l_shipdate, l_extendedprice, l_quantity))
  FROM (SELECT 'li:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS ID,
               'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, l_quantity, l_extendedprice, l_shipdate
        FROM lineitem) GROUP BY ID, src, dst
  UNION ALL
  SELECT DISTINCT 'sb:' || l_partkey || '-' || l_suppkey, 'p:' || l_partkey, 's:' || l_suppkey, 'SUPPLIED_BY', NULL, NULL FROM lineitem
  UNION ALL SELECT 'lc:c:' || c_custkey, 'c:' || c_custkey, 'n:' || c_nationkey, 'LOCATED_IN', NULL, NULL FROM customer
  UNION ALL SELECT 'lc:s:' || s_suppkey, 's:' || s_suppkey, 'n:' || s_nationkey, 'LOCATED_IN', NULL, NULL FROM supplier
  UNION ALL SELECT 'po:' || n_nationkey, 'n:' || n_nationkey, 'r:' || n_regionkey, 'PART_OF', NULL, NULL FROM nation
),
edges AS (
  SELECT * FROM raw_edges
  WHERE src IN (SELECT NODE FROM nodes) AND dst IN (SELECT NODE FROM nodes)
)"""

GRAPH_SQL = "WITH " + NODES_SQL.strip() + ",\n" + EDGES_SQL.strip() + "\n"


def with_graph(sql: str) -> str:
    """Prefix an oracle query with the graph CTEs (``nodes``, ``edges``)."""
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return GRAPH_SQL + ", " + body[5:]
    return GRAPH_SQL + body
