"""Source lineage of built graphs.

Runs over a recipe table (one row per graph: the build spec as JSON and the
recipe statement), so lineage of many graphs is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPEC_SCHEMA = ("struct<tables: map<string,string>, nodes: array<struct<sql: string>>, "
               "edges: array<struct<sql: string>>>")
# Fixed value: marker of the legacy recipe line listing source tables.
SOURCE_MARKER = "-- source tables:"


def _word_pattern(token):
    """``(?<!\\w)<escaped token>(?!\\w)`` as a column."""
    esc = F.regexp_replace(token, r"([^A-Za-z0-9_])", r"\\$1")
    return F.concat(F.lit(r"(?<!\w)"), esc, F.lit(r"(?!\w)"))


def source_lineage(recipes: DataFrame) -> DataFrame:
    """Relations each graph was built from: (graph, name, path, role).

    role: 'nodes' / 'edges' when only the node (edge) SELECTs mention the
    path or the whole-word table name, else null. Without a usable spec the
    statement's ``-- source tables: a = p, ...`` line is parsed (role null).
    Input columns: graph, spec_json, statement."""
    spec = F.from_json(F.col("spec_json"), SPEC_SCHEMA)
    r = recipes.select("graph", "statement", spec.alias("s"))
    has_spec = F.size(F.coalesce(F.col("s.tables"), F.create_map())) > 0
    with_spec = r.filter(has_spec).select(
        "graph",
        F.array_join(F.transform(F.coalesce("s.nodes", F.array()), lambda n: F.coalesce(n["sql"], F.lit(""))), " ")
        .alias("node_sql"),
        F.array_join(F.transform(F.coalesce("s.edges", F.array()), lambda n: F.coalesce(n["sql"], F.lit(""))), " ")
        .alias("edge_sql"),
        F.explode("s.tables").alias("name", "path"))
    pat = _word_pattern(F.col("name"))
    refs = lambda sql: ((F.col("path") != "") & F.col(sql).contains(F.col("path"))) | (
        (F.col("name") != "") & F.expr(f"{sql} RLIKE _pat"))
    w = with_spec.withColumn("_pat", pat)
    n, e = refs("node_sql"), refs("edge_sql")
    role = F.when(n & ~e, F.lit("nodes")).when(e & ~n, F.lit("edges"))
    primary = w.select("graph", "name", "path", role.alias("role"))

    line = F.regexp_extract("statement", r"--\s*source tables:([^\n]*)", 1)
    legacy = (r.filter(~has_spec | F.col("s").isNull())
              .filter(F.col("statement").contains(SOURCE_MARKER))
              .select("graph", F.explode(F.split(line, ",")).alias("pair"))
              .filter(F.col("pair").contains("="))
              .select("graph", F.trim(F.substring_index("pair", "=", 1)).alias("name"),
                      F.trim(F.expr("substring(pair, instr(pair, '=') + 1)")).alias("path"),
                      F.lit(None).cast("string").alias("role")))
    return primary.unionByName(legacy)
