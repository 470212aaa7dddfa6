"""Substring search on node names through an index of trigrams.

The index of a stored graph has a posting (gram, NODE) for every distinct
trigram of a node's lower-cased name (its id where it has none), each file
sorted by gram, so a search reads only the row groups of its own trigrams. A pattern's
postings are intersected by counting, and the few nodes that are left are
looked up and verified. Patterns under three characters have no trigram: they
scan the nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fs, store
from .match import _q, name_matches

GRAM = 3
ROW_GROUP = 4 << 20


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none if it is shorter."""
    places = F.sequence(F.lit(1), F.char_length(text) - (GRAM - 1))
    return F.when(F.char_length(text) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))) \
            .otherwise(F.array().cast("array<string>"))


def postings(nodes: DataFrame, name_col: str = "name") -> DataFrame:
    """(NODE, gram) of every distinct trigram of the nodes' names, sorted by gram in each task, not moved."""
    name = F.coalesce(F.col(name_col), F.col("NODE")) if name_col in nodes.columns else F.col("NODE")
    return nodes.select("NODE", F.explode(grams(F.lower(name))).alias("gram")).sortWithinPartitions("gram", "NODE")


def write_names(spark: SparkSession, root: str, graph: str, name_col: str = "name") -> None:
    """Write the index of a stored graph; a rebuilt graph needs it again.
    Every task writes the nodes that it reads; small row groups keep a gram's rows apart."""
    (postings(store.read_graph(spark, root, graph).nodes, name_col).write.mode("overwrite")
     .option("parquet.block.size", ROW_GROUP).parquet(store.table_path(root, graph, store.NAMES)))


def _asked(query: str) -> list[str]:
    low = query.lower()
    return sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})


def find_names(spark: SparkSession, root: str, graph: str, query: str, label: str | None = None, props: list | None = None,
               name_col: str = "name") -> DataFrame:
    """Nodes (NODE, LABEL, ``props``) whose name contains ``query`` in any case."""
    nodes = store.read_graph(spark, root, graph).nodes
    path, asked = store.table_path(root, graph, store.NAMES), _asked(query)
    if asked and fs.exists(spark, path):
        postings = spark.read.parquet(path).filter(F.col("gram").isin(asked))
        hits = postings.groupBy("NODE").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(asked)).select("NODE")
        nodes = nodes.join(hits, "NODE", "left_semi")
    if label is not None:
        nodes = nodes.filter(F.array_contains("labels", label))
    where = name_matches(query, name_col) if name_col in nodes.columns else F.lower("NODE").contains(query.lower())
    return nodes.filter(where).select("NODE", "LABEL", *[F.col(_q(p)) for p in (props or [])])
