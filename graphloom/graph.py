"""A property graph is two DataFrames.

``nodes``: ``NODE`` (string id), ``LABEL`` (structural label), ``labels``
(``array<string>``, structural label first, facets after) and any number of
typed property columns (null where a property does not apply).

``edges``: ``ID``, ``src``, ``dst``, ``type`` and typed property columns.

Stored layout (see :mod:`graphloom.sources.store`): one Parquet directory for
nodes and one for edges partitioned by ``type``, so a hop reads only its type.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_META = ["NODE", "LABEL", "labels", "label_raw", "first_seen_ts", "last_seen_ts"]
EDGE_META = ["ID", "src", "dst", "type", "first_seen_ts", "last_seen_ts"]


@dataclass
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    name: str = "graph"
    # Optional ontology: type_kind, type_name, canonical_name, axis.
    ontology: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    @property
    def spark(self):
        return self.nodes.sparkSession

    def node_properties(self) -> list[str]:
        return [c for c in self.nodes.columns if c not in NODE_META]

    def edge_properties(self) -> list[str]:
        return [c for c in self.edges.columns if c not in EDGE_META]

    def nodes_with_label(self, label: str) -> DataFrame:
        return self.nodes.filter(F.array_contains("labels", label))

    def edges_of_type(self, *types: str) -> DataFrame:
        if not types:
            return self.edges
        return self.edges.filter(F.col("type").isin(list(types)))

    def cache(self) -> "PropertyGraph":
        self.nodes = self.nodes.cache()
        self.edges = self.edges.cache()
        return self

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()
