"""Documents -> graph, end to end.

One batch job over many documents of one graph: fingerprint -> skip
unchanged (ledger) -> chunk -> extract -> merge/fold names -> fold labels
(ontology) -> upsert nodes and edges -> attribute columns -> ledger and text
store. Every state table is a :class:`BatchLog`: a run appends its rows as a
batch of its own; the ledger's batch is written only after the graph's, so a
failed run is simply retried, and a replay writes over its own batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import counts_row, splittable_join
from ..functions.types import SPARK_TYPE
from ..graph import PropertyGraph
from . import documents as D
from . import fold as FO
from . import ingest as I
from . import ledger as L
from .batch_log import keyed, new_batch_id
from ..session import cut_lineage


EDGE_KEY = I.EDGE_KEY
COLUMN_SCHEMA = "kind string, column string, type string"


class GraphStore:
    """The state tables of one graph under a shared folder."""

    def __init__(self, spark: SparkSession, root: str, graph: str):
        self.spark, self.graph = spark, graph.rsplit(".", 1)[-1]
        base = f"{root}/{self.graph}"
        self.nodes, self.edges = I.node_log(spark, f"{base}/nodes"), I.edge_log(spark, f"{base}/edges")
        self.ledger = keyed(spark, f"{base}/ledger", L.LEDGER_SCHEMA, ["graph", "doc_uri"])
        self.texts = keyed(spark, f"{base}/texts", L.TEXT_SCHEMA, ["graph", "doc_uri"])
        # A type or a column keeps what was recorded for it first.
        self.onto = keyed(spark, f"{base}/ontology", FO.ONTOLOGY_SCHEMA, ["graph", "type_kind", "type_name"], keep="first")
        self.columns = keyed(spark, f"{base}/columns", COLUMN_SCHEMA, ["kind", "column"], keep="first")

    def compact(self) -> None:
        """Merge every table's batches into one, by ordinary jobs."""
        for log in (self.nodes, self.edges, self.ledger, self.texts, self.onto, self.columns):
            log.compact()


def _evolve(store: GraphStore, nodes: DataFrame, edges: DataFrame, batch_id: str) -> None:
    """Declare the attributes that a batch brings; declared types stay."""
    declared = store.columns.current(batch_id)
    new = None
    for kind, batch, base in (("node", nodes, I.NODE_BASE_COLS), ("edge", edges, I.EDGE_BASE_COLS)):
        found = I.discover_attr_columns(batch.select("_ord", "attrs"), base, seq=F.col("_ord"))
        grown = I.evolve_columns(declared.filter(F.col("kind") == kind).select("column", "type"), found)
        part = grown.select(F.lit(kind).alias("kind"), "column", "type")
        new = part if new is None else new.unionByName(part)
    store.columns.append(new.join(declared, ["kind", "column"], "left_anti"), batch_id)


def state_graph(store: GraphStore) -> PropertyGraph:
    """The ingested state as a queryable graph: nodes with LABEL, labels,
    name and one typed column per declared attribute (C5/C6), edges likewise,
    the ontology beside. The declared columns (one row per attribute) are read
    by the driver; nothing else runs before the graph is used."""
    declared = store.columns.current().collect()
    typed = lambda kind, have: [(r["column"], r["type"]) for r in sorted(declared) if r["kind"] == kind and r["column"] not in have]
    value = lambda c, t: I.coerce_value(F.col("attrs")[c], t).cast(SPARK_TYPE[t]).alias(c)
    n, e = store.nodes.current(), store.edges.current()
    front = ["NODE", "LABEL", "labels", "label_raw", "name", "first_seen_ts", "last_seen_ts"]
    nodes = n.select("NODE", F.try_element_at("labels", F.lit(1)).alias("LABEL"), "labels", "label_raw", "name",
                     "first_seen_ts", "last_seen_ts", *[value(c, t) for c, t in typed("node", front)])
    front = ["ID", "src", "dst", "type", "first_seen_ts", "last_seen_ts"]
    edges = e.select(*front, *[value(c, t) for c, t in typed("edge", front)])
    return PropertyGraph(nodes, edges, name=store.graph, ontology=store.onto.current())


def ingest_documents(spark: SparkSession, store: GraphStore, docs: DataFrame, now: str,
                     max_chunks: int | None = None, mode: str = "sequential", extractor=None,
                     synonyms: DataFrame | None = None, synonym_fn=None, uri: str = "batch", batch_id: str | None = None) -> DataFrame:
    """Ingest ``docs`` (doc_uri, text, ord) into ``store``; returns the
    one-row report: documents, processed, reused (unchanged), backfilled
    (texts stored late), truncated (documents cut by ``max_chunks``), nodes,
    nodes_created, edges, edges_created, folded (names), labels.

    The rows of one uri count as submissions in the order of ``ord``, as if
    sent one after the other: each is new, unchanged or updated against the
    one before; the text store keeps the last. ``batch_id`` names the run's
    batches (default: a new id); a replay with the same id replaces them."""
    g, at = store.graph, batch_id or new_batch_id()
    batch = L.document_fingerprint(docs.withColumnRenamed("doc_uri", "_u"), name_col="_u").drop("_u", "display_uri") \
        .withColumn("graph", F.lit(g))
    keys = batch.select("graph", "doc_uri")
    statuses, _ = L.ledger_upsert(store.ledger.current(at), batch.select("graph", "doc_uri", "sha256", "ord", "text"), now)
    statuses = cut_lineage(statuses)
    todo = statuses.filter("status <> 'unchanged'")
    # A submission is a document of its own: uri and place in the batch.
    doc = F.concat_ws("#", F.col("ord").cast("string"), F.col("doc_uri"))
    chunks = D.chunk_documents(todo.select(doc.alias("doc_id"), "text"), max_chunks, mode)
    # Extraction output feeds entities, relations and folding: pin it once
    # (a user extractor may be costly and must not run twice per chunk).
    el = cut_lineage(D.extract_elements(chunks, extractor))
    ents = D.merge_entities(el)
    rels = D.merge_relations(D.link_relations(el, ents))
    renames = D.fold_partial_names(ents)
    ents = D.apply_folds(ents, renames)
    rels = D.redirect_relations(rels, renames)
    # Cut the lineage once the per-document work is done: the merged
    # elements feed several later branches (fold, upsert, report), and a
    # reliable checkpoint both avoids recomputing extraction per branch and
    # survives executor loss.
    ents, rels = cut_lineage(ents), cut_lineage(rels)
    order = todo.select(doc.alias("doc_id"), F.col("ord").alias("_dord"))
    ents = splittable_join(ents, order, ["doc_id"], "inner").withColumn("_ord", F.struct(
        F.col("_dord").alias("d"), F.col("doc_id").alias("u"), F.col("_first.chunk_idx").alias("c"), F.col("_first.pos").alias("p")))
    rels = splittable_join(rels, order, ["doc_id"], "inner").withColumn("_ord", F.struct(
        F.col("_dord").alias("d"), F.col("doc_id").alias("u"), F.col("_ord.chunk_idx").alias("c"), F.col("_ord.rpos").alias("p")))
    onto = store.onto.current(at)
    e_f, r_f, mapping, new_onto = FO.fold_labels(onto, g, ents, rels, uri, now, synonyms, synonym_fn)
    e_f, r_f = cut_lineage(e_f), cut_lineage(r_f)
    node_batch = e_f.select(F.col("NODE").alias("id"), "label", "labels", "label_raw",
                            F.col("NODE").alias("name"), "attrs", "_ord")
    edge_batch = r_f.select("id", "src", "dst", "label", "attrs", "_ord")
    old_nodes, old_edges = store.nodes.rows(at).select("NODE"), store.edges.rows(at).select(*EDGE_KEY)
    new_ids = node_batch.select(F.col("id").alias("NODE")).filter("NODE is not null")
    store.nodes.append(I.node_rows(node_batch, now, at, seq=F.col("_ord")), at)
    edge_keys = edge_batch.select("src", "dst", F.col("label").alias("type"), F.col("id").alias("ID"))
    store.edges.append(I.edge_rows(edge_batch, now, at, seq=F.col("_ord"), nodes=old_nodes.unionByName(new_ids)), at)
    store.onto.append(new_onto.join(onto.select("graph", "type_kind", "type_name"), ["graph", "type_kind", "type_name"], "left_anti"), at)
    _evolve(store, node_batch, edge_batch, at)
    # Ledger and texts only after the graph is written; unchanged documents
    # whose text is missing get it now.
    late = L.backfill_text(store.texts.rows(at), statuses)
    send = todo.select("graph", "doc_uri", "text", "ord").unionByName(late.select("graph", "doc_uri", "text", "ord"))
    store.texts.append(L.record_text(spark.createDataFrame([], L.TEXT_SCHEMA), send), at)
    touched = store.ledger.current(at).join(keys.distinct(), ["graph", "doc_uri"], "left_semi")
    store.ledger.append(L.ledger_upsert(touched, batch.select("graph", "doc_uri", "sha256", "ord"), now)[1], at)
    nodes = new_ids.distinct()
    edges = store.edges.rows().filter(F.col("seq") == at).select(*EDGE_KEY)
    return counts_row([
        ("documents", keys), ("processed", todo.select("doc_uri")), ("reused", statuses.filter("status = 'unchanged'").select("doc_uri")),
        ("backfilled", late.select("doc_uri").distinct()), ("truncated", chunks.filter("truncated").select("doc_id").distinct()),
        ("nodes", nodes), ("nodes_created", nodes.join(old_nodes, "NODE", "left_anti")),
        ("edges", edges), ("edges_created", edges.join(old_edges, EDGE_KEY, "left_anti")),
        ("folded", FO.fold_report(mapping).select("kind")), ("labels", mapping.select("canonical").distinct())])
