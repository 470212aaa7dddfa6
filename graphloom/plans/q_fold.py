"""Queries: ontology folding (I1-I8) over part types, and the document ledger
/ text store (I9-I15) over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fold as FO
from ..operators import ledger as L
from .registry import query
from .tpch import read

GRAPH = "tpch"
TS0 = "2025-01-01 00:00:00"


def _cap(c):
    """Capitalised spelling: first letter upper, rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 10 ** 6)))


def pre_ontology(spark, sf):
    """Ledger before the call: half of the part types (names before 'N') as
    canonicals of tpch/entity, a lower-case alias economy -> CHEAP, and
    out-of-scope rows (graph other, kind relation)."""
    t = read(spark, sf, "part").select(F.col("p_type").alias("t")).distinct()
    row = lambda g, k, n, c: t.select(F.lit(g).alias("graph"), F.lit(k).alias("type_kind"),
                                      n.alias("type_name"), c.alias("canonical_name"),
                                      F.lit("EntityType").alias("axis"),
                                      F.lit(None).cast("string").alias("first_seen_uri"),
                                      F.lit(None).cast("timestamp").alias("first_seen_ts"))
    return (row(GRAPH, "entity", F.col("t"), F.col("t")).filter(F.col("type_name") < "N")
            .unionByName(row(GRAPH, "entity", F.lower("t"), F.lit("CHEAP")).filter(F.col("t") == "ECONOMY"))
            .unionByName(row("other", "entity", F.col("t"), F.col("t")))
            .unionByName(row(GRAPH, "relation", F.col("t"), F.col("t"))))


ONTO_SQL = """
types AS (SELECT DISTINCT p_type AS t FROM part),
onto AS (SELECT 'tpch' AS graph, 'entity' AS type_kind, t AS type_name, t AS canonical_name, 'EntityType' AS axis FROM types WHERE t < 'N'
         UNION ALL SELECT 'tpch', 'entity', lower(t), 'CHEAP', 'EntityType' FROM types WHERE t = 'ECONOMY'
         UNION ALL SELECT 'other', 'entity', t, t, 'EntityType' FROM types
         UNION ALL SELECT 'tpch', 'relation', t, t, 'EntityType' FROM types)
"""


def _resolve_sql(kind_expr, name_expr):
    return (f"(SELECT o.canonical_name FROM onto o WHERE o.graph = 'tpch' AND o.type_kind = {kind_expr} "
            f"AND lower(o.type_name) = lower({name_expr}) ORDER BY (o.type_name <> {name_expr}), o.type_name LIMIT 1)")


@query("resolve_canonical", "WITH " + ONTO_SQL + """,
names AS (SELECT DISTINCT unnest([t, lower(t), upper(left(t, 1)) || lower(substr(t, 2))]) AS name FROM types)
SELECT name, """ + _resolve_sql("'entity'", "name") + """ AS canonical FROM names
""")
def q_resolve_canonical(spark, sf):
    t = read(spark, sf, "part").select(F.col("p_type").alias("t")).distinct()
    names = t.select(F.explode(F.array("t", F.lower("t"), _cap(F.col("t")))).alias("name")).distinct()
    return FO.resolve_canonical(pre_ontology(spark, sf), GRAPH, "entity", names)


def _variant(key, col):
    """Spelling of a type by key: original, lower or capitalised."""
    m = F.col(key) % 3
    return F.when(m == 0, F.col(col)).when(m == 1, F.lower(col)).otherwise(_cap(F.col(col)))


VARIANT_SQL = ("CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) "
               "ELSE upper(left(p_type, 1)) || lower(substr(p_type, 2)) END")


@query("record_types", "WITH " + ONTO_SQL + f""",
b AS (SELECT {VARIANT_SQL} AS type_name, p_partkey FROM part)
SELECT type_name, canonical_name, NULL AS first_seen_uri FROM onto WHERE graph = 'tpch' AND type_kind = 'entity'
UNION ALL
SELECT type_name, upper(type_name), 'p:' || min(p_partkey) FROM b
WHERE type_name NOT IN (SELECT type_name FROM onto WHERE graph = 'tpch' AND type_kind = 'entity')
GROUP BY type_name
""")
def q_record_types(spark, sf):
    p = read(spark, sf, "part")
    batch = p.select(F.lit(GRAPH).alias("graph"), F.lit("entity").alias("type_kind"),
                     _variant("p_partkey", "p_type").alias("type_name"),
                     F.upper(_variant("p_partkey", "p_type")).alias("canonical_name"),
                     F.lit("Type").alias("axis"), F.concat(F.lit("p:"), F.col("p_partkey")).alias("first_seen_uri"),
                     F.lit(TS0).cast("timestamp").alias("first_seen_ts"), F.col("p_partkey").alias("ord"))
    onto = FO.record_types(pre_ontology(spark, sf), batch)
    return (onto.filter((F.col("graph") == GRAPH) & (F.col("type_kind") == "entity"))
            .select("type_name", "canonical_name", "first_seen_uri"))


@query("get_canonicals", "WITH " + ONTO_SQL + """
SELECT DISTINCT canonical_name AS canonical FROM onto WHERE graph = 'tpch' AND type_kind = 'entity'
""")
def q_get_canonicals(spark, sf):
    return FO.get_canonicals(pre_ontology(spark, sf), GRAPH, "entity")


SYNONYMS = [("entity", "PROMO", "ECONOMY"), ("entity", "promo", "ECONOMY"), ("entity", "Promo", "ECONOMY"),
            ("relation", "MADE_BY", "MAKES")]


def _fold_inputs(spark, sf):
    p = read(spark, sf, "part")
    ents = p.select(F.concat(F.lit("p:"), F.col("p_partkey")).alias("NODE"), F.col("p_partkey").alias("_ord"),
                    _variant("p_partkey", "p_type").alias("label"),
                    F.array(F.struct(F.col("p_brand").alias("name"), F.lit("Brand").alias("axis"))).alias("facets"))
    rels = p.select(F.concat(F.lit("mb:"), F.col("p_partkey")).alias("id"), F.col("p_partkey").alias("_ord"),
                    F.when(F.col("p_partkey") % 2 == 0, F.lit("MADE_BY")).otherwise(F.lit("made_by")).alias("label"),
                    F.lit(None).cast("string").alias("axis"))
    syn = spark.createDataFrame(SYNONYMS, FO.SYNONYM_SCHEMA)
    return ents, rels, syn


def run_fold(spark, sf):
    ents, rels, syn = _fold_inputs(spark, sf)
    return FO.fold_labels(pre_ontology(spark, sf), GRAPH, ents, rels, "doc:parts", TS0, synonyms=syn)


FOLD_SQL = "WITH " + ONTO_SQL + f""",
syn AS (SELECT * FROM (VALUES ('entity', 'PROMO', 'ECONOMY'), ('entity', 'promo', 'ECONOMY'),
        ('entity', 'Promo', 'ECONOMY'), ('relation', 'MADE_BY', 'MAKES')) s(k, name, target)),
props AS (SELECT 'entity' AS k, {VARIANT_SQL} AS name, 'EntityType' AS axis, 0 AS part, p_partkey AS o, -1 AS f FROM part
          UNION ALL SELECT 'entity', p_brand, 'Brand', 0, p_partkey, 0 FROM part
          UNION ALL SELECT 'relation', CASE WHEN p_partkey % 2 = 0 THEN 'MADE_BY' ELSE 'made_by' END,
                           'RelationType', 1, p_partkey, -1 FROM part),
names AS (SELECT k, name, arg_min(axis, (part, o, f)) AS axis, min((part, o, f)) AS ord FROM props GROUP BY k, name),
pre AS (SELECT n.*, (SELECT o.canonical_name FROM onto o WHERE o.graph = 'tpch' AND o.type_kind = n.k
        AND lower(o.type_name) = lower(n.name) ORDER BY (o.type_name <> n.name), o.type_name LIMIT 1) AS canon FROM names n),
leaders AS (SELECT k, lower(name) AS l, arg_min(name, ord) AS leader FROM pre WHERE canon IS NULL GROUP BY k, lower(name)),
lsyn AS (SELECT l.k, l.leader, s.target FROM leaders l JOIN syn s ON s.k = l.k AND s.name = l.leader
         WHERE s.target IN (SELECT canonical_name FROM onto WHERE graph = 'tpch' AND type_kind = l.k)),
lc AS (SELECT l.*, coalesce(ls.target, l.leader) AS gcanon FROM leaders l LEFT JOIN lsyn ls ON ls.k = l.k AND ls.leader = l.leader),
mapping AS (SELECT p.k, p.name, coalesce(p.canon, lc.gcanon) AS canonical, p.axis,
                   lc.leader IS NOT NULL AND lc.leader = p.name AS is_leader
            FROM pre p LEFT JOIN lc ON lc.k = p.k AND lc.l = lower(p.name)),
ents AS (SELECT 'p:' || p_partkey AS NODE, {VARIANT_SQL} AS label, p_brand FROM part),
ents2 AS (SELECT e.NODE, e.label AS raw, e.p_brand, m1.canonical AS c1, m2.canonical AS c2 FROM ents e
          JOIN mapping m1 ON m1.k = 'entity' AND m1.name = e.label JOIN mapping m2 ON m2.k = 'entity' AND m2.name = e.p_brand)
"""


@query("fold_labels", FOLD_SQL + """
SELECT NODE AS id, c1 AS label FROM ents2
UNION ALL SELECT 'mb:' || p_partkey, m.canonical FROM part
JOIN mapping m ON m.k = 'relation' AND m.name = CASE WHEN p_partkey % 2 = 0 THEN 'MADE_BY' ELSE 'made_by' END
""")
def q_fold_labels(spark, sf):
    e, r, _, _ = run_fold(spark, sf)
    return (e.select(F.col("NODE").alias("id"), "label")
            .unionByName(r.select("id", "label")))


@query("synonym_match", FOLD_SQL + """
SELECT k AS type_kind, leader AS name, target FROM lsyn
""")
def q_synonym_match(spark, sf):
    ents, rels, syn = _fold_inputs(spark, sf)
    onto = pre_ontology(spark, sf)
    props = FO.proposals(ents, rels)
    names = props.groupBy("type_kind", "name").agg(F.min("ord").alias("ord"))
    pre = FO.resolve_canonical(onto, GRAPH, None, names.select("type_kind", "name"), kind_col="type_kind")
    miss = names.join(pre.filter(F.col("canonical").isNull()), ["type_kind", "name"])
    leaders = miss.groupBy("type_kind", F.lower("name").alias("_l")).agg(F.min_by("name", "ord").alias("name"))
    canon = (onto.filter(F.col("graph") == GRAPH)
             .select("type_kind", F.col("canonical_name").alias("canonical")).distinct())
    return FO.synonym_match(leaders.select("type_kind", "name"), canon, synonyms=syn)


@query("label_vectors", FOLD_SQL + """
SELECT NODE, CASE WHEN c1 = c2 THEN c1 ELSE c1 || '|' || c2 END AS labels, raw || '|' || p_brand AS label_raw FROM ents2
""")
def q_label_vectors(spark, sf):
    e, _, _, _ = run_fold(spark, sf)
    return e.select("NODE", F.array_join("labels", "|").alias("labels"), F.array_join("label_raw", "|").alias("label_raw"))


@query("fold_report", FOLD_SQL + """
SELECT k AS kind, name AS "from", canonical AS "to", axis FROM mapping WHERE canonical <> name
""")
def q_fold_report(spark, sf):
    _, _, mapping, _ = run_fold(spark, sf)
    return FO.fold_report(mapping)


@query("axis_map", FOLD_SQL + """
SELECT type_name, axis FROM onto WHERE graph = 'tpch' AND type_kind = 'entity'
UNION ALL SELECT name, axis FROM mapping WHERE k = 'entity' AND is_leader
""")
def q_axis_map(spark, sf):
    _, _, _, onto = run_fold(spark, sf)
    return FO.axis_map(onto, GRAPH, "entity")


# ------------------------------------------------------------- ledger / text

def _doc_batches(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    b1 = d.select(F.lit("warehouse." + GRAPH).alias("graph"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("doc_uri"),
                  "text", F.col("doc_id").alias("ord"))
    b2 = d.select(F.lit("warehouse." + GRAPH).alias("graph"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("doc_uri"),
                  F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
                  F.col("doc_id").alias("ord"))
    new = d.filter(F.col("doc_id") % 10 == 1).select(
        F.lit("warehouse." + GRAPH).alias("graph"), F.concat(F.lit("doc:new:"), F.col("doc_id")).alias("doc_uri"),
        "text", (F.col("doc_id") + F.lit(10 ** 12)).alias("ord"))
    fp = lambda b: L.document_fingerprint(b.withColumnRenamed("doc_uri", "_u"), name_col="_u").drop("_u")
    return fp(b1), fp(b2.unionByName(new))


def run_ledger(spark, sf):
    b1, b2 = _doc_batches(spark, sf)
    ledger0 = spark.createDataFrame([], L.LEDGER_SCHEMA)
    s1, led1 = L.ledger_upsert(ledger0, b1.select("graph", "doc_uri", "sha256", "ord"), "2025-01-01 00:00:00")
    s2, led2 = L.ledger_upsert(led1, b2.select("graph", "doc_uri", "sha256", "ord"), "2025-01-02 00:00:00")
    return b1, b2, s1, led1, s2, led2


LEDGER_SQL = """
b1 AS (SELECT 'doc:' || doc_id AS doc_uri, sha256(text) AS sha, text, doc_id FROM documents),
b2 AS (SELECT 'doc:' || doc_id AS doc_uri, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS sha,
              CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS text, doc_id FROM documents
       UNION ALL SELECT 'doc:new:' || doc_id, sha256(text), text, doc_id FROM documents WHERE doc_id % 10 = 1),
st AS (SELECT b2.doc_uri, b2.sha, CASE WHEN b1.doc_uri IS NULL THEN 'new' WHEN b1.sha = b2.sha THEN 'unchanged'
              ELSE 'updated' END AS status, b2.doc_id FROM b2 LEFT JOIN b1 ON b1.doc_uri = b2.doc_uri)
"""


@query("document_fingerprint", """
SELECT doc_id, sha256(text) AS sha256, 'text:' || sha256(text) AS doc_uri, 'text:' || left(sha256(text), 12) AS display_uri FROM documents
""")
def q_document_fingerprint(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    return L.document_fingerprint(d).select("doc_id", "sha256", "doc_uri", "display_uri")


@query("ledger_upsert", "WITH " + LEDGER_SQL + """
SELECT doc_uri, status, sha AS sha256, CASE WHEN doc_uri LIKE 'doc:new:%' THEN '2025-01-02' ELSE '2025-01-01' END AS first_ts
FROM st
""")
def q_ledger_upsert(spark, sf):
    _, _, _, _, _, led2 = run_ledger(spark, sf)
    return led2.select("doc_uri", "status", "sha256",
                       F.date_format("first_ingested_ts", "yyyy-MM-dd").alias("first_ts"))


@query("skip_unchanged", "WITH " + LEDGER_SQL + """
SELECT doc_uri FROM st WHERE status <> 'unchanged'
""")
def q_skip_unchanged(spark, sf):
    _, b2, _, led1, _, _ = run_ledger(spark, sf)
    return L.skip_unchanged(led1, b2).select("doc_uri")


@query("list_documents", "WITH " + LEDGER_SQL + """
SELECT doc_uri, status FROM st
""")
def q_list_documents(spark, sf):
    _, _, _, _, _, led2 = run_ledger(spark, sf)
    other = led2.withColumn("graph", F.lit("other"))
    return L.list_documents(led2.unionByName(other), "warehouse." + GRAPH).select("doc_uri", "status")


@query("document_text", "WITH " + LEDGER_SQL + """
SELECT doc_uri, substring(text, 1, 100) AS text, length(text) AS char_len, length(text) > 100 AS truncated FROM b2
""")
def q_document_text(spark, sf):
    _, b2, _, _, _, _ = run_ledger(spark, sf)
    store = L.record_text(spark.createDataFrame([], L.TEXT_SCHEMA), b2.select("graph", "doc_uri", "text"))
    return L.document_text(store, GRAPH, 100)


@query("backfill_text", "WITH " + LEDGER_SQL + """
SELECT doc_uri FROM st WHERE status = 'unchanged' AND doc_id % 3 = 0
""")
def q_backfill_text(spark, sf):
    b1, _, _, _, s2, _ = run_ledger(spark, sf)
    # The first run stored texts best-effort: documents with doc_id % 3 = 0
    # failed to store theirs.
    stored = b1.filter(F.substring_index("doc_uri", ":", -1).cast("long") % 3 != 0)
    store = L.record_text(spark.createDataFrame([], L.TEXT_SCHEMA), stored.select("graph", "doc_uri", "text"))
    return L.backfill_text(store, s2).select("doc_uri")


@query("clear_metadata", "WITH " + ONTO_SQL + ", " + LEDGER_SQL + """
SELECT 'ledger' AS tbl, 'other' AS graph, COUNT(*) AS n FROM st
UNION ALL SELECT 'ontology', 'other', COUNT(*) FROM onto WHERE graph = 'other'
""")
def q_clear_metadata(spark, sf):
    _, _, _, _, _, led2 = run_ledger(spark, sf)
    led = led2.unionByName(led2.withColumn("graph", F.lit("other")))
    onto = pre_ontology(spark, sf)
    out = L.clear_metadata({"ledger": led, "ontology": onto}, "warehouse." + GRAPH)
    out = L.clear_metadata(out, "warehouse." + GRAPH)     # idempotent
    return (out["ledger"].groupBy("graph").agg(F.count(F.lit(1)).alias("n")).select(F.lit("ledger").alias("tbl"), "graph", "n")
            .unionByName(out["ontology"].groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit("ontology").alias("tbl"), "graph", "n")))
