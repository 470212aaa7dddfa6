"""Documents -> graph elements.

Chunking, the default extractor, per-document merging and name folding are
column expressions and keyed aggregations: every step groups by document
(and a name key inside it), so the work spreads over documents and no step
pairs all entities of a document with each other.

The extractor is pluggable (K1): the default is a rule written with
``regexp_extract_all`` (JVM-side); a user function ``text -> {"entities":
[...], "relations": [...]}`` runs batched through ``mapInPandas``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import splittable_join
from ..functions.labels import canonical_id, python_strip, relation_id

# Paragraph separator and modes.
PARAGRAPH_SPLIT = r"(?U)\n\s*\n+"
MODES = ["sequential", "parallel", "whole"]

# Rule-based default extractor: capitalised word runs are entities. Possessive: the same matches as
# greedy, but Java's matcher loops over the words of a run instead of calling itself for each.
ENTITY_PATTERN = r"[A-Z][a-z]++(?: [A-Z][a-z]++)*+"
RULE_RELATION = "NEXT_TO"
RULE_AXIS = "ADJACENCY"

ENTITY_T = "struct<name:string,label:string,facets:array<struct<name:string,axis:string>>,attrs:map<string,string>>"
RELATION_T = "struct<source:string,target:string,label:string,axis:string,attrs:map<string,string>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def paragraphs(text) -> Column:
    """Split on blank lines, strip (Unicode whitespace), drop empties."""
    parts = F.transform(F.split(_c(text), PARAGRAPH_SPLIT, -1), python_strip)
    return F.filter(parts, lambda p: p != "")


def chunk_documents(docs: DataFrame, max_chunks: int | None = None, mode: str = "sequential",
                    doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """H1/H2: one row per kept chunk: doc, chunk_idx, chunk, truncated.

    sequential/parallel (and unknown modes): all paragraphs; with
    ``max_chunks`` only the first ones, ``truncated`` iff more existed;
    ``whole``: the stripped text as one chunk, never truncated."""
    mode = mode if mode in MODES else "sequential"
    t = F.col(text_col)
    if mode == "whole":
        body = python_strip(F.coalesce(t, F.lit("")))
        arr = F.when(body != "", F.array(body)).otherwise(F.array().cast("array<string>"))
        trunc = F.lit(False)
    else:
        ps = paragraphs(F.coalesce(t, F.lit("")))
        arr = ps if max_chunks is None else F.slice(ps, 1, max_chunks)
        trunc = F.lit(False) if max_chunks is None else F.size(ps) > max_chunks
    return docs.select(F.col(doc_col), trunc.alias("truncated"),
                       F.posexplode(arr).alias("chunk_idx", "chunk"))


def chunk_turns(turns: DataFrame, doc_col: str, order_col: str, text_col: str = "text",
                max_chunks: int | None = None, bucket: int | None = 64) -> DataFrame:
    """H1 over a document stored as ordered parts (e.g. conversation turns)
    whose text is the parts joined by blank lines, WITHOUT assembling it.

    A blank-line join always separates paragraphs, so the document's
    paragraphs are each part's paragraphs in part order. The chunk index is
    the part's offset (paragraphs in earlier parts) + the position inside the
    part. Offsets are a two-level prefix sum: within a bucket of
    ``bucket`` consecutive part numbers, plus the sum of earlier buckets
    (one row per (document, bucket)); a document with a third of all parts is
    therefore spread over many tasks. ``order_col`` must be numeric when
    bucketing. Output as :func:`chunk_documents`."""
    from pyspark.sql import Window
    t = turns.select(F.col(doc_col), F.col(order_col).alias("_o"),
                     paragraphs(F.coalesce(F.col(text_col), F.lit(""))).alias("_ps"))
    t = t.withColumn("_n", F.size("_ps"))
    bk = F.floor(F.col("_o") / bucket).cast("long") if bucket else F.lit(0).cast("long")
    t = t.withColumn("_b", bk)
    within = Window.partitionBy(doc_col, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_wo", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    per_b = t.groupBy(doc_col, "_b").agg(F.sum("_n").alias("_bn"))
    before = Window.partitionBy(doc_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_b = per_b.select(doc_col, "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_bo"),
                         "_bn")
    t = t.join(per_b.select(doc_col, "_b", "_bo"), [doc_col, "_b"])
    cut = F.lit(False)
    if max_chunks is not None:
        totals = per_b.groupBy(doc_col).agg(F.sum("_bn").alias("_tot"))
        t = splittable_join(t, totals, [doc_col], "inner")
        cut = F.col("_tot") > max_chunks
    ex = t.select(F.col(doc_col), cut.alias("truncated"),
                  (F.col("_bo") + F.col("_wo")).alias("_off"), F.posexplode("_ps").alias("_p", "chunk"))
    ex = ex.withColumn("chunk_idx", (F.col("_off") + F.col("_p")).cast("int"))
    if max_chunks is not None:
        ex = ex.filter(F.col("chunk_idx") < max_chunks)
    return ex.select(doc_col, "truncated", "chunk_idx", "chunk")


def rule_extract(chunk: Column, single_label: str | None = None) -> tuple[Column, Column]:
    """Default extractor: capitalised word runs are entities (label by run
    length: 1 token -> Term, more -> Name, or ``single_label``); consecutive
    entities are linked NEXT_TO (axis ADJACENCY)."""
    names = F.regexp_extract_all(chunk, F.lit(ENTITY_PATTERN), 0)
    empty_f = F.array().cast("array<struct<name:string,axis:string>>")
    empty_m = F.create_map().cast("map<string,string>")
    if single_label is None:
        lbl = lambda n: F.when(F.size(F.split(n, " ")) == 1, F.lit("Term")).otherwise(F.lit("Name"))
    else:
        lbl = lambda n: F.lit(single_label)
    ents = F.transform(names, lambda n: F.struct(n.alias("name"), lbl(n).alias("label"),
                                                 empty_f.alias("facets"), empty_m.alias("attrs")))
    # Neighbours are paired array by array: inside a lambda the names would be searched for again for every relation.
    n = F.greatest(F.size(names) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(names, 1, n), F.slice(names, 2, n), lambda a, b: F.struct(
        a.alias("source"), b.alias("target"), F.lit(RULE_RELATION).alias("label"), F.lit(RULE_AXIS).alias("axis"), empty_m.alias("attrs")))
    rels = F.coalesce(pairs, F.array().cast(f"array<{RELATION_T}>"))
    return ents, rels


def extract_elements(chunks: DataFrame, extractor=None, single_label: str | None = None,
                     doc_col: str = "doc_id") -> DataFrame:
    """H4/K1: chunk rows -> (doc, chunk_idx, entities, relations).

    ``extractor=None`` uses :func:`rule_extract` (no Python). Otherwise
    ``extractor(text) -> dict | JSON str`` is applied per chunk inside
    ``mapInPandas`` (Arrow batches, one call per chunk, parallel across
    partitions)."""
    if extractor is None:
        ents, rels = rule_extract(F.col("chunk"), single_label)
        return chunks.select(doc_col, "chunk_idx", ents.alias("entities"), rels.alias("relations"))

    schema = (f"{doc_col} {dict(chunks.dtypes)[doc_col]}, chunk_idx int, "
              f"entities array<{ENTITY_T}>, relations array<{RELATION_T}>")

    def run(batches):
        import pandas as pd
        for pdf in batches:
            ents, rels = [], []
            for text in pdf["chunk"]:
                out = extractor(text)
                if isinstance(out, str):
                    out = json.loads(out)
                out = out or {}
                ents.append([{"name": e.get("name"), "label": e.get("label"),
                              "facets": [{"name": f.get("name"), "axis": f.get("axis")}
                                         for f in (e.get("facets") or [])],
                              "attrs": {str(k): json.dumps(v) for k, v in (e.get("attrs") or {}).items()}}
                             for e in (out.get("entities") or [])])
                rels.append([{"source": r.get("source"), "target": r.get("target"), "label": r.get("label"),
                              "axis": r.get("axis"),
                              "attrs": {str(k): json.dumps(v) for k, v in (r.get("attrs") or {}).items()}}
                             for r in (out.get("relations") or [])])
            yield pd.DataFrame({doc_col: pdf[doc_col], "chunk_idx": pdf["chunk_idx"].astype("int32"),
                                "entities": ents, "relations": rels})

    return chunks.select(doc_col, "chunk_idx", "chunk").mapInPandas(run, schema)


def entity_rows(elements: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Explode entities with their order (chunk_idx, pos); blank names
    dropped; name/label stripped."""
    ex = elements.select(doc_col, "chunk_idx", F.posexplode("entities").alias("pos", "e"))
    return (ex.select(doc_col, "chunk_idx", "pos",
                      python_strip(F.coalesce(F.col("e.name"), F.lit(""))).alias("name"),
                      python_strip(F.coalesce(F.col("e.label"), F.lit(""))).alias("label"),
                      F.col("e.facets").alias("facets"), F.col("e.attrs").alias("attrs"))
            .filter(F.col("name") != ""))


def merge_entities(elements: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """H5: per document, one entity per lower-cased name: NODE = first-seen
    spelling; first non-empty label and facets; attrs first-seen wins per key.
    Columns doc, cid (canonical id of the name), NODE, name, label, facets,
    attrs. Names decide what is merged; the (short) id is output only."""
    e = entity_rows(elements, doc_col).withColumn("_key", F.lower("name")) \
        .withColumn("_ord", F.struct("chunk_idx", "pos"))
    base = e.groupBy(doc_col, "_key").agg(
        F.min("_ord").alias("_first"),
        F.min_by("name", "_ord").alias("NODE"),
        F.expr("min_by(label, _ord) FILTER (WHERE label <> '')").alias("label"),
        F.expr("min_by(facets, _ord) FILTER (WHERE size(facets) > 0)").alias("facets"))
    kv = (e.select(doc_col, "_key", "_ord", F.explode("attrs").alias("k", "v"))
          .groupBy(doc_col, "_key", "k").agg(F.min_by("v", "_ord").alias("v"))
          .groupBy(doc_col, "_key").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attrs")))
    return (base.join(kv, [doc_col, "_key"], "left")
            .select(doc_col, canonical_id(F.col("NODE")).alias("cid"), "_first", "NODE", F.col("NODE").alias("name"),
                    F.coalesce("label", F.lit("")).alias("label"),
                    F.coalesce("facets", F.array().cast("array<struct<name:string,axis:string>>")).alias("facets"),
                    F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs")))


def link_relations(elements: DataFrame, entities: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """H6: resolve relation endpoints by exact (stripped) spelling among the
    SAME chunk's entity names; dangling relations are dropped. Endpoint ids
    are the merged NODE of the lower-cased name.
    Columns doc, chunk_idx, rpos, src, dst, label, axis, attrs."""
    r = elements.select(doc_col, "chunk_idx", F.posexplode("relations").alias("rpos", "r"))
    r = r.select(doc_col, "chunk_idx", "rpos",
                 python_strip(F.coalesce(F.col("r.source"), F.lit(""))).alias("s_name"),
                 python_strip(F.coalesce(F.col("r.target"), F.lit(""))).alias("t_name"),
                 python_strip(F.coalesce(F.col("r.label"), F.lit(""))).alias("label"),
                 F.nullif(python_strip(F.coalesce(F.col("r.axis"), F.lit(""))), F.lit("")).alias("axis"),
                 F.coalesce(F.col("r.attrs"), F.create_map().cast("map<string,string>")).alias("attrs"))
    names = entity_rows(elements, doc_col).select(doc_col, "chunk_idx", "name").distinct()
    r = (r.join(names.withColumnRenamed("name", "s_name"), [doc_col, "chunk_idx", "s_name"], "left_semi")
          .join(names.withColumnRenamed("name", "t_name"), [doc_col, "chunk_idx", "t_name"], "left_semi"))
    ids = entities.select(doc_col, F.lower("NODE").alias("_key"), "NODE")
    r = (r.withColumn("_s", F.lower("s_name")).withColumn("_t", F.lower("t_name"))
          .join(ids.withColumnRenamed("_key", "_s").withColumnRenamed("NODE", "src"), [doc_col, "_s"])
          .join(ids.withColumnRenamed("_key", "_t").withColumnRenamed("NODE", "dst"), [doc_col, "_t"]))
    return r.select(doc_col, "chunk_idx", "rpos", "src", "dst", "label", "axis", "attrs")


def _first_relations(rows: DataFrame, doc_col: str) -> DataFrame:
    """The first row of each (src, dst, label) of a document, with its id."""
    first = rows.groupBy(doc_col, "src", "dst", "label").agg(
        F.min_by(F.struct("axis", "attrs", "_ord"), "_ord").alias("x"))
    return first.select(doc_col, relation_id("src", "dst", "label").alias("id"), "src", "dst", "label",
                        "x.axis", "x.attrs", "x._ord")


def merge_relations(links: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """H7: one relation per (src, dst, label), first occurrence wins;
    id = sha1(src|dst|label)[:16] is output only."""
    return _first_relations(links.withColumn("_ord", F.struct("chunk_idx", "rpos")), doc_col)


def fold_partial_names(entities: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """H8: rename map (doc, short NODE -> long NODE): a one-token name folds
    into the UNIQUE same-label name of several tokens whose last token equals
    it case-insensitively; zero or several candidates -> no fold.

    The long side is first aggregated per (doc, label, last token) -> count
    and the single candidate, so no pairs are formed."""
    toks = F.split(python_strip(F.col("NODE")), r"(?U)\s+")
    e = entities.select(doc_col, "label", "NODE", toks.alias("_t"))
    short = e.filter(F.size("_t") == 1).select(doc_col, "label", F.col("NODE").alias("short"),
                                                F.lower(F.try_element_at("_t", F.lit(1))).alias("_k"))
    long_ = (e.filter(F.size("_t") > 1)
             .groupBy(doc_col, "label", F.lower(F.try_element_at("_t", F.lit(-1))).alias("_k"))
             .agg(F.count(F.lit(1)).alias("_n"), F.min("NODE").alias("long")))
    j = short.join(long_, [doc_col, "label", "_k"]).filter(F.col("_n") == 1)
    return j.select(doc_col, "short", "long")


def apply_folds(entities: DataFrame, renames: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """H8 (entities): drop folded short entities; the long entity's attrs
    win over the short's, its facets are filled from the short if empty."""
    s = entities.join(renames.select(doc_col, F.col("short").alias("NODE"), "long"), [doc_col, "NODE"])
    s = s.select(doc_col, F.col("long").alias("NODE"), F.col("attrs").alias("_sattrs"),
                 F.col("facets").alias("_sfacets"))
    # Several shorts can fold into one long name (different tokens): merge
    # their attrs (first short by name wins among them) before the long.
    s = s.groupBy(doc_col, "NODE").agg(
        F.min_by("_sattrs", "NODE").alias("_sattrs"),
        F.expr("min_by(_sfacets, NODE) FILTER (WHERE size(_sfacets) > 0)").alias("_sfacets"))
    kept = entities.join(renames.select(doc_col, F.col("short").alias("NODE")), [doc_col, "NODE"], "left_anti")
    k = kept.join(s, [doc_col, "NODE"], "left")
    attrs = F.when(F.col("_sattrs").isNull(), F.col("attrs")).otherwise(
        F.map_concat(F.map_filter("_sattrs", lambda kk, v: ~F.array_contains(F.map_keys("attrs"), kk)),
                     F.col("attrs")))
    facets = F.when(F.size("facets") > 0, F.col("facets")).otherwise(
        F.coalesce("_sfacets", F.col("facets")))
    return k.select(*[c for c in entities.columns if c not in ("attrs", "facets")],
                    facets.alias("facets"), attrs.alias("attrs"))


def redirect_relations(relations: DataFrame, renames: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """H9: rewrite endpoints through the rename map; in documents with at
    least one rename drop self-loops and re-hash/dedupe (first wins);
    documents without renames are returned unchanged."""
    rn = renames.select(doc_col, "short", "long")
    docs_with = rn.select(doc_col).distinct().withColumn("_some", F.lit(True))
    r = splittable_join(relations, docs_with, [doc_col], "left")
    a = (r.filter("_some")
         .join(rn.withColumnRenamed("short", "src").withColumnRenamed("long", "_ns"), [doc_col, "src"], "left")
         .join(rn.withColumnRenamed("short", "dst").withColumnRenamed("long", "_nd"), [doc_col, "dst"], "left")
         .withColumn("src", F.coalesce("_ns", "src")).withColumn("dst", F.coalesce("_nd", "dst"))
         .filter(F.col("src") != F.col("dst")))
    a = _first_relations(a, doc_col)
    return r.filter("_some is null").select(*a.columns).unionByName(a)
