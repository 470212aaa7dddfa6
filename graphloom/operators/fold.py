"""Ontology folding.

The ontology ledger is a table ``graph, type_kind, type_name,
canonical_name, axis, first_seen_uri, first_seen_ts`` (PK graph, type_kind,
type_name; a row is canonical iff type_name = canonical_name).

Folding a batch works on the DISTINCT proposed names (small next to the
elements), resolves them with joins, and maps the elements back with one
join per label role, so the per-name logic never runs per element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import DEFAULT_EDGE_AXIS, DEFAULT_NODE_AXIS, python_strip

ONTOLOGY_SCHEMA = ("graph string, type_kind string, type_name string, canonical_name string, "
                   "axis string, first_seen_uri string, first_seen_ts timestamp")
SYNONYM_SCHEMA = "type_kind string, name string, target string"


def resolve_canonical(onto: DataFrame, graph: str, kind: str | None, names: DataFrame,
                      name_col: str = "name", kind_col: str | None = None) -> DataFrame:
    """Name -> canonical; exact type_name match beats a case-insensitive
    one (ties among case-insensitive matches: smallest type_name); scoped by
    (graph, kind); unknown -> null. Returns names' columns + ``canonical``."""
    o = onto.filter(F.col("graph") == graph)
    if kind is not None:
        o = o.filter(F.col("type_kind") == kind)
    o = o.select(F.col("type_kind").alias("_k"), F.lower("type_name").alias("_l"),
                 F.col("type_name").alias("_tn"), F.col("canonical_name").alias("_cn"))
    n = names.withColumn("_l", F.lower(F.col(name_col)))
    cond = [n["_l"] == o["_l"]]
    if kind_col is not None:
        cond.append(n[kind_col] == o["_k"])
    j = n.join(o, cond, "left").drop(o["_l"])
    rank = F.struct((F.col("_tn") != F.col(name_col)).alias("_ne"), F.col("_tn"))
    keys = [c for c in names.columns]
    return (j.groupBy(*keys).agg(F.min_by("_cn", F.when(F.col("_tn").isNotNull(), rank)).alias("canonical")))


def record_types(onto: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert (graph, kind, name) -> (canonical, axis, uri, ts); first
    seen wins both against the ledger (existing rows untouched) and inside
    the batch (by ``ord``). Returns the new ledger."""
    key = ["graph", "type_kind", "type_name"]
    first = batch.groupBy(*key).agg(F.min_by(
        F.struct("canonical_name", "axis", "first_seen_uri", "first_seen_ts"), "ord").alias("x"))
    first = first.select(*key, "x.*")
    new = first.join(onto.select(*key), key, "left_anti")
    return onto.unionByName(new.select(*onto.columns))


def get_canonicals(onto: DataFrame, graph: str, kind: str) -> DataFrame:
    """Distinct canonicals of (graph, kind)."""
    return (onto.filter((F.col("graph") == graph) & (F.col("type_kind") == kind))
            .select(F.col("canonical_name").alias("canonical")).distinct())


def axis_map(onto: DataFrame, graph: str, kind: str) -> DataFrame:
    """I8: type name -> axis."""
    return (onto.filter((F.col("graph") == graph) & (F.col("type_kind") == kind))
            .select("type_name", "axis"))


def synonym_match(unresolved: DataFrame, canon: DataFrame, synonyms: DataFrame | None = None,
                  synonym_fn=None) -> DataFrame:
    """Synonym decision for unresolved names (type_kind, name) ->
    ``target`` that must be one of the canonicals existing before the call
    (``canon``: type_kind, canonical); anything else -> null. Default: a
    synonym table join; ``synonym_fn(kind, name) -> str | None`` is a user
    function run with ``mapInPandas`` over the distinct names only (errors ->
    null). Nothing is asked when a kind has no canonicals."""
    u = unresolved.select("type_kind", "name").distinct().join(
        canon.select("type_kind").distinct(), "type_kind", "left_semi")
    if synonym_fn is not None:
        def run(batches):
            import pandas as pd
            for pdf in batches:
                out = []
                for k, n in zip(pdf["type_kind"], pdf["name"]):
                    try:
                        t = synonym_fn(k, n)
                        out.append(None if t is None else str(t))
                    except Exception:  # noqa: BLE001 - any error means "no fold"
                        out.append(None)
                yield pd.DataFrame({"type_kind": pdf["type_kind"], "name": pdf["name"], "target": out})
        cand = u.mapInPandas(run, SYNONYM_SCHEMA)
    elif synonyms is not None:
        cand = u.join(synonyms.select("type_kind", "name", "target"), ["type_kind", "name"])
    else:
        cand = u.withColumn("target", F.lit(None).cast("string"))
    valid = cand.join(canon.select("type_kind", F.col("canonical").alias("target")),
                      ["type_kind", "target"], "left_semi")
    return valid.groupBy("type_kind", "name").agg(F.min("target").alias("target"))


def proposals(entities: DataFrame, relations: DataFrame | None) -> DataFrame:
    """All label names a batch proposes, in processing order: per entity its
    structural label then its facets; relations after all entities.
    Columns type_kind, name, axis, ord (struct). Blank names skipped."""
    e = entities.select("_ord", python_strip(F.coalesce("label", F.lit(""))).alias("name"), "facets")
    s = e.select(F.lit("entity").alias("type_kind"), "name", F.lit(DEFAULT_NODE_AXIS).alias("axis"),
                 F.struct(F.lit(0).alias("part"), F.col("_ord").alias("o"), F.lit(-1).alias("f")).alias("ord"))
    f = e.select("_ord", F.posexplode(F.coalesce("facets", F.array().cast(
        "array<struct<name:string,axis:string>>"))).alias("fi", "x"))
    f = f.select(F.lit("entity").alias("type_kind"), python_strip(F.coalesce("x.name", F.lit(""))).alias("name"),
                 F.coalesce(F.nullif(python_strip(F.coalesce("x.axis", F.lit(""))), F.lit("")),
                            F.lit(DEFAULT_NODE_AXIS)).alias("axis"),
                 F.struct(F.lit(0).alias("part"), F.col("_ord").alias("o"), F.col("fi").alias("f")).alias("ord"))
    out = s.unionByName(f)
    if relations is not None:
        r = relations.select(F.lit("relation").alias("type_kind"),
                             python_strip(F.coalesce("label", F.lit(""))).alias("name"),
                             F.coalesce(F.nullif(python_strip(F.coalesce("axis", F.lit(""))), F.lit("")),
                                        F.lit(DEFAULT_EDGE_AXIS)).alias("axis"),
                             F.struct(F.lit(1).alias("part"), F.col("_ord").alias("o"), F.lit(-1).alias("f")).alias("ord"))
        out = out.unionByName(r)
    return out.filter(F.col("name") != "")


def fold_names(onto: DataFrame, graph: str, props: DataFrame, uri: str, ts,
               synonyms: DataFrame | None = None, synonym_fn=None):
    """I4 core: distinct proposed (kind, name) -> canonical.

    1. ledger hit (exact beats case-insensitive) -> that canonical;
    2. otherwise names are grouped by lower(name): the first spelling in call
       order (the leader) is checked against the canonicals that existed
       BEFORE the call (I5) and becomes a new canonical if none fits; later
       spellings of the same group resolve to the leader's canonical;
    3. leaders are recorded in the ledger (first seen wins).
    Returns (mapping[type_kind, name, canonical, axis], new ledger)."""
    names = props.groupBy("type_kind", "name").agg(F.min_by("axis", "ord").alias("axis"),
                                                   F.min("ord").alias("ord"))
    pre = resolve_canonical(onto, graph, None, names.select("type_kind", "name"),
                            name_col="name", kind_col="type_kind")
    names = names.join(pre, ["type_kind", "name"])
    hit = names.filter(F.col("canonical").isNotNull())
    miss = names.filter(F.col("canonical").isNull()).drop("canonical")
    grp = miss.groupBy("type_kind", F.lower("name").alias("_l")).agg(
        F.min_by("name", "ord").alias("leader"))
    canon = (onto.filter(F.col("graph") == graph)
             .select("type_kind", F.col("canonical_name").alias("canonical")).distinct())
    syn = synonym_match(grp.select("type_kind", F.col("leader").alias("name")), canon, synonyms, synonym_fn)
    grp = (grp.join(syn.withColumnRenamed("name", "leader"), ["type_kind", "leader"], "left")
           .withColumn("gcanon", F.coalesce("target", "leader")))
    miss = (miss.join(grp.select("type_kind", "_l", "leader", "gcanon"),
                      (miss.type_kind == grp.type_kind) & (F.lower(miss.name) == grp._l))
            .drop(grp.type_kind))
    resolved = miss.select("type_kind", "name", F.col("gcanon").alias("canonical"), "axis", "ord",
                           (F.col("name") == F.col("leader")).alias("_leader"))
    decided = (hit.select("type_kind", "name", "canonical", "axis", "ord", F.lit(False).alias("_leader"))
               .unionByName(resolved))
    # One decision per distinct proposed name, pinned once: the entity and
    # relation rewrites and the new ledger all read it, and a synonym
    # function is never asked twice.
    from ..session import cut_lineage
    decided = cut_lineage(decided)
    mapping = decided.select("type_kind", "name", "canonical", "axis")
    rec = decided.filter("_leader").select(
        F.lit(graph).alias("graph"), "type_kind", F.col("name").alias("type_name"),
        F.col("canonical").alias("canonical_name"), "axis", F.lit(uri).alias("first_seen_uri"),
        F.lit(ts).cast("timestamp").alias("first_seen_ts"), "ord")
    return mapping, record_types(onto, rec)


def fold_labels(onto: DataFrame, graph: str, entities: DataFrame, relations: DataFrame | None,
                uri: str, ts, synonyms: DataFrame | None = None, synonym_fn=None):
    """I4 + I6: rewrite entity labels, facets and relation labels to their
    canonicals and build the label vectors.

    ``entities``: any columns + label, facets (array<struct<name,axis>>) and
    ``_ord`` (processing order); ``relations``: label, axis, ``_ord``.
    Returns (entities + labels/label_raw, relations, mapping, new ledger)."""
    props = proposals(entities, relations)
    mapping, new_onto = fold_names(onto, graph, props, uri, ts, synonyms, synonym_fn)
    ent_map = mapping.filter(F.col("type_kind") == "entity").select("name", "canonical")
    e = label_vectors(entities, ent_map)
    r = None
    if relations is not None:
        rel_map = mapping.filter(F.col("type_kind") == "relation").select(
            F.col("name").alias("_n"), F.col("canonical").alias("_c"))
        r = (relations.withColumn("_n", python_strip(F.coalesce("label", F.lit(""))))
             .join(rel_map, "_n", "left")
             .withColumn("label", F.coalesce("_c", F.col("_n"))).drop("_n", "_c"))
    return e, r, mapping, new_onto


def label_vectors(entities: DataFrame, ent_map: DataFrame) -> DataFrame:
    """labels = distinct([structural canonical] + facet canonicals) in
    order; label_raw = all pre-fold names; blanks skipped. The name map is
    joined once per exploded label (bounded per entity). Entities are told
    apart by their document (where there is one) and ``_ord``."""
    ids = [c for c in entities.columns]
    key = [c for c in ("doc_id", "_ord") if c in ids]
    e = entities
    raw = F.concat(F.array(python_strip(F.coalesce("label", F.lit("")))),
                   F.transform(F.coalesce("facets", F.array().cast("array<struct<name:string,axis:string>>")),
                               lambda x: python_strip(F.coalesce(x["name"], F.lit("")))))
    x = e.select(*key, F.posexplode(raw).alias("i", "n")).filter(F.col("n") != "")
    x = x.join(ent_map.select(F.col("name").alias("n"), F.col("canonical").alias("c")), "n", "left")
    v = x.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "n", F.coalesce("c", "n").alias("c"))))
                              .alias("_v"))
    v = v.select(*key, F.array_distinct(F.transform("_v", lambda s: s["c"])).alias("labels"),
                 F.transform("_v", lambda s: s["n"]).alias("label_raw"),
                 F.filter("_v", lambda s: s["i"] == 0).alias("_s"))
    out = entities.join(v, key, "left")
    struct_canon = F.try_element_at(F.transform("_s", lambda s: s["c"]), F.lit(1))
    return out.select(*[c for c in ids if c != "label"],
                      F.coalesce(struct_canon, python_strip(F.coalesce("label", F.lit("")))).alias("label"),
                      F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
                      F.coalesce("label_raw", F.array().cast("array<string>")).alias("label_raw"))


def fold_report(mapping: DataFrame) -> DataFrame:
    """One row per (kind, name) whose canonical differs."""
    return (mapping.filter(F.col("canonical") != F.col("name"))
            .select(F.col("type_kind").alias("kind"), F.col("name").alias("from"),
                    F.col("canonical").alias("to"), "axis")
            .dropDuplicates(["kind", "from"]))
