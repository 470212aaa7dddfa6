"""Queries: documents -> elements (H1-H9) over the conversations table.

Documents are conversations with their turns joined by blank lines (turn
order); the extractor is the rule-based default.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import canonical_id
from ..operators import documents as D
from ..session import pinned
from .registry import query
from .tpch import read

def conversation_docs(spark, sf):
    """One document per conversation: turn texts joined with blank lines.
    A conversation is a bounded group (its turns)."""
    c = read(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]),
                     "\n\n").alias("text"))


DOCS_SQL = r"""
docs AS (SELECT conv_id AS doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn), '') AS text
         FROM conversations GROUP BY conv_id),
parts AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n+'),
                 lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM docs)
"""


DOCUMENTS_SQL = DOCS_SQL.replace(
    "FROM conversations GROUP BY conv_id",
    "FROM (SELECT doc_id AS conv_id, 0 AS turn, text FROM documents) GROUP BY conv_id")


def chunks_sql(docs_sql=DOCS_SQL):
    return docs_sql + r""",
chunks AS (SELECT doc_id, false AS truncated, unnest(ps) AS chunk, CAST(unnest(range(len(ps))) AS INTEGER) AS chunk_idx FROM parts)
"""


def ents_sql(single_label=None, docs_sql=DOCS_SQL):
    lbl = (f"'{single_label}'" if single_label else
           "CASE WHEN len(string_split(name, ' ')) = 1 THEN 'Term' ELSE 'Name' END")
    return chunks_sql(docs_sql) + rf""",
m AS (SELECT doc_id, chunk_idx, regexp_extract_all(chunk, '[A-Z][a-z]+(?: [A-Z][a-z]+)*') AS m FROM chunks),
ents AS (SELECT doc_id, chunk_idx, pos, name, {lbl} AS label,
                left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48)
                || '-' || left(sha1(lower(name)), 8) AS cid, lower(name) AS low
         FROM (SELECT doc_id, chunk_idx, unnest(m) AS name, CAST(unnest(range(len(m))) AS INTEGER) AS pos FROM m)),
merged AS (SELECT doc_id, low, min(cid) AS cid, arg_min(name, (chunk_idx, pos)) AS NODE,
                  arg_min(label, (chunk_idx, pos)) FILTER (WHERE label <> '') AS label
           FROM ents GROUP BY doc_id, low),
rels AS (SELECT a.doc_id, a.chunk_idx, a.pos AS rpos, a.name AS s_name, b.name AS t_name, a.low AS s_low, b.low AS t_low,
                'NEXT_TO' AS label
         FROM ents a JOIN ents b ON a.doc_id = b.doc_id AND a.chunk_idx = b.chunk_idx AND b.pos = a.pos + 1),
links AS (SELECT r.doc_id, r.chunk_idx, r.rpos, s.NODE AS src, t.NODE AS dst, r.label
          FROM rels r JOIN merged s ON s.doc_id = r.doc_id AND s.low = r.s_low
          JOIN merged t ON t.doc_id = r.doc_id AND t.low = r.t_low),
mrels AS (SELECT doc_id, id, arg_min(src, (chunk_idx, rpos)) AS src, arg_min(dst, (chunk_idx, rpos)) AS dst,
                 arg_min(label, (chunk_idx, rpos)) AS label, min((chunk_idx, rpos)) AS ord
          FROM (SELECT *, left(sha1(src || '|' || dst || '|' || label), 16) AS id FROM links) GROUP BY doc_id, id)
"""


def folds_sql(single_label, docs_sql=DOCUMENTS_SQL):
    return ents_sql(single_label, docs_sql) + r""",
toks AS (SELECT doc_id, label, NODE, string_split(NODE, ' ') AS t FROM merged),
shorts AS (SELECT doc_id, label, NODE AS short, lower(t[1]) AS k FROM toks WHERE len(t) = 1),
longs AS (SELECT doc_id, label, lower(t[len(t)]) AS k, COUNT(*) AS n, min(NODE) AS long FROM toks
          WHERE len(t) > 1 GROUP BY doc_id, label, lower(t[len(t)])),
renames AS (SELECT s.doc_id, s.short, l.long FROM shorts s JOIN longs l
            ON l.doc_id = s.doc_id AND l.label = s.label AND l.k = s.k WHERE l.n = 1)
"""


def text_docs(spark, sf):
    """The documents table as (doc_id, text)."""
    return read(spark, sf, "documents").select("doc_id", "text")


def conversation_chunks(spark, sf):
    """Chunks of the conversation documents computed from the turns (the
    documents are never assembled)."""
    c = read(spark, sf, "conversations").withColumnRenamed("conv_id", "doc_id")
    return D.chunk_turns(c, "doc_id", "turn")


def _elements(spark, sf, single_label=None, docs=None):
    ch = conversation_chunks(spark, sf) if docs is None else D.chunk_documents(docs)
    return D.extract_elements(ch, single_label=single_label)


def _merged(spark, sf, single_label=None, docs=None):
    """(elements, merged entities), each worked out and written once: both are
    read several times by what links and folds them."""
    el, _ = pinned(_elements(spark, sf, single_label, docs), "elements")
    ents, _ = pinned(D.merge_entities(el), "entities")
    return el, ents


@query("chunk_documents", "WITH " + chunks_sql() + """
SELECT doc_id, chunk_idx, chunk, truncated FROM chunks
""")
def q_chunk_documents(spark, sf):
    out = conversation_chunks(spark, sf)
    return out.select("doc_id", "chunk_idx", "chunk", "truncated")


@query("chunk_modes", "WITH " + DOCS_SQL + r"""
SELECT 'whole' AS mode, doc_id, CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' THEN 1 ELSE 0 END AS n_chunks,
       false AS truncated FROM docs
UNION ALL SELECT 'bogus', doc_id, len(ps), false FROM parts
UNION ALL SELECT 'capped', doc_id, least(len(ps), 4), len(ps) > 4 FROM parts
""")
def q_chunk_modes(spark, sf):
    docs = conversation_docs(spark, sf)
    out = None
    for mode, cap in (("whole", None), ("bogus", None), ("capped", 4)):
        ch = D.chunk_documents(docs, mode=mode, max_chunks=cap)
        per = docs.select("doc_id").join(
            ch.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("truncated").alias("truncated")),
            "doc_id", "left").select(F.lit(mode).alias("mode"), "doc_id",
                                     F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
                                     F.coalesce("truncated", F.lit(False)).alias("truncated"))
        out = per if out is None else out.unionByName(per)
    return out


@query("canonical_id", "WITH " + ents_sql() + """
SELECT DISTINCT name, cid FROM ents
""")
def q_canonical_id(spark, sf):
    el = _elements(spark, sf)
    e = D.entity_rows(el)
    return e.select("name", canonical_id("name").alias("cid")).distinct()


@query("extract_elements", "WITH " + ents_sql() + """
SELECT 'entity' AS kind, doc_id, chunk_idx, pos, name, label, NULL AS target FROM ents
UNION ALL SELECT 'relation', doc_id, chunk_idx, rpos, s_name, label, t_name FROM rels
""")
def q_extract_elements(spark, sf):
    el = _elements(spark, sf)
    e = el.select("doc_id", "chunk_idx", F.posexplode("entities").alias("pos", "x")).select(
        F.lit("entity").alias("kind"), "doc_id", "chunk_idx", "pos", F.col("x.name").alias("name"),
        F.col("x.label").alias("label"), F.lit(None).cast("string").alias("target"))
    r = el.select("doc_id", "chunk_idx", F.posexplode("relations").alias("pos", "x")).select(
        F.lit("relation").alias("kind"), "doc_id", "chunk_idx", "pos", F.col("x.source").alias("name"),
        F.col("x.label").alias("label"), F.col("x.target").alias("target"))
    return e.unionByName(r)


@query("merge_entities", "WITH " + ents_sql() + """
SELECT doc_id, cid, NODE, coalesce(label, '') AS label FROM merged
""")
def q_merge_entities(spark, sf):
    return D.merge_entities(_elements(spark, sf)).select("doc_id", "cid", "NODE", "label")


@query("link_relations", "WITH " + ents_sql() + """
SELECT doc_id, chunk_idx, rpos, src, dst, label FROM links
""")
def q_link_relations(spark, sf):
    return D.link_relations(*_merged(spark, sf)).select("doc_id", "chunk_idx", "rpos", "src", "dst", "label")


@query("merge_relations", "WITH " + ents_sql() + """
SELECT doc_id, id, src, dst, label FROM mrels
""")
def q_merge_relations(spark, sf):
    r = D.merge_relations(D.link_relations(*_merged(spark, sf)))
    return r.select("doc_id", "id", "src", "dst", "label")


@query("fold_partial_names", "WITH " + folds_sql("Entity") + """
SELECT doc_id, short, long FROM renames
""")
def q_fold_partial_names(spark, sf):
    ents = D.merge_entities(_elements(spark, sf, single_label="Entity", docs=text_docs(spark, sf)))
    return D.fold_partial_names(ents)


@query("redirect_relations", "WITH " + folds_sql("Entity") + """,
docs_with AS (SELECT DISTINCT doc_id FROM renames),
moved AS (SELECT r.doc_id, coalesce(a.long, r.src) AS src, coalesce(b.long, r.dst) AS dst, r.label, r.ord
          FROM mrels r LEFT JOIN renames a ON a.doc_id = r.doc_id AND a.short = r.src
          LEFT JOIN renames b ON b.doc_id = r.doc_id AND b.short = r.dst
          WHERE r.doc_id IN (SELECT doc_id FROM docs_with)),
redone AS (SELECT doc_id, id, arg_min(src, ord) AS src, arg_min(dst, ord) AS dst, arg_min(label, ord) AS label
           FROM (SELECT *, left(sha1(src || '|' || dst || '|' || label), 16) AS id FROM moved WHERE src <> dst)
           GROUP BY doc_id, id)
SELECT doc_id, id, src, dst, label FROM redone
UNION ALL SELECT doc_id, id, src, dst, label FROM mrels WHERE doc_id NOT IN (SELECT doc_id FROM docs_with)
""")
def q_redirect_relations(spark, sf):
    el, ents = _merged(spark, sf, single_label="Entity", docs=text_docs(spark, sf))
    rels, _ = pinned(D.merge_relations(D.link_relations(el, ents)), "relations")
    out = D.redirect_relations(rels, D.fold_partial_names(ents))
    return out.select("doc_id", "id", "src", "dst", "label")
