"""The registered queries of the numbered operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, license_scan, merkle, ngram_join, prefix_trie, quality, secrets, sharding, token_store, toxicity, url_filter
from .shared import documents, scratch

#: Vocabulary file of the tokenizer operators (any byte-level BPE file works).
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


_WORD = r"[^\x20\x09-\x0D]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_register(rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] for i in range(1, len(ws) - 2)]) END AS gs FROM w),
s AS (SELECT doc_id, unnest(gs) AS g FROM g),
n AS (SELECT doc_id, len(gs) AS n FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.y) AS component_id FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
""")
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir), percent=85, k=4).select("doc_id", "n_shingles", "component_id")


@_register()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


@_register()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(documents(spark, sf_dir), trusted)


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_RULE = "CASE " + " ".join(
    f"WHEN {_FITS.format(h, p)} THEN '{h}{p}'" for _, h, p in sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN rule = '{h}{p}' THEN '{a}'" for a, h, p in url_filter.RULES) + " ELSE 'allow' END"


@_register(rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {_RULE} AS rule FROM p)
SELECT *, {_VERDICT} AS verdict FROM r
""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge_urls(pages, url_filter.rules_frame(spark))


def _secret_sql() -> str:
    """Spans of every rule, in DuckDB: lengths of the pieces between matches and of the matches, summed up."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, {i} AS rank, '{r.kind}' AS kind,
       list_sum([length(x) for x in gaps[:k]]) + coalesce(list_sum([length(x) for x in ms[:k - 1]]), 0) AS a, ms[k] AS m
FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')))
WHERE length(regexp_extract(ms[k], '{pattern}', {r.group})) >= {r.least}""")
    said = "string_agg(kind || ':' || a || ':' || (a + length(m)), ',' ORDER BY a, rank)"
    base = [(i, r) for i, r in enumerate(secrets.RULES) if r.base]
    only = f"rank IN ({', '.join(str(i) for i, _ in base)})"
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce({said} FILTER ({only}), '')) AS base_sha256, coalesce({said}, '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


@_register(_secret_sql())
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(documents(spark, sf_dir))


@_register()
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_register()
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_store.write_tokens(documents(spark, sf_dir), path, VOCABULARY, end_id=0)
    return token_store.read_tokens(spark, path, digests=True)


@_register()
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir)).drop("spans")


@_register()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard_rows(documents(spark, sf_dir), shards=16)
            .withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}))


@_register()
def op10_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(documents(spark, sf_dir), VOCABULARY)


@_register()
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


# crc32 by its table of 256 remainders, which SQL works out first.
_CRC_TABLE = ("SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], "
              "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab")


def _crc(decimal: str) -> str:
    """Unsigned crc32 of ASCII text, beside the column ``tab``."""
    codes = f"list_prepend(4294967295::BIGINT, list_transform(string_split({decimal}, ''), lambda x: ord(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle_sql(levels: int = 6) -> str:
    """The manifest of up to 16 ** levels rows a source, one step a level."""
    hashed = " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {{{f}}}::VARCHAR, '-')" for f in merkle.FIELDS)
    leaf = f"sha256({hashed.format(**{f: f for f in merkle.FIELDS})})"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    forged = f"sha256({hashed.format(**{f: f for f in merkle.FIELDS} | {'text': lowered})})"

    def climb(name: str) -> str:
        out = []
        for k in range(levels):
            out.append(f"{name}r{k} AS (SELECT t, idx // 16 AS idx, string_agg(h, '' ORDER BY idx) AS run, n FROM {name}{k} WHERE n > {16 ** k} GROUP BY t, idx // 16, n)")
            out.append(f"{name}{k + 1} AS (SELECT t, idx, sha256(run) AS h, n FROM {name}r{k})")
        tops = " UNION ALL ".join(f"SELECT t, h FROM {name}{k} WHERE n <= {16 ** k}" for k in range(levels + 1))
        return ", ".join([*out, f"{name}top AS ({tops})"])

    def walk(name: str, start: str, t: str, i: str) -> str:
        out, before = [], start
        for k in range(levels):
            p = f"64 * (({i} // {16 ** k}) % 16)"
            now = f"{name}w{k}"
            out.append(f"""{now} AS (SELECT f.* REPLACE (f.proof || coalesce(left(r.run, {p}) || substr(r.run, {p} + 65), '') AS proof,
                CASE WHEN r.run IS NULL THEN f.x ELSE sha256(left(r.run, {p}) || f.x || substr(r.run, {p} + 65)) END AS x)
                FROM {before} f LEFT JOIN {name}r{k} r ON r.t = {t} AND r.idx = {i} // {16 ** (k + 1)})""")
            before = now
        return ", ".join(out)

    return f"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {_crc('doc_id::VARCHAR')} % 5 = 0 THEN {forged} ELSE {leaf} END AS x FROM documents, crc),
g AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
      count(*) OVER (PARTITION BY source) AS n FROM d),
a0 AS (SELECT t, i AS idx, leaf AS h, n FROM g), {climb('a')},
b0 AS (SELECT 0 AS t, t AS idx, h, (SELECT count(*) FROM atop) AS n FROM atop), {climb('b')},
s AS (SELECT doc_id, leaf, t, i, x, '' AS proof FROM g), {walk('a', 's', 'f.t', 'f.i')}, {walk('b', f'aw{levels - 1}', '0', 'f.t')}
SELECT w.doc_id, w.leaf, atop.h AS subroot, btop.h AS root, sha256(w.proof) AS proof_sha256, w.x AS folded_root, w.x = btop.h AS verified
FROM bw{levels - 1} w JOIN atop ON atop.t = w.t, btop
"""


@_register(_merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_rows(documents(spark, sf_dir))


@_register(f"""
WITH crc AS ({_CRC_TABLE}),
c AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 32)) AS s
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, s, c - c % 5 AS b, {_crc('c::VARCHAR')} % 9 AS h FROM c, crc),
r AS (SELECT h.c, list_concat(list_slice(coalesce(b.s, []), 1, h.h), list_slice(h.s, h.h + 1, len(h.s))) AS s FROM h LEFT JOIN c b ON b.c = h.b),
p AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r),
n AS (SELECT list_slice(s, 1, d) AS k, d, min(c) AS conv, count(*) AS n,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends FROM p GROUP BY 1, 2),
u AS (SELECT list_slice(k, 1, d - 1) AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(u.kids, 0) AS kids, CASE WHEN n.d > 0 THEN (n.n - 1) * strlen(n.k[n.d].x) ELSE 0 END AS saved FROM n LEFT JOIN u ON u.k = n.k),
a AS (SELECT list_slice(k, 1, e) AS k, sum((kids = 0)::INT) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1)
SELECT f.conv AS conv_id, f.d AS depth, q.conv AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, a.leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN a ON a.k = f.k LEFT JOIN n q ON f.d > 0 AND q.k = list_slice(f.k, 1, f.d - 1)
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
