"""Column functions for labels, identifiers and ids (all JVM-side).

Every function here returns a ``Column`` built from ``pyspark.sql.functions``
so it stays inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
# Identifier rule for labels, relation types and property keys.
SAFE_IDENT_PATTERN = r"^[A-Za-z0-9_]+$"
# Table names may be schema-qualified.
SAFE_TABLE_PATTERN = r"^[A-Za-z0-9_.]+$"
# Default axes for node labels and edge types.
DEFAULT_NODE_AXIS = "EntityType"
DEFAULT_EDGE_AXIS = "RelationType"
# Label every loader-written node carries besides its own labels.
ENTITY_LABEL = "Entity"
# Canonical entity id: slug of the lower-cased name (runs outside [a-z0-9]
# become '-', edge dashes stripped) cut to 48 characters, '-', and the first
# 8 hex digits of sha1(lower-cased name).
SLUG_PATTERN = "[^a-z0-9]+"
SLUG_MAX = 48
NAME_HASH_LEN = 8
# Relation id: first 16 hex digits of sha1("src|dst|label").
RELATION_ID_LEN = 16
# Uri of a pasted text: "text:" + first 12 hex digits of its sha256.
TEXT_URI_PREFIX = "text:"
TEXT_URI_HASH_LEN = 12


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_labels(c) -> Column:
    """Label value (string or JSON-array string) -> ``array<string>``.

    null or '' -> []; '[...]' parsed as JSON (bad JSON -> [value]);
    any other string -> [value]; empty entries dropped.
    """
    v = _c(c)
    parsed = F.from_json(v, "array<string>")
    arr = (F.when(v.isNull() | (v == ""), F.array().cast("array<string>"))
           .when(F.ltrim(v).startswith("["), F.coalesce(parsed, F.array(v)))
           .otherwise(F.array(v)))
    return F.filter(arr, lambda x: x.isNotNull() & (x != ""))


def clean_label_array(c) -> Column:
    """Array input: keep it, drop null/empty entries; null -> []."""
    v = _c(c)
    return F.filter(F.coalesce(v, F.array().cast("array<string>")),
                    lambda x: x.isNotNull() & (x != ""))


def labels_to_json(c) -> Column:
    """Inverse of :func:`normalize_labels`: array -> JSON-array string."""
    return F.to_json(_c(c))


def structural_label(c) -> Column:
    """The structural label is the first entry of the label vector."""
    return F.try_element_at(_c(c), F.lit(1))


def display_label(labels, label_prop=None) -> Column:
    """LABEL property, else first label that is not ``Entity``, else first."""
    arr = _c(labels)
    not_entity = F.try_element_at(F.filter(arr, lambda x: x != F.lit(ENTITY_LABEL)), F.lit(1))
    out = F.coalesce(not_entity, F.try_element_at(arr, F.lit(1)))
    if label_prop is not None:
        out = F.coalesce(_c(label_prop), out)
    return out


def is_safe_ident(c) -> Column:
    v = _c(c)
    return v.isNotNull() & v.rlike(SAFE_IDENT_PATTERN)


def python_strip(c) -> Column:
    """Unicode-aware trim, like Python ``str.strip()``."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def canonical_id(name) -> Column:
    """``slug(lower(name))[:48] + '-' + sha1(lower(name))[:8]``.

    slug: runs of characters outside ``[a-z0-9]`` become '-', then
    leading/trailing '-' are stripped.
    """
    low = F.lower(_c(name))
    slug = F.regexp_replace(F.regexp_replace(low, SLUG_PATTERN, "-"), "^-+|-+$", "")
    return F.concat(F.substring(slug, 1, SLUG_MAX), F.lit("-"),
                    F.substring(F.sha1(low), 1, NAME_HASH_LEN))


def relation_id(src, dst, label) -> Column:
    """``sha1(src|dst|label)[:16]``."""
    return F.substring(F.sha1(F.concat_ws("|", _c(src), _c(dst), _c(label))), 1, RELATION_ID_LEN)


def fingerprint(text) -> Column:
    """sha256 hex of the UTF-8 text."""
    return F.sha2(_c(text), 256)


def text_uri(sha) -> Column:
    """Short uri of a pasted text for display: ``text:<sha[:12]>``."""
    return F.concat(F.lit(TEXT_URI_PREFIX), F.substring(_c(sha), 1, TEXT_URI_HASH_LEN))


def text_key(sha) -> Column:
    """Key of a pasted text: ``text:`` and its whole sha256."""
    return F.concat(F.lit(TEXT_URI_PREFIX), _c(sha))


def graph_key(graph) -> Column:
    """Store key of a graph: the last dotted part of its name."""
    return F.substring_index(_c(graph), ".", -1)
