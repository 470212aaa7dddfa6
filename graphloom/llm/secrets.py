"""Operator 5 (native): secret scans with a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the
(lower-cased) trigrams that every match must contain. The index has the
postings (document, trigram) of the queries' trigrams; intersecting them per
alternative of a query gives each rule's candidate documents, and only these
run the rule's expression. A rule without mandatory trigrams scans every
text. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STRINGS = 64  # strings followed exactly while a query is derived


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, the group whose length counts and its least length."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The base rules. Runs of hexadecimal digits are maximal, so their least length can stand in the pattern.
BASE_RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]
RULES = BASE_RULES + MORE_RULES

# A query is a set of alternatives, each a set of trigrams that must all be there; an empty alternative is always true.
Query = frozenset[frozenset[str]]
ALWAYS: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    every = a | b
    return frozenset(x for x in every if not any(y < x for y in every))


def _both(a: Query, b: Query) -> Query:
    return _either(frozenset(x | y for x, y in product(a, b)), frozenset())


def _of_strings(strings: set[str]) -> Query:
    q: Query = frozenset()
    for s in strings:
        q = _either(q, frozenset([frozenset(s[i:i + 3] for i in range(len(s) - 2))]))
    return q


def _strings(node) -> set[str] | None:
    """All strings of a parsed item, lower-cased, if they are few."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN" and all(str(x[0]) == "LITERAL" for x in arg):
        return {chr(x[1]).lower() for x in arg}
    if op == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if op == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and arg[1] == 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for x in items:
        s = _strings(x)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def _query(items) -> Query:
    q, run = ALWAYS, {""}
    for x in items:
        s = _strings(x)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        q, run = _both(q, _of_strings(run)), {""}
        op, arg = str(x[0]), x[1]
        if op == "SUBPATTERN":
            q = _both(q, _query(arg[3]))
        elif op == "BRANCH":
            inner: Query = frozenset()
            for branch in arg[1]:
                inner = _either(inner, _query(branch))
            q = _both(q, inner)
        elif op == "MAX_REPEAT" and arg[0] >= 1:
            q = _both(q, _query(arg[2]))
    return _both(q, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Trigrams that every match of ``pattern`` must contain, as alternatives."""
    return _query(re._parser.parse(pattern))


def candidates(docs: DataFrame, rules: list[Rule], id_col: str, text_col: str) -> DataFrame:
    """(id, rules): the documents in whose postings an alternative of an indexed rule is complete."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    wanted = [(r.kind, k, g, len(alt)) for r in rules if frozenset() not in queries[r.kind]
              for k, alt in enumerate(sorted(queries[r.kind], key=sorted)) for g in sorted(alt)]
    grams = sorted({w[2] for w in wanted})
    low = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col).cast("string")).alias("_low"))
    if not wanted:
        return low.select("_id", F.array().cast("array<string>").alias("_rules")).limit(0)
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = low.select("_id", F.explode(found).alias("gram"))
    query = docs.sparkSession.createDataFrame(wanted, "rule string, alternative int, gram string, size int")
    return (postings.join(F.broadcast(query), "gram").groupBy("_id", "rule", "alternative", "size")
            .agg(F.count_distinct("gram").alias("n")).filter("n = size")
            .groupBy("_id").agg(F.collect_set("rule").alias("_rules")))


BLOCK = 128     # items that are folded at a time


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """A bound array cut into arrays of ``BLOCK`` items."""
    starts = F.sequence(F.lit(0), F.floor(F.size(items) / BLOCK).cast("int"))
    return F.filter(F.transform(starts, lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK))), lambda x: F.size(x) > 0)


def _running(values: Column, join, zero: Column) -> Column:
    """What ``join`` (a sum or a maximum) makes of the integers before each
    one of a bound array.

    A fold copies the array that it builds at every step, so the values are
    folded in blocks, and the blocks' totals on their own."""
    none = F.array().cast("array<int>")

    def fold(block: Column) -> Column:
        start = F.struct(zero.alias("now"), none.alias("out"))
        return F.aggregate(block, start, lambda acc, v: F.struct(join(acc["now"], v).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")))

    def placed(folded: Column) -> Column:
        totals = fold(F.transform(folded, lambda f: f["now"]))["out"]
        return F.flatten(F.zip_with(folded, totals, lambda f, s: F.transform(f["out"], lambda v: join(s, v))))

    return _let(F.transform(_blocks(values), fold), placed)


def _spans(text: Column, rule: Rule) -> Column:
    """Spans (start, end in code points) of a rule's leftmost non-overlapping matches that are long enough."""
    between = F.transform(F.split(text, rule.pattern, -1), lambda p: F.char_length(p))
    match = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), 0), lambda m: F.struct(
        F.char_length(m).alias("n"), (F.char_length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least).alias("ok")))
    # The last gap has no match behind it.
    pairs = F.filter(F.zip_with(between, match, lambda g, m: F.struct(g.alias("gap"), m["n"].alias("n"), m["ok"].alias("ok"))), lambda x: x["n"].isNotNull())

    def placed(pairs: Column) -> Column:
        ends = _let(F.transform(pairs, lambda x: x["gap"] + x["n"]), lambda v: _running(v, lambda a, b: a + b, F.lit(0)))
        spans = F.zip_with(pairs, ends, lambda x, before: F.struct((before + x["gap"]).alias("start"), (before + x["gap"] + x["n"]).alias("end"), x["ok"].alias("ok")))
        return F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return _let(pairs, placed)


def _named(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc`` (the row as a struct), ``text`` (null as empty) and
    ``spans``: array of (start, rank of the kind, kind, end), ascending.
    Repeated or null ids keep their rows (an id's candidates hold for all its
    rows, every row is verified)."""
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cand = candidates(docs, rules, id_col, text_col)
    d = d.join(cand, d["id"].eqNullSafe(cand["_id"]), "left").select("doc", "text", F.coalesce("_rules", F.array().cast("array<string>")).alias("due"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    t, parts = F.col("text"), []
    for rank, r in enumerate(rules):
        due = F.lit(True) if frozenset() in trigram_query(r.pattern) else F.array_contains("due", r.kind)
        d = d.withColumn(f"s{rank}", F.when(due & t.rlike(r.pattern), _spans(t, r)).otherwise(none))
        parts.append(_named(F.col(f"s{rank}"), rank, r.kind))
    return d.select("doc", "text", F.sort_array(F.concat(*parts)).alias("spans"))


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_digests(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_<kind> of each base rule, base_sha256 (of
    the base spans as kind:start:end, by start, then kind) and spans (all).

    A null text is empty and has no span; repeated rows and null ids keep their
    rows; other columns are not read; an empty table gives no rows."""
    d = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rules)
    base = [i for i, r in enumerate(rules) if r.base]
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long").alias(f"n_{rules[i].kind}")
    of_base = F.filter("spans", lambda s: s["rank"].isin(base))
    return d.select(F.col("doc.doc_id").alias(id_col), *[count(i) for i in base],
                    F.sha2(_said(of_base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark`` (overlapping
    spans by one); all rows and columns stay, a null text stays null."""
    d = scan(docs, rules, id_col, text_col)
    t = F.col("text")
    # What stands before each span that is not inside an earlier one: from the last end to its start.
    ends = _let(F.transform("spans", lambda s: s["end"]), lambda v: _running(v, lambda a, b: F.greatest(a, b), F.lit(0)))
    cuts = F.filter(F.zip_with("spans", ends, lambda s, e: F.struct(e.alias("from"), s["start"].alias("to"))), lambda x: x["to"] >= x["from"])

    def pieces(block: Column) -> Column:
        """The pieces of a block of cuts, out of the part of the text that it spans."""
        at = F.element_at(block, 1)["from"]
        return _let(F.substring(t, at + 1, F.element_at(block, -1)["to"] - at), lambda part: F.transform(
            block, lambda x: F.substring(part, x["from"] - at + 1, x["to"] - x["from"])))

    d = d.withColumn("_last", F.aggregate("spans", F.lit(0), lambda a, s: F.greatest(a, s["end"])))
    kept = _let(cuts, lambda c: F.flatten(F.transform(_blocks(c), pieces)))
    rest = F.concat(F.array_join(kept, mark), F.lit(mark), F.substring(t, F.col("_last") + 1, F.char_length(t)))
    body = F.when(F.size("spans") > 0, rest).otherwise(F.col("doc").getField(text_col))
    return d.select(F.col("doc").withField(text_col, body).alias("doc")).select("doc.*")
