"""Ontology folding (I1-I8) and ledger (I9-I15) on generated rows against
plain Python models."""

import random

from graphloom.operators import fold as FO
from graphloom.operators import ledger as L
from tests.conftest import rows

TYPES = ["Quay", "QUAY", "quay", "Ferry", "ferry", "Lock", "Weir", "weir"]


def generated_ontology(rnd, n=30):
    out = {}
    for _ in range(n):
        out.setdefault((rnd.choice("gh"), rnd.choice(["entity", "relation"]), rnd.choice(TYPES)), rnd.choice(["Quay", "Ferry", "Lock"]))
    return out


def frame(spark, onto):
    return spark.createDataFrame([(g, k, n, c, "Ax", None, None) for (g, k, n), c in onto.items()], FO.ONTOLOGY_SCHEMA)


def resolved(onto, g, kind, name):
    """Exact spelling, else the smallest spelling that differs in case only."""
    if (g, kind, name) in onto:
        return onto[g, kind, name]
    near = sorted(n for gg, k, n in onto if gg == g and k == kind and n.lower() == name.lower())
    return onto[g, kind, near[0]] if near else None


def test_resolve_against_the_model(spark):
    for seed in (1, 2):
        onto = generated_ontology(random.Random(seed))
        names = spark.createDataFrame([(n,) for n in TYPES + ["Unknown"]], "name string")
        for kind in ("entity", "relation"):
            got = dict(rows(FO.resolve_canonical(frame(spark, onto), "g", kind, names)))
            assert got == {n: resolved(onto, "g", kind, n) for n in TYPES + ["Unknown"]}


def test_first_recorded_type_wins(spark):
    rnd = random.Random(5)
    onto = generated_ontology(rnd, 12)
    batch = [("g", "entity", rnd.choice(TYPES + ["Buoy", "Pier"]), rnd.choice(TYPES), "Ax", f"u{i}", None, i) for i in range(40)]
    out = FO.record_types(frame(spark, onto), spark.createDataFrame(batch, FO.ONTOLOGY_SCHEMA + ", ord int"))
    want = dict(onto)
    for g, k, n, c, *_ in batch:
        want.setdefault((g, k, n), c)
    assert {(r.graph, r.type_kind, r.type_name): r.canonical_name for r in out.collect()} == want
    assert {r[0] for r in FO.get_canonicals(out, "g", "entity").collect()} == {c for (g, k, _), c in want.items() if (g, k) == ("g", "entity")}
    assert {r[0] for r in FO.axis_map(out, "g", "entity").collect()} == {n for g, k, n in want if (g, k) == ("g", "entity")}


def test_fold_against_the_model(spark):
    rnd = random.Random(9)
    onto = {("g", "entity", "Ferry"): "Ferry", ("g", "entity", "Boat"): "Ferry"}
    pool = ["Boat", "boat", "Ferry", "Weir", "WEIR", "weir", "Dam", "dam"]
    data = [(f"doc{i % 3}", i // 3, f"n{i}", rnd.choice(pool + [""]), [(rnd.choice(pool), None) for _ in range(rnd.randint(0, 3))]) for i in range(45)]
    ents = spark.createDataFrame(data, "doc_id string, ord int, NODE string, label string, facets array<struct<name:string,axis:string>>")
    from pyspark.sql import functions as F
    ents = ents.withColumn("_ord", F.struct("ord", "doc_id")).drop("ord")
    e, _, mapping, new = FO.fold_labels(frame(spark, onto), "g", ents, None, "u", "2025-01-01 00:00:00")
    # Names in order of (ord, document); an unknown name follows the first spelling of its kind.
    leader, seen = {}, []
    for d, o, _, label, facets in sorted(data, key=lambda r: (r[1], r[0])):
        seen += [n for n in [label, *(f for f, _ in facets)] if n]
    for n in seen:
        if resolved(onto, "g", "entity", n) is None:
            leader.setdefault(n.lower(), n)
    fold = lambda n: resolved(onto, "g", "entity", n) or leader[n.lower()]
    got = {r.NODE: r for r in e.collect()}
    for _, _, node, label, facets in data:
        raw = [n for n in [label, *(f for f, _ in facets)] if n]
        assert got[node].label_raw == raw and got[node].labels == list(dict.fromkeys(fold(n) for n in raw))
        assert got[node].label == (fold(label) if label else "")
    assert {(r["from"], r["to"]) for r in FO.fold_report(mapping).collect()} == {(n, fold(n)) for n in seen if fold(n) != n}
    assert {r.type_name for r in new.collect()} == {"Ferry", "Boat", *leader.values()}


def test_equal_places_in_two_documents_keep_their_labels(spark):
    data = [("a", 1, "x", "Weir", []), ("b", 1, "y", "Dam", [("Lock", None)])]
    ents = spark.createDataFrame(data, "doc_id string, _ord int, NODE string, label string, facets array<struct<name:string,axis:string>>")
    out = FO.label_vectors(ents, spark.createDataFrame([], "name string, canonical string"))
    assert {(r.NODE, tuple(r.label_raw)) for r in out.collect()} == {("x", ("Weir",)), ("y", ("Dam", "Lock"))}


def test_synonyms_must_be_known_canonicals(spark):
    u = spark.createDataFrame([("entity", "Boat")], "type_kind string, name string")
    none = spark.createDataFrame([], "type_kind string, canonical string")
    asked = lambda answer, canon: rows(FO.synonym_match(u, canon, synonym_fn=answer))
    assert asked(lambda k, n: "Ferry", none) == []
    canon = spark.createDataFrame([("entity", "Ferry")], "type_kind string, canonical string")
    assert asked(lambda k, n: "Ferry", canon) == [("entity", "Boat", "Ferry")]
    assert asked(lambda k, n: "Tug", canon) == [] and asked(lambda k, n: 1 / 0, canon) == []


def test_ledger_against_sequential_submissions(spark):
    rnd = random.Random(4)
    ledger, known = spark.createDataFrame([], L.LEDGER_SCHEMA), {}
    for run in range(3):
        batch = [(rnd.choice(["p.g", "g", "h"]), f"u{rnd.randint(0, 4)}", f"sha{rnd.randint(0, 2)}", i) for i in range(25)]
        df = spark.createDataFrame(batch, "graph string, doc_uri string, sha256 string, ord int")
        skipped = L.skip_unchanged(ledger, df).count()
        before = dict(known)
        want = []
        for g, u, sha, i in batch:
            key = (g.split(".")[-1], u)
            want.append((i, "new" if key not in known else "unchanged" if known[key] == sha else "updated"))
            known[key] = sha
        status, ledger = L.ledger_upsert(ledger, df, f"2025-01-0{run + 1} 00:00:00")
        assert rows(status, "ord", "status") == sorted(want, key=repr)
        ledger = spark.createDataFrame(ledger.collect(), L.LEDGER_SCHEMA)
        assert {(r.graph, r.doc_uri): r.sha256 for r in ledger.collect()} == known
        assert skipped == sum(before.get((g.split(".")[-1], u)) != sha for g, u, sha, _ in batch)
    left = L.clear_metadata({"ledger": ledger}, "p.g")["ledger"]
    assert {r.graph for r in left.collect()} == {g for g, _ in known} - {"g"}


def test_text_store_keeps_the_last_text(spark):
    b = spark.createDataFrame([("g", "u", "für alle", 1), ("g", "u", "später", 2), ("g", "v", "", 3)], "graph string, doc_uri string, text string, ord int")
    store = L.record_text(spark.createDataFrame([], L.TEXT_SCHEMA), b)
    assert rows(L.document_text(store, "g", 3)) == [("u", "spä", 6, True), ("v", "", 0, False)]
    store = L.record_text(store, spark.createDataFrame([("x.g", "u", "neu")], "graph string, doc_uri string, text string"))
    assert rows(store, "doc_uri", "text") == [("u", "neu"), ("v", "")]


def test_uri_of_a_pasted_text_is_its_whole_hash(spark):
    out = L.document_fingerprint(spark.createDataFrame([("t", None), ("t", "f.txt")], "text string, f string"), name_col="f").collect()
    assert out[0].doc_uri == "text:" + out[0].sha256 and out[0].display_uri == "text:" + out[0].sha256[:12]
    assert out[1].doc_uri == out[1].display_uri == "f.txt"
