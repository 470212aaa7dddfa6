"""Documents -> elements (H1-H9) on generated documents against a plain
Python model; a user extractor run through mapInPandas (K1)."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from graphloom.operators import documents as D
from tests.conftest import rows

FIRST = ["Zed", "Ona", "Quill", "Mirth"]
LAST = ["Vane", "vane", "Orlo", "Pike", "ORLO"]
LABELS = ["K", "L", ""]


def parse_elements(text):
    """Extractor of the test notation: ``E name|label`` and ``R a|b|label`` lines."""
    ents, rels = [], []
    for line in text.split("\n"):
        if line.startswith("E "):
            name, label = line[2:].split("|")
            ents.append({"name": name, "label": label})
        elif line.startswith("R "):
            a, b, label = line[2:].split("|")
            rels.append({"source": a, "target": b, "label": label})
    return {"entities": ents, "relations": rels}


def generated(seed, n=60):
    rnd, docs = random.Random(seed), []
    for d in range(n):
        chunks = []
        for _ in range(rnd.randint(0, 5)):
            names = [rnd.choice([rnd.choice(LAST), f"{rnd.choice(FIRST)} {rnd.choice(LAST)}"]) for _ in range(rnd.randint(0, 5))]
            lines = [f"E {x}|{rnd.choice(LABELS)}" for x in names]
            for _ in range(rnd.randint(0, 4)):
                a, b = (rnd.choice(names + ["Absent"]) for _ in range(2))
                lines.append(f"R {a}|{b}|{rnd.choice(['T', 'U'])}")
            chunks.append("\n".join(lines) or "words")
        docs.append((f"d{d}", rnd.choice(["\n\n", "\n \n\n"]).join(chunks)))
    return docs


def model(text):
    """(entities, relations, renames, redirected relations) of one document."""
    chunks = [c for c in (p.strip() for p in re.split(r"\n\s*\n+", text)) if c]
    ents, rels = {}, {}
    for c in chunks:
        for e in parse_elements(c)["entities"]:
            node = ents.setdefault(e["name"].lower(), [e["name"], ""])
            node[1] = node[1] or e["label"]
    for c in chunks:
        got = parse_elements(c)
        here = {e["name"] for e in got["entities"]}
        for r in got["relations"]:
            if r["source"] in here and r["target"] in here:
                rels.setdefault((ents[r["source"].lower()][0], ents[r["target"].lower()][0], r["label"]))
    nodes = {n: label for n, label in ents.values()}
    renames = {}
    for n, label in nodes.items():
        if len(n.split()) == 1:
            long = [m for m, other in nodes.items() if len(m.split()) > 1 and other == label and m.split()[-1].lower() == n.lower()]
            if len(long) == 1:
                renames[n] = long[0]
    moved = set(rels)
    if renames:
        moved = {(renames.get(a, a), renames.get(b, b), t) for a, b, t in rels}
        moved = {x for x in moved if x[0] != x[1]}
    return set(nodes.items()), set(rels), set(renames.items()), moved


def test_against_the_model(spark):
    docs = generated(11)
    df = spark.createDataFrame(docs, "doc_id string, text string")
    el = D.extract_elements(D.chunk_documents(df), extractor=parse_elements)
    ents = D.merge_entities(el)
    rels = D.merge_relations(D.link_relations(el, ents))
    ren = D.fold_partial_names(ents)
    red = D.redirect_relations(rels, ren)
    folded = D.apply_folds(ents, ren)
    by = lambda df, *c: {d: {x[1:] for x in rows(df, "doc_id", *c) if x[0] == d} for d, _ in docs}
    e, r, f, m = by(ents, "NODE", "label"), by(rels, "src", "dst", "label"), by(ren, "short", "long"), by(red, "src", "dst", "label")
    kept, n_folds = by(folded, "NODE"), 0
    for d, text in docs:
        we, wr, wf, wm = model(text)
        assert (e[d], r[d], f[d], m[d]) == (we, wr, wf, wm), text
        assert kept[d] == {(n,) for n, _ in we} - {(s,) for s, _ in wf}
        n_folds += len(wf)
    assert n_folds > 10
    # Every relation has its id once in a document.
    assert max(Counter((x[0], x[1]) for x in rows(red, "doc_id", "id")).values()) == 1


def test_names_with_equal_short_ids_stay_apart(spark):
    """The canonical id keeps 48 characters and 32 bits; names decide."""
    a, b = "x" * 60 + " one", "x" * 60 + " two"
    df = spark.createDataFrame([("d", f"E {a}|K\nE {b}|K\nE {a.upper()}|L")], "doc_id string, text string")
    ents = D.merge_entities(D.extract_elements(D.chunk_documents(df), extractor=parse_elements))
    assert rows(ents, "NODE", "label") == [(a, "K"), (b, "K")]


def test_no_cap_unless_asked(spark):
    df = spark.createDataFrame([("d", "\n\n".join(f"p{i}" for i in range(130))), ("e", "q"), ("f", None)], "doc_id string, text string")
    out = D.chunk_documents(df)
    assert out.filter("doc_id = 'd'").count() == 130 and out.filter("truncated").count() == 0
    cut = D.chunk_documents(df, max_chunks=50)
    assert cut.filter("doc_id = 'd' and truncated").count() == 50 and cut.filter("doc_id = 'e' and not truncated").count() == 1
    assert D.chunk_documents(df, mode="whole").count() == 2


def test_canonical_id_and_rule_extractor(spark):
    import hashlib

    from graphloom.functions.labels import canonical_id
    df = spark.createDataFrame([("Ünter Gräben?",)], "n string")
    low = "ünter gräben?"
    want = "nter-gr-ben-" + hashlib.sha1(low.encode()).hexdigest()[:8]
    assert df.select(canonical_id("n")).collect()[0][0] == want
    ch = spark.createDataFrame([("d", 0, "North Gate near Mill. Mill.")], "doc_id string, chunk_idx int, chunk string")
    el = D.extract_elements(ch).collect()[0]
    assert [e["name"] for e in el["entities"]] == ["North Gate", "Mill", "Mill"]
    assert [(r["source"], r["target"]) for r in el["relations"]] == [("North Gate", "Mill"), ("Mill", "Mill")]


def test_chunk_turns_equals_assembled_documents(spark):
    rnd = random.Random(3)
    part = ["a", "\n\n", " ", "b c", "\n", "\n\n\n", "d"]
    data = [(d, t, None if rnd.random() < 0.1 else "".join(rnd.choice(part) for _ in range(rnd.randint(0, 9))))
            for d in range(4) for t in sorted(rnd.sample(range(200), 25))]
    turns = spark.createDataFrame(data, "doc_id long, turn long, text string")
    docs = turns.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    for maxc, b in ((None, 64), (None, None), (5, 2), (40, 64)):
        got = rows(D.chunk_turns(turns, "doc_id", "turn", max_chunks=maxc, bucket=b), "doc_id", "chunk_idx", "chunk", "truncated")
        want = rows(D.chunk_documents(docs, max_chunks=maxc), "doc_id", "chunk_idx", "chunk", "truncated")
        assert got == want, (maxc, b)


def test_rule_extractor_on_long_texts(spark):
    """A long run of capitalised words is one match without recursion, and the names of a text are searched for
    by row, not by relation."""
    run = " ".join(["Abc"] * 5000)
    ents, rels = D.rule_extract(F.col("t"))
    got = spark.createDataFrame([(run + " x Def y Ghi",), ("",)], "t string").select("t", ents.alias("e"), rels.alias("r")).collect()
    assert [[e["name"] for e in g["e"]] for g in got] == [[run, "Def", "Ghi"], []]
    assert [[(r["source"], r["target"]) for r in g["r"]] for g in got] == [[(run, "Def"), ("Def", "Ghi")], []]
    plan = spark.range(1).select(F.lit("A").alias("t")).select(rels.alias("r"))._jdf.queryExecution().analyzed().toString()
    assert all("regexp_extract_all" not in part.split("namedlambdavariable")[0] for part in plan.split("lambdafunction(")[1:])
