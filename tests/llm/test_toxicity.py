"""Toxicity: the composed machine against word-by-word steps, and held-out accuracy."""
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import toxicity as X

from llm_data import docs, no_docs  # noqa: F401


def model():
    m = X.seeded()
    m.stems["vequ"] = (X.INSULT, 1.0)
    m.words["clown"] = (X.INSULT, 1.0)
    return m


def plain(m, text):
    """One transducer after the other, word by word, without tables or gaps."""
    a, b, c = 0, (False, False), (0, 0, X.OTHER)
    out, weight, opened = [], 0.0, 0.0
    for token in X._TOKEN.findall(text.lower()):
        kind, w = (X.END, 0.0) if token in X._END else (X.QUOTE, 0.0) if token in X._QUOTE else m.lookup(token)
        a, s = X._negation(a, kind)
        b, s = X._speech(b, s)
        c, s = X._target(c, s)
        if s in (X.LATE, X.LATE_THREAT):
            w = opened
        elif kind in (X.INSULT, X.THREAT):
            opened = w
        weight += X.FORMS.get(s, 0.0) * w
        if kind == X.END and weight:
            out.append(weight)
            weight = 0.0
    return out + [weight] if weight else out


WORDS = "you are an idiot clown vequere not never said kill will the house of . , ! \" \n moron nicht tu he quoted".split(" ")


@pytest.mark.parametrize("seed", range(20))
def test_composed_machine_equals_the_single_steps(seed, monkeypatch):
    rng = random.Random(seed)
    text = " ".join(rng.choice(WORDS) for _ in range(800))
    monkeypatch.setattr(X, "CHUNK", 97)
    monkeypatch.setattr(X, "CACHE_WORDS", 5)
    assert list(X.Reader(model()).clauses(text)) == pytest.approx(plain(model(), text))


def test_forms_are_ordered():
    r = X.Reader(model())
    e = {t: r.evidence(t) for t in ("you are an idiot", "an idiot", "not an idiot", "he said it was the clown", "I will kill you", "kill the lights", "the house", "", None)}
    assert e["you are an idiot"] > e["an idiot"] > e["not an idiot"] > 0
    assert 0 < e["he said it was the clown"] < r.evidence("it was the clown")
    assert e["I will kill you"] > e["kill the lights"] > 0
    assert e["the house"] == e[""] == e[None] == 0
    assert r.evidence("the clown. the clown.") > r.evidence("the clown.")


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = X.judge(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = out.filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r["predicted"] for r in rows if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in rows)
    false = sum(r["predicted"] for r in rows if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in rows)
    assert hit >= 0.88 and false <= 0.01, (hit, false)


def test_nulls_repeated_rows_clashing_columns_and_no_labels(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = X.judge(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "n_clauses"] and out.count() == docs.count()
    low = out.agg(F.min("score")).first()[0]
    empty = out.join(docs.filter("text is null or text = ''").select("doc_id").distinct(), "doc_id").filter("doc_id is not null").select("score").distinct().collect()
    assert [r["score"] for r in empty] == [low]
    assert X.judge(no_docs, labels.limit(0)).collect() == []
    assert X.judge(docs, labels.limit(0)).count() == docs.count()


def test_labels_of_the_held_out_part_change_nothing(spark):
    rng = random.Random(5)
    rows = [(i, ("you vile grobnik today " if i % 4 == 0 else "a calm day ") + " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = X.fit(docs, labels), X.fit(docs, flipped)
    assert a == b and a.lookup("grobnik")[0] == X.INSULT
