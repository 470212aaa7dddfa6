import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import langid as L

from llm_data import docs, no_docs  # noqa: F401


def test_gradients_by_differences():
    net = L.ByteGRU(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    seq = np.random.default_rng(0).integers(0, 256, (6, 5)).astype(np.uint8)
    label = np.array([0, 1, 2, 0, 1, 2])
    _, grads = net.gradients(seq, label)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[k][at] += 1e-4
        up, _ = net.gradients(seq, label)
        net.p[k][at] -= 2e-4
        down, _ = net.gradients(seq, label)
        net.p[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[at]) < 1e-5


def corpus(spark, n=240):
    rnd = random.Random(4)
    syl = {"xx": ["ka", "to", "mi"], "yy": ["bru", "sch", "ung"], "zz": ["ñe", "ción", "ar"]}
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(syl))
        rows.append((i, " ".join("".join(rnd.choice(syl[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = corpus(spark)
    out = L.identify(docs, steps=150).join(docs, "doc_id")
    held = out.filter("held_out")
    assert held.count() == docs.filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).count() > 20
    assert held.filter("lang_pred = lang").count() >= 0.97 * held.count()
    assert out.filter("score < 0 or score > 1").count() == 0


def test_label_is_no_input_of_a_prediction(spark):
    docs = corpus(spark, 120)
    net = L.fit(docs, steps=40)
    a = L.predict(docs, net).orderBy("doc_id").collect()
    b = L.predict(docs.withColumn("lang", F.lit("zz")), net).orderBy("doc_id").collect()
    assert a == b


def test_edge_rows(docs, no_docs):
    net = L.fit(docs, steps=30)
    out = L.identify(docs, steps=30).collect()
    assert len(out) == docs.count()
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {4, 5, 6, 11} <= und and 9 not in und and all(r.score == 0 for r in out if r.lang_pred == "und")
    assert L.identify(no_docs).count() == 0
    assert {r.lang_pred for r in L.predict(docs, L.fit(no_docs)).collect()} == {"und"}
    kept = L.keep_identified(docs, net, min_score=0.0)
    assert kept.columns == docs.columns and kept.count() == len(out) - sum(r.lang_pred == "und" for r in out)


def test_cached_words_score_as_fresh_ones():
    net = L.ByteGRU(["a", "b"], hidden=4)
    raw = np.frombuffer(b"ab cd ab " + b"x" * 100 + b" cd", np.uint8)
    one = L.Scorer(net)
    first = one.documents(raw, np.array([0, 9, len(raw)]))
    assert np.allclose(one.documents(raw, np.array([0, 9, len(raw)])), first)
    spans = L.position_labels(net, "ab  cd")
    assert all(a < b for a, b, _ in spans) and {p for a, b, _ in spans for p in range(a, b)} == {0, 1, 4, 5}


def test_prediction_against_a_plain_model(spark, docs):
    """Every whole text, word by word, position by position, pooled in plain Python."""
    import re
    net = L.fit(corpus(spark, 120), steps=60)
    texts = [(i, r.text) for i, r in enumerate(docs.select("text").collect())]      # ids of their own: some rows share one
    own = spark.createDataFrame(texts, "doc_id long, text string")
    for r in L.predict(own, net).join(own, "doc_id").collect():
        total, n = np.zeros(len(net.langs)), 0
        for w in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()):
            for i in range(0, len(w), L.PIECE_BYTES):
                piece = np.frombuffer(w[i:i + L.PIECE_BYTES], np.uint8)
                total += net.log_probs(piece[None])[0].sum(0)
                n += len(piece)
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = np.exp(total / n - (total / n).max())
        p /= p.sum()
        top = np.sort(p)[-2:]
        assert abs(r.score - p.max()) < 1e-4 and (r.lang_pred == net.langs[int(p.argmax())] or top[1] - top[0] < 1e-4)
