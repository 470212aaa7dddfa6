import math
import random
import re
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from graphloom.llm import quality as Q

from llm_data import ROWS, docs, no_docs  # noqa: F401


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed(word):
    return signed(xxhash.xxh64_intdigest(word.encode(), 42))


def chained(a, b):
    first = xxhash.xxh64_intdigest(struct.pack("<q", a), 42)
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", b), first))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def features(t, buckets):
    h = [hashed(w) for w in words(t)]
    return [x % buckets for x in h] + [chained(a, b) % buckets for a, b in zip(h, h[1:], strict=False)]


def base(t):
    w = words(t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count, inside = Counter(tri), set()
    for i, x in enumerate(tri):
        if count[x] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


EXTRA = [(100 + i, t, "en") for i, t in enumerate([
    "a a a a a a", "x y z x y z x y z", "line one\nline one\n \nline two\nline one", "é è ñ # $ %% <b>",
    " ".join(f"good word number {i}" for i in range(40)), "| ".join(f"junk{i}" for i in range(80)), "p q r s p q r t p q"])]


def test_against_plain_python(spark):
    rows = [r[:2] for r in ROWS + EXTRA]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(104, 1, 0), (1, 1, 0), (105, 0, 0), (12, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    buckets = 64
    out = Q.judge(docs, Q.trusted_ids(labels), buckets=buckets, threshold=0.0).collect()
    raw, good = Counter(), Counter()
    for d, t in rows:
        raw.update(features(t, buckets))
        if d in (104, 1):
            good.update(features(t, buckets))
    share = lambda c, b: math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * buckets))
    expect = Counter()
    for d, t in rows:
        f = features(t, buckets)
        ratio = sum(share(good, b) - share(raw, b) for b in f) / max(1, len(f))
        n, *rest = base(t)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        expect[(d, n, *rest, failed, not failed and ratio >= 0, round(ratio, 3))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.ratio, 3))
                   for r in out) == expect


def test_edges(docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.judge(docs, Q.trusted_ids(none))
    assert out.count() == docs.count() and out.filter("ratio <> 0").count() == 0
    assert out.filter("kept is null or (base_failed and kept)").count() == 0
    assert Q.judge(no_docs, Q.trusted_ids(none)).count() == 0


def test_trusted_is_bounded(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert Q.trusted_ids(labels, 10).count() == 10


def grown(spark, n):
    """``n`` documents of 400 words, one of 20 poor (words of its own kind), and labels: nine of ten good ones are trusted."""
    dice, rows = random.Random(5), []
    for i in range(n):
        kind, size = ("junk", 6 * n) if i % 20 == 0 else ("good", 2000)
        rows.append((i, " ".join(f"{kind}{dice.randrange(size)}" for _ in range(400)), int(kind == "good")))
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    return table, table.filter("quality = 0 or doc_id % 10 <> 1").select("doc_id", "quality", F.lit(0).alias("toxic"))


def test_poor_documents_stay_rejected_as_the_corpus_grows(spark):
    for n in (300, 1500):
        table, labels = grown(spark, n)
        out = Q.judge(table.drop("quality"), Q.trusted_ids(labels)).join(table, "doc_id")
        poor, good = out.filter("quality = 0 and not base_failed"), out.filter("quality = 1 and not base_failed")
        assert poor.count() == n // 20 + (n % 20 > 0) and poor.filter("kept").count() == 0
        assert good.filter("kept").count() == good.count()  # also those that are not trusted


def test_joined_and_broadcast_weights_agree(docs, spark, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (14, 1, 0)], "doc_id long, quality int, toxic int")
    table = lambda: Counter((*r[:6], round(r.ratio, 9), r.kept) for r in Q.judge(docs, Q.trusted_ids(labels)).collect())
    sent = table()
    monkeypatch.setattr(Q, "BROADCAST_BUCKETS", 0)
    assert table() == sent and sum(sent.values()) == len(ROWS)
