import random
import re
from collections import Counter

import pyarrow as pa

from graphloom.llm import license_scan as L

from llm_data import ROWS, docs, no_docs  # noqa: F401

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def base(t):
    w = words(t)
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def texts():
    rnd = random.Random(4)
    part = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC", "under", "the", "mit", "license", "cc", "by", "nc", "é", "words", "..", "\n"]
    return [" ".join(rnd.choice(part) for _ in range(rnd.randint(0, 20))) for _ in range(300)]


def test_base_columns(spark):
    rows = [r[:2] for r in ROWS] + list(enumerate(texts(), 100))
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == Counter((d, *base(t)) for d, t in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)


def distance(a, b):
    """Least edits that turn ``a`` into some substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_notices_with_edits(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(200):
        n = list(rnd.choice(list(L.NOTICES)))
        for _ in range(rnd.randint(0, 7)):
            p = rnd.randrange(len(n))
            n[p:p + rnd.randint(0, 1)] = [rnd.choice("abcxyz")] * rnd.randint(0, 1)
        rows.append((i, f"some words before, {''.join(n)}. And words after it"))
    out = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits = 0
    for i, t in rows:
        norm = " ".join(words(t))
        want = {label for n, label in L.NOTICES.items() if distance(n, norm) <= int(L.ERROR_SHARE * len(n))}
        assert {s.label for s in out[i].spans} == want, t
        hits += bool(want)
    assert 80 < hits < 200


def test_no_span_crosses_texts():
    scanner = L.Scanner(L.PHRASES, L.NOTICES, L.ERROR_SHARE)
    n, places, spans = scanner.scan(pa.array(["released under the", "mit license", "under the mit", "license"]))
    assert n.tolist() == [3, 2, 3, 1] and not places and not spans


def test_edges(docs, no_docs):
    r = L.scan_licenses(docs).filter("doc_id = 13").first()
    assert r.n_base == 1 and r.first_word == 1 and r.labels == "mit" and len(r.spans) == 2 and r.score == 1.0
    assert L.scan_licenses(no_docs).count() == 0
