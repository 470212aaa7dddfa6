import hashlib
import random
import re
from collections import Counter

from graphloom.llm import secrets as S

from llm_data import ROWS, docs, no_docs  # noqa: F401


def brute(text):
    found = []
    for rank, r in enumerate(S.RULES):
        for m in re.finditer(r.pattern, text or ""):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), rank, r.kind, m.end()))
    found.sort()
    base = [x for x in found if S.RULES[x[1]].base]
    say = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, k, b in xs)
    count = Counter(k for _, _, k, _ in base)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(say(base).encode()).hexdigest(), say(found)


def texts():
    rnd = random.Random(2)
    part = ["password", "PassWD", "token", "api_key", "APIKEY", "secret", "=", ":", " ", '"', "'", "abcdefgh", "xyz", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef",
            "é😀", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "a" * 36, "\n", "xoxb-", "eyJ", ".", "K"]
    return ["".join(rnd.choice(part) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + ["token=secret: abcdefghij", "hex " + "a" * 31, "a" * 32]


def test_against_python_re(spark):
    rows = [r[:2] for r in ROWS] + list(enumerate(texts(), 1000))
    out = S.scan_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in out) == Counter((d, *brute(t)) for d, t in rows)


def test_every_match_satisfies_its_query():
    for r in S.RULES:
        q = S.trigram_query(r.pattern)
        for t in texts():
            if re.search(r.pattern, t):
                assert any(all(g in t.lower() for g in alternative) for alternative in q)
    assert frozenset() in S.trigram_query("[0-9a-f]{32,}")
    assert S.trigram_query("abcd|uvw+x") == S.ALWAYS and S.trigram_query("abcd|uvwx") == frozenset(map(frozenset, (["abc", "bcd"], ["uvw", "vwx"])))


def test_redact(docs, no_docs):
    out = S.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    said = [r.text for r in out.filter("doc_id = 12").collect()][0]
    assert said.count("[SECRET]") == 3 and "AKIA" not in said and "abcdefgh12" not in said
    same = lambda df: Counter((r.doc_id, r.text) for r in df.filter("doc_id is null or doc_id <> 12").collect())
    assert same(out) == same(docs)
    assert S.redact(no_docs).count() == 0 and S.scan_digests(no_docs).count() == 0


def test_very_many_spans_take_time_in_proportion(spark):
    import time
    took = []
    for n in (4_000, 32_000):
        text = " ".join("AKIA" + f"{i:016d}" if i % 3 else "x token=abcdefgh12" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        t = time.time()
        row = S.scan_digests(df).first()
        took.append(time.time() - t)
        spans = [tuple(x.split(":")) for x in row["spans"].split(",")]
        assert len(spans) == n and all(text[int(a):int(b)].startswith("AKIA" if k == "access" else "token=") for k, a, b in spans)
        assert S.redact(df).first()["text"] == re.sub(r"AKIA\d+|token=\w+", "[SECRET]", text)
    assert took[1] < 8, took
