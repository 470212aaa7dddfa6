"""The pipeline's rows against a plain Python version of all its stages."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import regex

import corpus_pipeline as P
from graphloom.llm import langid, secrets
from graphloom.llm.queries import VOCABULARY
from graphloom.llm.shared import documents

from test_decontaminate import brute_tiles, words
from test_ngram_join import shingles

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"


def language_score(net, text):
    """Pooled probability of the best language, word by word."""
    total, n = np.zeros(len(net.langs)), 0
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        for i in range(0, len(w), langid.PIECE_BYTES):
            piece = np.frombuffer(w[i:i + langid.PIECE_BYTES], np.uint8)
            total += net.log_probs(piece[None])[0].sum(0)
            n += len(piece)
    mean = total / max(1, n)
    return float((np.exp(mean) / np.exp(mean).sum()).max())


def without_secrets(text):
    spans = sorted({(m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text) if len(m.group(r.group)) >= r.least})
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def plain(spark):
    net = langid.fit(documents(spark, SF))
    rows = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows if regex.search(r"\p{L}", r["text"] or "") and language_score(net, r["text"]) >= 0.4]
    sets = {d: shingles(t, 5) for d, t in rows}
    group = {d: d for d, _ in rows}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d
    ids = sorted(group)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    rows = [(d, t) for d, t in rows if find(d) == d]
    items = [words(t) for t in set(pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist())]
    grams = [{tuple(q[i:i + 4]) for i in range(len(q) - 3)} for q in items]
    clean = []
    for d, t in rows:
        w = words(t)
        mine = {tuple(w[i:i + 4]) for i in range(len(w) - 3)}
        if not any(g & mine and 2 * sum(x[2] for x in brute_tiles(q, w, 4)) >= len(q) for q, g in zip(items, grams, strict=True)):
            clean.append((d, without_secrets(t)))
    return clean


def test_rows(spark):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for d, t in plain(spark):
        ids = library.encode(t, add_special_tokens=False).ids
        want[d, len(ids), tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in P.run(spark, SF).collect())
    assert got == want and 100 < len(got) < 200


def test_stages_keep_the_columns(spark):
    docs = documents(spark, SF)
    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs.limit(20), SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = P.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() == 0
