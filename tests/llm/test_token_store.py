import os
import zlib

import numpy as np
import public_tokenizers

from graphloom.llm import token_store as S
from graphloom.llm.shared import scratch

from llm_data import ROWS, TWINS, docs, no_docs  # noqa: F401

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows, end_id=0):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((d, start, ids))
        start += len(ids)
    return out


def test_round_trip(spark, monkeypatch):
    rows = list({r[0]: r[:2] for r in ROWS}.values()) + [(500 + i, f"text number {i} with some words") for i in range(60)]
    docs = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, start long").repartition(4)
    path = scratch(spark, "store")
    S.write_tokens(docs, path, PATH, files=5)
    want = expected(rows)
    got = {r.doc_id: r for r in S.read_tokens(spark, path).collect()}
    assert [(d, s, i) for d, s, i in want] == [(d, got[d].start, got[d].ids) for d, _, _ in want]
    crc = {r.doc_id: r for r in S.read_tokens(spark, path, digests=True).collect()}
    assert all(crc[d].ids_crc32 == zlib.crc32(np.array(i, "<u4").tobytes()) and crc[d].n_tokens == len(i) for d, _, i in want)
    one = S.read_documents(spark, path, spark.createDataFrame([(501,), (9,), (12345,)], "doc_id long")).collect()
    assert {r.doc_id: r.ids for r in one} == {d: i for d, _, i in want if d in (501, 9)}


def test_repeated_rows_and_nulls(spark, docs):
    path = scratch(spark, "store")
    S.write_tokens(docs, path, PATH, files=3)
    out = S.read_tokens(spark, path).orderBy("start").collect()
    want = expected([r[:2] for r in ROWS])
    assert [r.doc_id for r in out] == [d for d, _, _ in want]
    assert sorted((str(r.doc_id), r.ids) for r in out) == sorted((str(d), i) for d, _, i in want)
    assert out[-1].start + out[-1].n_tokens == sum(len(i) for _, _, i in want)


def test_empty(spark, no_docs):
    path = scratch(spark, "store")
    S.write_tokens(no_docs, path, PATH, files=2)
    assert S.read_tokens(spark, path).count() == 0


def test_long_documents_leave_a_dictionary(spark):
    rows = [(i, " ".join(f"number {i * j % 97} of the long text" for j in range(400))) for i in range(100)]
    path = scratch(spark, "store")
    S.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, files=2, sample_bytes=8 << 10)
    meta = spark.read.parquet(f"{path}/meta").first()
    assert meta.dict_bytes == len(meta.dictionary) > 0
    assert {r.doc_id: r.ids for r in S.read_tokens(spark, path).collect()} == {d: i for d, _, i in expected(rows)}


def test_words_that_a_weak_hash_confuses(spark):
    rows = [(i, t) for i, t in enumerate([*TWINS, "x " + TWINS[1], "x " + TWINS[0]])]
    path = scratch(spark, "store")
    S.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), path, PATH)
    assert sorted((r.doc_id, r.start, r.ids) for r in S.read_tokens(spark, path).collect()) == expected(rows)
