import hashlib
import os
import random
from collections import Counter

import pyarrow as pa
import pytest
import public_tokenizers

from graphloom.llm import bpe

from llm_data import ROWS, TWINS, docs, no_docs  # noqa: F401

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(3)
    alpha = list("abstrelvmd' '''  \n\t.,!12½²é 　漢字😀-#<|>") + ["'s", "'re", "'ll", "<|endoftext|>", " the", " of", "\r\n", "ing", "tion"]
    out = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    return out + ["", " ", "  ", "\n\n", "'s", "''s'", "a''s", "don't've'll 'tis <|endoftext|>x<|endoftext|><|endoftext|>", "a" * 3000, "ab" * 2000,
                  " " * 900 + "x", "x" + "\n" * 7 + " y", "\x85a \x1c b\u200b", "\u2019s", "<|endoftext", "|>"]


def test_ids_and_text_against_the_library(library):
    encoder, rows = bpe.Encoder(PATH), [r[1] for r in ROWS] + texts()
    for i in range(0, len(rows), 211):
        part = rows[i:i + 211]
        ids, border = bpe.with_special(encoder, pa.array(part, pa.string()))
        for k, e in enumerate(library.encode_batch([t or "" for t in part], add_special_tokens=False)):
            own = ids[border[k]:border[k + 1]].tolist()
            assert own == e.ids, part[k]
            assert bpe.decode(encoder.v, own) == library.decode(e.ids, skip_special_tokens=False)
    assert 0 < encoder.repaired < encoder.proposed


def test_decode_of_any_ids(library):
    rnd, v = random.Random(9), bpe.vocabulary(PATH)
    for _ in range(500):
        ids = [rnd.randrange(v.size) for _ in range(6)]
        assert bpe.decode(v, ids) == library.decode(ids, skip_special_tokens=False)


def test_compatible_pairs_are_exact():
    rnd, v = random.Random(1), bpe.vocabulary(PATH)
    import numpy as np
    ok = [i for i in range(v.size) if v.reachable[i] and v.tokens[i]]
    a, b = (np.array([rnd.choice(ok) for _ in range(3000)]) for _ in range(2))
    good = v.compatible(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), good.tolist(), strict=True):
        assert g == (v.exact(v.tokens[x] + v.tokens[y]) == [x, y])


def test_many_spans_as_one_by_one():
    import numpy as np
    rnd, v = random.Random(6), bpe.vocabulary(PATH)
    words = [bytes(rnd.choice(b"abthein 'sx") for _ in range(rnd.randint(1, 25))) for _ in range(400)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    row, token = v.exact_rows(raw, ends - [len(w) for w in words], ends)
    for i, w in enumerate(words):
        assert token[row == i].tolist() == v.exact(w)


def test_cache_overflow_changes_nothing():
    rows = texts()[:300]
    want, _ = bpe.with_special(bpe.Encoder(PATH), pa.array(rows))
    small = bpe.Encoder(PATH)
    small.cache = 50
    got = [bpe.with_special(small, pa.array(rows[i:i + 20]))[0] for i in range(0, 300, 20)]
    assert [x for g in got for x in g.tolist()] == want.tolist()


def test_documents(docs, no_docs, library):
    out = bpe.digest_documents(docs, PATH).collect()
    expect = Counter()
    for d, t, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expect[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
               hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in out) == expect
    full = bpe.encode_documents(docs, PATH).collect()
    assert Counter((r.doc_id, len(r.ids), r.decoded) for r in full) == Counter(
        (d, len(library.encode(t or "", add_special_tokens=False).ids), t or "") for d, t, _ in ROWS)
    assert bpe.digest_documents(no_docs, PATH).count() == 0


def test_words_that_a_weak_hash_confuses(spark, library):
    rows = [(i, t) for i, t in enumerate([*TWINS, TWINS[0] + " x " + TWINS[1], TWINS[1] * 2, TWINS[0] * 2])]
    got = {r.doc_id: r.ids for r in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()}
    assert all(got[i] == library.encode(t, add_special_tokens=False).ids for i, t in rows)
