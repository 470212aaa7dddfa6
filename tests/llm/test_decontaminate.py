import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from graphloom.llm import decontaminate as D

from llm_data import ROWS, docs, no_docs  # noqa: F401


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_tiles(a, b, least):
    least = min(least, len(a))
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n >= max(1, least) and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        i, j, n = best
        free_a[i:i + n] = [False] * n
        free_b[j:j + n] = [False] * n
        tiles.append(best)


def test_tiles_against_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 14))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        code = lambda x: np.array([ord(c) * 7919 for c in x], np.uint64)
        for least in (2, 3, 4):
            assert D.greedy_tiles(code(a), code(b), least) == (brute_tiles(a, b, least) if a else [])


def fixture(spark):
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([1, 3, 5, 12, 30]))) for i in range(25)] + [(7, None), (8, ""), (9, "...")]
    items.append((3, items[3][1]))
    docs = [r[:2] for r in ROWS]
    for i in range(60):
        w = items[rnd.randrange(25)][1].split()
        if rnd.random() < 0.5 and len(w) > 8:
            w = w[len(w) // 2:] + ["xx"] + w[:len(w) // 2]  # reordered
        if rnd.random() < 0.4:
            w[len(w) // 2] = "Other,"
        docs.append((200 + i, f"{text(rnd.randint(0, 30))} {' '.join(w).upper()} {text(rnd.randint(0, 10))}"))
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture(spark)
    d = spark.createDataFrame([(i, t, None, None) for i, t in docs], "doc_id long, text string, item_id long, covered int")
    b = spark.createDataFrame(items, "item_id long, text string")
    expect = Counter()
    for i, t in docs:
        for j, q in set(items):
            a = words(q)
            tiles = brute_tiles(a, words(t), 4) if a else []
            covered = sum(x[2] for x in tiles)
            if a and 2 * covered >= len(a):
                expect[i, j, covered, len(a), tuple(tiles)] += 1
    for size in (1 << 25, 700):  # one block, several blocks
        out = D.contaminated(d, b, block_bytes=size).collect()
        assert Counter((r.doc_id, r.item_id, r.covered, r.item_words, tuple((x.item_word, x.doc_word, x.words) for x in r.tiles)) for r in out) == expect
        kept = D.drop_contaminated(d, b, block_bytes=size)
        assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in docs if not any(
            2 * sum(x[2] for x in brute_tiles(words(q), words(t), 4)) >= len(words(q)) for _, q in set(items) if words(q)))


def test_empty(spark, docs, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, items).count() == 0
    assert D.contaminated(no_docs, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    assert D.drop_contaminated(docs, items).count() == docs.count()


def test_word_windows_do_not_cross_texts():
    items = D.Items([1], pa.array(["a b c d"]), 4, 0.5)
    assert items.found(pa.array(["a b", "c d", "a b c d"])) == [(2, 0, [(0, 0, 4)])]


def test_repetitive_texts_in_bounded_memory(monkeypatch):
    """Whatever the slices, the tiles are the same; a repetitive pair does not hold all its pairs."""
    import tracemalloc
    rnd = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rnd.integers(0, 3, rnd.integers(1, 40)).astype(np.uint64) for _ in range(2))
        monkeypatch.setattr(D, "PAIRS", 1 << 20)
        whole = D.greedy_tiles(a, b, 3)
        for pairs in (1, 7):
            monkeypatch.setattr(D, "PAIRS", pairs)
            assert D.greedy_tiles(a, b, 3) == whole
    monkeypatch.setattr(D, "PAIRS", 1 << 18)
    item, doc = np.zeros(1002, np.uint64), np.zeros(20_000, np.uint64)
    tracemalloc.start()
    tiles = D.greedy_tiles(item, doc, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(0, 0, 1002)] and peak < 60e6
