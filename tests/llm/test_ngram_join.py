import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import ngram_join as J

from llm_data import ROWS, TWINS, docs, no_docs  # noqa: F401


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def brute(rows, percent=85, k=4):
    """(id, set size, smallest reachable id) of every row, by all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_edge_rows(docs):
    assert got(J.jaccard_components(docs)) == brute([r[:2] for r in ROWS])


def test_empty(no_docs):
    assert J.jaccard_components(no_docs).count() == 0
    assert J.one_per_component(no_docs).count() == 0


def varied(seed, n):
    """Texts of chained small edits, shared lines and short sets."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    line = "this very common line stands in many texts"
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            words = (out[rnd.randrange(len(out))][1] or "x").split()
            for _ in range(rnd.randint(0, max(1, len(words) // 12))):
                p = rnd.randrange(len(words) + 1)
                words[p:p + rnd.randint(0, 1)] = [rnd.choice(vocab)] * rnd.randint(0, 1)
        else:
            words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 6, 9, 14, 30, 80, 160]))]
            if rnd.random() < 0.4:
                words += line.split()
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("percent,k", [(85, 4), (80, 5)])
def test_against_all_pairs(spark, percent, k):
    rows = varied(percent, 500)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.jaccard_components(df, percent=percent, k=k)) == brute(rows, percent, k)


def test_crowded_subsets_lose_no_link(spark, monkeypatch):
    rows = varied(3, 400)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, links = J.jaccard_links(df, crowd=2)
    assert sets.count() == 400
    whole = J.components(links).groupBy("root").count().collect()
    full = J.components(J.jaccard_links(df)[1]).groupBy("root").count().collect()
    assert sorted(whole) == sorted(full)


def test_long_run_of_one_signature(spark, monkeypatch):
    """A subset shared by more rows than a task gathers streams through."""
    key = np.array([5 << J.TAG_BITS | 3] * 500 + [9 << J.TAG_BITS | 3] * 3 + [11 << J.TAG_BITS | 3])
    node = np.arange(504)
    rows = spark.createDataFrame(list(zip(key.tolist(), node.tolist(), strict=True)), "key long, node long").coalesce(1)
    run = J._shared_signatures

    def small(batches):
        from graphloom.llm import ngram_join
        ngram_join.HOLD = 8
        yield from run(b.slice(i, 7) for b in batches for i in range(0, b.num_rows, 7))
    out = rows.mapInArrow(small, "gid long, tag short, node long").groupBy("gid").count().collect()
    assert sorted(r["count"] for r in out) == [3, 500]


def test_bands_cover_all_partners():
    for percent in (80, 85, 95):
        bands = J.Bands(percent, 5000)
        for n in range(1, 5001):
            low = bands.of(bands.smallest_partner(n))
            assert bands.of(n) - low <= 1
            # The plan's worth suffices for every look-up of the band.
            for band in range(int(low), int(bands.of(n)) + 1):
                assert bands.need(n, band) <= bands.most(band) + 1


def test_one_per_component(docs):
    kept = J.one_per_component(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    expect = Counter({1: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, None: 2, 9: 1, 10: 1, 11: 1, 12: 1, 13: 1, 14: 1, 15: 1})
    # One shingle more makes the long text of 10 another set (5 of 6 shingles shared);
    # "one two" and "one  two" are copies, "three" is another text of id 8; 16 is linked with 15.
    assert ids == expect


def test_words_that_a_weak_hash_confuses(spark):
    rows = [(1, TWINS[0]), (2, TWINS[1]), (3, TWINS[1].upper()), (4, "a b c d " + TWINS[0]), (5, "a b c d " + TWINS[1])]
    assert got(J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_grown_components_equal_all_at_once(spark):
    from graphloom.llm.shared import grown
    import random
    rnd = random.Random(4)
    parts = [[(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(n)] for n in (20, 12, 9)]
    roots = None
    for p in parts:
        roots = grown(roots, spark.createDataFrame(p, "a string, b string"))
    met = {r["node"]: r["root"] for r in J.components(spark.createDataFrame(sum(parts, []), "a string, b string")).collect()}
    grew = {r["node"]: r["root"] for r in roots.collect()}
    assert met == {n: r for n, r in grew.items() if n in met} and all(n == r for n, r in grew.items() if n not in met)


def test_wide_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n, m, shared in ((513, 600, 500), (2000, 2000, 1700), (1000, 1200, 990), (1100, 1000, 995), (3000, 2900, 0), (2000, 2100, 900)):
        every = rng.integers(0, 2**64, n + m - shared, dtype=np.uint64)
        a, b = every[:n], every[n - shared:]
        apart, most = J.sketches_apart(J.wide_sketch(a), J.wide_sketch(b)), 20 * (n + m) // 180
        assert apart <= n + m - 2 * shared      # a link is never excluded
        assert (apart > most) == (100 * shared < 70 * (n + m - shared))     # here, what is far from linked always is
        assert apart == J.sketches_apart(J.wide_sketch(b), J.wide_sketch(a))
    assert J.wide_sketch(every[:512]) == b"" and J.sketches_apart(b"", J.wide_sketch(every)) == 0


def test_sets_do_not_stay_in_the_shared_folder(spark):
    from graphloom.session import ensure_checkpoint_dir
    from graphloom.sources import fs
    words = [f"w{i}" for i in range(1400)]
    texts = [" ".join(words), " ".join(words[:1380]), " ".join(words[700:] + [f"x{i}" for i in range(700)]), " ".join(f"y{i}" for i in range(1400))]
    here = lambda: {n for n in fs.list_names(spark, ensure_checkpoint_dir(spark)) if n.startswith("items-")}
    before = here()
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in J.one_per_component(df, 80, 5).collect()) == [0, 2, 3]
    assert here() == before
