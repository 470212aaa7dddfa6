import random
import zlib
from collections import Counter

from graphloom.llm import sharding as S
from graphloom.llm.shared import scratch

from llm_data import ROWS, docs, no_docs  # noqa: F401


def check(rows, out, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = {}
    for r in out:
        assert 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_edges(docs, no_docs):
    check([r[:2] for r in ROWS], S.shard_rows(docs, 4).collect(), 4)
    assert S.shard_rows(no_docs).count() == 0


def loads(out, shards):
    size = Counter()
    for r in out:
        size[r.shard] += r.size
    return [size[s] for s in range(shards)]


def test_sizes_are_nearly_equal(spark):
    rnd = random.Random(3)
    rows = [(i, "x" * int(rnd.paretovariate(1.2) * 20)) for i in range(6000)]
    rows = [(i, t[:30000]) for i, t in rows]
    out = S.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(rows, out, 8)
    n = loads(out, 8)
    assert max(n) <= 1.01 * sum(n) / 8 + 30000 / 4 and min(n) >= 0.97 * sum(n) / 8


def test_a_repeated_row_holding_a_third_is_split(spark):
    rows = [(7, "the same text again")] * 3000 + [(i, f"text {i}") for i in range(6000)]
    out = S.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    check(rows, out, 8)
    n = loads(out, 8)
    assert max(n) <= 1.03 * min(n)


def test_placing_follows_the_ring():
    """Every part goes to the first shard clockwise that has room, in the order of size."""
    rnd = random.Random(1)
    parts = [(c, 0, rnd.randint(1, 50)) for c in rnd.sample(range(256), 200)]
    got = S.place(parts, 5, 256, 8, 0.05)
    nodes, room, filled = S.ring(5, 256, 8), -(-sum(p[2] for p in parts) * 1.05 // 5), [0] * 5
    for c, p, size in sorted(parts, key=lambda x: (-x[2], x[0])):
        after = [s for at, s in nodes if at >= c] + [s for at, s in nodes if at < c]
        want = next((s for s in after if filled[s] + size <= room), None)
        assert want is None or got[c, p] == want
        filled[got[c, p]] += size


def test_few_rows_move_when_a_shard_is_added():
    parts = [(c, 0, 10) for c in range(1 << 12)]
    a, b = S.place(parts, 16, 1 << 12), S.place(parts, 17, 1 << 12)
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.35


def test_written_shards(spark, docs):
    path = scratch(spark, "shards")
    S.write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(r[:2] for r in ROWS)


def test_written_folders_are_as_even_as_the_plan(spark):
    rows = [(7, "same text again")] * 1000 + [(i, f"text number {i} " + "x" * (i % 20)) for i in range(2000)] + [(None, None)]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, shard string").repartition(6)
    path = scratch(spark, "shards")
    S.write_shards(df, path, 16)
    got = spark.read.parquet(path).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    size = Counter()
    for r in got:
        size[r.shard] += len((r.text or "").encode()) + 1
    plan = loads(S.shard_rows(df, 16).collect(), 16)
    assert max(size.values()) <= 1.03 * sum(plan) / 16 and min(size.values()) >= 0.97 * sum(plan) / 16
