"""Merkle manifest against a plain model that holds every tree in memory."""
import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, g string, idx string, tree string, h string"
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def said(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        a = i // 16 * 16
        out.append((level[a:i], level[i + 1:a + 16]))
        i //= 16
    return out


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, said(r)))
    groups = [list(g) for _, g in groupby(rows, key=lambda r: r[1])]
    trees = [levels([said(r) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for s, (g, tree) in enumerate(zip(groups, trees)):
        for i, r in enumerate(g):
            path = siblings(tree, i) + siblings(top, s)
            x = tree[0][i]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                x = said(r[:4] + (r[4] and r[4].translate(CAPITALS),))
            for before, after in path:
                x = H("".join(before + [x] + after))
            out.append((r[0], tree[0][i], tree[-1][0], top[-1][0], H("".join("".join(b + a) for b, a in path)), x, x == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([r + ("x",) * 4 for r in rows], SCHEMA).repartition(5)
    got = merkle.manifest_rows(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


def test_hot_source_many_sources_nulls_and_repeated_rows(spark):
    big = 1 << 60   # not a double
    rows = [(big + i, "hot" if i % 3 else f"s{i % 40:03d}", None if i % 7 == 0 else "en", i, None if i % 11 == 0 else f"Text {i} Ää") for i in range(5000)]
    rows += [(i, None, "en", 1, "") for i in range(17)] + [(None, "hot", None, None, None), (None, None, None, None, "A")]
    rows += [(5, "rep", "en", 3, "Same Text")] * 300 + [(9, "", "de", 0, "X" * 200_000), (9, "Z", "de", 0, "x" * 200_000)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_sizes_of_one_tree(spark, n):
    check(spark, [(i, "a", "en", 1, f"T{i}") for i in range(n)])


def test_every_row_a_source(spark):
    check(spark, [(i, f"s{i * 7919 % 1000:04d}", "en", 1, f"T{i}") for i in range(300)])


def test_empty_table(spark):
    assert merkle.manifest_rows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_partitions_fetch_the_smallest_union(spark):
    """Ranges against sets: what all proofs of a partition need and its own leaves cannot give."""
    n, cases = 5000, [(0, 4095), (4096, 4999), (17, 17), (250, 1300)]
    df = spark.createDataFrame([(k, 0, 0, lo, hi, n) for k, (lo, hi) in enumerate(cases)], "part long, layer int, tree long, lo long, hi long, n long")
    got = {(r["part"], r["level"], r["idx"]) for r in merkle.missing(df).collect()}
    want = set()
    for k, (lo, hi) in enumerate(cases):
        known, size, level = set(range(lo, hi + 1)), n, 0
        while size > 1:
            want |= {(k, level, j) for i in known for j in range(i // 16 * 16, min(i // 16 * 16 + 16, size)) if j not in known}
            known, size, level = {i // 16 for i in known}, (size + 15) // 16, level + 1
    assert got == want and not [x for x in got if x[0] == 0 and x[1] < 3]


def test_spelled_proof_and_a_forged_leaf(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "en", i, f"t{i}") for i in range(100)], "doc_id long, source string, lang string, n_chars int, text string")
    rows = merkle.prove(merkle.build(df, tamper=F.col("doc_id") == 7), spell=True).collect()
    assert all(r["proof_sha256"] == H(r["proof"]) and len(r["proof"]) % 64 == 0 for r in rows)
    assert all(r["verified"] for r in rows)      # lower-case text: the forged leaf is the same
