"""Prefix trie against a plain model."""
import hashlib
import zlib

from graphloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, c string, d string, key string, n string"


def model(rows, rebuild=True):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [z[2:] for z in sorted(v, key=lambda z: (z[0], z[1], z[2], z[3][:32]))] for c, v in convs.items()}
    whole = dict(convs)
    if rebuild:
        for c in convs:
            h = zlib.crc32(str(c).encode()) % 9
            whole[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    nodes = {}
    for c, s in whole.items():
        for k in range(len(s) + 1):
            nodes.setdefault(tuple(s[:k]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    for s in sorted(nodes, key=len, reverse=True):
        below = kids.get(s, [])
        leaves[s] = sum(leaves[x] for x in below) or 1
        saved[s] = sum(saved[x] for x in below) + (len(nodes[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
    ends = {s: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(s)).encode()).hexdigest() for s, m in nodes.items()}
    return sorted(((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves[s], saved[s], ends[s]) for s, m in nodes.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([r + ("x",) * 4 for r in rows], SCHEMA).repartition(4)


def sample():
    rows = []
    for c in range(120):
        for t in range(c % 10 + 1):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "hello" if t == 0 else f"é{c % 4 if t < 3 else c}.{t}"))
    for c in range(1000, 1060):     # copies of one conversation
        rows += [(c, t, "user", f"copy {t}") for t in range(12)]
    rows += [(2000, t, "user", f"deep {t}") for t in range(300)]                                # a long one, and one that leaves it late
    rows += [(2003, t, "user", f"deep {t}" if t < 40 else f"other {t}") for t in range(60)]
    rows += [(77, None, None, None), (77, None, "a", "first"), (78, 1, None, ""), (78, 1, "", None), (None, 1, "user", "nobody"), (-7, 0, "user", "x"), (-7, 0, "user", "x")]
    return rows


def test_rebuilt_against_the_model(spark):
    assert got(prefix_trie.rebuilt_trie(frame(spark, sample()))) == model(sample())


def test_as_they_are_against_the_model(spark):
    assert got(prefix_trie.conversation_trie(frame(spark, sample()))) == model(sample(), rebuild=False)


def test_turnless_conversations_and_empty_table(spark):
    rows = [(c, 0, "user", "x") for c in range(31, 60) if c % 5]       # their base conversations are missing
    out = got(prefix_trie.rebuilt_trie(frame(spark, rows)))
    assert out == model(rows) and any(r[1] == 0 for r in out)
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_members_of_one_sequence(spark, monkeypatch):
    rows = [(c, 0, "u", "same") for c in range(40_000)]
    assert got(prefix_trie.conversation_trie(frame(spark, rows))) == model(rows, rebuild=False)
