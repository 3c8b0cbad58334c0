"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

from seqloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, c long, d long, part int, path string"


def brute(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    convs = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, ends = {}, {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 6
        first = c - int(c / 100) * 100
        seq = convs.get(c - first, [])[:h] + convs[c][h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
        ends.setdefault(tuple(seq), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, who in members.items():
        under = [x for x in members if x[: len(p)] == p]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        sha = hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
        out.append((who[0], len(p), members[p[:-1]][0] if p else None, len(who), len(kids.get(p, [])), sum(x not in kids for x in under), saved, sha))
    return sorted(out, key=str)


def rows_of(seed, n):
    rnd = random.Random(seed)
    said = ["", "yes", "é" * 3, "x" * 50, None, "no\n"]
    rows = []
    for c in rnd.sample(range(-120, 420), n) + [0, 100, 200, 300]:
        if rnd.random() < 0.3:
            turns = [("user", "hello"), ("assistant", "hi"), ("user", "bye")][: rnd.randrange(1, 4)] * rnd.randrange(1, 4)
        else:
            turns = [(rnd.choice(["user", "assistant", None]), rnd.choice(said)) for _ in range(rnd.randrange(1, 9))]
        rows += [(c, rnd.choice([i, i, i, None, 2]), r, t, 7, 7, 7, "clash") for i, (r, t) in enumerate(turns)]
    return rows + [(None, 0, "user", "nobody", 7, 7, 7, "clash"), rows[0], rows[0]]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "PIECE", 40)
    for seed, n in ((1, 90), (2, 4)):
        rows = rows_of(seed, n)
        got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_many_copies_and_one_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}", 0, 0, 0, "") for c in range(150) for t in range(3)]
    rows += [(1000, t, "user", f"long {t % 7}" if t else "y" * 100_000, 0, 0, 0, "") for t in range(600)]
    got = sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_turnless(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone", 0, 0, 0, "")]
    assert sorted(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
