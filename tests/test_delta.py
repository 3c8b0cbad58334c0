"""Delta codes, interval subtraction, repeat parse and bucketed state: exact round trips and plain rules."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import delta, graph, joins, repeats
from seqloom.streaming import incremental

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def reads_of(seed, n=60):
    rnd = random.Random(seed)
    g = "".join(rnd.choice("ACGT") for _ in range(700))
    out = []
    for i in range(n):
        a, size = rnd.randrange(600), rnd.choice([60, 60, 75, 90])
        s = list(g[a : a + size])
        if i % 3 == 0:
            s[rnd.randrange(len(s))] = rnd.choice("ACGTNacx")
        s = "".join(s)
        out.append((i, rc(s) if i % 4 == 1 and set(s) <= set("ACGT") else s))
    return out + [(n, ""), (n + 1, "A"), (n + 2, out[0][1]), (n + 3, "ACGT" * 200)]


@pytest.mark.parametrize("seed", [1])
def test_delta_codes_come_back(spark, seed):
    reads = reads_of(seed)
    df = spark.createDataFrame(reads, "id long, seq string")
    rnd = random.Random(seed)
    pairs = spark.createDataFrame([tuple(sorted(rnd.sample(range(len(reads)), 2))) for _ in range(400)], "u long, v long").distinct()
    enc = delta.chained(pairs, df, most=30).cache()
    assert {r.id: r.seq for r in delta.chain_decoded(enc).collect()} == dict(reads)
    by = {}
    for r in enc.collect():
        by.setdefault(r.chain, []).append(r.rank)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and len(by) < len(reads)
    tree = graph.spanning_tree(pairs.withColumn("dist", F.rand(3)))
    order = graph.tree_order(tree).select("id", "parent", "depth").cache()
    alone = df.join(order, "id", "left_anti").select("id", F.lit(None).cast("long"), F.lit(0).cast("long"))
    enc = delta.tree_encoded(order.union(alone), df, most=30, every=4).cache()
    assert {r.id: r.seq for r in delta.tree_decoded(enc).collect()} == dict(reads)
    rows = enc.collect()
    assert max(r.level for r in rows) <= 3 and any(r.rc for r in rows) and all(r.level == 0 for r in rows if r.parent is None)


def test_subtraction_leaves_what_no_span_covers(spark):
    rnd = random.Random(4)
    part = lambda n: [(rnd.randrange(4), a, a + rnd.randrange(0, 60)) for a in (rnd.randrange(300) for _ in range(n))]
    items = [(*x, i) for i, x in enumerate(part(60))] + [(9, 5, 8, 100), (0, 7, 7, 101)]
    spans = part(12) + [(0, 50, 50)]
    covered = {(c, p) for c, a, b in spans for p in range(a, b)}
    want = []
    for c, a, b, i in items:
        free = [p for p in range(a, b) if (c, p) not in covered]
        for p in free:
            if want and want[-1][3] == i and want[-1][2] == p:
                want[-1][2] = p + 1
            else:
                want.append([c, p, p + 1, i])
    got = joins.subtracted(spark.createDataFrame(items, "cid long, start long, end long, i long"), spark.createDataFrame(spans, "cid long, start long, end long"), cell=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    state = incremental.Running(spark, str(tmp_path / "s"), ["k"], buckets=8)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, n long")
    state.merge(rows(("a", 1), ("b", 2), ("c", 3), ("d", 1)), 0)
    state.merge(rows(("a", 5), ("a", 1)), 1)
    state.merge(rows(("a", 5), ("a", 1)), 1)  # again, after a failure
    assert {tuple(r) for r in state.table().collect()} == {("a", 7), ("b", 2), ("c", 3), ("d", 1)}
    assert len(glob.glob(f"{tmp_path}/s/state/batch=1/bucket=*")) == 1
    for b in range(2, 6):
        state.merge(rows(("a", 1), ("b", 1), ("c", 1), ("d", 1)), b)
    assert {tuple(r) for r in state.table().collect()} == {("a", 11), ("b", 6), ("c", 7), ("d", 5)}
    assert sorted(x[-1] for x in glob.glob(f"{tmp_path}/s/state/batch=*")) == ["4", "5"] == sorted(x[-1] for x in glob.glob(f"{tmp_path}/s/index/batch=*"))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_replay_to_the_text(spark, seed):
    rnd = random.Random(seed)
    g = "".join(rnd.choice("ACGT") for _ in range(400))
    texts = {0: g, 1: g[50:200] + rc(g[100:300]) + "A" * 90, 2: rc(g[:120]) + g[300:330] + "ACG", 3: "", 4: "ACGT", 5: ("ACGTTGCATT" * 12), 6: g[:60] + "aNé" + rc(g[:60]) + g[5:60] + "aNR" + "tNc" + g[:50], 7: "é" + "ACGTA" * 3 + "né" * 30}
    df = spark.createDataFrame(list(texts.items()), "cid long, s string")
    tokens = repeats.parsed(df).cache()
    rows = sorted(tokens.collect(), key=lambda r: (r.cid, r.pos))
    at = {c: 0 for c in texts}
    for r in rows:
        assert r.pos == at[r.cid]
        at[r.cid] += r.len
        if r.literal is None:
            assert r.len >= 20 and (r.src_cid, r.src_pos + r.len) <= (r.cid, r.pos)  # earlier, and not into itself
            there = texts[r.src_cid][r.src_pos : r.src_pos + r.len]
            mine = texts[r.cid][r.pos : r.pos + r.len]
            assert (rc(there) if r.rc else there) == mine
            a, b = r.pos + r.len, r.src_pos + r.len
            if not r.rc and a < len(texts[r.cid]) and b < len(texts[r.src_cid]) and (r.src_cid != r.cid or b < r.pos):
                assert texts[r.cid][a] != texts[r.src_cid][b]  # as far as it goes
        else:
            assert texts[r.cid][r.pos : r.pos + r.len] == r.literal
    assert at == {c: len(s) for c, s in texts.items()}
    assert sum(r.len for r in rows if r.literal is not None) < 720
    assert {r.cid: r.s for r in repeats.replayed(tokens).collect()} == {c: s for c, s in texts.items() if s}
