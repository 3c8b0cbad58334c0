"""Unitigs of packed edges, and lists with circles."""

import random

import numpy as np

from seqloom.operators import graph, kmers, rolling


def walked(up):
    """{id: (head, rank)} by the plain rule: circles are cut before their smallest."""
    up, out = dict(up), {}
    for i in sorted({*up, *up.values()}):
        seen, x = [i], i
        while x in up and up[x] not in seen:
            x = up[x]
            seen.append(x)
        if x in up:  # a circle
            low = min(seen)
            out[i] = (low, seen.index(low))
        else:
            out[i] = (x, len(seen) - 1)
    return out


def some_lists(seed=6):
    rnd = random.Random(seed)
    ids, up = list(range(1, 140)), {}
    rnd.shuffle(ids)
    while ids:
        part, ids = ids[: rnd.choice((1, 2, 5, 30))], ids[30:]
        up |= dict(zip(part[1:], part))
        if rnd.random() < 0.5 and len(part) > 1:
            up[part[0]] = part[-1]
    return up


def test_lists_and_circles_in_a_task():
    for seed in range(20):
        up = some_lists(seed)
        b, a = np.array(list(up)), np.array(list(up.values()))
        got = {int(i): (int(u), int(d)) for i, u, d, _ in zip(*rolling.lists_of(a, b))}
        assert got == {i: (h, n) for i, (h, n) in walked(up).items() if n}


def test_long_lists_with_circles_are_contracted(spark):
    up = some_lists()
    links = spark.createDataFrame([(a, b) for b, a in up.items()], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 145)], "id long")
    got = {r.id: (r.head, r["rank"]) for r in graph._ranked(links, nodes, few=8, cyclic=True).collect()}
    assert got == {i: (i, 0) for i in range(1, 145)} | walked(up)


def test_packed_unitigs_are_those_of_strings(spark, monkeypatch):
    rnd = random.Random(3)
    base = "".join(rnd.choice("ACGT") for _ in range(400))
    ring = "".join(rnd.choice("ACGT") for _ in range(90))
    rows = [base, base[50:120] + base[10:60], ring + ring[:14], "ACGTACGT" * 3, "A" * 40, base[200:260] + "T" + base[261:300]]
    df = spark.createDataFrame([(s,) for s in rows], "seq string")
    monkeypatch.setattr(graph, "FEW", 10)
    kc = kmers.packed_counts(df, 15).select("packed")
    want = graph.unitigs(graph.dbg_edges(kmers.counts(df, 15))).select("seq", "n_edges")
    assert sorted(map(tuple, graph.packed_unitigs(kc, 15).collect())) == sorted(map(tuple, want.collect()))
