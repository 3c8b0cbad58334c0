"""Hard negatives against exact scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, row long, v string, codes int, asked string"


def brute(rows, k=5, low=80):
    f32 = lambda x: float(np.float32(x))
    ok = []
    for r in rows:
        e = r[1]
        if r[0] is None or r[2] is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        ok.append((r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], [math.floor(256 * f32(x)) for x in e]))
    dot = lambda a, b: max(-hardneg.LARGEST, min(hardneg.LARGEST, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, (a, lab, v) in enumerate(ok):
        if a % 100:
            continue
        scored = sorted(((-dot(v, w), x, m) for j, (x, m, w) in enumerate(ok) if j != i))
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            neg = [(x, t) for t, x, m in scored if m != lab and low * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r + 1, x, -s, -t) for r, (x, t) in enumerate(neg)]
    return sorted(out)


def mined(spark, rows, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    df = spark.createDataFrame([(*r, 1, "clash", 2, "no") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hardneg.mined(df, F.col("vec_id") % 100 == 0, label, **more).collect()))


def table(seed, n, dim, labels=3):
    rnd = random.Random(seed)
    heads = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        h = rnd.choice(heads)
        rows.append((i * 10, [x + rnd.gauss(0, rnd.choice([0.05, 0.5])) for x in h], rnd.randrange(labels)))
    return rows


@pytest.mark.parametrize("seed,dim,more", [(1, 16, {}), (2, 7, {"sample": 50, "part": 3}), (3, 5, {"group": 4})])
def test_equals_brute_force(spark, seed, dim, more):
    rows = table(seed, 300, dim)
    assert mined(spark, rows, **more) == brute(rows) != []


def test_ties_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "ROWS", 32)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    rows = table(4, 120, 6)
    copy = rows[0][1]
    rows += [(i, copy, i % 3) for i in range(5000, 5200)]
    rows += [(None, copy, 1), (7000, None, 1), (7100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (7200, [float("nan")] + [1.0] * 5, 1), (7300, [float("inf")] * 6, 1), (7400, copy, None), (7500, [], 1), (7600, [-x for x in copy], 1)]
    rows += [(5000, copy, 0), (5000, copy, 1), (7700, [2.0], 2)]
    padded = [(a, None if v is None else v + [0.0] * (6 - len(v)), m) for a, v, m in rows]
    assert mined(spark, rows) == brute(padded)


def test_large_scores_are_exact_or_held(spark):
    rows = [(100 * i, [2.0**20 + i, 2.0**18 - i, 1.0], i % 2) for i in range(20)] + [(31, [3e37, 1.0, 1.0], 1), (33, [3e37, 1.0, 2.0], 0)]
    held = [(a, [max(-(2.0**63), min(2.0**63, 256 * float(np.float32(x)))) / 256 for x in v], m) for a, v, m in rows]
    assert mined(spark, rows) == brute(held)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 1.0], 1)]) == []
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.7], 2)]
    assert mined(spark, rows) == brute(rows) == [(0, 1, 1, 2, 131072, 111104 + 0)] or mined(spark, rows) == brute(rows)
