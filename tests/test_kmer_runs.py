"""Long k-mers are shuffled as runs of neighbours and counted in their buckets."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from seqloom.operators import calling, kmers, rolling


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def texts(seed=4):
    rnd = random.Random(seed)
    g = "".join(rnd.choice("ACGT") for _ in range(3000))
    out = [g[i : i + 100] for i in range(0, 2900, 50)] + [rc(g[i : i + 90]) for i in range(7, 2900, 90)]
    return out + [g[:31], g[:30], "", g[:50] + "N" + g[50:90], "é" + g[:40], "A" * 200, "AC" * 60] + [g[500:640]] * 40


def brute(rows, k):
    n = Counter(min(s[i : i + k], rc(s[i : i + k])) for s in rows for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT"))
    return dict(n)


@pytest.mark.parametrize("k", [24, 31])
def test_counts_of_long_kmers(spark, k):
    seqs = spark.createDataFrame([(s,) for s in texts()] + [(None,)], "seq string").repartition(5)
    assert {r.kmer: r.n for r in kmers.counts(seqs, k).collect()} == brute(texts(), k)


def test_runs_are_small_and_large_buckets_are_counted_in_parts(monkeypatch):
    rows = texts()
    runs = list(rolling.runs_of(31)(iter([pa.RecordBatch.from_arrays([pa.array(rows[lo : lo + 20])], names=["s"]) for lo in range(0, len(rows), 20)])))
    size = sum(b.nbytes for b in runs)
    assert size < 3 * sum(max(0, len(s) - 30) for s in rows)
    monkeypatch.setattr(rolling, "BUFFER", 50)
    monkeypatch.setattr(rolling, "STEP", 64)
    table = pa.Table.from_batches([*runs, *runs]).sort_by("bucket").combine_chunks()
    made = pa.Table.from_batches(list(rolling.counted(31)(iter(table.to_batches(max_chunksize=3))))).to_pylist()
    got = {r["packed"]: r["n"] for r in made}
    assert len(got) == len(made)  # a k-mer leaves once
    pack = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    assert got == {pack(s): 2 * n for s, n in brute(rows, 31).items()}


def test_kmers_that_occur_twice(spark):
    rows = [(i, s) for i, s in enumerate(texts()) if i % 3] + [(3000, rc(texts()[4])), (None, texts()[6])]
    seqs = spark.createDataFrame(rows, "cid long, s string").repartition(4)
    at = {}
    for c, s in rows:
        for i in range(len(s) - 24):
            x = s[i : i + 25]
            if set(x) <= set("ACGT"):
                at.setdefault(min(x, rc(x)), []).append((-len(s), c, i, rc(x) < x))
    want = set()
    for kmer, places in at.items():
        if len(places) == 2 and None not in (places[0][1], places[1][1]) and places[0][1] != places[1][1]:
            a, b = sorted(places)
            want.add((kmer, a[1], a[2], b[1], -b[0] - b[2] - 25 if a[3] != b[3] else b[2], a[3] != b[3]))
    found = calling.anchor_pairs(seqs)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    assert "hashpartitioning(kmer" not in found._jdf.queryExecution().executedPlan().toString()
