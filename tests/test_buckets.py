"""Pairs inside buckets: what is kept equals what all pairs would give."""

import random

from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import graph, joins, sampling


def family(n=60, seed=5):
    """Reads of 100 bases that differ from a few others in some places."""
    rnd = random.Random(seed)
    roots = ["".join(rnd.choice("ACGT") for _ in range(100)) for _ in range(3)]
    out = []
    for i in range(n):
        s = list(roots[i % 3])
        for _ in range(rnd.randrange(8)):
            s[rnd.randrange(100)] = rnd.choice("ACGTN")
        out.append((i * 7 + 1, "".join(s)))
    return out + [(1000, "ACGT"), (1001, None), (None, roots[0])]


def test_a_forest_of_each_bucket_holds_the_minimum_spanning_forest(spark):
    seqs = spark.createDataFrame(family(), "uid long, seq string")
    every, few = joins.sampled_neighbours(seqs).collect(), joins.sampled_forest(seqs).collect()
    assert {(r.u, r.v): r.dist for r in few}.items() <= {(r.u, r.v): r.dist for r in every}.items()
    assert len(few) * 3 < len(every)
    tree = lambda rows: sorted(map(tuple, graph.spanning_tree(spark.createDataFrame(rows, "u long, v long, dist double")).collect()))
    assert tree(few) == tree(every)


def test_nearest_of_buckets_by_shifted_distance(spark):
    rows = family() + [(5000 + i, s[i:] + "A" * i) for i, (_, s) in enumerate(family()[:3])]
    seqs = spark.createDataFrame(rows, "uid long, seq string")
    side = lambda i, s: seqs.select(F.col("uid").alias(i), F.col("seq").alias(s))
    pairs = joins.sampled_neighbours(seqs).join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", F.round(S.shifted_distance("a", "b", 3), 6).alias("dist"))
    want = sampling.kept_first(pairs.union(pairs.select("v", "u", "dist")), ["u"], ["dist", "v"], 4).collect()
    assert sorted(map(tuple, joins.shifted_nearest(seqs).collect())) == sorted(map(tuple, want))


def test_buckets_beyond_the_cap_and_other_letters(spark):
    same = spark.createDataFrame([(i, "é" * 100) for i in range(6)], "uid long, seq string")
    assert joins.sampled_neighbours(same, cap=5).count() == 0
    assert sorted(map(tuple, joins.sampled_forest(same, cap=6).collect())) == [(0, i, 0.0) for i in range(1, 6)]


def test_a_whole_forest_leaves_out_no_bucket(spark):
    rows = [r for r in family(330, 9) if r[0] is not None and len(r[1] or "") == 100]
    for i, (_, s) in enumerate(rows[:90]):  # without other letters than four
        rows.append((9000 + i, s.replace("N", "A")))
    seqs = spark.createDataFrame(rows, "uid long, seq string")
    tree = lambda df: sorted(map(tuple, graph.spanning_tree(df).collect()))
    want = tree(joins.sampled_neighbours(seqs, cap=10_000))
    assert joins.sampled_forest(seqs, cap=100).count() < len(want)  # the cap drops whole buckets
    for size in (40, 1000):
        assert tree(joins.whole_forest(seqs, chunk=size, large=size)) == want


def test_the_catalog_trees_take_buckets_beyond_the_cap(spark, monkeypatch):
    from seqloom.plans import catalog

    rnd = random.Random(3)
    base = "".join(rnd.choice("ACGT") for _ in range(100))
    fixed = {(h * 31 + j * 13) % 100 for h in range(8) for j in range(8)}
    free = [i for i in range(100) if i not in fixed]
    rows = []
    for i in range(230):  # one bucket for each hash holds all
        s = list(base)
        for p in free:
            s[p] = rnd.choice("ACGT")
        rows.append((i, "".join(s)))
    monkeypatch.setattr(catalog, "distinct_reads", lambda spark, d: spark.createDataFrame(rows, "uid long, seq string"))
    assert catalog.mst_order(spark, "").count() == 230


def test_a_pair_leaves_one_bucket_and_is_not_shuffled(spark):
    seqs = spark.createDataFrame(family(), "uid long, seq string")
    rows = [(i, s) for i, s in family() if i is not None and s and len(s) == 100]
    keys = {i: [(h, "".join(s[(h * 31 + j * 13) % 100] for j in range(8))) for h in range(8)] for i, s in rows}
    many = {}
    for k in sum(keys.values(), []):
        many[k] = many.get(k, 0) + 1
    for cap in (6, 12, 200):
        want = []
        for i, s in rows:
            for j, t in rows:
                if i < j and any(k in keys[j] and many[k] <= cap for k in keys[i]):
                    want.append((i, j, round(2 * sum(a != b for a, b in zip(s, t)) / 100, 6)))
        got = joins.sampled_neighbours(seqs, cap=cap)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert not got._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    twice = seqs.union(seqs.where("uid = 8"))  # an id of two rows
    assert sorted(map(tuple, joins.sampled_neighbours(twice).collect())) == sorted(want)
