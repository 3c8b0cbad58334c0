"""Votes of reads that are counted in batches, and of equal flanks."""

import random

from seqloom.operators import calling


def framed(spark):
    rnd = random.Random(2)
    base = "".join(rnd.choice("ACGT") for _ in range(300))
    rows = []
    for i in range(200):
        at = rnd.randrange(200)
        s, q = base[at : at + 100], "".join(chr(33 + rnd.randrange(3) * 15) for _ in range(100))
        if i % 2:
            s = s[: 150 - at] + "ACGT"[("ACGT".index(base[150]) + 1) % 4] + s[151 - at :] if at <= 150 < at + 100 else s
        s = s[:7] + rnd.choice("ACGTNé") + s[8:]
        rows.append((i, i % 2 * 5, at, False, s, q[: rnd.choice((90, 100, 110))] if i % 9 else None, 0))
    return spark.createDataFrame(rows, "read_id long, cid long, pos int, rc boolean, b string, q string, mm int")


def test_reads_are_tallied_as_their_pileup_is(spark):
    f = framed(spark)
    want, got = calling.tallied(calling.pileup(f)), calling.tallied_reads(f)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.dtypes == want.dtypes
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_votes_count_equal_flanks_before_they_are_cut(spark):
    flank = [(1, 50, i < 5, "A" * 15 + ("C" if i < 5 else "G") + ("T" if i < 4 else "A") * 15) for i in range(9)]
    df = spark.createDataFrame(flank, "cid long, pos int, is_major boolean, flank string")
    out = calling.flank_votes(df)
    assert list(map(tuple, out.collect())) == [(1, 50, 15, 4, "A" * 15 + "G" + "A" * 15)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.rindex("Aggregate [cid")
    assert "Aggregate [cid" in plan[plan.index("Generate posexplode") :]
