"""Overlaps: only prefixes and suffixes that may meet leave their task."""

import random

from seqloom.operators import joins

OTHER = str.maketrans("ACGT", "TGCA")


def brute(rows, least, top):
    views = [(i, v, s if v == 0 else s.translate(OTHER)[::-1]) for i, s in rows for v in (0, 1) if s and len(s) >= least]
    out = set()
    for i, v, s in views:
        found = []
        for j, w, t in views:
            if (i, v) != (j, w):
                found += [(-n, j, w) for n in range(least, min(len(s), len(t)) + 1) if s[:n] == t[-n:]]
        out |= {(i, v, j, w, -n) for n, j, w in sorted(found)[:top]}
    return out


def test_overlaps_with_and_without_other_letters(spark):
    rnd = random.Random(8)
    base = "".join(rnd.choice("ACGT") for _ in range(300))
    rows = [(i, base[a : a + rnd.choice((40, 60))]) for i, a in enumerate(range(0, 240, 9))]
    rows = [(i, s.translate(OTHER)[::-1] if i % 4 == 3 else s) for i, s in rows]
    rows += [(100 + i, s[:20] + x + s[21:]) for i, (_, s) in enumerate(rows[:8]) for x in ("Né"[i % 2],)]
    rows += [(200, "ACGT" * 12), (201, "AC" * 20), (202, "ACGT"), (203, None)]
    seqs = spark.createDataFrame(rows, "uid long, seq string")
    for least in (24, 35):
        assert set(map(tuple, joins.overlaps(seqs, least=least, top=30).collect())) == brute(rows, least, 30)


def shuffled(spark):
    every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_what_cannot_meet_is_not_shuffled(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choice("ACGT") for _ in range(100))) for i in range(2000)]
    seqs, first = spark.createDataFrame(rows, "uid long, seq string"), shuffled(spark)
    assert joins.overlaps(seqs).count() == 0
    assert shuffled(spark) - first < 2_000_000  # 616,000 prefixes and suffixes are more than 10 MB
