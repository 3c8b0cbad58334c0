"""K-mers of a sequence that are counted where it lies, without a row for each."""

import random
from statistics import median

from seqloom.operators import kmers, views

RC = str.maketrans("ACGT", "TGCA")


def canonical(s, k):
    w = [s[i : i + k] for i in range(len(s) - k + 1)]
    return [min(x, x.translate(RC)[::-1]) for x in w if set(x) <= set("ACGT")]


def test_shares_and_medians_of_short_and_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 120)
    rnd = random.Random(2)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (3, 5, 60, 119, 120, 121, 500)] + ["ACGT" * 20 + "N" + "ACGT" * 90, "AC" * 30, "", None, "N" * 50]
    df = spark.createDataFrame(list(enumerate(seqs)), "id long, seq string")
    own = {i: canonical(s or "", 5) for i, s in enumerate(seqs)}
    every = [x for w in own.values() for x in w]
    count = {x: every.count(x) for x in set(every)}
    shares = kmers.distinct_share(df, "id", 5)
    assert {r.id: (r.kinds, r.n) for r in shares.collect()} == {i: (len(set(w)), len(w)) for i, w in own.items() if w}
    got = {r.id: r.median for r in kmers.median_counts(df, "id", 5).collect()}
    assert got == {i: median(map(count.get, w)) for i, w in own.items() if w}
    assert {r.kmer: r.n for r in kmers.counts(df, 5).collect()} == count


def test_windows_of_a_contig_of_many_pieces(spark):
    rnd = random.Random(4)
    s = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (9, 10, 64 * 5 + 4, 64 * 5 + 5, 64 * 5 + 9, 64 * 5 + 10, 1711)]
    df = spark.createDataFrame([(i, x, x.lower()) for i, x in enumerate(s)], "cid long, s string, q string")
    got = sorted((r.cid, r.i, r.seq, r.qual) for r in views.windows(df, 10, 5).collect())
    assert got == [(c, i, x[i * 5 : i * 5 + 10], x[i * 5 : i * 5 + 10].lower()) for c, x in enumerate(s) for i in range((len(x) - 10) // 5 + 1) if len(x) >= 10]
