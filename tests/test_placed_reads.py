"""Reads that carry their placements are encoded without an exchange by read."""

from seqloom.operators import store


def test_encoding_of_placed_reads(spark):
    contigs = spark.createDataFrame([(1, "ACGTACGTTGCA"), (2, "GGGGCCCC")], "cid long, s string")
    rows = [(1, 1, 0, False, "ACGTAC"), (2, 1, 2, True, "AACGTN"), (3, 2, 5, False, "CCCCC"), (4, None, None, None, "acg"), (5, 2, 0, False, "GGGA")]
    reads = spark.createDataFrame([(i, c, p, r, s, "r", "I" * len(s), "") for i, c, p, r, s in rows], "read_id long, cid long, pos int, rc boolean, seq string, name string, qual string, plus string")
    enc = store.encoded(reads, None, contigs)
    want = store.encoded(reads.drop("cid", "pos", "rc"), reads, contigs)
    assert sorted(enc.collect()) == sorted(want.collect())
    got = store.reconstructed(enc, contigs)
    assert {r.read_id: r.seq for r in got.collect()} == {r[0]: r[4] for r in rows}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(read_id" not in plan and "SortMergeJoin" not in plan
