"""Plans: sides that an explode makes larger than their files are not broadcast."""

import pytest

from seqloom.operators import quality
from seqloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mate_contexts", "apsp_overlaps", "hq_overlap", "error_correct", "anchor_overlaps", "knn_lsh", "flank_votes", "snv_candidates"])
def test_exploded_sides_are_not_broadcast(spark, name):
    plan = getattr(catalog, name)(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("name", ["snv_candidates", "three_hypotheses", "precision_recall"])
def test_bases_of_reads_are_not_joined_with_their_columns(spark, name):
    """Reads meet their contig by a join; their bases are counted where they are."""
    plan = getattr(catalog, name)(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1


@pytest.mark.parametrize("name", ["quality_contexts", "cond_entropy", "top_symbols"])
def test_quality_contexts_are_counted_without_an_exchange_of_qualities(spark, name):
    plan = getattr(catalog, name)(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "read_id" not in plan


def test_qualities_with_the_one_before(spark):
    df = spark.createDataFrame([("!%A",), ("B",), ("",), (None,), ("\u20ac!\u20ac",), ("B" * 12,)], "qual string").coalesce(1)
    got = {(r.bin, r.q1, r.q): r.n for r in quality.followed(df, 10).collect()}
    euro = 0x20AC - 33
    assert got == {(0, 0, 0): 2, (0, 0, 4): 1, (0, 4, 32): 1, (0, 0, 33): 2, (0, 33, 33): 9, (1, 33, 33): 2, (0, 0, euro): 2, (0, euro, 0): 1}
