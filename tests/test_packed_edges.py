"""Packed edges stand for strings."""

import random

from pyspark.sql import functions as F

from seqloom.functions.sequence import unpacked
from seqloom.operators import graph, kmers


def test_packed_edges_are_the_strings_edges(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([("".join(rnd.choice("ACGT") for _ in range(60)),) for _ in range(4)] + [("ACGTACGT" * 3,)], "seq string")
    for k in (6, 15):
        got = graph.packed_edges(kmers.packed_counts(df, k), k).select(*[unpacked(F.col(c).cast("long"), k - 1) for c in ("src", "dst")])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.dbg_edges(kmers.counts(df, k)).select("src", "dst").collect()))
