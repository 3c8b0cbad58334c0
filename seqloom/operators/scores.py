"""Compressibility and per-sample feature records."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import regime
from seqloom.operators import coverage, kmers, sampling


def compressibility(reads: DataFrame, key: str = "read_id", pilot: int = 5000) -> DataFrame:
    """One row (raw, packed, score, regime): how far deflate packs a pilot of at
    most `pilot` reads, evenly spread, joined as lines."""
    rows = sampling.strided(reads, key, pilot).select("at", "seq")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = "\n".join(pdf.sort_values("at").seq).encode()
        return pd.DataFrame({"raw": [len(raw)], "packed": [len(zlib.compress(raw, 9))]})

    out = rows.groupBy(F.lit("all")).applyInPandas(pack, "raw long, packed long")  # a bounded pilot
    score = F.col("packed") / F.nullif(F.col("raw"), F.lit(0))
    return out.select("raw", "packed", score.alias("score"), regime(score).alias("regime"))


def sample_features(reads: DataFrame, placed: DataFrame, contigs: DataFrame) -> DataFrame:
    """One wide row: read moments, GC, coverage moments and percentiles, contig
    lengths and k-mer statistics. reads: seq, rc; placed: cid, start, end."""
    from seqloom.session import materialize

    cov = materialize(coverage.depth(placed, contigs), "depth")
    parts = [
        coverage.read_moments(reads), coverage.gc(contigs),
        coverage.moments(cov).select(*[F.col(c).alias(f"cov_{c}") for c in ("mean", "std", "cv", "zero_share")]),
        coverage.n50(coverage.islands(cov)).select(F.col("n").alias("runs"), "longest", "total", "n50"),
        kmers.coverage_stats(kmers.counts(reads, 21)).select(F.col("distinct").alias("kmers_distinct"), F.col("total").alias("kmers_total"), "mean_cov", "n_solid", "n_error"),
        coverage.percentiles(cov).groupBy().pivot("p", [10, 25, 50, 75, 90]).agg(F.first("value")).select(*[F.col(str(p)).alias(f"cov_p{p}") for p in (10, 25, 50, 75, 90)]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def as_json(features: DataFrame) -> DataFrame:
    return features.select(F.to_json(F.struct(*features.columns)).alias("value"))


def simulated(spark, bases: int, coverage_: int, every: int = 997, width: int = 150) -> tuple[DataFrame, DataFrame]:
    """(reads, truth) of a diploid sample made from hashes: a genome of `bases`,
    with another base at every `every`-th place on half of the reads."""
    base = lambda p: F.lit("ACGT").substr((F.pmod(F.xxhash64(p, F.lit("genome")), F.lit(4)) + 1).cast("int"), F.lit(1))
    n = bases * coverage_ // width
    rows = spark.range(n).select(F.col("id").alias("read_id"), F.pmod(F.xxhash64("id", F.lit("start")), F.lit(bases - width)).alias("first"), (F.pmod(F.xxhash64("id", F.lit("hap")), F.lit(2)) == 1).alias("alt"))
    places = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.when(F.col("alt") & (F.pmod(F.col("first") + j, F.lit(every)) == every // 2), F.translate(base(F.col("first") + j), "ACGT", "CGTA")).otherwise(base(F.col("first") + j)))
    reads = rows.select("read_id", F.lit(0).cast("long").alias("cid"), F.col("first").cast("int").alias("pos"), F.lit(False).alias("rc"), F.array_join(places, "").alias("seq"), F.lit("I" * width).alias("qual"))
    sites = spark.range((bases + every - 1) // every).select((F.col("id") * every + every // 2).alias("p")).where(F.col("p") < bases)
    truth = sites.select(F.lit(0).cast("long").alias("cid"), (F.col("p") + 1).cast("int").alias("pos"), base(F.col("p")).alias("ref"), F.translate(base(F.col("p")), "ACGT", "CGTA").alias("alt"))
    return reads, truth


def simulated_genome(spark, bases: int) -> DataFrame:
    """(cid, s): the genome that simulated() reads come from."""
    base = F.lit("ACGT").substr((F.pmod(F.xxhash64("id", F.lit("genome")), F.lit(4)) + 1).cast("int"), F.lit(1))
    cells = spark.range(bases).select(F.col("id"), base.alias("b"))
    return cells.groupBy(F.lit(0).cast("long").alias("cid")).agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("x")).select("cid", F.array_join(F.transform("x", lambda p: p["b"]), "").alias("s"))
