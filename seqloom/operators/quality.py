"""Quality contexts, conditional frequencies and entropy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import rolling
from seqloom.session import arrowed, widened


def symbols(reads: DataFrame, key: str = "read_id", qual: str = "qual") -> DataFrame:
    """(key, pos, q)."""
    rows = reads.select(key, F.posexplode(F.split(qual, "")).alias("pos", "c"))
    return rows.select(key, "pos", F.greatest(F.ascii("c") - 33, F.lit(0)).alias("q"))


def followed(reads: DataFrame, width: int | None = None, qual: str = "qual") -> DataFrame:
    """(bin, q1, q, n): how often a quality q has q1 before it (0 for the first)
    in each range of width places, all places being one without a width. A task
    counts over whole columns, so that only its counts are shuffled."""
    some = reads.where(F.col(qual).isNotNull()).select(qual)
    rows = arrowed(some, followed_counts(width), "bin long, q1 int, q int, n long")
    return rows.groupBy("bin", "q1", "q").agg(F.sum("n").alias("n"))


def followed_counts(width: int | None):
    """Batches of one string column without nulls -> bin, q1, q, n, once for each
    part of a batch. An empty string counts as one quality of 0."""

    def run(batches):
        for part in rolling.slices(batches, 0):
            data, at = rolling.bytes_of(part.column(0))
            if (data >= 128).any():  # places count characters
                texts = part.column(0).to_pylist()
                data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            size = np.diff(at)
            q = np.maximum(data.astype(np.int64) - 33, 0)
            q1 = np.concatenate([[0], q[:-1]])[: len(q)]
            q1[at[:-1][size > 0]] = 0
            place = np.arange(len(q)) - np.repeat(at[:-1], size)
            cell = place // width if width else np.zeros(len(q), np.int64)
            empty = int((size == 0).sum())
            q, q1, cell = (np.concatenate([x, np.zeros(empty, np.int64)]) for x in (q, q1, cell))
            if not len(q):
                continue
            few = q.max() < 256  # else qualities are numbered as they occur
            many = np.arange(256) if few else np.union1d(q, q1)
            base = len(many)
            first, then = (q1, q) if few else (np.searchsorted(many, q1), np.searchsorted(many, q))
            key = (cell * base + first) * base + then
            if key.max() < 1 << 20:
                n = np.bincount(key)
                key = np.flatnonzero(n)
                n = n[key]
            else:
                key, n = np.unique(key, return_counts=True)
            pair = key % (base * base)
            yield pa.RecordBatch.from_arrays([pa.array(key // (base * base)), pa.array(many[pair // base].astype(np.int32)), pa.array(many[pair % base].astype(np.int32)), pa.array(n.astype(np.int64))], names=["bin", "q1", "q", "n"])

    return run


def states(reads: DataFrame, key: str = "read_id") -> DataFrame:
    """(key, pos, q, q1, q2, top, vol, run) of each quality, from what comes
    before it: the last two, a maximum that decays by one a place, a moving
    change (3 vol + 8 |dq|) / 4 and the length of the run before."""
    s = symbols(reads, key)
    w = Window.partitionBy(key).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.lag("q", 1, 0).over(w).alias("q1"), F.lag("q", 2, 0).over(w).alias("q2"), (F.max(F.col("q") + F.col("pos")).over(before) - F.col("pos") + 1).alias("peak"))
    s = s.withColumn("step", F.when(F.lag("q").over(w) == F.col("q"), 0).otherwise(1))
    s = s.withColumn("island", F.sum("step").over(w))
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy(key, "island").orderBy("pos")))
    s = s.withColumn("run", F.coalesce(F.lag("nth").over(w), F.lit(0)))
    # the moving change folds over the changes so far, which a read's length bounds
    change = F.abs(F.col("q") - F.col("q1")).cast("long")
    s = s.withColumn("changes", F.collect_list(change).over(before))
    vol = F.aggregate("changes", F.lit(0).cast("long"), lambda v, d: F.shiftright(3 * v + 8 * d, 2))
    return s.select(key, "pos", "q", "q1", "q2", F.greatest(F.coalesce("peak", F.lit(0)), F.lit(0)).alias("top"), vol.alias("vol"), "run")


def context_counts(rows: DataFrame, context: list[str], symbol: str) -> DataFrame:
    """(context, symbol, n, scaled): how often each symbol follows each context,
    and its share of 16384. Rows with a count n stand for n rows."""
    c = rows.groupBy(*context, symbol).agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("n"))
    return c.withColumn("scaled", F.floor(F.col("n") * 16384 / F.sum("n").over(Window.partitionBy(*context))).cast("long"))


def conditional_entropy(rows: DataFrame, context: list[str], symbol: str) -> DataFrame:
    """n, order0 and conditional bits for each symbol. Rows with a count n stand
    for n rows."""
    c = rows.groupBy(*context, symbol).agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("n"))
    total = c.groupBy(*context).agg(F.sum("n").alias("t"))
    h1 = c.join(total, context).agg(F.sum("n").alias("n"), F.sum(-F.col("n") * F.log2(F.col("n") / F.col("t"))).alias("bits"))
    o = c.groupBy(symbol).agg(F.sum("n").alias("n"))
    h0 = o.join(F.broadcast(o.agg(F.sum("n").alias("t")))).agg(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("t"))).alias("bits0"))
    return h1.join(F.broadcast(h0)).select("n", F.round(F.col("bits0") / F.col("n"), 6).alias("order0_bits"), F.round(F.col("bits") / F.col("n"), 6).alias("conditional_bits"))


def surprise(contigs: DataFrame, order: int = 11, buckets: int = 4) -> DataFrame:
    """(cid, pos, bucket): how unexpected each base is, from the earlier
    occurrences of its context in the contig. Places without a whole context
    get the middle bucket, unseen contexts the last."""
    cut = F.transform(F.sequence(F.lit(0), F.length("s") - 1), lambda i: F.struct(
        i.alias("pos"), F.col("s").substr(i + 1, F.lit(1)).alias("b"), F.when(i >= order, F.col("s").substr(i - order + 1, F.lit(order))).alias("ctx")))
    rows = contigs.where(F.length("s") > 0).select("cid", F.explode(cut).alias("x")).select("cid", "x.*")
    rows = rows.withColumn("ctx", F.when(F.col("ctx").rlike("^[ACGT]+$") & F.col("b").rlike("[ACGT]"), F.col("ctx")))
    earlier = lambda *by: F.count("*").over(Window.partitionBy("cid", "ctx", *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("cid", "pos", "ctx", earlier().alias("t"), earlier("b").alias("n"))
    p = (F.col("n") + 1) / (F.col("t") + 4)
    level = F.when(p >= 0.85, 0).when(p >= 0.60, 1).when(p >= 0.35, 2).otherwise(3)
    bucket = F.when(F.col("ctx").isNull(), buckets // 2).when(F.col("t") == 0, buckets - 1).otherwise(F.least(level, F.lit(buckets - 1)))
    return rows.select("cid", "pos", bucket.cast("int").alias("bucket"))


def dense_alphabet(reads: DataFrame, most: int = 24) -> DataFrame:
    """(q, code, levels, binned): the Phred values in use, numbered."""
    s = symbols(reads).select("q").distinct()
    n = s.agg(F.count("*").alias("levels"))
    w = Window.orderBy("q")  # at most 94 rows
    return s.select("q", (F.row_number().over(w) - 1).alias("code")).join(F.broadcast(n)).select("q", "code", "levels", (F.col("levels") <= most).alias("binned"))


def mate_contexts(reads: DataFrame) -> DataFrame:
    """(read_id, pos, q, mate_bin) of second mates: the bin of the first mate's
    quality at the same place, 4 without one. reads: read_id, pair_id, mate, qual."""
    s = reads.select("read_id", "pair_id", "mate", F.posexplode(F.split("qual", "")).alias("pos", "c")).withColumn("q", F.greatest(F.ascii("c") - 33, F.lit(0)))
    b = F.when(F.col("q1") < 10, 0).when(F.col("q1") < 20, 1).when(F.col("q1") < 30, 2).when(F.col("q1").isNotNull(), 3).otherwise(4)
    one = s.where("mate = 1").select(F.col("pair_id").alias("_p"), F.col("pos").alias("_pos"), F.col("q").alias("q1"))
    two = s.where("mate = 2")
    return two.join(widened(one), (F.col("pair_id") == F.col("_p")) & (F.col("pos") == F.col("_pos")), "left").select("read_id", "pos", "q", b.alias("mate_bin"))
