"""Incremental k-mer counts, coverage and sketches over a stream of reads.

Each micro-batch is reduced to counts first, and only those meet the state.
The state is a table in buckets of the key, versioned by batch, so that a batch
that runs again after a failure replaces what it had written.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from seqloom.operators.kmers import counts, exploded, hash60
from seqloom.session import drop_table, materialize


class Running:
    """Sums by key, kept under path; merge() adds a batch.

    Keys lie in buckets. A batch reads and rewrites the buckets that it touches
    and no others; a small index, written last, says which batch wrote each
    bucket, and so a batch that runs again replaces what it had written. Files
    that neither the last index nor the one before refers to are deleted."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def file(self, *parts: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self, kind: str) -> list[int]:
        """The batches of which there are files of a kind (index or state)."""
        p, fs = self.file(kind)
        return sorted(int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(p)) if fs.exists(p) else []

    def index(self, batch: int) -> dict[int, int]:
        """The batch that wrote each bucket, as of a batch."""
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/index/batch={batch}").collect()}

    def read(self, index: dict[int, int], only: list[int] | None = None) -> DataFrame | None:
        """The rows of the buckets of an index."""
        by: dict[int, list[int]] = {}
        for bucket, version in index.items():
            if only is None or bucket in only:
                by.setdefault(version, []).append(bucket)
        out = None
        for version, buckets in sorted(by.items()):
            part = self.spark.read.parquet(f"{self.path}/state/batch={version}").where(F.col("bucket").isin(buckets)).select(*self.keys, "n")
            out = part if out is None else out.union(part)
        return out

    def merge(self, rows: DataFrame, batch: int) -> None:
        """rows: keys and n."""
        rows = materialize(rows.groupBy(*self.keys).agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")), "batch")
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # no more than there are buckets
        earlier = [b for b in self.batches("index") if b < batch]
        index = self.index(earlier[-1]) if earlier else {}
        old = self.read(index, touched)
        new = rows.select(*self.keys, "n") if old is None else rows.select(*self.keys, "n").union(old)
        new = new.groupBy(*self.keys).agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/batch={batch}")
        index |= dict.fromkeys(touched, batch)
        self.spark.createDataFrame(list(index.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/batch={batch}")
        drop_table(rows)
        self.sweep(batch, {*index.values(), *(self.index(earlier[-1]).values() if earlier else ())}, earlier[-1:])

    def sweep(self, batch: int, versions: set[int], before: list[int]) -> None:
        for kind, keep in (("state", versions | {batch}), ("index", {batch, *before})):
            for b in self.batches(kind):
                if b < batch and b not in keep:
                    p, fs = self.file(kind, f"batch={b}")
                    fs.delete(p, True)

    def table(self) -> DataFrame:
        return self.read(self.index(self.batches("index")[-1]))


def kmer_stream(reads: DataFrame, state: Running, k: int, checkpoint: str) -> StreamingQuery:
    """Counts k-mers of a streaming DataFrame with a seq column."""
    return reads.writeStream.foreachBatch(lambda rows, batch: state.merge(counts(rows, k), batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_stream(placed: DataFrame, state: Running, checkpoint: str) -> StreamingQuery:
    """Sums starts and ends (cid, pos, n) of streaming placements (cid, start,
    end); running sums of n by position are the depth."""

    def merge(rows: DataFrame, batch: int) -> None:
        ev = rows.select("cid", F.col("start").alias("pos"), F.lit(1).alias("n")).union(rows.select("cid", "end", F.lit(-1)))
        state.merge(ev.groupBy("cid", "pos").agg(F.sum("n").alias("n")), batch)

    return placed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sketch_stream(reads: DataFrame, state: Running, k: int, size: int, checkpoint: str) -> StreamingQuery:
    """Keeps the `size` smallest k-mer hashes seen so far, with their counts."""

    def merge(rows: DataFrame, batch: int) -> None:
        h = exploded(rows, k, []).select(hash60(F.col("kmer")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
        earlier = [b for b in state.batches("index") if b < batch]
        if earlier:
            h = h.unionByName(state.read(state.index(earlier[-1]))).groupBy("h").agg(F.sum("n").alias("n"))
        # a sketch is `size` rows: one bucket, written anew
        h.orderBy("h").limit(size).withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(f"{state.path}/state/batch={batch}")
        state.spark.createDataFrame([(0, batch)], "bucket int, version long").write.mode("overwrite").parquet(f"{state.path}/index/batch={batch}")
        state.sweep(batch, {batch, *earlier[-1:]}, earlier[-1:])

    return reads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events by window and type, for a stream or a table (ts, event_type, value):
    rows later than the watermark are dropped from a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")
