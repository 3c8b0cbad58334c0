"""Exact top-k inner products over integer vectors, norm-sorted and pruned.

Vectors become floor(scale * x). Candidates are range-partitioned and sorted
by descending length. A query's partial inner product over the leading axes of
an SVD rotation, plus the Cauchy-Schwarz bound |q_rest| |x_rest| of what is
left, bounds its score; only candidates whose bound reaches the query's
current k-th score are scored, in integers. The longest candidates are scored
first and give every query its starting threshold, which all partitions use.

Queries are taken in groups of a fixed size, one pass over the candidates for
each group, so a group's matrix has a proven size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.vectors import finite, matrix, width
from seqloom.session import arrowed, materialize

SCALE = 1024
GROUP = 16384
HEAD = 2048
LEAD = 16
ROWS = 2048


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long"), v.alias("v"))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all rows, from their second moments, which
    partitions sum up and Spark adds: dim x dim numbers reach the driver."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    sums = arrowed(vectors.select("v"), moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "m")).groupBy("i", "j").agg(F.sum("m").alias("m"))
    out = np.zeros((dim, dim))
    for r in sums.collect():
        out[r.i, r.j] = r.m
    return np.linalg.eigh((out + out.T) / 2)[1][:, ::-1].copy()


def score_block(ids: np.ndarray, own: np.ndarray, xi: np.ndarray, q_own: np.ndarray, qi: np.ndarray, turn: np.ndarray, floor: np.ndarray, k: int, lead: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates of a norm-sorted block that can be among the k best of a
    query: (place of the query, id of the candidate, score). own tells rows
    apart; xi and qi are integers. floor: the k-th score so far, raised in place."""
    out = []
    x, q = xi.astype(np.float64), qi.astype(np.float64)
    xr, qr = x @ turn, q @ turn
    x_rest = np.sqrt((xr[:, lead:] ** 2).sum(1))
    q_rest = np.sqrt((qr[:, lead:] ** 2).sum(1))
    x_all, q_all = np.sqrt((xr**2).sum(1)), np.sqrt((qr**2).sum(1))
    slack = 1e-9 * (1 + x_all.max(initial=0) * q_all.max(initial=0))
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1) < 2.0**53
    for a in range(0, len(q_own), 512):
        s = slice(a, a + 512)
        near = np.flatnonzero(q_all[s] * x_all.max(initial=0) + slack >= floor[s])  # the whole block against a query
        if not len(near):
            continue
        near += a
        bound = qr[near, :lead] @ xr[:, :lead].T + np.outer(q_rest[near], x_rest) + slack
        row, col = np.nonzero(bound >= floor[near][:, None])
        keep = q_own[near[row]] != own[col]
        row, col = near[row[keep]], col[keep]
        for b in range(0, len(row), 1 << 18):
            r, c = row[b : b + (1 << 18)], col[b : b + (1 << 18)]
            score = np.einsum("ij,ij->i", q[r], x[c]).astype(np.int64) if exact else np.einsum("ij,ij->i", qi[r], xi[c])
            ok = score >= floor[r]
            r, c, score = r[ok], c[ok], score[ok]
            order = np.lexsort((ids[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            best = rank < k
            kth = rank == k - 1
            np.maximum.at(floor, r[kth], score[kth])
            out.append((r[best], ids[c[best]], score[best]))
    return out


def top_k(vectors: DataFrame, query: Column, k: int = 10, scale: int = SCALE, group: int = GROUP, head: int = HEAD, lead: int = LEAD, dim: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product
    of each vector for which `query` holds, ties to the smaller id.

    Every row for which `query` holds is a query, and every other row is a
    candidate of its, those of the same id too. Vectors that are null, hold null
    or non-finite components or have a null id take no part; vectors of other
    lengths are padded with zeros. Components beyond about
    2^31 wrap as 64-bit integers do. An empty table gives no rows; other
    columns are not looked at.
    """
    spark = vectors.sparkSession
    v = materialize(integer_vectors(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    dim = dim or max(width(v, "v"), 1)
    lead = min(lead, dim)
    turn = rotation(v, dim)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    v = v.withColumn("norm", norm)
    sorted_ = materialize(v.repartitionByRange(F.desc("norm")).sortWithinPartitions(F.desc("norm"), "vec_id").select("vec_id", "row", "v"), "sorted")

    def held_rows(df):
        table = df.select("vec_id", "row", "v").toArrow()
        ids, own = (table[c].to_numpy().astype(np.int64) for c in ("vec_id", "row"))
        x = table["v"].combine_chunks()
        return ids, own, matrix(x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks), dim, np.int64) if len(ids) else np.zeros((0, dim), np.int64)

    first_ids, first_own, first_x = held_rows(v.orderBy(F.desc("norm"), "vec_id").limit(head))
    asked = v.where(query)
    groups = max(1, -(-asked.count() // group))
    asked = materialize(asked.select("vec_id", "row", "v", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")), "queries")
    parts = []
    for g in range(groups):
        q_ids, q_own, q = held_rows(asked.where(F.col("group") == g))
        if not len(q_ids):
            continue
        floor = np.full(len(q_ids), -np.inf)
        for a in range(0, len(first_ids), 256):
            score_block(first_ids[a : a + 256], first_own[a : a + 256], first_x[a : a + 256], q_own, q, turn, floor, k, lead)
        held = spark.sparkContext.broadcast((q_ids, q_own, q, turn, floor))

        def search(batches, held=held, k=k, lead=lead, dim=dim):
            q_ids, q_own, q, turn, floor = held.value
            floor = floor.copy()
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    ids, own = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                    for at, found, score in score_block(ids, own, matrix(part.column(2), dim, np.int64), q_own, q, turn, floor, k, lead):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q_own[at], q_ids[at], found, score)], names=["row", "query_id", "vec_id", "score"])

        got = arrowed(sorted_, search, "row long, query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
        parts.append(got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        if groups > 1:  # a group's queries can go from all executors once its rows are written
            parts[-1] = materialize(parts[-1], "found")
            held.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.union, parts)
