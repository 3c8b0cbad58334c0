"""Hard negatives by product quantisation with stored residual norms.

Integer vectors are cut into parts of a few components. Each part is coded by
the nearest of 256 centroids, learned from a bounded sample, and the norm of
what the code leaves of it is stored. For an anchor, a table of its parts'
products with all centroids gives a row's score by lookups, up to the sum of
the products of part and residual norms (Cauchy-Schwarz). Rows whose upper
bound stays below what is already surely found are out; all others get their
exact integer scores.

One pass over the coded rows finds each anchor's positives, a second one the
negatives in each positive's window. Tasks keep the best few of each window, so
what they send does not grow with their rows. Anchors are taken in groups of a
fixed size, one pass over the rows for each group and search.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.vectors import finite, matrix, width
from seqloom.session import arrowed, materialize

SCALE = 256
#: Components of a part, centroids of a part, rows that the centroids are learned from at most.
PART, CENTROIDS, SAMPLE = 2, 256, 8192
#: Anchors of a group; anchors and rows that are compared at a time.
GROUP, ANCHORS, ROWS = 8192, 256, 2048
#: Scores are exact up to this absolute value (a hundred of them fit a long) and held there beyond it.
LARGEST = 9 * 10**16

OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def members(vectors: DataFrame, scale: int, label: Column, anchor: Column) -> DataFrame:
    """(vec_id, label, v array<double>, asked) of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("string").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("asked"))


def cut(x: np.ndarray, part: int) -> np.ndarray:
    """Rows as (parts, rows, part), padded with zeros."""
    pad = -x.shape[1] % part
    x = np.pad(x, ((0, 0), (0, pad)))
    return np.ascontiguousarray(x.reshape(len(x), -1, part).transpose(1, 0, 2))


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    out = np.empty(len(x), np.int64)
    own = (centroids**2).sum(1)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (own - 2 * x[a : a + 4096] @ centroids.T).argmin(1)
    return out


def codebook(sample: np.ndarray, part: int, size: int = CENTROIDS, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """(parts, size, part): centroids of each part by k-means over the sample."""
    parts, rng = cut(sample, part), np.random.default_rng(seed)
    out = np.zeros((len(parts), size, part))
    for m, x in enumerate(parts):
        if not len(x):
            continue
        c = x[rng.permutation(len(x))[:size]]
        c = np.concatenate([c, np.repeat(c[:1], size - len(c), 0)])
        for _ in range(rounds):
            at = nearest(x, c)
            n = np.bincount(at, minlength=size)
            for i in range(part):
                c[:, i] = np.where(n > 0, np.bincount(at, x[:, i], size) / np.maximum(n, 1), c[:, i])
        out[m] = c
    return out


def encoded(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes: rows x parts, norms of the residuals: rows x parts, rounded up)."""
    parts = cut(x, book.shape[2])
    codes = np.stack([nearest(p, c) for p, c in zip(parts, book)], 1) if len(parts) else np.zeros((len(x), 0), np.int64)
    rest = np.stack([np.sqrt(((p - c[k]) ** 2).sum(1)) for p, c, k in zip(parts, book, codes.T)], 1) if len(parts) else np.zeros((len(x), 0))
    return codes.astype(np.uint8), np.nextafter(rest.astype(np.float32), np.float32(np.inf))


def exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs, held within LARGEST."""
    out = np.empty(len(row), np.int64)
    small = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1) < 2.0**53
    for a in range(0, len(row), 1 << 16):
        r, c = q[row[a : a + (1 << 16)]], x[col[a : a + (1 << 16)]]
        if small:
            out[a : a + (1 << 16)] = np.einsum("ij,ij->i", r, c)
        else:
            for i, (u, v) in enumerate(zip(r.tolist(), c.tolist())):
                out[a + i] = max(-LARGEST, min(LARGEST, sum(int(s) * int(t) for s, t in zip(u, v))))
    return out


class Block:
    """Coded rows, and bounds of their scores."""

    def __init__(self, batch: pa.RecordBatch, dim: int, parts: int):
        self.row, self.id, self.label = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        self.x = matrix(batch.column(3), dim)
        self.codes = matrix(batch.column(4), parts, np.uint8)
        self.rest = matrix(batch.column(5), parts)

    def bounds(self, q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) scores for anchors x rows: those by lookup, less and
        plus how far they may be off, held like scores."""
        parts = cut(q, book.shape[2])
        score, off = np.zeros((len(q), len(self.x))), np.zeros((len(q), len(self.x)))
        for m, p in enumerate(parts):
            score += (p @ book[m].T)[:, self.codes[:, m]]
            off += np.outer(np.sqrt((p**2).sum(1)), self.rest[:, m])
        off += 1e-9 * (1 + np.abs(score) + off)  # rounding
        return np.clip(score - off, -LARGEST, LARGEST), np.clip(score + off, -LARGEST, LARGEST)


class Windows:
    """The best k rows of each window so far: larger scores, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.row = np.full((n, k), -1)

    def floor(self) -> np.ndarray:
        """What a row must reach to be among a window's best."""
        return np.where(self.row[:, -1] >= 0, self.score[:, -1].astype(float), -np.inf)

    def add(self, w: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(w):
            return
        had = np.unique(w)
        own = np.repeat(had, self.k)
        w, score, ids, row = np.append(w, own), np.append(score, self.score[had].ravel()), np.append(ids, self.id[had].ravel()), np.append(row, self.row[had].ravel())
        order = np.lexsort((row, ids, -score, row < 0, w))
        w, score, ids, row = w[order], score[order], ids[order], row[order]
        nth = np.arange(len(w)) - np.searchsorted(w, w)
        ok = nth < self.k
        for held, new in ((self.score, score), (self.id, ids), (self.row, row)):
            held[w[ok], nth[ok]] = new[ok]

    def found(self) -> tuple[np.ndarray, ...]:
        w, k = np.nonzero(self.row >= 0)
        return w, self.score[w, k], self.id[w, k], self.row[w, k]


def positives_of(blocks, q_row, q_label, q, book, k: int) -> Windows:
    """The k best rows of the same label for each anchor, itself not among them."""
    best = Windows(len(q), k)
    for b in blocks:
        for a in range(0, len(q), ANCHORS):
            s = slice(a, a + ANCHORS)
            same = (q_label[s][:, None] == b.label[None, :]) & (q_row[s][:, None] != b.row[None, :])
            if not same.any():
                continue
            low, high = b.bounds(q[s], book)
            at, col = np.nonzero(same & (high >= np.maximum(best.floor()[s], sure(low, same, k))[:, None]))
            at += a
            best.add(at, exact(q, b.x, at, col), b.id[col], b.row[col])
    return best


def sure(low: np.ndarray, ok: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest lower bound of each anchor among the rows that are ok."""
    low = np.where(ok, low, -np.inf)
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]


def negatives_of(blocks, q_label, q, book, q_of: np.ndarray, score_of: np.ndarray, low: int, k: int) -> Windows:
    """The k best rows of other labels in each window: low * p <= 100 * score <=
    100 * p for the positive's score p. q_of: the anchor of each window."""
    best = Windows(len(q_of), k)
    starts = np.searchsorted(q_of, np.arange(len(q) + 1))
    least = np.array([-(-low * int(p) // 100) for p in score_of], np.int64)
    for b in blocks:
        for a in range(0, len(q), ANCHORS):
            stop = min(a + ANCHORS, len(q))
            w = np.arange(starts[a], starts[stop])
            w = w[least[w] <= score_of[w]]
            if not len(w):
                continue
            other = q_label[a:stop][:, None] != b.label[None, :]
            lo, hi = b.bounds(q[a:stop], book)
            near = q_of[w] - a
            floor = np.maximum(best.floor()[w], least[w])
            # rows of any window of an anchor get their exact score once
            need = np.zeros_like(other)
            for i in range(0, len(w), ANCHORS):
                j = near[i : i + ANCHORS]
                inside = other[j] & (lo[j] <= score_of[w[i : i + ANCHORS], None]) & (hi[j] >= floor[i : i + ANCHORS, None])
                np.logical_or.at(need, j, inside)
            at, col = np.nonzero(need)
            got = exact(q, b.x, at + a, col)
            # pairs of an anchor's rows with its windows
            n = starts[at + a + 1] - starts[at + a]
            pair = np.repeat(np.arange(len(at)), n)
            win = np.repeat(starts[at + a], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            fits = (got[pair] >= least[win]) & (got[pair] <= score_of[win]) & (got[pair] >= best.floor()[win])
            best.add(win[fits], got[pair[fits]], b.id[col[pair[fits]]], b.row[col[pair[fits]]])
    return best


def mined(vectors: DataFrame, anchor: Column, label: Column | None = None, k_positive: int = 5, k_negative: int = 5, low: int = 80, scale: int = SCALE, part: int = PART, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for each vector for which `anchor` holds, its k_positive rows of largest
    inner product with the same label, and for each of those the first
    k_negative rows of another label with low % of the positive's score to all
    of it. Components are floor(scale * x); ties go to the smaller vec_id.

    Rows with a null vec_id, label or vector, or a null or non-finite component,
    take no part; other lengths are padded with zeros. Rows that repeat a vec_id
    are rows each, also as anchors, positives (one may have its anchor's vec_id)
    and negatives. Scores are exact integers up to 9e16 and held there beyond.
    An empty table gives no rows; other columns are not looked at. Centroids are
    learned from the `sample` rows of smallest hash; every row is coded and every
    bound holds whatever the centroids are, so nothing is missed.
    """
    spark = vectors.sparkSession
    rows = members(vectors, scale, F.col("label") if label is None else label, anchor)
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.xxhash64("label").alias("label"), "v", "asked"), "members")
    dim = max(width(rows, "v"), 1)
    first = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(sample).select("v").toArrow()["v"].combine_chunks()
    first = first if isinstance(first, pa.Array) else pa.concat_arrays(first.chunks) if first.num_chunks else None
    if first is None or not len(first):
        return spark.createDataFrame([], OUT)
    book = codebook(matrix(first, dim), part)
    parts = len(book)
    held_book = spark.sparkContext.broadcast(book)

    def encode(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                piece = batch.slice(a, ROWS)
                codes, rest = encoded(matrix(piece.column(3), dim), held_book.value)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, parts), pa.int32()), pa.array(x.ravel(), t)) for x, t in ((codes.astype(np.int16), pa.int16()), (rest, pa.float32()))]
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(4)], *lists, piece.column(4)], names=["row", "vec_id", "label", "v", "codes", "rest", "asked"])

    coded = materialize(arrowed(rows, encode, "row long, vec_id long, label long, v array<double>, codes array<short>, rest array<float>, asked boolean"), "coded")
    asked = coded.where("asked")
    groups = max(1, -(-asked.count() // group))
    asked = materialize(asked.select("row", "vec_id", "label", "v", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")), "anchors")

    def blocks(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                yield Block(batch.slice(a, ROWS), dim, parts)

    def search(run, names, schema, held):
        """One pass over the coded rows; run makes Windows of blocks."""

        def task(batches):
            best = run(blocks(batches), *held.value, held_book.value)
            w, score, ids, row = best.found()
            for a in range(0, len(w), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)], pa.int64()) for x in (w, score, ids, row)], names=names)

        return arrowed(coded.drop("asked"), task, schema)

    def best_of(found: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id", "row"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    names, schema = ["w", "score", "id", "row"], "w long, score long, id long, row long"
    out = []
    for g in range(groups):
        table = asked.where(F.col("group") == g).select("row", "vec_id", "label", "v").orderBy("vec_id", "row").toArrow()
        if not table.num_rows:
            continue
        q_row, q_id, q_label = (table[c].to_numpy().astype(np.int64) for c in ("row", "vec_id", "label"))
        v = table["v"].combine_chunks()
        q = matrix(v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks), dim)
        held = spark.sparkContext.broadcast((q_row, q_label, q))
        got = best_of(search(lambda b, r, lab, x, book: positives_of(b, r, lab, x, book, k_positive), names, schema, held), k_positive)
        got = got.orderBy("w", "rank").toArrow()
        held.destroy()
        q_of, score_of, positive = (got[c].to_numpy().astype(np.int64) for c in ("w", "score", "id"))
        if not len(q_of):
            continue
        held = spark.sparkContext.broadcast((q_label, q, q_of, score_of))
        found = search(lambda b, lab, x, of, p, book: negatives_of(b, lab, x, book, of, p, low, k_negative), names, schema, held)
        pairs = pa.table({"_w": np.arange(len(q_of)), "anchor_id": q_id[q_of], "positive_id": positive, "positive_score": score_of})
        pairs = F.broadcast(spark.createDataFrame(pairs))
        found = best_of(found, k_negative).join(pairs, F.col("w") == F.col("_w"))
        found = materialize(found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
        held.destroy()
        out.append(found)
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], OUT)
