"""Embedding near-duplicates by spherical-cap filters.

Filter directions are structured random product codes: the rotated space is
cut into blocks, every block has a few random unit vectors, and a direction is
one vector of each block side by side. A vector's inner product with a
direction is the sum of its blocks', so the directions that exceed a cap's
height are listed by list decoding: only block vectors, and then only sums over
half of the blocks, that can still reach the height are combined. Two near
vectors exceed a common direction with a probability that does not depend on
their number: as caps get higher with the table, more codes are used, so many
that a pair just at the threshold is missed with probability MISS at most, by a
simulation of such pairs.

Vectors meet by direction in two steps. First only ids and 128-bit sketches
travel; what has a partner of a near sketch in a bucket is cut into groups of
such partners, and a group that several directions gave counts once. Then the
vectors of the groups travel, and all pairs of a group are verified by cosine
in double precision.

A bucket is cut into chunks and compared chunk by chunk in matrix products, so
no bucket has to fit a task. A pair that meets in several groups counts at the
first; a large chunk pair reports link counts for each vector and a spanning
forest of its links, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.vectors import finite, matrix, width
from seqloom.llm.words import mix64
from seqloom.operators.graph import components
from seqloom.session import arrowed, materialize

COSINE = 0.93
BLOCKS = 4
#: Directions a vector exceeds, on average over random vectors, in each code.
EXPECTED = 3
#: At least so many directions are kept for each vector, the best ones.
AT_LEAST = 3
#: Vectors for each direction of a code.
FILL = 16
#: The chance to miss a pair that is just at the threshold.
MISS = 5e-4
CHUNK = 1024
#: Buckets of up to so many rows are compared many at a time.
SMALL = 48
SEED = 20240611
#: Bits of a sketch; sketches of a pair at the threshold differ in more places
#: than the bound with a probability of less than 1e-6.
BITS = 128
SIGMAS = 5.5


def code_size(rows: int, blocks: int = BLOCKS) -> int:
    """Vectors per block: a direction for every FILL rows, so that the vectors
    that meet by chance stay as few at every size."""
    return max(round((max(rows, 1) / FILL) ** (1 / blocks)), 4)


def top(values: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row with their ids."""
    if k >= values.shape[1]:
        return values, ids
    i = np.argpartition(-values, k - 1, axis=1)[:, :k]
    return np.take_along_axis(values, i, 1), np.take_along_axis(ids, i, 1)


def halves(y: np.ndarray, bounds, vectors, height: float, at_least: int):
    """For both halves of the blocks: the sums that can reach the height with
    the best of the other half, and their numbers."""
    parts = [y[:, a:b] @ c.T for (a, b), c in zip(zip(bounds[:-1], bounds[1:]), vectors)]
    size, n = parts[0].shape[1], len(y)
    best = [p.max(1) for p in parts]
    slack = np.maximum(sum(best) - height, 0)
    kept = []
    for p, most in zip(parts, best):
        k = max(at_least, int((p >= (most - slack)[:, None]).sum(1).max(initial=0)))
        kept.append(top(p, np.broadcast_to(np.arange(size), p.shape), k))
    sums = []
    for (v, i), (w, j) in (kept[:2], kept[2:]):
        sums.append(((v[:, :, None] + w[:, None, :]).reshape(n, -1), (i[:, :, None] * size + j[:, None, :]).reshape(n, -1)))
    out = []
    for (v, i), (w, _) in (sums, sums[::-1]):
        k = max(at_least, int((v >= (height - w.max(1))[:, None]).sum(1).max(initial=0)))
        out.append(top(v, i, k))
    return out, size


def product_code(dim: int, size: int, seed: int, blocks: int = BLOCKS, expected: float = EXPECTED):
    """(rotation, block bounds, vectors of each block, cap height)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    wide = max(dim, blocks)
    turn = np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dim]
    bounds = np.linspace(0, wide, blocks + 1).astype(int)
    code = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        c = rng.normal(size=(size, b - a))
        code.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    sample = rng.normal(size=(512, wide))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    sides, _ = halves(sample, bounds, code, np.inf, min(size, 40))
    sides = [-np.sort(-v, axis=1) for v, _ in sides]
    lo, hi = 0.0, 4.0
    for _ in range(40):
        mid = (lo + hi) / 2
        n = np.mean([np.searchsorted(-b, -(mid - a), side="right").sum() for a, b in zip(*sides)])
        lo, hi = (mid, hi) if n > expected else (lo, mid)
    return turn, bounds, code, lo


def decode(x: np.ndarray, code, at_least: int = AT_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction): for each unit vector the numbers of its filter
    directions, all that exceed the height, or the at_least best ones if fewer
    do."""
    turn, bounds, vectors, height = code
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ((v, i), (w, j)), size = halves(x @ turn, bounds, vectors, height, at_least)
    both = (v[:, :, None] + w[:, None, :]).reshape(len(x), -1)
    k = min(at_least, both.shape[1]) - 1
    least = np.minimum(-np.partition(-both, k, axis=1)[:, k], height)
    row, at = np.nonzero(both >= least[:, None])
    a, b = at // w.shape[1], at % w.shape[1]
    return row, i[row, a].astype(np.int64) * (size * size) + j[row, b]


def codes_for(dim: int, size: int, cosine: float, miss: float = MISS, pairs: int = 2048) -> list:
    """So many codes that random pairs at the threshold meet nowhere with
    probability miss at most: the share that each code misses is measured."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    wide = max(dim, 2)
    x, z = rng.normal(size=(2, pairs, wide))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    x, y = x[:, :dim], (cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z)[:, :dim]
    out, left = [], 1.0
    while left > miss and len(out) < 64:
        code = product_code(dim, size, SEED + len(out))
        hit = 0
        for lo in range(0, pairs, 256):
            (a, f), (b, g) = (decode(s[lo : lo + 256], code) for s in (x, y))
            hit += len(np.unique(a[np.isin(a * size**BLOCKS + f, b * size**BLOCKS + g)]))
        left *= max(1 - hit / pairs, 0.5 / pairs)
        out.append(code)
    return out


def planes(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED - 1)).normal(size=(dim, BITS))


def sketch_bound(cosine: float) -> int:
    """In how many bits the sketches of two near vectors may differ."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return int(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)) + 1)


def filtered(reps: DataFrame, dim: int, codes: list) -> DataFrame:
    """(label, filter, rep, a, b): a row for each direction of every
    representative, with its sketch in two halves."""
    held = reps.sparkSession.sparkContext.broadcast((codes, planes(dim)))

    def run(batches):
        codes, sides = held.value
        space = len(codes[0][2][0]) ** BLOCKS
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x = matrix(part.column(2), dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                bits = np.packbits(x @ sides > 0, axis=1).view(np.int64)
                found = [decode(x, c) for c in codes]
                row = np.concatenate([r for r, _ in found])
                filter_ = np.concatenate([f + k * space for k, (_, f) in enumerate(found)])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(1).take(at), pa.array(filter_), part.column(0).take(at), pa.array(bits[row, 0]), pa.array(bits[row, 1])], names=["label", "filter", "rep", "a", "b"])

    return arrowed(reps.select("rep", "label", "v"), run, "label long, filter long, rep long, a long, b long")


def chunked(posts: DataFrame, key: list[str], chunk: int) -> DataFrame:
    """posts with chunks, i, j, chunk: the pairs of chunks that a row is in;
    buckets of up to chunk rows are one chunk, and the one pair 0, 0."""
    big = posts.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    big = materialize(big.select(*[F.col(c).alias(f"_{c}") for c in key], F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "big")
    on = [F.col(c) == F.col(f"_{c}") for c in key]
    if not big.limit(1).count():
        return posts.select("*", F.lit(1).alias("chunks"), *[F.lit(0).alias(c) for c in ("i", "j", "chunk")])
    posts = posts.join(big, on, "left").drop(*[f"_{c}" for c in key]).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    posts = posts.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    return posts.select("*", others).select("*", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")).drop("other")


def runs(batches, width: int, most: int = 1 << 16):
    """(table, first row of each run of equal values in the first `width`
    columns, with the end): whole runs, of about `most` rows together."""
    held, size = [], 0

    def cut(table):
        ks = np.stack([table.column(n).to_numpy().astype(np.int64) for n in range(width)], 1)
        return np.concatenate([[0], np.flatnonzero((ks[1:] != ks[:-1]).any(1)) + 1, [len(ks)]])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size > most:
            table = pa.Table.from_batches(held).combine_chunks()
            at = cut(table)
            if len(at) > 2:
                yield table.slice(0, at[-2]), at[:-1]
                table = table.slice(at[-2]).combine_chunks()
            held, size = table.to_batches(), table.num_rows
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def small_pairs(at: np.ndarray, most: int):
    """(a, b) of all pairs of rows in the same run, for runs of up to most rows."""
    size = np.diff(at)
    run = np.repeat(np.arange(len(size)), size)
    ok = np.repeat(size <= most, size)
    for d in range(1, min(int(size[size <= most].max(initial=0)), most)):
        a = np.flatnonzero(ok[:-d] & (run[:-d] == run[d:]))
        if len(a):
            yield a, a + d


def spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest label that each row reaches through the pairs."""
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def groups(posts: DataFrame, bound: int, chunk: int) -> DataFrame:
    """(label, group, rep): what has partners of near sketches in a bucket, in
    the groups that these partners make; equal groups are one. In a bucket of
    several chunks all such rows are one group."""
    names = ["label", "filter", "i", "j"]
    rows = chunked(posts, ["label", "filter"], chunk).select(*names, "chunk", "rep", "a", "b", "chunks")

    def run(batches):
        for table, at in runs(batches, 4):
            label, filter_, i, j, side, rep, a, b, chunks = (table.column(n).to_numpy() for n in range(9))
            n, a, b = len(rep), a.view(np.uint64), b.view(np.uint64)
            comp, near = np.arange(n), np.zeros(n, bool)
            u, v = [], []
            for x, y in small_pairs(at, SMALL):
                close = np.bitwise_count(a[x] ^ a[y]) + np.bitwise_count(b[x] ^ b[y]) <= bound
                u.append(x[close])
                v.append(y[close])
            if u:
                u, v = np.concatenate(u), np.concatenate(v)
                comp = spread(comp, u, v)
                near[u] = near[v] = True
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo > SMALL or i[lo] != j[lo]:
                    s = slice(lo, hi)
                    close = np.bitwise_count(a[s, None] ^ a[None, s]) + np.bitwise_count(b[s, None] ^ b[None, s]) <= bound
                    np.fill_diagonal(close, False)
                    if i[lo] != j[lo]:
                        close &= side[s, None] != side[None, s]
                    near[s] = close.any(1)
                    own = np.arange(hi - lo)
                    while True:
                        new = np.minimum(own, np.where(close, own[None, :], hi - lo).min(1))
                        new = new[new]
                        if (new == own).all():
                            break
                        own = new
                    comp[s] = lo + own
            keep = np.flatnonzero(near)
            if not len(keep):
                continue
            # a group's name: the hash of its members; one of several chunks is named by its direction
            mixed = mix64(rep[keep].view(np.uint64) + np.uint64(0x632BE59B))
            first, owner = np.unique(comp[keep], return_inverse=True)
            total = np.zeros(len(first), np.uint64)
            np.add.at(total, owner, mixed)
            name = mix64(total)[owner]
            name = np.where(chunks[keep] == 1, name, mix64(filter_[keep].view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays([pa.array(label[keep]), pa.array(name.view(np.int64)), pa.array(rep[keep])], names=["label", "group", "rep"])

    return arrowed(rows.repartition(*names).sortWithinPartitions(*names), run, "label long, group long, rep long").distinct()


def first_meeting(f: int, mine: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Whether f is the smallest group that two vectors share, for all pairs."""
    earlier = [[x[x < f] for x in side] for side in (mine, other)]
    common = np.intersect1d(np.concatenate(earlier[0] or [np.zeros(0, np.int64)]), np.concatenate(earlier[1] or [np.zeros(0, np.int64)]))
    if not len(common):
        return np.ones((len(mine), len(other)), bool)
    marks = []
    for side in earlier:
        m = np.zeros((len(side), len(common)), np.float32)
        owner = np.repeat(np.arange(len(side)), [len(x) for x in side])
        flat = np.concatenate(side)
        at = np.searchsorted(common, flat)
        at = np.minimum(at, len(common) - 1)
        hit = common[at] == flat
        m[owner[hit], at[hit]] = 1
        marks.append(m)
    return marks[0] @ marks[1].T < 0.5


def compared(f: int, a: dict, b: dict, own: bool, cosine: float):
    """(vertex, links, forest edge) rows of a pair of chunks; own: they are one."""
    near = a["x"] @ b["x"].T >= cosine
    if own:
        near &= np.tri(len(near), k=-1, dtype=bool)
    if not near.any():
        return []
    keep_a, keep_b = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    near = near[np.ix_(keep_a, keep_b)]
    near &= first_meeting(f, [a["lists"][i] for i in keep_a], [b["lists"][i] for i in keep_b])
    ra, rb = a["rep"][keep_a], b["rep"][keep_b]
    ca, cb = near @ b["copies"][keep_b], a["copies"][keep_a] @ near
    out = [(r, n, None) for r, n in zip(ra.tolist(), ca.tolist()) if n] + [(r, n, None) for r, n in zip(rb.tolist(), cb.tolist()) if n]
    # a spanning forest of the links found here
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    la, lb = ra.tolist(), rb.tolist()
    for i in range(len(la)):
        for j in np.flatnonzero(near[i]).tolist():
            x, y = root(la[i]), root(lb[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((la[i], 0, lb[j]))
    return out


def verified(members: DataFrame, reps: DataFrame, dim: int, cosine: float, chunk: int) -> DataFrame:
    """(u, n, v): links of each vector, in parts, and edges that join the linked
    ones. A pair counts in the first group that both are in."""
    lists = members.groupBy("rep").agg(F.array_sort(F.collect_list("group")).alias("lists"))
    wide = reps.select("rep", "v", "copies").join(lists, "rep").select(F.col("rep").alias("_rep"), "v", "copies", "lists")
    names = ["label", "group", "i", "j"]
    rows = chunked(members, ["label", "group"], chunk).join(wide, F.col("rep") == F.col("_rep"))
    rows = rows.select(*names, "chunk", "rep", "copies", "lists", "v")

    def run(batches):
        for table, at in runs(batches, 4, 1 << 14):
            group, i, j, side, rep, copies = (table.column(n).to_numpy() for n in range(1, 7))
            many, flat = (x for x in (table.column(7).combine_chunks().value_lengths().to_numpy(), table.column(7).combine_chunks().flatten().to_numpy()))
            stop = np.cumsum(many)
            x = matrix(table.column(8).combine_chunks(), dim)
            x = x / np.sqrt((x**2).sum(1))[:, None]
            out = []
            padded = np.full((len(rep), int(many.max())), np.iinfo(np.int64).max)
            padded[np.repeat(np.arange(len(rep)), many), np.arange(len(flat)) - np.repeat(stop - many, many)] = flat
            for a, b in small_pairs(at, SMALL):
                for lo in range(0, len(a), 4096):
                    u, v = a[lo : lo + 4096], b[lo : lo + 4096]
                    near = np.flatnonzero(np.einsum("ij,ij->i", x[u], x[v]) >= cosine)
                    u, v = u[near], v[near]
                    mine = padded[u]
                    earlier = (mine[:, :, None] == padded[v][:, None, :]) & (mine < group[u][:, None])[:, :, None]
                    first = ~earlier.any((1, 2))
                    u, v = u[first], v[first]
                    out += [(rep[u], copies[v], rep[v]), (rep[v], copies[u], np.full(len(v), -1))]
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo > SMALL:
                    got = []
                    for c in dict.fromkeys((i[lo], j[lo])):
                        own = lo + np.flatnonzero(side[lo:hi] == c)
                        got.append({"rep": rep[own], "copies": copies[own], "x": x[own], "lists": [flat[stop[r] - many[r] : stop[r]] for r in own]})
                    if all(len(g["rep"]) for g in got):
                        found = compared(group[lo], got[0], got[-1], i[lo] == j[lo], cosine)
                        if found:
                            u, n, v = zip(*found)
                            out.append((np.array(u), np.array(n), np.array([-1 if y is None else y for y in v])))
                elif i[lo] != j[lo]:
                    raise AssertionError("chunk pairs are never small")
            if out:
                u, n, v = (np.concatenate(c).astype(np.int64) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n), pa.array(v, mask=v < 0)], names=["u", "n", "v"])

    return arrowed(rows.repartition(*names).sortWithinPartitions(*names), run, "u long, n long, v long")


def linked(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK, miss: float = MISS) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null labels are compared. Vectors that are null,
    zero, or hold null or non-finite components link with nothing, nor do rows
    with a null id. Equal vectors (by a hash of 128 bits) are one representative
    with a multiplicity. Rows that repeat a vec_id are vectors each. Vectors of
    other lengths are padded with zeros. An empty table gives no rows; other
    columns are not looked at.
    """
    v = F.col("embedding")
    some = F.exists(v, lambda x: x != 0)
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(v) & F.coalesce(some, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.when(ok, v).alias("v"))
    rows = rows.withColumn("a", F.xxhash64("v")).withColumn("b", F.xxhash64(F.lit(1), "v"))
    key = ["label", "a", "b"]
    reps = rows.where("v is not null").groupBy(*key).agg(F.first("v").alias("v"), F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    most = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    dim = max(width(reps, "v"), 1)
    posts = materialize(filtered(reps, dim, codes_for(dim, code_size(most), cosine, miss)), "posts")
    members = materialize(groups(posts, sketch_bound(cosine), chunk), "members")
    found = materialize(verified(members, reps, dim, cosine, chunk), "found")
    label = components(found.where("v is not null").select("u", "v")).select(F.col("id").alias("_id"), "component")
    links = found.groupBy(F.col("u").alias("_u")).agg(F.sum("n").alias("links"))
    named = reps.select(*key, "first", "copies", "rep").join(links, F.col("rep") == F.col("_u"), "left").join(label, F.col("rep") == F.col("_id"), "left")
    named = materialize(named.select(*key, "first", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component"), "named")
    least = named.where("component is not null").groupBy(F.col("component").alias("_component")).agg(F.min("first").alias("least"))
    named = named.join(least, F.col("component") == F.col("_component"), "left")
    named = named.select(*[F.col(c).alias(f"_{c}") for c in key], "links", F.coalesce("least", "first").alias("component"))
    on = [F.col(c) == F.col(f"_{c}") for c in key]
    ids = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("label")).alias("label"), "a", "b")
    out = ids.join(named, on, "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
