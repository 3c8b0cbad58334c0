"""Mixing sources to target weights, by DataFrame operations only.

Each source is a stream of words: its documents in the order of a hash of
their ids. The stream is cut into blocks of a fixed number of words. The
output is a sequence of shards of a fixed number of slots; every slot draws
its source from the target distribution, so a shard's source counts are
multinomial. The k-th slot of a source takes block perm_e(k mod n), with n the
source's blocks, e = k div n and perm_e a keyed Feistel permutation of the
indices, and is joined to that block.

A source's drawn slots are brought to its target in the end: what it drew
beyond its quota is handed, in slot order, to the sources that drew too few.
So a source's words differ from its target by about one block, and no block is
taken more often than max_repeats times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.frames import WORD, running_sums, same
from seqloom.session import materialize

BLOCK = 64
SHARD = 4096
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEATS = 2
ROUNDS = 4
#: Slots that a task expands from shards at a time.
TASK_SLOTS = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, most=MAX_REPEATS) -> list[float]:
    """The target of each source: its weight's part of share x all sizes, at
    most `most` times its own size; what is over is dealt again by weight
    among the others until none is above. sizes must be in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_, out = share * sum(n for _, n in sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if left * w[i] / total > most * sizes[i][1]}
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i][1])
            left -= out[i]
        open_ -= over
    return out


def permuted(i: Column, n: Column, key: Column) -> Column:
    """A permutation of 0..n-1 for each key: a Feistel network on a x b >= n
    with a = ceil(sqrt n), walked on until the result is below n. The network
    permutes a x b values of which fewer than a lie outside, so that a walk from
    inside is back inside after a steps at most; nearly all end after one."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        hi, lo = F.floor(x / b).cast("long"), F.pmod(x, b)
        for r in range(ROUNDS):
            if r % 2:
                hi = F.pmod(hi + F.pmod(F.xxhash64(lo, key, F.lit(r)), a), a)
            else:
                lo = F.pmod(lo + F.pmod(F.xxhash64(hi, key, F.lit(r)), b), b)
        return hi * b + lo

    step = lambda x, _: F.when(x < n, x).otherwise(once(x))
    first = once(i)
    return F.when(first < n, first).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), a), first, step))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row, written once."""
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key")), "sizes")


def plan(sizes: DataFrame, block: int = BLOCK, weights=WEIGHTS, share=SHARE, most=MAX_REPEATS) -> list[dict]:
    """One entry for each source, in order of code points, null last. The list
    of sources is the mix's configuration and small by contract."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be")))
    goal = targets([(r.source, r["size"]) for r in rows], weights, share, most)
    out, first = [], 0
    for i, (r, t) in enumerate(zip(rows, goal)):
        n = -(-r["size"] // block)
        mean = r["size"] / n if n else 1.0
        slots = min(round(t / mean), most * n)
        out.append({"sid": i, "source": r.source, "source_size": r["size"], "rows": r.n, "target": t, "n_blocks": n, "first": first, "quota": slots})
        first += slots
    return out


def plan_frame(docs: DataFrame, sources: list[dict]) -> DataFrame:
    return docs.sparkSession.createDataFrame(
        [(s["sid"], s["source"], s["source_size"], s["target"], s["n_blocks"], s["first"], s["quota"]) for s in sources],
        "sid int, _source string, source_size long, target double, n_blocks long, first long, quota long",
    )


def draw(sources: DataFrame, slots: int, shard: int = SHARD) -> DataFrame:
    """(shard, sid, n): multinomial counts per shard whose sums meet the quotas.

    Each slot draws a point of [0, slots) and takes the source whose interval
    holds it. The points are looked up through a grid of cells, so that the
    lookup is an equi-join for any number of sources.
    """
    spark = sources.sparkSession
    cells = 1024
    width = max(1, -(-slots // cells))
    grid = sources.where("quota > 0").select("sid", "first", (F.col("first") + F.col("quota")).alias("last"))
    grid = grid.select("*", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("last") - 1) / width))).alias("cell"))
    point = spark.range(slots).select((F.col("id") / shard).cast("long").alias("shard"), F.pmod(F.xxhash64("id", F.lit("slot")), F.lit(slots)).alias("point"))
    point = point.withColumn("cell", F.floor(F.col("point") / width))
    return point.join(grid, "cell").where("point >= first and point < last").groupBy("shard", "sid").agg(F.count("*").alias("n"))


def reconciled(drawn: DataFrame, sources: DataFrame, shards: int, slots: int) -> DataFrame:
    """(sid, shard, start, n): slots of each source by shard, with its running
    index, after overdrawn slots went to the sources that drew too few."""
    placed = running_sums(drawn, ["sid"], ["shard"], {"start": F.col("n")}, shards)
    quota = F.broadcast(sources.select("sid", "quota"))
    kept = placed.join(quota, "sid").withColumn("n", F.greatest(F.least(F.col("n"), F.col("quota") - F.col("start")), F.lit(0)))
    kept = materialize(kept.where("n > 0").select("sid", "shard", "start", "n"), "kept")
    lost = drawn.withColumnRenamed("n", "drawn").join(kept.select("sid", "shard", "n"), ["sid", "shard"], "left")
    lost = lost.select("shard", (F.col("drawn") - F.coalesce("n", F.lit(0))).alias("free")).groupBy("shard").agg(F.sum("free").alias("free")).where("free > 0")
    lost = running_sums(lost, [], ["shard"], {"at": F.col("free")}, shards)
    short = sources.select("sid", "quota").join(kept.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left")
    short = short.select("sid", F.coalesce("got", F.lit(0)).alias("got"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("need"))
    need = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    short = short.where("need > 0").select("*", F.coalesce(F.sum("need").over(need), F.lit(0)).alias("lo"))
    # both lists are cut at the multiples of a width and joined cell by cell
    width = max(1, -(-slots // 1024))
    cells = lambda lo, n: F.explode(F.sequence(F.floor(lo / width), F.floor((lo + n - 1) / width))).alias("cell")
    lost = lost.select("*", cells(F.col("at"), F.col("free")))
    short = short.select("*", cells(F.col("lo"), F.col("need")))
    more = lost.join(short, "cell").where("at < lo + need and at + free > lo").where(F.col("cell") == F.floor(F.greatest("at", "lo") / width))
    a, b = F.greatest("at", "lo"), F.least(F.col("at") + F.col("free"), F.col("lo") + F.col("need"))
    more = more.select("sid", "shard", (F.col("got") + a - F.col("lo")).alias("start"), (b - a).alias("n"))
    return kept.union(more)


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights=WEIGHTS, share=SHARE, most=MAX_REPEATS):
    """(sizes, plan, pieces): pieces are the words that the mix takes, one row
    for each part of a document in a taken block: sid, source, doc_id,
    text_key, size, block, from (first word in the document), words, epoch,
    shard.

    Null or empty texts have size 0 and no pieces; null sources are a source
    of their own; null ids and repeated rows are rows like any other; an
    empty table gives no rows; other columns of docs are not looked at.
    """
    sizes = sized(docs)
    sources = plan(sizes, block, weights, share, most)
    by_source = plan_frame(docs, sources)
    slots = sum(s["quota"] for s in sources)
    rows = sum(s["rows"] for s in sources)
    shards = -(-slots // shard)
    if slots:
        slot = reconciled(draw(by_source, slots, shard), by_source, shards, slots)
    else:
        slot = docs.sparkSession.createDataFrame([], "sid int, shard long, start long, n long")
    # a shard's slots are many rows: shards are dealt out before they become slots
    slot = slot.repartition(-(-slots // TASK_SLOTS) + 1, "sid", "shard")
    slot = slot.select("sid", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("k"))
    slot = slot.join(F.broadcast(by_source.select("sid", "n_blocks")), "sid").withColumn("epoch", F.floor(F.col("k") / F.col("n_blocks")))
    slot = slot.select("sid", "shard", "epoch", permuted(F.pmod("k", "n_blocks"), F.col("n_blocks"), F.xxhash64("sid", "epoch", F.lit("perm"))).alias("block"))
    stream = sizes.where("size > 0").join(F.broadcast(by_source.select("sid", "_source")), same(F.col("source"), F.col("_source"))).drop("_source")
    stream = running_sums(stream, ["sid"], ["doc_id", "text_key", "size"], {"start": F.col("size")}, rows)
    parts = stream.select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("block") * block, F.col("start"))
    hi = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    parts = parts.select("sid", "source", "doc_id", "text_key", "size", "block", (lo - F.col("start")).alias("from"), (hi - lo).alias("words"))
    return sizes, by_source, parts.join(slot, ["sid", "block"])


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken."""
    sizes, by_source, pieces = mix(docs, **options)
    got = pieces.groupBy("sid", "doc_id", "text_key", "size").agg(F.sum("words").alias("_taken"))
    got = got.select(F.col("sid").alias("_sid"), F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("size").alias("_size"), "_taken")
    base = sizes.join(F.broadcast(by_source), same(F.col("source"), F.col("_source")))
    # rows that repeat share what the mix took of them
    copies = base.groupBy("sid", "doc_id", "text_key", "size").agg(F.count("*").alias("copies"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    on = (F.col("sid") == F.col("_sid")) & same(F.col("doc_id"), F.col("_doc")) & (F.col("text_key") == F.col("_key")) & (F.col("size") == F.col("_size"))
    out = copies.join(got, on, "left").withColumn("_taken", F.coalesce("_taken", F.lit(0)))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    out = out.select("*", nth.alias("nth"))
    share_ = F.floor(F.col("_taken") / F.col("copies")) + F.when(F.col("nth") <= F.pmod("_taken", "copies"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", share_.cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: docs with, for each pass over its source, a row
    for each document that the pass takes words of. A text taken whole is as it
    was; of others the taken words remain, joined by spaces. n_chars, where docs
    has it, is set anew. Rows that repeat give their words in one row."""
    sizes, _, pieces = mix(docs, **options)
    key = ["doc_id", "text_key", "size"]
    ranges = pieces.groupBy(*key, "source", "epoch").agg(F.array_sort(F.collect_list(F.struct("from", "words"))).alias("ranges"), F.sum("words").alias("taken"))
    ranges = ranges.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("source").alias("_source"), "ranges", "taken")
    rows = docs.withColumn("_key", F.xxhash64("text"))
    if sizes.where("size > 0").groupBy(*key, "source").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "_key", "source"])
    on = same(F.col("doc_id"), F.col("_doc_id")) & (F.col("_key") == F.col("_text_key")) & same(F.col("source"), F.col("_source"))
    rows = rows.join(ranges, on)
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(F.col("_words"), (r["from"] + 1).cast("int"), r["words"].cast("int")))), " ")
    rows = rows.withColumn("_words", F.when(F.col("taken") != F.col("_size"), words))
    rows = rows.withColumn("text", F.when(F.col("taken") == F.col("_size"), F.col("text")).otherwise(part))
    made = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return rows.select(*[made[c].alias(c) if c in made else c for c in docs.columns])
