"""Seed-and-verify, overlap, neighbour and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import hamming, is_acgt, reverse_complement
from seqloom.operators import buckets
from seqloom.operators.kmers import block_minimizers, exploded, filter_of, minimizers
from seqloom.operators.rolling import LONGEST
from seqloom.operators.sampling import kept_first, running
from seqloom.session import arrowed, materialize, widened


def capped(rows: DataFrame, key: str, cap: int) -> DataFrame:
    """rows whose key occurs at most cap times: what keeps a seed join from the
    square of a repeat, as the seed indexes of short-read tools do. The keys are
    counted with partial sums and joined back, so a hot key meets in no task."""
    good = rows.groupBy(key).agg(F.count("*").alias("_many")).where(F.col("_many") <= cap).select(key)
    return rows.join(good, key, "left_semi")


def seed_hits(reads: DataFrame, contigs: DataFrame, w: int = 10, k: int = 15) -> DataFrame:
    """(read_id, n_seeds, n_hits): a read's minimizers, and where they occur in
    the contigs, without listing the pairs."""
    q = minimizers(reads, "read_id", w, k)
    t = minimizers(contigs.select("cid", F.col("s").alias("seq")), "cid", w, k).groupBy("value").agg(F.count("*").alias("n"))
    return q.join(t, "value", "left").groupBy("read_id").agg(F.count("*").alias("n_seeds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"))


def mapped(reads: DataFrame, contigs: DataFrame, w: int = 10, k: int = 15, top: int = 10) -> DataFrame:
    """(read_id, cid, start, rc, seeds, mm): the first of a read's ten best seed
    chains that fits with at most a tenth of its bases different; as it is, and
    where no chain fits from the other strand. All places of a seed count; contigs
    of equal text are the first of them, so that copies do not multiply."""
    places = contigs.groupBy("s").agg(F.min("cid").alias("cid"))
    v = views(reads, "read_id").select((F.col("read_id") * 2 + F.col("view")).alias("vid"), "seq")
    q = minimizers(v, "vid", w, k)
    t = minimizers(places.select("cid", F.col("s").alias("seq")), "cid", w, k).select("cid", F.col("value").alias("_value"), F.col("pos").alias("t_pos"), F.col("rc").alias("t_rc"))
    hits = q.join(t, (F.col("value") == F.col("_value")) & (F.col("rc") == F.col("t_rc")))
    chains = hits.groupBy("vid", "cid", (F.col("t_pos") - F.col("pos")).alias("start")).agg(F.count("*").alias("seeds")).where("start >= 0")
    best = Window.partitionBy("vid").orderBy(F.desc("seeds"), "cid", "start")
    chains = chains.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    rows = chains.join(v, "vid").join(places, "cid")
    rows = rows.select("*", F.col("s").substr(F.col("start") + 1, F.length("seq")).alias("there")).where(F.length("there") == F.length("seq"))
    rows = rows.withColumn("mm", hamming("seq", "there")).where(F.col("mm") <= F.greatest(F.lit(1), F.floor(F.length("seq") / 10)))
    rows = rows.select(F.floor(F.col("vid") / 2).alias("read_id"), (F.col("vid") % 2 == 1).alias("rc"), "cid", "start", "seeds", "mm", "rank")
    first = Window.partitionBy("read_id").orderBy("rc", "rank")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("read_id", "cid", "start", "rc", "seeds", "mm")


def mates(pairs: DataFrame, contigs: DataFrame, mean: int, spread: int, step: int = 5) -> DataFrame:
    """(read_id, mate_pos, mm): the place of fewest mismatches of the mate's
    other strand, every five bases within three spreads of the expected place;
    pairs: read_id, cid, pos, mate_seq."""
    shift = F.explode(F.sequence(F.lit(-3 * spread), F.lit(3 * spread), F.lit(step)))
    rows = pairs.select("read_id", "cid", "pos", reverse_complement("mate_seq").alias("m"), shift.alias("d"))
    rows = rows.withColumn("at", F.col("pos") + mean + F.col("d")).where("at >= 0").join(contigs.select("cid", "s"), "cid")
    rows = rows.where(F.col("at") + F.length("m") <= F.length("s")).select("read_id", "at", hamming("m", F.col("s").substr(F.col("at") + 1, F.length("m"))).alias("mm"))
    best = rows.groupBy("read_id").agg(F.min(F.struct("mm", "at")).alias("b"))
    return best.select("read_id", F.col("b.at").alias("mate_pos"), F.col("b.mm").alias("mm"))


def mated(pairs: DataFrame, contigs: DataFrame, mean: int, spread: int, most: int, step: int = 5) -> DataFrame:
    """(read_id, cid, pos, rc, mm, near) of the mates of pairs (read_id, cid,
    pos, mate_seq): the best place near the first mate, if at most `most` bases
    differ there; else, and where the first mate has no place (null cid or pos),
    the place that mapped() gives the mate. Mates that fit nowhere have no row."""
    placed_ = pairs.where(F.col("cid").isNotNull() & F.col("pos").isNotNull())
    near = materialize(mates(placed_, contigs, mean, spread, step).where(F.col("mm") <= most).join(placed_.select("read_id", "cid"), "read_id"), "near")
    rest = pairs.join(near.select("read_id"), "read_id", "left_anti").select("read_id", F.col("mate_seq").alias("seq"))
    far = mapped(rest, contigs).select("read_id", "cid", F.col("start").cast("int").alias("pos"), "rc", "mm", F.lit(False).alias("near"))
    return near.select("read_id", "cid", F.col("mate_pos").cast("int").alias("pos"), F.lit(True).alias("rc"), "mm", F.lit(True).alias("near")).union(far)


def views(seqs: DataFrame, key: str = "uid") -> DataFrame:
    """Both strands: (key, view, seq), view 0 as given and 1 from the other strand."""
    both = F.array(F.struct(F.lit(0).alias("view"), F.col("seq").alias("seq")), F.struct(F.lit(1).alias("view"), reverse_complement("seq").alias("seq")))
    return widened(seqs.select(key, F.explode(both).alias("x")).select(key, "x.*"))


def overlaps(seqs: DataFrame, key: str = "uid", least: int = 24, top: int = 8) -> DataFrame:
    """(to_id, to_view, from_id, from_view, overlap): for each strand of a
    sequence, the `top` longest suffixes of others that equal its prefix.

    Prefixes and suffixes of every length from `least` on meet by two hashes, so
    that only overlaps meet, however often a passage occurs; of those up to LONGEST
    bases, only such leave their task as end, or begin, as some other one may. Of
    equal suffixes only the first top + 1 are kept, one of which can be the sequence's own.
    """
    v = views(seqs, key).where(F.length("seq") >= least)
    n = F.length("seq")
    hashes = lambda x: [F.xxhash64(x), F.xxhash64(F.lit(1), x)]
    if least > LONGEST:
        sizes = F.explode(F.sequence(F.lit(least), n)).alias("n")
        head = tail = v.select(key, "view", "seq", sizes)
    else:
        # an overlap begins as a prefix of `least` bases does, and ends as a suffix does;
        # other letters than ACGT are in no filter
        pure = is_acgt("seq")
        odd = v.where(~pure).select(key, "view", "seq", F.explode(F.sequence(F.lit(least), n)).alias("n"))
        ends = lambda x: filter_of(v.select(x.alias("kmer")).where(is_acgt("kmer")), least)
        near = lambda x: exploded(v.where(pure), least, [key, "view", "seq"], canonical=False, among=ends(x))
        head = near(F.right("seq", F.lit(least))).select(key, "view", "seq", (F.col("pos") + least).alias("n")).union(odd)
        tail = near(F.left("seq", F.lit(least))).select(key, "view", "seq", (n - F.col("pos")).alias("n")).union(odd)
    a, b = hashes(F.left("seq", F.col("n")))
    head = widened(head.select(F.col(key).alias("to_id"), F.col("view").alias("to_view"), "n", a.alias("a"), b.alias("b")))
    a, b = hashes(F.right("seq", F.col("n")))
    tail = widened(tail.select(F.col(key).alias("from_id"), F.col("view").alias("from_view"), F.col("n").alias("_n"), a.alias("_a"), b.alias("_b")))
    order = F.row_number().over(Window.partitionBy("_n", "_a", "_b").orderBy("from_id", "from_view"))
    tail = tail.withColumn("r", order).where(F.col("r") <= top + 1).drop("r")
    on = (F.col("n") == F.col("_n")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    rows = head.join(tail, on).where((F.col("to_id") != F.col("from_id")) | (F.col("to_view") != F.col("from_view")))
    rows = rows.select("to_id", "to_view", "from_id", "from_view", F.col("n").alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("to_id", "to_view").orderBy(F.desc("overlap"), "from_id", "from_view"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def placed(reads: DataFrame, contigs: DataFrame, k: int = 24, parts: int = 2, most: Column | None = None) -> DataFrame:
    """(read_id, cid, pos, rc, mm): fallback placement. Seeds at a read's start,
    end and between (parts + 1 in all), both strands, give places; the one of
    fewest mismatches, at most an eighth of the read's length n or `most`, wins
    (ties: cid, pos, strand). Places of equal text around a seed count as their
    first one, and equal reads as one read, so that copies do not multiply."""
    most = F.greatest(F.lit(1), F.floor(F.col("n") / 8)) if most is None else most
    texts = materialize(reads.where(F.col("seq").isNotNull()).select("seq").distinct().select("seq", F.col("seq").alias("text")), "texts")
    v = views(texts, "text")
    n = F.length("seq")
    offs = F.array_distinct(F.array(*[F.floor((n - k) * i / parts).cast("int") for i in range(parts + 1)]))
    seeds = v.where(n >= k).select("*", n.alias("n"), F.explode(offs).alias("off")).select("*", F.col("seq").substr(F.col("off") + 1, F.lit(k)).alias("kmer"))
    index = exploded(contigs, k, ["cid"], "s", canonical=False).select("cid", "kmer", F.col("pos").alias("c_pos"))
    wanted = index.join(seeds.select("kmer", "off", "n").distinct(), "kmer").select("kmer", "off", "n", "cid", (F.col("c_pos") - F.col("off")).alias("pos")).where("pos >= 0")
    windows = wanted.join(contigs.select("cid", "s"), "cid").select("kmer", "off", "n", "cid", "pos", F.col("s").substr(F.col("pos") + 1, F.col("n")).alias("there")).where(F.length("there") == F.col("n"))
    windows = windows.groupBy("kmer", "off", "n", "there").agg(F.min(F.struct("cid", "pos")).alias("at"))
    rows = seeds.join(windows, ["kmer", "off", "n"]).select("text", "at", "view", "n", hamming("seq", "there").alias("mm")).where(F.col("mm") <= most)
    best = rows.groupBy("text").agg(F.min(F.struct("mm", F.col("at.cid").alias("cid"), F.col("at.pos").alias("pos"), "view")).alias("b"))
    best = reads.select("read_id", F.col("seq").alias("text")).join(best, "text").groupBy("read_id").agg(F.min("b").alias("b"))
    return best.select("read_id", F.col("b.cid").alias("cid"), F.col("b.pos").alias("pos"), (F.col("b.view") == 1).alias("rc"), F.col("b.mm").alias("mm"))


def neighbours(seqs: DataFrame, key: str = "uid", k: int = 15, cap: int = 500, max_mm: int = 8, top: int = 20) -> DataFrame:
    """(u, v, dist): neighbours that share a block minimizer, u < v. The implied
    shift and up to two bases more or less are tried; dist is the part of the
    overlap that differs, over at least a quarter of the shorter one. A pair meets
    its sequences once, with all of its shifts."""
    m = widened(capped(block_minimizers(seqs, key, k), "kmer", cap))
    a, b = (m.select(F.col(key).alias(x), "kmer", F.col("pos").alias(f"p{x}")) for x in "uv")
    pairs = a.join(b, "kmer").where("u < v").groupBy("u", "v").agg(F.collect_set(F.col("pu") - F.col("pv")).alias("shifts"))
    s = seqs.select(F.col(key).cast("long").alias(key), "seq")
    rows = widened(pairs).join(s.select(F.col(key).alias("u"), F.col("seq").alias("a")), "u").join(s.select(F.col(key).alias("v"), F.col("seq").alias("b")), "v")
    rows = arrowed(rows.select(F.col("u").cast("long"), F.col("v").cast("long"), "shifts", "a", "b"), buckets.near_shifts(2, max_mm), "u long, v long, part double")
    best = rows.groupBy("u", "v").agg(F.round(F.min("part"), 6).alias("dist"))
    both = best.union(best.select("v", "u", "dist"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("dist", "v"))
    near = both.withColumn("rank", rank).where(F.col("rank") <= top)
    return near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "dist").distinct()


def sampled_buckets(seqs: DataFrame, key: str = "uid", hashes: int = 8, places: int = 8, cap: int = 200, width: int = 100, step: int = 13) -> DataFrame:
    """(rows: array of id, seq) of the sequences of `width` bases that agree in all
    sampled places of one of the hashes, in buckets of 2 to cap rows. Place j of
    hash h is (h * 31 + j * step) mod width."""
    rows = _sampled(seqs, key, hashes, places, width, step)
    # the join deals rows by bucket, so the lists need no other exchange
    good = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).select("bucket")
    return rows.join(good, "bucket", "left_semi").groupBy("bucket").agg(F.collect_list(F.struct("id", "seq")).alias("rows")).select("rows")


def _sampled(seqs: DataFrame, key: str, hashes: int = 8, places: int = 8, width: int = 100, step: int = 13) -> DataFrame:
    """(id, seq, bucket) of the sequences of sampled_buckets(), one row for each hash."""
    at = lambda h: F.concat(*[F.col("seq").substr((h * 31 + j * step) % width + 1, 1) for j in range(places)])
    keys = F.explode(F.array(*[F.concat(F.lit(f"{h}:"), at(h)) for h in range(hashes)]))
    rows = seqs.where((F.length("seq") == width) & F.col(key).isNotNull())
    return widened(rows.select(F.col(key).cast("long").alias("id"), "seq", keys.alias("bucket")))


def _in_buckets(seqs: DataFrame, key: str, run, width: int = 100, **how) -> DataFrame:
    """(u, v, dist) of what run() keeps of the pairs of each bucket."""
    found = arrowed(sampled_buckets(seqs, key, width=width, **how), run, "u long, v long, cost long").distinct()
    return found.select("u", "v", F.round(F.col("cost") / F.lit(width), 6).alias("dist"))


def sampled_neighbours(seqs: DataFrame, key: str = "uid", width: int = 100, hashes: int = 8, places: int = 8, cap: int = 200, step: int = 13) -> DataFrame:
    """(u, v, dist): neighbours that agree in all sampled places of one of the
    hashes; dist = (2 * mismatches) / length. A pair leaves the first bucket of 2 to
    cap rows in which it is, so that no pair is shuffled, unless an id has two rows."""
    base = materialize(seqs.where((F.length("seq") == width) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "seq"), "sequences")
    rows = _sampled(base, "id", hashes, places, width, step).withColumn("own", F.xxhash64("seq"))
    over = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("bucket"), "over")
    rows = rows.withColumn("nth", F.split("bucket", ":")[0].cast("int"))
    if over.limit(1).count():
        out = rows.drop("seq").join(over, "bucket").groupBy(F.col("id").alias("_id"), F.col("own").alias("_own")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("nth"))).alias("out"))
        rows = rows.join(materialize(out, "out"), (F.col("id") == F.col("_id")) & (F.col("own") == F.col("_own")), "left").withColumn("out", F.coalesce("out", F.lit(0)))
        rows = rows.where(F.call_function("shiftright", F.col("out"), F.col("nth")).bitwiseAND(F.lit(1)) == 0)
    else:
        rows = rows.withColumn("out", F.lit(0))
    lists = rows.groupBy("bucket").agg(F.collect_list(F.struct("id", "seq", "nth", "out")).alias("rows")).where(F.size("rows") > 1).select("rows")
    at = [[(h * 31 + j * step) % width for j in range(places)] for h in range(hashes)]
    found = arrowed(lists, buckets.every_pair(width, at), "u long, v long, cost long")
    if base.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        found = found.distinct()
    return found.select("u", "v", F.round(F.col("cost") / F.lit(width), 6).alias("dist"))


def sampled_forest(seqs: DataFrame, key: str = "uid", width: int = 100, **how) -> DataFrame:
    """(u, v, dist): those of sampled_neighbours() that are in the minimum spanning
    tree of a bucket, under the order (dist, u, v). All edges of their minimum
    spanning forest are among them, at most one for each row of a bucket."""
    return _in_buckets(seqs, key, buckets.forests(width), width, **how)


def whole_forest(seqs: DataFrame, key: str = "uid", width: int = 100, chunk: int = 200, large: int = 2048, **how) -> DataFrame:
    """sampled_forest() of all buckets, however many rows they have. One of more than
    `chunk` rows is cut into parts of about `large` by a hash of the ids, and every two
    parts meet in a list of their own: an edge that is in no tree of two parts closes a
    cycle of smaller ones there. The comparisons grow with the square of a bucket, what
    is shuffled and kept of it with the square over `large`."""
    rows = _sampled(seqs, key, width=width, **how)
    # at most a `chunk`th of the rows
    many = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("bucket", F.ceil(F.col("n") / large).cast("int").alias("parts")), "large")
    lists = rows.join(F.broadcast(many), "bucket", "left_anti").groupBy("bucket").agg(F.collect_list(F.struct("id", "seq")).alias("rows"))
    found = arrowed(lists.where(F.size("rows") > 1).select("rows"), buckets.forests(width), "u long, v long, cost long")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.join(F.broadcast(many), "bucket").select("bucket", part.alias("part"), "id", "seq", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pair = ["bucket", "i", "j"]
    rows = rows.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "seq").repartition(*pair).sortWithinPartitions(*pair)
    found = found.union(arrowed(rows, buckets.chunk_pairs(width), "u long, v long, cost long")).distinct()
    return found.select("u", "v", F.round(F.col("cost") / F.lit(width), 6).alias("dist"))


def shifted_nearest(seqs: DataFrame, key: str = "uid", most: int = 3, n: int = 4, width: int = 100, **how) -> DataFrame:
    """(u, v, dist): for each u the n of its sampled_neighbours(), on either side,
    of least shifted_distance() (ties: v); n of a bucket's row are shuffled."""
    return kept_first(_in_buckets(seqs, key, buckets.nearest(width, most, n), width, **how), ["u"], ["dist", "v"], n)


def contained(contigs: DataFrame, k: int = 31) -> DataFrame:
    """(cid, in_cid, pos, rc): contigs that lie whole in a longer one, or in an
    equal one of smaller id, on either strand; the smallest (in_cid, pos)."""
    c = contigs.where(F.length("s") >= k)
    v = views(c.select(F.col("cid").alias("uid"), F.col("s").alias("seq"))).select(F.col("uid").alias("cid"), "view", "seq", F.col("seq").substr(1, k).alias("kmer"))
    index = exploded(c, k, ["cid"], "s", canonical=False, among=filter_of(v, k)).select(F.col("cid").alias("in_cid"), "kmer", "pos")
    rows = v.join(index, "kmer").where("cid <> in_cid").join(c.select(F.col("cid").alias("in_cid"), F.col("s").alias("t")), "in_cid")
    longer = (F.length("t") > F.length("seq")) | ((F.length("t") == F.length("seq")) & (F.col("in_cid") < F.col("cid")))
    rows = rows.where(longer & (F.col("t").substr(F.col("pos") + 1, F.length("seq")) == F.col("seq")))
    best = rows.groupBy("cid").agg(F.min(F.struct("in_cid", "pos", "view")).alias("b"))
    return best.select("cid", F.col("b.in_cid").alias("in_cid"), F.col("b.pos").alias("pos"), (F.col("b.view") == 1).alias("rc"))


def as_of(points: DataFrame, starts: DataFrame, at: str, start: str, value: str) -> DataFrame:
    """points with the value of the last start at or before each: both sides in
    one sorted pass per range of `at`, the carry over ranges by a second."""
    p = points.select(F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(starts.schema[value].dataType).alias("_value"))
    s = starts.select(F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    rows = p.union(s).withColumn("_cell", F.floor(F.col("_at") / 65536))
    inside = Window.partitionBy("_cell").orderBy("_at", "_kind")
    rows = rows.select("*", F.last("_value", ignorenulls=True).over(inside).alias("_v"))
    carry = rows.where("_kind = 0").groupBy("_cell").agg(F.max_by("_value", "_at").alias("_c"))
    cells = rows.select("_cell").distinct().join(carry, "_cell", "left")
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_cell", F.last("_c", ignorenulls=True).over(before).alias("_carried"))
    out = rows.where("_kind = 1").join(cells, "_cell")
    return out.select("_row.*", F.coalesce("_v", "_carried").alias(value))


def overlapping(items: DataFrame, spans: DataFrame, cell: int = 1024, group: str = "cid") -> DataFrame:
    """All columns of both for items and spans (group, start, end) that overlap:
    an equi-join on the cells that each touches, every pair in its first one."""
    cells = lambda df: df.select("*", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))).alias("_cell"))
    right = spans.select(*[F.col(c).alias(f"s_{c}") for c in spans.columns])
    right = right.select("*", F.explode(F.sequence(F.floor(F.col("s_start") / cell), F.floor((F.col("s_end") - 1) / cell))).alias("s__cell"))
    rows = widened(cells(items)).join(right, (F.col(group) == F.col(f"s_{group}")) & (F.col("_cell") == F.col("s__cell")))
    rows = rows.where((F.col("start") < F.col("s_end")) & (F.col("s_start") < F.col("end")) & (F.col("_cell") == F.floor(F.greatest("start", "s_start") / cell)))
    return rows.drop("_cell", "s__cell", f"s_{group}")


def uncovered(spans: DataFrame, cell: int = 65536, group: str = "cid") -> DataFrame:
    """(group, start, end): where no span (group, start, end) lies, between two
    of them or before the first (start null) and behind the last (end null). Starts and
    ends are summed up in ranges of places, so a group of many spans is spread."""
    events = spans.where("end > start").select(group, F.col("start").alias("at"), F.lit(1).alias("n")).union(spans.where("end > start").select(group, "end", F.lit(-1)))
    events = events.groupBy(group, "at").agg(F.sum("n").alias("n")).withColumn("cell", F.floor(F.col("at") / cell))
    events = materialize(running(events, group, "cell", [F.col("at")], {"deep": F.col("n")}), "events")
    inside, later = Window.partitionBy(group, "cell").orderBy("at"), Window.partitionBy("_g").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = events.groupBy(F.col(group).alias("_g"), F.col("cell").alias("_cell")).agg(F.min("at").alias("_first"))
    cells = cells.select("_g", "_cell", F.min("_first").over(later).alias("_next"))
    rows = events.withColumn("_lead", F.lead("at").over(inside)).where("deep = 0").join(cells, (F.col(group) == F.col("_g")) & (F.col("cell") == F.col("_cell")))
    gaps = rows.select(group, F.col("at").alias("start"), F.coalesce("_lead", "_next").alias("end"))
    return gaps.union(events.groupBy(group).agg(F.min("at").alias("end")).select(group, F.lit(None).cast("long"), "end"))


def subtracted(items: DataFrame, spans: DataFrame, cell: int = 1024, group: str = "cid") -> DataFrame:
    """items (group, start, end, ...) without what spans (group, start, end)
    cover: a row for each remaining part, in place of the item's start and end.
    Items of a group without spans stay; empty items are no rows."""
    items = items.where("end > start")
    bounds = items.groupBy(F.col(group).alias("_b")).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
    gaps = uncovered(spans, group=group).join(bounds, F.col(group) == F.col("_b"))
    gaps = gaps.select(group, F.greatest("_lo", F.coalesce("start", "_lo")).alias("start"), F.least("_hi", F.coalesce("end", "_hi")).alias("end")).where("start < end")
    free = items.join(spans.where("end > start").select(group).distinct(), group, "left_anti").select(*items.columns)
    part = overlapping(items, gaps, cell, group).withColumns({"start": F.greatest("start", "s_start"), "end": F.least("end", "s_end")}).select(*items.columns)
    return part.union(free)


def lifted(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """Contig coordinates on a genome. variants: cid, pos (1-based), ref, alt;
    blocks: cid, start, end (in the contig), chrom, g_start, rc, one for each
    aligned run. On the other strand places count from the block's end and the
    alleles are complemented."""
    rows = overlapping(variants.withColumn("start", F.col("pos") - 1).withColumn("end", F.col("pos")), blocks)
    ahead = F.col("s_g_start") + F.col("start") - F.col("s_start")
    back = F.col("s_g_start") + F.col("s_end") - 1 - F.col("start")
    flip = lambda c: F.when(F.col("s_rc"), reverse_complement(c)).otherwise(F.col(c))
    return rows.select("cid", "pos", F.col("s_chrom").alias("chrom"), (F.when(F.col("s_rc"), back).otherwise(ahead) + 1).alias("g_pos"), flip("ref").alias("ref"), flip("alt").alias("alt"))


def haplotype_lifted(variants: DataFrame, contigs: DataFrame, genome: DataFrame, flank: int = 25, reach: int = 300) -> DataFrame:
    """(cid, pos, chrom, g_pos, g_ref, g_alt): variants (cid, pos from 1, ref,
    alt, chrom, at) in the genome's frame, found by their haplotypes. contigs:
    cid, s; genome: chrom, s; at: about where the variant lies in chrom, from 0.

    The contig's flanks around either allele are looked up within `reach` bases
    of `at`, on both strands; the allele that the genome carries is its
    reference, the other one the alternative. On the other strand both are turned,
    and those of an indel, which share their first base, get the genome's base to
    their left in its place; equal ends go. Variants whose flanks
    leave the contig, whose reference is not the contig's, or that the genome
    carries neither way, have no row."""
    rows = variants.join(contigs.select("cid", "s"), "cid")
    at, n = F.col("pos") - 1, F.length("ref")
    rows = rows.where((at >= flank) & (at + n + flank <= F.length("s")) & (F.col("s").substr(F.col("pos"), n) == F.col("ref")))
    left, right = F.col("s").substr((at - flank + 1).cast("int"), F.lit(flank)), F.col("s").substr((at + n + 1).cast("int"), F.lit(flank))
    tries = [F.struct(F.lit(i).alias("nth"), F.col(mine).alias("mine"), F.col(other).alias("other"), F.lit(turn).alias("turn"), (reverse_complement(x) if turn else x).alias("hap"))
             for i, (mine, other, turn) in enumerate((m, o, t) for m, o in (("ref", "alt"), ("alt", "ref")) for t in (False, True)) for x in [F.concat(left, mine, right)]]
    rows = rows.withColumn("try", F.explode(F.array(*tries))).select("cid", "pos", "ref", "alt", "chrom", "at", "try.*")
    rows = rows.join(genome.select("chrom", F.col("s").alias("g")), "chrom")
    low = F.greatest(F.col("at") - reach, F.lit(0))
    rows = rows.withColumn("lo", low.cast("int")).withColumn("k", F.instr(F.upper(F.col("g").substr(F.col("lo") + 1, F.lit(2 * reach))), F.col("hap"))).where("k > 0")
    first = rows.groupBy("cid", "pos", "ref", "alt").agg(F.min(F.struct("nth", "mine", "other", "turn", F.col("lo").alias("lo"), "k", "chrom")).alias("x")).select("cid", "pos", "x.*")
    first = first.join(genome.select(F.col("chrom").alias("_chrom"), F.col("s").alias("g")), F.col("chrom") == F.col("_chrom"))
    start = F.col("lo") + F.col("k") - 1 + flank  # of the allele, from 0
    before = F.upper(F.col("g").substr(start.cast("int"), F.lit(1)))
    turned = lambda c: F.concat(before, reverse_complement(c).substr(F.lit(1), F.length(c) - 1))
    plain = F.length("mine") == F.length("other")  # a substitution needs no base to its left
    allele = lambda c: F.when(~F.col("turn"), F.col(c)).when(plain, reverse_complement(c)).otherwise(turned(c))
    first = first.select("cid", "pos", "chrom", "g", F.when(F.col("turn") & ~plain, start).otherwise(start + 1).alias("g_pos"), allele("mine").alias("r"), allele("other").alias("a"))
    shared = F.least(F.length("r"), F.length("a")) - 1
    # bases that both end with, without the first one
    same = F.array_position(F.transform(F.sequence(F.lit(1), shared + 1), lambda i: (i > shared) | (F.right("r", i) != F.right("a", i))), True) - 1
    cut = lambda c: F.col(c).substr(F.lit(1), (F.length(c) - F.greatest(same, F.lit(0))).cast("int"))
    first = first.select("cid", "pos", "chrom", "g_pos", "g", cut("r").alias("g_ref"), cut("a").alias("g_alt"))
    return first.where(F.upper(F.col("g").substr(F.col("g_pos").cast("int"), F.length("g_ref"))) == F.col("g_ref")).drop("g")
