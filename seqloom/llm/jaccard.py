"""N-gram Jaccard join: a size-aware heavy-light join over word shingles.

A document's set holds the 64-bit hashes of its distinct shingles. Documents
with equal sets are one vertex. Small sets enumerate their subsets of the
fixed sizes that a partner's size asks for, so two small sets that link share
a subset. Large sets scan inverted lists: each posts its first shingles in a
global order, as many as any partner must share one of. The boundary between
small and large is the one of least cost under the measured sizes. Every
candidate is verified by its true intersection.

The order puts shingles first that are in one document only. To tell them
apart without counting every shingle, only those with a hash below a bound are
counted; the rest come later, by hash. A set with enough shingles of its own
among the counted ones has no others to post: it can have no partner, whatever
the corpus holds, and its text is not looked at again.

Components need not have all pairs listed. A list's first document is verified
against the others; then, in lists that still hold several components, a
document drawn per list; and only pairs of documents in different components
that are left are all verified, those first that a parity bitmap cannot rule
out. So a group of n near copies costs about n pairs, and no link is lost.
"""

from __future__ import annotations

from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.words import hashed_words, mix64, shingles, text_slices
from seqloom.operators.graph import components
from seqloom.session import arrowed, materialize

#: The hottest shingles are known to be shared and need no counting.
HOT = 1 << 18
BUFFER = 1 << 20
#: Cost of scanning one posting, in enumerated subsets.
SCAN = 8
SIZES = 64
WORDS = 8
#: Up to so many candidate ids are broadcast to pick their texts; beyond, a shuffle join does it.
PICK = 2_000_000


def least(num: int, den: int, n: int) -> int:
    """ceil(num * n / den)."""
    return -(-num * n // den)


def subset_sizes(n: int, num: int, den: int) -> range:
    """The sizes of the subsets that a set of n enumerates: a pair with larger
    size b shares at least ceil(num b / den) shingles and meets at that size."""
    return range(least(num, den, n), min(n, least(num, den, n * den // num)) + 1)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - least(num, den, n) + 1


def boundary(hist: dict[int, int], num: int, den: int, scan: int = SCAN) -> int:
    """The largest size of a small set, of least total cost."""
    light = lambda n: sum(comb(n, c) for c in subset_sizes(n, num, den))
    best, at = None, 0
    for x in range(SIZES // 2):
        cost = sum(hist.get(n, 0) * light(n) for n in range(1, x + 1))
        cost += sum(hist.get(n, 0) * scan * prefix_size(n, num, den) for n in range(least(num, den, x + 1), SIZES))
        if best is None or cost < best:
            best, at = cost, x
    return at


def subset_keys(s: np.ndarray, num: int, den: int) -> list[int]:
    """Keys of the enumerated subsets of a small set, through what they leave out."""
    from itertools import combinations

    m = mix64(s + np.uint64(0x51ED270B))
    total, out = int(m.sum(dtype=np.uint64)), []
    v = m.tolist()
    for c in subset_sizes(len(s), num, den):
        out += [(total - sum(gone) + c * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for gone in combinations(v, len(v) - c)]
    return mix64(np.array(out, dtype=np.uint64)).view(np.int64).tolist()


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists_of(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), signed(flat))


def statistics(texts: DataFrame, k: int) -> tuple[np.ndarray, dict[int, int]]:
    """(hashes of the hottest shingles, coolest first; number of sets by size).
    Counts cover all texts; a shingle counts within each buffer of a partition
    that holds it three times or more, which the hot ones do."""

    def run(batches):
        held, size = [], 0
        sizes = np.zeros(SIZES, np.int64)

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= 3
            return pa.RecordBatch.from_arrays([signed(keys[often]), pa.array(n[often], pa.int64()), pa.array(np.zeros(often.sum(), bool))], names=["key", "n", "size"])

        for _, text in text_slices(batches, 0):
            h, counts = shingles(*hashed_words(text), k)
            sizes += np.bincount(np.minimum(counts, SIZES - 1), minlength=SIZES)
            held.append(h)
            size += len(h)
            if size > BUFFER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(range(SIZES), pa.int64()), pa.array(sizes), pa.array([True] * SIZES)], names=["key", "n", "size"])

    found = materialize(arrowed(texts.select("text"), run, "key long, n long, size boolean").groupBy("size", "key").agg(F.sum("n").alias("n")), "shingles")
    hist = {r.key: r.n for r in found.where("size").collect()}
    hot = found.where("not size").orderBy(F.desc("n"), "key").limit(HOT).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    return hot[::-1].copy(), hist


def counted_share(num: int, den: int) -> float:
    """The share of the hashes that is counted: about twice what a set must post."""
    return min(1.0, 1.8 * (1 - num / den) + 0.04)


def sized(texts: DataFrame, k: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, n, set_a, set_b, low, bits): the size of each set, its
    fingerprint of 128 bits, its counted shingles, and the parity of the number
    of its shingles in each of at least n classes. Two such bitmaps, the wider
    one folded, differ in no more places than the sets do."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(np.sort(hot))
    bound = np.uint64(min(int(counted_share(num, den) * 2.0**64), 2**64 - 1))

    def run(batches):
        keys = held.value
        for part, text in text_slices(batches, 1):
            h, counts = shingles(*hashed_words(text), k)
            stop = np.cumsum(counts)
            start = stop - counts
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h), dtype=np.uint64)])
            more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(0x2545F491)), dtype=np.uint64)])
            low = np.flatnonzero(h <= bound)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h[low]), len(keys) - 1)
                low = low[keys[i] != h[low]]
            words = np.maximum(WORDS, 1 << np.ceil(np.log2(np.maximum(counts, 64) / 64)).astype(np.int64))
            first = np.cumsum(words) - words
            place = np.repeat(first * 64, counts) + (h % np.repeat((words * 64).astype(np.uint64), counts)).astype(np.int64)
            bits = np.packbits((np.bincount(place, minlength=int(words.sum()) * 64) & 1).astype(np.uint8)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int32()), signed(sums[stop] - sums[start]), signed(more[stop] - more[start]),
                 lists_of(h[low], np.diff(np.searchsorted(low, np.append(start, len(h))))), lists_of(bits, words)],
                names=["doc_id", "n", "set_a", "set_b", "low", "bits"])

    return arrowed(texts, run, "doc_id long, n int, set_a long, set_b long, low array<long>, bits array<long>")


def picked(rows: DataFrame, col: str, ids: DataFrame, how: str) -> DataFrame:
    """rows whose id is, or is not, in ids: by broadcast up to a checked size."""
    ids = F.broadcast(ids) if ids.count() <= PICK else ids
    return rows.join(ids.select(F.col("id").alias("_pick")), F.col(col) == F.col("_pick"), how)


def whole_sets(texts: DataFrame, ids: DataFrame, k: int, num: int, den: int, small: int = 0) -> DataFrame:
    """(id, set, keys) of the documents in ids; keys are a small set's subsets."""

    def run(batches):
        for part, text in text_slices(batches, 1):
            h, counts = shingles(*hashed_words(text), k)
            stop = np.cumsum(counts)
            keys = [subset_keys(h[b - n : b], num, den) if 0 < n <= small else [] for b, n in zip(stop.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), lists_of(h, counts), pa.array(keys, pa.list_(pa.int64()))], names=["id", "set", "keys"])

    some = picked(texts.select("doc_id", "text"), "doc_id", ids, "left_semi")
    return materialize(arrowed(some, run, "id long, set array<long>, keys array<long>"), "sets")


def folded(bits: Column, words: Column) -> Column:
    """A bitmap of fewer words: word i has the parity of all i + j * words."""
    part = lambda i: F.aggregate(F.sequence(F.lit(0), (F.size(bits) / words).cast("int") - 1), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(bits[i + j * words]))
    return F.when(F.size(bits) == words, bits).otherwise(F.transform(F.sequence(F.lit(0), words - 1), part))


def comparable(a: Column, b: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(a, b) * den >= F.greatest(a, b) * num


def size_class(n: Column, num: int, den: int) -> Column:
    """Sets whose sizes can link are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / log(den / num) - 1e-9).cast("int") if num < den else n.cast("int")


def room(a: Column, b: Column, num: int, den: int) -> Column:
    """In how many shingles sets of these sizes may differ and still link."""
    both = a + b
    return both - F.ceil(both * num / (num + den)) * 2


def close(a: str, b: str, num: int, den: int) -> Column:
    """Whether bitmaps of WORDS words leave room for a link."""
    apart = sum((F.bit_count(F.col(f"{a}bits")[i].bitwiseXOR(F.col(f"{b}bits")[i])) for i in range(WORDS)), F.lit(0))
    return apart <= room(F.col(f"{a}n"), F.col(f"{b}n"), num, den)


def verified(texts: DataFrame, bits: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets link. Whole bitmaps drop most others before
    any whole set is made."""
    side = lambda x: bits.select(F.col("id").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    p = pairs.distinct().join(side("u"), F.col("u") == F.col("u_id")).join(side("v"), F.col("v") == F.col("v_id"))
    words = F.least(F.size("u_bits"), F.size("v_bits"))
    p = p.withColumn("a", folded(F.col("u_bits"), words)).withColumn("b", folded(F.col("v_bits"), words))
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    pairs = materialize(p.where(apart <= room(F.col("u_n"), F.col("v_n"), num, den)).select("u", "v"), "pairs")
    s = whole_sets(texts, pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), k, num, den)
    s = s.select(F.col("id").alias("_i"), F.col("set").alias("_s"))
    p = pairs.join(s, F.col("v") == F.col("_i")).select("u", "v", F.col("_s").alias("sv"))
    p = p.join(s, F.col("u") == F.col("_i")).select("u", "v", F.size("_s").alias("a"), F.size("sv").alias("b"), F.size(F.array_intersect("_s", "sv")).alias("i"))
    return p.where((F.col("i") * den >= (F.col("a") + F.col("b") - F.col("i")) * num)).select("u", "v")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def linked(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id; two
    documents link when den * intersection >= num * union.

    Texts of fewer than k words have their whole sequence as one shingle;
    null texts and texts without words have none and link with nothing: their
    component is their own id. Every row is a document of its own: rows that
    repeat an id, with equal or with other texts, and rows with a null id link
    like all others. A component is named by the smallest id in it, null if it
    has none. An empty table gives no rows; other columns are not looked at.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hot, hist = statistics(texts, k)
    small = boundary(hist, num, den)
    light = materialize(sized(texts, k, num, den, hot), "sized")
    if distinct_ids(light):
        return components_of(texts, light, k, num, den, small)
    rows, found = by_row(texts, k, num, den, small, hot)
    out = rows.select("doc_id", F.col("row").alias("_row")).join(found, F.col("_row") == F.col("row"))
    first = out.groupBy(F.col("component_id").alias("_c")).agg(F.min("doc_id").alias("first"))
    return out.join(first, F.col("component_id") == F.col("_c")).select("doc_id", "n_shingles", F.col("first").alias("component_id"))


SET = ["n", "set_a", "set_b"]


def distinct_ids(light: DataFrame) -> bool:
    """Whether an id stands for one set, so that sets can go by the ids of their
    documents: no set is without an id, and no id has several sets."""
    one = F.struct(*SET)
    mixed = light.groupBy("doc_id").agg(F.min(one).alias("a"), F.max(one).alias("b"))
    return not mixed.where("a <> b or (doc_id is null and b.n > 0)").limit(1).count()


def by_row(texts: DataFrame, k: int, num: int, den: int, small: int, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, text), written with a number for each row; (row, n_shingles,
    component_id) by these numbers."""
    rows = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.col("row").alias("doc_id"), "text")
    light = materialize(sized(keyed, k, num, den, hot), "sized")
    return rows, components_of(keyed, light, k, num, den, small).withColumnRenamed("doc_id", "row")


def components_of(texts: DataFrame, light: DataFrame, k: int, num: int, den: int, small: int) -> DataFrame:
    """(doc_id, n_shingles, component_id), where an id stands for one set."""
    named = light.where("n > 0").groupBy(*SET).agg(F.min("doc_id").alias("rep"))
    named = named.select(*[F.col(c).alias(f"_{c}") for c in SET], "rep")
    equal = [F.col(c) == F.col(f"_{c}") for c in SET]
    others = light.where("n > 0").select("doc_id", *SET).join(named, equal).where("doc_id <> rep").select(F.col("doc_id").alias("id")).distinct()
    others = materialize(others, "others")
    reps = picked(light.where("n > 0"), "doc_id", others, "left_anti").withColumnRenamed("doc_id", "id")
    label = labels(texts, reps, k, num, den, small)
    named = named.join(label.withColumnRenamed("id", "_id"), F.col("rep") == F.col("_id"), "left").withColumn("rep", F.coalesce("component", "rep")).drop("_id", "component")
    out = light.select("doc_id", *SET).join(named, equal, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))


def posted(texts: DataFrame, reps: DataFrame, k: int, num: int, den: int, small: int) -> DataFrame:
    """(key, id, n): what each set posts. First in the order of shingles are the
    counted ones of one document, then the counted ones of several, by hash,
    then all others, by hash. Sets with enough of the first kind post nothing;
    only sets that need the third kind, and the small ones, are made again."""
    rows = reps.select("id", F.explode("low").alias("key"))
    # hot shingles are not among the rows, so no key has many
    many = F.count("*").over(Window.partitionBy("key"))
    shared = rows.select("id", "key", many.alias("many")).where("many > 1").groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list("key")).alias("shared"))
    rows = reps.select("id", "n", "low").join(shared, F.col("id") == F.col("_id"), "left")
    rows = rows.withColumn("shared", F.coalesce("shared", F.array().cast("array<long>")))
    post = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    need = F.greatest(post - (F.size("low") - F.size("shared")), F.lit(0)).cast("int")
    rows = rows.withColumn("need", F.when(F.col("n") >= least(num, den, small + 1), need).otherwise(0)).where((F.col("n") <= small) | (F.col("need") > 0))
    again = (F.col("n") <= small) | (F.col("need") > F.size("shared"))
    rows = materialize(rows.select("id", "n", "need", "shared", again.alias("again"), F.when(again, F.col("low")).alias("low")), "suspects")
    sets = whole_sets(texts, rows.where("again").select("id"), k, num, den, small).withColumnRenamed("id", "_id")
    made = rows.where("again").join(sets, F.col("id") == F.col("_id"))
    third = F.slice(F.array_sort(F.array_except("set", "low")), 1, F.greatest(F.col("need") - F.size("shared"), F.lit(1)))
    own = F.slice("shared", 1, F.greatest("need", F.lit(1)))
    own = F.when(F.col("need") > 0, own).otherwise(F.array().cast("array<long>"))
    third = F.when(F.col("need") > F.size("shared"), third).otherwise(F.array().cast("array<long>"))
    out = rows.where("not again").select("id", "n", F.explode(own).alias("key"))
    out = out.union(made.select("id", "n", F.explode(F.concat("keys", own, third)).alias("key")))
    return materialize(out.select("key", "id", "n"), "posts")


def labels(texts: DataFrame, reps: DataFrame, k: int, num: int, den: int, small: int) -> DataFrame:
    """(id, component) of the representatives that link with others."""
    posts = posted(texts, reps, k, num, den, small)
    shared = posts.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    lists = posts.join(shared, "key")
    # only rows with a row of comparable size in their list can link: one of the same class of sizes or of the next
    lists = lists.withColumn("class", size_class(F.col("n"), num, den))
    classes = lists.groupBy("key", "class").agg(F.count("*").alias("many"))
    near = classes.select("key", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)).alias("class"), "many").groupBy("key", "class").agg(F.sum("many").alias("many"))
    near = near.where("many > 1").select(F.col("key").alias("_key"), F.col("class").alias("_class"))
    lists = lists.join(near, (F.col("key") == F.col("_key")) & (F.col("class") == F.col("_class")), "left_semi").select("key", "id", "n")
    lists = materialize(lists, "lists")
    whole = reps.select("id", "n", "bits")
    bits = picked(whole, "id", lists.select("id").distinct(), "left_semi").select("id", folded(F.col("bits"), F.lit(WORDS)).alias("bits"))
    bits = materialize(bits.dropDuplicates(["id"]), "bits")
    none = lists.select("id", F.col("id").alias("component")).limit(0)

    # the first document of each list against the others
    first = lists.groupBy("key").agg(F.min(F.struct("id", "n")).alias("d"))
    pairs, lists = against(lists, first, num, den)
    pairs = pairs.join(named_bits(bits, "u"), F.col("u") == F.col("u_id")).join(named_bits(bits, "v"), F.col("v") == F.col("v_id"))
    pairs = pairs.where(close("u_", "v_", num, den))
    label = joined(none, verified(texts, whole, pairs.select("u", "v"), k, num, den))

    # in lists that still hold several components, a document drawn by list
    lists = several(lists, label, bits)
    if lists is None:
        return label
    drawn = lists.groupBy("key").agg(F.min_by(F.struct("id", "n", "component", "bits"), F.xxhash64("key", "id")).alias("d"))
    pairs, lists = against(lists, drawn, num, den)
    pairs = pairs.where(F.col("u_component") != F.col("v_component")).where(close("u_", "v_", num, den))
    label = joined(label, verified(texts, whole, pairs.select("u", "v"), k, num, den))

    # all that is left: pairs in different components that share a list
    lists = several(lists, label, bits)
    if lists is None:
        return label
    u, v = (lists.select(*[F.col(c).alias(f"{x}_{c}") for c in lists.columns]) for x in "uv")
    on = (F.col("u_key") == F.col("v_key")) & (F.col("u_component") < F.col("v_component"))
    on = on & comparable(F.col("u_n"), F.col("v_n"), num, den) & close("u_", "v_", num, den)
    pairs = u.join(v, on).select(*ordered(F.col("u_id"), F.col("v_id")))
    return joined(label, verified(texts, whole, pairs, k, num, den))


def named_bits(bits: DataFrame, side: str) -> DataFrame:
    return bits.select(F.col("id").alias(f"{side}_id"), F.col("bits").alias(f"{side}_bits"))


def against(lists: DataFrame, drawn: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of each list's drawn document d with the others of comparable
    size; the lists without it: all of its pairs in the list are known)."""
    rows = lists.join(drawn.select(F.col("key").alias("_key"), "d"), F.col("key") == F.col("_key")).where(F.col("id") != F.col("d.id"))
    fields = [c for c in lists.columns if c != "key"]
    pairs = rows.where(comparable(F.col("n"), F.col("d.n"), num, den))
    pairs = pairs.select(*ordered(F.col("id"), F.col("d.id")), *[F.col(c).alias(f"u_{c}") for c in fields if c != "id"], *[F.col(f"d.{c}").alias(f"v_{c}") for c in fields if c != "id"])
    if "bits" not in fields:
        pairs = pairs.distinct()
    return pairs, rows.select("key", "id", "n")


def several(lists: DataFrame, label: DataFrame, bits: DataFrame) -> DataFrame | None:
    """The rows, with component and bitmap, of lists with several components."""
    label = label.select(F.col("id").alias("_i"), "component")
    rows = lists.join(label, F.col("id") == F.col("_i"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    keys = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    rows = materialize(rows.join(keys, "key").join(bits, "id").select("key", "id", "n", "component", "bits"), "mixed")
    return rows if rows.limit(1).count() else None


def joined(label: DataFrame, edges: DataFrame) -> DataFrame:
    """label after edges have joined its components."""
    of = lambda x: label.select(F.col("id").alias(f"_{x}"), F.col("component").alias(f"c{x}"))
    e = edges.join(of("u"), F.col("u") == F.col("_u"), "left").join(of("v"), F.col("v") == F.col("_v"), "left")
    e = e.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv"))
    e = materialize(e, "edges")
    top = components(e.select(F.col("cu").alias("u"), F.col("cv").alias("v"))).select(F.col("id").alias("_c"), F.col("component").alias("_top"))
    ids = label.union(e.select("u", "cu")).union(e.select("v", "cv")).distinct()
    out = ids.join(top, F.col("component") == F.col("_c"), "left").select("id", F.coalesce("_top", "component").alias("component"))
    return materialize(out, "label")


def first_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose document is the first of its group of linked
    ones: the one of smallest id, once. Texts without words are in no group and
    stay. Rows that repeat an id or have none are documents of their own, as in
    linked(); null ids come last."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hot, hist = statistics(texts, k)
    small = boundary(hist, num, den)
    light = materialize(sized(texts, k, num, den, hot), "sized")
    again = light.where("n > 0").groupBy("doc_id").agg(F.count("*").alias("many")).where("many > 1")
    if not distinct_ids(light) or again.limit(1).count():
        keyed = materialize(docs.withColumn("_row_of_docs", F.monotonically_increasing_id()), "rows")
        texts = keyed.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("_row_of_docs").alias("row"))
        found = components_of(texts.select(F.col("row").alias("doc_id"), "text"), materialize(sized(texts.select(F.col("row").alias("doc_id"), "text"), k, num, den, hot), "sized"), k, num, den, small)
        found = found.join(texts.select("row", F.col("doc_id").alias("_doc")), F.col("doc_id") == F.col("row"))
        first = found.groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", "row")).alias("first"))
        kept = materialize(first.select(F.col("first.row").alias("_kept")), "kept")
        return keyed.join(kept, F.col("_row_of_docs") == F.col("_kept"), "left_semi").drop("_row_of_docs")
    rows = components_of(texts, light, k, num, den, small)
    gone = materialize(rows.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    return picked(docs, "doc_id", gone, "left_anti")
