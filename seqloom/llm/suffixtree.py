"""Language-model scores by a probabilistic suffix tree over words.

A state of the tree is a context of words, as long as contexts of the length
before were retained. A context is a candidate when it occurs MIN_CONTEXT times
in the training texts, and keeps explicit next words that occur MIN_EDGE times
after it; the rest of its mass falls back to the next shorter state in
proportion, so every state's next-word probabilities sum to 1. No context is a
candidate whose suffix always has one and the same next word. A candidate is
retained when its distribution diverges from that of its longest retained
suffix: its count times the Kullback-Leibler divergence exceeds what its free
parameters cost. Contexts get longer until the states of a length gain less than
LEAST_GAIN. A text is scored with the longest retained suffix before each token.

Both floors are counts, so what is learned grows with the corpus. Contexts and
next words are rows of tables, under a hash of their words. The logarithm of a
token's probability is a sum over all word runs that end at it or just before
it, so every run has one value, and a text's score is the sum of the values of
the runs in it. What is broadcast only saves work and has a bound: the HEAD most
frequent runs, and a filter of 2^FILTER bits that tells most of the runs that no
table has. All others are found by a join.
"""

from __future__ import annotations

from functools import reduce
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.frames import fold
from seqloom.llm.jaccard import signed
from seqloom.llm.words import hashed_words, mix64, text_slices
from seqloom.session import arrowed, drop_table, drop_written, materialize, trim, written

MIN_CONTEXT = 5
MIN_EDGE = 2
#: Contexts grow until the states of a length save less than this part of the
#: training texts' code length under the words' own probabilities.
LEAST_GAIN = 1e-3
HEAD = 1 << 20
FILTER = 28
DISCOUNT = 0.5
FOLDS, HELD = 5, 1
BUFFER = 1 << 21
#: The end token; a word hashes to it with probability 2^-64.
END = np.uint64(0x454E444F46444F43)
#: The hash of a run of words is the polynomial of its words' hashes in BASE,
#: modulo 2^64; both numbers are odd, and each the other's inverse.
BASE = 0xA0761D6478BD642F
INVERSE = pow(BASE, -1, 1 << 64)


def token_stream(text) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts, each with its end; tokens per text)."""
    h, counts = hashed_words(text)
    size = counts + 1
    out = np.empty(len(h) + len(counts), np.uint64)
    stop = np.cumsum(size) - 1
    is_end = np.zeros(len(out), bool)
    is_end[stop] = True
    out[is_end] = END
    out[~is_end] = h
    return out, size


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Runs:
    """The hashes of all runs of words of some texts, each by two sums."""

    def __init__(self, tokens: np.ndarray, size: np.ndarray):
        self.size, self.start = size, np.cumsum(size) - size
        self.pos = np.arange(len(tokens)) - np.repeat(self.start, size)
        self.up = powers(BASE, len(tokens))
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * powers(INVERSE, len(tokens)), out=self.sums[1:])

    def ends(self, n: int) -> np.ndarray:
        """Where runs of n words end that lie within one text."""
        return np.flatnonzero(self.pos >= n - 1)

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        """The hashes of the runs of n words that end there."""
        return self.up[at] * (self.sums[at + 1] - self.sums[at + 1 - n])


def reduced(columns: list[np.ndarray], n: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows, told apart and sorted by their first column, and their counts."""
    order = np.argsort(columns[0])
    key = columns[0][order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
    many = np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n[order], first) if len(key) else n
    return [key[first], *[c[order[first]] for c in columns[1:]]], many.astype(np.int64)


def range_bits(rows: int) -> int:
    """Of so many rows, a range of keys has a few millions at most."""
    return max(13, rows.bit_length() - 22)


def blocks_of(bits: int, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """(ranges, one binary block for each of them from each column) of rows that
    are sorted by the first column."""
    cut = np.searchsorted(columns[0] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cut))
    ends = np.append(cut[some], cut[-1])
    block = lambda c: pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))])
    return some, [*map(block, columns)]


def summed(source: DataFrame, slices, keys_of, names: tuple[str, ...], least: int, rows: int, more=None) -> DataFrame:
    """names (all of them hashes) and n: how often each row of keys_of (arrays, by
    the first of which rows are told apart) comes up in all slices of source, from
    `least` times on. more: what makes another column of the others in the end,
    so that it need not travel.

    Buffers of bounded size are counted where they arise and leave as one block for
    each range of the first column; ranges are so many that a task can hold what
    all buffers have of one."""
    bits = range_bits(rows)
    blocks = ", ".join(f"{c} binary" for c in (*names, "n"))
    out_names = [*names, *([more[0]] if more else []), "n"]

    def run(batches):
        held, size = [], 0

        def flush():
            columns, n = reduced([np.concatenate(x) for x in zip(*held)], None)
            some, made = blocks_of(bits, [*columns, n])
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *made], names=["range", *names, "n"])

        for part in slices(batches):
            keys = keys_of(part)
            held.append(keys)
            size += len(keys[0])
            if size > BUFFER:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def merged(held):
        whole = [np.frombuffer(b"".join(x), np.uint64) for x in zip(*held)]
        return reduced(whole[:-1], whole[-1].view(np.int64))

    def merge(batches):
        at, held, size, out = None, [], 0, []

        def done():
            columns, n = merged(held)
            often = n >= least
            out.append([*[c[often] for c in columns], n[often]])

        def batch():
            *columns, n = [np.concatenate(x) for x in zip(*out)]
            columns += [more[1](*columns)] if more else []
            return pa.RecordBatch.from_arrays([*map(signed, columns), pa.array(n)], names=out_names)

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for place, *row in zip(*columns):
                if place != at and held:
                    done()
                    held, size = [], 0
                    if sum(len(x[-1]) for x in out) > 100_000:
                        yield batch()
                        out.clear()
                at = place
                held.append(row)
                size += len(row[-1])
                if size > 8 * BUFFER:  # what is distinct may be much less
                    columns_, n = merged(held)
                    held, size = [[x.tobytes() for x in (*columns_, n)]], 0
        if held:
            done()
        if out:
            yield batch()

    parts = arrowed(source, run, f"range int, {blocks}").repartition("range").sortWithinPartitions("range")
    return arrowed(parts, merge, ", ".join(f"{c} long" for c in out_names))


class Table:
    """Places of keys in a sorted list. Most are told by one look: a slot for the
    low bits of a key names the most frequent one there."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        bits = max(8, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.slot = np.full(1 << bits, -1, np.int32)
        by = np.argsort(weight[order], kind="stable").astype(np.int32)
        self.slot[(self.keys[by] & self.mask).astype(np.int64)] = by  # the last one written stays
        self.order = order

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place in keys, -1 where x is not in it."""
        if not len(self.keys):
            return np.full(len(x), -1, np.int64)
        at = self.slot[(x & self.mask).astype(np.int64)].astype(np.int64)
        other = np.flatnonzero((at >= 0) & (self.keys[at] != x))
        i = np.minimum(np.searchsorted(self.keys, x[other]), len(self.keys) - 1)
        at[other] = np.where(self.keys[i] == x[other], i, -1)
        return at


def filter_of(df: DataFrame, key: str) -> np.ndarray:
    """A bit set of the keys' low bits: at least 16 bits a key up to the bound, and
    so many that few texts are kept for runs that they do not hold."""
    bits = min(max(FILTER - 2, (16 * df.count()).bit_length()), FILTER)
    at = df.select(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("set")).toArrow()
    out = np.zeros((1 << (bits - 15), 4096), np.uint8)
    for batch in rows.to_batches(64):
        for block, part in zip(batch["block"].to_pylist(), batch["set"].to_pylist()):
            out[block] = np.frombuffer(part, np.uint8)
    del rows
    return out.reshape(-1)


def sent_out(spark, value):
    """A broadcast of value, of which the driver's Python keeps nothing: it is the
    caller's to pass the only reference."""
    held = spark.sparkContext.broadcast(value)
    del value
    trim()
    return held


def maybe(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    at = x & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent(df: DataFrame, most: int) -> DataFrame:
    """The rows of largest n, at most so many: all of an n or none."""
    held, least = 0, None
    for n, many in sorted(map(tuple, df.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().collect()), reverse=True):
        held += many
        if held > most:
            break
        least = n
    return df.where(F.lit(False) if least is None else F.col("n") >= least)


def texts_of(batches):
    """(tokens, tokens per text) of slices of texts."""
    for _, text in text_slices(batches, 0):
        yield token_stream(text)


def lists_of_tokens(batches):
    """The same of lists of hashes."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.column(0).slice(lo, 1024)
            yield part.flatten().to_numpy(zero_copy_only=False).view(np.uint64), part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def passages_kept(run: Runs, length: int, active: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of the passages whose neighbouring words are all frequent
    pairs, with the word after each, for those that hold an active run. A run that
    is frequent lies within one such passage, as all of its pairs are frequent."""
    joined = np.zeros(len(run.pos) + 1, bool)
    at = run.ends(2)
    joined[at] = maybe(pairs, run(at, 2))  # with the word before
    first = np.flatnonzero(~joined[:-1])
    stop = np.append(first[1:], len(run.pos))
    holds = np.zeros(len(run.pos) + 1, np.int64)
    np.cumsum(np.bincount(active, minlength=len(run.pos)), out=holds[1:])
    some = (holds[stop] > holds[first]) & (stop - first >= length)
    first, stop = first[some], stop[some]
    more = np.append(run.pos, 0)[stop] > 0  # the next word is of the same text
    return first, stop + more - first


def learned(train: DataFrame, vocabulary: DataFrame, total: int, distinct: int, depth: int | None = None, min_context: float = MIN_CONTEXT, min_edge: float = MIN_EDGE, least_gain: float = LEAST_GAIN) -> tuple[DataFrame | None, int]:
    """((key, value, n) of the runs of all states and explicit next words, words of
    the longest): a pass over the training texts for each context length, until
    the states of a length gain too little or none is retained. From the third length on only passages
    that hold a candidate are read, and they get fewer."""
    spark = train.sparkSession
    end = int(END.view(np.int64))
    least_context, least_edge = max(min_context, 2), max(min_edge, 2)
    log_root = F.log10((F.col("n") + 0.5) / (total + 0.5 * (distinct + 1)))
    edges = vocabulary.where(F.col("n") >= 2).select("key", "n", log_root.alias("log_p"))
    contexts = vocabulary.where((F.col("key") != end) & (F.col("n") >= least_context)).select(F.col("key").alias("ctx"), F.col("n").alias("total"))
    source, slices, pairs = train.select("text"), texts_of, None
    code_length = -(vocabulary.agg(F.sum(F.col("n") * log_root)).first()[0] or 0.0) * log(10)
    values, d, gained = [], 0, code_length
    while gained > least_gain * code_length and (depth is None or d < depth) and contexts.limit(1).count():
        d += 1
        held = [sent_out(spark, filter_of(contexts, "ctx")), sent_out(spark, filter_of(edges, "key"))]

        def keys(part, d=d, held=held, pairs=pairs):
            wanted, often, pairs = held[0].value, held[1].value, pairs and pairs.value
            of = Runs(*part)
            state, next_ = (np.zeros(len(of.pos), bool) for _ in range(2))
            at = of.ends(d)
            h = of(at, d)
            state[at], next_[at] = maybe(wanted, h), maybe(often, h)
            # next words of candidates, and longer candidates; what comes before the last word is as frequent as these
            frequent = state.copy()
            if d == 2:
                frequent[at] = maybe(pairs, h)
            at = of.ends(d + 1)
            at = at[state[at - 1] & next_[at] | state[at] & (frequent[at - 1] if d < 3 else True)]
            return of(at, d + 1), of(at - 1, d), *([of(at, d)] if d > 1 else [])

        def holding(batches, d=d, held=held, slices=slices, pairs=pairs):
            wanted, pairs = held[0].value, pairs.value
            for part in slices(batches):
                of = Runs(*part)
                at = of.ends(d)
                first, size = passages_kept(of, d, at[maybe(wanted, of(at, d))], pairs)
                flat = part[0][np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), signed(flat))], names=["tokens"])

        if d >= 3 and (d == 3 or d & (d - 1) == 0):
            source, slices = materialize(arrowed(source, holding, "tokens array<long>"), "holding"), lists_of_tokens
        # a pair's last word follows from the hashes of the pair and of its first
        names, last = (("key", "ctx"), ("shorter", lambda key, ctx: key - ctx * np.uint64(BASE))) if d == 1 else (("key", "ctx", "shorter"), None)
        found = materialize(summed(source, slices, keys, names, min(least_context, least_edge), total, last), "runs", sweep=True)
        own = found.where(F.col("n") >= least_edge).join(contexts, "ctx").join(edges.select(F.col("key").alias("shorter"), F.col("log_p").alias("log_q")), "shorter")
        own = materialize(own.select("key", "ctx", "n", "total", F.log10((F.col("n") - DISCOUNT) / F.col("total")).alias("own"), "log_q"), "nexts", sweep=True)
        for one in held:  # all that is made with them is written
            one.destroy()
        p, q = F.pow(10.0, F.col("own")), F.pow(10.0, F.col("log_q"))
        state = own.groupBy("ctx", "total").agg(F.sum(p).alias("p"), F.sum(q).alias("q"), F.sum(p * F.log(p / q)).alias("kl"), F.count("*").alias("k"), F.max("n").alias("top"))
        rest, below = F.greatest(1 - F.col("p"), F.lit(1e-12)), F.greatest(1 - F.col("q"), F.lit(1e-12))
        gain = F.col("total") * (F.col("kl") + rest * F.log(rest / below))
        kept = gain > 0.5 * (F.col("k") + 1) * F.log("total")
        state = materialize(state.select(F.col("ctx").alias("_ctx"), "total", F.when(kept, F.log10(rest / below)).alias("back"), F.when(kept, gain).alias("gain"), (F.col("top") < F.col("total")).alias("open")), "states")
        gained = state.agg(F.sum("gain")).first()[0]
        if gained is None:
            break
        if d == 1:
            pairs = sent_out(spark, filter_of(found.where(F.col("n") >= least_context), "key"))
        # where one next word always follows, longer contexts tell nothing more
        contexts = found.where(F.col("n") >= least_context).join(state.where("open").select(F.col("_ctx").alias("shorter")), "shorter", "left_semi")
        contexts = materialize(contexts.select(F.col("key").alias("ctx"), F.col("n").alias("total")), "contexts")
        edges = own.join(state.select("_ctx", "back"), F.col("ctx") == F.col("_ctx"))
        edges = edges.select("key", "n", F.when(F.col("back").isNull(), F.col("log_q")).otherwise(F.col("own")).alias("log_p"), F.coalesce(F.col("own") - F.col("log_q") - F.col("back"), F.lit(0.0)).alias("value"))
        edges = materialize(edges, "edges", sweep=True)
        drop_table(found, own)
        values += [state.select(F.col("_ctx").alias("key"), F.coalesce("back", F.lit(0.0)).alias("value"), F.col("total").alias("n")), edges.select("key", "value", "n")]
    if not values:
        return None, 0
    every = reduce(DataFrame.union, values).groupBy("key").agg(F.sum("value").alias("value"), F.max("n").alias("n"))
    return materialize(every, "values", sweep=True), len(values) // 2 + 1


def scored(docs: DataFrame, depth: int | None = None, min_context: float = MIN_CONTEXT, min_edge: float = MIN_EDGE, least_gain: float = LEAST_GAIN) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Null and empty texts are the end token alone. Rows with a null id are
    trained on and not held out. Repeated rows are texts each. Without any
    training text all words are unknown. An empty table gives no rows; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), fold(FOLDS, HELD).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    train = rows.where("not held_out")

    vocabulary = materialize(summed(train.select("text"), texts_of, lambda part: part[:1], ("key",), 1, 1 << 32), "vocabulary", sweep=True)
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"], sums["v"]
    before = written()
    values, most = learned(train, vocabulary, total, distinct, depth, min_context, min_edge, least_gain)

    if most:  # of all that learning wrote only the words and the values are read again
        drop_written([*before, written()[-1]])

    def head(df, column):
        rows = frequent(df, HEAD).select("key", F.col(column).alias("value"), F.col("n").alias("weight")).toArrow()
        table = Table(rows["key"].to_numpy().astype(np.int64).view(np.uint64), rows["weight"].to_numpy())
        return table, rows["value"].to_numpy()[table.order]

    def words():
        table, n = head(vocabulary, "n")
        return table, np.log10((n + 0.5) / (total + 0.5 * (distinct + 1)))

    # one after the other, so that the driver holds one of them at a time
    held = [sent_out(spark, words())]
    if most:
        held.append(sent_out(spark, filter_of(values, "key")))  # all runs, so that the end of a run that has a value is in it, too
        values = values.where("value <> 0")
        held.append(sent_out(spark, head(values, "value")))
        held.append(sent_out(spark, filter_of(values, "key")))

    def run(batches):
        words_head, log_root = held[0].value
        bits, (runs_head, runs_value), own = [x.value for x in held[1:]] or (None, (None, None), None)
        asked, waiting = ([], []), 0
        for part, text in text_slices(batches, 1, 512):
            tokens, size = token_stream(text)
            of = Runs(tokens, size)
            start = of.start
            owner = np.repeat(np.arange(len(size)), size)
            w = words_head.find(tokens)
            known = w >= 0
            plain = np.where(known, log_root[np.maximum(w, 0)] if len(log_root) else 0.0, 0.0)
            log_p = plain.copy()
            more, more_owner = [], []
            at = np.arange(len(tokens))
            for n in range(1, most + 1):
                at = at[of.pos[at] >= n - 1]
                h = of(at, n)
                hit = maybe(bits, h)
                end_, h = at[hit], h[hit]
                at = at if n == 1 else end_  # a longer run can only be one whose end is
                i = runs_head.find(h)
                log_p[end_[i >= 0]] += runs_value[i[i >= 0]]
                rest = np.flatnonzero(i < 0)
                rest = rest[maybe(own, h[rest])]
                more.append(h[rest])
                more_owner.append(owner[end_[rest]])
                if not len(at):
                    break
            total_of = lambda x: np.add.reduceat(x, start)
            rare = np.flatnonzero(~known)
            row = part.column(3).to_numpy()
            for kind, keys, of_ in ((0, tokens[rare], owner[rare]), (1, np.concatenate([tokens[:0], *more]), np.concatenate([owner[:0], *more_owner]))):
                asked[kind].append((keys, row[of_]))
            waiting += sum(len(x[-1][0]) for x in asked)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row % (2 << bits_of), pa.int32()), pa.array(np.full(len(row), 2), pa.int32()), pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.int64()), part.column(3), part.column(0), part.column(2),
                 pa.array(size, pa.int64()), pa.array(total_of(known.astype(np.int64))), pa.array(total_of(plain)), pa.array(total_of(log_p))], names=names)
            if waiting > BUFFER:
                yield from sent(asked)
                asked, waiting = ([], []), 0
        yield from sent(asked)

    names = ["range", "kind", "a", "b", "first", "row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = "range int, kind int, a binary, b binary, first long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    bits_of = range_bits(total)

    def block_rows(kind: int, words: bool, columns: list[np.ndarray], first: int) -> pa.RecordBatch:
        ranges, (a, b) = blocks_of(bits_of, columns)
        ranges = ranges + (0 if words else 1 << bits_of)
        n = len(ranges)
        return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(np.full(n, kind), pa.int32()), a, b, pa.array(np.full(n, first), pa.int64()), *[pa.nulls(n, k) for k in kinds]], names=names)

    def sent(asked):
        """The keys that no broadcast table has, by range, with the rows that ask."""
        for kind, held in enumerate(asked):
            keys, row = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            if len(keys):
                order = np.argsort(keys)
                yield block_rows(1, kind == 0, [keys[order], (row[order] - row.min()).astype(np.int32)], row.min())

    def offered(words):
        def run(batches):
            held, size = [], 0

            def made():
                key, value = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(key)
                return block_rows(0, words, [key[order], value[order]], 0)

            for b in batches:
                held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
                size += b.num_rows
                if size > BUFFER:
                    yield made()
                    held, size = [], 0
            if held:
                yield made()

        return run

    def answer(batches):
        """Of each range first what is offered, then what is asked. Partial sums by
        row leave when they are many."""
        at, keys, value, found, many = None, [], [], [], 0

        def sums():
            row, base, gain, known = (np.concatenate(x) for x in zip(*found))
            rows_, of = np.unique(row, return_inverse=True)
            add = lambda w: np.bincount(of, weights=w, minlength=len(rows_))
            return pa.RecordBatch.from_arrays([pa.array(rows_), *[pa.nulls(len(rows_), k) for k in kinds[1:4]], pa.array(add(known).astype(np.int64)), pa.array(add(base)), pa.array(add(gain))], names=names[5:])

        for batch in batches:
            kind = batch.column(1).to_numpy()
            texts = np.flatnonzero(kind == 2)
            if len(texts):
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(texts)) for i in range(5, 12)], names=names[5:])
            blocks = batch.take(pa.array(np.flatnonzero(kind < 2)))
            for place, kind_, a, b, first in zip(*[blocks.column(i).to_pylist() for i in range(5)]):
                if place != at:
                    at, keys, value = place, [], []
                if kind_ == 0:
                    keys.append(np.frombuffer(a, np.uint64))
                    value.append(np.frombuffer(b, np.float64))
                    continue
                if len(keys) != 1:
                    whole = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                    order = np.argsort(whole)
                    keys, value = [whole[order]], [np.concatenate(value)[order] if value else np.zeros(0)]
                asked, row = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int32) + np.int64(first)
                i = np.minimum(np.searchsorted(keys[0], asked), max(len(keys[0]) - 1, 0))
                hit = keys[0][i] == asked if len(keys[0]) else np.zeros(len(asked), bool)
                got = np.where(hit, value[0][i], 0.0) if len(keys[0]) else np.zeros(len(asked))
                words = place < 1 << bits_of
                plain = np.where(hit, got, unseen) if words else np.zeros(len(asked))
                found.append((row, plain, plain if words else got, (hit & words).astype(np.int64)))
                many += len(row)
                if many > BUFFER:
                    yield sums()
                    found, many = [], 0
        if found:
            yield sums()

    unseen = log10(0.5 / (total + 0.5 * (distinct + 1)))
    stream = arrowed(rows, run, schema)
    offers = [arrowed(vocabulary.select("key", F.log10((F.col("n") + 0.5) / (total + 0.5 * (distinct + 1))).alias("value")), offered(True), schema)]
    if most:
        offers.append(arrowed(values.select("key", "value"), offered(False), schema))
    stream = reduce(DataFrame.union, offers, stream).repartition("range").sortWithinPartitions("range", "kind")
    got = arrowed(stream, answer, schema.partition("first long, ")[2])
    out = got.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
