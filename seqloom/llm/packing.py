"""Packing token sequences into windows by non-negative least squares.

Documents are cut at multiples of the window; what is left of each has a
length class (lengths rounded up to a unit). Shallow combinations of classes
that fill a window are enumerated, their repeat counts solved by non-negative
least squares against the class histogram and rounded down to what the
histogram holds, and the residual classes are packed greedily, best fit
first. Slack in the windows is then filled from a reserve of documents that
may be cut anywhere, chosen by a hash of their ids; the reserve's rest becomes
full windows and, last, windows whose length is a power of two, so that no
padding is left. Only the class histogram and the list of combinations, whose
sizes the window bounds, reach the driver.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.frames import running_sums
from seqloom.llm.words import text_slices
from seqloom.session import STATE, arrowed, materialize

WINDOW = 4096
UNIT = 32
DEPTH = 3
END = 2
RESERVE = 8
#: Words that a worker keeps with their ids, some 150 bytes each.
CACHE = 400_000


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable
    bytes as they are, the others as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for i in range(256):
        out[i] = chr(i) if i in plain else chr(more)
        more += i not in plain
    return out


def marks() -> re.Pattern:
    """Characters that the tokenizer's NFC step may join with the one before: all
    of a combining class."""
    return re.compile("[" + "".join(chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))) + "]")


_PARTS = re.compile(rb"([a-z\x80-\xff]*)([!-/:-@\[-`{-~]*)")


class Words(dict):
    """Token bytes of each chunk of a lower-cased text between ASCII white
    space. The tokenizer drops white space and never joins across it, so a
    text's ids are those of its chunks in turn. A chunk of letters with signs
    behind it is two words to the tokenizer, which go to its merges directly;
    any other chunk goes through the whole tokenizer. When full, the oldest
    quarter goes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.of = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.mark = marks()

    def merged(self, word: bytes) -> bytes:
        got = self.of.model.tokenize(word.decode() if word.isascii() else "".join(map(self.letters.__getitem__, word)))
        return array("I", [t.id for t in got]).tobytes()

    def made(self, chunk: bytes) -> bytes:
        parts = _PARTS.fullmatch(chunk)
        if parts and len(chunk) < 64:
            head, tail = parts.groups()
            if not head or head.isascii():
                plain = True
            else:
                # Latin letters whose lower case is one letter, composed
                text = head.decode("utf-8")
                plain = text.isalpha() and max(text) < "\u0250" and "\u0130" not in text
                head = text.lower().encode("utf-8") if plain else head
            if plain and tail and head:
                return self[head] + self[tail]
            if plain:
                return self.merged(head or tail)
        return np.array(self.of.encode(chunk.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.made(chunk)
        if len(self) >= CACHE:
            for old in list(islice(self, CACHE // 4)):
                del self[old]
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


def words_of(path: str) -> Words:
    """The words of this process: a Python worker that runs several tasks keeps
    them from one to the next, until one of another kind comes."""
    import types

    kept = sys.modules.setdefault(STATE, types.ModuleType(STATE)).__dict__
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def tokenizer_bytes(path: str):
    """text -> its ids as little-endian unsigned 32-bit values."""
    words = words_of(path)
    special = [x.content.lower().encode() for x in words.of.get_added_tokens_decoder().values()]

    def no_mark(text: str) -> bool:
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not words.mark.search(text)

    def whole(text: str) -> bytes:
        return np.array(words.of.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8")
        low = raw.lower()
        if any(x in low for x in special):
            return whole(text)
        if no_mark(text):
            return b"".join(map(words.__getitem__, low.split()))
        # what a mark is joined with depends on the letter's case: such a chunk goes as it is
        pairs = zip(low.split(), raw.split())
        return b"".join(whole(r.decode("utf-8")) if words.mark.search(r.decode("utf-8")) else words[w] for w, r in pairs)

    return ids


TOKENS = "doc_id long, row_key long, tokens long, crcs array<long>, reserve boolean, ids binary"


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, reserve: int = RESERVE) -> DataFrame:
    """One row for each document: its length, the crc32 of each of its windows
    and, for the reserve, its ids. row_key tells repeated rows apart."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_key"), F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("reserve")), F.lit(reserve)) == 0, F.lit(False)).alias("reserve"))
    stop = np.array([end], dtype="<u4").tobytes()
    step = 4 * window

    def run(batches):
        encode = tokenizer_bytes(path)
        for part, text in text_slices(batches, 1):
            data = [encode(t) + stop for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(2), pa.array([len(d) // 4 for d in data], pa.int64()),
                pa.array([[zlib.crc32(d[i : i + step]) for i in range(0, len(d), step)] for d in data], pa.list_(pa.int64())),
                part.column(3), pa.array([d if k else None for d, k in zip(data, part.column(3).to_pylist())], pa.binary()),
            ], names=["doc_id", "row_key", "tokens", "crcs", "reserve", "ids"])

    return materialize(arrowed(docs, run, TOKENS, keeps=True), "tokens")


def combinations(units: int, depth: int, classes: list[int]) -> list[tuple[int, ...]]:
    """All multisets of up to depth classes in use that sum to units."""
    have, out = set(classes), []
    for a in classes:
        if a == units:
            out.append((a,))
        for b in classes:
            if depth >= 2 and a <= b and a + b == units:
                out.append((a, b))
            if depth >= 3 and a <= b <= units - a - b and units - a - b in have:
                out.append((a, b, units - a - b))
    return out


def nnls(A: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """min |Ax - b| over x >= 0 by accelerated projected gradient."""
    if not A.shape[1]:
        return np.zeros(0)
    lip = float(np.linalg.norm(A, 2) ** 2)
    g, c = A.T @ A, A.T @ b
    x = y = np.zeros(A.shape[1])
    t = 1.0
    for _ in range(steps):
        new = np.maximum(y - (g @ y - c) / lip, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def schedule(hist: dict[int, int], units: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """[(classes of a window, windows)], using each class as often as hist has it."""
    hist = Counter({k: v for k, v in hist.items() if v})
    classes = sorted(hist)
    combos = combinations(units, depth, classes)
    row = {c: i for i, c in enumerate(classes)}
    A = np.zeros((len(classes), len(combos)))
    for j, combo in enumerate(combos):
        for c in combo:
            A[row[c], j] += 1
    weight = np.array([float(c) for c in classes])  # a token left over costs the same in any class
    x = nnls(A * weight[:, None], np.array([hist[c] for c in classes], float) * weight)
    out = []

    def take(combo: tuple[int, ...], n: int) -> None:
        n = min([n, *(hist[c] // k for c, k in Counter(combo).items())])
        if n > 0:
            hist.subtract({c: n * k for c, k in Counter(combo).items()})
            out.append((combo, n))

    for j in np.argsort(-x, kind="stable").tolist():
        take(combos[j], int(x[j] + 1e-9))
    while any(hist.values()):  # residuals: the largest class, then what fits best, as deep as it takes
        room, combo = units, []
        left = Counter(hist)
        while fit := [c for c in classes if left[c] > 0 and c <= room]:
            combo.append(fit[-1])
            left[fit[-1]] -= 1
            room -= fit[-1]
        use = Counter(combo)
        take(tuple(combo), max(1, min(hist[c] // k for c, k in use.items())))
    return out


PIECE = ["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end: int = END, reserve: int = RESERVE) -> DataFrame:
    """One row for each piece: doc_id, row_key, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as
    often as they occur, null ids like any other; an empty table gives no
    rows; other columns are not looked at. Every sequence is full or, for at
    most log2(window) of them, as long as a power of two; only in a table
    whose reserve is too small for the slack are some sequences padded.
    """
    spark = docs.sparkSession
    units = window // unit
    t = tokenized(docs, path, window, end, reserve)
    light = t.select("doc_id", "row_key", "tokens", "crcs", "reserve", F.floor(F.col("tokens") / window).alias("full"), F.pmod("tokens", F.lit(window)).alias("rest"))
    total = light.agg(F.count("*").alias("n"), F.sum(F.when(~F.col("reserve"), F.col("full"))).alias("full")).first()
    n, n_full = total["n"], total["full"] or 0
    key = ["row_key"]

    # full windows of documents outside the reserve
    whole = running_sums(light.where("not reserve and full > 0").drop("crcs"), [], key, {"seq": F.col("full")}, n)
    whole = whole.join(light.select("row_key", "crcs"), "row_key")
    whole = whole.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k"))
    whole = whole.select("doc_id", "row_key", (F.col("k") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crcs")[F.col("k").cast("int")].alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), (F.col("seq") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # rests of documents outside the reserve: class, then rank in the class
    rest = light.where("not reserve and rest > 0").withColumn("class", F.ceil(F.col("rest") / unit).cast("int"))
    hist = {r["class"]: r["n"] for r in rest.groupBy("class").agg(F.count("*").alias("n")).collect()}
    plan = schedule(hist, units, depth)
    first, slots, used = 0, [], Counter()
    for combo, times in plan:
        for pos, c in enumerate(combo):
            slots.append((c, used[c], used[c] + times, first, pos))
            used[c] += times
        first += times
    n_plan = first
    slot = spark.createDataFrame(slots, "class int, lo long, hi long, first long, pos int")
    ranked = running_sums(rest, ["class"], key, {"rank": F.lit(1)}, n)
    # the list of slots is bounded by the window: a few thousand rows
    placed = ranked.join(F.broadcast(slot), "class").where("rank >= lo and rank < hi").select("doc_id", "row_key", "tokens", "full", "rest", "crcs", (F.col("first") + F.col("rank") - F.col("lo")).alias("seq"), "pos")
    placed = materialize(placed.select(
        "doc_id", "row_key", (F.col("full") * window).alias("start"), F.col("rest").alias("length"), F.col("crcs")[F.col("full").cast("int")].alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"), (F.col("seq") + n_full).alias("sequence_id"), F.col("pos")), "placed")
    inside = Window.partitionBy("sequence_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rests = placed.select("doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))

    # the stream that fills what is left: the reserve
    left = materialize(light.where("reserve").select("row_key", F.col("tokens").alias("length")), "left")
    stream = running_sums(left, [], key, {"at": F.col("length")}, n)
    held = placed.groupBy("sequence_id").agg(F.sum("length").alias("held"))
    gaps = running_sums(held.where(f"held < {window}").withColumn("gap", window - F.col("held")), [], ["sequence_id"], {"at": F.col("gap")}, n)
    gaps = materialize(gaps.select("sequence_id", F.col("held").alias("offset"), "at", F.col("gap").alias("size")), "gaps")
    gap_total = gaps.agg(F.sum("size")).first()[0] or 0
    have = left.agg(F.sum("length")).first()[0] or 0
    tail = max(0, have - gap_total)
    ends, at, bit = [], gap_total + tail // window * window, 1
    for b in range(window.bit_length() - 2, -1, -1):
        bit = 1 << b
        if tail % window & bit:
            ends.append((n_full + n_plan + tail // window + len(ends), 0, at, bit))
            at += bit
    more = spark.range(tail // window).select((F.col("id") + n_full + n_plan).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.col("id") * window + gap_total).alias("at"), F.lit(window).cast("long").alias("size"))
    room = gaps.union(more).union(spark.createDataFrame(ends, "sequence_id long, offset long, at long, size long"))
    cell = lambda df, size: df.select("*", F.explode(F.sequence(F.floor(F.col("at") / window), F.floor((F.col("at") + F.col(size) - 1) / window))).alias("cell"))
    a = cell(stream.where("length > 0"), "length").select("cell", "row_key", F.col("at").alias("a"), (F.col("at") + F.col("length")).alias("b"))
    r = cell(room, "size").select("cell", "sequence_id", "offset", F.col("at").alias("c"), (F.col("at") + F.col("size")).alias("d"))
    lo, hi = F.greatest("a", "c"), F.least("b", "d")
    fill = a.join(r, "cell").where("a < d and c < b").where(F.col("cell") == F.floor(lo / window))
    fill = fill.select("row_key", "sequence_id", (F.col("offset") + lo - F.col("c")).alias("offset"), (lo - F.col("a")).alias("from"), (hi - lo).alias("length"))
    fill = materialize(fill, "fill")
    crc = F.crc32(F.substring("ids", (F.col("from") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
    cut = t.where("reserve").select("doc_id", "row_key", "tokens", "ids").join(fill, "row_key")
    cut = cut.select("doc_id", "row_key", F.col("from").alias("start"), "length", crc.alias("ids_crc32"), F.col("tokens").alias("doc_tokens"), "sequence_id", "offset")
    return whole.union(rests).union(cut).select(*PIECE)

