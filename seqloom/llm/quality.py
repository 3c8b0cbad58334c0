"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words, all of them. Every
passage is encoded by learned layers: its words, hashed, are looked up in a
table of embeddings and averaged; the steps between classes of characters
inside its words, and ratios of characters and words, stand beside them. A
gated attention network weighs the passages of a bag; the weighted sum of their
representations gives the score. Only documents carry labels, so all weights,
those of the embeddings too, are learned from document labels alone.

The network is fitted on the driver, on a sample of labelled documents with all
of their passages: at most SAMPLE documents and PASSAGES passages in all, both
parameters. Scoring covers all passages of all texts on the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.frames import WORD, fold
from seqloom.llm.words import SPACE, string_buffers, text_slices, word_bounds, word_hashes
from seqloom.session import arrowed, trim

PASSAGE = 64
SAMPLE = 6000
PASSAGES = 60_000
BUCKETS, WIDTH = 1 << 13, 16
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 12, 128, 4e-3, 1e-4
#: At least so many steps are taken, over however few documents.
STEPS = 240
FOLDS = 5
THRESHOLD = 0.3


def byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, sentence marks, brackets and
    quotes, bars and rules, marks of markup, exclamation, other signs, bytes
    of other scripts."""
    out = np.full(256, 8, np.uint8)
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "()[]{}\"'", "|-_=/\\", "#$%&*@^~<>+", "!?")):
        out[[ord(c) for c in chars]] = i
    out[128:] = 9
    return out


CLASSES = byte_classes()
KINDS = 10
RATIOS = 2 * KINDS + 7
FEATURES = RATIOS + KINDS * KINDS


def passages(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of all passages, passages per text, buckets of all words, words
    per passage); a text without words has one passage of zeros."""
    data, offsets = string_buffers(col)
    starts, ends, counts = word_bounds(data, offsets)
    many = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(many) - many
    x = np.zeros((int(many.sum()), FEATURES))
    if not len(starts):
        return x, many, np.zeros(0, np.uint16), np.zeros(len(x), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    owner = first[doc] + nth // PASSAGE
    size = (ends - starts).astype(float)
    total = lambda w: np.bincount(owner, weights=w, minlength=len(x))
    n, chars = np.maximum(total(np.ones(len(owner))), 1), np.maximum(total(size), 1)
    kind = CLASSES[data]
    for k in range(KINDS):
        run = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)])
        got = (run[ends] - run[starts]).astype(float)
        x[:, k] = total(got) / chars
        x[:, KINDS + k] = total(got == size if k < 2 else got > 0) / n
    h = word_hashes(data, starts, ends)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    _, seen = np.unique(h + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), return_index=True)
    gap = np.zeros(len(h))
    gap[1:] = (starts[1:] - ends[:-1] > 1) & (owner[1:] == owner[:-1])
    j = 2 * KINDS
    x[:, j] = total(again) / n
    x[:, j + 1] = np.bincount(owner[seen], minlength=len(x)) / n
    x[:, j + 2] = chars / n / 10
    x[:, j + 3] = np.sqrt(np.maximum(total(size**2) / n - (chars / n) ** 2, 0)) / 10
    x[:, j + 4] = total(gap) / n
    x[:, j + 5] = total(size > 24) / n
    x[:, j + 6] = n / PASSAGE
    # steps from a class of characters to the next inside words
    inside = kind[~SPACE[data]]
    of = np.repeat(owner, ends - starts)
    last = np.zeros(len(inside), bool)
    last[np.cumsum(ends - starts) - 1] = True
    at = np.flatnonzero(~last)
    step = np.bincount(of[at] * (KINDS * KINDS) + inside[at].astype(np.int64) * KINDS + inside[at + 1], minlength=len(x) * KINDS * KINDS)
    x[:, RATIOS:] = step.reshape(len(x), -1) / chars[:, None]
    return x, many, (h >> np.uint64(51)).astype(np.uint16), np.bincount(owner, minlength=len(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def means(table: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean embedding of each passage's words, zero without words."""
    out = np.zeros((len(size), table.shape[1]))
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(table[words], (np.cumsum(size) - size)[some]) / size[some, None]
    return out


def forward(w: dict, x: np.ndarray, many: np.ndarray, words: np.ndarray, size: np.ndarray) -> dict:
    """All layers: inputs, hidden passages h, gates, attention, bags z, scores p."""
    start = np.cumsum(many) - many
    owner = np.repeat(np.arange(len(many)), many)
    inputs = np.concatenate([(x - w["mean"]) / w["scale"] * w["use"], means(w["E"], words, size)], axis=1)
    h = np.tanh(inputs @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, start)[owner])
    att = e / np.add.reduceat(e, start)[owner]
    z = np.add.reduceat(att[:, None] * h, start)
    return {"inputs": inputs, "h": h, "t": t, "g": g, "att": att, "z": z, "p": sigmoid(z @ w["c"] + w["d"]), "start": start, "owner": owner}


def gradients(w: dict, x: np.ndarray, many: np.ndarray, words: np.ndarray, size: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean cross entropy of the bags' labels."""
    f = forward(w, x, many, words, size)
    h, t, g, att, owner, start = (f[k] for k in ("h", "t", "g", "att", "owner", "start"))
    dp = (f["p"] - y) / len(y)
    grad = {"c": f["z"].T @ dp, "d": np.array([dp.sum()])}
    dz = dp[:, None] * w["c"]
    datt = (h * dz[owner]).sum(1)
    de = att * (datt - np.add.reduceat(att * datt, start)[owner])
    grad["a"] = (t * g).T @ de
    dtg = de[:, None] * w["a"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    grad["V"], grad["U"] = h.T @ dt, h.T @ dg
    dh = (att[:, None] * dz[owner] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    grad["W"], grad["b"] = f["inputs"].T @ dh, dh.sum(0)
    own = (dh @ w["W"][x.shape[1] :].T) / np.maximum(size, 1)[:, None]
    of = np.repeat(np.arange(len(size)), size)
    grad["E"] = np.stack([np.bincount(words, weights=own[of, k], minlength=len(w["E"])) for k in range(own.shape[1])], axis=1)
    return grad


def fit(x: np.ndarray, many: np.ndarray, words: np.ndarray, size: np.ndarray, y: np.ndarray, seed: int = 7, use: np.ndarray | None = None) -> dict:
    """Adam on the cross entropy. use: 0 for features that are left out, for
    trials of what the others know."""
    rng = np.random.Generator(np.random.PCG64(seed))
    f = x.shape[1] + WIDTH
    w = {"E": rng.normal(0, 0.1, (BUCKETS, WIDTH)), "W": rng.normal(0, f**-0.5, (f, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "a": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    fixed = {"mean": x.mean(0, dtype=float), "scale": x.std(0, dtype=float) + 1e-3, "use": np.ones(x.shape[1]) if use is None else use}
    names = list(w)
    m, v = ({k: np.zeros_like(w[k]) for k in names} for _ in range(2))
    first, word = np.cumsum(many) - many, np.cumsum(size) - size
    ranges = lambda at, n: np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    step, epochs = 0, max(EPOCHS, -(-STEPS // max(1, -(-len(many) // BATCH))))
    for epoch in range(epochs):
        order = rng.permutation(len(many))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for lo in range(0, len(order), BATCH):
            bags = order[lo : lo + BATCH]
            rows = ranges(first[bags], many[bags])
            grad = gradients(w | fixed, x[rows], many[bags], words[ranges(word[rows], size[rows])], size[rows], y[bags])
            step += 1
            for k in names:
                gk = grad[k] + (DECAY * w[k] if w[k].ndim == 2 else 0)
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w | fixed


def score(w: dict | None, x: np.ndarray, many: np.ndarray, words: np.ndarray, size: np.ndarray) -> np.ndarray:
    return forward(w, x, many, words, size)["p"] if w else np.full(len(many), 0.5)


def sample_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = PASSAGES):
    """(features, passages per text, words, words per passage, label) of labelled
    documents outside the held-out fold: those of smallest hash, with all of
    their passages, up to `sample` documents and `most` passages. Rows that
    repeat with one label count once. None without any."""
    spark = docs.sparkSession
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~fold(FOLDS, 0)).select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "y").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "y", "text", F.xxhash64("text").alias("h"))
    many = F.greatest(F.ceil(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) / PASSAGE), F.lit(1)).cast("long")
    found = texts.select("doc_id", "h", "y", many.alias("many")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h", "y").limit(sample).collect()
    total, taken = 0, {}
    for r in found:
        if total + r.many <= most:
            total += r.many
            taken[r.doc_id, r.h, r.y] = len(taken)
    if not taken:
        return None
    own = spark.createDataFrame([(*k, n) for k, n in taken.items()], "_id long, _h long, _y double, place long")
    rows = texts.join(F.broadcast(own), (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("y") == F.col("_y"))).select("place", "y", "text")

    def run(batches):
        for part, text in text_slices(batches, 2):
            x, n, words, size = passages(text)
            a, b = np.cumsum(n), np.cumsum(size)
            cut = lambda flat, stop: [flat[lo:hi].tobytes() for lo, hi in zip(np.append(0, stop[:-1]), stop)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cut(x.astype(np.float16), a), pa.binary()), pa.array(cut(words, b[a - 1]), pa.binary()), pa.array(cut(size.astype(np.int32), a), pa.binary())], names=["place", "y", "x", "words", "size"])

    # rows that repeat a whole document give the same bag
    got = arrowed(rows, run, "place long, y double, x binary, words binary, size binary").dropDuplicates(["place"]).toArrow().sort_by("place")
    x = [np.frombuffer(b, np.float16).reshape(-1, FEATURES) for b in got["x"].to_pylist()]
    whole = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in got[name].to_pylist()])
    return np.concatenate(x, dtype=np.float32), np.array([len(b) for b in x]), whole("words", np.uint16), whole("size", np.int32).astype(np.int64), got["y"].to_numpy()


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The network, from labels (doc_id, quality) outside the held-out fold; None
    without labels or with no text for them, when every score is 0.5."""
    got = sample_of(docs, labels, sample)
    w = fit(*got) if got else None
    del got
    trim()
    return w


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted; see quality_of for the cases."""
    w = trained(docs, labels, sample)
    held = docs.sparkSession.sparkContext.broadcast(w)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    src = docs.select(*names)
    at = names.index("text")
    fields = src.schema.fields
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double", "predicted int"])

    def run(batches):
        w = held.value
        for part, text in text_slices(batches, at):
            s = score(w, *passages(text))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return arrowed(src, run, schema)


def quality_of(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Null and empty texts are a bag with one empty passage and get a score as
    well; rows with a null id are scored and not held out; repeated rows score
    alike. Null labels teach nothing; labels given twice count once. An empty
    table gives no rows; other columns are not looked at.
    """
    out = scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, sample, threshold)
    return out.select("doc_id", fold(FOLDS, 0).alias("held_out"), "score", "predicted")
