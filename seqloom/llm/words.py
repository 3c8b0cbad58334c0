"""Words of whole texts as 64-bit hashes, by whole-column numpy passes.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased.
The functions read the buffers of an Arrow string column without making
Python strings; null texts count as empty. Temporary arrays cover about
1 MB of text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240607))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)[LOWER] * np.uint64(2) + np.uint64(1)
BYTE_CODE[SPACE] = 0
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = 1 << 20


def text_slices(batches, text: int, step: int = 256, most: int = 1 << 21):
    """(slice of a batch, its text column): at most `step` rows and about `most`
    bytes of text at a time, or one longer text."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end, lo = np.cumsum(size), 0
        while lo < batch.num_rows:
            fits = int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, side="right"))
            hi = max(min(lo + step, fits), lo + 1)
            part = batch.slice(lo, hi - lo)
            yield part, part.column(text)
            lo = hi


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, BASE, dtype=np.uint64))
    return out


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, dtype=kind, count=len(col) + 1, offset=col.offset * kind().itemsize).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, number of words per text)."""
    n = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(n, np.int64)
    word = ~SPACE[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    if not len(starts):
        return out
    size = ends - starts
    power = powers(int(size.max()))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP)))
        lo, hi = starts[i], ends[j - 1]
        at = starts[i:j] - lo
        code = BYTE_CODE[data[lo:hi]]
        gap = np.diff(np.append(at, hi - lo))
        pos = np.arange(hi - lo, dtype=np.int64) - np.repeat(at, gap)
        np.minimum(pos, len(power) - 1, out=pos)
        code *= power[pos]
        out[i:j] = np.add.reduceat(code, at)
        i = j
    return mix64(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_words(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words per text) of a string column."""
    data, offsets = string_buffers(col)
    starts, ends, counts = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each text; their number per text).

    A text of 1 to k-1 words has the whole sequence as its one shingle.
    """
    n, total = len(counts), len(hashes)
    first = np.cumsum(counts) - counts
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    code = powers(k + 1)[1:]
    span = max(total - k + 1, 0)
    h = np.zeros(span, dtype=np.uint64)
    for j in range(k):
        h += hashes[j : j + span] * code[j]
    doc = np.repeat(np.arange(n), counts)
    inside = doc[:span] == doc[k - 1 : k - 1 + span]
    h, owner = mix64(h)[inside], doc[:span][inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            whole[has] += hashes[first[short[has]] + j] * code[j]
        whole = mix64(whole + counts[short].astype(np.uint64))
        h, owner = np.concatenate([h, whole]), np.concatenate([owner, short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    stop = np.cumsum(np.bincount(owner, minlength=n))
    for a, b in zip(np.concatenate([[0], stop[:-1]]).tolist(), stop.tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.bincount(owner[keep], minlength=n)
