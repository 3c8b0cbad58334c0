"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the spans of
its assistant texts, sorted as rendered, are intersected with the token spans
by binary search. A token that reaches past a turn's text is in the mask only
with the characters inside it.

Template, a turn: <|turn|>role\\n text <|end|>\\n. Inside roles and texts a
"<|" becomes "<&|", and every "<&...&|" gets one more "&"; taking one away
undoes it, so no text can close a turn or open one.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import arrowed

TURN, END = "<|turn|>", "<|end|>\n"
LOSS_ROLE = "assistant"
#: A longer conversation is rendered and encoded in several segments, cut
#: between turns, so that memory stays bounded for any number of turns. No word
#: of the tokenizer reaches over the end of a turn, so the segments' ids, one
#: after the other, are those of the whole.
SEGMENT = 4_000_000

_ESCAPE = re.compile(r"<(&*)\|")
_UNESCAPE = re.compile(r"<&(&*)\|")
_PARSE = re.compile(re.escape(TURN) + r"(.*?)\n(.*?)" + re.escape(END), re.S)
_ROLE = str.maketrans({"\\": "\\\\", "\n": "\\n"})
_UNROLE = re.compile(r"\\(.)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<&\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, np.ndarray]:
    """(text, spans of the texts of loss_role as rendered)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role).translate(_ROLE)}\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a rendered text was made of."""
    return [(unescape(_UNROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)), unescape(text)) for role, text in _PARSE.findall(formatted)]


def masked(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the tokens that share a character with a span, the shared
    parts of those tokens)."""
    if not len(offsets) or not len(spans):
        return np.zeros(len(offsets), bool), np.zeros((0, 2), np.int64)
    # the first span that ends after the token's start; empty spans hold no character
    spans = spans[spans[:, 1] > spans[:, 0]]
    i = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    j = np.searchsorted(spans[:, 0], offsets[:, 1], side="left")
    mask = i < j
    parts = []
    for t in np.flatnonzero(mask & (j - i > 1)):  # a token over more than one turn
        parts += [(t, max(a, offsets[t, 0]), min(b, offsets[t, 1])) for a, b in spans[i[t] : j[t]]]
    one = np.flatnonzero(mask & (j - i == 1))
    single = np.column_stack([one, np.maximum(spans[i[one], 0], offsets[one, 0]), np.minimum(spans[i[one], 1], offsets[one, 1])])
    all_ = np.concatenate([single, np.array(parts, dtype=np.int64).reshape(-1, 3)])
    return mask, all_[np.argsort(all_[:, 0], kind="stable"), 1:]


def merged(parts: np.ndarray) -> np.ndarray:
    """Sorted spans with overlapping and touching ones joined (the tokens of one
    character's bytes all span the character)."""
    parts = parts[parts[:, 1] > parts[:, 0]]
    if not len(parts):
        return parts
    reach = np.maximum.accumulate(parts[:, 1])
    first = np.flatnonzero(np.append(True, parts[1:, 0] > reach[:-1]))
    return np.column_stack([parts[first, 0], reach[np.append(first[1:], len(parts)) - 1]])


FORMATTED = "conv_id long, segment int, last boolean, formatted string, ids array<int>, mask array<boolean>, loss array<struct<start:long,end:long>>"


def formatted(conversations: DataFrame, tokenizer: str, loss_role: str = LOSS_ROLE, segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation, more only for one of over `segment`
    characters: the rendered text, its token ids, the token mask and the
    character spans under it.

    Turns stand in the order of turn (null first), then role, then text;
    repeated rows are turns each. Null texts and null roles are empty; rows
    with a null conv_id are one conversation. An empty table gives no rows;
    other columns are not looked at. Rows are sorted into their conversations
    on disk and read as a stream: no conversation is held as a whole.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True

        def made(key, number, last, turns):
            text, spans = render(turns, loss_role)
            got = encoder.encode(text, add_special_tokens=False)
            ids = np.array(got.ids, dtype=np.int32)
            offsets = np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
            mask, parts = masked(offsets, spans)
            return key, number, last, text, ids, mask, merged(parts)

        def conversations_():
            key, number, turns, size = None, 0, [], 0
            for batch in batches:
                columns = (batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
                for conv, role, text in zip(*columns):
                    if turns and (conv != key or size > segment):
                        yield made(key, number, conv != key, turns)
                        number = number + 1 if conv == key else 0
                        turns, size = [], 0
                    key = conv
                    turns.append((role, text))
                    size += len(text)
            if turns:
                yield made(key, number, True, turns)

        held, size = [], 0
        for row in conversations_():
            held.append(row)
            size += len(row[3])
            if size > 2_000_000:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    return arrowed(rows, run, FORMATTED)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    key, number, last, text, ids, mask, loss = zip(*rows)
    lists = lambda parts, values: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), values)
    spans = np.concatenate(loss)
    spans = pa.StructArray.from_arrays([pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64())], names=["start", "end"])
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(number, pa.int32()), pa.array(last, pa.bool_()), pa.array(text, pa.string()),
         lists(ids, pa.array(np.concatenate(ids))), lists(mask, pa.array(np.concatenate(mask))), lists(loss, spans)],
        names=["conv_id", "segment", "last", "formatted", "ids", "mask", "loss"])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rows: DataFrame) -> DataFrame:
    """What the output of formatted() says, read back from it: one row for each
    conversation. The segments of one follow each other in their partition."""

    def run(batches):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = loss_chars = 0
        for batch in batches:
            out = []
            keys, lasts, texts = (batch.column(i).to_pylist() for i in range(3))
            stop = np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))
            start, end = (batch.column(3).flatten().field(i).to_pylist() for i in (0, 1))
            first = 0
            for key, last, text, after in zip(keys, lasts, texts, stop.tolist()):
                for role, body in turns_of(text):
                    n += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for i in range(first, after):
                    part = unescape(text[start[i] : end[i]])
                    loss_chars += len(part)
                    loss.update(part.encode())
                first = after
                chars += len(text)
                if last:
                    out.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = chars = loss_chars = 0
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return arrowed(rows.select("conv_id", "last", "formatted", "loss"), run, DIGEST)
