"""WARC archives: exact round trips, and what is saved from damaged ones."""

import base64
import glob
import gzip
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import warc

SCHEMA = "page_id long, url string, html string, archive string, value long"


def sha(x: bytes) -> str:
    return hashlib.sha1(x).hexdigest()


def archive(payloads: list[bytes], gz: bool) -> tuple[bytes, list[int]]:
    """An archive of responses and the places where its records begin."""
    out, starts = b"", []
    for i, x in enumerate(payloads):
        starts.append(len(out))
        one = warc.record(i, f"http://a/{i}", sha(x), len(x), x, None, "2020-01-01T00:00:00Z")
        out += warc.members(one + warc.END, 6) + b"\0" if gz else one + warc.END
    return out, starts


def found(data: bytes):
    rows = list(warc.walked(data))
    good = [(a, b, warc.page_of(r.fields["warc-record-id"].strip("<>")), warc.payload_of(r.fields, r.block)[0]) for a, b, r, _ in rows if r]
    gaps = [(a, b) for a, b, r, _ in rows if not r]
    spans = sorted({(a, b) for a, b, *_ in good} | set(gaps))
    assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]][: len(spans)] and (not spans or spans[-1][1] == len(data))  # nothing is unaccounted for
    return good, gaps


PAYLOADS = [b"<p>one</p>" * 40, b"", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "ünï\x00\x1f".encode() * 9, bytes(range(256)) * 5, b"\r\n\r\n" * 7]


@pytest.mark.parametrize("gz", [True, False])
def test_walk_whole(gz):
    data, starts = archive(PAYLOADS, gz)
    good, gaps = found(data)
    assert [x[2:] for x in good] == list(enumerate(PAYLOADS)) and [x[0] for x in good] == starts and not gaps
    if gz:
        assert gzip.decompress(data).count(b"WARC-Type") == len(PAYLOADS)
    assert found(b"") == ([], [])


@pytest.mark.parametrize("gz", [True, False])
@settings(max_examples=80, deadline=None)
@given(seed=st.integers(0, 10**9))
def test_damage_costs_only_what_it_touches(gz, seed):
    rnd = random.Random(seed)
    payloads = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(300))) for _ in range(rnd.randrange(2, 9))]
    data, starts = archive(payloads, gz)
    bounds = [*starts, len(data)]
    hit = rnd.randrange(len(payloads))
    a, b = bounds[hit], bounds[hit + 1]
    kind = rnd.choice(["flip", "zero", "cut", "junk"])
    at = rnd.randrange(a, b)
    if kind == "flip":
        data = data[:at] + bytes([data[at] ^ (1 << rnd.randrange(8))]) + data[at + 1 :]
    elif kind == "zero":
        n = min(b - at, 20)
        data = data[:at] + bytes(n) + data[at + n :]
    elif kind == "cut":
        data = data[:at] + data[min(b, at + 9) :]
    else:
        data = data[:a] + b"\x1f\x8bjunk WARC/1.1\r\n" + data[a:]
    good, gaps = found(data)
    kept = {i for _, _, i, _ in good}
    # a flip of a header's letter may leave the record's checks whole; nothing else is lost, and no payload is wrong
    assert kept >= set(range(len(payloads))) - {hit} or (not gz and kind == "flip")
    assert all(payloads[i] == x for _, _, i, x in good if i is not None and i < len(payloads)) or kind == "flip"
    if kind == "junk":
        assert kept == set(range(len(payloads))) and gaps == [(a, a + 17)]


def test_a_record_of_several_members_and_members_of_several_records():
    big = random.Random(1).randbytes(1000) * 40_000
    data, starts = archive([b"x", big, b"y"], True)
    assert starts[2] - starts[1] > 0 and gzip.decompress(data).endswith(b"\r\n\r\n")
    good, gaps = found(data)
    assert [x[2:] for x in good] == [(0, b"x"), (1, big), (2, b"y")] and not gaps
    plain, starts = archive(PAYLOADS, False)
    one = gzip.compress(plain)
    good, gaps = found(one)
    assert [x[3] for x in good] == PAYLOADS and not gaps
    # a member that ends early gives the records before its end
    good, gaps = found(one[:-200] + archive([b"later"], True)[0])
    assert good and [x[3] for x in good][:1] == PAYLOADS[:1] and good[-1][3] == b"later" and len(gaps) == 1


def test_round_trip_of_pages(spark, tmp_path):
    rows = [
        (1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (None, "http://a/n", "<p>same</p>"),
        (5, "http://a/5", "<p>same</p>"), (7, "bad url\r\nX: y", "é" * 70_000), (8, "http://a/8", None), (-9, "", ""), (2**62 + 3, "u", "x\x00\r\n\r\ny"), (-(2**63), "u", "low")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    for gz in (True, False):
        path = warc.archived(pages, f"file://{tmp_path}/{gz}", gzip=gz, archive=3000)
        got = warc.salvaged(spark, path, payloads=True).collect()
        assert all(r.kind == "record" for r in got) and len({r.archive for r in got}) > 1
        out = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
        want = []
        for i, (page, url, html) in enumerate(rows):
            x = (html or "").encode()
            same = [r for r in rows if (r[2] or "") == (html or "")]
            top = max((r[0] for r in same if r[0] is not None), default=None)
            first = page == top and not any(r[0] == page and (r[2] or "") == (html or "") for r in rows[:i])
            want.append((page, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if first else "revisit", None if first else top))
        assert out == sorted(want, key=str)
        assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"} == {(5, rows[0][2]), (7, rows[5][2]), (8, ""), (2**62 + 3, rows[8][2]), (-(2**63), "low")}
        assert {r.uri for r in got if r.page_id == 7} == {"bad%20url%0D%0AX:%20y"} and {r.uri for r in got if r.page_id == 3} == {None}


def test_gaps_of_a_folder(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i} " * 50, "", 0) for i in range(40)], SCHEMA)
    path = warc.archived(pages.coalesce(1), f"file://{tmp_path}/w", archive=20_000)
    names = sorted(glob.glob(f"{tmp_path}/w/part*"), key=lambda x: -len(open(x, "rb").read()))
    data = bytearray(open(names[0], "rb").read())
    places = [(a, b) for a, b, r, _ in warc.walked(bytes(data)) if r]
    a, b = places[1]
    data[(a + b) // 2] ^= 255
    copy = tmp_path / "damaged"
    copy.mkdir()
    for n in names:
        (copy / n.rpartition("/")[2]).write_bytes(data if n == names[0] else open(n, "rb").read())
    got = warc.salvaged(spark, f"file://{copy}").collect()
    gaps = [r for r in got if r.kind == "gap"]
    assert [(r.start, r.end) for r in gaps] == [(a, b)] and gaps[0].reason and sum(r.kind == "record" for r in got) == 39
    empty = warc.archived(pages.limit(0), f"file://{tmp_path}/e")
    assert not warc.salvaged(spark, empty).collect()
