"""WARC archives of pages, and a reader that salvages damaged ones.

Writing: a payload is kept once, in the response of its page of largest id; all
other pages with it become revisits. Records are gzip members or plain, and
Spark's text writer lays them out, so archives go through its commit protocol
to any file system it knows. A plain record ends with two line breaks, which is
the writer's line separator. A gzip member ends with its length, low byte first:
the last byte is zero below 16 MB, and that byte is the separator; longer
records take several members.

Reading: an archive is walked record by record. A record counts when its gzip
checks, version line, length, end and digests hold. After one that does not,
the reader looks for the next gzip member or version line at which a whole
record passes, goes on there, and reports the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import arrowed, shared_path

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes that an archive holds at most in the mean.
ARCHIVE = 32 << 20
#: Bytes of a member before compression, so that the last byte of its length is zero.
MEMBER = (1 << 24) - 1
#: Compressed bytes given to the decompressor at once.
STEP = 1 << 16

_START = re.compile(rb"WARC/\d\.\d\r\n|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")

ROWS = """archive string, start long, end long, kind string, reason string, record_type string, record_id string,
    refers_to_id string, uri string, payload_bytes long, payload_digest string, payload binary"""


class Damaged(ValueError):
    """Why bytes are not a record."""


class Record(NamedTuple):
    end: int
    fields: dict[str, str]
    block: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha1: str) -> str:
    """A UUID of version 8 that holds the page's id and 47 bits of its payload's digest."""
    n = (page_id or 0) % (1 << 64)
    head = int(sha1[:12], 16) >> 1 << 1 | (page_id is None)
    return uuid.UUID(int=head << 80 | 8 << 76 | n >> 62 << 64 | 2 << 62 | n % (1 << 62)).urn


def page_of(urn: str | None) -> int | None:
    """The page's id in record_id(); None for null ids and for other identifiers."""
    if not urn or not re.fullmatch(r"urn:uuid:[0-9a-f-]{36}", urn) or (u := uuid.UUID(urn).int) >> 76 & 15 != 8 or u >> 80 & 1:
        return None
    n = (u >> 64 & 3) << 62 | u % (1 << 62)
    return n - (1 << 64) if n >> 63 else n


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(page_id: int | None, url: str | None, sha1: str, size: int, payload: bytes | None, refers_to: str | None, date: str) -> bytes:
    """One record without its closing line breaks; a payload of None makes a revisit."""
    block = http_head(size) + (payload or b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", f"<{record_id(page_id, sha1)}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def members(data: bytes, level: int) -> bytes:
    """data as gzip members of less than 16 MB each, without the last zero byte."""
    out = []
    for a in range(0, len(data), MEMBER):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out.append(z.compress(data[a : a + MEMBER]) + z.flush())
    return b"".join(out)[:-1]


def archived(pages: DataFrame, path: str | None = None, gzip: bool = True, archive: int = ARCHIVE, level: int = 4, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes pages (page_id, url, html) as archives to a folder and returns it.

    A record for each row: the payload is html in UTF-8, a null one is empty. Of
    the rows with equal payloads (by SHA-256), that with the largest page_id
    (null is smallest; of repeated ids that of the largest url, then one of the
    repeated rows) is the response, and the others revisit it. A null url has no
    target; control characters and blanks in a url are percent-encoded. An empty
    table writes no record. Other columns are not looked at. Payloads are brought
    together once a digest, so copies do not travel; archives are cut by records
    so that they hold about `archive` bytes.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    # copies are counted by input partition, so that a row repeated many times stays spread
    known = rows.select("page_id", "url", "sha", F.sha1("html").alias("sha1"), F.length("html").cast("long").alias("size"), F.spark_partition_id().alias("part"))
    known = known.groupBy("sha", "page_id", "url", "part").agg(F.count("*").alias("n"), F.first("sha1").alias("sha1"), F.first("size").alias("size"))
    order = F.struct("page_id", "url", "part")
    best = known.groupBy("sha").agg(F.max(order).alias("best"), F.first("sha1").alias("sha1"), F.first("size").alias("size"))
    whole = known.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    kept = rows.select("sha", "html").dropDuplicates(["sha"]).join(best.withColumnRenamed("sha", "_sha"), F.col("sha") == F.col("_sha"))
    kept = kept.select("best.page_id", "best.url", "sha1", "size", "html", F.lit(None).cast("long").alias("to_page"))
    again = known.join(best.select(F.col("sha").alias("_sha"), "best"), F.col("sha") == F.col("_sha"))
    copies = F.col("n") - F.when(order.eqNullSafe(F.col("best")), 1).otherwise(0)
    again = again.withColumn("n", copies).where("n > 0").select("page_id", "url", "sha1", "size", F.lit(None).cast("binary").alias("html"), F.col("best.page_id").alias("to_page"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")

    def build(batches):
        for batch in batches:
            page, url, sha1, size, to_page = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            html, done, held = batch.column(4), [], 0
            for i in range(batch.num_rows):
                payload = html[i].as_py()
                text = record(page[i], url[i], sha1[i], size[i], payload, payload is None and record_id(to_page[i], sha1[i]) or None, date)
                done.append(members(text + END, level) if gzip else text)
                held += len(done[-1])
                if held > STEP * 64:
                    yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["value"])
                    done, held = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], names=["value"])

    out = arrowed(kept.union(again), build, "value binary").select(F.col("value").cast("string").alias("value"))
    a_file = max(1, int(archive // max(1, (whole["size"] or 0) / (whole["n"] or 1) + 600)))
    out.write.option("lineSep", "\0" if gzip else END.decode()).option("maxRecordsPerFile", a_file).mode("overwrite").text(path)
    return path


def payload_of(fields: dict[str, str], block: bytes) -> tuple[bytes, dict[str, str]]:
    """The payload of a record and the fields of its HTTP head, if it has one."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, {}
    head, _, body = block.partition(END)
    http = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return body, {k.strip().lower(): v.strip() for k, _, v in http}


def digest_holds(stated: str | None, data: bytes) -> bool:
    """Whether data has the stated digest; kinds other than SHA-1 are not checked."""
    kind, _, value = (stated or "").partition(":")
    if kind.lower() != "sha1":
        return True
    return value.upper() == base32_sha1(data) or value.lower() == hashlib.sha1(data).hexdigest()


def parsed(data: bytes, at: int, must_digest: bool = False) -> Record | None:
    """The record at a place; None if data ends first; Damaged if there is none.
    must_digest: one without a digest of its block counts as damaged."""
    version = _VERSION.match(data, at)
    if not version:
        if len(data) - at < len(VERSION) and VERSION.startswith(data[at : at + 5]):
            return None
        raise Damaged("no version line")
    stop = data.find(END, version.end() - 2)
    if stop < 0:
        return None
    fields: dict[str, str] = {}
    for line in data[version.end() : stop].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Damaged("a header line without a name")
        fields[name.strip().lower()] = value.strip()
    if not all(x in fields for x in ("warc-type", "warc-record-id", "warc-date")):
        raise Damaged("a mandatory field is missing")
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        raise Damaged("no length")
    a = stop + len(END)
    b = a + int(fields["content-length"])
    if len(data) < b + len(END):
        return None
    if data[b : b + len(END)] != END:
        raise Damaged("no end where the length says")
    block = data[a:b]
    if must_digest and not fields.get("warc-block-digest", "").lower().startswith("sha1:"):
        raise Damaged("no digest in a damaged member")
    if not digest_holds(fields.get("warc-block-digest"), block):
        raise Damaged("another block digest")
    body, http = payload_of(fields, block)
    if fields.get("warc-type") in ("response", "resource") and "transfer-encoding" not in http and not digest_holds(fields.get("warc-payload-digest"), body):
        raise Damaged("another payload digest")
    return Record(b + len(END), fields, block)


def unzipped(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(content, end, what failed) of the gzip member at a place."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    while at < len(data):
        step = view[at : at + STEP]
        at += len(step)
        try:
            out.append(z.decompress(step))
        except zlib.error as e:
            return b"".join(out), at, str(e)
        if z.eof:
            return b"".join(out), at - len(z.unused_data), ""
    return b"".join(out), at, "the archive ends inside a member"


def unit(data: bytes, at: int) -> tuple[int, list[Record], str, bool]:
    """(end, records, what was lost, whether the end is known) of the plain
    record or the gzip members at a place, which hold whole records together.
    Damaged if there is none."""
    if not data.startswith(b"\x1f\x8b", at):
        one = parsed(data, at)
        if one is None:
            raise Damaged("the archive ends inside a record")
        return one.end, [one], "", True
    raw, end, failed = unzipped(data, at)
    found: list[Record] = []
    lost, place = failed, 0
    while place < len(raw):
        try:
            one = parsed(raw, place, must_digest=bool(failed))
        except Damaged as e:
            lost = lost or str(e)
            later = _VERSION.search(raw, place + 1)
            if not later:
                break
            place = later.start()
            continue
        if one:
            found.append(one)
            place = one.end
        elif not failed and data.startswith(b"\x1f\x8b", end):  # a record over several members
            more, end, failed = unzipped(data, end)
            raw, place = raw[place:] + more, 0
            lost = lost or failed
        else:
            lost = lost or "the archive ends inside a record"
            break
    if not found:
        raise Damaged(lost or "an empty member")
    return end, found, lost, not failed


def walked(data: bytes) -> Iterator[tuple[int, int, Record | None, str]]:
    """(start, end, record, "") for each record and (start, end, None, reason)
    for each gap, in order; together they cover data. Places are those of the
    archive's bytes; records of one member share its span, and so does what is
    lost inside a member of which other records were saved."""
    at, lost, why, saved = 0, None, "", []
    while at <= len(data):
        found: list[Record] = []
        try:
            if at < len(data):
                end, found, inside, sure = unit(data, at)
        except Damaged as e:
            if lost is None:
                lost, why = at, str(e)
        if lost is not None and (found or at == len(data)):
            yield from ((lost, at, one, "") for one in saved)
            yield lost, at, None, why
            lost, saved = None, []
        if at == len(data):
            return
        if found and sure:
            yield from ((at, end, one, "") for one in found)
            if inside:
                yield at, end, None, inside
            at = end
            continue
        if found:  # a member without an end: its records count, the next start is looked for
            lost, why, saved = at, inside, found
        later = _START.search(data, at + 1)
        at = later.start() if later else len(data)


def salvaged(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """archive, start, end, kind ("record" or "gap"), reason, record_type,
    record_id, refers_to_id, uri, payload_bytes, payload_digest, payload, page_id
    and refers_to of everything in the archives of a folder.

    start and end are the bytes of the archive that hold a record or are lost;
    gaps have a reason and nothing else. A response's length and digest are those
    of what was read; a revisit's are those that it states for the full payload.
    payload is null unless asked for. page_id and refers_to are null for archives
    that archived() did not write. Empty archives have no rows. An archive is
    read by one task as a whole: its size is the bound on memory.
    """

    def rows(batches):
        for batch in batches:
            names, contents = batch.column(0).to_pylist(), batch.column(1)
            for i, name in enumerate(names):
                for part in parts(name, contents[i].as_buffer().to_pybytes()):
                    yield part

    def parts(name, data):
        out, held = [], 0
        for start, end, one, reason in walked(data):
            if one is None:
                out.append((name, start, end, "gap", reason, *[None] * 9))
            else:
                f = one.fields
                body, http = payload_of(f, one.block)
                kind = f.get("warc-type")
                size, digest = len(body), None
                stated = f.get("warc-payload-digest", "")
                if kind == "revisit":
                    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
                    digest = stated.partition(":")[2] or None
                else:
                    digest = base32_sha1(body) if not stated.lower().startswith("sha1:") or len(stated) != 37 else stated[5:].upper()
                ids = [f[k].strip("<>") if k in f else None for k in ("warc-record-id", "warc-refers-to")]
                out.append((name, start, end, "record", None, kind, *ids, f.get("warc-target-uri"), size, digest, body if payloads else None, *map(page_of, ids)))
                held += len(body) * payloads + 500
            if held > STEP * 64:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=labels)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=labels)

    schema = f"{ROWS}, page_id long, refers_to long"
    labels = [x.split()[0] for x in schema.split(",")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(",")]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return arrowed(files, rows, schema)


def reread(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    row of pages, written as archives and read back; the cases are those of
    archived() and salvaged()."""
    found = salvaged(pages.sparkSession, archived(pages)).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
