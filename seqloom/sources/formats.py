"""FASTQ, FASTA, VCF, SAM and BED as data sources.

Register once with register(spark); then spark.read.format("fastq").load(path)
and df.write.format("fastq").save(path). A plain FASTQ file is read in byte
ranges, each starting at the first record that begins in it; a compressed one
is one partition.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE = 64 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None, part: int):
        super().__init__((path, start, stop, part))
        self.path, self.start, self.stop, self.part = path, start, stop, part


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_")))
    return [path]


def opened(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def record_start(f, at: int) -> int:
    """The first record start at or after a byte: a line that begins with @ and
    whose second successor begins with +, as its own quality line cannot."""
    f.seek(at)
    if at:
        f.seek(at - 1)
        f.readline()
    while True:
        here = f.tell()
        lines = [f.readline() for _ in range(4)]
        if not lines[0]:
            return here
        if lines[0].startswith(b"@") and lines[2].startswith(b"+") and len(lines[1].rstrip(b"\r\n")) == len(lines[3].rstrip(b"\r\n")):
            return here
        f.seek(here)
        f.readline()


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for p in files_of(self.path):
            size = os.path.getsize(p)
            if p.endswith(".gz"):
                out.append(Range(p, 0, None, len(out)))
            else:
                out += [Range(p, a, min(a + self.range, size), len(out)) for a in range(0, max(size, 1), self.range)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        with opened(partition.path) as f:
            if partition.stop is not None:
                f.seek(record_start(f, partition.start))
            while partition.stop is None or f.tell() < partition.stop:
                at = f.tell()
                head = f.readline()
                if not head:
                    return
                head = head.rstrip(b"\r\n")
                if not head:
                    continue
                if not head.startswith(b"@"):
                    raise ValueError(f"{partition.path}: a record at byte {at} does not begin with @")
                seq, plus, qual = (f.readline().rstrip(b"\r\n") for _ in range(3))
                if not plus.startswith(b"+") or len(seq) != len(qual):
                    raise ValueError(f"{partition.path}: bad record at byte {at}")
                yield (os.path.basename(partition.path), at, head[1:].decode("latin-1"), seq.decode("latin-1"), plus[1:].decode("latin-1"), qual.decode("latin-1"))


class LineReader(DataSourceReader):
    def __init__(self, options: dict, parse):
        self.path, self.parse = options["path"], parse

    def partitions(self) -> list[InputPartition]:
        return [Range(p, 0, None, i) for i, p in enumerate(files_of(self.path))]

    def read(self, partition: Range) -> Iterator[tuple]:
        with opened(partition.path) as f:
            yield from self.parse(line.decode("latin-1").rstrip("\r\n") for line in f)


class Done(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class LineWriter(DataSourceWriter):
    """Each partition writes a part file; what a failed task left is replaced."""

    def __init__(self, options: dict, render, head: str, suffix: str):
        self.path, self.render, self.head, self.suffix = options["path"].removeprefix("file://"), render, head, suffix
        self.crlf = options.get("crlf", "false").lower() == "true"

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():05d}{self.suffix}"
        stop = "\r\n" if self.crlf else "\n"
        with open(os.path.join(self.path, f".{name}"), "w", encoding="latin-1", newline="") as f:
            if self.head:
                f.write(self.head.replace("\n", stop))
            for row in rows:
                f.write(self.render(row).replace("\n", stop) + stop)
        os.replace(os.path.join(self.path, f".{name}"), os.path.join(self.path, name))
        return Done(name)

    def commit(self, messages) -> None:
        open(os.path.join(self.path, "_SUCCESS"), "w").close()


def fasta_records(lines: Iterator[str]) -> Iterator[tuple]:
    name, parts = None, []
    for line in lines:
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts)
            name, parts = line[1:], []
        elif line:
            parts.append(line)
    if name is not None:
        yield name, "".join(parts)


def table_records(kinds: tuple, skip: str):
    def parse(lines: Iterator[str]) -> Iterator[tuple]:
        for line in lines:
            if line and not line.startswith(skip):
                cells = line.split("\t")
                yield tuple(k(c) for k, c in zip(kinds, cells + [""] * (len(kinds) - len(cells))))

    return parse


VCF_HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"


class Fastq(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file string, at long, name string, seq string, plus string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(dict(self.options))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return LineWriter(dict(self.options), lambda r: f"@{r['name']}\n{r['seq']}\n+{r['plus'] or ''}\n{r['qual']}", "", ".fastq")


class Fasta(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "name string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(dict(self.options), fasta_records)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return LineWriter(dict(self.options), lambda r: f">{r['name']}\n{r['seq']}", "", ".fasta")


class Vcf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(dict(self.options), table_records((str, int, str, str, str, str, str, str), "#"))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return LineWriter(dict(self.options), lambda r: "\t".join(str(x) for x in (r["chrom"], r["pos"], r["id"], r["ref"], r["alt"], r["qual"], r["filter"], r["info"])), VCF_HEAD, ".vcf")


class Sam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sam"

    def schema(self) -> str:
        return "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        def parse(lines):
            for c in (x.split("\t") for x in lines if x and not x.startswith("@")):
                yield c[0], int(c[1]), c[2], int(c[3]), int(c[4]), c[5], c[9], c[10]

        return LineReader(dict(self.options), parse)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return LineWriter(dict(self.options), lambda r: "\t".join(str(x) for x in (r["qname"], r["flag"], r["rname"], r["pos"], r["mapq"], r["cigar"], "*", 0, 0, r["seq"], r["qual"])), "@HD\tVN:1.6\n", ".sam")


class Bed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bed"

    def schema(self) -> str:
        return "chrom string, start long, end long"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(dict(self.options), table_records((str, int, int), "#"))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return LineWriter(dict(self.options), lambda r: f"{r['chrom']}\t{r['start']}\t{r['end']}", "", ".bed")


def register(spark: SparkSession) -> None:
    for source in (Fastq, Fasta, Vcf, Sam, Bed):
        spark.dataSource.register(source)


def numbered(reads: DataFrame) -> DataFrame:
    """reads of the fastq source with read_id, their place in file order: ranks
    within byte cells, and the cells' sums before."""
    from pyspark.sql import Window

    rows = reads.withColumn("_cell", F.floor(F.col("at") / (1 << 20)))
    inside = F.row_number().over(Window.partitionBy("file", "_cell").orderBy("at"))
    cells = rows.groupBy("file", "_cell").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("file", "_cell", before.alias("_before"))
    rows = rows.withColumn("_nth", inside).join(cells, ["file", "_cell"])
    return rows.select((F.col("_before") + F.col("_nth") - 1).alias("read_id"), "name", "seq", "plus", "qual")


def paired(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """Mates of two numbered files side by side; fails if one file has more."""
    a = r1.select("read_id", F.struct("name", "seq", "plus", "qual").alias("r1"))
    b = r2.select(F.col("read_id").alias("_id"), F.struct("name", "seq", "plus", "qual").alias("r2"))
    rows = a.join(b, F.col("read_id") == F.col("_id"), "full")
    missing = F.col("r1").isNull() | F.col("r2").isNull()
    ok = F.when(missing, F.raise_error(F.lit("the two files have different numbers of reads")).cast("long")).otherwise(F.col("read_id"))
    return rows.select(ok.alias("pair_id"), "r1", "r2")


def vcf_rows(records: DataFrame) -> DataFrame:
    """Call records (cid, pos, ref, alt, af, dp and any of anchors, ploidy) as vcf rows, sorted."""
    extra = [F.concat(F.lit(f";{c.upper()}="), F.col(c)) for c in ("anchors", "ploidy") if c in records.columns]
    info = F.concat(F.format_string("AF=%.3f;DP=%d", F.col("af").cast("double"), F.col("dp")), *extra)
    rows = records.repartitionByRange("cid", "pos").sortWithinPartitions("cid", "pos", "ref", "alt")
    return rows.select(F.concat(F.lit("contig_"), F.col("cid")).alias("chrom"), F.col("pos").cast("long").alias("pos"), F.lit(".").alias("id"), "ref", "alt", F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"))


def sam_rows(framed: DataFrame) -> DataFrame:
    """Placed reads (read_id, cid, pos, rc, b, q, mm) as sam rows."""
    from seqloom.functions.sequence import mapq

    return framed.select(F.concat(F.lit("r"), F.col("read_id")).alias("qname"), F.when(F.col("rc"), 16).otherwise(0).alias("flag"), F.concat(F.lit("contig_"), F.col("cid")).alias("rname"), (F.col("pos") + 1).cast("long").alias("pos"), mapq("mm").alias("mapq"), F.concat(F.length("b"), F.lit("M")).alias("cigar"), F.col("b").alias("seq"), F.col("q").alias("qual"))
