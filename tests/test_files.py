"""Formats through Spark's reader and writer, on a path that only Hadoop's file access can open."""

import gzip
import random

import pytest

from seqloom.sources import files


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("store")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./in", f"file://{d}")
    return d, "viewfs://shelf/in"


def records(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        size = rnd.choice([0, 1, 5, 30, 80])
        qual = "".join(rnd.choice("@@+I!") for _ in range(size))
        out.append((f"r{i} x", "".join(rnd.choice("ACGTN") for _ in range(size)), rnd.choice(["", "again"]), qual))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_over_splits(spark, store, end):
    d, far = store
    rows = [r for r in records(300) if r[1]]
    path = d / f"a{len(end)}.fastq"
    path.write_bytes("".join(f"@{n}{end}{s}{end}+{p}{end}{q}{end}" for n, s, p, q in rows).encode())
    with gzip.open(str(path) + ".gz", "wb") as f:
        f.write(path.read_bytes())
    for size in ("700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            for name in (path.name, path.name + ".gz"):
                got = files.read_fastq(spark, f"{far}/{name}").orderBy("block", "nth").collect()
                assert [tuple(r)[3:] for r in got] == rows
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    df = spark.createDataFrame(rows, "name string, seq string, plus string, qual string").coalesce(1)
    files.write_fastq(df, f"{far}/out{len(end)}", end)
    assert next((d / f"out{len(end)}").glob("part*")).read_bytes() == path.read_bytes()


def test_fastq_of_broken_records_stops(spark, store):
    d, far = store
    (d / "b.fastq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a whole FASTQ record"):
        files.read_fastq(spark, f"{far}/b.fastq").collect()
    (d / "c.fastq").write_text("")
    assert files.read_fastq(spark, f"{far}/c.fastq").collect() == []


def test_fasta_vcf_sam_and_bed(spark, store):
    d, far = store
    (d / "a.fa").write_text(">one two\nACGT\nAC\n>empty\n>last\nG")
    assert [tuple(r) for r in files.read_fasta(spark, f"{far}/a.fa").collect()] == [("one two", "ACGTAC"), ("empty", ""), ("last", "G")]
    files.write_fasta(spark.createDataFrame([("x", "ACGT"), ("y", "")], "name string, seq string"), f"{far}/fa")
    assert sorted(map(tuple, files.read_fasta(spark, f"{far}/fa").collect())) == [("x", "ACGT"), ("y", "")]
    contigs = spark.createDataFrame([("c2", 50), ("c1", 900)], "name string, len long")
    calls = [("c2", 5, None, "A", "C", None, "PASS", "DP=3"), ("c1", 70, None, "G", "T", None, "PASS", "DP=9"), ("c1", 7, None, "G", "GA", None, "PASS", "DP=1")]
    kinds = ", ".join(f"{k} {v}" for k, v in files.VCF.items())
    files.write_vcf(spark.createDataFrame(calls, kinds).repartition(3), contigs, f"{far}/vcf")
    lines = "".join(p.read_text() for p in sorted((d / "vcf").glob("part*"))).splitlines()
    assert lines[:4] == ["##fileformat=VCFv4.2", "##contig=<ID=c1,length=900>", "##contig=<ID=c2,length=50>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    assert [x.split("\t")[:2] for x in lines[4:]] == [["c1", "7"], ["c1", "70"], ["c2", "5"]]
    assert sorted(r.pos for r in files.read_vcf(spark, f"{far}/vcf").collect()) == [5, 7, 70]
    rows = [("q", 16, "c1", 3, 60, "4M", "*", 0, 0, "ACGT", "IIII")]
    files.write_sam(spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in files.SAM.items())), contigs, f"{far}/sam")
    lines = "".join(p.read_text() for p in sorted((d / "sam").glob("part*"))).splitlines()
    assert lines[:3] == ["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:c1\tLN:900", "@SQ\tSN:c2\tLN:50"]
    assert [tuple(r) for r in files.read_sam(spark, f"{far}/sam").collect()] == rows
    (d / "a.bed").write_text("#x\nc1\t5\t9\r\n\nc2\t0\t3\n")
    assert sorted(map(tuple, files.read_bed(spark, f"{far}/a.bed").collect())) == [("c1", 5, 9), ("c2", 0, 3)]
