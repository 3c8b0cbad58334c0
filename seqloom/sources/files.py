"""FASTQ, FASTA, VCF, SAM and BED through Spark's own text reader and writer: on
every file system that Spark knows, in splits, with its commit protocol.

A FASTQ record begins behind a line end with "@", and so may its qualities:
the reader splits there, and puts pieces that belong together back, also over
the border of two splits.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.session import arrowed

PIECES = "file string, block long, nth long, kind string, name string, seq string, plus string, qual string"


def _pieces(batches):
    """Records, and what may be part of one: heads without qualities, and qualities."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
    at, nth, held = None, 0, None
    for batch in batches:
        out: list[tuple] = []
        for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (file, block):
                if held:
                    out.append(held)
                at, nth, held = (file, block), 0, None
            if nth == 0 and block == 0:
                value = value.removeprefix("@")
            lines = [x.removesuffix("\r") for x in value.removesuffix("\n").split("\n")]
            if held and len(lines) == 1:
                out.append((*held[:3], "whole", *held[4:7], "@" + lines[0]))
                held = None
                nth += 1
                continue
            if held:
                out.append(held)
                held = None
            if len(lines) == 1:
                if block or nth or value.strip():  # not an empty file
                    out.append((file, block, nth, "tail", None, None, None, "@" + lines[0]))
            elif len(lines) == 3:
                held = (file, block, nth, "head", lines[0], lines[1], lines[2].removeprefix("+"), None)
            else:
                out.append((file, block, nth, "whole" if len(lines) == 4 and len(lines[1]) == len(lines[3]) else "odd", lines[0], lines[1], lines[2].removeprefix("+"), lines[3] if len(lines) > 3 else None))
            nth += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, kinds)], names=names)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, name, seq, plus, qual): records of four lines, with
    line ends of either kind; (file, block, nth) is their order. A record whose
    sequence and qualities differ in length, or that is cut off, stops the read.
    Compressed files are read, each as one split."""
    raw = spark.read.option("lineSep", "\n@").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    rows = arrowed(raw, _pieces, PIECES)
    whole = rows.where("kind = 'whole'")
    # pieces at the borders of splits: few, and joined in the order of their file
    loose = rows.where("kind <> 'whole'")
    w = Window.partitionBy("file").orderBy("block", "nth")
    loose = loose.withColumns({"next_kind": F.lead("kind").over(w), "next_qual": F.lead("qual").over(w), "last_kind": F.lag("kind").over(w)})
    loose = loose.where("not (kind = 'tail' and last_kind <=> 'head')")
    qual = F.when((F.col("kind") == "head") & (F.col("next_kind") == "tail") & (F.length("next_qual") == F.length("seq")), F.col("next_qual"))
    broken = F.raise_error(F.concat(F.lit("not a whole FASTQ record in "), F.col("file")))
    loose = loose.withColumn("qual", F.when(qual.isNotNull(), qual).otherwise(broken))
    keep = ["file", "block", "nth", "name", "seq", "plus", "qual"]
    return whole.select(*keep).union(loose.select(*keep))


def write_fastq(reads: DataFrame, path: str, line_end: str = "\n", compression: str | None = None) -> None:
    """Writes (name, seq, plus, qual) in the order of the rows' partitions; null
    plus is empty. Every line, the last one too, has the line end."""
    plus = F.concat(F.lit("+"), F.coalesce("plus", F.lit(""))) if "plus" in reads.columns else F.lit("+")
    value = F.concat_ws(line_end, F.concat(F.lit("@"), "name"), "seq", plus, "qual")
    write_lines(reads.select(value.alias("value")), path, line_end, compression)


def write_lines(rows: DataFrame, path: str, line_end: str = "\n", compression: str | None = None) -> None:
    out = rows.select("value").write.mode("overwrite").option("lineSep", line_end)
    (out.option("compression", compression) if compression else out).text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): sequences over any number of lines."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where("trim(v) <> ''")
    lines = F.split("v", "\r?\n")
    return raw.select(F.get(lines, F.lit(0)).alias("name"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"))


def write_fasta(contigs: DataFrame, path: str) -> None:
    """Writes (name, seq)."""
    write_lines(contigs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")), path)


def fields_of(spark: SparkSession, path: str, columns: dict[str, str], comment: str) -> DataFrame:
    """The tab-separated columns, with their types, of lines that are no comment."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("v")).where(~F.col("v").startswith(comment) & (F.col("v") != ""))
    cells = F.split("v", "\t")
    return raw.select(*[F.get(cells, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(columns.items())])


VCF = {"chrom": "string", "pos": "long", "id": "string", "ref": "string", "alt": "string", "qual": "string", "filter": "string", "info": "string"}
SAM = {"qname": "string", "flag": "int", "rname": "string", "pos": "long", "mapq": "int", "cigar": "string", "rnext": "string", "pnext": "long", "tlen": "long", "seq": "string", "qual": "string"}
BED = {"chrom": "string", "start": "long", "end": "long"}


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return fields_of(spark, path, VCF, "#")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return fields_of(spark, path, SAM, "@")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return fields_of(spark, path, BED, "#")


def headed(rows: DataFrame, columns: list[str], order: list[str], heads: DataFrame, path: str) -> None:
    """Writes head lines (nth, value) and, sorted behind them, tab-separated
    rows: the parts of the folder, one after the other, are one file."""
    body = rows.select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("nth"), F.struct(*order).alias("at"), F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns]).alias("value"))
    head = heads.select(F.lit(0).alias("part"), "nth", F.lit(None).cast(body.schema["at"].dataType).alias("at"), "value")
    write_lines(head.union(body).repartitionByRange("part", "nth", "at").sortWithinPartitions("part", "nth", "at"), path)


def contig_lines(contigs: DataFrame, form: str, first: int) -> DataFrame:
    """(nth, value): form, with {name} and {len}, for each contig (name, len) by name."""
    before, _, rest = form.partition("{name}")
    middle, _, after = rest.partition("{len}")
    nth = F.row_number().over(Window.orderBy("name")) + first  # the contigs of a head: a line each
    return contigs.select(nth.cast("long").alias("nth"), F.concat(F.lit(before), "name", F.lit(middle), F.col("len").cast("string"), F.lit(after)).alias("value"))


def write_vcf(records: DataFrame, contigs: DataFrame, path: str) -> None:
    """Writes records (the columns of VCF) by chrom and pos behind a head that
    names the contigs (name, len)."""
    spark = records.sparkSession
    fixed = spark.createDataFrame([(0, "##fileformat=VCFv4.2"), (1 << 60, "#" + "\t".join(c.upper() for c in VCF))], "nth long, value string")
    headed(records, list(VCF), ["chrom", "pos", "ref", "alt"], fixed.union(contig_lines(contigs, "##contig=<ID={name},length={len}>", 0)), path)


def write_sam(rows: DataFrame, contigs: DataFrame, path: str) -> None:
    """Writes alignments (the columns of SAM) by rname and pos behind @HD and an
    @SQ line for each contig (name, len)."""
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(0, "@HD\tVN:1.6\tSO:coordinate")], "nth long, value string")
    headed(rows, list(SAM), ["rname", "pos", "qname"], fixed.union(contig_lines(contigs, "@SQ\tSN:{name}\tLN:{len}", 0)), path)
