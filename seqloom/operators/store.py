"""The lossless columnar read store: encode, reconstruct, query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import reverse_complement


def encoded(reads: DataFrame, placements: DataFrame | None, contigs: DataFrame) -> DataFrame:
    """reads (read_id, name, seq, qual, plus) with a placement become their
    differences from the contig: mm (offset, base) in the contig's direction for
    ACGT bases, exc (offset, character) in the read's for everything else.
    Reads without a placement, or that leave their contig, keep their bases.
    placements: None where reads have cid, pos and rc themselves, which spares an
    exchange that parts neighbours; those of a contig are alike and pack well."""
    rows = reads if placements is None else reads.join(placements.select("read_id", "cid", "pos", "rc"), "read_id", "left")
    # contigs are far smaller than their reads, which are then not sorted
    rows = rows.join(contigs.select("cid", "s").hint("shuffle_hash"), "cid", "left")
    n = F.length("seq")
    fits = F.col("s").isNotNull() & (F.col("pos") >= 0) & (F.col("pos") + n <= F.length("s"))
    plain = F.regexp_replace("seq", "[^ACGT]", "N")
    b = F.when(F.col("rc"), reverse_complement(plain)).otherwise(plain)
    rows = rows.select("*", fits.alias("fits"), F.when(fits, F.split(b, "")).alias("b"), F.when(fits, F.split(F.col("s").substr(F.col("pos") + 1, n), "")).alias("t"))
    diff = F.filter(F.transform(F.arrays_zip("b", "t"), lambda x, i: F.struct(i.alias("off"), x["b"].alias("base"), x["t"].alias("own"))), lambda d: (d["base"] != d["own"]) & (d["base"] != "N"))
    odd = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.struct(i.alias("off"), c.alias("ch"))), lambda d: ~d["ch"].rlike("^[ACGT]$") & (d["ch"] != ""))
    return rows.select(
        "read_id", F.when(F.col("fits"), F.col("cid")).alias("cid"), F.when(F.col("fits"), F.col("pos")).alias("pos"), (F.col("fits") & F.col("rc")).alias("rc"), n.alias("r_len"),
        F.when(F.col("fits"), F.transform(diff, lambda d: F.struct(d["off"].alias("off"), d["base"].alias("base")))).alias("mm"), F.when(F.col("fits"), odd).alias("exc"),
        F.when(~F.col("fits"), F.col("seq")).alias("raw"), "name", "qual", "plus")


def overlaid(base, edits, at: str, what: str):
    """base with characters replaced at the offsets of edits, which are sorted."""
    step = lambda s, d: F.concat(s.substr(F.lit(1), d[at]), d[what], s.substr(d[at] + 2, F.length(s)))
    return F.aggregate(edits, base, step)


def reconstructed(enc: DataFrame, contigs: DataFrame) -> DataFrame:
    """(read_id, name, seq, plus, qual) as they were."""
    rows = enc.join(contigs.select("cid", "s").hint("shuffle_hash"), "cid", "left")
    b = overlaid(F.col("s").substr(F.col("pos") + 1, F.col("r_len")), "mm", "off", "base")
    b = F.when(F.col("rc"), reverse_complement(b)).otherwise(b)
    seq = F.coalesce("raw", overlaid(b, "exc", "off", "ch"))
    return rows.select("read_id", "name", seq.alias("seq"), "plus", "qual")


def covering(enc: DataFrame, cid: int, start: int, end: int) -> DataFrame:
    """Encoded reads that overlap [start, end) of a contig; the conditions reach
    the files' statistics."""
    return enc.where((F.col("cid") == cid) & (F.col("pos") < end) & (F.col("pos") + F.col("r_len") > start))


def write(enc: DataFrame, contigs: DataFrame, path: str) -> None:
    """A store is three tables: reads sorted by place, contigs, and one row of totals."""
    enc.repartitionByRange("cid", "pos").sortWithinPartitions("cid", "pos", "read_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/reads")
    contigs.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/contigs")
    totals = enc.agg(F.count("*").alias("n_reads"), F.count("cid").alias("n_mapped"), F.coalesce(F.sum(F.size("mm")), F.lit(0)).alias("n_mismatches"))
    size = contigs.agg(F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("genome_len"))
    totals.join(F.broadcast(size)).write.mode("overwrite").parquet(f"{path}/meta")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reads, contigs, meta)."""
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("reads", "contigs", "meta"))


def exported(contigs: DataFrame) -> DataFrame:
    """FASTA lines."""
    return contigs.select(F.concat(F.lit(">contig_"), F.col("cid"), F.lit("\n"), F.col("s")).alias("value"))


def quality_binned(reads: DataFrame, bins: int) -> DataFrame:
    """reads with lossy qualities."""
    from seqloom.functions.sequence import binned_quality

    return reads.withColumn("qual", binned_quality("qual", bins))
