"""Reads, contigs and placements derived from text tables.

The letters of a text are read as bases (a-z as ACGT in turn) and as
qualities, so that the sequence operators have input wherever there is text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import widened

LETTERS = "abcdefghijklmnopqrstuvwxyz"
AS_BASE = "ACGTACGTACGTACGTACGTACGTAC"
AS_QUAL = "".join(chr(35 + i) for i in range(26))
AS_HIGH_QUAL = "".join(chr(55 + i) for i in range(26))
WIDTH, STRIDE = 100, 50
HAP_STRIDE = 10
#: Windows of a contig that ids keep apart.
WINDOWS = 1_000_000


def dna(texts: DataFrame, cid: Column, high: bool = False) -> DataFrame:
    """(cid, s, q) of each text."""
    t = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]", "")
    rows = texts.select(cid.cast("long").alias("cid"), t.alias("t"))
    return rows.select("cid", F.translate("t", LETTERS, AS_BASE).alias("s"), F.translate("t", LETTERS, AS_HIGH_QUAL if high else AS_QUAL).alias("q"))


def window_id() -> Column:
    """cid * WINDOWS + i; more windows than that stop the query."""
    return F.when(F.col("i") < WINDOWS, F.col("cid") * WINDOWS + F.col("i")).otherwise(F.raise_error("a contig of too many windows"))


#: Windows that are cut from one piece of a contig.
PIECE = 64


def windows(contigs: DataFrame, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """(cid, i, seq, qual): windows of width bases every stride bases. Pieces of
    a contig are cut first: a place in a long string costs as much as the string
    before it."""
    n = lambda c: F.floor((F.length(c) - width) / stride).cast("int")
    size = (PIECE - 1) * stride + width
    part = lambda c: F.col(c).substr(F.col("part") * (PIECE * stride) + 1, F.lit(size)).alias(c)
    rows = contigs.where(F.length("s") >= width).select("cid", "s", "q", F.explode(F.sequence(F.lit(0), F.floor(n("s") / PIECE).cast("int"))).alias("part"))
    rows = rows.select("cid", (F.col("part") * PIECE).alias("first"), part("s"), part("q"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), n("s"))).alias("j"))
    cut = lambda c: F.col(c).substr(F.col("j") * stride + 1, F.lit(width))
    return widened(rows.select("cid", (F.col("first") + F.col("j")).alias("i"), cut("s").alias("seq"), cut("q").alias("qual")))


def reads(contigs: DataFrame) -> DataFrame:
    """read_id, cid, i, name, seq, qual."""
    name = F.concat(F.lit("RUN"), F.col("cid") % 7, F.lit(":"), F.col("cid"), F.lit(":"), F.col("i"), F.lit(":"), F.col("i") * STRIDE, F.lit("/"), F.col("i") % 2 + 1)
    return windows(contigs).select(window_id().alias("read_id"), "cid", "i", name.alias("name"), "seq", "qual")


def haplotype_reads(contigs: DataFrame) -> DataFrame:
    """read_id, cid, pos, rc, seq, qual: a window every ten bases with its
    placement. At every 97th place odd reads carry another base; every third
    read is given from the other strand."""
    w = windows(contigs, WIDTH, HAP_STRIDE).withColumn("pos", F.col("i") * HAP_STRIDE)
    off = F.pmod(F.lit(48) - F.col("pos"), F.lit(97))  # the first planted place in the window
    alt = F.col("seq")
    for shift in (0, 97):
        at = off + shift
        swap = F.translate(alt.substr(at + 1, F.lit(1)), "ACGT", "CGTA")
        alt = F.when(at < WIDTH, F.concat(alt.substr(F.lit(1), at), swap, alt.substr(at + 2, F.lit(WIDTH)))).otherwise(alt)
    seq = F.when(F.col("i") % 2 == 1, alt).otherwise(F.col("seq"))
    rc = F.col("i") % 3 == 0
    back = F.reverse(F.translate(seq, "ACGT", "TGCA"))
    return w.select(
        window_id().alias("read_id"), "cid", "pos", rc.alias("rc"),
        F.when(rc, back).otherwise(seq).alias("seq"), F.when(rc, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))
