"""Pileups and reference-free variant calling.

placed: read_id, cid, pos, rc, seq, qual (reads with their placement);
contigs: cid, s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.sequence import hamming, reverse_complement, tandem_in, unpacked
from seqloom.operators import buckets, rolling
from seqloom.operators.joins import overlapping
from seqloom.operators.kmers import exploded, twice
from seqloom.session import arrowed, widened

MAX_MM = 7
MIN_DEPTH, MIN_MINOR, MIN_Q, MIN_LR = 6, 2, 20, 10.0
HALF = 15
FLANK_DIFF, MINOR_FLANKS, MAF, THIRD = 2, 3, 0.20, 0.12
DEPTH_CAP, KMER_CAP = 2.5, 1.1


def in_contig_frame(placed: DataFrame, contigs: DataFrame, max_mm: int = MAX_MM) -> DataFrame:
    """read_id, cid, pos, rc, base string b, quality string q in the contig's
    direction, mm; reads that leave the contig or differ in max_mm places or
    more are dropped. The contig's window is cut before bases are compared."""
    seq = F.when(F.col("rc"), reverse_complement("seq")).otherwise(F.col("seq"))
    qual = F.when(F.col("rc"), F.reverse("qual")).otherwise(F.col("qual"))
    rows = placed.select("read_id", "cid", "pos", "rc", seq.alias("b"), qual.alias("q")).join(contigs.select("cid", "s"), "cid")
    rows = rows.where((F.col("pos") >= 0) & (F.col("pos") + F.length("b") <= F.length("s")))
    rows = rows.withColumn("mm", hamming("b", F.col("s").substr(F.col("pos") + 1, F.length("b"))))
    return rows.where(F.col("mm") < max_mm).select("read_id", "cid", "pos", "rc", "b", "q", "mm")


def pileup(framed: DataFrame) -> DataFrame:
    """read_id, cid, pos, base, qual: one row for each base of a read."""
    rows = framed.select("read_id", "cid", "pos", F.posexplode(F.arrays_zip(F.split("b", "").alias("b"), F.split("q", "").alias("q"))).alias("j", "x"))
    return widened(rows.select("read_id", "cid", (F.col("pos") + F.col("j")).alias("pos"), F.col("x.b").alias("base"), F.greatest(F.ascii("x.q") - 33, F.lit(0)).alias("qual")).where("base in ('A','C','G','T')"))


def allele_counts(piles: DataFrame) -> DataFrame:
    """cid, pos, a, c, g, t, depth."""
    n = lambda b: F.count(F.when(F.col("base") == b, 1)).alias(b.lower())
    return piles.groupBy("cid", "pos").agg(*map(n, "ACGT"), F.count("*").alias("depth"))


def ranked_alleles(counts: DataFrame) -> DataFrame:
    """counts with alleles: the four (n, base), most first, ties in base order."""
    pairs = F.array(*[F.struct((-F.col(b.lower())).alias("neg"), F.lit(b).alias("base")) for b in "ACGT"])
    ranked = F.transform(F.array_sort(pairs), lambda p: F.struct((-p["neg"]).alias("n"), p["base"].alias("base")))
    return counts.withColumn("alleles", ranked)


def tallied(piles: DataFrame) -> DataFrame:
    """cid, pos, a, c, g, t, depth, votes: each column once, votes being its
    (base, qual, n) in order. Equal votes are counted first, and no base of a read
    is joined with its column's counts."""
    return _tallied(piles.groupBy("cid", "pos", "base", "qual").agg(F.count("*").alias("n")))


def tallied_reads(framed: DataFrame) -> DataFrame:
    """tallied() of the pileup() of framed reads, which are counted as they stand in a
    batch: there is no row for each base."""
    at = framed.schema["pos"].dataType.simpleString()
    rows = framed.where("b is not null and q is not null").select(F.col("cid").cast("long").alias("cid"), "pos", "b", "q")
    votes = arrowed(rows, buckets.vote_counts, f"cid long, pos {at}, base string, qual int, n long")
    # dealt once, by column, for both sums
    return _tallied(votes.repartition("cid", "pos").groupBy("cid", "pos", "base", "qual").agg(F.sum("n").alias("n")))


def _tallied(rows: DataFrame) -> DataFrame:
    n = lambda b: F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).alias(b.lower())
    votes = F.array_sort(F.collect_list(F.struct("base", "qual", "n"))).alias("votes")
    return rows.groupBy("cid", "pos").agg(*map(n, "ACGT"), F.sum("n").alias("depth"), votes)


def _summed(p) -> Column:
    """The sum over a column's bases of the logarithm of p(base, error), 1e-300 at least."""
    term = lambda v: v["n"] * F.log(F.greatest(p(v["base"], F.pow(F.lit(10.0), -v["qual"] / 10.0)), F.lit(1e-300)))
    return F.aggregate("votes", F.lit(0.0), lambda total, v: total + term(v))


def likelihood(n_alleles: int) -> Column:
    """The log-likelihood of a column's bases under the first alleles."""
    one = lambda k, base, e: F.when(base == F.col("alleles")[k]["base"], 1 - e).otherwise(e / 3)
    return _summed(lambda base, e: sum((one(k, base, e) for k in range(1, n_alleles)), one(0, base, e)) / n_alleles)


def candidates(piles: DataFrame) -> DataFrame:
    """cid, pos, a, c, g, t, depth, major, minor, n_minor, minor_q, lr, alleles
    of the columns that look heterozygous."""
    return heterozygous(tallied(piles))


def heterozygous(tallies: DataFrame) -> DataFrame:
    """candidates() of tallied() columns. Those that fail on their counts are gone
    before any likelihood is summed."""
    rows = ranked_alleles(tallies).where((F.col("depth") >= MIN_DEPTH) & (F.col("alleles")[1]["n"] >= MIN_MINOR))
    minor = F.filter("votes", lambda v: v["base"] == F.col("alleles")[1]["base"])
    quals = F.flatten(F.transform(minor, lambda v: F.array_repeat(v["qual"], v["n"].cast("int"))))
    half = lambda up: F.get("quals", F.floor((F.size("quals") - 1 + up) / 2).cast("int"))
    rows = rows.withColumn("quals", quals).withColumn("minor_q", (half(0) + half(1)) / 2.0).where(F.col("minor_q") >= MIN_Q)
    rows = rows.withColumn("lr", F.round((likelihood(2) - likelihood(1)) * 10 / F.log(F.lit(10.0)), 6)).where(F.col("lr") >= MIN_LR)
    return rows.select("cid", "pos", "a", "c", "g", "t", "depth", F.col("alleles")[0]["base"].alias("major"), F.col("alleles")[1]["base"].alias("minor"), F.col("alleles")[1]["n"].alias("n_minor"), "minor_q", "lr", "alleles")


def flanks(framed: DataFrame, cand: DataFrame, half: int = HALF) -> DataFrame:
    """cid, pos, is_major, flank: the 2 half + 1 bases around a candidate in each
    read that holds them all and carries the major or the minor allele."""
    spans = framed.select("cid", "b", F.col("pos").alias("start"), (F.col("pos") + F.length("b")).alias("end"))
    sites = cand.select("cid", (F.col("pos") - half).alias("start"), (F.col("pos") + half + 1).alias("end"), "pos", "major", "minor").where("start >= 0")
    rows = overlapping(spans, sites).where((F.col("s_start") >= F.col("start")) & (F.col("s_end") <= F.col("end")))
    rows = rows.select("cid", F.col("s_pos").alias("pos"), "s_major", "s_minor", F.col("b").substr(F.col("s_start") - F.col("start") + 1, F.lit(2 * half + 1)).alias("flank"))
    base = F.col("flank").substr(half + 1, 1)
    return rows.where((base == F.col("s_major")) | (base == F.col("s_minor"))).select("cid", "pos", (base == F.col("s_major")).alias("is_major"), "flank")


def flank_votes(flank: DataFrame, half: int = HALF, least: int = 3) -> DataFrame:
    """cid, pos, diffs, n_minor_flank, minor_mode: places around a candidate
    where both alleles' reads vote for different bases, at least three votes
    each; and the most common minor flank (ties: the smaller) with its count."""
    # reads mostly agree around a candidate: equal flanks are counted before they are cut
    flank = flank.groupBy("cid", "pos", "is_major", "flank").agg(F.count("*").alias("n"))
    votes = flank.select("cid", "pos", "is_major", "n", F.posexplode(F.split("flank", "")).alias("j", "base")).where(F.col("j") != half)
    votes = votes.groupBy("cid", "pos", "j", "is_major", "base").agg(F.sum("n").alias("n"))
    sides = votes.groupBy("cid", "pos", "j", "is_major").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("neg"), "base")).alias("b"))
    side = lambda m, c: F.max(F.when(F.col("is_major") == m, c))
    per = sides.groupBy("cid", "pos", "j").agg(side(True, F.col("n")).alias("n1"), side(False, F.col("n")).alias("n2"), side(True, F.col("b.base")).alias("b1"), side(False, F.col("b.base")).alias("b2"))
    diffs = per.groupBy("cid", "pos").agg(F.count(F.when((F.col("n1") >= least) & (F.col("n2") >= least) & (F.col("b1") != F.col("b2")), 1)).alias("diffs"))
    modes = flank.where("not is_major").groupBy("cid", "pos").agg(F.min(F.struct((-F.col("n")).alias("neg"), "flank")).alias("b"))
    return diffs.join(modes, ["cid", "pos"], "left").select("cid", "pos", "diffs", F.coalesce(-F.col("b.neg"), F.lit(0)).alias("n_minor_flank"), F.col("b.flank").alias("minor_mode"))


def kept_sites(cand: DataFrame, votes: DataFrame, kc: DataFrame, h: int, ploidy: int = 2) -> DataFrame:
    """The candidates that pass all filters: few flank differences, depth and
    flank k-mer below their caps, minor share and minor flank support, and no
    allele beyond the ploidy."""
    minor_kmer = F.least("minor_mode", reverse_complement("minor_mode"))
    rows = cand.join(votes, ["cid", "pos"]).withColumn("kmer", minor_kmer).join(kc.select(F.col("kmer").alias("_k"), F.col("n").alias("kn")), F.col("kmer") == F.col("_k"), "left")
    rows = rows.where((F.col("diffs") <= FLANK_DIFF) & (F.col("n_minor_flank") >= MINOR_FLANKS))
    rows = rows.where((F.col("depth") <= int(DEPTH_CAP * h * 1.25 + 0.5)) & (F.coalesce("kn", F.lit(0)) <= int(KMER_CAP * h + 0.5)))
    rows = rows.where(F.col("n_minor") >= MAF * F.col("depth"))
    if ploidy < 4:
        rows = rows.where(F.col("alleles")[ploidy]["n"] <= THIRD * F.col("depth"))
    return rows


def snv_records(kept: DataFrame, contigs: DataFrame, ploidy: int = 2) -> DataFrame:
    """cid, pos (1-based), ref, alt, af, dp."""
    rows = kept.join(contigs.select("cid", "s"), "cid").withColumn("ref", F.col("s").substr(F.col("pos") + 1, F.lit(1)))
    if ploidy == 2:
        alt = F.when(F.col("major") != F.col("ref"), F.col("major")).otherwise(F.col("minor"))
    else:
        some = F.filter(F.slice("alleles", 1, ploidy), lambda a: (a["base"] != F.col("ref")) & (a["n"] >= MAF * F.col("depth")))
        alt = F.array_join(F.transform(some, lambda a: a["base"]), ",")
    rows = rows.select("cid", (F.col("pos") + 1).alias("pos"), "ref", alt.alias("alt"), F.round(F.col("n_minor") / F.col("depth"), 3).alias("af"), F.col("depth").alias("dp"))
    return rows.where("alt <> ''")


def consensus(piles: DataFrame, contigs: DataFrame) -> DataFrame:
    """cid, s: each place by majority, ties to the first base; places without
    votes as they were."""
    votes = piles.groupBy("cid", "pos", "base").agg(F.count("*").alias("n"))
    best = votes.groupBy("cid", "pos").agg(F.min(F.struct((-F.col("n")).alias("neg"), "base")).alias("b"))
    own = contigs.select("cid", F.posexplode(F.split("s", "")).alias("pos", "own")).where("own <> ''")
    rows = own.join(best, ["cid", "pos"], "left").select("cid", "pos", F.coalesce("b.base", "own").alias("base"))
    parts = rows.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("x"))
    return parts.select("cid", F.array_join(F.transform("x", lambda p: p["base"]), "").alias("s"))


def anchor_pairs(contigs: DataFrame, k: int = 25) -> DataFrame:
    """kmer, ref_cid, ref_pos, alt_cid, alt_pos, opposite: canonical k-mers that
    occur exactly twice, in two contigs; the longer one (ties: smaller cid) is
    the reference, and alt_pos counts in its direction."""
    if rolling.FEWEST <= k <= rolling.LONGEST:
        side = lambda i: F.struct((-F.col(f"n{i}")).alias("neg"), F.col(f"key{i}").alias("cid"), F.col(f"pos{i}").alias("pos"), F.col(f"rc{i}").alias("rc"))
        two = twice(contigs, "cid", k, "s").select(unpacked("packed", k).alias("kmer"), F.least(side(1), side(2)).alias("a"), F.greatest(side(1), side(2)).alias("b"))
    else:
        rows = exploded(contigs.select("cid", "s", F.length("s").alias("n")), k, ["cid", "n"], "s")
        occ = F.struct((-F.col("n")).alias("neg"), "cid", "pos", "rc")
        two = rows.groupBy("kmer").agg(F.count("*").alias("many"), F.min(occ).alias("a"), F.max(occ).alias("b")).where("many = 2 and a.cid <> b.cid")
    opposite = F.col("a.rc") != F.col("b.rc")
    return two.select("kmer", F.col("a.cid").alias("ref_cid"), F.col("a.pos").alias("ref_pos"), F.col("b.cid").alias("alt_cid"), F.when(opposite, -F.col("b.neg") - F.col("b.pos") - k).otherwise(F.col("b.pos")).alias("alt_pos"), opposite.alias("opposite"))


def bubbles(contigs: DataFrame, anchors: DataFrame, longest: int = 30, flank: int = 15) -> DataFrame:
    """cid, apos, kind (ins, del, snv), len, ins, anchors, alt_cid, alt_pos: where
    two contigs match from an anchor, differ by one event and match again over
    the flank. Insertions are tried before deletions, short ones first; equal
    events are counted, with the smallest (alt_cid, alt_pos)."""
    pair = ["ref_cid", "alt_cid", "opposite", "diag"]
    side = lambda x: contigs.select(F.col("cid").alias(f"{x}_cid"), F.col("s").alias(x))
    alt = F.when(F.col("opposite"), reverse_complement("alt")).otherwise(F.col("alt"))
    anchors = anchors.select("ref_cid", "alt_cid", "opposite", (F.col("ref_pos") - F.col("alt_pos")).alias("diag"), "ref_pos")
    # the places that differ, once for each diagonal of a pair
    lines = anchors.select(*pair).distinct().join(side("ref"), "ref_cid").join(side("alt"), "alt_cid").withColumn("alt", alt)
    lo = F.greatest("diag", F.lit(0))
    n = F.least(F.length("ref") - lo, F.length("alt") - (lo - F.col("diag")))
    places = F.zip_with(F.split(F.col("ref").substr(lo + 1, n), ""), F.split(F.col("alt").substr(lo - F.col("diag") + 1, n), ""), lambda x, y: x != y)
    places = F.filter(F.transform(places, lambda d, i: F.when(d, i + lo)), lambda i: i.isNotNull())
    places = lines.select(*pair, places.alias("places"))
    # the first of them behind each anchor
    hit = F.array_min(F.filter("places", lambda i: i >= F.col("ref_pos")))
    met = anchors.join(places, pair).select(*pair, "ref_pos", hit.alias("apos")).where("apos is not null")
    met = met.groupBy(*pair, "apos").agg(F.count("*").alias("anchors"), F.min(F.col("ref_pos") - F.col("diag")).alias("alt_pos"))
    rows = met.join(side("ref"), "ref_cid").join(side("alt"), "alt_cid").withColumn("alt", alt)
    rows = rows.withColumn("A", F.col("ref").substr(F.col("apos") + 1, F.lit(longest + 2 * flank))).withColumn("B", F.col("alt").substr(F.col("apos") - F.col("diag") + 1, F.lit(longest + 2 * flank)))
    part = lambda c, at: F.col(c).substr(at + 1, F.lit(flank))
    full = lambda x: F.length(x) == flank
    steps = F.sequence(F.lit(1), F.lit(longest))
    gap = lambda long, short: F.get(F.filter(steps, lambda g: full(part(long, g)) & (part(long, g) == part(short, F.lit(0)))), F.lit(0))
    snv = full(part("A", F.lit(1))) & (part("A", F.lit(1)) == part("B", F.lit(1)))
    rows = rows.select(*pair, "apos", "anchors", "alt_pos", "B", gap("B", "A").alias("gi"), gap("A", "B").alias("gd"), snv.alias("snv"))
    kind = F.when(F.col("gi").isNotNull(), "ins").when(F.col("gd").isNotNull(), "del").when(F.col("snv"), "snv")
    rows = rows.withColumn("kind", kind).where("kind is not null and apos > 0")
    bases = F.when(F.col("kind") == "ins", F.col("B").substr(F.lit(1), F.col("gi"))).when(F.col("kind") == "snv", F.col("B").substr(1, 1)).otherwise("")
    rows = rows.select(F.col("ref_cid").alias("cid"), F.col("apos").cast("int").alias("apos"), "kind", F.coalesce("gi", "gd", F.lit(1)).alias("len"), bases.alias("ins"), "anchors", "alt_cid", F.col("alt_pos").cast("int").alias("alt_pos"))
    return rows.groupBy("cid", "apos", "kind", "len", "ins").agg(F.sum("anchors").alias("anchors"), F.min(F.struct("alt_cid", "alt_pos")).alias("x")).select("cid", "apos", "kind", "len", "ins", "anchors", "x.alt_cid", "x.alt_pos")


def indel_records(found: DataFrame, contigs: DataFrame, smooth: DataFrame, medians: DataFrame) -> DataFrame:
    """cid, pos, ref, alt, af, dp, anchors of the indel bubbles with support on
    both sides. smooth: cid, pos, cov; medians: cid, median."""
    rows = found.where("kind in ('ins', 'del')").join(contigs.select("cid", "s"), "cid").where(F.col("apos") <= F.length("s"))
    at = lambda x: widened(smooth.select(F.col("cid").alias(f"{x}_c"), F.col("pos").alias(f"{x}_p"), F.col("cov").alias(f"{x}_cov")))
    rows = rows.join(at("r"), (F.col("cid") == F.col("r_c")) & (F.col("apos") - 1 == F.col("r_p")), "left")
    rows = rows.join(at("a"), (F.col("alt_cid") == F.col("a_c")) & (F.col("alt_pos") == F.col("a_p")), "left")
    rows = rows.join(medians.select(F.col("cid").alias("m_c"), "median"), F.col("alt_cid") == F.col("m_c"), "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumn("refd", z("r_cov")).withColumn("altd", F.greatest(z("median"), z("a_cov"))).where("refd >= 3 and altd >= 3 and anchors >= 3")
    event = F.when(F.col("kind") == "del", F.col("s").substr(F.col("apos") + 1, F.col("len"))).otherwise(F.col("ins"))
    left = F.col("s").substr(F.greatest(F.col("apos") - 12, F.lit(0)) + 1, F.least(F.col("apos"), F.lit(12)))
    rows = rows.withColumn("event", event).where(~tandem_in("event", left) | (F.col("anchors") >= 5)).where((F.col("kind") == "ins") | (F.length("event") == F.col("len")))
    anchor = F.col("s").substr(F.col("apos"), F.lit(1))
    ref = F.when(F.col("kind") == "del", F.concat(anchor, "event")).otherwise(anchor)
    alt = F.when(F.col("kind") == "ins", F.concat(anchor, "event")).otherwise(anchor)
    return rows.select("cid", F.col("apos").alias("pos"), ref.alias("ref"), alt.alias("alt"), F.round(F.col("altd") / F.greatest(F.lit(1), F.col("refd") + F.col("altd")), 3).alias("af"), (F.col("refd") + F.col("altd")).alias("dp"), "anchors")


def cross_contig_snvs(found: DataFrame, contigs: DataFrame, smooth: DataFrame, medians: DataFrame, h: int, called: DataFrame) -> DataFrame:
    """cid, pos, ref, alt, af, dp, anchors of single-base bubbles that no pileup
    call covers: solid flanks, balanced alleles, plausible depth."""
    rows = found.where("kind = 'snv' and anchors >= 15").join(contigs.select("cid", "s"), "cid")
    rows = rows.join(widened(smooth.select(F.col("cid").alias("r_c"), F.col("pos").alias("r_p"), F.col("cov").alias("refd"))), (F.col("cid") == F.col("r_c")) & (F.col("apos") == F.col("r_p")), "left")
    rows = rows.join(medians.select(F.col("cid").alias("m_c"), F.col("median").alias("altd")), F.col("alt_cid") == F.col("m_c"), "left")
    rows = rows.select("cid", (F.col("apos") + 1).alias("pos"), F.col("s").substr(F.col("apos") + 1, F.lit(1)).alias("ref"), F.col("ins").alias("alt"), F.coalesce("refd", F.lit(0)).alias("refd"), F.coalesce("altd", F.lit(0)).alias("altd"), "anchors")
    rows = rows.withColumn("dp", F.col("refd") + F.col("altd")).withColumn("af", F.round(F.col("altd") / F.greatest(F.lit(1), F.col("dp")), 3))
    rows = rows.where((F.col("af") >= 0.25) & (F.col("af") <= 0.75) & (F.col("dp") <= int(1.8 * h + 0.5)))
    return rows.join(called.select("cid", "pos"), ["cid", "pos"], "left_anti").select("cid", "pos", "ref", "alt", "af", "dp", "anchors")


def three_hypotheses(piles: DataFrame) -> DataFrame:
    """cid, pos, depth, qual, genotype: the best of major alone, both, minor
    alone; het if both are as likely as the minor alone."""
    rows = ranked_alleles(tallied(piles)).where((F.col("depth") >= MIN_DEPTH) & (F.col("alleles")[1]["n"] >= 1))
    minor = _summed(lambda base, e: F.when(base == F.col("alleles")[1]["base"], 1 - e).otherwise(e / 3))
    s = rows.select("cid", "pos", "depth", likelihood(1).alias("l1"), likelihood(2).alias("l2"), minor.alias("l3"))
    best = F.greatest("l1", "l2", "l3")
    gt = F.when(best == F.col("l1"), "ref").when(F.col("l2") >= F.col("l3"), "het").otherwise("hom")
    return s.select("cid", "pos", "depth", F.round((best - F.col("l1")) * 10 / F.log(F.lit(10.0)), 4).alias("qual"), gt.alias("genotype")).where("genotype <> 'ref'")


def normalized_indel(ref: Column, alt: Column) -> tuple[Column, Column]:
    """Both alleles without the suffix that they share, the first base kept."""
    n = F.least(F.length(ref), F.length(alt)) - 1
    same = F.zip_with(F.split(F.reverse(ref), ""), F.split(F.reverse(alt), ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    k = F.least(F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, n), n)
    return ref.substr(F.lit(1), F.length(ref) - k), alt.substr(F.lit(1), F.length(alt) - k)


def genotype(base: Column, alleles: Column) -> Column:
    """0/1, 1/1, 1/2 or null (no variant) of a site's alleles, an array, against
    the genome's base."""
    other = F.size(F.filter(alleles, lambda a: a != base))
    return F.when(other == 0, F.lit(None)).when(other == 1, F.when(F.array_contains(alleles, base), "0/1").otherwise("1/1")).otherwise(F.when(F.array_contains(alleles, base), "0/1").otherwise("1/2"))


def precision_recall(truth: DataFrame, calls: DataFrame, key: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of exact matches on key."""
    t, c = truth.select(*key).distinct().withColumn("t", F.lit(1)), calls.select(*key).distinct().withColumn("c", F.lit(1))
    s = t.join(c, key, "full").agg(F.count(F.when(F.col("t").isNotNull() & F.col("c").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("c").isNull(), 1)).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    s = s.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.select("tp", "fp", "fn", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), 6).alias("f1"))

