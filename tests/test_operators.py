"""Operators that SQL cannot express, and invariants."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.functions import tables
from seqloom.operators import calling, coverage, graph, joins, kmers, names, sampling, scores, store
from seqloom.sources import formats
from seqloom.streaming import incremental

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def genome(n, seed=1):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ACGTNacgtnU", max_size=30), min_size=1, max_size=20))
def test_reverse_complement_and_canonical(spark, seqs):
    rows = spark.createDataFrame([(s,) for s in seqs], "s string").select("s", S.reverse_complement("s").alias("r")).select("s", "r", S.reverse_complement("r").alias("rr"), S.canonical("r").alias("c"), S.canonical(S.reverse_complement("r")).alias("c2")).collect()
    for r in rows:
        up = "".join(c if c in "ACGT" else "N" for c in r.s.upper().replace("U", "T"))
        assert r.r == rc(up) and r.rr == up
        if "N" not in up:
            assert r.c == r.c2 == min(up, rc(up))


def test_kmer_counts_cover_all_windows(spark):
    seqs = [genome(n, n) for n in (3, 7, 30, 700)] + ["ACGTNACGTACG", ""]
    got = {r.kmer: r.n for r in kmers.counts(spark.createDataFrame([(s,) for s in seqs], "seq string"), 7).collect()}
    want = {}
    for s in seqs:
        for i in range(len(s) - 6):
            w = s[i : i + 7]
            if "N" not in w:
                want[min(w, rc(w))] = want.get(min(w, rc(w)), 0) + 1
    assert got == want


def test_components_and_tree(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60), rnd.randrange(9) / 10) for _ in range(50)] + [(100 + i, 101 + i, 0.5) for i in range(30)]
    df = spark.createDataFrame(edges, "u long, v long, dist double")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    tree = []
    for d, u, v in sorted({(min(d for a, b, d in edges if {a, b} == {u, v}), min(u, v), max(u, v)) for u, v, _ in edges if u != v}):
        if root(u) != root(v):
            a, b = sorted((root(u), root(v)))
            parent[b] = a
            tree.append((u, v, d))
    assert {(r.u, r.v, r.dist) for r in graph.spanning_tree(df).collect()} == set(tree)
    got = {r.id: r.component for r in graph.components(df).collect()}
    assert got == {x: root(x) for u, v, _ in edges if u != v for x in (u, v)}
    order = graph.tree_order(df.where("u >= 100")).orderBy("at").collect()
    assert [r.id for r in order] == list(range(100, 131))


def test_unitigs_spell_the_genome(spark):
    g = genome(300, 11)
    kc = kmers.counts(spark.createDataFrame([(g,)], "seq string"), 15)
    e = graph.dbg_edges(kc)
    seqs = {r.seq for r in graph.unitigs(e).collect()}
    assert seqs == {g, rc(g)}
    assert graph.without_tips(e, 5).count() == e.count()
    one = spark.createDataFrame([(g[i : i + 14], g[i + 1 : i + 15]) for i in range(286)], "src string, dst string").withColumn("base", F.right("dst", F.lit(1)))
    rows = graph.euler_strings(one).collect()
    assert [r.seq for r in rows] == [g]


@pytest.mark.parametrize("seed", [1, 2])
def test_assembly_places_every_read(spark, seed):
    g = genome(900, seed)
    reads = [g[i : i + 100] for i in range(0, 801, 30)]
    reads = [rc(r) if i % 3 == 0 else r for i, r in enumerate(reads)] + [genome(100, 99)]
    u = spark.createDataFrame(list(enumerate(reads)), "uid long, seq string")
    contigs, placed = graph.assembled(joins.overlaps(u), u)
    c = {r.cid: r.seq for r in contigs.collect()}
    rows = placed.collect()
    assert sorted(r.uid for r in rows) == list(range(len(reads)))
    for r in rows:
        s = rc(reads[r.uid]) if r.rc else reads[r.uid]
        assert c[r.cid][r.pos : r.pos + len(s)] == s
    assert max(map(len, c.values())) == 880 and len(c) == 2


def test_superstring_chains(spark):
    g = genome(400, 4)
    u = spark.createDataFrame([(i, g[50 * i : 50 * i + 100]) for i in range(7)], "uid long, seq string")
    rows = graph.greedy_superstring(u, 50).orderBy("uid").collect()
    assert [(r.head, r.rank, r.start) for r in rows] == [(0, i, 50 * i) for i in range(7)]


def test_store_round_trip_and_interval(spark, tmp_path):
    g = genome(500, 8)
    rnd = random.Random(2)
    reads = []
    for i in range(40):
        p = rnd.randrange(400)
        s = list(g[p : p + 100])
        for _ in range(i % 4):
            s[rnd.randrange(100)] = rnd.choice("ACGTNacgtRY")
        s = "".join(s)
        back = i % 2 == 1
        reads.append((i, f"r{i}", rc(s) if back and set(s) <= set("ACGT") else s, "I" * 100, "", 0, p, back and set(s) <= set("ACGT")))
    reads += [(40, "alone", "NNNN", "!!!!", "x", None, None, None), (41, "empty", "", "", "", None, None, None)]
    df = spark.createDataFrame(reads, "read_id long, name string, seq string, qual string, plus string, cid long, pos int, rc boolean")
    contigs = spark.createDataFrame([(0, g)], "cid long, s string")
    enc = store.encoded(df.drop("cid", "pos", "rc"), df.where("cid is not null"), contigs)
    store.write(enc, contigs, str(tmp_path / "s"))
    enc, contigs, meta = store.open_store(spark, str(tmp_path / "s"))
    back = {r.read_id: (r.name, r.seq, r.qual, r.plus) for r in store.reconstructed(enc, contigs).collect()}
    assert back == {r[0]: r[1:5] for r in reads}
    assert {r.read_id for r in store.covering(enc, 0, 100, 120).collect()} == {r[0] for r in reads if r[6] is not None and r[6] < 120 and r[6] + 100 > 100}
    assert meta.first().n_mapped == 40


def test_simulated_variants_are_called(spark):
    reads, truth = scores.simulated(spark, 4000, 30, every=397)
    g = scores.simulated_genome(spark, 4000)
    framed = calling.in_contig_frame(reads, g).cache()
    cand = calling.candidates(calling.pileup(framed))
    got = {(r.pos + 1, r.major, r.minor) for r in cand.collect()}
    want = {(r.pos, r.ref, r.alt) for r in truth.collect()}
    assert {p for p, *_ in got} == {p for p, *_ in want}
    assert all({a, b} == {r, t} for (p, a, b), (q, r, t) in zip(sorted(got), sorted(want)))


def test_error_correction_restores_a_base(spark):
    g = genome(120, 6)
    bad = g[:60] + g[60].translate(RC) + g[61:]
    df = spark.createDataFrame([(i, g) for i in range(5)] + [(9, bad)], "read_id long, seq string")
    got = kmers.corrections(df, "read_id", kmers.counts(df, 15), 3, 15).collect()
    assert [(r.read_id, r.pos, r.base) for r in got] == [(9, 60, g[60])]


def test_indel_bubbles(spark):
    g = genome(400, 21)
    c = spark.createDataFrame([(1, g), (2, g[:200] + g[204:]), (3, genome(300, 5))], "cid long, s string")
    (r,) = calling.bubbles(c, calling.anchor_pairs(c)).collect()
    assert (r.cid, r.kind, r.len, r.alt_cid) == (1, "del", 4, 2) and g[: r.apos] + g[r.apos + 4 :] == g[:200] + g[204:]


def test_as_of(spark):
    starts = [(0, "a"), (70_000, "b"), (70_010, "c"), (300_000, "d")]
    at = [0, 5, 69_999, 70_000, 70_009, 70_010, 299_999, 300_001, 10**6]
    got = joins.as_of(spark.createDataFrame([(x,) for x in at], "pos long"), spark.createDataFrame(starts, "start long, v string"), "pos", "start", "v")
    assert {r.pos: r.v for r in got.collect()} == {x: [v for s, v in starts if s <= x][-1] for x in at}


def test_fastq_source(spark, tmp_path):
    formats.register(spark)
    rnd = random.Random(1)
    reads = [(f"r{i} x", genome(rnd.randrange(1, 80), i), "@+I"[i % 3]) for i in range(200)]
    path = tmp_path / "a.fastq"
    path.write_text("".join(f"@{n}\n{s}\n+\n{q * len(s)}\n" for n, s, q in reads))
    df = formats.numbered(spark.read.format("fastq").option("rangeBytes", 777).load(str(path)))
    assert [(r.name, r.seq, r.qual) for r in df.orderBy("read_id").collect()] == [(n, s, q * len(s)) for n, s, q in reads]
    df.select("name", "seq", "plus", "qual").write.format("fastq").mode("append").save(str(tmp_path / "out"))
    assert spark.read.format("fastq").load(str(tmp_path / "out")).count() == 200
    with pytest.raises(Exception, match="different numbers"):
        formats.paired(df, df.where("read_id < 100")).collect()


def test_vcf_sam_bed_fasta(spark, tmp_path):
    formats.register(spark)
    rec = spark.createDataFrame([(2, 5, "A", "C", 0.5, 9), (1, 7, "G", "T", 0.25, 8)], "cid long, pos int, ref string, alt string, af double, dp int")
    formats.vcf_rows(rec).coalesce(1).write.format("vcf").mode("append").save(str(tmp_path / "v"))
    got = spark.read.format("vcf").load(str(tmp_path / "v")).collect()
    assert {(r.chrom, r.pos, r.info) for r in got} == {("contig_1", 7, "AF=0.250;DP=8"), ("contig_2", 5, "AF=0.500;DP=9")}
    fa = spark.createDataFrame([("a", "ACGT"), ("b", "")], "name string, seq string")
    fa.write.format("fasta").mode("append").save(str(tmp_path / "f"))
    assert {(r.name, r.seq) for r in spark.read.format("fasta").load(str(tmp_path / "f")).collect()} == {("a", "ACGT"), ("b", "")}
    bed = spark.createDataFrame([("c", 1, 5)], "chrom string, start long, end long")
    bed.write.format("bed").mode("append").save(str(tmp_path / "b"))
    assert spark.read.format("bed").load(str(tmp_path / "b")).collect() == bed.collect()


def test_sql_functions(spark):
    tables.register(spark)
    assert [r.kmer for r in spark.sql("SELECT * FROM kmers('ACGTA', 3) ORDER BY pos").collect()] == ["ACG", "CGT", "GTA"]
    assert spark.sql("SELECT reverse_complement('AACu') x, canonical('TTT') y, mapq(3) z").first() == ("AGTT", "AAA", 42)


def test_streams(spark, tmp_path):
    reads = [genome(60, i) for i in range(12)]
    for i in range(3):
        spark.createDataFrame([(s,) for s in reads[4 * i : 4 * i + 4]], "seq string").write.parquet(str(tmp_path / f"in/b{i}"))
    stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    state = incremental.Running(spark, str(tmp_path / "state"), ["kmer"])
    incremental.kmer_stream(stream, state, 11, str(tmp_path / "cp")).awaitTermination()
    want = kmers.counts(spark.createDataFrame([(s,) for s in reads], "seq string"), 11)
    assert {(r.kmer, r.n) for r in state.table().collect()} == {(r.kmer, r.n) for r in want.collect()}


def test_features_and_compressibility(spark):
    g = genome(600, 3)
    contigs = spark.createDataFrame([(0, g)], "cid long, s string")
    reads = spark.createDataFrame([(i, g[i * 20 : i * 20 + 100], False) for i in range(25)], "read_id long, seq string, rc boolean")
    placed = spark.createDataFrame([(0, i * 20, i * 20 + 100) for i in range(25)], "cid long, start int, end int")
    row = scores.sample_features(reads, placed, contigs).first()
    assert row.n == 25 and row.n50 == 580 and row.cov_p50 == 5
    assert scores.compressibility(reads).first().raw == 25 * 101 - 1


def test_genotype_and_normalized_indel(spark):
    rows = spark.createDataFrame([("A", ["A", "C"], "0/1"), ("A", ["C"], "1/1"), ("A", ["C", "G"], "1/2"), ("A", ["A"], None)], "b string, al array<string>, want string")
    assert all(r.want == r.got for r in rows.select("want", calling.genotype(F.col("b"), F.col("al")).alias("got")).collect())
    ref, alt = calling.normalized_indel(F.lit("ACGG"), F.lit("AGG"))
    assert spark.range(1).select(ref, alt).first() == ("AC", "A")


def test_depth_equals_counting(spark):
    spans = [(0, 2, 9), (0, 5, 6), (1, 0, 3)]
    c = spark.createDataFrame([(0, "A" * 10), (1, "A" * 4)], "cid long, s string")
    got = {(r.cid, r.pos): r.cov for r in coverage.depth(spark.createDataFrame(spans, "cid long, start int, end int"), c).collect()}
    assert got == {(k, p): sum(x == k and a <= p < b for x, a, b in spans) for k, n in ((0, 10), (1, 4)) for p in range(n)}
    assert list(itertools.islice(got, 1))


def test_placed_in_passages_that_many_contigs_share(spark):
    rnd = random.Random(9)
    base = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    shared = base(120)
    contigs = spark.createDataFrame([(i, base(20 + i % 3) + shared + base(10)) for i in range(80)], "cid long, s string")
    read = shared[10:110]
    reads = spark.createDataFrame([(1, read), (2, read[:50] + ("A" if read[50] != "A" else "C") + read[51:]), (3, base(100)), (4, read)], "read_id long, seq string")
    got = {r.read_id: (r.cid, r.pos, r.rc, r.mm) for r in joins.placed(reads, contigs).collect()}
    assert got == {1: (0, 30, False, 0), 2: (0, 30, False, 1), 4: (0, 30, False, 0)}


def test_hashes_equal_python(spark):
    import zlib

    texts = ["", "A", "GATTACA", "x" * 200]
    full = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def fnv(t):
        h = S.FNV_START
        for c in t.encode():
            h = (h ^ c) * S.FNV_PRIME & full
        return signed(h)

    def mixed(x, steps, last):
        x &= full
        for shift, c in steps:
            x = (x ^ x >> shift) * c & full
        return signed(x ^ x >> last)

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.fnv1a("t").alias("f"), F.crc32("t").alias("c")).collect()
    assert {(r.t, r.f, r.c) for r in rows} == {(t, fnv(t), zlib.crc32(t.encode())) for t in texts}
    values = [0, 1, -1, 1 << 62, -(1 << 63), 123456789012345]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", S.fmix("v").alias("a"), S.splitmix("v").alias("b")).collect()
    assert {tuple(r) for r in rows} == {(v, mixed(v, S.FMIX, 33), mixed(v, S.SPLITMIX, 31)) for v in values}


def test_hashed_minimizers_skip_other_letters_and_take_short_reads(spark):
    g = genome(60)
    rows = spark.createDataFrame([(1, g), (2, g[:17]), (3, g[:14]), (4, g[:20] + "N" + g[21:]), (5, "N" * 40), (6, None)], "read_id long, seq string")
    got = {k: [r for r in kmers.hashed_minimizers(rows, "read_id").orderBy("read_id", "pos").collect() if r.read_id == k] for k in range(1, 7)}
    assert got[1] and len(got[2]) == 1 and not got[3] and not got[5] and not got[6]
    assert got[4] and all(r.pos + 15 <= 20 or r.pos > 20 for r in got[4])


def test_sequential_names(spark):
    cases = {1: ["P.7", "P.8", "P.9"], 2: ["P.007", "P.8"], 3: ["P.7", "P.08"], 4: ["P.7", "Q.8"], 5: ["P.7", "P.9"], 6: ["P.0", "P.1"], 7: [".7"], 8: ["a.b.3"], 9: ["x"], 10: [None]}
    rows = [(g, i, n) for g, ns in cases.items() for i, n in enumerate(ns)]
    got = {r.g: (r.prefix, r.first, r.sequential) for r in names.sequential(spark.createDataFrame(rows, "g long, i long, name string"), "g", "i").collect()}
    assert {g for g, r in got.items() if r[2]} == {1, 2, 8}
    assert got[1] == ("P", 7, True) and got[8] == ("a.b", 3, True)


def test_shifted_distance(spark):
    g = genome(40)
    rows = spark.createDataFrame([(g, g), (g, g[2:] + "AC"), (g, "TT" + g[:-2]), ("", g), ("A", "")], "a string, b string")
    got = [r[0] for r in rows.select(S.shifted_distance("a", "b", 3)).collect()]
    assert got[0] == 0.0 and got[1] <= 2 / 40 and got[2] <= 2 / 40 and got[3:] == [1.0, 1.0]


def test_empty_rows_of_ranks_and_shards(spark):
    none = spark.createDataFrame([], "cid long, len int, place long")
    assert sampling.by_size(none, "len", "cid").count() == 0
    assert sampling.stacked(none, "cid", "place").count() == 0
    assert sampling.kept_first(none, ["cid"], ["len"], 2).count() == 0
