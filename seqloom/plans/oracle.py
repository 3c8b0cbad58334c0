"""SQL for the queries of seqloom.plans.catalog, in DuckDB's dialect."""

from __future__ import annotations

from seqloom.functions.sequence import quality_bin
from seqloom.operators.views import AS_BASE, AS_HIGH_QUAL, AS_QUAL, LETTERS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dna(name: str, table: str, cid: str, qual: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT CAST(cid AS BIGINT) AS cid, translate(t, {q(LETTERS)}, {q(AS_BASE)}) AS s, translate(t, {q(LETTERS)}, {q(qual)}) AS q
        FROM (SELECT {cid} AS cid, regexp_replace(lower(coalesce("text", '')), '[^a-z]', '', 'g') AS t FROM {table}))"""


def reads_of(name: str, src: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT cid * 1000000 + i AS read_id, cid, i, 'RUN' || (cid % 7) || ':' || cid || ':' || i || ':' || (i * 50) || '/' || (1 + i % 2) AS name,
        substr(s, 1 + 50 * i, 100) AS seq, substr(q, 1 + 50 * i, 100) AS qual
        FROM (SELECT cid, s, q, CAST(unnest(range(0, (length(s) - 100) // 50 + 1)) AS INTEGER) AS i FROM {src} WHERE length(s) >= 100))"""


def rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


TEXTS = dna("texts", "documents", "doc_id", AS_QUAL)
TALK = dna("talk", "conversations", "conv_id * 100000 + turn", AS_HIGH_QUAL)
TEXT_READS = TEXTS + ", " + reads_of("reads", "texts")
TALK_READS = TALK + ", " + reads_of("reads", "talk")
UNIQUE = TALK_READS + ", uniq AS MATERIALIZED (SELECT min(read_id) AS uid, seq FROM reads GROUP BY seq)"
HAPS = TALK + f""", haps0 AS (SELECT cid, i, i * 10 AS pos, substr(s, 1 + 10 * i, 100) AS w, substr(q, 1 + 10 * i, 100) AS qq, (((48 - i * 10) % 97) + 97) % 97 AS off
        FROM (SELECT cid, s, q, CAST(unnest(range(0, (length(s) - 100) // 10 + 1)) AS INTEGER) AS i FROM talk WHERE length(s) >= 100)),
    haps1 AS (SELECT *, CASE WHEN i % 2 = 1 THEN substr(w, 1, off) || translate(substr(w, off + 1, 1), 'ACGT', 'CGTA') || substr(w, off + 2, 100) ELSE w END AS a FROM haps0),
    haps2 AS (SELECT *, CASE WHEN i % 2 = 1 AND off + 97 < 100 THEN substr(a, 1, off + 97) || translate(substr(a, off + 98, 1), 'ACGT', 'CGTA') || substr(a, off + 99, 100) ELSE a END AS b FROM haps1),
    haps AS MATERIALIZED (SELECT cid * 1000000 + i AS read_id, cid, pos, i % 3 = 0 AS rc, CASE WHEN i % 3 = 0 THEN {rc('b')} ELSE b END AS seq, CASE WHEN i % 3 = 0 THEN reverse(qq) ELSE qq END AS qual FROM haps2)"""
FRAMED = HAPS + f""", framed AS MATERIALIZED (SELECT read_id, cid, pos, rc, b, qual2 AS q, mm FROM (
        SELECT h.*, CASE WHEN h.rc THEN {rc('h.seq')} ELSE h.seq END AS b, CASE WHEN h.rc THEN reverse(h.qual) ELSE h.qual END AS qual2,
               hamming(CASE WHEN h.rc THEN {rc('h.seq')} ELSE h.seq END, substr(t.s, h.pos + 1, 100)) AS mm
        FROM haps h JOIN talk t USING (cid)) WHERE mm < 7)"""
PILES = FRAMED + """, piles AS MATERIALIZED (SELECT read_id, cid, pos + j AS pos, substr(b, j + 1, 1) AS base, greatest(ascii(substr(q, j + 1, 1)) - 33, 0) AS qual
        FROM (SELECT *, CAST(unnest(range(0, length(b))) AS INTEGER) AS j FROM framed))"""
COUNTS = PILES + """, counts AS MATERIALIZED (SELECT cid, pos, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, count(*) AS depth FROM piles GROUP BY cid, pos),
    alleles AS (SELECT cid, pos, base, n, row_number() OVER (PARTITION BY cid, pos ORDER BY n DESC, base) AS r FROM (SELECT cid, pos, unnest([a, c, g, t]) AS n, unnest(['A', 'C', 'G', 'T']) AS base FROM counts)),
    ranked AS MATERIALIZED (SELECT cid, pos, max(base) FILTER (r = 1) AS b1, max(base) FILTER (r = 2) AS b2, max(n) FILTER (r = 2) AS n2, max(n) FILTER (r = 3) AS n3, max(n) FILTER (r = 4) AS n4 FROM alleles GROUP BY cid, pos)"""


def ll(alleles: list[str]) -> str:
    p = " + ".join(f"CASE WHEN base = {a} THEN 1 - pow(10.0, -qual / 10.0) ELSE pow(10.0, -qual / 10.0) / 3 END" for a in alleles)
    return f"sum(ln(greatest(({p}) / {len(alleles)}, 1e-300)))"


CANDIDATES = COUNTS + f""", cand AS MATERIALIZED (SELECT k.cid, k.pos, k.a, k.c, k.g, k.t, k.depth, b1 AS major, b2 AS minor, n2 AS n_minor, minor_q, lr, n3 FROM counts k JOIN ranked r USING (cid, pos) JOIN (
        SELECT cid, pos, median(CASE WHEN base = b2 THEN qual END) AS minor_q, round(({ll(['b1', 'b2'])} - {ll(['b1'])}) * 10 / ln(10), 6) AS lr
        FROM piles JOIN ranked USING (cid, pos) GROUP BY cid, pos) l USING (cid, pos) WHERE depth >= 6 AND n2 >= 2 AND minor_q >= 20 AND lr >= 10)"""
FLANKS = CANDIDATES + """, flank AS MATERIALIZED (SELECT cid, pos, substr(f, 16, 1) = major AS is_major, f AS flank FROM (
        SELECT c.cid, c.pos, c.major, c.minor, substr(f.b, c.pos - 15 - f.pos + 1, 31) AS f FROM cand c JOIN framed f ON f.cid = c.cid AND c.pos - 15 >= f.pos AND c.pos + 16 <= f.pos + 100 AND c.pos >= 15)
        WHERE substr(f, 16, 1) IN (major, minor)),
    votes AS (SELECT cid, pos, j, is_major, substr(flank, j + 1, 1) AS base, count(*) AS n FROM (SELECT *, unnest(range(0, 31)) AS j FROM flank) WHERE j <> 15 GROUP BY ALL),
    sides AS (SELECT cid, pos, j, is_major, sum(n) AS n, first(base ORDER BY n DESC, base) AS b FROM votes GROUP BY cid, pos, j, is_major),
    diffs AS (SELECT cid, pos, count(*) FILTER (n1 >= 3 AND n2 >= 3 AND x1 <> x2) AS diffs FROM (SELECT cid, pos, j, max(n) FILTER (is_major) AS n1, max(n) FILTER (NOT is_major) AS n2, max(b) FILTER (is_major) AS x1, max(b) FILTER (NOT is_major) AS x2 FROM sides GROUP BY cid, pos, j) GROUP BY cid, pos),
    modes AS (SELECT cid, pos, max(n) AS n, first(flank ORDER BY n DESC, flank) AS flank FROM (SELECT cid, pos, flank, count(*) AS n FROM flank WHERE NOT is_major GROUP BY ALL) GROUP BY cid, pos),
    voted AS MATERIALIZED (SELECT d.cid, d.pos, diffs, coalesce(n, 0) AS n_minor_flank, flank AS minor_mode FROM diffs d LEFT JOIN modes m USING (cid, pos))"""


def kmers_of(src: str, seq: str, k: int, keep: str = "", canonical: bool = True) -> str:
    own = f"substr({seq}, p + 1, {k})"
    km = f"least({own}, substr(back, length({seq}) - p - {k} + 1, {k}))" if canonical else own
    return f"(SELECT {keep} CAST(p AS INTEGER) AS pos, {km} AS kmer FROM (SELECT *, {rc(seq)} AS back, unnest(range(0, length({seq}) - {k} + 1)) AS p FROM {src} WHERE length({seq}) >= {k}))"


def count_sql(src: str, seq: str, k: int) -> str:
    return f"(SELECT kmer, count(*) AS n FROM {kmers_of(src, seq, k)} GROUP BY kmer)"


DEPTH_H = f"""kc AS MATERIALIZED {count_sql('haps', 'seq', 31)},
    top AS (SELECT top, greatest(1, top // 200) AS bw FROM (SELECT least(coalesce(max(n), 0), 5000) AS top FROM kc)),
    dims AS (SELECT top, bw, top // bw + 2 AS nb FROM top),
    hist AS (SELECT b, coalesce(k, 0) AS k, lag(coalesce(k, 0)) OVER (ORDER BY b) AS k0, lead(coalesce(k, 0)) OVER (ORDER BY b) AS k1 FROM (SELECT unnest(range(0, nb)) AS b FROM dims) LEFT JOIN (SELECT n // bw AS b, count(*) AS k FROM kc, dims WHERE n >= 2 AND n <= top GROUP BY 1) USING (b)),
    valley AS (SELECT coalesce(min(b), 2) AS v FROM hist, dims WHERE b >= 1 AND b + 1 < nb // 3 AND k < k0 AND k < k1),
    peak AS (SELECT first(b ORDER BY k DESC, b) AS p FROM hist, valley WHERE b > v),
    depth_h AS (SELECT CAST(CASE WHEN top >= 4 AND floor((coalesce(p, v) + 0.5) * bw) >= 5 THEN floor((coalesce(p, v) + 0.5) * bw) ELSE 30 END AS BIGINT) AS h FROM dims, valley, peak)"""


def sites(ploidy: int) -> str:
    extra = f"AND {'n' + str(ploidy + 1)} <= 0.12 * depth" if ploidy < 4 else ""
    return FLANKS + ", " + DEPTH_H + f""", kept AS (SELECT c.*, r.n4, r.b1, r.b2 FROM cand c JOIN voted v USING (cid, pos) JOIN (SELECT cid, pos, n4, b1, b2 FROM ranked) r USING (cid, pos) LEFT JOIN kc ON kc.kmer = least(minor_mode, {rc('minor_mode')}), depth_h
        WHERE diffs <= 2 AND n_minor_flank >= 3 AND depth <= floor(2.5 * h * 1.25 + 0.5) AND coalesce(kc.n, 0) <= floor(1.1 * h + 0.5) AND n_minor >= 0.2 * depth {extra})"""


TWINS = TALK + """, twin_a AS (SELECT cid, s, CAST(cid % 12 + 1 AS INTEGER) AS g, substr(s, 101) AS rest FROM talk WHERE length(s) >= 200),
    twins AS MATERIALIZED (SELECT cid, s FROM twin_a UNION ALL SELECT cid + 50000, substr(s, 1, 100) || CASE WHEN cid % 3 = 2 THEN translate(substr(rest, 1, 1), 'ACGT', 'CGTA') || substr(rest, 2)
        WHEN cid % 2 = 1 THEN substr('ACGTTGCATCAG', 1, g) || rest ELSE substr(rest, g + 1) END FROM twin_a)"""
ANCHORS = TWINS + f""", occ AS (SELECT kmer, cid, pos, n, own <> kmer AS rc FROM (SELECT cid, n, CAST(p AS INTEGER) AS pos, substr(s, p + 1, 25) AS own, least(substr(s, p + 1, 25), substr(back, n - p - 24, 25)) AS kmer FROM (SELECT cid, s, length(s) AS n, {rc('s')} AS back, unnest(range(0, length(s) - 24)) AS p FROM twins))),
    anchors AS MATERIALIZED (SELECT kmer, a.cid AS ref_cid, a.pos AS ref_pos, b.cid AS alt_cid, CASE WHEN a.rc <> b.rc THEN b.n - b.pos - 25 ELSE b.pos END AS alt_pos, a.rc <> b.rc AS opposite FROM (
        SELECT kmer, first(x ORDER BY x.n DESC, x.cid, x.pos) AS a, last(x ORDER BY x.n DESC, x.cid, x.pos) AS b, count(*) AS many FROM (SELECT kmer, {{'cid': cid, 'pos': pos, 'n': n, 'rc': rc}} AS x FROM occ) GROUP BY kmer) WHERE many = 2 AND a.cid <> b.cid)"""
BUBBLES = ANCHORS + f""", lines AS (SELECT ref_cid, alt_cid, opposite, diag, r.s AS R, CASE WHEN opposite THEN {rc('t.s')} ELSE t.s END AS T FROM (SELECT DISTINCT ref_cid, alt_cid, opposite, ref_pos - alt_pos AS diag FROM anchors) l JOIN twins r ON r.cid = ref_cid JOIN twins t ON t.cid = alt_cid),
    -- the places that differ, once for each diagonal of a pair, and the first of them behind each anchor
    places AS MATERIALIZED (SELECT ref_cid, alt_cid, opposite, diag, p FROM (SELECT *, unnest(range(greatest(diag, 0), least(length(R), length(T) + diag))) AS p FROM lines) WHERE R[p + 1] <> T[p - diag + 1]),
    met AS (SELECT a.ref_cid, a.alt_cid, a.opposite, a.diag, p AS apos, a.alt_pos FROM (SELECT *, ref_pos - alt_pos AS diag FROM anchors) a ASOF JOIN places x ON x.ref_cid = a.ref_cid AND x.alt_cid = a.alt_cid AND x.opposite = a.opposite AND x.diag = a.diag AND a.ref_pos <= x.p),
    sums AS (SELECT ref_cid, alt_cid, opposite, diag, apos, count(*) AS anchors, min(alt_pos) AS alt_pos FROM met GROUP BY ALL),
    sided AS (SELECT s.*, substr(R, CAST(apos + 1 AS INTEGER), 60) AS A, substr(T, CAST(apos - s.diag + 1 AS INTEGER), 60) AS B FROM sums s JOIN lines l ON l.ref_cid = s.ref_cid AND l.alt_cid = s.alt_cid AND l.opposite = s.opposite AND l.diag = s.diag),
    gaps AS (SELECT *, list_filter(range(1, 31), lambda g: length(substr(B, g + 1, 15)) = 15 AND substr(B, g + 1, 15) = substr(A, 1, 15))[1] AS gi,
        list_filter(range(1, 31), lambda g: length(substr(A, g + 1, 15)) = 15 AND substr(A, g + 1, 15) = substr(B, 1, 15))[1] AS gd,
        length(substr(A, 2, 15)) = 15 AND substr(A, 2, 15) = substr(B, 2, 15) AS snv FROM sided),
    events AS (SELECT ref_cid AS cid, apos, CASE WHEN gi IS NOT NULL THEN 'ins' WHEN gd IS NOT NULL THEN 'del' WHEN snv THEN 'snv' END AS kind, coalesce(gi, gd, 1) AS len, CASE WHEN gi IS NOT NULL THEN substr(B, 1, gi) WHEN gd IS NULL AND snv THEN substr(B, 1, 1) ELSE '' END AS ins, anchors, alt_cid, alt_pos FROM gaps),
    bubbles AS MATERIALIZED (SELECT cid, CAST(apos AS INTEGER) AS apos, kind, CAST(len AS INTEGER) AS len, ins, CAST(sum(anchors) AS BIGINT) AS anchors, min(x).alt_cid AS alt_cid, CAST(min(x).alt_pos AS INTEGER) AS alt_pos FROM (SELECT *, {{'alt_cid': alt_cid, 'alt_pos': alt_pos}} AS x FROM events WHERE kind IS NOT NULL AND apos > 0) GROUP BY cid, apos, kind, len, ins)"""


def depth_of(name: str, contigs: str, spans: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT c.cid, c.pos, least(sum(coalesce(d, 0)) OVER (PARTITION BY c.cid ORDER BY c.pos), 60000) AS cov FROM (SELECT cid, CAST(unnest(range(0, length(s))) AS INTEGER) AS pos FROM {contigs}) c
        LEFT JOIN (SELECT cid, pos, sum(d) AS d FROM (SELECT cid, start AS pos, 1 AS d FROM {spans} UNION ALL SELECT cid, stop, -1 FROM {spans}) GROUP BY cid, pos) e ON e.cid = c.cid AND e.pos = c.pos)"""


COVER = TALK_READS + ", spans AS (SELECT cid, i * 50 AS start, i * 50 + 100 AS stop FROM reads), " + depth_of("cov", "talk", "spans")
SMOOTH = "smooth AS MATERIALIZED (SELECT cid, pos, CAST(floor(sum(cov) OVER w / count(*) OVER w) AS BIGINT) AS cov FROM cov WINDOW w AS (PARTITION BY cid ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))"
MEDIANS = "medians AS (SELECT cid, cov AS median FROM (SELECT cid, cov, row_number() OVER (PARTITION BY cid ORDER BY cov) AS r, count(*) OVER (PARTITION BY cid) AS n FROM cov) WHERE r = n // 2 + 1)"
TWIN_COVER = BUBBLES + ", spans AS (SELECT cid, i * 10 AS start, i * 10 + 100 AS stop FROM (SELECT cid, unnest(range(0, (length(s) - 100) // 10 + 1)) AS i FROM twins WHERE length(s) >= 100)), " + depth_of("cov", "twins", "spans") + ", " + SMOOTH + ", " + MEDIANS
MINIMIZERS = "windowed AS (SELECT {key}, pos, min(struct_pack(kmer := kmer, neg := -(pos + 14), rc := rc)) OVER (PARTITION BY {key} ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM {src}), {name} AS MATERIALIZED (SELECT {key}, m.kmer AS value, CAST(-m.neg AS INTEGER) AS pos, m.rc AS rc FROM (SELECT *, lag(m) OVER (PARTITION BY {key} ORDER BY pos) AS l FROM (SELECT * FROM windowed WHERE pos >= 9)) WHERE l IS NULL OR m <> l)"


def minimizers_of(name: str, src: str, seq: str, key: str) -> str:
    rows = f"(SELECT {key}, pos, least(own, other) AS kmer, other < own AS rc FROM (SELECT {key}, CAST(p AS INTEGER) AS pos, substr({seq}, p + 1, 15) AS own, substr(back, length({seq}) - p - 14, 15) AS other FROM (SELECT *, {rc(seq)} AS back, unnest(range(0, length({seq}) - 14)) AS p FROM {src} WHERE length({seq}) >= 15)))"
    return MINIMIZERS.format(key=key, src=rows, name=name).replace("windowed", f"w_{name}")


TALK_MIN = TALK_READS + ", " + minimizers_of("rm", "reads", "seq", "read_id")
NUM = "regexp_full_match(val, '(0|[1-9][0-9]{0,17})')"
TOKENS = "(SELECT read_id, unnest(range(0, len(t))) AS col, unnest(t) AS val FROM (SELECT read_id, regexp_extract_all(name, '[0-9]+|[^0-9]+') AS t FROM reads))"
BIN = lambda n: f"translate(qual, {q(''.join(chr(33 + x) for x in range(94)))}, {q(''.join(chr(33 + quality_bin(x, n)) for x in range(94)))})"
LSH = UNIQUE + ", buckets AS (SELECT uid, unnest([" + ", ".join("'" + str(h) + ":' || " + " || ".join(f"substr(seq, {(h * 31 + j * 13) % 100 + 1}, 1)" for j in range(8)) for h in range(8)) + """]) AS b FROM uniq WHERE length(seq) = 100),
    few AS (SELECT b FROM buckets GROUP BY b HAVING count(*) <= 200), near AS MATERIALIZED (SELECT u, v, round(2 * hamming(x.seq, y.seq) / 100, 6) AS dist FROM (SELECT DISTINCT p.uid AS u, o.uid AS v FROM buckets p JOIN buckets o USING (b) JOIN few USING (b) WHERE p.uid < o.uid) JOIN uniq x ON x.uid = u JOIN uniq y ON y.uid = v)"""
DBG = TALK_READS + f""", kc AS {count_sql('reads', 'seq', 15)}, strands AS (SELECT kmer, false AS is_rc, n FROM kc UNION ALL SELECT {rc('kmer')}, true, n FROM kc WHERE {rc('kmer')} <> kmer),
    edges AS MATERIALIZED (SELECT substr(kmer, 1, 14) AS src, substr(kmer, 2, 14) AS dst, substr(kmer, 15, 1) AS base, is_rc, n FROM strands)"""
OVERLAPS = UNIQUE + f""", views AS (SELECT uid, 0 AS view, seq FROM uniq UNION ALL SELECT uid, 1, {rc('seq')} FROM uniq), heads AS (SELECT *, substr(seq, 1, 24) AS seed FROM views WHERE length(seq) >= 24),
    tails AS (SELECT uid, view, substr(seq, place + 1, 24) AS seed, substr(seq, place + 1) AS rest FROM (SELECT *, unnest(range(0, length(seq) - 23)) AS place FROM views WHERE length(seq) >= 24)),
    over AS MATERIALIZED (SELECT to_id, CAST(to_view AS INTEGER) AS to_view, from_id, CAST(from_view AS INTEGER) AS from_view, CAST(overlap AS INTEGER) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY to_id, to_view ORDER BY overlap DESC, from_id, from_view) AS r FROM (
        SELECT h.uid AS to_id, h.view AS to_view, t.uid AS from_id, t.view AS from_view, length(t.rest) AS overlap FROM heads h JOIN tails t USING (seed) WHERE (h.uid <> t.uid OR h.view <> t.view) AND length(t.rest) <= length(h.seq) AND starts_with(h.seq, t.rest))) WHERE r <= 8)"""


def freq(k: int) -> str:
    alphabet = f"(SELECT string_agg(['A','C','G','T'][CAST(i // CAST(pow(4, {k} - 1 - j) AS BIGINT) % 4 AS BIGINT) + 1], '' ORDER BY j) AS kmer FROM (SELECT i, unnest(range(0, {k})) AS j FROM range(0, {4**k}) r(i)) GROUP BY i)"
    return f"WITH {TEXTS}, got AS (SELECT kmer, count(*) AS n FROM {kmers_of('texts', 's', k, canonical=False)} GROUP BY kmer) SELECT a.kmer, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM got), 9) AS freq FROM {alphabet} a LEFT JOIN got USING (kmer)"


SKETCH = TALK + f", sketch AS MATERIALIZED (SELECT cid, CAST(rank AS INTEGER) AS rank, h FROM (SELECT cid, h, row_number() OVER (PARTITION BY cid ORDER BY h) AS rank FROM (SELECT cid, CAST('0x' || substr(md5(kmer), 1, 15) AS BIGINT) AS h FROM {kmers_of('talk', 's', 21, 'cid,')})) WHERE rank <= 50)"

TWO64 = "18446744073709551616::UHUGEINT"


def times(x: str, c: int) -> str:
    return f"CAST(CAST({x} AS UHUGEINT) * {c}::UHUGEINT % {TWO64} AS UBIGINT)"


def mixed(x: str, steps: list, last: int) -> str:
    """Folds and products of 64 bits; x is an UBIGINT, evaluated once a step by a list of one."""
    for shift, c in steps:
        x = f"list_transform([{x}], lambda v: {times(f'xor(v, v >> {shift})', c)})[1]"
    return f"list_transform([{x}], lambda v: xor(v, v >> {last}))[1]"


def signed(x: str) -> str:
    return f"CAST(CAST({x} AS HUGEINT) - CASE WHEN {x} >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END AS BIGINT)"


def packed_sql(kmer: str) -> str:
    return f"list_reduce(list_transform(string_split({kmer}, ''), lambda b: CAST(instr('ACGT', b) - 1 AS UBIGINT)), lambda h, b: h * 4 + b)"


FMIX_STEPS = [(33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)]
SPLIT_STEPS = [(30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)]
FNV = "list_reduce(list_transform(string_split(seq, ''), lambda b: CAST(ascii(b) AS UBIGINT)), lambda h, b: " + times("xor(h, b)", 1099511628211) + ", 14695981039346656037::UBIGINT)"
CRC = "xor(list_reduce(list_transform(range(0, length(seq) * 8), lambda i: CASE WHEN i % 8 = 0 THEN ascii(seq[i // 8 + 1]) ELSE 0 END::BIGINT), lambda h, b: CASE WHEN xor(h, b) & 1 = 1 THEN xor(xor(h, b) >> 1, 3988292384) ELSE xor(h, b) >> 1 END, 4294967295::BIGINT), 4294967295)"


def shift_cost(n: int) -> str:
    x, y = max(n, 0), max(-n, 0)
    return f"(2 * hamming(substr(a, {x + 1}, {100 - abs(n)}), substr(b, {y + 1}, {100 - abs(n)})) + {abs(n)})"


PLANTED = "planted AS (SELECT cid, p AS pos FROM (SELECT cid, unnest(range(0, length(s))) AS p FROM talk WHERE length(s) >= 100) WHERE p % 97 = 48)"

GRADED = dna("lowtalk", "conversations", "conv_id * 100000 + turn", AS_QUAL) + ", " + HAPS.replace(TALK + ", ", "").replace("FROM talk", "FROM lowtalk")
VIEWS2 = f"""v AS MATERIALIZED (SELECT 2 * read_id AS id, seq FROM haps UNION ALL SELECT 2 * read_id + 1, {rc('seq')} FROM haps)"""
STARTS = TALK + f""", w AS (SELECT cid * 1000000 + i AS cid, i, substr(s, 1 + 300 * i, 330) || translate(substr(s, 331 + 300 * i, 1), 'ACGT', 'CGTA') || substr(s, 332 + 300 * i, 29) AS x
        FROM (SELECT cid, s, CAST(unnest(range(0, (length(s) - 360) // 300 + 1)) AS INTEGER) AS i FROM talk WHERE length(s) >= 360)),
    v AS MATERIALIZED (SELECT 2 * cid AS id, CASE WHEN i % 2 = 1 THEN {rc('x')} ELSE x END AS seq FROM w UNION ALL SELECT 2 * cid + 1, CASE WHEN i % 2 = 1 THEN x ELSE {rc('x')} END FROM w)"""


def suffix_prefix(k: int, steps: int, least: int, most: str, more: str) -> str:
    """SQL of inexact overlaps of the views v (id, seq)."""
    return f"""seeds AS (SELECT id AS src, length(seq) AS n, b, substr(seq, length(seq) - b - {k - 1}, {k}) AS kmer FROM (SELECT *, unnest(range(0, {steps * k}, {k})) AS b FROM v) WHERE length(seq) >= b + {k}),
    km AS (SELECT id AS dst, length(seq) AS m, p, substr(seq, CAST(p + 1 AS INTEGER), {k}) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {k - 1})) AS p FROM v)),
    pr AS (SELECT DISTINCT src, dst, p + {k} + b AS overlap FROM seeds JOIN km USING (kmer) WHERE p + {k} + b <= n AND p + {k} + b <= m AND p + {k} + b >= {least} {more}),
    ov AS (SELECT src, dst, CAST(overlap AS INTEGER) AS overlap, CAST(hamming(substr(a.seq, CAST(length(a.seq) - overlap + 1 AS INTEGER), CAST(overlap AS INTEGER)), substr(b.seq, 1, CAST(overlap AS INTEGER))) AS INTEGER) AS mm FROM pr JOIN v a ON a.id = src JOIN v b ON b.id = dst)
    SELECT src, dst, overlap, mm FROM ov WHERE mm <= {most}"""


def swapped(x: str, i: int) -> str:
    return f"(substr({x}, 1, {i - 1}) || translate(substr({x}, {i}, 1), 'ACGT', 'CGTA') || substr({x}, {i + 1}))"


NESTED = TALK + f""", parts AS (SELECT cid, s, {swapped(swapped('substr(s, 11, 150)', 20), 90)} AS b FROM talk WHERE length(s) >= 200),
    nested AS MATERIALIZED (SELECT cid * 3 AS cid, s FROM parts UNION ALL SELECT cid * 3 + 1, CASE WHEN cid % 2 = 0 THEN {rc('b')} ELSE b END FROM parts UNION ALL SELECT cid * 3 + 2, substr(b, 41, 80) FROM parts),
    v AS MATERIALIZED (SELECT cid, 0 AS view, s AS seq, length(s) AS n FROM nested UNION ALL SELECT cid, 1, {rc('s')}, length(s) FROM nested),
    seeds AS (SELECT cid, view, n, off, substr(seq, CAST(off + 1 AS INTEGER), 11) AS kmer FROM (SELECT DISTINCT cid, view, n, seq, (n - 11) * i // 8 AS off FROM v, range(0, 9) AS t(i))),
    km AS (SELECT cid AS to_cid, length(s) AS m, p AS spot, substr(s, CAST(p + 1 AS INTEGER), 11) AS kmer FROM (SELECT *, unnest(range(0, length(s) - 10)) AS p FROM nested)),
    pl AS (SELECT DISTINCT cid, view, to_cid, spot - off AS pos, n FROM seeds JOIN km USING (kmer) WHERE cid <> to_cid AND (m > n OR (m = n AND to_cid < cid)) AND spot >= off AND spot - off + n <= m),
    fit AS (SELECT pl.*, hamming(v.seq, substr(t.s, CAST(pos + 1 AS INTEGER), CAST(pl.n AS INTEGER))) AS mm FROM pl JOIN v USING (cid, view) JOIN nested t ON t.cid = to_cid),
    hosts AS MATERIALIZED (SELECT cid, to_cid, pos, view = 1 AS rc, CAST(n AS INTEGER) AS len, CAST(mm AS INTEGER) AS mm FROM fit WHERE mm <= floor(n * 0.06) QUALIFY row_number() OVER (PARTITION BY cid ORDER BY mm, to_cid, pos, view) = 1)"""

SQL = {
    "fastq_written": f"WITH {TEXT_READS} SELECT name, seq, qual FROM reads",
    "repeat_replay": f"WITH {TALK} SELECT cid, s FROM talk WHERE s <> ''",
    "chain_delta": f"WITH {UNIQUE} SELECT uid AS id, seq FROM uniq",
    "tree_delta": f"WITH {UNIQUE} SELECT uid AS id, seq FROM uniq",
    "interval_subtract": f"""WITH {TALK_READS}, bare AS (SELECT read_id, cid, p, row_number() OVER (PARTITION BY read_id ORDER BY p) AS r FROM (SELECT read_id, cid, unnest(range(50 * i, 50 * i + 100)) AS p FROM reads) WHERE cid % 5 = 0 OR p % 97 >= 30)
        SELECT read_id, cid, min(p) AS start, max(p) + 1 AS "end" FROM bare GROUP BY read_id, cid, p - r""",
    "anchor_overlaps": f"WITH {GRADED}, {VIEWS2}, {suffix_prefix(24, 1, 0, '4', 'AND src <> dst')}",
    "merge_overlaps": f"WITH {STARTS}, {suffix_prefix(11, 7, 16, 'floor(overlap * 0.06)', 'AND src // 2 <> dst // 2 AND p + 11 + b < n AND p + 11 + b < m')}",
    "contained_inexact": f"WITH {NESTED} SELECT * FROM hosts",
    "contained_resolved": f"""WITH RECURSIVE {NESTED}, up AS (
        SELECT cid, to_cid, pos, rc, len FROM hosts
        UNION ALL SELECT u.cid, h.to_cid, CASE WHEN h.rc THEN h.pos + h.len - u.pos - u.len ELSE h.pos + u.pos END, u.rc <> h.rc, u.len FROM up u JOIN hosts h ON h.cid = u.to_cid)
        SELECT cid, to_cid, CAST(pos AS BIGINT) AS pos, rc, len FROM up WHERE to_cid NOT IN (SELECT cid FROM hosts)""",
    "reads_derive": f"WITH {TEXT_READS} SELECT read_id, cid, i, name, seq, qual FROM reads",
    "revcomp": f"WITH {TALK_READS} SELECT read_id, {rc('seq')} AS rc FROM reads",
    "kmer_count": f"WITH {TEXT_READS} SELECT kmer, n FROM {count_sql('reads', 'seq', 8)}",
    "kmer_spectrum": f"WITH {TEXT_READS} SELECT least(n, 1000) AS mult, count(*) AS kmers FROM {count_sql('reads', 'seq', 31)} GROUP BY 1",
    "kmer_stats": f"WITH {TEXT_READS}, kc AS MATERIALIZED {count_sql('reads', 'seq', 31)}, st AS (SELECT count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS total, sum(n) / count(*) AS m FROM kc), th AS (SELECT *, greatest(2, CAST(floor(sqrt(m)) AS BIGINT)) AS threshold FROM st) SELECT n_distinct, total, round(m, 6) AS mean_cov, threshold, (SELECT count(*) FROM kc, th WHERE n >= threshold) AS n_solid, n_distinct - (SELECT count(*) FROM kc, th WHERE n >= threshold) AS n_error FROM th",
    "kmer_solid": f"WITH {TEXT_READS} SELECT kmer, n FROM {count_sql('reads', 'seq', 31)} WHERE n >= 20",
    "haploid_depth": f"WITH {HAPS}, {DEPTH_H} SELECT h FROM depth_h",
    "quality_bins": f"WITH {TEXT_READS} SELECT read_id, {BIN(2)} AS bin2, {BIN(4)} AS bin4, {BIN(8)} AS bin8 FROM reads",
    "hq_tail": f"WITH {TEXT_READS} SELECT read_id, NOT regexp_matches(seq, '[Nn]') AND NOT regexp_matches(right(qual, 12), '[!\"#]') AS hq FROM reads",
    "hq_expected_errors": f"WITH {TEXT_READS} SELECT read_id, ee, ee <= 1 AS hq FROM (SELECT read_id, round(list_sum(list_transform(range(1, length(qual) + 1), lambda x: pow(10.0, -(ascii(qual[x]) - 33) / 10.0))), 6) AS ee FROM (SELECT read_id, CASE WHEN read_id % 2 = 0 THEN translate(qual, {q(AS_QUAL)}, {q(AS_HIGH_QUAL)}) ELSE qual END AS qual FROM reads))",
    "dedup_exact": f"WITH {TEXT_READS} SELECT seq, min(read_id) AS rep, count(*) AS n FROM reads GROUP BY seq",
    "duplicates_fan_out": f"WITH {TEXT_READS}, u AS (SELECT seq, min(read_id) AS uid FROM reads GROUP BY seq HAVING count(*) > 1) SELECT uid, read_id FROM reads JOIN u USING (seq)",
    "amplicon_clusters": f"WITH {TEXT_READS} SELECT min(read_id) AS cluster, count(*) AS n, least(" + ", ".join(f"least(substr(seq, {o + 1}, 24), {rc(f'substr(seq, {o + 1}, 24)')})" for o in (0, 25, 50, 76)) + ") AS order_key FROM reads GROUP BY seq",
    "stride_sample": f"WITH {TEXT_READS}, o AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS place, count(*) OVER () AS n FROM reads) SELECT read_id, place FROM o WHERE place % greatest(n // 1000, 1) = 0 AND (place // greatest(n // 1000, 1) < 1000 OR n <= 1000)",
    "stratified_sample": f"WITH {TEXT_READS}, o AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS place, count(*) OVER () AS n FROM reads) SELECT read_id, CAST(x AS INTEGER) AS stratum FROM o, range(0, 3) s(x) WHERE place >= n * x // 3 AND place < n * x // 3 + 333 + CASE WHEN x < 1 THEN 1 ELSE 0 END",
    "regime_proxy": f"WITH {TEXTS}, r AS (SELECT cid, round(count(DISTINCT kmer) / count(*), 6) AS score FROM {kmers_of('texts', 's', 16, 'cid,')} GROUP BY cid) SELECT cid, score, CASE WHEN score < 0.05 THEN 'AMPLICON' WHEN score < 0.15 THEN 'TARGETED' WHEN score < 0.35 THEN 'WGS' ELSE 'METAGENOMIC' END AS regime FROM r",
    "minimizers": f"WITH {TALK_MIN} SELECT read_id, value, pos, rc FROM rm",
    "block_minimizers": f"WITH {TALK_READS} SELECT read_id, CAST(pos // 10 AS BIGINT) AS block, min(struct_pack(k := kmer, p := pos)).k AS kmer, min(struct_pack(k := kmer, p := pos)).p AS pos FROM {kmers_of('reads', 'seq', 15, 'read_id,')} GROUP BY read_id, pos // 10",
    "minimizer_hits": f"WITH {TALK_MIN}, {minimizers_of('cm', 'talk', 's', 'cid')} SELECT read_id, count(*) AS n_seeds, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_hits FROM rm LEFT JOIN (SELECT value, count(*) AS n FROM cm GROUP BY value) USING (value) GROUP BY read_id",
    "map_reads": f"""WITH {TALK_READS}, turned AS MATERIALIZED (SELECT read_id, CASE WHEN read_id % 3 = 0 THEN {rc('seq')} ELSE seq END AS seq FROM reads),
        strands AS MATERIALIZED (SELECT read_id * 2 AS vid, seq FROM turned UNION ALL SELECT read_id * 2 + 1, {rc('seq')} FROM turned), uniqt AS MATERIALIZED (SELECT min(cid) AS cid, s FROM talk GROUP BY s),
        {minimizers_of('rm', 'strands', 'seq', 'vid')}, {minimizers_of('cm', 'uniqt', 's', 'cid')},
        chains AS (SELECT vid, cid, c.pos - r.pos AS start, count(*) AS seeds FROM rm r JOIN cm c USING (value, rc) WHERE c.pos - r.pos >= 0 GROUP BY vid, cid, c.pos - r.pos),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY seeds DESC, cid, start) AS rank FROM chains) WHERE rank <= 10),
        fit AS (SELECT b.*, CASE WHEN length(substr(t.s, start + 1, 100)) = 100 THEN hamming(r.seq, substr(t.s, start + 1, 100)) END AS mm FROM best b JOIN strands r USING (vid) JOIN talk t ON t.cid = b.cid)
        SELECT vid // 2 AS read_id, cid, start, vid % 2 = 1 AS rc, seeds, CAST(mm AS INTEGER) AS mm FROM (SELECT *, row_number() OVER (PARTITION BY vid // 2 ORDER BY vid % 2, rank) AS n FROM fit WHERE mm <= 10) WHERE n = 1""",
    "mate_search": f"""WITH {TALK_READS}, p AS (SELECT r.read_id, r.cid, r.i * 50 AS pos, m.seq AS mseq FROM reads r JOIN reads m ON m.read_id = r.read_id + 2 AND m.cid = r.cid),
        c AS (SELECT read_id, CAST(pos + 100 + d AS INTEGER) AS place, hamming(mseq, substr(t.s, pos + 100 + d + 1, 100)) AS mm FROM (SELECT *, unnest(range(-30, 31, 5)) AS d FROM p) p JOIN talk t USING (cid) WHERE pos + 100 + d >= 0 AND pos + 200 + d <= length(t.s))
        SELECT read_id, first(place ORDER BY mm, place) AS mate_pos, CAST(min(mm) AS INTEGER) AS mm FROM c GROUP BY read_id""",
    "apsp_overlaps": f"WITH {OVERLAPS} SELECT * FROM over",
    "hq_overlap": f"WITH {OVERLAPS} SELECT uid, l AS best_left, r AS best_right, least(l, r) >= floor(0.65 * n) AS hq65, least(l, r) >= floor(0.45 * n) AS hq45, least(l, r) >= floor(0.15 * n) AS hq15 FROM (SELECT uid, any_value(length(seq)) AS n, coalesce(max(overlap) FILTER (to_view = 0), 0) AS l, coalesce(max(overlap) FILTER (to_view = 1), 0) AS r FROM uniq LEFT JOIN over ON to_id = uid GROUP BY uid)",
    "fallback_place": f"""WITH {HAPS}, v AS (SELECT read_id, 0 AS view, seq FROM haps UNION ALL SELECT read_id, 1, {rc('seq')} FROM haps), seeds AS (SELECT *, substr(seq, off + 1, 24) AS kmer FROM (SELECT *, unnest([0, 38, 76]) AS off FROM v)),
        idx AS (SELECT cid, pos, kmer FROM {kmers_of('talk', 's', 24, 'cid,', False)}),
        cand AS (SELECT DISTINCT read_id, view, seq, x.cid, x.pos - off AS pos FROM seeds JOIN idx x USING (kmer) WHERE x.pos - off >= 0),
        fit AS (SELECT read_id, cid, pos, view, hamming(seq, substr(t.s, pos + 1, 100)) AS mm FROM cand JOIN talk t USING (cid) WHERE pos + 100 <= length(t.s))
        SELECT read_id, b.cid AS cid, CAST(b.pos AS INTEGER) AS pos, b.view = 1 AS rc, CAST(b.mm AS INTEGER) AS mm FROM (SELECT read_id, min(struct_pack(mm := mm, cid := cid, pos := pos, view := view)) AS b FROM fit WHERE mm <= 12 GROUP BY read_id)""",
    "knn_kmer": f"""WITH {UNIQUE}, bm AS (SELECT uid, min(struct_pack(k := kmer, p := pos)).k AS kmer, min(struct_pack(k := kmer, p := pos)).p AS pos FROM {kmers_of('uniq', 'seq', 15, 'uid,')} GROUP BY uid, pos // 10), few AS (SELECT kmer FROM bm GROUP BY kmer HAVING count(*) <= 500),
        pairs AS (SELECT DISTINCT u, v, base + x AS shift FROM (SELECT DISTINCT a.uid AS u, b.uid AS v, a.pos - b.pos AS base FROM bm a JOIN few USING (kmer) JOIN bm b USING (kmer) WHERE a.uid < b.uid), range(-2, 3) r(x)),
        cut AS (SELECT u, v, substr(a.seq, greatest(shift, 0) + 1, 100 - abs(shift)) AS x, substr(b.seq, greatest(-shift, 0) + 1, 100 - abs(shift)) AS y, 100 - abs(shift) AS n FROM pairs JOIN uniq a ON a.uid = u JOIN uniq b ON b.uid = v WHERE (100 - abs(shift)) * 4 >= 100),
        best AS (SELECT u, v, min(round(hamming(x, y) / n, 6)) AS dist FROM cut WHERE hamming(x, y) <= 8 GROUP BY u, v), twoway AS (SELECT u, v, dist FROM best UNION ALL SELECT v, u, dist FROM best)
        SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v, dist FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY dist, v) AS r FROM twoway) WHERE r <= 20""",
    "knn_lsh": f"WITH {LSH} SELECT u, v, dist FROM near",
    "contained_contigs": f"""WITH {TALK}, c AS (SELECT cid, s FROM talk WHERE length(s) >= 80), cs AS (SELECT cid, s FROM c UNION ALL SELECT cid + 50000, CASE WHEN cid % 2 = 0 THEN {rc('substr(s, 11, 60)')} ELSE substr(s, 11, 60) END FROM c),
        v AS (SELECT cid, 0 AS view, s FROM cs UNION ALL SELECT cid, 1, {rc('s')} FROM cs), idx AS (SELECT cid, pos, kmer FROM {kmers_of('cs', 's', 31, 'cid,', False)}),
        hit AS (SELECT v.cid, i.cid AS in_cid, i.pos, v.view FROM v JOIN idx i ON i.kmer = substr(v.s, 1, 31) JOIN cs t ON t.cid = i.cid WHERE v.cid <> i.cid AND (length(t.s) > length(v.s) OR (length(t.s) = length(v.s) AND t.cid < v.cid)) AND substr(t.s, i.pos + 1, length(v.s)) = v.s)
        SELECT cid, b.in_cid AS in_cid, b.pos AS pos, b.view = 1 AS rc FROM (SELECT cid, min(struct_pack(in_cid := in_cid, pos := pos, view := view)) AS b FROM hit GROUP BY cid)""",
    "pair_interleave": f"WITH {TALK_READS} SELECT read_id * 2 AS read_id, 0 AS mate, seq FROM reads UNION ALL SELECT read_id * 2 + 1, 1, {rc('seq')} FROM reads",
    "pe_detect": f"""WITH {TEXT_READS}, o AS (SELECT regexp_replace(regexp_replace(name, '^RUN[0-9]+:([0-9]+):([0-9]+):.*(/[12])$', 'R\\1\\3'), '/[12]$', '') AS b, row_number() OVER (ORDER BY read_id) - 1 AS place FROM reads), p AS (SELECT place // 2 AS p, min(b) AS a, max(b) AS z, count(*) AS n FROM o WHERE place < 400 GROUP BY 1 HAVING count(*) = 2)
        SELECT count(*) AS total, count(*) FILTER (a = z) AS matches, count(*) > 0 AND count(*) FILTER (a = z) >= count(*) * 9 // 10 AS paired FROM p""",
    "insert_stats": f"WITH {TALK_READS}, p AS (SELECT 150 + (read_id * 7) % 61 AS d FROM reads ORDER BY read_id LIMIT 1000) SELECT count(*) AS n, CAST(round(avg(d)) AS BIGINT) AS mean, CAST(ceil(round(stddev_pop(d), 9)) AS BIGINT) AS spread FROM p",
    "pileup_counts": f"WITH {COUNTS} SELECT cid, pos, a, c, g, t, depth FROM counts",
    "pileup_read_mm": f"WITH {FRAMED} SELECT read_id, cid, pos, rc, CAST(mm AS INTEGER) AS mm FROM framed",
    "snv_candidates": f"WITH {CANDIDATES} SELECT cid, pos, a, c, g, t, depth, major, minor, n_minor, minor_q, lr FROM cand",
    "flank_votes": f"WITH {FLANKS} SELECT cid, pos, diffs, n_minor_flank, minor_mode FROM voted",
    "snv_calls": f"WITH {sites(2)} SELECT cid, pos + 1 AS pos, substr(s, pos + 1, 1) AS ref, CASE WHEN major <> substr(s, pos + 1, 1) THEN major ELSE minor END AS alt, round(n_minor / depth, 3) AS af, depth AS dp FROM kept JOIN talk USING (cid)",
    "polyploid_calls": f"""WITH {sites(3)}, best AS (SELECT k.cid, k.pos, k.depth, k.n_minor, a.base, a.n, a.r FROM kept k JOIN alleles a USING (cid, pos) WHERE a.r <= 3 AND a.n >= 0.2 * k.depth)
        SELECT cid, pos + 1 AS pos, substr(any_value(s), pos + 1, 1) AS ref, string_agg(base, ',' ORDER BY r) AS alt, round(any_value(n_minor) / any_value(depth), 3) AS af, any_value(depth) AS dp FROM best JOIN talk USING (cid) WHERE base <> substr(s, pos + 1, 1) GROUP BY cid, pos""",
    "three_hypotheses": f"""WITH {COUNTS}, l AS (SELECT cid, pos, any_value(depth) AS depth, {ll(['b1'])} AS l1, {ll(['b1', 'b2'])} AS l2, {ll(['b2'])} AS l3 FROM piles JOIN ranked USING (cid, pos) JOIN counts USING (cid, pos) WHERE depth >= 6 AND n2 >= 1 GROUP BY cid, pos)
        SELECT cid, pos, depth, round((greatest(l1, l2, l3) - l1) * 10 / ln(10), 4) AS qual, CASE WHEN l2 >= l3 THEN 'het' ELSE 'hom' END AS genotype FROM l WHERE greatest(l1, l2, l3) <> l1""",
    "consensus": f"WITH {COUNTS}, every AS (SELECT cid, CAST(unnest(range(0, length(s))) AS INTEGER) AS pos, s FROM talk WHERE length(s) > 0) SELECT e.cid, string_agg(coalesce(b1, substr(e.s, e.pos + 1, 1)), '' ORDER BY e.pos) AS s FROM every e LEFT JOIN ranked r ON r.cid = e.cid AND r.pos = e.pos GROUP BY e.cid",
    "anchor_pairs": f"WITH {ANCHORS} SELECT kmer, ref_cid, ref_pos, alt_cid, CAST(alt_pos AS INTEGER) AS alt_pos, opposite FROM anchors",
    "bubbles": f"WITH {BUBBLES} SELECT * FROM bubbles",
    "vcf_strata": f"WITH {BUBBLES} SELECT kind, CASE WHEN len = 1 THEN '1' WHEN len <= 5 THEN '2-5' ELSE '6+' END AS size, count(*) AS n FROM bubbles WHERE kind IN ('ins', 'del') GROUP BY ALL",
    "cross_contig_snvs": f"""WITH {TWIN_COVER}, x AS (SELECT b.cid, b.apos + 1 AS pos, substr(t.s, b.apos + 1, 1) AS ref, ins AS alt, coalesce(r.cov, 0) AS refd, coalesce(m.median, 0) AS altd, anchors FROM bubbles b JOIN twins t USING (cid) LEFT JOIN smooth r ON r.cid = b.cid AND r.pos = b.apos LEFT JOIN medians m ON m.cid = b.alt_cid WHERE kind = 'snv' AND anchors >= 15),
        y AS (SELECT *, CAST(refd + altd AS BIGINT) AS dp, round(altd / greatest(1, refd + altd), 3) AS af FROM x) SELECT cid, pos, ref, alt, af, dp, anchors FROM y WHERE af >= 0.25 AND af <= 0.75 AND dp <= 54
        AND (cid, pos) NOT IN (SELECT (cid, pos) FROM (WITH {sites(2)} SELECT cid, pos + 1 AS pos FROM kept))""",
    "coverage_depth": f"WITH {COVER} SELECT cid, pos, CAST(cov AS BIGINT) AS cov FROM cov",
    "coverage_window": f"WITH {COVER}, {SMOOTH} SELECT * FROM smooth",
    "coverage_bins": f"WITH {TEXT_READS} SELECT cid, CAST(i * 50 // 1000 AS BIGINT) AS bin, CAST(count(*) * 100 AS BIGINT) AS bases FROM reads GROUP BY ALL",
    "coverage_medians": f"WITH {COVER}, {MEDIANS} SELECT cid, CAST(median AS BIGINT) AS median FROM medians",
    "coverage_islands": f"WITH {COVER} SELECT cid, min(pos) AS start, count(*) AS len FROM (SELECT cid, pos, pos - row_number() OVER (PARTITION BY cid ORDER BY pos) AS g FROM cov WHERE cov > 0) GROUP BY cid, g",
    "coverage_n50": f"""WITH {COVER}, isl AS (SELECT count(*) AS len FROM (SELECT cid, pos, pos - row_number() OVER (PARTITION BY cid ORDER BY pos) AS g FROM cov WHERE cov > 0) GROUP BY cid, g), r AS (SELECT len, sum(len) OVER (ORDER BY len DESC) AS run FROM isl), t AS (SELECT count(*) AS n, max(len) AS longest, CAST(sum(len) AS BIGINT) AS total FROM isl)
        SELECT n, longest, total, (SELECT max(len) FROM r, t WHERE run >= total // 2) AS n50 FROM t""",
    "coverage_pctl": f"WITH {COVER}, o AS (SELECT cov, row_number() OVER (ORDER BY cov) - 1 AS place, count(*) OVER () AS n FROM cov) SELECT CAST(p AS INTEGER) AS p, CAST(cov AS BIGINT) AS value FROM o, (VALUES (10), (25), (50), (75), (90)) v(p) WHERE place = p * (n - 1) // 100",
    "coverage_moments": f"WITH {COVER} SELECT round(avg(cov), 6) AS mean, round(stddev_pop(cov), 6) AS std, round(stddev_pop(cov) / nullif(avg(cov), 0), 6) AS cv, round(avg(CASE WHEN cov = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS zero_share FROM cov",
    "kmer_freq3": freq(3),
    "kmer_freq4": freq(4),
    "minhash": f"WITH {SKETCH} SELECT cid, rank, h FROM sketch",
    "sketch_similarity": f"""WITH {SKETCH}, s AS (SELECT DISTINCT cid, h FROM sketch), l AS (SELECT cid, list(h ORDER BY h) AS l FROM s GROUP BY cid), p AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM s a JOIN s b USING (h) WHERE a.cid < b.cid),
        x AS (SELECT p.a, p.b, list_sort(list_distinct(list_concat(la.l, lb.l)))[1:50] AS u, list_intersect(la.l, lb.l) AS i FROM p JOIN l la ON la.cid = p.a JOIN l lb ON lb.cid = p.b)
        SELECT a, b, CAST(len(list_intersect(u, i)) AS INTEGER) AS shared, CAST(len(u) AS INTEGER) AS union_n, round(len(list_intersect(u, i)) / len(u), 6) AS jaccard FROM x""",
    "mm_pos_hist": f"""WITH {FRAMED}, o AS (SELECT CASE WHEN rc THEN 99 - j ELSE j END AS off FROM (SELECT f.rc, f.b, t.s, f.pos, unnest(range(0, 100)) AS j FROM framed f JOIN talk t USING (cid)) WHERE substr(b, j + 1, 1) <> substr(s, pos + j + 1, 1)), g AS (SELECT CAST(least(off // 10, 9) AS INTEGER) AS bin, count(*) AS n FROM o GROUP BY 1)
        SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(n / (SELECT sum(n) FROM g), 0), 6) AS share FROM range(0, 10) r(b) LEFT JOIN g ON g.bin = b""",
    "read_moments": f"WITH {HAPS} SELECT count(*) AS n, round(avg(length(seq)), 6) AS mean_len, round(stddev_pop(length(seq)), 6) AS std_len, round(avg(CASE WHEN rc THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rc_share FROM haps",
    "gc": f"WITH {TEXTS} SELECT round(sum(length(regexp_replace(s, '[^GC]', '', 'g'))) / sum(length(s)), 6) AS gc FROM texts",
    "position_delta": f"""WITH {TEXT_READS}, d AS (SELECT read_id, CAST(i * 50 - coalesce(lag(i * 50) OVER (ORDER BY read_id), 0) AS BIGINT) AS delta FROM reads), z AS (SELECT *, CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS zigzag FROM d)
        SELECT read_id, delta, zigzag, CAST(greatest(ceil(length(bin(zigzag)) / 7.0), 1) AS INTEGER) AS bytes FROM z""",
    "contig_jump": f"WITH {TEXT_READS}, d AS (SELECT i * 50 - coalesce(lag(i * 50) OVER (ORDER BY read_id), 0) AS delta FROM reads) SELECT count(*) AS n, count(*) FILTER (delta < 0 OR delta > 300) AS jumps, round(count(*) FILTER (delta < 0 OR delta > 300) / count(*), 6) AS rate FROM d",
    "contig_offsets": f"WITH {TALK} SELECT cid, CAST(length(s) AS INTEGER) AS len, CAST(coalesce(sum(length(s)) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base_off FROM talk",
    "asof_contig": f"WITH {TALK}, o AS (SELECT cid, length(s) AS len, coalesce(sum(length(s)) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_off FROM talk), p AS (SELECT unnest(range(0, (SELECT CAST(sum(len) AS BIGINT) FROM o), 37)) AS pos) SELECT pos, cid FROM p ASOF JOIN (SELECT cid, CAST(base_off AS BIGINT) AS base_off FROM o WHERE len > 0) s ON p.pos >= s.base_off",
    "interval_query": f"WITH {TALK_READS} SELECT read_id, r.cid, CAST(i * 50 AS BIGINT) AS start, CAST(i * 50 + 100 AS BIGINT) AS \"end\" FROM reads r JOIN talk t ON t.cid = r.cid WHERE length(t.s) >= 150 AND i * 50 < 150 AND i * 50 + 100 > 120",
    "name_tokens": f"WITH {TALK_READS} SELECT read_id, CAST(col AS INTEGER) AS col, {NUM} AS is_num, val FROM {TOKENS}",
    "name_fields": f"""WITH {TALK_READS}, f AS (SELECT read_id, unnest(range(0, len(t))) AS k, unnest(t) AS f FROM (SELECT read_id, regexp_extract_all(name, '[._:=/ -]+|[^._:=/ -]+') AS t FROM reads)), s AS (SELECT read_id, k, CASE WHEN len(regexp_extract_all(f, '[0-9]+|[^0-9]+')) <= 2 THEN regexp_extract_all(f, '[0-9]+|[^0-9]+') ELSE [f] END AS x FROM f),
        u AS (SELECT read_id, k, unnest(range(0, len(x))) AS j, unnest(x) AS val FROM s) SELECT read_id, CAST(row_number() OVER (PARTITION BY read_id ORDER BY k, j) - 1 AS INTEGER) AS col, {NUM} AS is_num, val FROM u""",
    "name_profile": f"""WITH {TEXT_READS}, c AS (SELECT read_id, CAST(col AS INTEGER) AS col, {NUM} AS is_num, val, CASE WHEN {NUM} THEN CAST(val AS BIGINT) END AS num FROM {TOKENS}), u AS (SELECT *, coalesce(num > lag(num) OVER (PARTITION BY col ORDER BY read_id), true) AS up FROM c),
        s AS (SELECT col, count(*) AS n, count(DISTINCT val) AS distinct_vals, bool_and(is_num) AS numeric, min(num) AS lo, max(num) AS hi, bool_and(up) AS up FROM u GROUP BY col)
        SELECT col, n, distinct_vals, numeric, distinct_vals = 1 AS constant, numeric AND up AS monotonic, numeric AND coalesce(lo = 1 AND hi = n, false) AND distinct_vals = n AS permutation FROM s""",
    "order_recover": f"WITH {TEXT_READS} SELECT read_id, read_id * 3 + 1 AS val, row_number() OVER (ORDER BY read_id) - 1 AS rank FROM reads",
    "value_dict": f"""WITH {TALK_READS}, c AS (SELECT CAST(col AS INTEGER) AS col, val, {NUM} AS is_num FROM {TOKENS}), ok AS (SELECT col FROM c GROUP BY col HAVING bool_and(is_num)), g AS (SELECT col, CAST(val AS BIGINT) AS val, count(*) AS n FROM c JOIN ok USING (col) GROUP BY ALL)
        SELECT col, val, CAST(row_number() OVER (PARTITION BY col ORDER BY val) - 1 AS INTEGER) AS code, n, CAST(floor(n * 65536 / sum(n) OVER (PARTITION BY col)) AS BIGINT) AS scaled FROM g""",
    "illumina": f"WITH {TEXT_READS}, f AS (SELECT regexp_full_match(name, '(.*):([0-9]+):([0-9]+)(/[0-9]+)?') AS ok FROM reads ORDER BY read_id LIMIT 100) SELECT count(*) AS n, count(*) FILTER (ok) AS matching, count(*) FILTER (ok) * 10 >= count(*) * 9 AS looks_illumina FROM f",
    "illumina_fields": f"WITH {TALK_READS} SELECT read_id, 'RUN' || (cid % 7) || ':' || cid AS prefix, CAST(i AS BIGINT) AS x, CAST(i * 50 AS BIGINT) AS y, CAST(1 + i % 2 AS INTEGER) AS mate FROM reads",
    "quality_contexts": f"""WITH {TEXT_READS}, s AS (SELECT read_id, CAST(unnest(range(0, length(qual))) AS INTEGER) AS pos, qual FROM reads), t AS (SELECT read_id, pos, greatest(ascii(substr(qual, pos + 1, 1)) - 33, 0) AS q, CASE WHEN pos > 0 THEN greatest(ascii(substr(qual, pos, 1)) - 33, 0) ELSE 0 END AS q1 FROM s), g AS (SELECT q1, CAST(pos // 10 AS BIGINT) AS posbin, q, count(*) AS n FROM t GROUP BY ALL)
        SELECT CAST(q1 AS INTEGER) AS q1, posbin, CAST(q AS INTEGER) AS q, n, CAST(floor(n * 16384 / sum(n) OVER (PARTITION BY q1, posbin)) AS BIGINT) AS scaled FROM g""",
    "cond_entropy": f"""WITH {TEXT_READS}, s AS (SELECT read_id, CAST(unnest(range(0, length(qual))) AS INTEGER) AS pos, qual FROM reads), t AS (SELECT ascii(substr(qual, pos + 1, 1)) AS q, CASE WHEN pos > 0 THEN ascii(substr(qual, pos, 1)) ELSE 33 END AS q1 FROM s), c AS (SELECT q1, q, count(*) AS n FROM t GROUP BY ALL), h1 AS (SELECT sum(n) AS n, sum(-n * log2(n / t)) AS b FROM (SELECT n, sum(n) OVER (PARTITION BY q1) AS t FROM c)), h0 AS (SELECT sum(-n * log2(n / t)) AS b FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT q, sum(n) AS n FROM c GROUP BY q)))
        SELECT CAST(h1.n AS BIGINT) AS n, round(h0.b / h1.n, 6) AS order0_bits, round(h1.b / h1.n, 6) AS conditional_bits FROM h0, h1""",
    "quality_states": f"""WITH RECURSIVE {TALK_READS}, w AS (SELECT read_id, qual, 0 AS pos, greatest(ascii(qual) - 33, 0) AS q, 0 AS q1, 0 AS q2, 0 AS top, CAST(0 AS BIGINT) AS vol, 0 AS run FROM reads
        UNION ALL SELECT read_id, qual, pos + 1, greatest(ascii(substr(qual, pos + 2, 1)) - 33, 0), q, q1, greatest(q, top - 1), (3 * vol + 8 * abs(q - q1)) // 4, CASE WHEN pos > 0 AND q = q1 THEN run + 1 ELSE 1 END FROM w WHERE pos + 1 < length(qual))
        SELECT read_id, pos, CAST(q AS INTEGER) AS q, CAST(q1 AS INTEGER) AS q1, CAST(q2 AS INTEGER) AS q2, CAST(top AS INTEGER) AS top, vol, CAST(run AS INTEGER) AS run FROM w""",
    "surprise": f"""WITH {TALK}, p AS (SELECT cid, CAST(pos AS INTEGER) AS pos, substr(s, pos + 1, 1) AS b, CASE WHEN pos >= 4 THEN substr(s, pos - 3, 4) END AS ctx FROM (SELECT cid, s, unnest(range(0, length(s))) AS pos FROM talk)),
        c AS (SELECT cid, pos, ctx, count(*) OVER (PARTITION BY cid, ctx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t, count(*) OVER (PARTITION BY cid, ctx, b ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM p)
        SELECT cid, pos, CAST(CASE WHEN ctx IS NULL THEN 2 WHEN t = 0 THEN 3 WHEN (n + 1) / (t + 4) >= 0.85 THEN 0 WHEN (n + 1) / (t + 4) >= 0.60 THEN 1 WHEN (n + 1) / (t + 4) >= 0.35 THEN 2 ELSE 3 END AS INTEGER) AS bucket FROM c""",
    "dense_alphabet": f"WITH {TEXT_READS}, s AS (SELECT DISTINCT ascii(unnest(string_split(qual, ''))) - 33 AS q FROM reads) SELECT CAST(q AS INTEGER) AS q, CAST(row_number() OVER (ORDER BY q) - 1 AS INTEGER) AS code, count(*) OVER () AS levels, count(*) OVER () <= 24 AS binned FROM s",
    "mate_contexts": f"""WITH {TALK_READS}, s AS (SELECT read_id, cid * 1000000 + i // 2 AS pair_id, i % 2 + 1 AS mate, pos, ascii(substr(qual, pos + 1, 1)) - 33 AS q FROM (SELECT *, CAST(unnest(range(0, length(qual))) AS INTEGER) AS pos FROM reads))
        SELECT b.read_id, b.pos, CAST(b.q AS INTEGER) AS q, CAST(CASE WHEN a.q < 10 THEN 0 WHEN a.q < 20 THEN 1 WHEN a.q < 30 THEN 2 WHEN a.q IS NOT NULL THEN 3 ELSE 4 END AS INTEGER) AS mate_bin FROM s b LEFT JOIN s a ON a.pair_id = b.pair_id AND a.mate = 1 AND a.pos = b.pos WHERE b.mate = 2""",
    "mismatch_ranks": f"""WITH {FRAMED}, x AS (SELECT read_id, CAST(j AS INTEGER) AS off, substr(b, j + 1, 1) AS b, substr(s, pos + j + 1, 1) AS t FROM (SELECT f.*, t.s, unnest(range(0, 100)) AS j FROM framed f JOIN talk t USING (cid)))
        SELECT read_id, off, CAST(instr('ACGT', b) - 1 - CASE WHEN b > t THEN 1 ELSE 0 END AS INTEGER) AS rank, b AS base FROM x WHERE b <> t""",
    "reconstruct_lossless": f"WITH {HAPS} SELECT read_id, CASE WHEN read_id % 5 = 0 THEN substr(seq, 1, 40) || 'n' || substr(seq, 42) ELSE seq END AS seq, qual FROM haps",
    "components": f"""WITH RECURSIVE {LSH}, e AS (SELECT u, v FROM near WHERE dist <= 1.2 UNION ALL SELECT v, u FROM near WHERE dist <= 1.2), r AS (SELECT DISTINCT u AS id, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id) SELECT id, min(c) AS component FROM r GROUP BY id""",
    "dbg_edges": f"WITH {DBG} SELECT src, dst, base, is_rc, n FROM edges",
    "dbg_degrees": f"WITH {DBG} SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, sum(o) > sum(i) AS is_start, sum(o) <> sum(i) AS unbalanced FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node",
    "sam_rows": f"WITH {FRAMED} SELECT 'r' || read_id AS qname, CASE WHEN rc THEN 16 ELSE 0 END AS flag, 'contig_' || cid AS rname, CAST(pos + 1 AS BIGINT) AS pos, CAST(greatest(0, 60 - 6 * mm) AS INTEGER) AS mapq, length(b) || 'M' AS cigar, b AS seq, q AS qual FROM framed",
    "vcf_lift": f"""WITH {TALK}, c AS (SELECT cid, substr(s, 5, 1) AS ref FROM talk WHERE length(s) >= 150), v AS (SELECT cid, unnest([10, 60, 149]) AS pos, ref, 'T' AS alt FROM c), b AS (SELECT cid, unnest([0, 55]) AS start, unnest([50, 150]) AS stop FROM c)
        SELECT cid, CAST(pos AS INTEGER) AS pos, 'chr' || (cid % 5) AS chrom, CASE WHEN cid % 2 = 1 THEN cid * 10 + start + stop - 1 - (pos - 1) ELSE cid * 10 + pos - 1 END + 1 AS g_pos, CASE WHEN cid % 2 = 1 THEN {rc('ref')} ELSE ref END AS ref, CASE WHEN cid % 2 = 1 THEN 'A' ELSE alt END AS alt FROM v JOIN b USING (cid) WHERE pos - 1 >= start AND pos - 1 < stop""",
    "precision_recall": f"""WITH {CANDIDATES}, t AS (SELECT cid, p + 1 AS pos FROM (SELECT cid, unnest(range(0, length(s))) AS p FROM talk WHERE length(s) >= 100) WHERE p % 97 = 48), x AS (SELECT t.cid AS a, c.cid AS b FROM t FULL JOIN (SELECT cid, pos + 1 AS pos FROM cand) c ON c.cid = t.cid AND c.pos = t.pos),
        n AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS fn FROM x), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n)
        SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""",
    "select_k": f"WITH {TEXTS} SELECT cid, CAST(length(s) AS INTEGER) AS len, CAST(CASE WHEN length(s) <= 50 THEN 15 WHEN length(s) >= 250 THEN 25 ELSE 21 END AS INTEGER) AS k FROM texts",
    "read_order": f"WITH {TEXT_READS}, w AS MATERIALIZED (SELECT read_id, kmer FROM {kmers_of('reads', 'seq', 12, 'read_id,')}), c AS (SELECT kmer, count(*) AS n FROM w GROUP BY kmer) SELECT read_id, median(n) AS confidence FROM w JOIN c USING (kmer) GROUP BY read_id",
    "hash_functions": f"WITH {UNIQUE}, c AS (SELECT uid, seq, {packed_sql('substr(seq, 1, 31)')} AS code, {FNV} AS f, {CRC} AS crc FROM uniq), h AS (SELECT uid, f, crc, {mixed('code', FMIX_STEPS, 33)} AS m, {mixed('code', SPLIT_STEPS, 31)} AS p FROM c) SELECT uid, {signed('f')} AS fnv, {signed('m')} AS fmix, {signed('p')} AS splitmix, crc FROM h",
    "sampled_kmers": f"WITH {TALK_READS} SELECT kmer, n FROM (SELECT kmer, n, {mixed(packed_sql('kmer'), FMIX_STEPS, 33)} AS h FROM {count_sql('reads', 'seq', 15)}) WHERE h & 15 = 0",
    "hashed_minimizers": f"""WITH {TALK_READS}, h AS (SELECT read_id, pos, {mixed(packed_sql('kmer'), FMIX_STEPS, 33)} AS h FROM {kmers_of('reads', 'seq', 15, 'read_id,', False)}), windowed AS (SELECT read_id, pos, min(struct_pack(h := h, pos := pos)) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM h)
        SELECT DISTINCT read_id, m.pos AS pos, {signed('m.h')} AS hash FROM windowed WHERE pos >= 9""",
    "shift_neighbours": f"WITH {LSH}, p AS (SELECT u, v, round(least({', '.join(shift_cost(n) for n in range(-3, 4))}) / 100, 6) AS dist FROM (SELECT u, v, x.seq AS a, y.seq AS b FROM near JOIN uniq x ON x.uid = u JOIN uniq y ON y.uid = v)) SELECT u, v, dist FROM (SELECT u, v, dist FROM p UNION ALL SELECT v, u, dist FROM p) QUALIFY row_number() OVER (PARTITION BY u ORDER BY dist, v) <= 4",
    "name_sequences": f"WITH {TEXT_READS}, g AS (SELECT cid, count(*) = 1 OR cid % 3 <> 0 AS ok FROM reads GROUP BY cid) SELECT cid, CASE WHEN ok THEN 'SRR.x' || cid END AS prefix, CASE WHEN ok THEN 5::BIGINT END AS first, ok AS sequential FROM g",
    "mean_record": f"WITH {TEXT_READS} SELECT count(*) AS n, round(avg(length(name) + 2 * length(seq) + 7), 6) AS mean_bytes FROM (SELECT * FROM reads ORDER BY read_id LIMIT 1000)",
    "depth_recall": f"WITH {CANDIDATES}, {PLANTED} SELECT coalesce(k.depth, 1) >= 6 AS deep, count(*) AS n, count(c.cid) AS n_called FROM planted p LEFT JOIN counts k USING (cid, pos) LEFT JOIN cand c ON c.cid = p.cid AND c.pos = p.pos GROUP BY 1",
    "error_sets": f"WITH {CANDIDATES}, {PLANTED} SELECT cid, CAST(pos AS INTEGER) AS pos, CASE WHEN c.major IS NULL THEN 'missed' WHEN p.k IS NULL THEN 'extra' ELSE 'both' END AS kind FROM (SELECT *, 1 AS k FROM planted) p FULL JOIN cand c USING (cid, pos)",
    "contig_ranks": f"WITH {TEXTS} SELECT cid, CAST(length(s) AS INTEGER) AS len, row_number() OVER (ORDER BY length(s) DESC, cid) - 1 AS rank FROM texts",
    "first_places": f"WITH {TALK_READS} SELECT DISTINCT kmer, read_id FROM {kmers_of('reads', 'seq', 15, 'read_id,')} QUALIFY dense_rank() OVER (PARTITION BY kmer ORDER BY read_id) <= 4",
    "smallest_codec": f"""WITH {TALK_READS}, c AS (SELECT CAST(col AS INTEGER) AS col, val FROM {TOKENS} WHERE {NUM}), z AS (SELECT col, unnest(['text', 'varint', 'fixed']) AS codec, unnest([sum(length(val)), sum(greatest(ceil(length(bin(CAST(val AS BIGINT))) / 7.0), 1)), count(*) * 4]) AS bytes FROM c GROUP BY col)
        SELECT col, codec, CAST(bytes AS BIGINT) AS bytes FROM z QUALIFY row_number() OVER (PARTITION BY col ORDER BY bytes, codec) = 1""",
    "base_contexts": f"WITH {TALK_READS}, p AS (SELECT seq, unnest(range(1, length(seq) + 1)) AS j FROM reads) SELECT CAST((CASE WHEN j = 1 THEN 4 ELSE instr('ACGT', seq[j - 1]) - 1 END * 5 + instr('ACGT', seq[j]) - 1) * 5 + CASE WHEN j = length(seq) THEN 4 ELSE instr('ACGT', seq[j + 1]) - 1 END AS INTEGER) AS ctx, count(*) AS n FROM p GROUP BY 1",
    "stacked_shards": f"WITH {TALK_READS}, o AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS nth FROM reads) SELECT read_id, nth % 3 AS shard, nth // 3 AS place, row_number() OVER (ORDER BY nth % 3, nth // 3) - 1 AS id FROM o",
    "chunk_concat": f"WITH {TALK} SELECT cid, substr(s, 1, length(s) // 50 * 50) AS s FROM talk WHERE length(s) >= 50",
    "mate_ranks": f"WITH {TALK_READS}, p AS (SELECT read_id, cid * 1000000 + i // 2 AS pair_id, i % 2 AS mate FROM reads), f AS (SELECT pair_id, row_number() OVER (ORDER BY read_id DESC) - 1 AS rank FROM p WHERE mate = 0) SELECT read_id, pair_id, rank FROM p JOIN f USING (pair_id) WHERE mate = 1",
}
SQL["top_symbols"] = f"SELECT q1, posbin, q, scaled FROM ({SQL['quality_contexts']}) WHERE scaled > 100"
SQL["sam_written"] = SQL["sam_rows"]
