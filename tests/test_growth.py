"""Orders, trails, greedy joins and growing contigs against plain rules."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import graph, growth, joins, sampling

RC = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(RC)[::-1]


def differ(a, b):
    return sum(x != y for x, y in zip(a, b))


def genome(n, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice("ACGT") for _ in range(n))


def test_long_chains_need_few_rounds(spark, monkeypatch):
    rounds = []
    real = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label="x", sweep=False: (rounds.append(label), real(df, label, sweep))[1])
    df = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert graph.components(df).groupBy("component").count().collect() == [(0, 3001)]
    assert rounds.count("jump") < 20


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_order_is_depth_first(spark, seed):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1000), 70)
    tree = [(ids[i], ids[rnd.randrange(max(0, i - 3) if seed == 1 else 0, i)]) for i in range(1, 50)]
    tree += [(ids[50], x) for x in ids[51:]]  # a star of its own
    near = {}
    for u, v in tree:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    want, seen = [], set()
    for first in sorted(near):
        if first in seen:
            continue
        at, stack = 0, [(first, None, 0)]
        while stack:
            x, up, deep = stack.pop()
            seen.add(x)
            want.append((x, first, at, up, deep))
            at += 1
            stack += [(y, x, deep + 1) for y in sorted(near[x], reverse=True) if y != up]
    got = graph.tree_order(spark.createDataFrame(tree, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_tips_equal_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(34)} | {(100 + i, 101 + i) for i in range(5)} | {(200 + i, 201 + i) for i in range(9)} | {(300, 302), (301, 302), (302, 303)}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    starts = set(out) - {b for _, b in edges}
    changed = True
    while changed:
        changed = False
        for s in sorted(starts):
            cur, walk, tip = s, [], False
            while s in out and len(walk) < 6:
                if cur not in out:
                    tip = True
                    break
                if len(out[cur]) > 1:
                    break
                walk.append(cur)
                cur = out[cur][0]
            if tip:
                for x in walk:
                    changed |= out.pop(x, None) is not None
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {(r.src, r.dst) for r in graph.without_tips(df, 6).select("src", "dst").collect()}
    assert got == {(a, b) for a in out for b in out[a]}


@pytest.mark.parametrize("seed", [2])
def test_trails_use_every_edge_once(spark, seed):
    rnd = random.Random(seed)
    edges = []
    for base in (0, 100):  # closed walks that share nodes, and some more edges
        for _ in range(6):
            walk = [base + rnd.randrange(8) for _ in range(rnd.randrange(2, 6))]
            edges += list(zip(walk, walk[1:] + walk[:1]))
    edges += [(rnd.randrange(8), rnd.randrange(8)) for _ in range(seed)] + [(200, 201), (201, 202)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(edges)], "id long, src long, dst long")
    trails = {}
    for r in graph.euler_trails(df).collect():
        trails.setdefault(r.trail, []).append((r.at, r.id))
    assert sorted(i for t in trails.values() for _, i in t) == list(range(len(edges)))
    degree, parent = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) - 1 if a != b else degree.get(b, 0)
        parent[root(a)] = root(b)
    degree = {n: sum(a == n for a, _ in edges) - sum(b == n for _, b in edges) for n in degree}
    for t in trails.values():
        t.sort()
        assert [a for a, _ in t] == list(range(len(t)))
        assert all(edges[x][1] == edges[y][0] for (_, x), (_, y) in zip(t, t[1:]))
    least = {}
    for n, x in degree.items():
        least[root(n)] = least.get(root(n), 0) + max(x, 0)
    assert len(trails) == sum(max(1, x) for x in least.values())


def greedy(edges, anchored):
    taken, used, parent = [], set(), {}

    def root(x):
        x = -1 if anchored and x < 0 else x
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, p, q in sorted({(w, min(p, q), max(p, q)) for p, q, w in edges}):
        a, b = root(p // 2), root(q // 2)
        if p // 2 != q // 2 and not {p, q} & used and a != b:
            taken.append((p, q, w))
            used |= {p, q}
            parent[a] = b
    return sorted(taken)


@pytest.mark.parametrize("seed,anchored", [(1, False), (3, True)])
def test_greedy_joins_equal_one_at_a_time(spark, seed, anchored):
    rnd = random.Random(seed)
    lo = -12 if anchored else 0
    edges = [(rnd.randrange(lo, 40), rnd.randrange(lo, 40), rnd.randrange(12)) for _ in range(160)]
    edges += [(2 * i + 61, 2 * i + 62, 3) for i in range(20)] + [(101, 60, 5)]  # a ring: its last edge is refused
    best = {}
    for p, q, w in edges:
        k = (min(p, q), max(p, q))
        best[k] = min(best.get(k, w), w)
    got = growth.greedy_joins(spark.createDataFrame([(p, q, w) for p, q, w in edges], "p long, q long, w int"), ["w"], anchored)
    assert sorted((r.p, r.q, r.w) for r in got.collect()) == greedy([(p, q, w) for (p, q), w in best.items()], anchored)


def noisy_reads(seed, n=110, size=80, length=1100):
    rnd, g = random.Random(seed), genome(length, seed)
    out = []
    for i in range(n):
        a = rnd.randrange(0, length - size)
        s = list(g[a : a + size])
        if rnd.random() < 0.3:
            s[rnd.randrange(size)] = rnd.choice("ACGT")
        s = "".join(s)
        out.append((i, rc(s) if rnd.random() < 0.5 else s, rnd.random() < 0.85))
    return out + [(n, "ACGTNNACGT", True), (n + 1, "", True), (n + 2, None, False), (n + 3, genome(size, 77), True), (n + 4, out[3][1], True), (n + 5, genome(size, 78), False)]


def placed_well(reads, places, contigs, most):
    """Every read is placed once, with as many differences as it says."""
    assert sorted(p.uid for p in places) == [r[0] for r in reads]
    text = {r[0]: r[1] or "" for r in reads}
    for p in places:
        s = text[p.uid]
        there = contigs[p.cid][p.pos : p.pos + len(s)]
        assert len(there) == len(s) and differ(rc(s) if p.rc else s, there) == p.mm
        assert p.mm <= max(most(len(s)), sum(c not in "ACGT" for c in s))


def sequential(reads, k=16, max_mm=4, error=0.10):
    """The length of what one read at a time makes: inside, else on at an open end, else anew."""
    pg = []
    for _, s, _ in reads:
        s = s or ""
        fits = lambda c, t: any(differ(c[i : i + len(t)], t) <= max_mm for i in range(len(c) - len(t) + 1))
        if any(fits(c, t) for c in pg for t in (s, rc(s))):
            continue
        best = max(((n, -i, t) for i, c in enumerate(pg) for t in (s, rc(s)) for n in range(k, min(len(t), len(c) + 1)) if differ(c[len(c) - n :], t[:n]) <= int(n * error)), default=None)
        if best:
            pg[-best[1]] += best[2][best[0] :]
        else:
            pg.append(s)
    return sum(map(len, pg))


@pytest.mark.parametrize("more", [{"error": 0.06}, {"error": 0.10, "batches": 3, "open_all": False}])
def test_every_read_is_placed(spark, more):
    reads = noisy_reads(5)
    df = spark.createDataFrame(reads, "uid long, seq string, hq boolean")
    places, contigs = growth.placed_all(df, **more)
    text = {r.cid: r.s for r in contigs.collect()}
    places = places.collect()
    placed_well(reads, places, text, lambda n: max(4, int(n * more["error"])))
    low = {r[0] for r in reads if not r[2]}
    alone = {p.cid for p in places if p.uid in low and text[p.cid] == (reads[p.uid][1] or "")}
    assert all(p.uid in low for p in places if p.cid in alone)  # nobody joins a contig of a read of low quality
    assert sum(map(len, text.values())) <= 1.4 * sequential(reads, error=more["error"])


def test_anchor_growth_merge_and_containment(spark):
    reads = noisy_reads(9)
    places, contigs = growth.anchor_grown(spark.createDataFrame(reads, "uid long, seq string, hq boolean"))
    text = {r.cid: r.s for r in contigs.collect()}
    places = places.collect()
    placed_well(reads, places, text, lambda n: n // 3)
    g = genome(2000, 21)
    swap = lambda s, i: s[:i] + s[i].translate(str.maketrans("ACGT", "CGTA")) + s[i + 1 :]
    parts = {0: g[:500], 1: rc(swap(g[440:900], 20)), 2: swap(g[850:1300], 30), 3: g[1290:1400], 4: rc(genome(300, 22))}
    moves, made = growth.merged(spark.createDataFrame(list(parts.items()), "cid long, s string"))
    made = {r.cid: r.s for r in made.collect()}
    assert sorted(len(s) for s in made.values()) == [110, 300, 1300]
    items = spark.createDataFrame([(c, 5, False, 20, f"i{c}") for c in parts], "cid long, pos long, rc boolean, len int, tag string")
    for r in growth.moved(items, moves).collect():
        s = made[r.cid][r.pos : r.pos + 20]
        assert differ(rc(s) if r.rc else s, parts[int(r.tag[1:])][5:25]) <= 1
    assert {r.cid for r in moves.collect()} == set(parts)
    nest = {0: g[:800], 1: rc(swap(swap(g[100:500], 40), 300)), 2: rc(g[100:500])[50:200], 3: g[:800], 4: "ACGT", 5: swap(rc(g[100:500])[60:160], 50)}
    found = growth.hosts(spark.createDataFrame(list(nest.items()), "cid long, s string"))
    up = {r.cid: r for r in found.collect()}
    for c, s in nest.items():
        fits = [(differ(v, t[i : i + len(s)]), h, i, w) for h, t in nest.items() if h != c and (len(t), -h) > (len(s), -c) for w, v in ((0, s), (1, rc(s))) for i in range(len(t) - len(s) + 1) if len(s) >= 11]
        best = min((x for x in fits if x[0] <= int(len(s) * 0.06)), default=None)
        assert (best is None) == (c not in up)
        if best:
            assert (up[c].mm, up[c].to_cid, up[c].pos, int(up[c].rc)) == best
    for r in growth.resolved(found).collect():
        assert r.to_cid not in up
        there = nest[r.to_cid][r.pos : r.pos + r.len]
        assert differ(rc(there) if r.rc else there, nest[r.cid]) <= 6


def test_running_counts_and_places(spark):
    df = spark.createDataFrame([(x * 7 % 50, x % 3) for x in range(200)], "k long, v int")
    rows = sampling.indexed(df, ["k", "v"]).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(200)) and [(r.k, r.v) for r in rows] == sorted((r.k, r.v) for r in rows)
    cells = spark.createDataFrame([(x * x, x) for x in range(100)], "cell long, n long")
    got = {r.cell: r.before for r in sampling.before(cells, "cell", fan=4, levels=3).collect()}
    assert got == {x * x: sum(range(x)) for x in range(100)}


def test_mates_near_or_mapped(spark):
    g = genome(900, 31)
    contigs = spark.createDataFrame([(0, g), (1, genome(400, 32))], "cid long, s string")
    other = genome(400, 32)
    rows = [(0, 0, 100, rc(g[205:285])), (1, 0, 100, g[600:680]), (2, None, None, other[50:130]), (3, 0, 100, genome(80, 33)), (4, 1, 20, rc(other[120:200])), (5, 0, 880, rc(g[10:90]))]
    got = joins.mated(spark.createDataFrame(rows, "read_id long, cid long, pos int, mate_seq string"), contigs, 100, 5, 6)
    got = {r.read_id: (r.cid, r.pos, r.rc, r.mm, r.near) for r in got.collect()}
    assert got == {0: (0, 205, True, 0, True), 1: (0, 600, False, 0, False), 2: (1, 50, False, 0, False), 4: (1, 120, True, 0, True), 5: (0, 10, True, 0, False)}


def test_haplotypes_are_found_on_the_genome(spark):
    g = genome(1500, 41)
    part = g[300:700]
    snv = part[:100] + part[100].translate(str.maketrans("ACGT", "CGTA")) + part[101:]
    deletion = part[:200] + part[203:]
    contigs = {0: part, 1: rc(part), 2: snv, 3: rc(deletion), 4: genome(200, 42)}
    at = lambda c, i: contigs[c][i]
    v = [
        (0, 51, at(0, 50), at(0, 50).translate(str.maketrans("ACGT", "CGTA")), "x", 350),  # as it is
        (1, 51, at(1, 50), at(1, 50).translate(str.maketrans("ACGT", "CGTA")), "x", 640),  # other strand
        (2, 101, at(2, 100), part[100], "x", 380),  # the genome has the alternative
        (0, 200, part[199:203], part[199], "x", 500),  # a deletion
        (3, len(deletion) - 200, at(3, len(deletion) - 201), at(3, len(deletion) - 201) + rc(part[200:203]), "x", 505),  # an insertion that the genome has, turned
        (0, 10, at(0, 9), "T", "x", 300), (4, 101, at(4, 100), "T", "x", 300), (0, 61, rc(at(0, 60)), at(0, 60), "x", 300)]
    names = "cid long, pos int, ref string, alt string, chrom string, at long"
    got = joins.haplotype_lifted(spark.createDataFrame(v, names), spark.createDataFrame(list(contigs.items()), "cid long, s string"), spark.createDataFrame([("x", g)], "chrom string, s string")).collect()
    got = {(r.cid, r.pos): (r.g_pos, r.g_ref, r.g_alt) for r in got}
    assert set(got) == {x[:2] for x in v[:5]}
    for c, pos, ref, alt, *_ in v[:5]:
        p, r, a = got[c, pos]
        assert g[p - 1 : p - 1 + len(r)] == r
        # both texts are the genome, as it is and with the other allele
        new = g[: p - 1] + a + g[p - 1 + len(r) :]
        mine = contigs[c][: pos - 1] + alt + contigs[c][pos - 1 + len(ref) :]
        assert {contigs[c], mine} & {g[300:700], rc(g[300:700])}
        assert any(x in new or rc(x) in new for x in (contigs[c], mine) if x not in (part, rc(part)))


def test_the_shortest_trial_is_kept(spark):
    reads = [(u, s) for u, s, _ in noisy_reads(13)]
    df = spark.createDataFrame(reads, "uid long, seq string")
    share, places, contigs = growth.best_trial(df)
    text = {r.cid: r.s for r in contigs.collect()}
    found = places.collect()
    assert sorted(p.uid for p in found) == [u for u, _ in reads] and len(text) == contigs.count()
    for p in found:
        s = dict(reads)[p.uid] or ""
        there = text[p.cid][p.pos : p.pos + len(s)]
        assert differ(rc(s) if p.rc else s, there) == p.mm <= max(1, len(s) // 8)
    size = sum(map(len, text.values()))
    others = [growth.best_trial(df, [x])[2].agg(F.sum(F.length("s"))).first()[0] for x in (0.65, 0.15)]
    assert size <= min(others) and share in (0.65, 0.45, 0.15)
