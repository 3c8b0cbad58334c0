"""Graph operators: components, spanning trees, de Bruijn graphs, assembly.

Every loop works on tables: each round is a few joins whose result is written
to the shared folder, and the driver sees one count per round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import reverse_complement, unpacked
from seqloom.operators import rolling
from seqloom.operators.sampling import indexed, running
from seqloom.session import arrowed, drop_table, materialize, reread


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (u, v): the smallest id that
    its links reach.

    Each round every vertex goes to the one of smallest hash among itself and
    its neighbours, and on to where that one goes; edges are contracted. Hashes
    are new in each round, so a part of the vertices that does not depend on
    the graph's shape goes, long chains in the order of their ids included, and
    the number of rounds is logarithmic. The smallest ids are taken in the end."""
    e = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps: list[DataFrame] = []
    while e.limit(1).count():
        hashed = lambda c, n=len(maps): F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("p"))
        both = e.union(e.select("v", "u"))
        hook = both.groupBy("u").agg(F.min(hashed("v")).alias("m")).select(F.col("u").alias("id"), F.least("m", hashed("u"))["p"].alias("p"))
        up = hook.select(F.col("id").alias("_i"), F.col("p").alias("_p"))
        jump = materialize(hook.join(up, F.col("p") == F.col("_i")).select("id", F.col("_p").alias("p")), "jump")
        maps.append(jump)
        a, b = (jump.select(F.col("id").alias(f"_{x}"), F.col("p").alias(f"_p{x}")) for x in "uv")
        was, e = e, e.join(a, F.col("u") == F.col("_u")).join(b, F.col("v") == F.col("_v"))
        e = materialize(e.select(F.least("_pu", "_pv").alias("u"), F.greatest("_pu", "_pv").alias("v")).where("u <> v").distinct(), "edges")
        drop_table(was)
    if not maps:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    # from the last map, the smallest, back to the first, so that only that is joined as a whole
    out = maps[-1].select("id", F.col("p").alias("at"))
    for m in maps[-2::-1]:
        up = out.select(F.col("id").alias("_i"), F.col("at").alias("_p"))
        out = materialize(m.join(up, F.col("p") == F.col("_i"), "left").select("id", F.coalesce("_p", "p").alias("at")), "labels")
    least = out.groupBy(F.col("at").alias("_at")).agg(F.min("id").alias("component"))
    return out.join(least, F.col("at") == F.col("_at")).select("id", "component")


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(u, v, dist): the minimum spanning forest under the order (dist, u, v),
    by rounds that add every component's smallest outgoing edge."""
    e = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "dist").where("u <> v").groupBy("u", "v").agg(F.min("dist").alias("dist")), "edges")
    left = e.select("u", "v", "dist", F.col("u").alias("cu"), F.col("v").alias("cv"))
    tree = e.limit(0)
    while left.limit(1).count():
        order = F.struct("dist", "u", "v", "cu", "cv")
        sides = left.select(F.col("cu").alias("c"), order.alias("x")).union(left.select("cv", order))
        chosen = materialize(sides.groupBy("c").agg(F.min("x").alias("x")).select("x.*").distinct(), "chosen")
        tree = materialize(tree.union(chosen.select("u", "v", "dist")), "tree")
        comp = components(chosen.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        a, b = (comp.select(F.col("id").alias(f"_{x}"), F.col("component").alias(f"_c{x}")) for x in "uv")
        left = left.join(a, F.col("cu") == F.col("_u"), "left").join(b, F.col("cv") == F.col("_v"), "left")
        left = left.select("u", "v", "dist", F.coalesce("_cu", "cu").alias("cu"), F.coalesce("_cv", "cv").alias("cv")).where("cu <> cv")
        left = materialize(left, "left")
    return tree


def paths(links: DataFrame, nodes: DataFrame, cyclic: bool = True) -> DataFrame:
    """(id, head, rank) of every node along links (src, dst) in which no node
    has two links out or two in: the first node of its path and the steps from
    it. Pointers double each round. Cycles are cut before their smallest node;
    cyclic says whether there can be any."""
    return _ranked(links.where("src <> dst") if cyclic else links, nodes, cyclic=cyclic)


def _opened(links: DataFrame) -> DataFrame:
    """links (id, up) without the one of the smallest node of each cycle."""
    comp = components(links.select(F.col("up").alias("u"), F.col("id").alias("v")))
    starts = links.select(F.col("up").alias("id")).join(links.select("id"), "id", "left_anti").distinct()
    headed = comp.join(starts, "id").select("component").distinct()
    cyclic = comp.join(headed, "component", "left_anti").select("component").distinct()
    return links.join(cyclic.select(F.col("component").alias("id")), "id", "left_anti")


#: Rows of links from which on they are contracted before pointers double.
FEW = 200_000


def _ranked(links: DataFrame, nodes: DataFrame, few: int = FEW, cyclic: bool = False) -> DataFrame:
    """paths(): long lists are contracted first, so that all rounds together cost some
    times the list, not its logarithm times."""
    left = materialize(links.select(F.col("dst").alias("id"), F.col("src").alias("up"), F.lit(1).cast("long").alias("d")), "list")
    if left.count() <= few:
        return _doubled(_opened(left) if cyclic else left, nodes)
    return _contracted(left, nodes, [], few, cyclic)


def _contracted(left: DataFrame, nodes: DataFrame, out: list[DataFrame], few: int = FEW, cyclic: bool = False) -> DataFrame:
    """(id, head, rank) of every node along links left (id, up, d), written, and those
    that out (id, up, d, gone), written, has taken from it.

    Of the nodes behind another one, those whose coin, new in each round, shows
    heads while that of the node before shows tails leave the list, a quarter in
    a round, until few are left, whose pointers double. Then they come back, the
    last first. Cycles are cut where only few of their nodes are left, and turned to
    their smallest one in the end."""
    links = out[0] if out else left
    while left.count() > few:
        coin = lambda c, n=len(out): F.pmod(F.xxhash64(c, F.lit(n)), F.lit(2)) == 0
        # at a node meet its own link and that of the one behind it
        ends = F.array(F.struct(F.col("id").alias("x"), F.col("up").alias("to"), "d", F.lit(True).alias("own")), F.struct(F.col("up").alias("x"), F.col("id").alias("to"), "d", F.lit(False).alias("own")))
        own = lambda c, mine: F.max(F.when(F.col("own") == mine, F.col(c)))
        met = left.select(F.explode(ends).alias("e")).select("e.*").groupBy("x").agg(own("to", True).alias("up"), own("d", True).alias("up_d"), own("to", False).alias("id"), own("d", False).alias("d"))
        met = met.where("id is not null").select("id", "x", "d", "up", "up_d", (coin("id") & ~coin("x")).alias("gone"), (F.col("up").isNotNull() & coin("x") & ~coin("up")).alias("jumps"))
        met = met.select("id", F.when(F.col("jumps"), F.col("up")).otherwise(F.col("x")).alias("up"), F.when(F.col("jumps"), F.col("d") + F.col("up_d")).otherwise(F.col("d")).alias("d"), "gone")
        met = materialize(met, "list")
        out.append(met)
        left = met.where("not gone and id <> up").drop("gone")
    ends = materialize(left.select("id").union(left.join(left.select(F.col("id").alias("up")), "up", "left_anti").select(F.col("up").alias("id"))).distinct(), "ends")
    heads = nodes.join(links.select("id"), "id", "left_anti").join(ends, "id", "left_anti")
    if cyclic:  # one node of a cycle may be left, which follows itself
        open_ = materialize(_opened(left), "open")
        alone = reduce(DataFrame.union, [met.where("not gone and id = up").select("id") for met in out])
        heads = heads.union(alone)
        cut = materialize(alone.union(left.join(open_.select("id"), "id", "left_anti").select("id")).select(F.col("id").alias("_h")), "cut")
        left = open_
    parts = [materialize(_doubled(left, ends), "ranks")]
    for met in out[::-1]:
        at = _all(parts).select(F.col("id").alias("_i"), "head", F.col("rank").alias("_rank"))
        # one whose node before is a head that no one is behind any more
        back = met.where("gone").join(at, F.col("up") == F.col("_i"), "left")
        parts.append(materialize(back.select("id", F.coalesce("head", "up").alias("head"), (F.col("d") + F.coalesce("_rank", F.lit(0))).alias("rank")), "ranks"))
    got = _all(parts)
    rest = materialize(heads.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("rank")), "heads")
    drop_table(*out, *([links] if links is not out[0] else []))
    if cyclic and cut.limit(1).count():
        # a node that is alone has its row in rest, all others of its cycle in got
        every = got.union(rest)
        on = every.join(cut, F.col("head") == F.col("_h")).groupBy("_h").agg(F.count("*").alias("_n"), F.min(F.struct("id", "rank")).alias("_m"))
        on = materialize(on, "cycles")
        every = every.join(on, F.col("head") == F.col("_h"), "left")
        return every.select("id", F.coalesce("_m.id", "head").alias("head"), F.when(F.col("_h").isNull(), F.col("rank")).otherwise(F.pmod(F.col("rank") - F.col("_m.rank"), F.col("_n"))).alias("rank"))
    return got.union(rest)


def _all(parts: list[DataFrame]) -> DataFrame:
    """The rows of tables that materialize() has written, in one scan."""
    return reread(parts[0].sparkSession, parts[0].schema, *[p.written_to for p in parts])


def _doubled(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """_ranked() of few links (id, up, d)."""
    links = links.select("id", "up", "d")
    at = nodes.select("id").join(links, "id", "left").select("id", F.coalesce("up", "id").alias("up"), F.coalesce("d", F.lit(0)).cast("long").alias("rank"))
    at = materialize(at, "at")
    while True:
        up = at.select(F.col("id").alias("_i"), F.col("up").alias("_up"), F.col("rank").alias("_rank"))
        new = materialize(at.join(up, F.col("up") == F.col("_i")).select("id", F.col("_up").alias("up"), (F.col("rank") + F.col("_rank")).alias("rank"), (F.col("_up") != F.col("up")).alias("moved")), "at")
        moved = new.where("moved").limit(1).count()
        drop_table(at)
        at = new.drop("moved")
        at.written_to = new.written_to
        if not moved:
            return at.select("id", F.col("up").alias("head"), "rank")


def tree_order(tree: DataFrame) -> DataFrame:
    """(id, component, at, parent, depth): vertices of a forest (u, v) in
    depth-first order from the smallest of each component, smaller neighbours
    first; the root's parent is null.

    Every edge is walked both ways in one tour of its tree; list ranking by
    doubling gives each step's place in the tour, hence parents and subtree
    sizes. A vertex comes after its parent and the subtrees of its smaller
    siblings, so running sums along the tour are the order. All steps of a
    vertex of many edges, and of a long tour, are spread over tasks."""
    both = tree.select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b")
    arcs = materialize(indexed(both.union(both.select("b", "a")).distinct(), ["a", "b"]), "arcs")
    ends = materialize(arcs.groupBy(F.col("a").alias("_a")).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")), "ends")
    root = components(tree.select("u", "v")).where("id = component").select(F.col("id").alias("_a"))
    starts = ends.join(root, "_a").select(F.col("lo").alias("start"))
    # behind an edge into a vertex comes that vertex's next edge, behind its last one the first
    last = ends.select(F.col("hi").alias("_i"), "lo")
    then = arcs.join(last, F.col("idx") == F.col("_i"), "left").select(F.col("a").alias("b"), F.col("b").alias("a"), F.coalesce("lo", F.col("idx") + 1).alias("dst"))
    links = arcs.select("a", "b", F.col("idx").alias("src")).join(then, ["a", "b"]).select("src", "dst")
    links = links.join(starts, F.col("dst") == F.col("start"), "left_anti")
    tour = paths(materialize(links, "links"), arcs.select(F.col("idx").alias("id")), cyclic=False)
    tour = materialize(arcs.join(tour, F.col("idx") == F.col("id")).select("a", "b", "idx", "part", "head", "rank"), "tour")
    back = tour.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("rank").alias("back"))
    steps = tour.join(back, ["a", "b"]).withColumn("down", F.col("rank") < F.col("back"))
    # subtrees of smaller siblings, by parent and range of the sorted edges
    size = F.when(F.col("down"), (F.col("back") - F.col("rank") + 1) / 2).otherwise(0).cast("long")
    steps = materialize(running(steps.withColumn("size", size), "a", "part", [F.col("idx")], {"upto": F.col("size")}), "steps")
    jump = steps.where("down").select(F.col("a").alias("p"), F.col("b").alias("c"), (F.col("upto") - F.col("size") + 1).alias("jump"))
    down = steps.where("down").join(jump.select(F.col("p").alias("a"), F.col("c").alias("b"), "jump"), ["a", "b"])
    up = steps.where("not down").join(jump.select(F.col("c").alias("a"), F.col("p").alias("b"), (-F.col("jump")).alias("jump")), ["a", "b"])
    walk = down.select("a", "b", "head", "rank", "down", "jump").union(up.select("a", "b", "head", "rank", "down", "jump")).withColumn("block", F.floor(F.col("rank") / 65536))
    walk = running(walk, "head", "block", [F.col("rank")], {"at": F.col("jump"), "depth": F.when(F.col("down"), 1).otherwise(-1)})
    roots = steps.join(starts, F.col("idx") == F.col("start")).select(F.col("idx").alias("head"), F.col("a").alias("component"))
    rows = walk.where("down").join(roots.withColumnRenamed("head", "_h"), F.col("head") == F.col("_h"))
    rows = rows.select(F.col("b").alias("id"), "component", F.col("at").cast("long").alias("at"), F.col("a").alias("parent"), F.col("depth").cast("long").alias("depth"))
    zero = F.lit(0).cast("long")
    return rows.union(roots.select("component", "component", zero, F.lit(None).cast("long"), zero))


# de Bruijn graphs: a k-mer is an edge from its first k - 1 bases to its last


def dbg_edges(kc: DataFrame, least: int = 1) -> DataFrame:
    """(src, dst, base, is_rc, n): both strands of every canonical k-mer."""
    rows = kc.where(F.col("n") >= least)
    rc = reverse_complement("kmer")
    both = rows.select("kmer", F.lit(False).alias("is_rc"), "n").union(rows.where(rc != F.col("kmer")).select(rc, F.lit(True), "n"))
    cut = F.length("kmer") - 1
    return both.select(F.col("kmer").substr(F.lit(1), cut).alias("src"), F.col("kmer").substr(F.lit(2), cut).alias("dst"), F.right("kmer", F.lit(1)).alias("base"), "is_rc", "n")


def dbg_degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in, is_start, unbalanced)."""
    rows = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    d = rows.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return d.select("node", "n_out", "n_in", (F.col("n_out") > F.col("n_in")).alias("is_start"), (F.col("n_out") != F.col("n_in")).alias("unbalanced"))


def packed_turned(c, k: int):
    """The reverse complement of packed strings of k bases."""
    x = c.bitwiseXOR(F.lit((1 << (2 * k)) - 1))
    for n, m in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = F.shiftleft(x.bitwiseAND(F.lit(m)), n).bitwiseOR(F.shiftrightunsigned(x, n).bitwiseAND(F.lit(m)))
    return F.shiftrightunsigned(x, 64 - 2 * k)


def kmer_degrees(kc: DataFrame, k: int) -> DataFrame:
    """dbg_degrees(dbg_edges()) of canonical packed k-mers (packed), k up to 31.

    A node and its other strand are one row until the end: what leaves the one
    enters the other. A k-mer leaves its first k - 1 bases and enters its last
    ones, so it adds a row for each, a packed node, and no row for each strand."""
    mask = (1 << (2 * k - 2)) - 1
    turned = lambda c: packed_turned(c, k - 1)
    ends = F.array(F.struct(F.shiftrightunsigned("packed", 2).alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("packed").bitwiseAND(F.lit(mask)).alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    own = F.col("packed")
    kmer_turned = F.lit(False)
    if k % 2 == 0:  # a k-mer that is its own other strand is one edge
        half = F.shiftrightunsigned(own, 2)
        kmer_turned = (turned(half) == own.bitwiseAND(F.lit(mask)))
    rows = kc.select(kmer_turned.alias("own"), F.explode(ends).alias("x")).where("not own or x.o = 1").select("x.*")
    rows = rows.select("v", turned(F.col("v")).alias("w"), "o", "i")
    # in the direction of the smaller name; a node that is its own other strand has both
    rows = rows.select(F.least("v", "w").alias("v"), F.when(F.col("v") <= F.col("w"), F.col("o")).otherwise(F.col("i")).alias("o"), F.when(F.col("v") <= F.col("w"), F.col("i")).otherwise(F.col("o")).alias("i"))
    d = rows.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).select("*", turned(F.col("v")).alias("w"))
    same = F.col("v") == F.col("w")
    both = F.when(same, F.array(F.struct("v", (F.col("o") + F.col("i")).alias("n_out"), (F.col("o") + F.col("i")).alias("n_in"))))
    both = both.otherwise(F.array(F.struct("v", F.col("o").alias("n_out"), F.col("i").alias("n_in")), F.struct(F.col("w").alias("v"), F.col("i").alias("n_out"), F.col("o").alias("n_in"))))
    d = d.select(F.explode(both).alias("x")).select(unpacked("x.v", k - 1).alias("node"), "x.n_out", "x.n_in")
    return d.select("node", "n_out", "n_in", (F.col("n_out") > F.col("n_in")).alias("is_start"), (F.col("n_out") != F.col("n_in")).alias("unbalanced"))


def packed_edges(kc: DataFrame, k: int) -> DataFrame:
    """(edge, src, dst) of both strands of canonical packed k-mers (packed), k up to
    31; nodes are packed, too, and all sort as the strings do."""
    mask = (1 << (2 * k - 2)) - 1
    rc = packed_turned(F.col("packed"), k)
    both = F.array_distinct(F.array(F.col("packed"), rc))
    kind = "int" if k <= 16 else "long"
    rows = kc.select(F.explode(both).alias("edge"))
    return rows.select("edge", F.shiftrightunsigned("edge", 2).cast(kind).alias("src"), F.col("edge").bitwiseAND(F.lit(mask)).cast(kind).alias("dst"))


def without_tips(edges: DataFrame, longest: int) -> DataFrame:
    """edges without tips, again and again until none is left: from a node that
    nothing leads to (in edges as given), along nodes with one way on, to one
    without any, in fewer than `longest` steps. All nodes of the walk lose their
    edges, also where several walks have met; walks that led to them end there.

    Walks begin at the nodes that nothing leads to and only they are followed, by
    jumps of 1, 2, 4, ... steps, each kept only where it is whole. A node has all
    of its edges or none, so that a walk stays as it is and later rounds only look
    where it now ends."""
    e = materialize(edges, "edges")
    out = materialize(e.groupBy("src").agg(F.min("dst").alias("to"), F.max("dst").alias("most")), "ways")
    jumps = [materialize(out.where(F.col("to") == F.col("most")).select(F.col("src").alias("node"), "to"), "jump")]
    starts = jumps[0].select("node").join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    walks = materialize(starts.select(F.col("node").alias("start"), F.lit(0).alias("step"), "node"), "walks")
    while 2 ** len(jumps) <= longest:
        on = jumps[-1].select(F.col("node").alias("_n"), F.col("to").alias("_to"))
        jumps.append(materialize(jumps[-1].join(on, F.col("to") == F.col("_n")).select("node", F.col("_to").alias("to")), "jump"))
    for i in reversed(range(len(jumps))):
        far = walks.join(jumps[i], "node").select("start", (F.col("step") + 2**i).alias("step"), F.col("to").alias("node"))
        was, walks = walks, materialize(walks.union(far.where(F.col("step") < longest)), "walks")
        drop_table(was)
    drop_table(*jumps)
    # where walks end: nodes without a way on, and those that lost theirs
    ends = materialize(walks.select("node").distinct().join(out.select(F.col("src").alias("node")), "node", "left_anti"), "ends")
    first = ends
    drop_table(out)
    while True:
        stop = walks.join(ends, "node", "left_semi").groupBy(F.col("start").alias("_s")).agg(F.min("step").alias("stop")).where("stop > 0")
        new = walks.join(stop, (F.col("start") == F.col("_s")) & (F.col("step") < F.col("stop"))).select("node").distinct()
        new = materialize(new.join(ends, "node", "left_anti"), "ends")
        if not new.limit(1).count():
            break
        ends = materialize(ends.union(new), "ends")
    gone = ends.join(first, "node", "left_anti").select(F.col("node").alias("src"))
    return e.join(gone, "src", "left_anti")


def unitigs(edges: DataFrame) -> DataFrame:
    """(head, tail, n_edges, seq): maximal paths whose inner nodes have one link
    in and one out."""
    d = dbg_degrees(edges)
    simple = d.where("n_out = 1 and n_in = 1").select("node")
    named = materialize(edges.select("src", "dst", "base").distinct().select("*", F.concat("src", "base").alias("id")), "named")
    into = named.join(simple.select(F.col("node").alias("dst")), "dst").select(F.col("id").alias("a"), F.col("dst").alias("via"))
    out = named.join(simple.select(F.col("node").alias("src")), "src").select(F.col("id").alias("b"), F.col("src").alias("via"))
    links = into.join(out, "via").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    placed = paths(materialize(links, "links"), named.select("id"))
    rows = placed.join(named, "id").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("rank", "base", "dst", "src"))).alias("x"))
    seq = F.concat(F.element_at("x", 1)["src"], F.array_join(F.transform("x", lambda p: p["base"]), ""))
    return rows.select(F.element_at("x", 1)["src"].alias("head"), F.element_at("x", -1)["dst"].alias("tail"), F.size("x").alias("n_edges"), seq.alias("seq"))


def packed_unitigs(kc: DataFrame, k: int) -> DataFrame:
    """(seq, n_edges): unitigs() of canonical packed k-mers (packed), k up to 31.

    Edges meet in buckets of nodes, most neighbours in the same one, so that lists
    are some times shorter when they leave them; what is shuffled before are 8 or 16
    bytes an edge."""
    met = arrowed(kc.select("packed"), rolling.dealt_edges(k), "bucket int, into binary, out binary").repartition("bucket").sortWithinPartitions("bucket")
    met = materialize(arrowed(met, rolling.linked_edges(k), "id long, up long, d long, gone boolean"), "list")
    edges = packed_edges(kc, k).select(F.col("edge").alias("id"))
    at = _contracted(met.where("not gone").drop("gone"), edges, [met], cyclic=True)
    rows = at.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    last = F.transform("x", lambda p: F.substring(F.lit("ACGT"), p["id"].bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)))
    return rows.select(F.concat(unpacked(F.shiftrightunsigned("head", 2), k - 1), F.array_join(last, "")).alias("seq"), F.size("x").alias("n_edges"))


def euler_trails(edges: DataFrame) -> DataFrame:
    """(id, trail, at) of every edge (id, src, dst): its trail, named by one of
    its edges, and its place there. Every edge lies on one trail, and there are
    as few as can be: where more edges leave nodes of a component than enter
    them, one for each such edge, else one circuit.

    Edges into a node are paired with edges out of it, which gives trails and
    circuits. Circuits of one half, by a hash, then join trails of the other
    half that they share a node with, by exchanging what comes next there; half
    of those that can join do so in a round. Only nodes where trails can still
    join are looked at in a round, and the trails, not their edges, are renamed."""
    e = edges.select("id", "src", "dst")
    ends = F.array(F.struct(F.col("dst").alias("node"), F.lit(True).alias("into")), F.struct(F.col("src").alias("node"), F.lit(False).alias("into")))
    rows = e.select("id", F.explode(ends).alias("x")).select("id", "x.*").repartition("node")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("node", "into").orderBy("id")))
    side = lambda into: F.max(F.when(F.col("into") == into, F.col("id")))
    pairs = rows.groupBy("node", "nth").agg(side(True).alias("a"), side(False).alias("b"))
    pairs = materialize(pairs, "pairs", sweep=True)  # a without b: a trail ends; b without a: one begins
    same = materialize(components(pairs.where("a is not null and b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("id").alias("_e"), "component"), "same")
    # nodes that one trail passes once join nothing
    many = pairs.where("nth = 2").select("node")
    once = pairs.join(many, "node", "left_anti").select("a", "b")
    at = pairs.join(many, "node", "left_semi").select("node", "a", "b", F.coalesce("a", "b").alias("e"))
    at = materialize(at.join(same, F.col("e") == F.col("_e"), "left").select("node", "a", "b", F.coalesce("component", "e").alias("first")), "passages", sweep=True)
    # trails by the smallest of their edges as paired
    begun = pairs.where("a is null").select(F.col("b").alias("e")).join(same, F.col("e") == F.col("_e"), "left").select(F.coalesce("component", "e").alias("first")).distinct()
    trails = same.select(F.col("component").alias("first")).union(at.select("first")).distinct()
    trails = trails.join(begun.withColumn("open", F.lit(True)), "first", "left").select("first", F.col("first").alias("trail"), F.coalesce("open", F.lit(False)).alias("open"))
    trails = materialize(trails, "trails")
    settled = [once]
    done = 0
    while True:
        # a pair is a passage through a node of its edges' trail; one that begins there counts too
        own = materialize(at.join(trails.select(F.col("first").alias("_f"), "trail", "open"), F.col("first") == F.col("_f")).drop("_f"), "named")
        mixed = own.groupBy("node").agg(F.min("trail").alias("x"), F.max("trail").alias("y"), F.min("open").alias("o")).where("x <> y and not o").select("node")
        mixed = materialize(mixed, "mixed")
        # trails that meet stay together and open ones open: what is not mixed will not be
        settled.append(materialize(own.join(mixed, "node", "left_anti").select("a", "b"), "settled"))
        near = materialize(own.join(mixed, "node", "left_semi"), "near")
        drop_table(own, at)
        if not near.limit(1).count():
            break
        # who stays: open trails, and circuits whose hash says so
        stays = F.col("open") | (F.pmod(F.xxhash64("trail", F.lit(done)), F.lit(2)) == 0)
        marked = near.withColumn("stays", stays)
        pick = lambda rows: rows.groupBy("node").agg(F.min(F.struct("trail", "a", "b", "open")).alias("k"))
        hosts = pick(marked.where("stays"))
        guests = marked.where("not stays").join(hosts, "node").groupBy("trail").agg(F.min(F.struct("node", "a", "b", "k")).alias("g"))
        guests = materialize(guests.select(F.col("trail").alias("guest"), "g.node", "g.a", "g.b", F.col("g.k").alias("k")), "guests")
        done += 1
        at = near.select("node", "a", "b", "first")
        at.written_to = near.written_to
        if guests.limit(1).count():
            # at a node: host's edge, then the guests' in turn; each goes on where the one before did
            ring = guests.select("node", F.col("guest").alias("o"), "a", "b").union(guests.select("node", F.lit(None).cast("long"), "k.a", "k.b").distinct())
            w = Window.partitionBy("node").orderBy(F.asc_nulls_first("o"))
            lo, hi = F.first("b").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lead("b").over(w)
            more = F.lead(F.lit(1)).over(w)
            turned = ring.select(F.col("node").alias("_node"), F.col("a").alias("_a"), F.col("b").alias("was"), F.when(more == 1, hi).otherwise(lo).alias("next"), F.lit(True).alias("turned"))
            now = at.join(turned, (F.col("node") == F.col("_node")) & F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("was")), "left")
            at = materialize(now.select("node", "a", F.when(F.col("turned"), F.col("next")).otherwise(F.col("b")).alias("b"), "first"), "passages")
            drop_table(near)
            into = guests.select(F.col("guest").alias("_t"), F.col("k.trail").alias("host"), F.col("k.open").alias("host_open"))
            was, trails = trails, materialize(trails.join(into, F.col("trail") == F.col("_t"), "left").select("first", F.coalesce("host", "trail").alias("trail"), F.coalesce("host_open", "open").alias("open")), "trails")
            drop_table(was)
        drop_table(guests)
    # a circuit begins with its smallest edge
    cut = trails.where("not open").groupBy("trail").agg(F.min("first").alias("dst")).select("dst")
    links = reduce(DataFrame.union, settled).where("a is not null and b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = materialize(links.join(cut, "dst", "left_anti"), "links", sweep=True)
    drop_table(pairs, same, trails, *settled[1:])
    return paths(links, e.select("id"), cyclic=False).select("id", F.col("head").alias("trail"), F.col("rank").alias("at"))


def euler_strings(edges: DataFrame) -> DataFrame:
    """(trail, n_edges, seq) of the trails over edges (src, dst): the first
    node and then the last base of each node after it, longest first when read
    in the order of n_edges."""
    named = materialize(indexed(edges.select("src", "dst"), ["src", "dst"]).select(F.col("idx").alias("id"), "src", "dst"), "named")
    rows = euler_trails(named).join(named, "id")
    parts = F.array_sort(F.collect_list(F.struct("at", F.right("dst", F.lit(1)).alias("base"), "src")))
    rows = rows.groupBy("trail").agg(parts.alias("x"))
    return rows.select("trail", F.size("x").alias("n_edges"), F.concat(F.element_at("x", 1)["src"], F.array_join(F.transform("x", lambda p: p["base"]), "")).alias("seq"))


def greedy_superstring(seqs: DataFrame, k: int, key: str = "uid") -> DataFrame:
    """(key, head, rank, start): sequences chained where one's last k bases are
    another's first k, mutual best first; start counts in the chain's string."""
    rows = seqs.where(F.length("seq") >= k).select(key, "seq")
    a = rows.select(F.col(key).alias("out_end"), F.right("seq", F.lit(k)).alias("k"))
    b = rows.select(F.col(key).alias("in_end"), F.col("seq").substr(1, k).alias("k"))
    # the rank of an end among those of its k-mer pairs them without a product
    nth = lambda df, c: df.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(c)))
    links = nth(a, "out_end").join(nth(b, "in_end"), ["k", "nth"]).where("out_end <> in_end").select(F.col("out_end").alias("src"), F.col("in_end").alias("dst"))
    placed = paths(materialize(links, "links"), rows.select(F.col(key).alias("id")))
    rows = placed.join(rows.select(F.col(key).alias("id"), F.length("seq").alias("n")), "id")
    before = F.sum(F.col("n") - k).over(Window.partitionBy("head").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(F.col("id").alias(key), "head", "rank", F.coalesce(before, F.lit(0)).alias("start"))


def assembled(overlaps: DataFrame, seqs: DataFrame, key: str = "uid") -> tuple[DataFrame, DataFrame]:
    """(contigs: cid, seq; placements: key, cid, pos, rc) from suffix-prefix
    overlaps (to_id, to_view, from_id, from_view, overlap) of strand views.

    An end of a sequence joins at most one other, the longest overlap that is
    the best of both ends first; so contigs grow on both sides at once, and the
    other strand of every chain is the same chain backwards. Chains that close
    on themselves or on their other strand are cut at their smallest end."""
    end = lambda i, v: F.col(i) * 2 + F.col(v)
    o = overlaps.where("to_id <> from_id").select(end("from_id", "from_view").alias("a"), end("to_id", "to_view").alias("b"), "overlap")
    flip = lambda c: c + 1 - 2 * F.pmod(c, F.lit(2))
    # one name for a join and its mirror: a's tail with b's head is flip(b)'s tail with flip(a)'s head
    o = o.select("a", "b", flip(F.col("b")).alias("ma"), flip(F.col("a")).alias("mb"), "overlap").select(
        F.when(F.struct("a", "b") <= F.struct("ma", "mb"), F.struct("a", "b")).otherwise(F.struct(F.col("ma").alias("a"), F.col("mb").alias("b"))).alias("x"), "overlap").groupBy("x").agg(F.max("overlap").alias("overlap"))
    o = o.select("x.a", "x.b", "overlap")
    # ports: a leaves by the tail of its view; the tail of view 1 is the head of view 0
    port = lambda view, tail: F.floor(view / 2) * 2 + F.when(F.pmod(view, F.lit(2)) == (0 if tail else 1), 1).otherwise(0)
    o = o.select(port(F.col("a"), True).alias("p"), port(F.col("b"), False).alias("q"), "overlap").where("p <> q")
    left = materialize(o.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "overlap").groupBy("p", "q").agg(F.max("overlap").alias("overlap")), "ports")
    done = left.limit(0)
    while left.limit(1).count():
        order = F.struct((-F.col("overlap")).alias("w"), "p", "q")
        both = left.select(F.col("p").alias("x"), order.alias("o")).union(left.select("q", order))
        best = both.groupBy("x").agg(F.min("o").alias("o"))
        new = materialize(best.groupBy("o").agg(F.count("*").alias("n")).where("n = 2").select("o.p", "o.q", (-F.col("o.w")).alias("overlap")), "new")
        done = materialize(done.union(new), "done")
        used = new.select(F.col("p").alias("u")).union(new.select("q"))
        left = materialize(left.join(used, F.col("p") == F.col("u"), "left_anti").join(used, F.col("q") == F.col("u"), "left_anti"), "left")
    # walk: from each view, the join at its tail port leads to the next view
    d = done.select("p", "q", "overlap").union(done.select("q", "p", "overlap"))
    view_out = lambda port_: F.floor(port_ / 2) * 2 + F.when(F.pmod(port_, F.lit(2)) == 1, 0).otherwise(1)
    view_in = lambda port_: F.floor(port_ / 2) * 2 + F.when(F.pmod(port_, F.lit(2)) == 0, 0).otherwise(1)
    links = materialize(d.select(view_out(F.col("p")).alias("src"), view_in(F.col("q")).alias("dst"), "overlap").distinct(), "links")
    ids = seqs.select(F.explode(F.array(F.col(key) * 2, F.col(key) * 2 + 1)).alias("id"))
    at = materialize(paths(links.select("src", "dst"), ids), "paths")
    # of a chain and its mirror keep the one that holds the smaller head; a view is kept once
    mine = at.select("id", "head", "rank", F.floor(F.col("id") / 2).alias("k"))
    keep = mine.groupBy("k").agg(F.min(F.struct("head", "rank", "id")).alias("m")).select("m.*")
    smaller = keep.select("head").distinct()
    rows = at.join(smaller, "head").join(keep.select("id"), "id", "left_semi")
    text = seqs.select(F.col(key).alias("k"), "seq")
    rows = rows.withColumn("k", F.floor(F.col("id") / 2)).join(text, "k")
    rows = rows.withColumn("seq", F.when(F.pmod("id", F.lit(2)) == 1, reverse_complement("seq")).otherwise(F.col("seq")))
    rows = rows.join(links.select(F.col("src").alias("_s"), F.col("dst").alias("id"), "overlap"), "id", "left")
    w = Window.partitionBy("head").orderBy("rank")
    joined = F.lag("id").over(w) == F.col("_s")
    rows = rows.withColumn("add", F.when(F.coalesce(joined, F.lit(False)), F.length("seq") - F.col("overlap")).otherwise(F.length("seq")))
    rows = rows.withColumn("stop", F.sum("add").over(w))
    rows = materialize(rows.select("k", "id", "head", "rank", "seq", "add", (F.col("stop") - F.length("seq")).alias("pos")), "laid")
    contigs = rows.groupBy(F.col("head").alias("cid")).agg(F.array_sort(F.collect_list(F.struct("rank", F.right("seq", F.col("add")).alias("s")))).alias("x")).select("cid", F.array_join(F.transform("x", lambda p: p["s"]), "").alias("seq"))
    return contigs, rows.select(F.col("k").alias(key), F.col("head").alias("cid"), "pos", (F.pmod("id", F.lit(2)) == 1).alias("rc"))
