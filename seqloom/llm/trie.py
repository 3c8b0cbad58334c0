"""Prefix trie of conversations, summed along heavy paths.

Turns are numbered and their position-bound hashes summed in two levels, so a
conversation of any length is split over tasks; the sums up to a turn name the
prefix. Every prefix that conversations share is a node. A node's child with
most members (ties: the smallest member) continues its path; every other child
begins a path of its own and has at most half of the node's members, so a walk
to the root changes paths a logarithmic number of times. Each path ends in a
leaf and is named by the leaf's smallest conversation, whose turns are its
nodes. Sums run backwards along the paths, those of the deepest level first;
what the top of a path has gathered is attached to its parent for the next round.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import arrowed, drop_table, materialize

KEY = ["d", "a", "b"]
#: Depths of a path that one task sums up.
BLOCK = 4096
#: Characters of joined ids that travel as one row to the digest of a node.
PIECE = 1 << 16
PRIME = (1 << 61) - 1


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string")) % 6).cast("int")


def keyed(df: DataFrame, names: list[str], prefix: str = "_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) if c in names else F.col(c) for c in df.columns])


def on(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(left, right):
        out = out & (F.col(x) == F.col(y))
    return out


def summed_before(rows: DataFrame, group: str, part: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with each name of sums: the sum of its expression over the rows of
    the group up to and with each, in the order of part and then of order. A
    window holds the rows of one part of a group, or a group's parts."""
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(group, part).agg(*[F.sum(e).alias(f"_{n}") for n, e in sums.items()])
    cells = cells.select(F.col(group).alias("_g"), F.col(part).alias("_p"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    rows = rows.select("*", *[F.sum(e).over(inside).alias(f"_own_{n}") for n, e in sums.items()]).join(cells, on([group, part], ["_g", "_p"]))
    return rows.select(*[c for c in rows.columns if not c.startswith("_own_")], *[(F.col(f"_own_{n}") + F.col(f"_{n}")).alias(n) for n in sums])


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """(c, part, turn, name, chars, salt): turns in order over the parts; name
    is the MD5 of role and text."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("name"), F.length(text).cast("long").alias("chars"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    return materialize(rows.repartitionByRange("c", F.asc_nulls_first("turn"), "name", "salt").withColumn("part", F.spark_partition_id()), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns as rebuilt: c, part, d from 1, name, chars; conversations: c, n).
    turns: c, part, turn, name, chars, salt."""
    order = [F.asc_nulls_first("turn"), F.col("name"), F.col("salt")]
    cells = turns.groupBy("c", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("c", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    convs = turns.groupBy("c").agg(F.count("*").alias("own")).withColumn("h", borrowed(F.col("c"))).withColumn("first", F.col("c") - F.col("c") % 100)
    firsts = convs.where("c % 100 = 0").select(F.col("c").alias("first"), F.col("own").alias("there"))
    convs = convs.join(firsts, "first", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("c", "first", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "convs")
    cells = cells.join(convs.select("c", "h", "m"), "c").select(F.col("c").alias("_c"), F.col("part").alias("_p"), "before", "h", "m")
    nth = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order))
    rows = turns.withColumn("nth", nth).join(cells, on(["c", "part"], ["_c", "_p"])).withColumn("nth", F.col("nth") + F.col("before"))
    rows = materialize(rows.select("c", "part", "nth", "h", "m", "name", "chars"), "numbered")
    own = rows.where("nth > h").select("c", "part", (F.col("nth") - F.col("h") + F.col("m")).cast("long").alias("d"), "name", "chars")
    heads = rows.where("c % 100 = 0 and nth <= 5").select(F.col("c").alias("first"), "nth", "name", "chars")
    taken = convs.join(heads, "first").where("nth <= h").select("c", F.lit(-1).alias("part"), F.col("nth").cast("long").alias("d"), "name", "chars")
    return taken.union(own), convs.select("c", "n")


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, d, a, b, pa, pb, chars, last) for each conversation and depth, the
    root included: a and b name the prefix, pa and pb the one before."""
    hashes = {x: F.xxhash64("d", "name", F.lit(x)).cast("decimal(20,0)") for x in "ab"}
    rows = rows.select("*", *[h.alias(f"h{x}") for x, h in hashes.items()])
    rows = summed_before(rows, "c", "part", [F.col("d")], {x: F.col(f"h{x}") for x in "ab"})
    cut = lambda x: F.pmod(x, F.lit(PRIME).cast("decimal(20,0)")).cast("long")
    rows = rows.select("c", "d", *[cut(F.col(x)).alias(x) for x in "ab"], *[cut(F.col(x) - F.col(f"h{x}")).alias(f"p{x}") for x in "ab"], "chars")
    zero = F.lit(0).cast("long")
    root = convs.select("c", zero.alias("d"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), zero.alias("chars"))
    sizes = convs.select(F.col("c").alias("_c"), "n")
    ends = F.col("d") == F.col("n")
    return materialize(rows.union(root).join(sizes, F.col("c") == F.col("_c")).select("c", "d", "a", "b", "pa", "pb", "chars", ends.alias("last")), "prefixes")


def nodes_of(rows: DataFrame) -> DataFrame:
    """(d, a, b, conv_id, n_convs, chars, pa, pb, n_children, heavy): heavy
    marks the child of its parent with most members."""
    nodes = rows.groupBy(*KEY).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = materialize(nodes, "nodes")
    most = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("first"), "a", "b")).alias("most")
    kids = materialize(nodes.where("d > 0").groupBy((F.col("d") - 1).alias("_d"), F.col("pa").alias("_a"), F.col("pb").alias("_b")).agg(F.count("*").alias("n_children"), most), "kids")
    heavy = kids.select((F.col("_d") + 1).alias("_d"), F.col("most.a").alias("_a"), F.col("most.b").alias("_b"), F.lit(True).alias("heavy"))
    mine = [f"_{k}" for k in KEY]
    nodes = nodes.join(kids.drop("most"), on(KEY, mine), "left").drop(*mine).join(heavy, on(KEY, mine), "left").drop(*mine)
    return materialize(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "heavy": F.coalesce("heavy", F.lit(False))}), "tree")


def paths_of(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """(path, level, top, d, a, b, pa, pb, leaf, saved) of every node: the heavy
    path it lies on, the path's level and first depth, and its own share."""
    leaves = tree.where("n_children = 0").select(F.col("conv_id").alias("path"))
    walk = rows.join(leaves, F.col("c") == F.col("path")).select("path", *KEY)
    saved = (F.col("n_convs") - 1) * F.col("chars")
    info = tree.select(*[F.col(k).alias(f"_{k}") for k in KEY], "pa", "pb", "heavy", (F.col("n_children") == 0).alias("leaf"), saved.alias("saved"))
    # all walks meet at the root, which needs no join to be known
    below = walk.where("d > 0").join(info.where("_d > 0"), on(KEY, [f"_{k}" for k in KEY])).select("path", *KEY, "pa", "pb", "heavy", "leaf", "saved")
    below = materialize(below, "walks")
    tops = below.where("not heavy").groupBy(F.col("path").alias("_path")).agg(F.max("d").alias("top"), F.count("*").alias("level"))
    cut = below.join(tops, F.col("path") == F.col("_path"), "left").where("top is null or d >= top")
    cut = cut.select("path", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("top", F.lit(0)).cast("long").alias("top"), *KEY, "pa", "pb", "leaf", "saved")
    root = info.where("_d = 0").select(F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("top"), *[F.col(f"_{k}").alias(k) for k in KEY], "pa", "pb", "leaf", "saved")
    # the root begins the path of level 0; without any turn it is a path of its own
    name = cut.where("level = 0").agg(F.coalesce(F.min("path"), F.lit(0)).cast("long").alias("path"))
    root = root.join(F.broadcast(name)).select(*cut.columns)
    out = materialize(cut.union(root).repartitionByRange("level", "path", "d").sortWithinPartitions("level", "path", "d"), "paths")
    drop_table(below)
    return out


def subtree_sums(paths: DataFrame) -> DataFrame:
    """(d, a, b, n_leaves, saved_tokens) over the subtree of every node."""
    levels = paths.agg(F.max("level").alias("n")).first()["n"]
    if levels is None:
        return paths.select(*KEY, F.lit(0).alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    done, hung = None, None
    for level in range(levels, -1, -1):
        at = paths.where(F.col("level") == level)
        leaves, saved = F.col("leaf").cast("long"), F.col("saved")
        if hung is not None:
            at = at.join(hung, on(KEY, [f"_{k}" for k in KEY]), "left")
            leaves, saved = leaves + F.coalesce("_n", F.lit(0)), saved + F.coalesce("_s", F.lit(0))
        # backwards: the parts of a path are blocks of depths, the deepest first
        at = at.select("path", "top", *KEY, "pa", "pb", leaves.alias("n"), saved.alias("s"), (-F.floor(F.col("d") / BLOCK)).alias("part"))
        sums = summed_before(at, "path", "part", [F.desc("d")], {"n_leaves": F.col("n"), "saved_tokens": F.col("s")})
        sums = materialize(sums.select("top", *KEY, "pa", "pb", "n_leaves", "saved_tokens"), "sums")
        done = sums if done is None else done.union(sums)
        hung = sums.where("d = top and d > 0").groupBy((F.col("d") - 1).alias("_d"), F.col("pa").alias("_a"), F.col("pb").alias("_b")).agg(F.sum("n_leaves").alias("_n"), F.sum("saved_tokens").alias("_s"))
    return done.select(*KEY, "n_leaves", "saved_tokens")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(d, a, b, ends_sha256): the digest of the ascending ids, joined by commas,
    of the conversations (c) that end at each node. Ids are joined to pieces in
    sorted ranges; a node's pieces, not its ids, meet in one task, as a stream."""
    names = [*KEY, "first", "piece"]

    def pieces(batches):
        at, ids, size = None, [], 0
        out: list[tuple] = []
        for batch in batches:
            for d, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != (d, a, b) or size > PIECE:
                    if ids:
                        out.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids, size = (d, a, b), [], 0
                ids.append(c)
                size += 12
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, ids[0], ",".join(map(str, ids)))], names=names)

    def digests(batches):
        at, sha, out = None, None, []
        for batch in batches:
            for d, a, b, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if at == (d, a, b):
                    sha.update(b",")
                else:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (d, a, b), hashlib.sha256()
                sha.update(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*KEY, "ends_sha256"])
                out = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], names=[*KEY, "ends_sha256"])

    key = "d long, a long, b long"
    ranged = ends.select(*KEY, "c").repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c")
    cut = arrowed(ranged, pieces, f"{key}, first long, piece string")
    met = cut.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return arrowed(met, digests, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 of every node.

    Conversation c takes its first h = crc32(c) % 6 turns from conversation
    c - c % 100 (as many as that has; none if it is absent) and goes on with its
    own turns after its first h. Turns stand in the order of turn, null first;
    ties, and repeated rows, which are turns each, in the order of the MD5 of
    role and text. Null roles and texts are empty, rows with a null conv_id take
    no part, long texts count whole, other columns are not looked at. An empty
    table has no nodes. Prefixes are told apart by two sums of 64-bit hashes of
    their turns' MD5 and place, 122 bits in all.
    """
    turns = sorted_turns(conversations)
    rows, convs = rebuilt(turns)
    rows = prefixes(rows, convs)
    tree = nodes_of(rows)
    sums = subtree_sums(paths_of(rows, tree))
    digests = ends_digests(rows.where("last"))
    mine = [f"_{k}" for k in KEY]
    parents = tree.where("d > 0 and n_children > 0").select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("conv_id").alias("parent_conv_id"))
    first = tree.where("d = 0").select("conv_id").first()
    nodes = tree.select(*KEY, "conv_id", "n_convs", "n_children", "pa", "pb")
    top = nodes.where("d <= 1").withColumn("parent_conv_id", F.when(F.col("d") == 1, F.lit(first and first["conv_id"]).cast("long")))
    deep = nodes.where("d > 1").join(parents, on(["pa", "pb"], ["_a", "_b"]) & (F.col("d") - 1 == F.col("_d")), "left").select(*top.columns)
    out = top.union(deep).join(keyed(sums, KEY), on(KEY, mine), "left").drop(*mine).join(keyed(digests, KEY), on(KEY, mine), "left")
    none = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
