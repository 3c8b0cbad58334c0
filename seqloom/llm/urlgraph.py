"""URL verdicts from rules and from trust that spreads along host links, by
DataFrame operations only.

Rules name a host and a path prefix and judge the urls that they fit; the
longest rule wins. For all other urls the hosts' link graph decides: trust
flows from the hosts of allowed urls along links (personalised PageRank),
distrust flows from the hosts of blocked urls against links, and a host is
blocked when its distrust is more than `ratio` times its trust.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

#: (verdict, rule), a rule being a host, then a path prefix.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("block", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
DAMPING = 0.85
#: The walks go on until a round changes less than this in all.
TOLERANCE = 1e-6
RATIO = 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules of
    equal length: the first in the list."""
    fits = []
    for verdict, rule in rules:
        name, slash, prefix = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        fits.append((len(rule), fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    fits.sort(key=lambda x: -x[0])
    return reduce(lambda rest, x: F.when(x[1], x[2]).otherwise(rest), reversed(fits), F.lit(None).cast("struct<rule:string,verdict:string>"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted. //host links take
    the page's scheme."""
    scheme = F.regexp_extract("url", r"(?s)^(.*?:)//", 1)
    links = pages.where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("src"), scheme.alias("scheme"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat("scheme", "to")).otherwise(F.col("to"))
    links = links.select("src", host_of(to).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of the hosts that seeds (host, allowed, blocked)
    reach; each kind of seed sums to 1. Both walks run as one: a row for each
    kind and host. Mass at hosts without links stays there. Rounds end when one
    reaches no new host and changes less than the tolerance in all."""
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).first()
    start = seeds.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), "host", (F.col("allowed") / (total["a"] or 1)).alias("seed")),
        F.struct(F.lit("distrust").alias("kind"), "host", (F.col("blocked") / (total["b"] or 1)).alias("seed")),
    )).alias("x")).select("x.*").where("seed > 0")
    start = materialize(start, "seeds")
    rank = start.withColumnRenamed("seed", "rank")
    if edges.limit(1).count():
        both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").union(
            edges.select(F.lit("distrust"), "dst", "src", "n"))
        out = materialize(both.groupBy("kind", "host").agg(F.sum("n").alias("out")), "degrees")
        both = materialize(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("out")).alias("part")), "walk")
        reached = rank.count()
        while True:
            # an inner join: a hub's edges can be split among tasks
            moved = rank.join(both, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("part") * damping).alias("x"))
            stays = rank.join(out, ["kind", "host"], "left_anti").select("kind", "host", (F.col("rank") * damping).alias("x"))
            now = moved.union(stays).union(start.select("kind", "host", F.col("seed") * (1 - damping))).withColumn("old", F.lit(0.0)).union(rank.select("kind", "host", F.lit(0.0), "rank"))
            now = materialize(now.groupBy("kind", "host").agg(F.sum("x").alias("rank"), F.sum("old").alias("old")), "rank")
            seen = now.agg(F.count("*").alias("n"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change")).first()
            rank, new, reached = now.select("kind", "host", "rank"), seen["n"] > reached, seen["n"]
            if not new and (seen["change"] or 0.0) < tolerance:
                break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    return rank.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judged(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, ratio: float = RATIO) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, by_graph,
    trust, distrust.

    A null url or one without :// has an empty host and path, fits no rule and
    is allowed. A host's seed mass is the share of its pages that rules allow
    or block, so that one host counts as one seed however many pages it has.
    Hosts that no seed reaches are allowed. Null html has no links; repeated
    rows are judged alike; an empty table gives no rows; other columns are
    not looked at.
    """
    page = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    page = page.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    is_ = lambda v: F.avg(F.when(F.col("best.verdict") == v, 1.0).otherwise(0.0))
    seeds = page.where("host <> ''").groupBy("host").agg(is_("allow").alias("allowed"), is_("block").alias("blocked"))
    edges = materialize(host_edges(pages), "links")
    rank = propagated(edges, materialize(seeds, "hosts"), damping, tolerance)
    out = page.join(rank, "host", "left")
    trust, distrust = (F.coalesce(x, F.lit(0.0)) for x in ("trust", "distrust"))
    graph = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", graph).alias("verdict"), F.col("best").isNull().alias("by_graph"), trust.alias("trust"), distrust.alias("distrust"))
