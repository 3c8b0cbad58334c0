"""Places in file order, and samples by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import materialize


def before(cells: DataFrame, cell: str, fan: int = 4096, levels: int = 2) -> DataFrame:
    """cells (cell, n) with before, the sum of n of all smaller cells: sums of
    `fan` neighbouring cells are cumulated first, level by level, so that no
    window holds more than `fan` cells while there are fewer than fan^(levels + 1)."""
    if not levels:
        over = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    own, up = f"_up{levels}", f"_of{levels}"
    rows = cells.withColumn(own, F.floor(F.col(cell) / fan))
    sums = before(rows.groupBy(F.col(own).alias(up)).agg(F.sum("n").alias("n")), up, fan, levels - 1).select(up, F.col("before").alias("_base"))
    inside = Window.partitionBy(own).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, F.col(own) == F.col(up))
    return rows.withColumn("before", F.col("_base") + F.col("_own")).select(*cells.columns, "before")


def numbered(rows: DataFrame, key: str, cell: int = 1_000_000) -> DataFrame:
    """rows with at, their place in key order from 0: ranks within ranges of the
    key, and the ranges' counts before."""
    rows = rows.withColumn("_cell", F.floor(F.col(key) / cell))
    counts = before(rows.groupBy("_cell").agg(F.count("*").alias("n")), "_cell")
    counts = counts.select(F.col("_cell").alias("_c"), F.col("before").alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(key)) - 1
    rows = rows.withColumn("_nth", inside).join(counts, F.col("_cell") == F.col("_c"))
    return rows.withColumn("at", F.col("_before") + F.col("_nth")).drop("_cell", "_c", "_nth", "_before")


def running(rows: DataFrame, group: str, part: str, order: list, sums: dict[str, Column]) -> DataFrame:
    """rows with each name of sums: the sum of its expression over the rows of
    the group up to and with each, in the order of part and then of order. A
    window holds the rows of one part of a group, or a group's parts."""
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(F.col(group).alias("_g"), F.col(part).alias("_p")).agg(*[F.sum(e).alias(f"_{n}") for n, e in sums.items()])
    cells = cells.select("_g", "_p", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    own = rows.select("*", *[F.sum(e).over(inside).alias(f"_own_{n}") for n, e in sums.items()])
    out = own.join(cells, (F.col(group) == F.col("_g")) & (F.col(part) == F.col("_p")))
    return out.select(*rows.columns, *[(F.col(f"_own_{n}") + F.col(f"_{n}")).alias(n) for n in sums])


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, written, with part, the range of the order that a row lies in, and
    idx, its place in the order from 0; no range holds more than its share."""
    out = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "indexed")
    starts = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = out.groupBy(F.col("part").alias("_p")).agg(F.count("*").alias("n")).select("_p", F.coalesce(F.sum("n").over(starts), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    out = out.withColumn("_nth", nth).join(parts, F.col("part") == F.col("_p"))
    return out.withColumn("idx", (F.col("_before") + F.col("_nth")).cast("long")).drop("_nth", "_p", "_before")


def strided(rows: DataFrame, key: str, n: int = 1000) -> DataFrame:
    """Every (rows / n)-th row, n at most; all rows if there are no more."""
    total = rows.agg(F.count("*").alias("_total"))
    rows = numbered(rows, key).join(F.broadcast(total))
    stride = F.greatest(F.floor(F.col("_total") / n), F.lit(1))
    return rows.where((F.pmod("at", stride) == 0) & ((F.floor(F.col("at") / stride) < n) | (F.col("_total") <= n))).drop("_total")


def stratified(rows: DataFrame, key: str, n: int, strata: int = 3) -> DataFrame:
    """Runs of consecutive rows from evenly spread places, n in all, with
    stratum; the first n mod strata runs hold one more."""
    total = rows.agg(F.count("*").alias("_total"))
    first = F.explode(F.transform(F.sequence(F.lit(0), F.lit(strata - 1)), lambda s: F.struct(s.alias("stratum"), F.floor(F.col("_total") * s / strata).alias("lo"), (F.lit(n // strata) + F.when(s < n % strata, 1).otherwise(0)).alias("size"))))
    runs = total.select(first.alias("x")).select("x.*")
    rows = numbered(rows, key)
    return rows.join(F.broadcast(runs), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.col("size"))).drop("lo", "size")


def kept_first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key. Each task keeps n of a key before the
    shuffle, so that a hot key sends n rows a task and no more."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def by_size(rows: DataFrame, size: str, key: str) -> DataFrame:
    """rows with rank, their place by falling size and then key: ranks among
    rows of one size, and the counts of larger sizes before."""
    counts = rows.groupBy(F.col(size).alias("_s")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_s", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(size).orderBy(key)) - 1
    rows = rows.withColumn("_nth", inside).join(counts, F.col(size) == F.col("_s"))
    return rows.withColumn("rank", F.col("_before") + F.col("_nth")).drop("_s", "_nth", "_before")


def stacked(rows: DataFrame, shard: str, place: str) -> DataFrame:
    """rows of all shards as one table: id is the place in the shard after the
    rows of the shards before it; places of a shard are 0, 1, 2, ..."""
    counts = rows.groupBy(F.col(shard).alias("_s")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_s", before.alias("_before"))
    return rows.join(counts, F.col(shard) == F.col("_s")).withColumn("id", F.col("_before") + F.col(place)).drop("_s", "_before")
