"""Frame helpers that stay balanced when one group holds most rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def fold(n: int, index: int, seed: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod n is index; null ids are in no fold."""
    return F.coalesce(F.crc32(F.col(seed).cast("string")) % n == index, F.lit(False))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def running_sums(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, Column], rows: int) -> DataFrame:
    """Adds, for each name in sums, the sum of its expression over the rows of
    the same group that come before. The order within a group is that of a
    hashed bucket, then of the order columns. Both windows hold about the
    square root of a group's rows, however many rows the group has.
    """
    n = max(1, math.ceil(math.sqrt(max(rows, 1))))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    own = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*groups, "_bucket").agg(*[F.sum(e).alias(f"_all_{k}") for k, e in sums.items()])
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*groups, "_bucket", *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums])
    base = base.select(*[F.col(c).alias(f"_g_{c}") for c in [*groups, "_bucket"]], *[f"_base_{k}" for k in sums])
    part = df.select("*", *[F.coalesce(F.sum(e).over(own), F.lit(0)).alias(f"_own_{k}") for k, e in sums.items()])
    on = same(F.col("_bucket"), F.col("_g__bucket"))
    for c in groups:
        on = on & same(F.col(c), F.col(f"_g_{c}"))
    out = part.join(base, on)
    keep = [c for c in df.columns if c != "_bucket"]
    return out.select(*keep, *[(F.col(f"_own_{k}") + F.col(f"_base_{k}")).alias(k) for k in sums])
