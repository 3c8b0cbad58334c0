"""Sequence functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="pos int, kmer string")
class KmersTable:
    """kmers(seq, k): every window of k bases."""

    def eval(self, seq: str, k: int):
        if seq is not None and k is not None and k > 0:
            for i in range(len(seq) - k + 1):
                yield i, seq[i : i + k]


def register(spark: SparkSession) -> None:
    """The table function kmers(seq, k), and SQL macros in JVM code for the
    scalar functions."""
    spark.udtf.register("kmers", KmersTable)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(regexp_replace(translate(upper(s), 'U', 'T'), '[^ACGT]', 'N'), 'ACGT', 'TGCA'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION canonical(s STRING) RETURNS STRING RETURN least(s, reverse(translate(s, 'ACGT', 'TGCA')))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION mapq(mm INT) RETURNS INT RETURN greatest(0, 60 - 6 * mm)")
