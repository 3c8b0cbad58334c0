"""Tables that are read back are not sent through the driver for their small files."""

from pyspark.sql import functions as F

from seqloom.session import materialize


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_a_table_of_small_files_and_many_rows_is_shuffled(spark):
    rows = materialize(spark.range(1_500_000).select("id", F.floor(F.col("id") / 1000).alias("x")))
    few = materialize(spark.range(10))
    assert "BroadcastHashJoin" not in plan(spark.range(1 << 40).join(rows, "id", "left"))
    assert "BroadcastHashJoin" in plan(spark.range(1 << 40).join(few, "id", "left"))
    assert "BroadcastHashJoin" in plan(spark.range(1 << 40).join(F.broadcast(rows), "id", "left"))
