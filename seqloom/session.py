"""Sessions for scripts and tests, table access, and the shared work folder."""

from __future__ import annotations

import atexit
import gc
import os
import re
import sys
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    local temporary one where that is unset and driver and executors are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.sparkContext.setCheckpointDir(base)
        _drop_at_exit(spark, base)
    return base


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, deleted with those of materialize()."""
    path = os.path.join(shared_dir(spark), f"seqloom-{label}-{uuid.uuid4().hex}")
    _drop_at_exit(spark, path)
    return path


#: Bytes of a written table from which on joins shuffle it. Spark takes a table's size
#: from its files, and ids and bases take many times as much in memory as in those.
SMALL = 1 << 18


def reread(spark: SparkSession, schema, *paths: str) -> DataFrame:
    """Written tables, to be joined by a shuffle unless they are small."""
    out = spark.read.schema(schema).parquet(*paths)
    conf, size = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for path in paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size += hadoop.getFileSystem(conf).getContentSummary(hadoop).getLength()
    return widened(out) if size > SMALL else out


def materialize(df: DataFrame, label: str = "part", sweep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the plan above starts
    from files that outlive any executor. sweep: after it, have the executors
    delete the shuffles that nothing refers to any more, as those of a large df."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = reread(spark, df.schema, path)
    out.written_to = path
    if sweep:
        del df
        gc.collect()
        trim()
        spark.sparkContext._jvm.System.gc()
    return out


def widened(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle. Spark takes the size of exploded rows from the
    files that they are made of, of which they hold many times as much, and would
    send them whole through the driver. A broadcast that is asked for stays."""
    return df.hint("merge")


#: Rows of an Arrow batch, where the session has Spark's default: a batch of whole
#: texts is held on both sides of the pipe to Python.
BATCH_ROWS = 1000


def arrowed(df: DataFrame, run, schema: str, keeps: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema) in small batches, unless the session says how
    large they are; the worker gives free memory back after each task, as workers
    live on and an executor's limit covers all. keeps: run uses what it left in
    STATE in earlier tasks, which those of any other run let go."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if name not in conf.getAll:
        conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(released(run, keeps), schema)


def trim() -> None:
    """Gives this process' free memory back."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: A module that is made in Python workers only, for what they keep between tasks.
STATE = "seqloom_worker_state"


def released(run, keeps: bool = False):
    """run, after which the worker gives free memory back. Unless it keeps, what
    others left in the worker goes before."""
    state = STATE

    def wrapped(batches):
        if not keeps and sys.modules.pop(state, None):
            trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def written() -> list[str]:
    """The tables that materialize() has written from this thread and that are there."""
    return [path for _, path, thread in _to_drop if thread == threading.get_ident()]


def drop_written(keep: list[str]) -> None:
    """Deletes the tables of written() that are not among keep: for callers that
    have written what they made of them."""
    for path in set(written()) - set(keep):
        at = next(i for i, x in enumerate(_to_drop) if x[1] == path)
        spark, *_ = _to_drop.pop(at)
        _drop(spark, path)


def drop_table(*tables: DataFrame) -> None:
    """Deletes what materialize() wrote for these."""
    for df in tables:
        _to_drop[:] = [x for x in _to_drop if x[1] != df.written_to]
        _drop(df.sparkSession, df.written_to)


_to_drop: list[tuple[SparkSession, str, int]] = []


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    if not _to_drop:
        atexit.register(_drop_all)
    _to_drop.append((spark, path, threading.get_ident()))


def _drop(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _drop_all() -> None:
    for spark, path, _ in _to_drop:
        try:
            _drop(spark, path)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            return
