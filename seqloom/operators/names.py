"""Read names as typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.sequence import digit_tokens, field_tokens

ILLUMINA = r"^(.*):([0-9]+):([0-9]+)(/[0-9]+)?$"


def columns(names: DataFrame, tokens=digit_tokens, key: str = "read_id") -> DataFrame:
    """(key, col, is_num, val) of every token of every name; numbers have at
    most 18 digits and no leading zero."""
    rows = names.select(key, F.posexplode(tokens("name")).alias("col", "val"))
    return rows.select(key, "col", F.col("val").rlike("^(0|[1-9][0-9]{0,17})$").alias("is_num"), "val")


def field_columns(names: DataFrame, key: str = "read_id") -> DataFrame:
    return columns(names, field_tokens, key)


def profile(cols: DataFrame, key: str = "read_id") -> DataFrame:
    """One row for each column: col, n, distinct_vals, numeric, constant,
    monotonic (numbers that rise strictly in read order), permutation (numbers
    1..n in some order)."""
    num = F.when(F.col("is_num"), F.col("val").cast("long"))
    # one name column is a sorted pass of its own; columns are few, rows are not:
    # order is checked within ranges of the key and between their edges
    rows = cols.select(key, "col", "val", "is_num", num.alias("num"), F.floor(F.col(key) / 1_000_000).alias("cell"))
    w = Window.partitionBy("col", "cell").orderBy(key)
    rows = rows.withColumn("up", F.coalesce(F.col("num") > F.lag("num").over(w), F.lit(True)))
    cells = rows.groupBy("col", "cell").agg(F.min("up").alias("up"), F.min_by("num", key).alias("a"), F.max_by("num", key).alias("b"))
    edge = Window.partitionBy("col").orderBy("cell")
    rising = cells.withColumn("up", F.col("up") & F.coalesce(F.col("a") > F.lag("b").over(edge), F.lit(True))).groupBy(F.col("col").alias("_col")).agg(F.min("up").alias("up"))
    s = rows.groupBy("col").agg(F.count("*").alias("n"), F.countDistinct("val").alias("distinct_vals"), F.min("is_num").alias("numeric"), F.min("num").alias("lo"), F.max("num").alias("hi"))
    s = s.join(rising, F.col("col") == F.col("_col"))
    return s.select("col", "n", "distinct_vals", "numeric", (F.col("distinct_vals") == 1).alias("constant"), (F.col("numeric") & F.col("up")).alias("monotonic"),
                    (F.col("numeric") & F.coalesce((F.col("lo") == 1) & (F.col("hi") == F.col("n")), F.lit(False)) & (F.col("distinct_vals") == F.col("n"))).alias("permutation"))


def illumina_share(names: DataFrame, first: int = 100, key: str = "read_id") -> DataFrame:
    """n, matching, looks_illumina of the first names: nine of ten end in :x:y."""
    rows = names.orderBy(key).limit(first).select(F.col("name").rlike(ILLUMINA).alias("ok"))
    s = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("matching"))
    return s.select("n", "matching", (F.col("matching") * 10 >= F.col("n") * 9).alias("looks_illumina"))


def illumina_fields(names: DataFrame, key: str = "read_id") -> DataFrame:
    part = lambda i: F.regexp_extract("name", ILLUMINA, i)
    rows = names.where(F.col("name").rlike(ILLUMINA))
    return rows.select(key, part(1).alias("prefix"), part(2).cast("long").alias("x"), part(3).cast("long").alias("y"), F.nullif(F.regexp_replace(part(4), "/", ""), F.lit("")).cast("int").alias("mate"))


def base_name(name="name"):
    """A name without its mate mark."""
    return F.regexp_replace(name, "/[12]$", "")


def paired_share(names: DataFrame, first: int = 200, key: str = "read_id") -> DataFrame:
    """total, matches, paired: whether nine of ten of the first neighbours at
    even and odd places share a base name."""
    at = F.row_number().over(Window.orderBy(key)) - 1
    rows = names.orderBy(key).limit(2 * first).select(key, base_name().alias("b")).withColumn("at", at)
    pairs = rows.groupBy(F.floor(F.col("at") / 2).alias("p")).agg(F.count("*").alias("n"), F.min("b").alias("a"), F.max("b").alias("z")).where("n = 2")
    s = pairs.agg(F.count("*").alias("total"), F.count(F.when(F.col("a") == F.col("z"), 1)).alias("matches"))
    return s.select("total", "matches", ((F.col("total") > 0) & (F.col("matches") >= F.floor(F.col("total") * 9 / 10))).alias("paired"))


def interleaved(r1: DataFrame, r2: DataFrame, key: str = "read_id") -> DataFrame:
    """Both files' reads as one, mates side by side: pair_id, mate and the rest."""
    a = r1.withColumn("mate", F.lit(0)).withColumn("read_id", F.col(key) * 2)
    b = r2.withColumn("mate", F.lit(1)).withColumn("read_id", F.col(key) * 2 + 1)
    return a.unionByName(b)


def dictionary(cols: DataFrame) -> DataFrame:
    """(col, val, code, n, scaled): the numbers of each numeric column, sorted
    and numbered from 0, with counts scaled to 65536."""
    numeric = cols.groupBy("col").agg(F.min("is_num").alias("ok")).where("ok").select("col")
    rows = cols.join(F.broadcast(numeric), "col").groupBy("col", F.col("val").cast("long").alias("val")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("col")
    return rows.select("col", "val", (F.row_number().over(w.orderBy("val")) - 1).alias("code"), "n", F.floor(F.col("n") * 65536 / F.sum("n").over(w)).cast("long").alias("scaled"))


def deltas(rows: DataFrame, value: str, key: str = "read_id") -> DataFrame:
    """(key, delta, zigzag, bytes) against the row before, in key order."""
    from seqloom.functions.sequence import varint_bytes, zigzag

    cell = F.floor(F.col(key) / 1_000_000)
    rows = rows.select(key, value, cell.alias("cell"))
    last = rows.groupBy("cell").agg(F.max_by(value, key).alias("last"))
    carried = last.select("cell", F.lag("last").over(Window.orderBy("cell")).alias("before"))
    inside = F.lag(value).over(Window.partitionBy("cell").orderBy(key))
    rows = rows.withColumn("prev", inside).join(carried, "cell")
    d = (F.col(value) - F.coalesce("prev", "before", F.lit(0))).cast("long")
    return rows.select(key, d.alias("delta"), zigzag(d).alias("zigzag"), varint_bytes(zigzag(d)).alias("bytes"))


def sequential(rows: DataFrame, group: str, place: str, name: str = "name") -> DataFrame:
    """(group, prefix, first, sequential): whether a group's names are PREFIX.N
    with N rising by one from place 0 on."""
    n = lambda c: F.regexp_extract(c, r"(?s)^.+\.([0-9]{1,18})$", 1)
    p = lambda c: F.regexp_extract(c, r"(?s)^(.+)\.[0-9]{1,18}$", 1)
    # a leading zero is allowed in the first name alone
    parsed = rows.select(group, F.col(place).alias("_at"), p(F.col(name)).alias("p"), n(F.col(name)).alias("n"))
    num = F.expr("try_cast(n as long)")
    plain = (F.col("_at") == 0) | ~F.col("n").startswith("0")
    sums = parsed.groupBy(group).agg(
        F.min("p").alias("prefix"), F.max("p").alias("_p"), F.min(num - F.col("_at")).alias("first"), F.max(num - F.col("_at")).alias("_f"),
        F.bool_and(F.coalesce(num.isNotNull() & plain, F.lit(False))).alias("_ok"))
    size = F.length("prefix")
    ok = F.col("_ok") & (F.col("prefix") == F.col("_p")) & (F.col("first") == F.col("_f")) & (F.col("first") > 0) & (size > 0) & (size < 255)
    ok = F.coalesce(ok, F.lit(False))
    return sums.select(group, F.when(ok, F.col("prefix")).alias("prefix"), F.when(ok, F.col("first")).alias("first"), ok.alias("sequential"))


def smallest(sizes: DataFrame, keys: list[str], codec: str = "codec", size: str = "bytes") -> DataFrame:
    """For each key the codec of fewest bytes, the first by name of equals."""
    best = F.min(F.struct(F.col(size), F.col(codec))).alias("b")
    return sizes.groupBy(*keys).agg(best).select(*keys, F.col(f"b.{codec}").alias(codec), F.col(f"b.{size}").alias(size))
