"""Ranks and sequential numbers without a single task over a whole group or table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut


def numbered(df: DataFrame, group: list[str], order: Column, bucket: Column, out: str = "pos") -> DataFrame:
    """0-based position of each row within ``group`` by ``order``, ties in no fixed order.

    ``bucket`` must be a non-decreasing function of ``order`` (say, its quotient by a width). Each task ranks one
    bucket of a group; the offsets come from a prefix sum over the bucket counts. So a hot group is spread over tasks,
    and the table of offsets has a row for each bucket only.
    """
    d = df.withColumn("__b", bucket)
    counts = d.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group).orderBy("__b") if group else Window.orderBy("__b")
    offsets = counts.select(*group, "__b", (F.sum("__n").over(w) - F.col("__n")).alias("__o"))
    inside = F.row_number().over(Window.partitionBy(*group, "__b").orderBy(order)) - 1
    keys = [*group, "__b"]
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = d.withColumn("__i", inside).alias("l").join(offsets.alias("r"), cond)
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l.__i") + F.col("r.__o")).cast("bigint").alias(out))


def running(df: DataFrame, value: str, order: str, width: int = 4096, out: str = "before") -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``order`` (a unique whole number), as column ``out``.

    Sums run inside buckets of ``width`` numbers; only the table of bucket sums is ordered as a whole.
    """
    d = df.withColumn("__b", F.floor(F.col(order) / width))
    per = d.groupBy("__b").agg(F.sum(value).alias("__n"))
    base = per.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__o"))  # a row for each bucket
    inside = F.sum(value).over(Window.partitionBy("__b").orderBy(order)) - F.col(value)
    return d.withColumn("__i", inside).join(base, "__b").withColumn(out, F.col("__i") + F.col("__o")).drop("__b", "__i", "__o")


def picked(df: DataFrame, order: list[Column], wanted: list[int], out: str = "pos") -> DataFrame:
    """Rows at the wanted 0-based positions of the ordered table; positions out of range are skipped.

    A distributed sort, and a count for each of its partitions, of which the places of the wanted rows follow. No task
    sees more than its part, however large a position is.
    """
    places = sorted({i for i in wanted if i >= 0})
    if not places:
        return df.limit(0).withColumn(out, F.lit(0).cast("bigint"))
    done = cut(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    at: dict[int, int] = {}
    begin = 0
    for part, n in sorted(done.groupBy(F.shiftright("__id", 33)).count().collect()):
        at |= {(part << 33) + i - begin: i for i in places if begin <= i < begin + n}
        begin += n
    if not at:
        return df.limit(0).withColumn(out, F.lit(0).cast("bigint"))
    pos = F.create_map(*[F.lit(x).cast("bigint") for pair in at.items() for x in pair])
    return done.where(F.col("__id").isin(list(at))).withColumn(out, F.element_at(pos, F.col("__id"))).drop("__id")
