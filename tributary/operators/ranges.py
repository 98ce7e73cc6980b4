"""Number ranges: overlaps, points inside, gaps. Half-open [s, e)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs of one owner's ranges that overlap."""
    a = ranges.select("owner", F.col("member").alias("first"), F.col("s").alias("s1"), F.col("e").alias("e1"))
    b = ranges.select("owner", F.col("member").alias("second"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return a.join(b, "owner").where("first < second and e1 > s2 and e2 > s1").select("owner", "first", "second")


def next_free(ranges: DataFrame, start: int = 1) -> DataFrame:
    """owner and the first number from ``start`` that none of its ranges has: the end of the first island."""
    before = Window.partitionBy("owner").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    used = ranges.where(F.col("e") > start).withColumn("reach", F.greatest(F.coalesce(F.max("e").over(before), F.lit(start)), F.lit(start)))
    gaps = used.groupBy("owner").agg(F.min(F.when(F.col("s") > F.col("reach"), F.col("reach"))).alias("gap"), F.max("e").alias("end"))
    free = gaps.select("owner", F.coalesce("gap", "end").alias("free"))
    return ranges.select("owner").distinct().join(free, "owner", "left").select("owner", F.coalesce("free", F.lit(start)).alias("free"))


def inside(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """owner, n for points that lie in a range of their owner."""
    hit = points.join(ranges.select(F.col("owner").alias("o"), "s", "e"), (F.col("owner") == F.col("o")) & (F.col("s") <= F.col("n")) & (F.col("n") < F.col("e")), "left_semi")
    return hit.select("owner", "n").distinct()


def repeated(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows after the first of their key: holders of a name or number that is taken."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("turn > 1").drop("turn")
