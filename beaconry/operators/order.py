"""Order-dependent building blocks that don't put all rows into one task.

Rows have an arrival number `seq`.  They are split by blocks of it; what each block adds up to is one row, and only those
rows are ordered globally.  Frames that look back or ahead get the few rows they need from the neighbouring blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def row_index(rows: DataFrame, name: str = "row_index", block: int = BLOCK) -> DataFrame:
    """Rows with their number, from 0, in order of seq."""
    cut = rows.withColumn("_b", F.floor(F.col("seq") / F.lit(block)))
    sums = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sums.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("seq"))
    return cut.withColumn("_own", own).join(before, "_b").withColumn(name, F.col("_own") - 1 + F.col("_before")).drop("_b", "_own", "_before")


def runs(rows: DataFrame, value: Column, block: int = BLOCK) -> DataFrame:
    """Runs of equal values in order of seq: run (from 0), value, n, first_seq.

    A block's first run goes on from the block before if that ended with the same value."""
    cut = rows.select("seq", value.alias("value"), F.floor(F.col("seq") / F.lit(block)).alias("b"))
    w = Window.partitionBy("b").orderBy("seq")
    new = (~F.lag("value").over(w).eqNullSafe(F.col("value"))).cast("int")
    local = cut.withColumn("new", new).withColumn("r", F.sum("new").over(w))
    local = local.groupBy("b", "r").agg(F.first("value").alias("value"), F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    ends = local.groupBy("b").agg(F.min_by("value", "r").alias("v0"), F.max_by("value", "r").alias("v1"), F.max("r").alias("k"))
    g = Window.orderBy("b")
    on = F.coalesce((F.lag("v1").over(g) == F.col("v0")).cast("int"), F.lit(0))
    ends = ends.withColumn("on", on)
    before = F.coalesce(F.sum(F.col("k") - F.col("on")).over(g.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("b", (before - F.col("on")).alias("shift"))
    joined = local.join(ends, "b").withColumn("run", F.col("shift") + F.col("r") - 1)
    return joined.groupBy("run").agg(F.first("value").alias("value"), F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))


def framed(rows: DataFrame, index: str, back: int, ahead: int = 0, block: int = BLOCK) -> tuple[DataFrame, Window]:
    """(rows, window by block) for frames over a contiguous index that reach `back` rows before and `ahead` rows after.

    Rows near a block's edge are copied into the next one, with _own false; drop these (own_rows) after the frames."""
    block = max(block, back + ahead + 1)
    b, at = F.floor(F.col(index) / F.lit(block)), F.pmod(F.col(index), F.lit(block))
    copy = lambda into, when: F.when(when, F.struct(into.alias("b"), F.lit(False).alias("own")))
    places = [F.struct(b.alias("b"), F.lit(True).alias("own"))]
    if back:
        places.append(copy(b + 1, at >= block - back))
    if ahead:
        places.append(copy(b - 1, at < ahead))
    dealt = rows.withColumn("_p", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull()))).withColumns({"_b": F.col("_p.b"), "_own": F.col("_p.own")}).drop("_p")
    return dealt, Window.partitionBy("_b").orderBy(index)


def own_rows(framed_rows: DataFrame) -> DataFrame:
    return framed_rows.filter("_own").drop("_own", "_b")


def trailing(x: Column, order: Window, first: int, last: int) -> tuple[Column, Column, Column]:
    """Count, mean (0 if empty) and population deviation (0 below two values) of a trailing frame."""
    w = order.rowsBetween(first, last)
    n, s, q = F.count(x).over(w), F.sum(x).over(w), F.sum(x * x).over(w)
    mean = F.when(n > 0, s / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    # whole numbers: equal values are told exactly
    var = F.when((n < 2) | (n * q == s * s), F.lit(0.0)).otherwise(F.greatest(q / F.greatest(n, F.lit(1)) - mean * mean, F.lit(0.0)))
    return n, mean, F.sqrt(var)


def z_score(x: Column, mean: Column, std: Column) -> Column:
    infinite = F.lit(float("inf"))
    return F.when(std == 0, F.when(x == mean, F.lit(0.0)).otherwise(infinite)).otherwise((x - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std))
