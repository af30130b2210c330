"""Volume and velocity anomalies over buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import BLOCK, framed, own_rows, row_index, runs, trailing, z_score


def bucket_of(seconds: int) -> Column:
    return F.floor(F.col("timestamp").cast("long") / F.lit(seconds))


def timed(rows: DataFrame) -> DataFrame:
    """Rows with a set time: above zero and a number."""
    return rows.filter((F.col("timestamp") > 0) & ~F.isnan("timestamp"))


def buckets(rows: DataFrame, seconds: int = 60, block: int = BLOCK) -> DataFrame:
    """Completed runs of one bucket in arrival order: run, bucket, n, first_seq, next_seq.  The last run isn't complete.

    rows: seq, timestamp (seconds); unset times (zero or less) don't count."""
    all_, w = framed(runs(timed(rows), bucket_of(seconds), block).withColumnRenamed("value", "bucket"), "run", 0, 1, block)
    return own_rows(all_.withColumn("next_seq", F.lead("first_seq").over(w)))


def volume_anomalies(rows: DataFrame, seconds: int = 60, history: int = 60, threshold: float = 2.5, least: int = 10, block: int = BLOCK) -> DataFrame:
    """run, bucket, count, z_score, mean, std of anomalous completed runs, and next_seq, the row that each goes to."""
    return flagged(buckets(rows, seconds, block), history, threshold, least, block)


def flagged(completed: DataFrame, history: int = 60, threshold: float = 2.5, least: int = 10, block: int = BLOCK) -> DataFrame:
    """The anomalous ones of runs (run, bucket, n, next_seq; those without next_seq aren't complete).

    z is taken against up to `history` runs before; mean and std are those of the frame that ends with the run."""
    done, w = framed(completed.select("run", "bucket", F.col("n").cast("long").alias("n"), "next_seq"), "run", history, block=block)
    n = F.col("n")
    seen, mean, std = trailing(n, w, -history, -1)
    _, mean2, std2 = trailing(n, w, 1 - history, 0)
    scored = done.select("_b", "_own", "run", "bucket", n.alias("count"), "next_seq", seen.alias("seen"), z_score(n, mean, std).alias("z_score"), mean2.alias("mean"), std2.alias("std"))
    return own_rows(scored).filter(F.col("next_seq").isNotNull() & (F.col("seen") >= least) & (F.col("z_score") > threshold)).drop("seen")


def velocity_anomalies(counts: DataFrame, window: int = 30, threshold: float = 3.0, least: int = 5, block: int = BLOCK) -> DataFrame:
    """seq, delta, z_score, mean_delta of anomalous changes between successive counts.  counts: seq, x."""
    rows, w = framed(row_index(counts.select("seq", "x"), "_k"), "_k", window + 1, block=block)
    d = rows.withColumn("d", (F.col("x") - F.lag("x").over(w)).cast("long"))
    seen, mean, std = trailing(F.col("d"), w, -window, -1)
    _, mean2, _ = trailing(F.col("d"), w, 1 - window, 0)
    scored = d.select("_b", "_own", "seq", F.col("d").cast("double").alias("delta"), seen.alias("seen"), z_score(F.col("d"), mean, std).alias("z_score"), mean2.alias("mean_delta"))
    return own_rows(scored).filter(F.col("delta").isNotNull() & (F.col("seen") >= least) & (F.col("z_score") > threshold)).drop("seen")


def sliding_stats(rows: DataFrame, value: Column, size: int, block: int = BLOCK) -> DataFrame:
    """seq, n, mean, std of the last `size` values, each row's own included, and z_score against those before it."""
    source, w = framed(row_index(rows.select("seq", value.alias("x")), "_k"), "_k", size, block=block)
    n, mean, std = trailing(F.col("x"), w, 1 - size, 0)
    _, mean0, std0 = trailing(F.col("x"), w, -size, -1)
    return own_rows(source.select("_b", "_own", "seq", n.alias("n"), mean.alias("mean"), std.alias("std"), z_score(F.col("x"), mean0, std0).alias("z_score")))
