"""Time-boxed replay: greedy windows anchored at records, each with its own dedup state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import RuleEngine


#: windows of time that one task walks through; a later block waits for nothing but its first anchor
SPAN = 16


def chains(t, seconds: float):
    """For sorted times: the last anchor of the chain that starts at each one, how many anchors it has, and the next place."""
    import numpy as np

    to = np.searchsorted(t, t + seconds, "left")
    last, n = t.copy(), np.ones(len(t), np.int64)
    for k in range(len(t) - 1, -1, -1):
        if to[k] < len(t):
            last[k], n[k] = last[to[k]], n[to[k]] + 1
    return last, n, to


def anchors(records: DataFrame, seconds: float = 300.0, span: int = SPAN) -> DataFrame:
    """window_id, anchor: the first time, and each first time at or past the last anchor plus the window's length.

    Each anchor follows from the one before.  Blocks of `span` windows of time are walked through in parallel, from every
    time that their first anchor can be: one within a window's length of the block's start, or the first one after
    that.  These alone, a small part of the distinct times, are then followed from block to block in one task, which
    gives each block its first anchor and the number of the windows before it."""
    import numpy as np
    import pandas as pd

    size = float(seconds * span)
    times = records.select(F.col("timestamp").cast("double").alias("t")).filter("t is not null").distinct().withColumn("block", F.floor(F.col("t") / F.lit(size)))

    def entries(key, rows):
        t = np.sort(rows["t"].to_numpy())
        start = key[0] * size
        last, n, _ = chains(t, seconds)
        many = min(int(np.searchsorted(t, start + seconds, "left")) + 1, len(t))
        return pd.DataFrame({"block": key[0], "first": t[:many], "last": last[:many], "n": n[:many]})

    def follow(it):
        import pyarrow as pa

        last, done, k = None, None, 0
        for b in it:
            out = []
            for block, first, end, n in zip(*(c.to_pylist() for c in b.columns)):
                if block != done and (last is None or first >= last + seconds):
                    out.append((block, first, k))
                    last, done, k = end, block, k + n
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.int64()))], ["block", "first", "before"])

    ways = times.groupBy("block").applyInPandas(entries, "block long, first double, last double, n long")
    begun = ways.repartition(1).sortWithinPartitions("block", "first").mapInArrow(follow, "block long, first double, before long")

    def walk(key, left, right):
        if not len(right):
            return pd.DataFrame({"window_id": [], "anchor": []})
        t = np.sort(left["t"].to_numpy())
        _, _, to = chains(t, seconds)
        out, k = [], int(np.searchsorted(t, right["first"].iloc[0]))
        while k < len(t):
            out.append(t[k])
            k = int(to[k])
        return pd.DataFrame({"window_id": int(right["before"].iloc[0]) + np.arange(len(out)), "anchor": out})

    return times.groupBy("block").cogroup(begun.groupBy("block")).applyInPandas(walk, "window_id long, anchor double")


def windows(records: DataFrame, seconds: float = 300.0) -> DataFrame:
    """Records with window_id.  A window lies in its anchor's cell of time or in that and the next: an equi-join finds it."""
    cell = lambda c: F.floor(c / F.lit(float(seconds)))
    near = anchors(records, seconds).withColumn("_cell", F.explode(F.array(cell(F.col("anchor")), cell(F.col("anchor")) + 1)))
    placed = records.withColumn("_cell", cell(F.col("timestamp"))).join(near, "_cell")
    return placed.filter((F.col("timestamp") >= F.col("anchor")) & (F.col("timestamp") < F.col("anchor") + F.lit(float(seconds)))).drop("_cell", "anchor")


def replay(records: DataFrame, seconds: float = 300.0, engine: RuleEngine | None = None) -> DataFrame:
    """Signals per window.  The engine alone decides: no language, confidence or anomaly step."""
    placed = windows(records, seconds)
    # arrival order within equal times
    scored = (engine or RuleEngine()).scores(placed)
    before = Window.partitionBy("window_id", "dedup_key").orderBy("timestamp", "seq").rowsBetween(Window.unboundedPreceding, -1)
    best = scored.withColumn("_best", F.max("score").over(before))
    return best.filter(F.col("_best").isNull() | (F.col("score") > F.col("_best"))).drop("_best")


def timeline(records: DataFrame, seconds: float = 300.0, engine: RuleEngine | None = None) -> DataFrame:
    """window, start, end, records, signals"""
    placed = windows(records, seconds)
    base = placed.groupBy(F.col("window_id").alias("window")).agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("records"))
    hits = replay(records, seconds, engine).groupBy(F.col("window_id").alias("window")).agg(F.count("*").alias("signals"))
    return base.join(hits, "window", "left").withColumn("signals", F.coalesce("signals", F.lit(0)))


def totals(lines: DataFrame) -> DataFrame:
    """total_records, total_signals, total_windows, detection_rate, first_detection (window, or null)."""
    out = lines.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total_records"), F.coalesce(F.sum("signals"), F.lit(0)).alias("total_signals"), F.count("*").alias("total_windows"), F.min(F.when(F.col("signals") > 0, F.col("window"))).alias("first_detection"))
    return out.withColumn("detection_rate", F.when(F.col("total_records") > 0, F.col("total_signals") / F.greatest("total_records", F.lit(1))).otherwise(F.lit(0.0)))


def summary(row) -> str:
    first = "none" if row["first_detection"] is None else f"window {row['first_detection']}"
    return f"Simulation: {row['total_records']} records, {row['total_signals']} signals, {row['total_windows']} windows, detection rate {row['detection_rate']:.3f}, first detection at {first}"


