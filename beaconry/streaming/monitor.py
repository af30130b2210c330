"""The monitor over streams: stateful dedup by key, volume anomalies carried from micro-batch to micro-batch, alerts.

Arrival is the order: files come in order of their modification time, and what a later file brings is later, whatever
its seq; within a micro-batch rows go by seq.  A stream whose files arrive in order of seq gives what the batch monitor
gives.  State outlives batches; a time to live of the dedup state is an extension, off by default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Detection
from ..operators.anomaly import bucket_of, flagged, timed
from ..operators.classify import http_transport
from ..operators.detect import language_filter, with_anomalies, with_ids
from ..operators.notify import dispatch
from ..operators.order import BLOCK, framed, own_rows, runs
from ..operators.rules import RuleEngine
from ..sources.records import parse_records


def read_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Records of JSON lines in files that arrive in a folder; {"seq": n} in a line gives the order, else the time read."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(path)
    seq = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.seq", "bigint"), F.unix_micros(F.current_timestamp()))
    return parse_records(lines.select(seq.alias("seq"), "value"))


def dedup_stream(scored: DataFrame, ttl_seconds: int | None = None) -> DataFrame:
    """Rows whose score is above all earlier ones of their key, across micro-batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    columns = [c for c in scored.columns if c != "dedup_key"]

    def keep(key, parts: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([p for p in parts if len(p)]).sort_values("seq", kind="stable")
        best = state.get[0] if state.exists else float("-inf")
        top = rows["score"].cummax().shift(fill_value=best).clip(lower=best)
        out = rows[rows["score"] > top]
        state.update((max(best, float(rows["score"].max())),))
        if ttl_seconds:
            state.setTimeoutDuration(1000 * ttl_seconds)
        if len(out):
            yield out.assign(dedup_key=key[0])[[*columns, "dedup_key"]]

    schema = ", ".join(f"`{c}` {t}" for c, t in [*((c, t) for c, t in scored.dtypes if c != "dedup_key"), ("dedup_key", "string")])
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_seconds else GroupStateTimeout.NoTimeout
    return scored.groupBy("dedup_key").applyInPandasWithState(keep, schema, "best double", "append", timeout)


def monitor_stream(records: DataFrame, config: Detection | None = None, engine: RuleEngine | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """Signals of a stream of records: language filter, scores, dedup, confidence.  signal_batches adds anomalies."""
    config = config or Detection()
    scored = (engine or RuleEngine(thresholds=config.thresholds)).scores(language_filter(records, config.languages))
    return with_ids(dedup_stream(scored, ttl_seconds).filter(F.col("score") >= config.min_confidence))


def volume_stream(signals: DataFrame, by: str | None = None, seconds: int = 60, history: int = 60, threshold: float = 2.5, least: int = 10) -> DataFrame:
    """Anomalous completed buckets of a stream of signals (seq, timestamp): key, bucket, count, z_score, mean, std, next_seq.

    Without `by` there is one detector, as in batch form, and one state; with it one for each value."""

    def watch(key, parts: Iterator, state) -> Iterator:
        import pandas as pd

        rows = pd.concat([p for p in parts if len(p)]).sort_values("seq", kind="stable")
        bucket, n, seen = state.get if state.exists else (None, 0, [])
        seen, out = list(seen), []
        for seq, t in zip(rows["seq"], rows["timestamp"]):
            b = int(t) // seconds
            if bucket is not None and b != bucket:
                mean = sum(seen) / len(seen) if seen else 0.0
                spread = lambda x: (max(sum(v * v for v in x) / len(x) - (sum(x) / len(x)) ** 2, 0.0)) ** 0.5 if len(set(x)) > 1 else 0.0
                std = spread(seen)
                z = (n - mean) / std if std else 0.0 if n == mean else float("inf")
                ready, seen = len(seen) >= least, [*seen, n][-history:]
                if ready and z > threshold:
                    out.append((str(key[0]), bucket, n, z, sum(seen) / len(seen), spread(seen), int(seq)))
                n = 0
            bucket, n = b, n + 1
        state.update((bucket, n, [int(v) for v in seen]))
        if out:
            yield pd.DataFrame(out, columns=["key", "bucket", "count", "z_score", "mean", "std", "next_seq"])

    timed = signals.filter((F.col("timestamp") > 0) & ~F.isnan("timestamp")).select("seq", "timestamp", (F.col(by) if by else F.lit("all")).alias("key"))
    schema = "key string, bucket long, count long, z_score double, mean double, std double, next_seq long"
    return timed.groupBy("key").applyInPandasWithState(watch, schema, "bucket long, n long, seen array<long>", "append", "NoTimeout")


def event_time_counts(signals: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Extension: signals per tumbling window of event time, with a watermark for late ones."""
    timed = signals.withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", f"{seconds} seconds")).agg(F.count("*").alias("n"))


def carried_anomalies(kept: DataFrame, state: str, number: int, seconds: int = 60, history: int = 60, threshold: float = 2.5, least: int = 10, block: int = BLOCK) -> DataFrame:
    """Anomalies of micro-batch `number`, as volume_anomalies gives them for all batches so far; next_seq lies in this one.

    What goes from batch to batch is one small table: the last `history` completed runs and the open one.  Each batch
    writes its own, so one that is repeated after a failure starts from the same."""
    spark = kept.sparkSession
    kind = "run long, bucket long, n long"
    # at most history + 1 rows
    old = [tuple(r) for r in spark.read.schema(kind).parquet(f"{state}/{number - 1}").orderBy("run").collect()] if number else []
    now = runs(timed(kept.select("seq", "timestamp")), bucket_of(seconds), block).withColumnRenamed("value", "bucket").select("run", "bucket", "n", "first_seq")
    first = now.filter("run = 0").first()
    on = bool(old and first and old[-1][1] == first["bucket"])
    more = F.lit(old[-1][2] if on else 0)
    if on:
        old = old[:-1]
    before = spark.createDataFrame([(k, b, n) for k, (_, b, n) in enumerate(old)], kind).withColumn("first_seq", F.lit(None).cast("long"))
    now = now.select((F.col("run") + len(old)).alias("run"), "bucket", (F.col("n") + F.when(F.col("run") == 0, more).otherwise(0)).alias("n"), "first_seq")
    all_ = before.unionByName(now).persist()
    try:
        n = all_.count()
        all_.filter(F.col("run") >= n - history - 1).select(*(F.col(c).cast("long") for c in ("run", "bucket", "n"))).coalesce(1).write.mode("overwrite").parquet(f"{state}/{number}")
        placed, w = framed(all_, "run", 0, 1, block)
        completed = own_rows(placed.withColumn("next_seq", F.lead("first_seq").over(w)))
        rows = flagged(completed, history, threshold, least, block)
        # anomalies of one micro-batch; at most one for each bucket that ended in it
        out = rows.persist()
        out.count()
        return out
    finally:
        all_.unpersist()


def signal_batches(config: Config, output: str, transport: Callable = http_transport, seconds: int = 60) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on monitor_stream: adds each micro-batch's anomalies, writes its signals to output/batch=number and
    delivers its alerts.  A batch repeated after a failure is written over; receivers of alerts go by signal_id."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        found = None
        try:
            found = carried_anomalies(kept, f"{output}/_volume", number, seconds)
            signals = with_anomalies(kept, found)
            signals.write.mode("overwrite").parquet(f"{output}/batch={number}")
            if config.notifications.enabled and config.notifications.webhooks:
                dispatch(kept.sparkSession.read.schema(signals.schema).parquet(f"{output}/batch={number}"), config.notifications, transport)
        finally:
            kept.unpersist()
            if found is not None:
                found.unpersist()

    return run
