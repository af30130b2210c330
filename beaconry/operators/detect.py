"""The monitor: language filter, scoring, running-max dedup, confidence filter, volume anomalies and boost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Detection
from ..functions import text as X
from ..storage import written
from .anomaly import volume_anomalies
from .rules import RuleEngine


def language_filter(records: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    return records.filter(F.col("language").isin(*languages))


def running_max_dedup(scored: DataFrame, *reset: str) -> DataFrame:
    """Rows whose score is above all earlier ones of their key; `reset` columns start afresh."""
    before = Window.partitionBy(*reset, "dedup_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    best = scored.withColumn("_best", F.max("score").over(before))
    return best.filter(F.col("_best").isNull() | (F.col("score") > F.col("_best"))).drop("_best")


def with_ids(signals: DataFrame, now: Column | None = None) -> DataFrame:
    at = X.moment(F.col("timestamp"), now)
    return signals.withColumns({"signal_id": X.signal_id(F.col("dedup_key"), at), "created_at": X.iso_time(at)})


def boosted(score: Column, anomaly: Column) -> Column:
    return F.when(anomaly.isNotNull(), F.least(score * F.lit(1.15), F.lit(1.0))).otherwise(score)


def evaluate(records: DataFrame, engine: RuleEngine | None = None, now: Column | None = None) -> DataFrame:
    """What the rule engine alone emits, in order of seq."""
    return with_ids(running_max_dedup((engine or RuleEngine()).scores(records)), now)


def kept_signals(records: DataFrame, config: Detection, engine: RuleEngine | None = None, now: Column | None = None) -> DataFrame:
    """What passes language, dedup and confidence, in that order."""
    return evaluate(language_filter(records, config.languages), engine or RuleEngine(thresholds=config.thresholds), now).filter(F.col("score") >= config.min_confidence)


def payload_of(found: DataFrame) -> DataFrame:
    """seq (of the signal that it goes to) and volume_anomaly, as signals carry it."""
    fields = F.struct("bucket", "count", F.round("z_score", 2).alias("z_score"), F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))
    return found.select(F.col("next_seq").alias("seq"), fields.alias("volume_anomaly"))


def merged_metadata(metadata: Column, anomaly: Column) -> Column:
    """A record's metadata (JSON of an object) with its anomaly, which takes the place of a value of that name."""
    own = F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rest = F.map_filter(own, lambda k, _: k != "volume_anomaly")
    infinite = anomaly["z_score"] == float("inf")
    # JSON has no infinity
    plain = F.when(anomaly.isNotNull(), F.struct(anomaly["bucket"].alias("bucket"), anomaly["count"].alias("count"), F.when(~infinite, anomaly["z_score"]).alias("z_score"), anomaly["mean"].alias("mean"), anomaly["std"].alias("std")))
    return F.to_json(F.when(anomaly.isNotNull(), F.map_concat(rest, F.create_map(F.lit("volume_anomaly"), F.to_variant_object(plain)))).otherwise(own))


def with_anomalies(kept: DataFrame, found: DataFrame) -> DataFrame:
    """Signals with the anomaly of the bucket before (or null), the boost it brings, and it in their metadata."""
    out = kept.join(payload_of(found), "seq", "left").withColumn("score", boosted(F.col("score"), F.col("volume_anomaly")))
    return out.withColumn("metadata", merged_metadata(F.col("metadata"), F.col("volume_anomaly"))) if "metadata" in kept.columns else out


def monitor(records: DataFrame, config: Detection | None = None, engine: RuleEngine | None = None, bucket_seconds: int = 60, now: Column | None = None) -> DataFrame:
    """Signals of records (seq, text, source, language, timestamp, and metadata if there is any), with the anomaly of the
    bucket before, or null.

    Severity is that of the score before the boost.  What passed the filters is written, as it is read twice."""
    kept = written(kept_signals(records, config or Detection(), engine, now), "signals")
    return with_anomalies(kept, volume_anomalies(kept.select("seq", "timestamp"), bucket_seconds))
