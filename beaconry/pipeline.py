"""The whole run: records to signals, alerts, classifications and reports, as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import reports
from .operators.classify import Classifier, http_transport
from .operators.detect import monitor
from .operators.notify import dispatch
from .operators.rules import RuleEngine
from .sources.records import read_records
from .storage import written
from .streaming.monitor import monitor_stream, read_stream, signal_batches


@dataclass
class Result:
    signals: DataFrame
    classifications: DataFrame | None
    sitreps: DataFrame
    errors: list[str] = field(default_factory=list)

    def summary(self) -> DataFrame:
        """One row of counts."""
        out = self.signals.agg(F.count("*").alias("total_signals"), F.count_if(F.col("severity").isin("P0", "P1")).alias("escalations"))
        out = out.crossJoin(self.sitreps.agg(F.count("*").alias("total_sitreps")))
        n = F.lit(0).cast("long") if self.classifications is None else None
        out = out.withColumn("total_classifications", n) if n is not None else out.crossJoin(self.classifications.agg(F.count("*").alias("total_classifications")))
        return out.withColumn("total_errors", F.lit(len(self.errors)).cast("long"))


class Pipeline:
    def __init__(self, spark: SparkSession, config: Config | None = None, engine: RuleEngine | None = None, classifier: Classifier | None = None, transport=http_transport):
        self.spark, self.config, self.classifier, self.transport = spark, config or Config(), classifier, transport
        self.engine = engine or RuleEngine(thresholds=self.config.detection.thresholds)

    def run(self, records: DataFrame) -> Result:
        """records: seq, text, source, language, timestamp.  Alerts and classifications, if set up, are made at once, one for
        each signal.  A classification that fails as a whole leaves its error in the result."""
        signals = monitor(records, self.config.detection, self.engine)
        if self.config.notifications.enabled and self.config.notifications.webhooks or self.classifier is not None:
            # what went out is what the result holds
            signals = written(signals, "sent")
        dispatch(signals, self.config.notifications, self.transport)
        batched = reports.batches(signals, records, self.config.detection.batch_size)
        high = reports.incidents(batched)
        results, errors = None, []
        if self.classifier is not None:
            try:
                results = written(self.classifier.classify(signals), "classified")
            except Exception as error:  # noqa: BLE001
                errors.append(f"Classification failed: {error}")
        by = None if results is None else results.join(high.select("signal_id", "incident_id", "seq"), "signal_id")
        return Result(signals, results, reports.sitreps(high, by, self.config.reports.max_signals_per_report), errors)

    def run_file(self, path: str) -> Result:
        return self.run(read_records(self.spark, path))

    def stream(self, path: str, output: str, checkpoint: str, files: int = 100, **trigger):
        """A started query over files of JSON lines that arrive in a folder: signals with anomalies, boost and metadata go to
        output (parquet, by batch), alerts to the webhooks.  trigger: as for writeStream.trigger."""
        signals = monitor_stream(read_stream(self.spark, path, files), self.config.detection, self.engine)
        writer = signals.writeStream.foreachBatch(signal_batches(self.config, output, self.transport)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
