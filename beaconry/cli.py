"""Commands: monitor, classify, validate, report."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import SEVERITIES, Classification, Config, Notifications, Provider, Webhook
from .operators import reports
from .operators.classify import Classifier, create_provider
from .operators.evaluate import GoldenSet
from .pipeline import Pipeline
from .sources import records as io


def severity_histogram(signals):
    """Signals of each severity, zero where there are none."""
    names = signals.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return names.join(signals.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n")).orderBy("severity")


def monitor(spark, a) -> None:
    config = Config.load(a.config) if a.config else Config()
    if a.webhook and not a.dry_run:
        config = replace(config, notifications=Notifications(True, tuple(Webhook(u) for u in a.webhook), a.min_severity))
    signals = Pipeline(spark, config).run_file(a.source).signals
    kept = signals.filter(F.col("severity") <= a.min_severity)
    if a.dry_run:
        rows = severity_histogram(kept).collect()
        for r in rows:
            print(f"{r['severity']}  {r['n']}")
        print(f"records scanned: {signals.count()}  signals that would be emitted: {sum(r['n'] for r in rows)}")
        if a.output:
            print(f"output would have been written to: {a.output}")
        return
    if a.output:
        io.write_signals(kept, a.output)
        print(f"Processed. {kept.count()} signals detected.")
        return
    n = 0
    for r in kept.orderBy("seq").select("severity", "signal_id", F.substring("text", 1, 100).alias("text")).toLocalIterator():
        n += 1
        print(f"[{r['severity']}] {r['signal_id']} | {r['text']}")
    print(f"Processed. {n} signals detected.")


def classify(spark, a, transport=None) -> None:
    config = Provider(provider=a.provider, model=a.model)
    provider = create_provider(config, transport) if transport else create_provider(config)
    results = Classifier(provider, Classification(llm=config)).classify(io.read_signals(spark, a.input)).persist()
    for r in results.select("signal_id", "severity", F.transform("labels", lambda x: x["incident_type"]).alias("t")).toLocalIterator():
        print(f"  {r['signal_id']}: {r['severity']} -> {list(r['t'])}")
    if a.output:
        io.write_results(results, a.output)
        print(f"Results written to {a.output}")


def validate(spark, a) -> None:
    found = GoldenSet(io.read_golden(spark, a.golden_set)).evaluate(io.read_predictions(spark, a.predictions), a.threshold)
    for r in found["per_label"].orderBy("label").collect():
        print(f"{r['label']:30s} {r['precision']:.3f} {r['recall']:.3f} {r['f1']:.3f}")
    m, s = found["macro"].first(), found["severity"].first()
    if m and s:
        print(f"\nMacro P={m['macro_precision']:.3f}  R={m['macro_recall']:.3f}  F1={m['macro_f1']:.3f}\nSeverity accuracy: {s['severity_accuracy']:.3f}")
    modes = found["failure_modes"].orderBy("rank", "label").collect()
    if modes:
        print("\nFailure modes:")
    for r in modes:
        print(f"  - {r['mode']}")


def report(spark, a) -> None:
    found = None
    if a.signals:
        signals = io.read_signals(spark, a.signals).withColumn("incident_id", F.lit(a.incident_id))
        found = reports.sitreps(signals)
    if found is None or found.isEmpty():
        found = reports.empty_sitrep(spark, a.incident_id)
    created = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss+00:00")
    if a.format == "markdown":
        text = reports.sitrep_markdown(found, created, True).first()["markdown"]
    else:
        text = json.dumps(json.loads(found.withColumn("created_at", created).toJSON().first()), indent=2)
    if a.output:
        io.write_report(text, a.output)
        print(f"Report written to {a.output}")
    else:
        print(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="beaconry")
    sub = top.add_subparsers(dest="command", required=True)
    m = sub.add_parser("monitor", help="signals of a file of JSON lines")
    m.add_argument("--source", required=True)
    m.add_argument("--config")
    m.add_argument("--min-severity", default="P4", choices=SEVERITIES)
    m.add_argument("--output", "-o")
    m.add_argument("--dry-run", action="store_true")
    m.add_argument("--webhook", action="append", default=[])
    c = sub.add_parser("classify", help="classifications of a file of signals")
    c.add_argument("--input", required=True)
    c.add_argument("--model", default=Provider.model)
    c.add_argument("--provider", default=Provider.provider)
    c.add_argument("--output", "-o")
    v = sub.add_parser("validate", help="predictions against a golden set")
    v.add_argument("--golden-set", required=True)
    v.add_argument("--predictions", required=True)
    v.add_argument("--threshold", type=float, default=0.5)
    r = sub.add_parser("report", help="situation report of an incident")
    r.add_argument("--incident-id", required=True)
    r.add_argument("--signals")
    r.add_argument("--format", default="markdown", choices=("markdown", "json"))
    r.add_argument("--output", "-o")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("beaconry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    {"monitor": monitor, "classify": classify, "validate": validate, "report": report}[a.command](spark, a)


if __name__ == "__main__":
    main()
