"""Readers of records, signals, golden sets and predictions, and writers of signals, results and reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INCIDENT_TYPES
from ..functions.text import is_blank

RECORD = "seq bigint, text string, source string, language string, timestamp double, metadata string"
SIGNAL = "signal_id string, text string, source string, language string, score double, severity string, matched_rules array<string>, suggested_types array<string>, dedup_key string, created_at string"
GOLDEN = "example_id string, text string, source string, language string, true_labels array<string>, true_severity string, notes string"


def parse_records(lines: DataFrame) -> DataFrame:
    """Records of lines (seq, value).  Blank lines, bad JSON and wrong types are left out; a valid line that isn't an
    object is too.  Numeric strings are taken as timestamps; unset fields get their defaults."""
    v = F.try_parse_json("value")
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    rows = lines.filter(~is_blank(F.col("value"))).select("seq", v.alias("_v")).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    raw = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(raw(name)), F.lit("ABSENT"))
    typed = rows.select("seq", "_v", *[kind(n).alias(f"_{n}") for n in ("text", "source", "language", "timestamp", "metadata")])
    ok = (F.col("_text") == "STRING") & F.col("_source").isin("STRING", "ABSENT") & F.col("_language").isin("STRING", "ABSENT")
    number = get("$.timestamp", "double")
    ok &= (F.col("_timestamp") == "ABSENT") | ((F.col("_timestamp") != "VOID") & number.isNotNull())
    ok &= (F.col("_metadata") == "ABSENT") | F.col("_metadata").startswith("OBJECT")
    return typed.filter(ok).select(
        "seq",
        get("$.text", "string").alias("text"),
        F.coalesce(get("$.source", "string"), F.lit("unknown")).alias("source"),
        F.coalesce(get("$.language", "string"), F.lit("en")).alias("language"),
        F.coalesce(number, F.lit(0.0)).alias("timestamp"),
        F.coalesce(F.to_json(raw("metadata")), F.lit("{}")).alias("metadata"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; seq grows with the lines of a file.  A missing path raises."""
    return parse_records(spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), "value"))


def records_from(df: DataFrame, order: str | None = None) -> DataFrame:
    """Any DataFrame with a text column as records: defaults for what is absent, arrival order from `order`."""
    have = set(df.columns)
    part = lambda name, kind, default: (F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in have else F.lit(default)).alias(name)
    seq = F.col(order).cast("long") if order else F.col("seq").cast("long") if "seq" in have else F.monotonically_increasing_id()
    return df.filter("text is not null").select(seq.alias("seq"), F.col("text").cast("string"), part("source", "string", "unknown"), part("language", "string", "en"), part("timestamp", "double", 0.0), part("metadata", "string", "{}"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden examples of one JSON array, with pos."""
    rows = spark.read.option("multiLine", True).schema(GOLDEN).json(path)
    filled = rows.select("example_id", "text", F.coalesce("source", F.lit("golden_set")).alias("source"), F.coalesce("language", F.lit("en")).alias("language"), "true_labels", F.coalesce("true_severity", F.lit("P4")).alias("true_severity"), F.coalesce("notes", F.lit("")).alias("notes"))
    return filled.withColumn("pos", F.monotonically_increasing_id())


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of JSON lines, with pos; a bad line, a missing id or an unknown label raises."""
    kinds = "example_id string, predicted_labels array<string>, predicted_severity string, confidence double"
    rows = spark.read.schema(kinds).option("mode", "FAILFAST").json(path)
    labels = F.coalesce("predicted_labels", F.array().cast("array<string>"))
    known = F.forall(labels, lambda x: x.isin(*INCIDENT_TYPES))
    checked = F.when(known, labels).otherwise(F.raise_error(F.concat(F.lit("unknown label in "), F.to_json(labels))).cast("array<string>"))
    named = F.coalesce("example_id", F.raise_error(F.lit("a prediction has no example_id")).cast("string"))
    return rows.select(named.alias("example_id"), checked.alias("predicted_labels"), F.coalesce("predicted_severity", F.lit("P4")).alias("predicted_severity"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.monotonically_increasing_id().alias("pos"))


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Signals of JSON lines for reports and classification, with their defaults and seq."""
    rows = spark.read.schema(SIGNAL).json(path)
    none = F.array().cast("array<string>")
    defaults = {"signal_id": F.lit("UNKNOWN"), "text": F.lit(""), "source": F.lit("cli"), "language": F.lit("en"), "score": F.lit(0.5), "severity": F.lit("P4"), "matched_rules": none, "suggested_types": none, "dedup_key": F.lit(""), "created_at": F.lit("")}
    return rows.select(*[F.coalesce(c, d).alias(c) for c, d in defaults.items()]).withColumn("seq", F.monotonically_increasing_id())


def signal_lines(signals: DataFrame) -> DataFrame:
    return signals.select(F.to_json(F.struct("signal_id", "severity", F.round("score", 3).alias("score"), F.col("suggested_types").alias("types"), F.col("matched_rules").alias("rules"), F.substring("text", 1, 200).alias("text"))).alias("value"))


def write_signals(signals: DataFrame, path: str) -> None:
    signal_lines(signals).write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_report(text: str, path: str) -> None:
    Path(path).write_text(text, encoding="utf8")

