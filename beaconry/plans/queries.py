"""Registered queries: one callable (spark, sf_dir) for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import severity_histogram as histogram
from ..config import Config, Detection, Notifications, Thresholds, Webhook
from ..functions import text as X
from ..functions.vocabulary import TERMS
from ..operators import anomaly, classify, detect, evaluate, notify, order, reports, simulate
from ..operators.rules import KeywordRule, PatternRule, RuleEngine
from .inputs import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: 05:00 on 1 January 2024, in place of the clock
NOW = "timestamp_seconds(1704085200)"
THRESHOLDS = [0.0, 0.3, 0.5, 0.7, 0.9]
#: words of the invented prose, for rules over the raw documents
FREQUENT = {"en": ["the", "thand", "thatin"], "es": ["de", "que"], "fr": ["le", "des"], "de": ["der", "die"]}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(c):
    return F.array_join(c, ",")


def r6(c):
    return F.round(c, 6)


def feed(spark, d):
    return derived(spark, d, "feed")


def signals(spark, d):
    return detect.monitor(feed(spark, d))


def documents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("doc_id").alias("seq"), "text", "source", F.col("lang").alias("language"), F.lit(0.0).alias("timestamp"))


def events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("timestamp"))


@query
def language_filter(spark, d):
    return detect.language_filter(feed(spark, d), Detection().languages).select("seq", "language")


@query
def blank_filter(spark, d):
    padded = feed(spark, d).withColumn("text", F.when(F.col("seq") % 6 == 0, F.lit(" \t 　")).otherwise(F.col("text")))
    return padded.filter(~X.is_blank(F.col("text"))).select("seq", "text")


@query
def vocabulary(spark, d):
    rows = [(c, x, k, t) for c, by in TERMS.items() for x, ts in by.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, "category string, language string, pos int, term string")


def _keyword(category):
    def run(spark, d):
        rule = KeywordRule(category, [category])
        return feed(spark, d).select("seq", r6(rule.score()).alias("score")).filter("score > 0")

    return run


for _c in TERMS:
    QUERIES[f"keyword_{_c}"] = _keyword(_c)


@query
def keyword_fallback(spark, d):
    """Pooled categories, custom terms and the English lists for other languages."""
    rule = KeywordRule("all", custom_terms={"it": ["quiet day", "park"], "de": ["und"]})
    return feed(spark, d).select("seq", "language", r6(rule.score()).alias("score"))


@query
def keyword_documents(spark, d):
    """Custom terms over whole raw documents."""
    docs = documents(spark, d)
    rule = KeywordRule("frequent", ["none"], custom_terms=FREQUENT)
    return docs.select("seq", r6(rule.score()).alias("score"))


def posts(spark, d):
    return derived(spark, d, "posts")


@query
def keyword_posts(spark, d):
    """All categories over whole texts."""
    return posts(spark, d).select("seq", *[r6(KeywordRule(c, [c]).score()).alias(c) for c in TERMS])


@query
def rule_engine_posts(spark, d):
    out = RuleEngine().scores(posts(spark, d))
    return out.select("seq", r6("score").alias("score"), "severity", joined("matched_rules").alias("matched_rules"), joined("suggested_types").alias("suggested_types"), "dedup_key")


@query
def prompt_posts(spark, d):
    prompt = classify.user_prompt(F.col("text"), F.col("source"), F.col("language"))
    return posts(spark, d).select("seq", F.sha2(prompt, 256).alias("prompt"))


@query
def signal_metadata(spark, d):
    """A record's own metadata, and the anomaly that takes the place of a value of its name."""
    rows = feed(spark, d).withColumn("metadata", F.concat(F.lit('{"k": '), F.col("seq").cast("string"), F.when(F.col("seq") % 3 == 0, ', "volume_anomaly": {"count": -1}').otherwise(""), F.lit("}")))
    get = lambda path: F.get_json_object("metadata", path).cast("long")
    return detect.monitor(rows).select("seq", get("$.k").alias("k"), get("$.volume_anomaly.count").alias("anomaly_count"), get("$.volume_anomaly.bucket").alias("anomaly_bucket"))


@query
def pattern_rule(spark, d):
    rule = PatternRule("p", [r"https?://\S+", r"case \d*7\b", r"ATTENTAT|tornado"])
    return feed(spark, d).select("seq", r6(rule.score()).alias("score")).filter("score > 0")


@query
def rule_engine(spark, d):
    out = RuleEngine().scores(feed(spark, d))
    return out.select("seq", r6("score").alias("score"), "severity", joined("matched_rules").alias("matched_rules"), joined("suggested_types").alias("suggested_types"), "dedup_key")


@query
def matched_rules(spark, d):
    return RuleEngine().scores(feed(spark, d)).select(F.explode("matched_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query
def suggested_types(spark, d):
    return RuleEngine().scores(feed(spark, d)).groupBy(joined("suggested_types").alias("types")).agg(F.count("*").alias("n"))


@query
def dedup_key(spark, d):
    return documents(spark, d).select("seq", X.dedup_key(F.col("text")).alias("dedup_key"))


@query
def dedup_running_max(spark, d):
    return detect.running_max_dedup(RuleEngine().scores(feed(spark, d))).select("seq", "dedup_key", r6("score").alias("score"))


@query
def min_confidence(spark, d):
    """The filter stands behind dedup: a weak record still holds back later copies."""
    found = detect.monitor(feed(spark, d), Detection(min_confidence=0.9), bucket_seconds=10**9)
    return found.select("seq", r6("score").alias("score"))


@query
def severity_assign(spark, d):
    grid = feed(spark, d).select("seq", (F.col("seq") % 101 / F.lit(100.0)).alias("score"))
    return grid.select("seq", X.severity(F.col("score"), Thresholds()).alias("severity"))


@query
def severity_filter(spark, d):
    return signals(spark, d).filter(F.col("severity") <= "P1").select("seq", "severity")


@query
def severity_histogram(spark, d):
    return histogram(signals(spark, d).filter(F.col("severity") <= "P3"))


@query
def escalation_count(spark, d):
    return signals(spark, d).agg(F.count("*").alias("signals"), F.count_if(F.col("severity").isin("P0", "P1")).alias("escalations"))


@query
def signal_id(spark, d):
    rows = feed(spark, d).withColumn("timestamp", F.when(F.col("seq") % 4 == 0, 0.0).when(F.col("seq") % 4 == 1, F.col("timestamp") + 0.25).otherwise(F.col("timestamp")))
    return detect.evaluate(rows, now=F.expr(NOW)).select("seq", "signal_id", "created_at")


@query
def monitor_signals(spark, d):
    out = signals(spark, d)
    a = F.col("volume_anomaly")
    return out.select("seq", "signal_id", "source", "language", r6("score").alias("score"), "severity", joined("matched_rules").alias("matched_rules"), joined("suggested_types").alias("suggested_types"), "dedup_key", "created_at", a["bucket"].alias("anomaly_bucket"), a["count"].alias("anomaly_count"))


@query
def anomaly_boost(spark, d):
    return signals(spark, d).filter("volume_anomaly is not null").select("seq", r6("score").alias("score"), "severity")


@query
def volume_buckets(spark, d):
    return anomaly.buckets(events(spark, d), 3600).filter("next_seq is not null").select("run", "bucket", "n")


@query
def volume_anomaly(spark, d):
    out = anomaly.volume_anomalies(events(spark, d), 3600)
    return out.select("bucket", "count", r6("z_score").alias("z_score"), r6("mean").alias("mean"), r6("std").alias("std"), "next_seq")


def _counts(spark, d):
    return anomaly.buckets(events(spark, d), 3600).select(F.col("run").alias("seq"), F.col("n").alias("x"))


@query
def velocity_anomaly(spark, d):
    return anomaly.velocity_anomalies(_counts(spark, d)).select("seq", "delta", r6("z_score").alias("z_score"), r6("mean_delta").alias("mean_delta"))


@query
def sliding_stats(spark, d):
    out = anomaly.sliding_stats(_counts(spark, d), F.col("x"), 20).filter("seq >= 2")
    return out.select("seq", "n", r6("mean").alias("mean"), r6("std").alias("std"), r6("z_score").alias("z_score"))


@query
def row_batches(spark, d):
    """Arrival numbers have gaps."""
    rows = order.row_index(feed(spark, d).select((F.col("seq") * 3 + F.col("seq") % 2).alias("seq")), block=64)
    return rows.select("seq", F.floor(F.col("row_index") / 64).alias("batch"))


def _eval(spark, d, thresholds):
    return evaluate.joined(derived(spark, d, "golden"), derived(spark, d, "predictions"), thresholds)


def _stats(spark, d, thresholds):
    return evaluate.per_label(_eval(spark, d, thresholds), evaluate.universe(derived(spark, d, "golden")))


@query
def golden_join(spark, d):
    return _eval(spark, d, [0.5]).select("example_id", "pos", joined("true_labels").alias("true_labels"), "true_severity", "found", joined("counted_labels").alias("counted_labels"), "predicted_severity", "confidence")


@query
def label_universe(spark, d):
    return evaluate.universe(derived(spark, d, "golden"))


@query
def confusion_per_label(spark, d):
    return _stats(spark, d, [0.5]).select("label", "tp", "fp", "fn", "tn")


@query
def label_prf(spark, d):
    return _stats(spark, d, [0.0]).select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def macro_metrics(spark, d):
    return evaluate.macro(_stats(spark, d, [0.5])).select(*[r6(c).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


@query
def severity_accuracy(spark, d):
    return evaluate.severity_accuracy(_eval(spark, d, [0.5])).select("total_examples", r6("severity_accuracy").alias("severity_accuracy"))


@query
def fn_audit(spark, d):
    return evaluate.audit(_eval(spark, d, [0.5])).select("example_id", "text_preview", joined("missed_labels").alias("missed_labels"), joined("predicted_labels").alias("predicted_labels"), "confidence")


@query
def failure_modes(spark, d):
    rows = _eval(spark, d, [0.5])
    stats = evaluate.per_label(rows, evaluate.universe(derived(spark, d, "golden")))
    return evaluate.failure_modes(stats, evaluate.audit(rows)).select("rank", "label", "mode")


@query
def threshold_sweep(spark, d):
    return evaluate.macro(_stats(spark, d, THRESHOLDS)).select("threshold", *[r6(c).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")])


@query
def simulation_windows(spark, d):
    return simulate.windows(feed(spark, d)).select("seq", "window_id")


@query
def simulation_signals(spark, d):
    return simulate.replay(feed(spark, d)).select("seq", "window_id", r6("score").alias("score"))


@query
def simulation_timeline(spark, d):
    return simulate.timeline(feed(spark, d))


@query
def detection_rate(spark, d):
    return simulate.totals(simulate.timeline(feed(spark, d))).select("total_records", "total_signals", "total_windows", r6("detection_rate").alias("detection_rate"))


@query
def first_detection(spark, d):
    return simulate.totals(simulate.timeline(feed(spark, d))).select("first_detection")


def _incidents(spark, d):
    rows = feed(spark, d)
    return reports.incidents(reports.batches(detect.monitor(rows), rows))


def _sitreps(spark, d):
    return reports.sitreps(_incidents(spark, d), max_signals=5)


@query
def batch_sitrep(spark, d):
    return _incidents(spark, d).select("seq", "batch", "incident_id")


@query
def sitrep_metrics(spark, d):
    m = F.col("metrics")
    return _sitreps(spark, d).select("incident_id", m["signal_count"].alias("signal_count"), m["unique_sources"].alias("unique_sources"), joined(m["languages_affected"]).alias("languages"))


@query
def sitrep_header(spark, d):
    return _sitreps(spark, d).select("incident_id", "title", "severity", "summary")


@query
def sitrep_types(spark, d):
    return _sitreps(spark, d).select("incident_id", joined("incident_types").alias("incident_types"))


@query
def sitrep_actions(spark, d):
    return _sitreps(spark, d).select("incident_id", F.posexplode("recommended_actions").alias("pos", "a")).select("incident_id", "pos", "a.action", "a.priority", "a.owner")


@query
def sitrep_signals(spark, d):
    return _sitreps(spark, d).select("incident_id", F.explode("signals").alias("s")).select("incident_id", "s.seq", "s.signal_id")


def _results(spark, d):
    return classify.parse_responses(derived(spark, d, "responses"))


@query
def sitrep_classifications(spark, d):
    """Types of classified signals follow those of the signals."""
    inc = _incidents(spark, d)
    found = classify.parse_responses(derived(spark, d, "responses").withColumnRenamed("seq", "n").select(F.concat(F.lit("S-"), F.col("n").cast("string")).alias("signal_id"), "response"))
    by = found.join(inc.select(F.concat(F.lit("S-"), F.col("seq").cast("string")).alias("signal_id"), "incident_id", "seq"), "signal_id")
    return reports.sitreps(inc, by.select("incident_id", "seq", "labels")).select("incident_id", joined("incident_types").alias("incident_types"))


@query
def sitrep_markdown(spark, d):
    return reports.sitrep_markdown(_sitreps(spark, d), F.lit("2024-01-01T05:00:00+00:00"), True)


def _shift(spark, d):
    rows = _sitreps(spark, d).withColumn("pos", F.conv(F.substring(F.md5(F.encode("incident_id", "UTF-8")), 1, 8), 16, 10).cast("long"))
    low = rows.withColumn("severity", F.when(F.col("incident_id") < "INC-SIG-20240101-02", "P3").otherwise(F.col("severity")))
    actions = spark.createDataFrame([(0, "Called the desk", "completed", "ana", ""), (1, "Check the feed", "pending", "", "again at noon"), (2, "Ask legal", "escalated", "", ""), (3, "Tidy rules", "deferred", "bo", "")], "pos long, description string, status string, owner string, notes string")
    return reports.handover(low, actions, ["INC-1"], "kim", "calm", F.expr(NOW))


@query
def handover(spark, d):
    out = _shift(spark, d)
    listed = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ";")
    return out.select(listed("active_incidents", "incident_id", "severity", "title").alias("active"), listed("actions_taken", "status", "description").alias("taken"), listed("pending_actions", "status", "description").alias("pending"), joined("resolved_incidents").alias("resolved"), "emerging_signals_summary", "shift_start", "analyst", "notes")


@query
def handover_markdown(spark, d):
    return reports.handover_markdown(_shift(spark, d))


@query
def llm_fence(spark, d):
    return derived(spark, d, "responses").select("seq", classify.unfenced(F.col("response")).alias("body"))


@query
def llm_parse(spark, d):
    return _results(spark, d).select("signal_id", "severity", "requires_human_review", "escalation_note")


@query
def llm_labels(spark, d):
    return _results(spark, d).select("signal_id", F.posexplode("labels").alias("pos", "l")).select("signal_id", "pos", "l.incident_type", r6("l.confidence").alias("confidence"), "l.reasoning")


@query
def primary_type(spark, d):
    return _results(spark, d).select("signal_id", classify.primary_type(F.col("labels")).alias("primary_type"), r6(classify.max_confidence(F.col("labels"))).alias("max_confidence"))


@query
def classification_prompt(spark, d):
    return feed(spark, d).select("seq", classify.user_prompt(F.col("text"), F.col("source"), F.col("language")).alias("prompt"))


@query
def boosted_prompt(spark, d):
    # two modes for each label, and one more
    modes = failure_modes(spark, d).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "mode"))).alias("m"))
    return modes.select(classify.boosted_prompt_of(F.transform("m", lambda x: x["mode"])).alias("prompt"))


@query
def backoff_schedule(spark, d):
    return spark.range(8).select(F.col("id").alias("attempt"), classify.backoff(F.col("id")).alias("seconds"))


_ALERTS = Notifications(True, (Webhook("https://example.org/hook", "s3cret"),), "P1")


@query
def webhook_payload(spark, d):
    return notify.passing(signals(spark, d), _ALERTS).select("seq", notify.payload().alias("payload"))


@query
def webhook_signature(spark, d):
    out = webhook_payload(spark, d)
    return out.select("seq", notify.signature(F.col("payload"), _ALERTS.webhooks[0].secret).alias("signature"))


@query
def pipeline_summary(spark, d):
    from ..pipeline import Pipeline

    return Pipeline(spark, Config()).run(feed(spark, d)).summary()

