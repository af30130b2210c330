"""Golden-set evaluation of multi-label predictions.

golden: example_id, true_labels, true_severity (and text, for previews); predictions: example_id, predicted_labels,
predicted_severity, confidence.  Both have `pos`, the order of their rows: of rows of one id the last wins.  A missing
prediction adds false negatives, one for each listed label, but no true negatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame) -> DataFrame:
    """One row per id: the last one's values at the first one's place."""
    cols = [c for c in rows.columns if c not in ("example_id", "pos")]
    one = rows.groupBy("example_id").agg(F.min("pos").alias("pos"), F.max_by(F.struct(*cols), "pos").alias("_v"))
    return one.select("example_id", "pos", "_v.*")


def joined(golden: DataFrame, predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Golden rows with their prediction for each threshold; predicted_labels of a confidence below it are empty there."""
    pred = last_wins(predictions).drop("pos").withColumn("found", F.lit(True))
    rows = last_wins(golden).join(pred, "example_id", "left").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    kept = F.when(F.col("found") & (F.col("confidence") >= F.col("threshold")), F.col("predicted_labels")).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("counted_labels", kept)


def universe(golden: DataFrame) -> DataFrame:
    return last_wins(golden).select(F.explode("true_labels").alias("label")).distinct()


def _rate(a, b):
    return F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(F.lit(0.0))


def per_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """threshold, label, tp, fp, fn, tn, precision, recall, f1.  labels: the golden set's.

    Each row is counted under the labels it has; true negatives are what is left of a threshold's rows."""
    count = lambda c: F.sum(c.cast("long"))
    cells = rows.select("threshold", "found", "true_labels", "counted_labels", F.explode(F.array_union("true_labels", "counted_labels")).alias("label")).join(labels, "label", "left_semi")
    has, got = F.array_contains("true_labels", F.col("label")), F.array_contains("counted_labels", F.col("label"))
    listed = F.size(F.filter("true_labels", lambda x: x == F.col("label")))
    seen = cells.groupBy("threshold", "label").agg(
        count((F.col("found") & has & got).cast("int")).alias("tp"),
        count((F.col("found") & ~has & got).cast("int")).alias("fp"),
        count((F.col("found") & has & ~got).cast("int")).alias("_missed"),
        count(F.when(F.col("found"), (has & ~got).cast("int")).otherwise(listed)).alias("fn"),
    )
    all_ = rows.groupBy("threshold").agg(F.count_if("found").alias("_all"))
    out = seen.join(all_, "threshold").withColumn("tn", F.col("_all") - F.col("tp") - F.col("fp") - F.col("_missed")).drop("_all", "_missed")
    p, r = _rate(F.col("tp"), F.col("tp") + F.col("fp")), _rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-300))).otherwise(F.lit(0.0)))


def macro(stats: DataFrame) -> DataFrame:
    """threshold, macro_precision, macro_recall, macro_f1: means over labels that were predicted, and that occur."""
    out = stats.groupBy("threshold").agg(
        F.coalesce(F.avg(F.when(F.col("tp") + F.col("fp") > 0, F.col("precision"))), F.lit(0.0)).alias("macro_precision"),
        F.coalesce(F.avg(F.when(F.col("tp") + F.col("fn") > 0, F.col("recall"))), F.lit(0.0)).alias("macro_recall"),
    )
    p, r = F.col("macro_precision"), F.col("macro_recall")
    return out.withColumn("macro_f1", F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-300))).otherwise(F.lit(0.0)))


def severity_accuracy(rows: DataFrame) -> DataFrame:
    right = F.count_if(F.col("found") & (F.col("true_severity") == F.col("predicted_severity")))
    return rows.groupBy("threshold").agg(F.count("*").alias("total_examples"), (right / F.count("*")).alias("severity_accuracy"))


def audit(rows: DataFrame) -> DataFrame:
    """threshold, example_id, pos, text_preview, missed_labels, predicted_labels, confidence; missing predictions always."""
    missed = F.when(F.col("found"), F.array_sort(F.array_except("true_labels", "counted_labels"))).otherwise(F.col("true_labels"))
    none = F.array().cast("array<string>")
    out = rows.withColumns({"missed_labels": missed, "predicted_labels": F.when(F.col("found"), F.col("predicted_labels")).otherwise(none), "confidence": F.when(F.col("found"), F.col("confidence")).otherwise(F.lit(0.0))})
    return out.filter(~F.col("found") | (F.size("missed_labels") > 0)).select("threshold", "example_id", "pos", F.substring("text", 1, 100).alias("text_preview"), "missed_labels", "predicted_labels", "confidence")


def failure_modes(stats: DataFrame, missed: DataFrame) -> DataFrame:
    """threshold, rank, label, mode: recall, then precision, then confident misses; labels in order."""
    # fixed values: wording of the modes
    low = F.concat(F.lit("Low recall on '"), "label", F.lit("' ("), F.format_string("%.2f", "recall"), F.lit(") -- model may be under-detecting this category"))
    over = F.concat(F.lit("Low precision on '"), "label", F.lit("' ("), F.format_string("%.2f", "precision"), F.lit(") -- model may be over-triggering on this category"))
    sure = F.concat(F.col("n").cast("string"), F.lit(" high-confidence false negatives -- model is confident but missing labels, calibration issue"))
    recall = stats.filter((F.col("recall") < 0.5) & (F.col("tp") + F.col("fn") >= 2)).select("threshold", F.lit(1).alias("rank"), "label", low.alias("mode"))
    precision = stats.filter((F.col("precision") < 0.5) & (F.col("tp") + F.col("fp") >= 2)).select("threshold", F.lit(2).alias("rank"), "label", over.alias("mode"))
    misses = missed.filter("confidence > 0.7").groupBy("threshold").agg(F.count("*").alias("n")).filter("n >= 2").select("threshold", F.lit(3).alias("rank"), F.lit("").alias("label"), sure.alias("mode"))
    return recall.unionByName(precision).unionByName(misses)


class GoldenSet:
    """Evaluations of prediction tables against one golden table."""

    DEFAULT_THRESHOLDS = (0.0, 0.3, 0.5, 0.7, 0.9)

    def __init__(self, golden: DataFrame):
        self.golden = golden

    def add(self, more: DataFrame) -> GoldenSet:
        """Rows of more replace those of equal ids; new ones follow."""
        top = self.golden.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("top"))
        later = more.crossJoin(top).withColumn("pos", F.col("pos") + F.col("top") + 1).drop("top")
        return GoldenSet(self.golden.unionByName(later))

    def size(self) -> int:
        return self.golden.select("example_id").distinct().count()

    def evaluate(self, predictions: DataFrame, thresholds: tuple[float, ...] | float | None = 0.0) -> dict[str, DataFrame]:
        """Lazily: per_label, macro, severity, audit and failure_modes, each by threshold."""
        cuts = list(thresholds or self.DEFAULT_THRESHOLDS) if not isinstance(thresholds, (int, float)) else [float(thresholds)]
        rows = joined(self.golden, predictions, cuts)
        stats = per_label(rows, universe(self.golden))
        missed = audit(rows)
        return {"per_label": stats, "macro": macro(stats), "severity": severity_accuracy(rows), "audit": missed, "failure_modes": failure_modes(stats, missed)}

    def summary(self, predictions: DataFrame, threshold: float = 0.0) -> str:
        """A printed report of one threshold; only its few lines reach the driver."""
        r = self.evaluate(predictions, threshold)
        m, s = r["macro"].first(), r["severity"].first()
        # fixed values: layout of the report
        lines = [f"Golden Set Evaluation ({s['total_examples']} examples)", f"  Macro Precision: {m['macro_precision']:.3f}", f"  Macro Recall:    {m['macro_recall']:.3f}", f"  Macro F1:        {m['macro_f1']:.3f}", f"  Severity Acc:    {s['severity_accuracy']:.3f}", "", "  Per-label F1:"]
        lines += [f"    {x['label']:30s}  P={x['precision']:.3f}  R={x['recall']:.3f}  F1={x['f1']:.3f}" for x in r["per_label"].orderBy("label").collect()]
        n = r["audit"].count()
        if n:
            lines += ["", f"  False Negatives: {n}"] + [f"    - {x['example_id']}: missed {list(x['missed_labels'])}" for x in r["audit"].orderBy("pos").limit(5).collect()]
        modes = r["failure_modes"].orderBy("rank", "label").collect()
        if modes:
            lines += ["", "  Identified Failure Modes:"] + [f"    - {x['mode']}" for x in modes]
        return "\n".join(lines)


def boost(classifier, golden: GoldenSet, rounds: int = 3, threshold: float = 0.5) -> list[DataFrame]:
    """Rounds of evaluation in which each one's failure modes go into the next one's prompt; the macro rows of each round.

    A round classifies every golden example once.  It ends early where no new failure mode turns up.  classifier: one
    whose classify() takes signal_id, text, source, language."""
    from ..storage import written

    examples = last_wins(golden.golden)
    have = set(examples.columns)
    fill = lambda c, x: F.coalesce(F.col(c), F.lit(x)).alias(c) if c in have else F.lit(x).alias(c)
    asked = examples.select(F.col("example_id").alias("signal_id"), "text", fill("source", "golden_set"), fill("language", "en"))
    out = []
    for _ in range(rounds):
        results = written(classifier.classify(asked), "boost")
        confidence = F.coalesce(F.array_max(F.transform("labels", lambda x: x["confidence"])), F.lit(0.0))
        said = results.select(F.col("signal_id").alias("example_id"), F.lit(0).cast("long").alias("pos"), F.transform("labels", lambda x: x["incident_type"]).alias("predicted_labels"), F.col("severity").alias("predicted_severity"), confidence.alias("confidence"))
        found = golden.evaluate(said, threshold)
        out.append(found["macro"])
        # two modes for each label of the golden set, and one more
        modes = [r["mode"] for r in found["failure_modes"].orderBy("rank", "label").select("mode").collect()]
        new = [m for m in modes if m not in classifier.failure_modes]
        if not new:
            break
        for m in new:
            classifier.add_failure_mode(m)
    return out
