"""Situation reports per incident and shift handovers, as aggregates and string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SEVERITY_DESCRIPTIONS
from .order import row_index

# fixed values: recommended actions by incident type
ACTIONS: dict[str, list[tuple[str, str, str]]] = {
    "child_safety": [
        ("Escalate to NCMEC reporting pipeline", "immediate", "child-safety-team"),
        ("Freeze implicated accounts pending review", "immediate", "on-call"),
        ("Engage legal for preservation requests", "short_term", "legal"),
    ],
    "violent_extremism": [
        ("Activate counter-terrorism playbook", "immediate", "on-call"),
        ("Coordinate with law enforcement liaison", "immediate", "law-enforcement-ops"),
        ("Deploy emergency content removal queue", "immediate", "content-ops"),
    ],
    "natural_disaster": [
        ("Activate crisis response hub for affected region", "immediate", "crisis-response"),
        ("Enable SOS features in affected geographies", "short_term", "product"),
        ("Monitor for scam/fraud exploiting disaster", "monitoring", "on-call"),
    ],
    "platform_manipulation": [
        ("Snapshot network graph of involved accounts", "immediate", "integrity"),
        ("Rate-limit flagged account cluster", "short_term", "anti-abuse"),
        ("Draft transparency report entry", "monitoring", "policy"),
    ],
    "coordinated_harassment": [
        ("Enable enhanced protections for targeted users", "immediate", "user-safety"),
        ("Identify and action coordinating accounts", "short_term", "on-call"),
        ("Notify comms team for potential media inquiry", "monitoring", "comms"),
    ],
    "self_harm": [
        ("Surface crisis resources to affected users", "immediate", "well-being"),
        ("Review and enforce self-harm content policies", "short_term", "content-ops"),
    ],
}
# fixed values: wording of summaries
HIGH = "HIGH SEVERITY signals detected -- immediate review required."
EMPTY = "No signals collected for this incident."
SIGNAL = "struct<seq: bigint, signal_id: string, severity: string, text: string>"


def action_table(spark: SparkSession) -> DataFrame:
    """incident_type, action_pos, action, priority, owner: the templates, seventeen rows."""
    rows = [(t, k, *a) for t, actions in ACTIONS.items() for k, a in enumerate(actions)]
    return spark.createDataFrame(rows, "incident_type string, action_pos int, action string, priority string, owner string")


def title_case(types: Column) -> Column:
    return F.transform(types, lambda t: F.initcap(F.replace(t, F.lit("_"), F.lit(" "))))


def first_types(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct types of each group in order of first mention.  rows: keys, part, seq, types.

    Each type keeps its first place, so at most a dozen entries of a group meet."""
    places = rows.select(*keys, "part", "seq", F.posexplode("types").alias("k", "t")).groupBy(*keys, "t").agg(F.min(F.struct("part", "seq", "k")).alias("at"))
    return places.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]).alias("incident_types"))


def sitreps(signals: DataFrame, results: DataFrame | None = None, max_signals: int = 50, title: str | None = None) -> DataFrame:
    """One row per incident_id of signals (incident_id, seq, signal_id, text, source, language, score, severity,
    suggested_types): title, severity (of the highest score, the first on ties), incident_types, summary, metrics, the
    first max_signals signals and recommended_actions.  results: incident_id, seq, labels; their types come last."""
    spark = signals.sparkSession
    types = signals.select("incident_id", F.lit(0).alias("part"), "seq", F.col("suggested_types").alias("types"))
    if results is not None:
        types = types.unionByName(results.select("incident_id", F.lit(1).alias("part"), "seq", F.transform("labels", lambda x: x["incident_type"]).alias("types")))
    types = types.join(signals.select("incident_id").distinct(), "incident_id", "left_semi")
    base = signals.groupBy("incident_id").agg(
        F.max_by("severity", F.struct("score", -F.col("seq"))).alias("severity"),
        F.count("*").alias("signal_count"),
        F.count_distinct("source").alias("unique_sources"),
        F.array_sort(F.collect_set("language")).alias("languages_affected"),
        F.coalesce(F.bool_or(F.col("severity").isin("P0", "P1")), F.lit(False)).alias("_high"),
    )
    w = Window.partitionBy("incident_id").orderBy("seq")
    # at most max_signals rows of an incident meet
    top = signals.select("incident_id", "seq", "signal_id", "severity", "text", F.row_number().over(w).alias("_k")).filter(F.col("_k") <= max_signals)
    shown = top.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("seq", "signal_id", "severity", "text"))).alias("signals"))
    ordered = first_types(types, "incident_id")
    act = F.broadcast(action_table(spark))
    acts = ordered.select("incident_id", F.posexplode("incident_types").alias("_p", "incident_type")).join(act, "incident_type").groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("_p", "action_pos", "action", "priority", "owner"))).alias("recommended_actions"))
    out = base.join(ordered, "incident_id", "left").join(shown, "incident_id").join(acts, "incident_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("incident_types", F.coalesce("incident_types", none))
    plain = F.transform(F.coalesce("recommended_actions", F.array().cast("array<struct<_p: int, action_pos: int, action: string, priority: string, owner: string>>")), lambda x: F.struct(x["action"].alias("action"), x["priority"].alias("priority"), x["owner"].alias("owner")))
    auto = F.when(F.size("incident_types") > 0, F.concat(F.array_join(title_case(F.slice("incident_types", 1, 3)), ", "), F.lit(" Incident"))).otherwise(F.concat(F.lit("Incident "), "incident_id"))
    said = F.concat(F.lit("Detected "), F.col("signal_count").cast("string"), F.lit(" signals across "), F.col("unique_sources").cast("string"), F.lit(" source(s). Languages: "), F.array_join("languages_affected", ", "), F.lit(". Incident types: "), F.array_join("incident_types", ", "), F.lit("."), F.when(F.col("_high"), F.lit(" " + HIGH)).otherwise(F.lit("")))
    metrics = F.struct("signal_count", "unique_sources", "languages_affected", F.lit("").alias("first_seen"), F.lit("").alias("last_seen"), F.lit(0.0).alias("peak_velocity"))
    return out.select("incident_id", (auto if title is None else F.lit(title)).alias("title"), "severity", F.lit("active").alias("status"), "incident_types", said.alias("summary"), metrics.alias("metrics"), plain.alias("recommended_actions"), "signals")


def empty_sitrep(spark: SparkSession, incident_id: str, title: str | None = None) -> DataFrame:
    """The report of an incident without signals."""
    s = spark.range(1)
    metrics = F.struct(F.lit(0).cast("long").alias("signal_count"), F.lit(0).cast("long").alias("unique_sources"), F.array().cast("array<string>").alias("languages_affected"), F.lit("").alias("first_seen"), F.lit("").alias("last_seen"), F.lit(0.0).alias("peak_velocity"))
    return s.select(F.lit(incident_id).alias("incident_id"), F.lit(title or f"Incident {incident_id}").alias("title"), F.lit("P4").alias("severity"), F.lit("active").alias("status"), F.array().cast("array<string>").alias("incident_types"), F.lit(EMPTY).alias("summary"), metrics.alias("metrics"), F.array().cast("array<struct<action: string, priority: string, owner: string>>").alias("recommended_actions"), F.array().cast(f"array<{SIGNAL}>").alias("signals"))


def batches(signals: DataFrame, records: DataFrame, size: int = 64) -> DataFrame:
    """Signals with the number of their batch: `size` valid records each, in arrival order."""
    numbered = row_index(records.select("seq")).select("seq", F.floor(F.col("row_index") / F.lit(size)).alias("batch"))
    return signals.join(numbered, "seq")


def incidents(batched: DataFrame) -> DataFrame:
    """Signals of P0 to P2 with the incident_id of their batch, named after its first such signal."""
    high = batched.filter(F.col("severity") <= "P2")
    names = high.groupBy("batch").agg(F.concat(F.lit("INC-"), F.min_by("signal_id", "seq")).alias("incident_id"))
    return high.join(names, "batch")


def sitrep_markdown(reports: DataFrame, created: Column, include_signals: bool = False) -> DataFrame:
    """incident_id, markdown"""
    # fixed values: layout of the report
    wording = F.create_map(*[F.lit(x) for pair in SEVERITY_DESCRIPTIONS.items() for x in pair])
    m = F.col("metrics")
    text = lambda c: F.when(F.length(c) > 0, c).otherwise(F.lit("N/A"))
    acts = F.transform("recommended_actions", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". **["), F.upper(x["priority"]), F.lit("]** "), x["action"], F.lit(" (Owner: "), x["owner"], F.lit(")")))
    lines = [
        F.concat(F.lit("# SITREP: "), "title"),
        F.lit(""),
        F.concat(F.lit("**Incident ID:** "), "incident_id"),
        F.concat(F.lit("**Severity:** "), "severity", F.lit(" — "), wording[F.col("severity")]),
        F.concat(F.lit("**Status:** "), "status"),
        F.concat(F.lit("**Types:** "), F.array_join("incident_types", ", ")),
        F.concat(F.lit("**Created:** "), created),
        *map(F.lit, ("", "## Summary", "")),
        F.when(F.length("summary") > 0, F.col("summary")).otherwise(F.lit("_No summary available._")),
        *map(F.lit, ("", "## Metrics", "", "| Metric | Value |", "|--------|-------|")),
        F.concat(F.lit("| Signals detected | "), m["signal_count"].cast("string"), F.lit(" |")),
        F.concat(F.lit("| Unique sources | "), m["unique_sources"].cast("string"), F.lit(" |")),
        F.concat(F.lit("| Languages | "), text(F.array_join(m["languages_affected"], ", ")), F.lit(" |")),
        F.concat(F.lit("| First seen | "), text(m["first_seen"]), F.lit(" |")),
        F.concat(F.lit("| Last seen | "), text(m["last_seen"]), F.lit(" |")),
        F.concat(F.lit("| Peak velocity | "), F.format_string("%.1f", m["peak_velocity"]), F.lit(" signals/min |")),
        *map(F.lit, ("", "## Recommended Actions", "")),
        F.when(F.size(acts) > 0, F.array_join(acts, "\n")).otherwise(F.lit("_No actions recommended._")),
    ]
    if include_signals:
        raw = F.transform(F.slice("signals", 1, 50), lambda x: F.concat(F.lit("- `"), x["signal_id"], F.lit("` ["), x["severity"], F.lit("] "), F.substring(x["text"], 1, 120), F.lit("...")))
        lines.append(F.when(F.size("signals") > 0, F.concat(F.lit("\n## Raw Signals\n\n"), F.array_join(raw, "\n"))))
    return reports.select("incident_id", F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("markdown"))


def handover(reports: DataFrame, actions: DataFrame | None = None, resolved: list[str] | None = None, analyst: str = "", notes: str = "", now: Column | None = None) -> DataFrame:
    """One row: the active incidents by severity, actions taken and pending, and the emerging incidents' summary.

    reports: those of a shift, with pos; actions: pos, description, status, owner, notes."""
    active = reports.filter("status = 'active'")
    keep = F.struct("severity", "pos", "incident_id", "title", "incident_types", "status", "summary")
    listed = active.agg(F.array_sort(F.collect_list(keep)).alias("active_incidents"))
    low = active.filter(F.col("severity").isin("P3", "P4"))
    kinds = low.select(F.explode("incident_types").alias("t")).agg(F.array_join(F.array_sort(F.collect_set("t")), ", ").alias("t"))
    emerging = low.agg(F.count("*").alias("n")).crossJoin(kinds).select(F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" low-severity signals under monitoring. Types: "), "t", F.lit("."))).otherwise(F.lit("")).alias("emerging_signals_summary"))
    out = listed.crossJoin(emerging)
    kind = "array<struct<pos: bigint, description: string, status: string, owner: string, notes: string>>"
    for name, states in (("actions_taken", ("completed", "escalated")), ("pending_actions", ("pending", "deferred"))):
        if actions is None:
            out = out.withColumn(name, F.array().cast(kind))
        else:
            out = out.crossJoin(actions.filter(F.col("status").isin(*states)).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "description", "status", "owner", "notes"))).alias(name)))
    at = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss+00:00")
    return out.withColumns({"shift_start": at, "shift_end": at, "analyst": F.lit(analyst), "notes": F.lit(notes), "resolved_incidents": F.array(*map(F.lit, resolved or ())).cast("array<string>")})


def handover_markdown(summary: DataFrame) -> DataFrame:
    # fixed values: layout of the summary
    def section(title: str, column: str, line, none: str) -> Column:
        body = F.array_join(F.transform(column, line), "\n")
        return F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(column) > 0, body).otherwise(F.lit(none)))

    some = lambda c, a, b="": F.when(F.length(c) > 0, F.concat(F.lit(a), c, F.lit(b))).otherwise(F.lit(""))
    incident = lambda x: F.concat(F.lit("- **"), x["incident_id"], F.lit("** ["), x["severity"], F.lit("] "), x["title"], F.lit(" ("), F.array_join(x["incident_types"], ", "), F.lit(") -- "), x["status"], some(F.substring(x["summary"], 1, 200), "\n  - "))
    taken = lambda a: F.concat(F.lit("- ["), F.upper(a["status"]), F.lit("] "), a["description"], some(a["owner"], " (", ")"), some(a["notes"], "\n  - Note: "))
    pending = lambda a: F.concat(F.lit("- **"), a["description"], F.lit("**"), some(a["owner"], " (Owner: ", ")"), some(a["notes"], "\n  - "))
    head = F.concat(F.lit("# Shift Handover Summary\n\n**Shift:** "), "shift_start", F.lit(" -- "), "shift_end", F.lit("\n**Analyst:** "), F.when(F.length("analyst") > 0, F.col("analyst")).otherwise(F.lit("N/A")))
    parts = [
        head,
        section("Active Incidents", "active_incidents", incident, "_No active incidents._"),
        section("Resolved This Shift", "resolved_incidents", lambda x: F.concat(F.lit("- "), x), "_None._"),
        section("Actions Taken", "actions_taken", taken, "_No actions logged._"),
        section("Pending / Requires Follow-up", "pending_actions", pending, "_No pending actions._"),
        F.when(F.length("emerging_signals_summary") > 0, F.concat(F.lit("## Emerging Signals\n\n"), "emerging_signals_summary")),
        F.when(F.length("notes") > 0, F.concat(F.lit("## Analyst Notes\n\n"), "notes")),
    ]
    return summary.select(F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("markdown"))
