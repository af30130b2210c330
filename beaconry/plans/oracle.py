"""DuckDB SQL of the registered queries, written from the semantics and not from the Spark plans."""

from __future__ import annotations

from ..config import SEVERITY_DESCRIPTIONS
from ..functions.vocabulary import LANGUAGES, TERMS, TYPE_OF, terms_for
from ..operators.classify import BOOSTED_PROMPT, NO_NOTES, SYSTEM_PROMPT, USER_PROMPT
from ..operators.reports import ACTIONS, HIGH
from .inputs import FEED, GOLDEN, POSTS, PREDICTIONS, RESPONSES

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOW = "TIMESTAMP '2024-01-01 05:00:00'"
ORACLE: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits(terms: list[str], text: str = "lower(text)") -> str:
    edge = r"[^\p{L}\p{N}_]"
    plain = lambda t: "".join(c if c.isalnum() or c in " _" else "\\" + c for c in t)
    return " + ".join(f"CAST(regexp_matches({text}, {q(f'(^|{edge}){plain(t)}($|{edge})')}) AS INT)" for t in terms) or "0"


def of_terms(terms: list[str]) -> str:
    if not terms:
        return "0::DOUBLE"
    return f"CASE WHEN ({hits(terms)}) = 0 THEN 0::DOUBLE ELSE least(0.3::DOUBLE + least(({hits(terms)})::DOUBLE / {len(terms)} * 5, 1::DOUBLE) * 0.7::DOUBLE, 1::DOUBLE) END"


def keyword(categories: list[str], custom: dict[str, list[str]] | None = None) -> str:
    own = dict.fromkeys([*(x for x in LANGUAGES if x != "en"), *(custom or {})])
    when = " ".join(f"WHEN '{x}' THEN {of_terms(terms_for(categories, x, custom or {}))}" for x in own)
    return f"CASE language {when} ELSE {of_terms(terms_for(categories, '', {}))} END"


RULES = [("keyword_violence", 1.2, "violence"), ("keyword_disaster", 1.0, "natural_disaster"), ("keyword_platform", 1.1, "platform_abuse"), ("keyword_csam", 1.5, "child_safety"), ("keyword_self_harm", 1.3, "self_harm"), ("url_flood", 0.5, None)]
KEY = f"substring(sha256(regexp_replace(regexp_replace(lower(text), '^{SPACE}+|{SPACE}+$', '', 'g'), '{SPACE}+', ' ', 'g')), 1, 16)"
_n = range(len(RULES))
SEVERITY = "CASE WHEN score >= 0.95::DOUBLE THEN 'P0' WHEN score >= 0.85::DOUBLE THEN 'P1' WHEN score >= 0.7::DOUBLE THEN 'P2' WHEN score >= 0.5::DOUBLE THEN 'P3' ELSE 'P4' END"
_weighted = " + ".join(f"CASE WHEN r{k} > 0 THEN r{k} * {RULES[k][1]}::DOUBLE ELSE 0::DOUBLE END" for k in _n)
_weights = " + ".join(f"CASE WHEN r{k} > 0 THEN {RULES[k][1]}::DOUBLE ELSE 0::DOUBLE END" for k in _n)
_names = "concat_ws(',', " + ", ".join(f"CASE WHEN r{k} > 0 THEN '{RULES[k][0]}' END" for k in _n) + ")"
_types = "concat_ws(',', " + ", ".join(f"CASE WHEN r{k} > 0 THEN '{TYPE_OF[RULES[k][2]]}' END" for k in _n if RULES[k][2]) + ")"


def z(x: str, n: str, s: str, sq: str) -> str:
    """z-score of x against n values with sum s and sum of squares sq."""
    return f"CASE WHEN {deviation(n, s, sq)} = 0 THEN CASE WHEN {x} = {average(n, s)} THEN 0::DOUBLE ELSE 'inf'::DOUBLE END ELSE ({x} - {average(n, s)}) / {deviation(n, s, sq)} END"


def average(n: str, s: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {s}::DOUBLE / {n} ELSE 0::DOUBLE END)"


def deviation(n: str, s: str, sq: str) -> str:
    return f"(CASE WHEN {n} < 2 OR {n} * {sq} = {s} * {s} THEN 0::DOUBLE ELSE sqrt(greatest({sq}::DOUBLE / {n} - ({s}::DOUBLE / {n}) * ({s}::DOUBLE / {n}), 0)) END)"


def frames(x: str, size: int, order: str) -> str:
    """Columns n0, s0, q0 (the frame before) and n1, s1, q1 (the frame with the row)."""
    out = []
    for k, frame in enumerate((f"ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING", f"ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW")):
        w = f"OVER (ORDER BY {order} {frame})"
        out += [f"count({x}) {w} AS n{k}", f"coalesce(sum({x}) {w}, 0)::BIGINT AS s{k}", f"coalesce(sum({x} * {x}) {w}, 0)::BIGINT AS q{k}"]
    return ", ".join(out)


def bucketed(source: str, seconds: int, p: str) -> str:
    """CTEs {p}runs (run, bucket, n, first_seq, next_seq) and {p}anomalies of source (seq, timestamp)."""
    return f"""{p}timed AS (SELECT seq, floor(timestamp)::BIGINT // {seconds} AS bucket FROM {source} WHERE timestamp > 0),
{p}marked AS (SELECT *, CASE WHEN lag(bucket) OVER (ORDER BY seq) = bucket THEN 0 ELSE 1 END AS new FROM {p}timed),
{p}numbered AS (SELECT *, sum(new) OVER (ORDER BY seq) - 1 AS run FROM {p}marked),
{p}grouped AS (SELECT run::BIGINT AS run, any_value(bucket) AS bucket, count(*) AS n, min(seq) AS first_seq FROM {p}numbered GROUP BY run),
{p}runs AS (SELECT *, lead(first_seq) OVER (ORDER BY run) AS next_seq FROM {p}grouped),
{p}frames AS (SELECT *, {frames('n', 60, 'run')} FROM {p}runs),
{p}scored AS (SELECT *, {z('n', 'n0', 's0', 'q0')} AS z FROM {p}frames),
{p}anomalies AS (SELECT * FROM {p}scored WHERE next_seq IS NOT NULL AND n0 >= 10 AND z > 2.5)"""


CTE = {
    "feed": FEED,
    "golden_rows": GOLDEN,
    "prediction_rows": PREDICTIONS,
    "responses": RESPONSES,
    "ruled": "SELECT *, " + ", ".join(f"{keyword([c])} AS r{k}" if c else f"CASE WHEN regexp_matches(text, 'https?://\\S+', 'i') THEN 1::DOUBLE ELSE 0::DOUBLE END AS r{k}" for k, (_, _, c) in enumerate(RULES)) + " FROM feed",
    "totals": f"SELECT *, {_weighted} AS w, {_weights} AS t FROM ruled",
    "rated": f"SELECT *, w / t AS score, {_names} AS matched_rules, {_types} AS suggested_types, {KEY} AS dedup_key FROM totals WHERE t > 0",
    "scored": f"SELECT *, {SEVERITY} AS severity FROM rated",
    "ranked": "SELECT *, max(score) OVER (PARTITION BY dedup_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM scored WHERE language IN ('en', 'es', 'pt', 'fr', 'de')",
    "kept": "SELECT * FROM ranked WHERE (best IS NULL OR score > best) AND score >= 0.3",
    "ids": "SELECT *, 'SIG-' || strftime(make_timestamp((timestamp * 1000000)::BIGINT), '%Y%m%d-%H%M%S') || '-' || upper(substring(dedup_key, 1, 6)) AS signal_id, strftime(make_timestamp((timestamp * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at FROM kept",
    "signals": "SELECT i.* EXCLUDE (score), a.bucket AS anomaly_bucket, a.n AS anomaly_count, CASE WHEN a.bucket IS NULL THEN i.score ELSE least(i.score * 1.15::DOUBLE, 1::DOUBLE) END AS score FROM ids i LEFT JOIN m_anomalies a ON a.next_seq = i.seq",
    "batched": "SELECT s.*, (f.k - 1) // 64 AS batch FROM signals s JOIN (SELECT seq, row_number() OVER (ORDER BY seq) AS k FROM feed) f USING (seq)",
    "high": "SELECT * FROM batched WHERE severity <= 'P2'",
    "incidents": "SELECT h.*, n.incident_id FROM high h JOIN (SELECT batch, 'INC-' || arg_min(signal_id, seq) AS incident_id FROM high GROUP BY batch) n USING (batch)",
    "mentions": "SELECT incident_id, t, min((seq, k)) AS place FROM (SELECT incident_id, seq, unnest(string_split(suggested_types, ',')) AS t, generate_subscripts(string_split(suggested_types, ','), 1) AS k FROM incidents) WHERE t <> '' GROUP BY ALL",
    "typed": "SELECT incident_id, string_agg(t, ',' ORDER BY place) AS incident_types FROM mentions GROUP BY incident_id",
    "facts": "SELECT incident_id, arg_max(severity, (score, -seq)) AS severity, count(*) AS signal_count, count(DISTINCT source) AS unique_sources, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, bool_or(severity IN ('P0', 'P1')) AS urgent FROM incidents GROUP BY incident_id",
    "golden": "SELECT example_id, min(pos) AS pos, arg_max(text, pos) AS text, list_filter(string_split(arg_max(labels, pos), '|'), lambda x: x <> '') AS true_labels, arg_max(true_severity, pos) AS true_severity FROM golden_rows GROUP BY example_id",
    "predictions": "SELECT example_id, list_filter(string_split(arg_max(labels, pos), '|'), lambda x: x <> '') AS predicted_labels, arg_max(predicted_severity, pos) AS predicted_severity, arg_max(confidence, pos) AS confidence FROM prediction_rows GROUP BY example_id",
    "cuts": "SELECT unnest([0.0, 0.3, 0.5, 0.7, 0.9])::DOUBLE AS threshold",
    "pairs": "SELECT c.threshold, g.*, p.example_id IS NOT NULL AS found, p.predicted_labels, p.predicted_severity, p.confidence, CASE WHEN p.confidence >= c.threshold THEN p.predicted_labels ELSE [] END AS counted FROM golden g CROSS JOIN cuts c LEFT JOIN predictions p USING (example_id)",
    "universe": "SELECT DISTINCT unnest(true_labels) AS label FROM golden",
    "cells": "SELECT threshold, label, found, list_contains(true_labels, label) AS has, list_contains(counted, label) AS got, len(list_filter(true_labels, lambda x: x = label)) AS listed FROM pairs CROSS JOIN universe",
    "confusion": "SELECT threshold, label, count(*) FILTER (found AND has AND got) AS tp, count(*) FILTER (found AND NOT has AND got) AS fp, (count(*) FILTER (found AND has AND NOT got) + coalesce(sum(listed) FILTER (NOT found), 0))::BIGINT AS fn, count(*) FILTER (found AND NOT has AND NOT got) AS tn FROM cells GROUP BY ALL",
    "rates": "SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0::DOUBLE END AS r FROM confusion",
    "means": "SELECT threshold, coalesce(avg(p) FILTER (tp + fp > 0), 0)::DOUBLE AS mp, coalesce(avg(r) FILTER (tp + fn > 0), 0)::DOUBLE AS mr FROM rates GROUP BY threshold",
    "audit": "SELECT threshold, example_id, pos, substring(text, 1, 100) AS text_preview, CASE WHEN found THEN list_sort(list_filter(list_distinct(true_labels), lambda x: NOT list_contains(counted, x))) ELSE true_labels END AS missed, CASE WHEN found THEN predicted_labels ELSE [] END AS shown, CASE WHEN found THEN confidence ELSE 0::DOUBLE END AS confidence, found FROM pairs",
    "missed_rows": "SELECT * FROM audit WHERE NOT found OR len(missed) > 0",
    "anchors": "SELECT min(timestamp) AS a, 0::BIGINT AS window_id FROM feed UNION ALL SELECT (SELECT min(timestamp) FROM feed WHERE timestamp >= a + 300), window_id + 1 FROM anchors WHERE EXISTS (SELECT 1 FROM feed WHERE timestamp >= a + 300)",
    "placed": "SELECT f.*, (SELECT max(window_id) FROM anchors WHERE a <= f.timestamp) AS window_id FROM scored f",
    "replayed": "SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY window_id, dedup_key ORDER BY timestamp, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM placed) WHERE before IS NULL OR score > before",
    "all_placed": "SELECT seq, timestamp, (SELECT max(window_id) FROM anchors WHERE a <= f.timestamp) AS window_id FROM feed f",
    "timeline": "SELECT p.window_id AS \"window\", min(p.timestamp) AS start, max(p.timestamp) AS \"end\", count(*) AS records, count(r.seq) AS signals FROM all_placed p LEFT JOIN replayed r USING (seq) GROUP BY p.window_id",
    "events_feed": "SELECT event_id AS seq, floor(epoch(ts))::DOUBLE AS timestamp FROM events",
    "counts": "SELECT run AS seq, n AS x FROM e_runs",
    "trimmed": f"SELECT seq, signal_id, regexp_replace(response, '^{SPACE}+|{SPACE}+$', '', 'g') AS t FROM responses",
    "bodies": "SELECT seq, signal_id, CASE WHEN starts_with(t, '```') THEN regexp_extract(t, '(?s)^```[^\\n]*\\n(.*)\\n```', 1) ELSE t END AS body FROM trimmed",
    "parsed": "SELECT *, CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' AND NOT coalesce(TRY_CAST(json_extract_string(body, '$._parse_error') AS BOOLEAN), false) ELSE false END AS good, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM bodies",
    "listed": "SELECT signal_id, unnest(range(coalesce(json_array_length(j, '$.labels'), 0)::BIGINT)) AS i, j FROM parsed WHERE good",
    "items": "SELECT signal_id, i, json_extract_string(j, '$.labels[' || i || '].type') AS incident_type, greatest(0, least(1, coalesce(TRY_CAST(json_extract_string(j, '$.labels[' || i || '].confidence') AS DOUBLE), 0)))::DOUBLE AS confidence, coalesce(json_extract_string(j, '$.labels[' || i || '].reasoning'), '') AS reasoning FROM listed",
    "labelled": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY confidence DESC, i) - 1 AS pos FROM items WHERE confidence >= 0.6 AND incident_type IN ('political_unrest', 'natural_disaster', 'platform_manipulation', 'coordinated_harassment', 'child_safety', 'violent_extremism', 'self_harm', 'misinformation', 'data_breach', 'regulatory', 'other')) WHERE pos < 3",
}
# the same rules over whole texts
CTE |= {"posts": POSTS} | {f"p_{x}": CTE[x].replace(f"FROM {y}", f"FROM {z}") for x, y, z in (("ruled", "feed", "posts"), ("totals", "ruled", "p_ruled"), ("rated", "totals", "p_totals"), ("scored", "rated", "p_rated"))}
NEEDS = {
    "p_ruled": ["posts"], "p_totals": ["p_ruled"], "p_rated": ["p_totals"], "p_scored": ["p_rated"],
    "ruled": ["feed"], "totals": ["ruled"], "rated": ["totals"], "scored": ["rated"], "ranked": ["scored"], "kept": ["ranked"], "ids": ["kept"],
    "m": ["kept"], "signals": ["ids", "m"], "batched": ["signals", "feed"], "high": ["batched"], "incidents": ["high"], "mentions": ["incidents"], "typed": ["mentions"], "facts": ["incidents"],
    "golden": ["golden_rows"], "predictions": ["prediction_rows"], "pairs": ["golden", "predictions", "cuts"], "universe": ["golden"], "cells": ["pairs", "universe"],
    "confusion": ["cells"], "rates": ["confusion"], "means": ["rates"], "audit": ["pairs"], "missed_rows": ["audit"],
    "anchors": ["feed"], "placed": ["scored", "anchors"], "replayed": ["placed"], "all_placed": ["feed", "anchors"], "timeline": ["all_placed", "replayed"],
    "e": ["events_feed"], "counts": ["e"], "trimmed": ["responses"], "bodies": ["trimmed"], "parsed": ["bodies"], "listed": ["parsed"], "items": ["listed"], "labelled": ["items"],
}
GROUPS = {"m": bucketed("kept", 60, "m_"), "e": bucketed("events_feed", 3600, "e_")}


def sql(body: str, *names: str) -> str:
    """body over the named CTEs and all that they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for x in NEEDS.get(name, ()):
                visit(x)
            order.append(name)

    for x in names:
        visit(x)
    return "WITH RECURSIVE " + ",\n".join(GROUPS[x] if x in GROUPS else f"{x} AS ({CTE[x]})" for x in order) + "\n" + body


def add(name: str, body: str, *names: str) -> None:
    ORACLE[name] = sql(body, *names)


add("language_filter", "SELECT seq, language FROM feed WHERE language IN ('en', 'es', 'pt', 'fr', 'de')", "feed")
add("blank_filter", "SELECT seq, text FROM feed WHERE seq % 6 <> 0", "feed")
ORACLE["vocabulary"] = "SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(x)}, {k}, {q(t)})" for c, by in TERMS.items() for x, ts in by.items() for k, t in enumerate(ts)) + ") v(category, language, pos, term)"
for _c in TERMS:
    add(f"keyword_{_c}", f"SELECT seq, round({keyword([_c])}, 6) AS score FROM feed WHERE {keyword([_c])} > 0", "feed")
add("keyword_fallback", f"SELECT seq, language, round({keyword(list(TERMS), {'it': ['quiet day', 'park'], 'de': ['und']})}, 6) AS score FROM feed", "feed")
_frequent = {"en": ["the", "thand", "thatin"], "es": ["de", "que"], "fr": ["le", "des"], "de": ["der", "die"]}
_own = " ".join(f"WHEN '{x}' THEN {of_terms(t)}" for x, t in _frequent.items())
ORACLE["keyword_documents"] = f"SELECT doc_id AS seq, round(CASE lang {_own} ELSE 0::DOUBLE END, 6) AS score FROM documents"
_found = " + ".join(f"CAST(regexp_matches(text, {q(p)}, 'i') AS INT)" for p in (r"https?://\S+", r"case \d*7\b", r"ATTENTAT|tornado"))
add("pattern_rule", f"SELECT seq, round(least(0.4::DOUBLE + ({_found})::DOUBLE / 3 * 0.6::DOUBLE, 1), 6) AS score FROM feed WHERE {_found} > 0", "feed")
add("rule_engine", "SELECT seq, round(score, 6) AS score, severity, matched_rules, suggested_types, dedup_key FROM scored", "scored")
add("keyword_posts", "SELECT seq, " + ", ".join(f"round({keyword([c])}, 6) AS {c}" for c in TERMS) + " FROM posts", "posts")
add("rule_engine_posts", "SELECT seq, round(score, 6) AS score, severity, matched_rules, suggested_types, dedup_key FROM p_scored", "p_scored")
add("signal_metadata", "SELECT seq, seq AS k, coalesce(anomaly_count, CASE WHEN seq % 3 = 0 THEN -1 END) AS anomaly_count, anomaly_bucket FROM signals", "signals")
add("matched_rules", "SELECT rule, count(*) AS n FROM (SELECT unnest(string_split(matched_rules, ',')) AS rule FROM scored) GROUP BY rule", "scored")
add("suggested_types", "SELECT suggested_types AS types, count(*) AS n FROM scored GROUP BY 1", "scored")
ORACLE["dedup_key"] = f"SELECT doc_id AS seq, {KEY} AS dedup_key FROM documents"
_all = CTE["ranked"].split(" WHERE")[0]
ORACLE["dedup_running_max"] = sql(f"SELECT seq, dedup_key, round(score, 6) AS score FROM ({_all}) WHERE best IS NULL OR score > best", "scored")
add("min_confidence", "SELECT seq, round(score, 6) AS score FROM ranked WHERE (best IS NULL OR score > best) AND score >= 0.9", "ranked")
add("severity_assign", f"SELECT seq, {SEVERITY} AS severity FROM (SELECT seq, (seq % 101)::DOUBLE / 100 AS score FROM feed)", "feed")
add("severity_filter", "SELECT seq, severity FROM signals WHERE severity <= 'P1'", "signals")
add("severity_histogram", "SELECT s AS severity, count(seq) AS n FROM (SELECT unnest(['P0', 'P1', 'P2', 'P3', 'P4']) AS s) LEFT JOIN signals ON severity = s AND severity <= 'P3' GROUP BY s", "signals")
add("escalation_count", "SELECT count(*) AS signals, count(*) FILTER (severity IN ('P0', 'P1')) AS escalations FROM signals", "signals")
_at = f"CASE WHEN seq % 4 = 0 THEN {NOW} ELSE make_timestamp(((timestamp + CASE WHEN seq % 4 = 1 THEN 0.25 ELSE 0 END) * 1000000)::BIGINT) END"
ORACLE["signal_id"] = sql(f"SELECT seq, 'SIG-' || strftime({_at}, '%Y%m%d-%H%M%S') || '-' || upper(substring(dedup_key, 1, 6)) AS signal_id, strftime({_at}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN seq % 4 = 1 THEN '.250000' ELSE '' END || '+00:00' AS created_at FROM ({_all}) WHERE best IS NULL OR score > best", "scored")
add("monitor_signals", "SELECT seq, signal_id, source, language, round(score, 6) AS score, severity, matched_rules, suggested_types, dedup_key, created_at, anomaly_bucket, anomaly_count FROM signals", "signals")
add("anomaly_boost", "SELECT seq, round(score, 6) AS score, severity FROM signals WHERE anomaly_bucket IS NOT NULL", "signals")
add("volume_buckets", "SELECT run, bucket, n FROM e_runs WHERE next_seq IS NOT NULL", "e")
_mean1, _std1 = average("n1", "s1"), deviation("n1", "s1", "q1")
add("volume_anomaly", f"SELECT bucket, n AS count, round(z, 6) AS z_score, round({_mean1}, 6) AS mean, round({_std1}, 6) AS std, next_seq FROM e_anomalies", "e")
_z = z("d", "n0", "s0", "q0")
add("velocity_anomaly", f"SELECT seq, d::DOUBLE AS delta, round({_z}, 6) AS z_score, round({_mean1}, 6) AS mean_delta FROM (SELECT *, {frames('d', 30, 'seq')} FROM (SELECT seq, x - lag(x) OVER (ORDER BY seq) AS d FROM counts) WHERE d IS NOT NULL) WHERE n0 >= 5 AND {_z} > 3", "counts")
add("sliding_stats", f"SELECT seq, n1 AS n, round({_mean1}, 6) AS mean, round({_std1}, 6) AS std, round({z('x', 'n0', 's0', 'q0')}, 6) AS z_score FROM (SELECT *, {frames('x', 20, 'seq')} FROM counts) WHERE seq >= 2", "counts")
add("row_batches", "SELECT seq * 3 + seq % 2 AS seq, (row_number() OVER (ORDER BY seq) - 1) // 64 AS batch FROM feed", "feed")
_half = "threshold = 0.5::DOUBLE"
add("golden_join", f"SELECT example_id, pos, array_to_string(true_labels, ',') AS true_labels, true_severity, found, array_to_string(counted, ',') AS counted_labels, predicted_severity, confidence FROM pairs WHERE {_half}", "pairs")
add("label_universe", "SELECT label FROM universe", "universe")
add("confusion_per_label", f"SELECT label, tp, fp, fn, tn FROM confusion WHERE {_half}", "confusion")
_f1 = lambda p, r: f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0::DOUBLE END"
add("label_prf", f"SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round({_f1('p', 'r')}, 6) AS f1 FROM rates WHERE threshold = 0", "rates")
_macro = f"round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round({_f1('mp', 'mr')}, 6) AS macro_f1"
add("macro_metrics", f"SELECT {_macro} FROM means WHERE {_half}", "means")
add("threshold_sweep", f"SELECT threshold, {_macro} FROM means", "means")
add("severity_accuracy", f"SELECT count(*) AS total_examples, round(count(*) FILTER (true_severity = predicted_severity)::DOUBLE / count(*), 6) AS severity_accuracy FROM pairs WHERE {_half}", "pairs")
add("fn_audit", f"SELECT example_id, text_preview, array_to_string(missed, ',') AS missed_labels, array_to_string(shown, ',') AS predicted_labels, confidence FROM missed_rows WHERE {_half}", "missed_rows")
_modes = f"""SELECT 1 AS rank, label, 'Low recall on ''' || label || ''' (' || printf('%.2f', r) || ') -- model may be under-detecting this category' AS mode FROM rates WHERE {_half} AND r < 0.5 AND tp + fn >= 2
UNION ALL SELECT 2, label, 'Low precision on ''' || label || ''' (' || printf('%.2f', p) || ') -- model may be over-triggering on this category' FROM rates WHERE {_half} AND p < 0.5 AND tp + fp >= 2
UNION ALL SELECT 3, '', count(*) || ' high-confidence false negatives -- model is confident but missing labels, calibration issue' FROM missed_rows WHERE {_half} AND confidence > 0.7 HAVING count(*) >= 2"""
add("failure_modes", _modes, "rates", "missed_rows")
_a, _b, _c2 = BOOSTED_PROMPT
add("boosted_prompt", f"SELECT {q(_a)} || string_agg('- ' || mode, chr(10) ORDER BY rank, label) || {q(_b + NO_NOTES + _c2 + SYSTEM_PROMPT)} AS prompt FROM ({_modes})", "rates", "missed_rows")
add("simulation_windows", "SELECT seq, window_id FROM all_placed", "all_placed")
add("simulation_signals", "SELECT seq, window_id, round(score, 6) AS score FROM replayed", "replayed")
add("simulation_timeline", "SELECT * FROM timeline", "timeline")
add("detection_rate", "SELECT sum(records)::BIGINT AS total_records, sum(signals)::BIGINT AS total_signals, count(*) AS total_windows, round(sum(signals)::DOUBLE / sum(records), 6) AS detection_rate FROM timeline", "timeline")
add("first_detection", "SELECT min(\"window\") FILTER (signals > 0) AS first_detection FROM timeline", "timeline")
add("batch_sitrep", "SELECT seq, batch, incident_id FROM incidents", "incidents")
add("sitrep_metrics", "SELECT incident_id, signal_count, unique_sources, languages FROM facts", "facts")
add("sitrep_types", "SELECT incident_id, coalesce(incident_types, '') AS incident_types FROM facts LEFT JOIN typed USING (incident_id)", "facts", "typed")
_words = "array_to_string(list_transform(list_slice(string_split(incident_types, ','), 1, 3), lambda t: array_to_string(list_transform(string_split(t, '_'), lambda w: upper(w[1]) || w[2:]), ' ')), ', ')"
_title = f"CASE WHEN incident_types IS NOT NULL THEN {_words} || ' Incident' ELSE 'Incident ' || incident_id END"
_summary = f"'Detected ' || signal_count || ' signals across ' || unique_sources || ' source(s). Languages: ' || replace(languages, ',', ', ') || '. Incident types: ' || coalesce(replace(incident_types, ',', ', '), '') || '.' || CASE WHEN urgent THEN ' {HIGH}' ELSE '' END"
add("sitrep_header", f"SELECT incident_id, {_title} AS title, severity, {_summary} AS summary FROM facts LEFT JOIN typed USING (incident_id)", "facts", "typed")
_templates = ", ".join(f"({q(t)}, {k}, {q(a)}, {q(p)}, {q(o)})" for t, acts in ACTIONS.items() for k, (a, p, o) in enumerate(acts))
add("sitrep_actions", f"SELECT incident_id, (row_number() OVER (PARTITION BY incident_id ORDER BY place, k) - 1)::INT AS pos, action, priority, owner FROM mentions JOIN (VALUES {_templates}) a(t, k, action, priority, owner) USING (t)", "mentions")
add("sitrep_signals", "SELECT incident_id, seq, signal_id FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY seq) AS k FROM incidents) WHERE k <= 5", "incidents")
add("sitrep_classifications", """SELECT incident_id, string_agg(t, ',' ORDER BY place) AS incident_types FROM (SELECT incident_id, t, min(place) AS place FROM
(SELECT incident_id, t, (0, place[1], place[2]) AS place FROM mentions UNION ALL SELECT i.incident_id, l.incident_type, (1, i.seq, l.pos + 1) FROM incidents i JOIN labelled l ON l.signal_id = 'S-' || i.seq)
GROUP BY ALL) GROUP BY incident_id""", "mentions", "labelled")  # fmt: skip
_wording = " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in SEVERITY_DESCRIPTIONS.items())
CTE["shown"] = "SELECT incident_id, string_agg('- `' || signal_id || '` [' || severity || '] ' || substring(text, 1, 120) || '...', chr(10) ORDER BY seq) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY seq) AS k FROM incidents) WHERE k <= 5 GROUP BY incident_id"
CTE["todo"] = f"SELECT incident_id, string_agg(n || '. **[' || upper(priority) || ']** ' || action || ' (Owner: ' || owner || ')', chr(10) ORDER BY n) AS acts FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY place, k) AS n FROM mentions JOIN (VALUES {_templates}) a(t, k, action, priority, owner) USING (t)) GROUP BY incident_id"
NEEDS |= {"shown": ["incidents"], "todo": ["mentions"]}
_lines = [
    f"'# SITREP: ' || {_title}", "''", "'**Incident ID:** ' || incident_id", f"'**Severity:** ' || severity || ' — ' || CASE severity {_wording} END", "'**Status:** active'", "'**Types:** ' || coalesce(replace(incident_types, ',', ', '), '')",
    "'**Created:** 2024-01-01T05:00:00+00:00'", "''", "'## Summary'", "''", _summary, "''", "'## Metrics'", "''", "'| Metric | Value |'", "'|--------|-------|'", "'| Signals detected | ' || signal_count || ' |'", "'| Unique sources | ' || unique_sources || ' |'",
    "'| Languages | ' || replace(languages, ',', ', ') || ' |'", "'| First seen | N/A |'", "'| Last seen | N/A |'", "'| Peak velocity | 0.0 signals/min |'", "''", "'## Recommended Actions'", "''", "coalesce(acts, '_No actions recommended._')", "chr(10) || '## Raw Signals' || chr(10) || chr(10) || raw",
]
add("sitrep_markdown", f"SELECT incident_id, concat_ws(chr(10), {', '.join(_lines)}) || chr(10) AS markdown FROM facts LEFT JOIN typed USING (incident_id) LEFT JOIN todo USING (incident_id) LEFT JOIN shown USING (incident_id)", "facts", "typed", "todo", "shown")
CTE["shift"] = f"SELECT incident_id, CASE WHEN incident_id < 'INC-SIG-20240101-02' THEN 'P3' ELSE severity END AS level, ('0x' || substring(md5(incident_id), 1, 8))::BIGINT AS pos, {_title} AS title, incident_types, {_summary} AS summary FROM facts LEFT JOIN typed USING (incident_id)"
CTE["calm"] = "SELECT coalesce((SELECT count(*) || ' low-severity signals under monitoring. Types: ' FROM shift WHERE level IN ('P3', 'P4') HAVING count(*) > 0) || (SELECT coalesce(string_agg(DISTINCT t, ', ' ORDER BY t), '') FROM mentions JOIN shift USING (incident_id) WHERE level IN ('P3', 'P4')) || '.', '') AS calm"
NEEDS |= {"shift": ["facts", "typed"], "calm": ["shift", "mentions"]}
add("handover", "SELECT (SELECT string_agg(incident_id || ':' || level || ':' || title, ';' ORDER BY level, pos) FROM shift) AS active, 'completed:Called the desk;escalated:Ask legal' AS taken, 'pending:Check the feed;deferred:Tidy rules' AS pending, 'INC-1' AS resolved, calm AS emerging_signals_summary, '2024-01-01T05:00:00+00:00' AS shift_start, 'kim' AS analyst, 'calm' AS notes FROM calm", "shift", "calm")
_incident = "'- **' || incident_id || '** [' || level || '] ' || title || ' (' || coalesce(replace(incident_types, ',', ', '), '') || ') -- active' || chr(10) || '  - ' || substring(summary, 1, 200)"
_parts = [
    "'# Shift Handover Summary'", "'**Shift:** 2024-01-01T05:00:00+00:00 -- 2024-01-01T05:00:00+00:00' || chr(10) || '**Analyst:** kim'", "'## Active Incidents'", f"(SELECT string_agg({_incident}, chr(10) ORDER BY level, pos) FROM shift)", "'## Resolved This Shift'", "'- INC-1'",
    "'## Actions Taken'", "'- [COMPLETED] Called the desk (ana)' || chr(10) || '- [ESCALATED] Ask legal'", "'## Pending / Requires Follow-up'", "'- **Check the feed**' || chr(10) || '  - again at noon' || chr(10) || '- **Tidy rules** (Owner: bo)'",
    "CASE WHEN calm <> '' THEN '## Emerging Signals' || chr(10) || chr(10) || calm END", "'## Analyst Notes'", "'calm'",
]
add("handover_markdown", f"SELECT concat_ws(chr(10) || chr(10), {', '.join(_parts)}) || chr(10) AS markdown FROM calm", "shift", "calm")
add("llm_fence", "SELECT seq, body FROM bodies", "bodies")
add("llm_parse", "SELECT signal_id, CASE WHEN good AND json_extract_string(j, '$.overall_severity') IN ('P0', 'P1', 'P2', 'P3', 'P4') THEN json_extract_string(j, '$.overall_severity') ELSE 'P4' END AS severity, CASE WHEN good THEN coalesce(TRY_CAST(json_extract_string(j, '$.requires_human_review') AS BOOLEAN), false) ELSE true END AS requires_human_review, CASE WHEN good THEN json_extract_string(j, '$.escalation_note') ELSE 'Failed to parse LLM response as JSON' END AS escalation_note FROM parsed", "parsed")
add("llm_labels", "SELECT signal_id, pos::INT AS pos, incident_type, round(confidence, 6) AS confidence, reasoning FROM labelled", "labelled")
add("primary_type", "SELECT p.signal_id, max(l.incident_type) FILTER (l.pos = 0) AS primary_type, round(coalesce(max(l.confidence), 0), 6)::DOUBLE AS max_confidence FROM parsed p LEFT JOIN labelled l USING (signal_id) GROUP BY p.signal_id", "parsed", "labelled")
_p = [q(x) for x in USER_PROMPT]
add("classification_prompt", f"SELECT seq, {_p[0]} || text || {_p[1]} || source || {_p[2]} || language || {_p[3]} AS prompt FROM feed", "feed")
add("prompt_posts", f"SELECT seq, sha256({_p[0]} || text || {_p[1]} || source || {_p[2]} || language || {_p[3]}) AS prompt FROM posts", "posts")
ORACLE["backoff_schedule"] = "SELECT k AS attempt, least(power(2::DOUBLE, k), 30::DOUBLE) AS seconds FROM (SELECT unnest(range(8)) AS k)"
_list = lambda c: f"'[' || CASE WHEN {c} = '' THEN '' ELSE '\"' || replace({c}, ',', '\",\"') || '\"' END || ']'"
_body = f"""'{{"alert_type":"signal","signal_id":"' || signal_id || '","severity":"' || severity || '","score":' || CAST(round(score, 4) AS VARCHAR) || ',"text":"' || substring(text, 1, 500) || '","source":"' || source || '","language":"' || language || '","matched_rules":' || {_list('matched_rules')} || ',"suggested_types":' || {_list('suggested_types')} || ',"created_at":"' || created_at || '"}}'"""
add("webhook_payload", f"SELECT seq, {_body} AS payload FROM signals WHERE severity <= 'P1'", "signals")
_pads = ["".join(f"\\x{b ^ x:02X}" for b in b"s3cret".ljust(64, b"\0")) for x in (0x36, 0x5C)]
add("webhook_signature", f"SELECT seq, 'sha256=' || sha256('{_pads[1]}'::BLOB || unhex(sha256('{_pads[0]}'::BLOB || encode({_body})))) AS signature FROM signals WHERE severity <= 'P1'", "signals")
add("pipeline_summary", "SELECT count(*) AS total_signals, count(*) FILTER (severity IN ('P0', 'P1')) AS escalations, (SELECT count(DISTINCT incident_id) FROM incidents) AS total_sitreps, 0::BIGINT AS total_classifications, 0::BIGINT AS total_errors FROM signals", "signals", "incidents")
