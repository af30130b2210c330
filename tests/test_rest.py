import hashlib
import hmac
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from beaconry.cli import main
from beaconry.config import Classification, Config, Notifications, Provider, Webhook
from beaconry.operators import classify, notify, reports
from beaconry.operators.classify import Classifier, TransportError, create_provider
from beaconry.operators.evaluate import GoldenSet, boost
from beaconry.pipeline import Pipeline
from beaconry.sources import records as io
from beaconry.streaming.monitor import volume_stream

GOLDEN = "example_id string, pos long, text string, true_labels array<string>, true_severity string"
PREDICTION = "example_id string, pos long, predicted_labels array<string>, predicted_severity string, confidence double"


def golden_case(spark):
    golden = [
        ("G1", 0, "a", ["violent_extremism"], "P0"), ("G2", 1, "b", ["natural_disaster"], "P1"), ("G3", 2, "c", ["platform_manipulation", "misinformation"], "P2"),
        ("G4", 3, "d", [], "P4"), ("G5", 4, "e", ["self_harm"], "P1"), ("G6", 5, "f", ["data_breach"], "P1"),
    ]
    preds = [("G1", 0, ["violent_extremism"], "P0", 0.9), ("G2", 1, ["natural_disaster"], "P1", 0.9), ("G3", 2, ["platform_manipulation"], "P2", 0.8), ("G4", 3, ["other"], "P3", 0.45), ("G5", 4, ["self_harm"], "P1", 0.9)]
    return GoldenSet(spark.createDataFrame(golden, GOLDEN)), spark.createDataFrame(preds, PREDICTION)


def test_golden_set(spark):
    g, p = golden_case(spark)
    r = g.evaluate(p, 0.5)
    m = r["macro"].first()
    assert (m.macro_precision, m.macro_recall, m.macro_f1) == pytest.approx((1.0, 4 / 6, 0.8))
    assert r["severity"].first().severity_accuracy == pytest.approx(4 / 6)
    assert sorted(x.example_id for x in r["audit"].collect()) == ["G3", "G6"]
    assert r["failure_modes"].count() == 0 and "Macro F1:        0.800" in g.summary(p, 0.5)
    assert g.size() == 6 and g.evaluate(p, None)["macro"].count() == 5
    assert g.add(spark.createDataFrame([("G1", 0, "z", ["other"], "P4")], GOLDEN)).size() == 6


def test_responses(spark):
    rows = [
        ("a", '{"labels": [{"type": "self_harm", "confidence": 0.9}, {"type": "other", "confidence": 0.95}], "overall_severity": "P1"}'),
        ("b", "```json\n{\"labels\": []}\n```\ntail"), ("c", "{bad"), ("d", "[1]"), ("e", None), ("f", '{"labels": [{"type": "nope", "confidence": 1}, 3, {"type": "other"}, {"type": "other", "confidence": "x"}]}'), ("g", ""),
    ]
    got = {r.signal_id: r for r in classify.parse_responses(spark.createDataFrame(rows, "signal_id string, response string"), Classification(confidence_threshold=0.0)).collect()}
    assert [x.incident_type for x in got["a"].labels] == ["other", "self_harm"] and got["a"].severity == "P1"
    assert [got[k].requires_human_review for k in "abcdefg"] == [False, False, True, True, True, False, True]
    assert [(x.incident_type, x.confidence) for x in got["f"].labels] == [("other", 0.0)]


def test_classifier_retries(spark):
    calls = []

    def transport(url, headers, body, timeout):
        calls.append(url)
        raise TransportError(401 if "once" in url else None)

    for base, n in (("https://x", 3), ("https://once", 1)):
        calls.clear()
        with pytest.raises(TransportError):
            create_provider(Provider(max_retries=2, api_base=base), transport).complete("s", "u", sleep=lambda s: None)
        assert len(calls) == n
    with pytest.raises(ValueError):
        create_provider(Provider(provider="none"))


def test_classifier_over_rows(spark):
    def transport(url, headers, body, timeout):
        if b"fail" in body:
            raise TransportError(400, "no")
        return json.dumps({"choices": [{"message": {"content": '{"labels": [{"type": "other", "confidence": 0.9}], "overall_severity": "P3"}'}}]}).encode()

    c = Classifier(create_provider(Provider(), transport))
    rows = spark.createDataFrame([("1", "fine", "s", "en"), ("2", "fail", "s", "en")], "signal_id string, text string, source string, language string")
    got = {r.signal_id: r for r in c.classify(rows).collect()}
    assert got["1"].severity == "P3" and got["2"].requires_human_review and "no" in got["2"].escalation_note
    c.add_failure_mode("misses satire")
    assert "- misses satire" in c.system_prompt
    c.reset()
    assert c.system_prompt == classify.SYSTEM_PROMPT


def test_signature_and_delivery(spark):
    body = '{"ü": 1}'
    for secret in ("k", "long" * 40):
        got = spark.createDataFrame([(body,)], "b string").select(notify.signature(F.col("b"), secret)).first()[0]
        assert got == "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    for statuses, n in (([400], 1), ([503, 200], 2), ([None, 500, 502, 503], 4)):
        todo, calls = list(statuses), []

        def transport(url, headers, data, timeout):
            calls.append(headers)
            s = todo.pop(0)
            if s != 200:
                raise TransportError(s)
            return b""

        notify.deliver(body, "sha256=x", Webhook("u"), transport, sleep=lambda s: None)
        assert len(calls) == n and calls[0][notify.SIGNATURE] == "sha256=x"


def signals(spark):
    rows = [("I", 0, "S0", "shots", "a", "en", 0.9, "P1", ["violent_extremism"]), ("I", 1, "S1", "flood", "b", "fr", 0.95, "P2", ["natural_disaster", "violent_extremism"])]
    return spark.createDataFrame(rows, "incident_id string, seq long, signal_id string, text string, source string, language string, score double, severity string, suggested_types array<string>")


def test_sitrep_and_handover(spark):
    s = reports.sitreps(signals(spark))
    r = s.first()
    assert (r.title, r.severity) == ("Violent Extremism, Natural Disaster Incident", "P2") and len(r.recommended_actions) == 6
    text = reports.sitrep_markdown(s, F.lit("now"), True).first().markdown
    assert "- `S0` [P1] shots..." in text and "| Languages | en, fr |" in text and text.endswith("\n")
    none = reports.sitrep_markdown(reports.empty_sitrep(spark, "X"), F.lit("now")).first().markdown
    assert "# SITREP: Incident X" in none and "_No actions recommended._" in none
    h = reports.handover(s.withColumn("pos", F.lit(0).cast("long")))
    out = reports.handover_markdown(h).first().markdown
    assert "- **I** [P2]" in out and "_No pending actions._" in out and "Emerging" not in out


def test_read_records(spark, tmp_path):
    lines = ['{"text": "shooting now", "timestamp": "5", "x": 1}', "", "bad", '{"text": 3}', '{"text": "a", "source": null}', "[1]", '{"text": "b", "metadata": {"k": 1}}']
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    got = io.read_records(spark, str(tmp_path / "r.jsonl")).orderBy("seq").collect()
    assert [(r.text, r.source, r.language, r.timestamp) for r in got] == [("shooting now", "unknown", "en", 5.0), ("b", "unknown", "en", 0.0)]


def test_bad_predictions_raise(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"example_id": "a", "predicted_labels": ["nope"]}\n')
    with pytest.raises(Exception, match="unknown label"):
        io.read_predictions(spark, str(tmp_path / "p.jsonl")).collect()


def feed_lines():
    return "".join(json.dumps({"seq": k, "text": f"{'shooting' if k % 3 else 'bot  network'} case {k % 7}", "timestamp": 1000.0 + 7 * k}) + "\n" for k in range(60))


def test_pipeline_and_cli(spark, tmp_path, capsys):
    path = tmp_path / "f.jsonl"
    path.write_text(feed_lines() + '{"text": "shooting and bombing at https://x.y"}\n')
    r = Pipeline(spark, Config()).run_file(str(path))
    s = r.summary().first()
    assert s.total_signals == r.signals.count() > 5 and s.total_sitreps == 1 and s.total_classifications == 0
    main(["monitor", "--source", str(path), "--dry-run", "--output", str(tmp_path / "o")], spark)
    assert "records scanned" in capsys.readouterr().out and not (tmp_path / "o").exists()
    main(["monitor", "--source", str(path), "--min-severity", "P1", "--output", str(tmp_path / "o")], spark)
    assert spark.read.json(str(tmp_path / "o")).filter("severity > 'P1'").count() == 0
    main(["report", "--incident-id", "I-1"], spark)
    assert "Incident I-1" in capsys.readouterr().out


def test_webhooks_from_pipeline(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text(feed_lines())
    out = tmp_path / "sent"
    out.mkdir()

    def transport(url, headers, body, timeout):
        (out / hashlib.md5(body).hexdigest()).write_bytes(body)
        return b""

    config = Config(notifications=Notifications(True, (Webhook("https://x"),), "P4"))
    got = Pipeline(spark, config, transport=transport).run_file(str(path))
    assert len(list(out.iterdir())) == got.signals.count()


def arrive(folder, parts):
    """Files that arrive one after another."""
    folder.mkdir()
    for k, lines in enumerate(parts):
        (folder / f"{k}.jsonl").write_text("".join(lines))
        os.utime(folder / f"{k}.jsonl", (1_700_000_000 + 10 * k,) * 2)


def busy_lines(order=0):
    """Two signals a minute with their metadata, and one minute that has many."""
    times, t = [], 60_000.0
    for k in range(40):
        times += [t + j for j in range(25 if k in (20, 33) else 2 + k % 2)]
        t += 60
    return [json.dumps({"seq": k + order, "text": f"shooting at place {k if k % 4 else k % 60}", "timestamp": x, "metadata": {"k": k} | ({"volume_anomaly": "own"} if k % 50 == 7 else {})}) + "\n" for k, x in enumerate(times)]


STREAMED = ("seq", "signal_id", "score", "severity", "metadata", "created_at", "volume_anomaly", "dedup_key")


def as_rows(df):
    return sorted((tuple(r[c] for c in STREAMED) for r in df.collect()), key=lambda x: x[0])


def test_stream_equals_batch(spark, tmp_path):
    lines = busy_lines()
    for n in (1, 4):
        arrive(tmp_path / f"in{n}", [lines[a : a + 37] for a in range(0, len(lines), 37)])
        out = tmp_path / f"out{n}"
        Pipeline(spark).stream(str(tmp_path / f"in{n}"), str(out), str(tmp_path / f"c{n}"), n, availableNow=True).awaitTermination(300)
        batch = Pipeline(spark).run(io.parse_records(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "seq long, value string"))).signals
        want = as_rows(batch)
        assert as_rows(spark.read.parquet(str(out))) == want
    assert sum(r[6] is not None for r in want) == 2 and any('"own"' in r[4] for r in want)


def test_stream_goes_by_arrival(spark, tmp_path):
    lines = busy_lines()
    parts = [lines[60:], lines[:60]]
    arrive(tmp_path / "in", parts)
    Pipeline(spark).stream(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), 1, availableNow=True).awaitTermination(300)
    got = sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())
    arrived = [json.loads(x) for x in parts[0] + parts[1]]
    batch = Pipeline(spark).run(io.parse_records(spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(arrived)], "seq long, value string"))).signals
    assert got == sorted(arrived[r.seq]["seq"] for r in batch.collect())


def test_stream_alerts(spark, tmp_path):
    arrive(tmp_path / "in", [busy_lines()[:30], busy_lines()[30:60]])
    sent = tmp_path / "sent"
    sent.mkdir()

    def transport(url, headers, body, timeout):
        (sent / hashlib.md5(url.encode() + body).hexdigest()).write_bytes(body)
        return b""

    config = Config(notifications=Notifications(True, (Webhook("https://a"), Webhook("https://b", "key")), "P4"))
    Pipeline(spark, config, transport=transport).stream(str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), 1, availableNow=True).awaitTermination(300)
    assert len(list(sent.iterdir())) == 2 * spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_volume_stream(spark, tmp_path):
    assert volume_stream(spark.readStream.schema("seq long, timestamp double").json(str(tmp_path))).isStreaming


def counting(folder, answer):
    folder.mkdir()

    def transport(url, headers, body, timeout):
        (folder / uuid.uuid4().hex).write_bytes(body)
        return json.dumps({"choices": [{"message": {"content": answer(body)}}]}).encode()

    return transport


def test_one_call_for_each_signal(spark, tmp_path):
    def answer(body):
        if b"place 3" in body:
            raise TransportError(400, "no")
        return '{"labels": [{"type": "other", "confidence": 0.9}], "overall_severity": "P3"}'

    calls = tmp_path / "calls"
    c = Classifier(create_provider(Provider(), counting(calls, answer)))
    rows = spark.createDataFrame([(str(k), f"place {k}", "s", "en") for k in range(10)], "signal_id string, text string, source string, language string")
    got = c.classify(rows).collect()
    assert len(got) == 10 == len(list(calls.iterdir())) and sum(r.requires_human_review for r in got) == 1
    records = io.parse_records(spark.createDataFrame([(k, x) for k, x in enumerate(busy_lines()[:40])], "seq long, value string"))
    r = Pipeline(spark, classifier=c).run(records)
    n, s = r.signals.count(), r.summary().first()
    assert r.sitreps.count() and r.classifications.count() == n == s.total_classifications and s.total_errors == 0
    assert len(list(calls.iterdir())) == 10 + n


def test_failed_classification_is_recorded(spark):
    class Broken(Classifier):
        def classify(self, signals):
            return signals.select(F.raise_error(F.lit("down")).cast("string").alias("signal_id"))

    records = io.parse_records(spark.createDataFrame([(0, '{"text": "shooting"}')], "seq long, value string"))
    r = Pipeline(spark, classifier=Broken(create_provider())).run(records)
    assert len(r.errors) == 1 and r.errors[0].startswith("Classification failed: ") and r.summary().first().total_errors == 1
    assert r.classifications is None and r.signals.count() == 1


def test_boosting_loop(spark, tmp_path):
    """The model under-detects until its prompt says so."""

    def answer(body):
        kind = "self_harm" if b"Low recall on 'self_harm'" in body else "other"
        return json.dumps({"labels": [{"type": kind, "confidence": 0.9}], "overall_severity": "P1"})

    c = Classifier(create_provider(Provider(), counting(tmp_path / "calls", answer)))
    g = GoldenSet(spark.createDataFrame([(f"G{k}", k, "text", ["self_harm"], "P1") for k in range(3)], GOLDEN))
    rounds = [m.first().macro_f1 for m in boost(c, g)]
    assert rounds == [0.0, 1.0] and len(list((tmp_path / "calls").iterdir())) == 6
    assert any("self_harm" in m for m in c.failure_modes)


@pytest.mark.parametrize("gone", [["corpus_pipeline"], ["beaconry.llm"], ["corpus_pipeline", "beaconry.llm"]])
def test_entry_survives_without_llm(gone, tmp_path):
    """Both folders and the pipeline are deleted from a copy, as the driver does."""
    import shutil
    import subprocess
    import sys

    root = __file__.rsplit("/", 2)[0]
    shutil.copytree(f"{root}/beaconry", tmp_path / "beaconry", ignore=lambda d, names: ["llm"] if "beaconry.llm" in gone and d.endswith("beaconry") else [])
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if "corpus_pipeline" not in gone else [])):
        shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e\nassert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
