import json
import random

import pytest
from pyspark.sql import functions as F

from beaconry.config import Config, Detection, Thresholds
from beaconry.functions import text as X
from beaconry.operators import anomaly, detect, order, simulate
from beaconry.operators.rules import KeywordRule, PandasRule, PatternRule, RuleEngine
from beaconry.plans.inputs import derived

SCHEMA = "seq long, text string, source string, language string, timestamp double"


def records(spark, rows):
    full = [(k, r[0], "s", *(r[1:] or ("en",)), *([0.0] if len(r) < 3 else [])) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def scores(spark, rule, rows):
    return [r[0] for r in records(spark, rows).orderBy("seq").select(rule.score()).collect()]


def test_thresholds():
    t = Thresholds(p0_threshold=0.9, p1_threshold=0.8)
    assert (t.assign(0.9), t.assign(0.89), Thresholds().assign(0.1)) == ("P0", "P1", "P4")
    with pytest.raises(ValueError):
        Thresholds(p0_threshold=1.2)


def test_keyword_scores(spark):
    rule = KeywordRule("v", ["violence"])
    got = scores(spark, rule, [("shooting reported",), ("shooting and bombing",), ("troubleshooting",), ("Überfall!", "de"), ("shooting", "it"), ("",), (None,)])
    assert got == pytest.approx([0.7375, 1.0, 0.0, 0.7375, 0.7375, 0.0, 0.0])


def test_custom_terms_with_signs(spark):
    rule = KeywordRule("c", ["none"], {"en": ["c++", "it's", "a.b"]})
    assert scores(spark, rule, [("c++ x",), ("c++x",), ("it's",), ("a.b",), ("axb",)]) == pytest.approx([0.0, 1.0, 1.0, 1.0, 0.0])


def test_patterns(spark):
    rule = PatternRule("p", [r"\d{3}-\d{4}", r"@\w+"])
    assert scores(spark, rule, [("call 555-1234 @me",), ("@ME",), ("none",)]) == pytest.approx([1.0, 0.7, 0.0])


def test_pandas_rule(spark):
    engine = RuleEngine([PandasRule("long", lambda t, x: min(len(t) / 10, 1.0), 2.0)])
    assert [r.score for r in engine.scores(records(spark, [("abc",), ("",)])).collect()] == pytest.approx([0.3])


def test_engine_anchors(spark):
    rows = [("shooting reported",), ("Earthquake hits the region",), ("https://x.y",), ("shooting https://x.y",), ("shooting earthquake",), ("nothing",), (" 　",)]
    got = {r.seq: r for r in RuleEngine().scores(records(spark, rows)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    assert [got[k].score for k in range(5)] == pytest.approx([0.7375, 0.883333333, 1.0, 0.814705882, 0.803787879])
    assert [got[k].severity for k in range(5)] == ["P2", "P1", "P0", "P2", "P2"]
    assert got[2].suggested_types == [] and got[4].suggested_types == ["violent_extremism", "natural_disaster"]


def test_key_and_id(spark):
    r = spark.createDataFrame([("hello  world", 1742038200.0), (" hello world ", 0.5)], "t string, ts double")
    got = r.select(X.dedup_key(F.col("t")).alias("k"), X.iso_time(X.moment(F.col("ts"))).alias("at")).collect()
    assert {x.k for x in got} == {"b94d27b9934d3e08"}
    assert got[0].at == "2025-03-15T11:30:00+00:00" and got[1].at == "1970-01-01T00:00:00.500000+00:00"


def test_running_max(spark):
    rows = spark.createDataFrame([(0, "a", 0.5), (1, "a", 0.5), (2, "a", 0.7), (3, "a", 0.6), (4, "b", 0.1)], "seq long, dedup_key string, score double")
    assert sorted(r.seq for r in detect.running_max_dedup(rows).collect()) == [0, 2, 4]


def test_weak_record_holds_back_later_copy(spark):
    rows = records(spark, [("shooting", "en"), ("shooting", "en")])
    assert detect.monitor(rows, Detection(min_confidence=0.9)).count() == 0


def reference_monitor(rows):
    """Row by row, from the written semantics; rows: (seq, score, key, timestamp)."""
    best, out, seen, bucket, n = {}, [], [], None, 0
    for seq, score, key, ts in rows:
        if key in best and score <= best[key]:
            continue
        best[key] = score
        hit = False
        if ts > 0:
            b = int(ts) // 60
            if bucket is not None and b != bucket:
                mean = sum(seen) / len(seen) if seen else 0
                var = sum(x * x for x in seen) / len(seen) - mean * mean if len(seen) > 1 else 0
                std = 0 if len(set(seen)) < 2 else max(var, 0) ** 0.5
                z = (n - mean) / std if std else (0 if n == mean else float("inf"))
                hit = len(seen) >= 10 and z > 2.5
                seen = [*seen, n][-60:]
                n = 0
            bucket, n = b, n + 1
        out.append((seq, round(min(score * 1.15, 1.0) if hit else score, 9)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_monitor_against_row_by_row(spark, seed):
    rng = random.Random(seed)
    t, rows = 1e6, []
    for k in range(700):
        t += rng.choice([0, 1, 5, 20, 40, -30]) if rng.random() < 0.97 else rng.choice([300, -200])
        text = rng.choice(["shooting", "earthquake", "bot  network", "bot network", "raid shooting"]) + f" {rng.randrange(400) if rng.random() < 0.5 else k}"
        rows.append((k, text, "s", "en", float(t) if rng.random() < 0.95 else 0.0))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.seq, round(r.score, 9)) for r in detect.monitor(frame).collect())
    scored = {r.seq: r for r in RuleEngine().scores(frame).collect()}
    assert got == reference_monitor([(k, scored[k].score, scored[k].dedup_key, r[4]) for k, r in enumerate(rows) if k in scored])


def test_feed_counts(spark):
    out = detect.monitor(derived(spark, "/root/testdata/sf0.001", "feed"))
    got = {r.severity: r.n for r in out.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    assert got == {"P0": 70, "P1": 39, "P2": 19} and out.filter("volume_anomaly is not null").count() == 1


def test_steady_stream_and_row_index(spark):
    rows = spark.range(600).select((F.col("id") * 3).alias("seq"), (F.col("id") + 1).cast("double").alias("timestamp"))
    assert anomaly.volume_anomalies(rows, 10).count() == 0
    assert [r.row_index for r in order.row_index(rows, block=64).orderBy("seq").collect()] == list(range(600))
    assert order.runs(rows, F.floor(F.col("timestamp") / 10), block=7).count() == 61


def test_blocks_do_not_show(spark):
    """Small blocks give what one block gives, also where runs go over their edges and times are out of order."""
    rng = random.Random(4)
    rows, t = [], 1e6
    for k in range(600):
        t += rng.choice([0, 0, 0, 3, 20, -15]) if rng.random() < 0.95 else 200
        rows.append((3 * k + rng.randrange(3), t, rng.randrange(50) + (400 if k % 97 == 0 else 0)))
    frame = spark.createDataFrame(rows, "seq long, timestamp double, x long")
    as_set = lambda df: sorted(map(tuple, df.collect()))
    for f in (
        lambda block: order.runs(frame, F.floor(F.col("timestamp") / 10), block),
        lambda block: anomaly.buckets(frame, 10, block),
        lambda block: anomaly.volume_anomalies(frame, 10, history=12, threshold=1.0, least=3, block=block),
        lambda block: anomaly.velocity_anomalies(frame, window=9, threshold=1.0, block=block),
        lambda block: anomaly.sliding_stats(frame, F.col("x"), 15, block),
    ):
        want = as_set(f(order.BLOCK))
        assert want and as_set(f(5)) == want


@pytest.mark.parametrize("seed", range(2))
def test_anchors_against_walk(spark, seed):
    rng = random.Random(seed)
    times = sorted({rng.choice([rng.uniform(-500, 4000), float(rng.randrange(4000)), rng.uniform(9000, 9300)]) for _ in range(900)})
    want = []
    for t in times:
        if not want or t >= want[-1] + 100:
            want.append(t)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(times * 2)], "seq long, timestamp double")
    for span in (1, 3, 16):
        got = simulate.anchors(rows, 100.0, span).orderBy("window_id").collect()
        assert [r.window_id for r in got] == list(range(len(want))) and [r.anchor for r in got] == want


def test_metadata_is_merged(spark):
    a = "struct<bucket: long, count: long, z_score: double, mean: double, std: double>"
    rows = [(0, '{"b": 1, "volume_anomaly": 3}', (1, 2, 3.0, 4.0, 5.0)), (1, '{"volume_anomaly": 3}', None), (2, "bad", None), (3, None, (1, 2, float("inf"), 1.0, 0.0)), (4, "[1]", None)]
    frame = spark.createDataFrame(rows, f"k int, m string, a {a}").select("k", detect.merged_metadata(F.col("m"), F.col("a")).alias("out"))
    got = {r.k: json.loads(r.out) for r in frame.collect()}
    assert got[0] == {"b": 1, "volume_anomaly": {"bucket": 1, "count": 2, "z_score": 3.0, "mean": 4.0, "std": 5.0}} and got[1] == {"volume_anomaly": 3}
    assert got[2] == got[4] == {} and got[3]["volume_anomaly"]["z_score"] is None


def test_replay_windows(spark):
    rows = spark.createDataFrame([(0, 500.0), (1, 100.0), (2, 105.0), (3, 200.0), (4, 305.0)], "seq long, timestamp double")
    assert [r.anchor for r in simulate.anchors(rows, 100).orderBy("anchor").collect()] == [100, 200, 305, 500]
    assert {r.seq: r.window_id for r in simulate.windows(rows, 100).collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 0: 3}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert detect.monitor(none).count() == 0 and simulate.timeline(none).count() == 0
    assert simulate.totals(simulate.timeline(none)).first().detection_rate == 0.0


def test_config_round_trip(tmp_path):
    c = Config(detection=Detection(languages=("en",)))
    c.save(tmp_path / "c.yaml")
    assert Config.load(tmp_path / "c.yaml") == c
    (tmp_path / "e.yaml").write_text("")
    assert Config.load(tmp_path / "e.yaml") == Config()
    with pytest.raises(FileNotFoundError):
        Config.load(tmp_path / "none.yaml")
