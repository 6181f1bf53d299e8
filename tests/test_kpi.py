"""The replay report on golden segments: metrics and checks by hand, the three written forms, latency from a query's progress."""

import json
import math
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from tankwise.operators import kpi as K
from tankwise.operators import tracking
from tankwise.sources.files import read_segments
from tankwise.streaming.tracking import track_stream


def documents():
    stamp = lambda i: f"2026-01-01 {i // 30:02}:{2 * i % 60:02}:00"
    fall = [200.0 - i / 2 for i in range(40)]
    flat = [150.0, 150.4, 0.0, 150.2, 150.1, 150.3]
    steep = [100.0, 40.0, 41.0, 40.5]
    some = {"max_clean_span": 25.0, "max_final_lag_liters": -1.0, "min_total_clean_drop": 10.0, "max_upward_step": 0.0, "required_motion_states": ["UNCERTAIN"]}
    rows = [
        {"id": "fall", "raw_liters": fall, "speed_kmh": [40.0] * 40, "checks": some, "review_status": "approved", "expected_production_clean_liters": [x + 1 for x in fall]},
        {"id": "flat", "raw_liters": flat, "speed_kmh": [0.0] * 6, "checks": {"zero_dropout_indexes": [2], "max_step_size": 0.0, "min_clean_liters": 150.0}, "review_status": "pending"},
        {"id": "steep", "raw_liters": steep, "speed_kmh": [0.0] * 4, "checks": {"min_valley_attenuation_liters": 30.0, "zero_dropout_indexes": [2], "required_motion_states": ["MOVING"]}, "review_status": "pending"},
    ]
    return [r | {"timestamps": [stamp(i) for i in range(len(r["raw_liters"]))], "capacity_est_liters": 300.0} for r in rows]


def detrended(v):
    mid, mean = (len(v) - 1) / 2, statistics.fmean(v)
    slope = sum((i - mid) * (x - mean) for i, x in enumerate(v)) / sum((i - mid) ** 2 for i in range(len(v)))
    return statistics.pstdev(x - mean - slope * (i - mid) for i, x in enumerate(v))


@pytest.fixture(scope="module")
def report(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden")
    (path / "g.json").write_text(json.dumps(documents()))
    segments = read_segments(spark, str(path / "g.json"))
    return K.segment_metrics(K.replayed(segments).withColumn("checks", K.settings(F.col("checks"))))


def test_metrics_and_checks_are_those_of_the_curves(report):
    rows = {r.id: r for r in report.collect()}
    assert len(rows) == 3
    for d in documents():
        state, raw = tracking.fresh(), d["raw_liters"]
        out = [tracking.step(state, 1_767_225_600_000_000 + i * 120_000_000, x, s, 300.0) for i, (x, s) in enumerate(zip(raw, d["speed_kmh"], strict=True))]
        clean = [o["clean"] for o in out]
        pairs = [(r, c) for r, c in zip(raw, clean, strict=True) if r > 0]
        noise, left = detrended([r for r, _ in pairs]), detrended([c for _, c in pairs])
        r = rows[d["id"]]
        assert r.points == len(raw) and r.raw_std == pytest.approx(statistics.pstdev(r for r, _ in pairs), abs=1e-6) and r.clean_std == pytest.approx(statistics.pstdev(clean), abs=1e-6)
        assert r.noise_reduction_percent == pytest.approx(100 * (1 - left / noise) if noise > 1e-6 else 0.0, abs=2e-3)
        want = {}
        c = d["checks"]
        rise = [b - a for a, b in zip(clean, clean[1:], strict=False)]
        want["max_clean_span"] = max(clean) - min(clean) <= c.get("max_clean_span", math.nan)
        want["min_clean_liters"] = min(clean) >= c.get("min_clean_liters", math.nan)
        want["min_valley_attenuation_liters"] = min(clean) - min(raw) >= c.get("min_valley_attenuation_liters", math.nan)
        want["min_total_clean_drop"] = clean[0] - clean[-1] >= c.get("min_total_clean_drop", math.nan)
        want["max_upward_step"] = round(max(rise), 6) <= c.get("max_upward_step", math.nan)
        want["max_final_lag_liters"] = clean[-1] - raw[-1] <= c.get("max_final_lag_liters", math.nan)
        want["max_step_size"] = round(max(map(abs, rise)), 6) <= c.get("max_step_size", math.nan)
        want["zero_dropout_indexes"] = all(out[i]["quality_flag"] == "ZERO_DROPOUT_HELD" and clean[i] == clean[i - 1] for i in c.get("zero_dropout_indexes", []))
        want["required_motion_states"] = set(c.get("required_motion_states", [])) <= {o["motion_state"] for o in out}
        assert {n: r[n] for n in K.CHECKS} == {n: want[n] if n in c else None for n in K.CHECKS}
        assert (r.checks_passed, r.checks_total) == (sum(want[n] for n in c), len(c))
        expected = d.get("expected_production_clean_liters", clean)
        assert r.regression_mae == pytest.approx(statistics.fmean(abs(a - b) for a, b in zip(clean, expected, strict=True)), abs=1e-6)
    assert rows["flat"].zero_dropout_indexes and rows["steep"].zero_dropout_indexes is False and rows["steep"].required_motion_states is False


def test_a_clean_curve_below_the_level_lags_by_nothing(spark):
    checks = F.from_json(F.lit('{"max_final_lag_liters": 1}'), K.SETTINGS)
    t = spark.createDataFrame([("a", 0, 100.0, 100.0), ("a", 1, 100.0, 60.0)], "id string, pos int, fuel double, clean double")
    t = t.selectExpr("*", "cast(null as double) as expected", "'UNCERTAIN' as motion_state", "'VALID' as quality_flag", "'approved' as review_status").withColumn("checks", checks)
    assert K.segment_metrics(t).first().max_final_lag_liters is True


def test_the_report_is_written_in_three_forms_and_the_same_twice(spark, report, tmp_path):
    durations = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    totals = K.summary(report, durations)
    t = totals.first()
    assert (t.segments, t.points, t.approved, t.pending, t.total, t.model_type) == (3, 50, 1, 2, 11, "fallback_rules") and (t.p50_ms, t.p95_ms) == (50.5, pytest.approx(95.05))
    for name in ("a", "b"):
        K.write(report, totals, str(tmp_path / name))
    texts = [[(tmp_path / name / form).glob("part-*") for form in ("metrics", "segments", "report")] for name in ("a", "b")]
    a, b = ["".join(p.read_text() for part in of for p in sorted(part)) for of in texts]
    assert a == b
    whole = json.loads(spark.read.text(str(tmp_path / "a/metrics")).first()[0])
    assert whole["segments"] == 3 and [s["id"] for s in whole["segment_metrics"]] == ["fall", "flat", "steep"]
    assert spark.read.option("header", True).csv(str(tmp_path / "a/segments")).count() == 3
    lines = [r[0] for r in spark.read.text(str(tmp_path / "a/report")).collect()]
    assert lines[0] == "Replay report" and len(lines) == 9 and "failed: " in lines[-1] and "required_motion_states" in lines[-1]


def test_latency_comes_from_the_progress_of_a_query(spark, tmp_path):
    schema = "vehicle_id string, seq long, us long, fuel double, speed double"
    spark.createDataFrame([("a", i, i * 120_000_000, 100.0, 0.0) for i in range(50)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    listener = K.Latency()
    spark.streams.addListener(listener)
    try:
        q = track_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert sum(n for _, n in listener.batches) == 50 and listener.durations(spark).count() == 50


def test_deviations_around_a_line_have_the_bits_of_the_sql(spark):
    """Nearly straight lines leave almost nothing, so the last bits of the sums decide the noise reduction."""
    cases = [[399.67, 354.67, 309.67], [346.31, 406.29, 466.27], [0.0, 579.12, 578.8, 578.49], [0.0, 506.19, 505.91, 505.62], [100.0], [80.0, 80.0, 80.0], [0.0, 0.0]]
    cases += [[round(400 - 0.3 * i + (i * 7919 + j * 104729) % 97 / 100, 2) for i in range(3 + j % 9)] for j in range(60)]
    last = lambda v, i: v[max(0, i - 7) : i + 1]
    clean = lambda v, i: sum(last(v, i)) / len(last(v, i)) if v[i] else (v[i - 1] if i else None)
    rows = [(f"s{j}", i, x, clean(v, i), None, "MOVING", "VALID", None, None) for j, v in enumerate(cases) for i, x in enumerate(v)]
    points = spark.createDataFrame(rows, f"id string, pos int, fuel double, clean double, expected double, motion_state string, quality_flag string, review_status string, checks struct<{K.SETTINGS.replace(' double', ':double').replace(' array', ':array')}>")
    got = {r[0]: tuple(r)[1:] for r in K.segment_metrics(points).select("id", "raw_std", "clean_std", "raw_detrended_std", "clean_detrended_std", "noise_reduction_percent").collect()}
    values = ", ".join(f"('{i}', {pos}, {fuel}::double, {'null' if c is None else repr(c)}::double)" for i, pos, fuel, c, *_ in rows)
    around = lambda y: f"case when count({y}) >= 3 then stddev_pop({y}) * sqrt(greatest(0, 1 - coalesce(case when stddev_pop({y}) > 0 then regr_r2({y}, i) end, 0))) else 0 end"
    want = duckdb.sql(f"""select id, round(rs, 6), round(cs, 6), round(rd, 6), round(cd, 6), round(case when round(rd, 6) > 0 then 100 * (1 - cd / rd) else 0 end, 3) + 0.0 from (
        select id, coalesce(stddev_pop(raw), 0) as rs, coalesce(stddev_pop(clean), 0) as cs, {around('raw')} as rd, {around('valid')} as cd from (
          select *, case when fuel > 0 then fuel end as raw, case when fuel > 0 then clean end as valid, case when fuel > 0 then sum(case when fuel > 0 then 1 else 0 end) over (partition by id order by pos) end as i
          from (values {values}) as t(id, pos, fuel, clean)) group by id)""").fetchall()
    assert got == {r[0]: r[1:] for r in want}
