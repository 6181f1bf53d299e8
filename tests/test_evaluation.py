import hashlib
import json

import pytest

from tankwise.operators import evaluation as E
from tankwise.operators import events as V
from tankwise.operators import feature_vector as V28
from tankwise.operators import forest as M
from tankwise.operators import offline, serving, tracking
from tankwise.operators import profile as P
from tankwise.plans.queries import telemetry
from tankwise.sources import files as S

SF = "/root/testdata/sf0.001"
MINUTES_2 = 120_000_000


def points(spark, values, **more):
    rows = [("v", i, i * MINUTES_2, v, *[x[i] for x in more.values()]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "vehicle_id string, seq long, us long, fuel double" + "".join(f", {c} string" for c in more))


def test_events_are_runs_of_shifts(spark, tmp_path):
    labels = [None, "UPWARD_SHIFT", "UPWARD_SHIFT", None, "DOWNWARD_SHIFT", "UPWARD_SHIFT"]
    t = points(spark, [50.0, 70.0, 90.0, 90.0, 60.0, 99.0], label=labels).selectExpr("*", "1.0 as lat", "2.0 as lng")
    e = V.shift_events(t)
    assert sorted((r.event_type, r.start_us // MINUTES_2, r.end_us // MINUTES_2, r.start_fuel, r.end_fuel, r.change_liters) for r in e.collect()) == [
        ("DRAIN", 3, 4, 90.0, 60.0, -30.0), ("REFUEL", 0, 2, 50.0, 90.0, 40.0), ("REFUEL", 4, 5, 60.0, 99.0, 39.0),
    ]
    V.save_events(e, str(tmp_path / "events"))
    V.save_events(e.limit(1), str(tmp_path / "events"))
    back = spark.read.parquet(str(tmp_path / "events"))
    assert back.count() == 4 and [r.end_us // MINUTES_2 for r in V.newest_events(e, 2).orderBy("place").collect()] == [5, 4]


def test_replay_of_segments_begins_afresh(spark):
    t = points(spark, [100.0, 101.0, 50.0, 51.0]).selectExpr("*", "0.0 as speed", "cast(1 + seq div 2 as long) as segment_id")
    out = E.replay(t).orderBy("seq").collect()
    assert [r.clean for r in out][::2] == [100.0, 50.0] and [r.signal_state for r in out][::2] == ["INIT", "INIT"] and [r.segment_id for r in out] == [1, 1, 2, 2] and out[1].clean_std > 0


def test_dropouts_and_required_states(spark):
    t = points(spark, [100.0, 100.0, 0.0, 0.0, 100.0])
    out = tracking.track(t)
    at = lambda places: E.held_at(out, spark.createDataFrame([("v", p) for p in places], "vehicle_id string, pos int")).first().zero_dropout_indexes
    assert at([2, 3]) is True and at([2, 4]) is False and at([9]) is False
    assert E.has_states(out, ["UNCERTAIN"]).first()[1] is True and E.has_states(out, ["UNCERTAIN", "MOVING"]).first()[1] is False


def test_latency(spark):
    r = E.latency(spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")).first()
    assert (r.p50_ms, r.p95_ms, r.p99_ms) == pytest.approx((50.5, 95.05, 99.01)) and r.points_per_second == pytest.approx(1000 * 100 / 5050)
    assert E.latency(spark.createDataFrame([], "ms double")).first().points_per_second == 0


def test_dropouts_are_lines_in_time(spark):
    got = offline.fill_dropouts(points(spark, [100.0, 80.0, 81.0, 79.0, 99.0, 60.0, 98.0, 70.0, 70.0])).orderBy("seq").collect()
    assert [round(r.cleaned, 6) for r in got] == [100.0, 99.75, 99.5, 99.25, 99.0, 98.5, 98.0, 70.0, 70.0]
    assert [r.dropout for r in got] == [None, "SENSOR_DROPOUT", "SENSOR_DROPOUT", "SENSOR_DROPOUT", None, "SPIKE", None, None, None]


def test_bumps_are_flattened_and_shifts_stay(spark):
    got = offline.flatten_bumps(points(spark, [100.0] * 5 + [105.0, 106.0, 105.0] + [100.0] * 5 + [120.0] * 6)).orderBy("seq").collect()
    assert [r.shape_clean for r in got] == [100.0] * 13 + [120.0] * 6


def test_labels_are_followed_by_share(spark):
    rules = ["REFUEL", "REFUEL", "SPIKE", "STABLE_JITTER", "CONSUMPTION", "CONSUMPTION", "DRAIN", "DRAIN", "UNKNOWN"]
    got = offline.follow_labels(points(spark, [100.0, 200.0, 10.0, 210.0, 300.0, 191.2, 100.0, 100.0, 0.0], rule=rules)).orderBy("seq").collect()
    want = [100.0, 200.0, 200.0, 201.2, 201.2, 201.2 - 0.58 * 10]
    want.append(want[-1] + 0.45 * (100 - want[-1]))
    want.append(want[-1] + 0.685 * (100 - want[-1]))
    assert [r.followed for r in got] == pytest.approx([*want, want[-1]])


def test_models_are_saved_loaded_and_boosted(spark, tmp_path):
    t = M.held_out(V28.offline(P.labelled(telemetry(spark, SF))))
    model = M.train(t.where("not held_out"), trees=5, depth=5)
    M.save(model, str(tmp_path / "m"), columns=V28.NAMES, rows=3)
    again, facts = M.load(spark, str(tmp_path / "m"))
    assert facts == {"columns": V28.NAMES, "rows": 3}
    some = t.where("held_out")
    assert sorted(map(str, M.classify(model, some).select("seq", "guess").collect())) == sorted(map(str, M.classify(again, some).select("seq", "guess").collect()))
    boosted = M.train_boosted(t.where("not held_out"), rounds=3, depth=3)
    hit = boosted.transform(some.select("vehicle_id", "seq", "label", "features.*")).where("label is not null").selectExpr("avg(cast(guess = label as int))").first()[0]
    assert hit > 0.6


def test_causal_states_do_not_look_ahead(spark):
    model = M.train(V28.offline(P.labelled(telemetry(spark, SF))), trees=5, depth=5)
    one = telemetry(spark, SF).where("vehicle_id = 'V00001'").cache()
    cut = one.selectExpr("percentile_approx(us, 0.5)").first()[0]
    whole = {r.seq: r.state for r in M.predict_causal(model, one).collect()}
    part = {r.seq: r.state for r in M.predict_causal(model, one.where(f"us <= {cut}")).collect()}
    assert part == {k: whole[k] for k in part} and "INIT" in whole.values()


def test_golden_segments_with_all_their_facts(spark, tmp_path):
    doc = {"id": "s", "source": "x.csv", "source_rows": [7, 8], "review_status": "approved", "capacity_est_liters": 200, "timestamps": ["2026-01-01 00:00:00", "2026-01-01 00:02:00"],
           "raw_liters": [1.0, 2], "speed_kmh": [0, 5], "expected_production_clean_liters": [1.0, 1.5], "checks": {"max_clean_span": 3}}
    (tmp_path / "g.json").write_text(json.dumps([doc, {k: v for k, v in doc.items() if k in ("timestamps", "raw_liters", "speed_kmh")} | {"id": "t"}]))
    rows = {(r.id, r.pos): r for r in S.read_segments(spark, str(tmp_path / "g.json")).collect()}
    assert len(rows) == 4 and (rows["s", 1].expected, rows["s", 1].first_row, rows["s", 1].checks.max_clean_span, rows["s", 1].lat) == (1.5, 7, 3, None)
    assert rows["t", 0].capacity is None and rows["t", 0].checks is None
    source = spark.createDataFrame([(7, rows["s", 0].time, 1.0, None), (8, rows["s", 1].time, 2.004, 5.0)], "row int, time timestamp, fuel double, speed double")
    one = S.read_segments(spark, str(tmp_path / "g.json")).where("id = 's'")
    assert tuple(E.provenance(one, source).first()) == ("s", 2, 2)
    E.write_report(E.provenance(one, source), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().same == 2


def test_folders_of_files_are_listed_and_enhanced(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("A 1_processed", "B_da_gop"):
        (tmp_path / "in" / f"{name}.csv").write_text("FuelTime,FuelLevel\n2026-01-01 10:00:00,93\n2026-01-01 10:02:00,0\n2026-01-01 10:04:00,92\n")
    assert sorted(r.vehicle for r in S.available_sources(spark, str(tmp_path / "in")).collect()) == ["A 1", "B"]
    S.enhance_files(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert len(rows) == 6 and {float(r.enhanced) for r in rows} <= {93.0} | {float(r.enhanced) for r in rows if r.seq == "3"}
    assert S.union_sources(spark.range(1).selectExpr("id"), spark.range(2).selectExpr("id", "id as x")).count() == 3
    assert S.write_table(spark.range(1), "jdbc:none", "t", enabled=False) is False


def test_history_is_that_of_one_vehicle(spark):
    t = spark.createDataFrame([("ab1", 1, 1, 5.0), ("AB", 2, 2, 6.0), ("ab", 3, 3, 7.0)], "vehicle_id string, seq long, us long, fuel double")
    find = lambda like: [r.seq for r in serving.history(t, like, None, None, 5).collect()]
    assert find("ab1") == [1] and find("Ab") == [2] and find("b1") == [1] and find("zz") == []
    assert [r.seq for r in serving.log(t, "ab", 3, None, 5).collect()] == [3] and serving.without_vehicle(t, "ab").count() == 2


def test_stored_and_filtered_rows(spark, tmp_path):
    rows = spark.createDataFrame([("v", 5.0, 4.0, "GRADUAL_CHANGE", "2026-01-02 03:00"), ("v", None, 4.0, "x", None), ("v", 5.0, None, "x", "2026-01-03"), ("w", 1.0, 1.0, "x", "2026-01-04")], "vehicle_id string, raw double, clean double, signal_state string, time string")
    serving.save_measurements(rows, str(tmp_path / "m"))
    assert sorted((r.vehicle_id, r.state_code) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("v", "GRADUAL_CHANGE"), ("w", "STABLE_JITTER")]
    assert [serving.on_days(rows, "time", *d).count() for d in (("2026-01-02", "2026-01-03"), (None, "2026-01-02"), ("2026-01-05", None))] == [3, 2, 1]
    (tmp_path / "f").write_text("abc")
    assert S.stamps(spark, str(tmp_path / "f")).first().stamp == "ba7816bf8f01"


def test_rare_labels_are_repeated_in_training(spark):
    rows = spark.createDataFrame([("v", i, i, ["A", "B", "B", "C"][i % 4]) for i in range(40)], "vehicle_id string, seq long, us long, label string")
    got = P.balanced(rows, "label", 8, capped=["B"], rare=["C"], least=25).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"A": 10, "B": 8, "C": 25}
    assert P.balanced(rows, "label", 8).count() == 24


def test_folds_of_long_lines_are_the_recursions(spark):
    import random

    from tankwise.operators import preparation, quality
    from tankwise.operators import windows as W

    r = random.Random(2)
    rows, want = [], {}
    for v, n in (("a", 1), ("b", 7), ("c", 1500), ("d", 200)):
        at, x, p, k, period = 0, None, 9.0, 0, 5.0
        for i in range(n):
            gap = r.choice([0.1, 2.0, 7.5, 15.0, 40.0]) if i else 0
            at += int(gap * 60_000_000)
            z = r.choice([0.0, r.uniform(50, 200)]) if i else 100.0
            rows.append((v, i, at, z))
            if i and 0.25 <= gap <= 15:
                period = 0.8 * period + 0.2 * gap
            if z > 0:
                gain = (p + 0.5) / (p + 12.5) if k else 1.0
                x, p, k = (x + gain * (z - x), (1 - gain) * (p + 0.5), k + 1) if k else (z, p, 1)
        want[v] = (k, pytest.approx(x, abs=1e-9), pytest.approx(p, abs=1e-12), pytest.approx(period, abs=1e-9))
    t = spark.createDataFrame(rows, "vehicle_id string, seq long, us long, fuel double")
    ends = {e.vehicle_id: (e.n, e.estimate, e.variance) for e in quality.kalman_end(t).collect()}
    periods = {e.vehicle_id: e.period for e in preparation.learnt_period(W.steps(t)).collect()}
    assert {v: (*ends[v], periods[v]) for v in want} == want


def test_dropouts_end_within_six_hours_wherever_slots_begin(spark):
    minute = 60_000_000
    levels = [(0, 100), (359, 100), (361, 50), (700, 60), (721, 99), (722, 40), (1083, 99), (1084, 99)]
    t = spark.createDataFrame([("v", i, int(m * minute), float(x)) for i, (m, x) in enumerate(levels)], "vehicle_id string, seq long, us long, fuel double")
    got = offline.fill_dropouts(t).orderBy("seq").collect()
    assert [r.dropout for r in got] == [None, None, "SENSOR_DROPOUT", "SENSOR_DROPOUT", None, None, None, None]  # 361 minutes are too many for the second
    assert got[2].cleaned == pytest.approx(100 - 2 / 362) and len(t.columns) + 2 == len(got[0])


def test_balanced_rows_are_the_smallest_hashes(spark):
    """By brute force, with the labels computed twice only: once for the counts, once for the rows."""
    rows = spark.range(20_000).selectExpr("concat('v', id % 7) as vehicle_id", "id as seq", "id as us", "case when id % 500 = 1 then 'C' when id % 2 = 0 then 'A' else 'B' end as label")
    got = P.balanced(rows, "label", 300, capped=["A"], rare=["C"], least=150)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    by_label = {}
    for r in sorted(rows.collect(), key=lambda r: hashlib.md5(f"{r.vehicle_id}|{r.seq}".encode()).hexdigest()):
        by_label.setdefault(r.label, []).append(r.seq)
    c = by_label["C"]
    want = [("A", s, 1) for s in by_label["A"][:300]] + [("B", s, 1) for s in by_label["B"]] + [("C", s, k + 1) for i, s in enumerate(c) for k in range(150 // len(c) + (i < 150 % len(c)))]
    assert sorted((r.label, r.seq, r.copy) for r in got.collect()) == sorted(want)


def test_training_rows_of_a_label_are_cut_before_they_meet(spark):
    """The most rows that one task reads: those up to the limit and of one head of hashes, not those that each task could send."""
    n, limit, sc = 100_000, 20_000, spark.sparkContext
    t = spark.range(0, n, 1, 4).selectExpr("concat('v', id % 7) as vehicle_id", "id as seq", "id as us", "'STABLE_JITTER' as label", "named_struct('FuelLevel', id / 2D) as features")
    sc.setJobGroup("training rows", "")
    assert M.training_rows(t, limit).count() == limit
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for job in sc.statusTracker().getJobIdsForGroup("training rows") for s in sc.statusTracker().getJobInfo(job).stageIds}
    tasks = [x for s in stages for x in [sc._jsc.sc().statusStore().taskList(s, 0, 1000)]]
    read = [x.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for x in tasks for i in range(x.size()) if x.apply(i).taskMetrics().isDefined()]
    assert limit <= max(read) <= limit + 4 * n // 16**P.HEAD
