"""The service path as a stream: against batch, across restarts and repeated batches; state, sessions and old state documents."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F
from test_epochs import SCHEMA, random_rows

from tankwise.operators import feature_vector as V28
from tankwise.operators import forest as M
from tankwise.operators import serving, tracking
from tankwise.operators import windows as W
from tankwise.streaming import service as S
from tankwise.streaming.tracking import decode, encode, keep_latest, latest

POINT = "vehicle_id string, seq long, us long, fuel double, speed double, lat double, lng double, capacity double, kind string"


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        d = r.uniform(-60, 60)
        label = "UPWARD_SHIFT" if d > 20 else "DOWNWARD_SHIFT" if d < -20 else "OSCILLATION_NOISE"
        rows.append((f"M{i % 7}", i, i, label, dict.fromkeys(V28.NAMES, 0.0) | {"DeltaFuel": d, "AbsDeltaFuel": abs(d), "FuelLevel": 100.0}))
    fields = ", ".join(f"{n}: double" for n in V28.NAMES)
    return M.train(spark.createDataFrame(rows, f"vehicle_id string, seq long, us long, label string, features struct<{fields}>"), trees=5, depth=5)


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_the_feature_step_is_the_causal_vector(spark, seed):
    rows = [(*r, 250.0 if seed != 12 else None) for r in random_rows(seed, n=60)]
    t = spark.createDataFrame(rows, SCHEMA + ", capacity double")
    batch = V28.causal(t).orderBy("us", "seq").collect()
    state = V28.fresh()
    for r, b in zip(rows, batch, strict=True):
        state = json.loads(json.dumps(state))
        vehicle, seq, us, fuel, speed, lat, lng, cap = r
        out = V28.step(state, (vehicle, seq, us, fuel, speed, cap, lat, lng))
        assert (out["known"] is None) == (b.features is not None)
        if b.features is not None:
            assert {n: out[V28.IN + n] for n in V28.NAMES} == pytest.approx(b.features.asDict(), abs=1e-9)


def service_rows():
    rows = [(v, i, us, None if f is not None and math.isnan(f) else f, s, la, ln, None, "point") for k, v in enumerate(["A", None, "C#1"]) for _, i, us, f, s, la, ln in random_rows(20 + k, n=40)]
    return sorted(rows, key=lambda r: (r[2], r[1]))


def start(spark, tmp_path, source, model, sink):
    vehicles = spark.createDataFrame([("A", 200.0), ("C#1", 850.0)], "vehicle_id string, capacity_liters double")
    out = S.clean_stream(source, vehicles, model, default_vehicle="spare")
    q = out.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_the_chained_stream_is_batch_across_restarts(spark, tmp_path, model):
    rows = service_rows()
    third = len(rows) // 3
    sink = S.keep_results(str(tmp_path / "out"))
    seen = []

    def twice(batch, batch_id):  # as after a failure between the sink and the commit
        sink(batch, batch_id)
        sink(batch, batch_id)
        seen.append(batch_id)

    for n in range(3):
        part = rows[n * third : (n + 1) * third if n < 2 else None]
        spark.createDataFrame(part, POINT).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        source = spark.readStream.schema(POINT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        start(spark, tmp_path, source, model, twice)  # a new query each time, from the checkpoint
    assert seen == [0, 1, 2]
    t = spark.createDataFrame(rows, POINT).withColumn("vehicle_id", F.coalesce("vehicle_id", F.lit("spare"))).drop("kind")
    t = t.withColumn("capacity", F.when(F.col("vehicle_id") == "A", 200.0))
    want = tracking.track(M.predict_causal(model, t).withColumnRenamed("state", "label"))
    stored = want.where("raw is not null and clean is not null")
    columns = ["vehicle_id", "seq", "us", "raw", "clean", "signal_state", "quality_flag", "motion_state", "previous"]
    key = lambda x: sorted(map(repr, x.select(columns).collect()))
    assert key(S.kept(spark, str(tmp_path / "out"), "measurements")) == key(stored)
    events = S.kept(spark, str(tmp_path / "out"), "events").drop("batch")
    assert sorted(map(repr, events.collect())) == sorted(map(repr, S.shifts(want).collect())) and events.count() > 3
    # what the state holds of each vehicle is what came out last
    held = {r.vehicle_id: r for r in S.contexts(spark, str(tmp_path / "ck"), operator=0).collect()}
    last = {r.vehicle_id: r for r in want.where("clean is not null").withColumn("rn", F.row_number().over(W.Window.partitionBy("vehicle_id").orderBy(F.desc("us"), F.desc("seq")))).where("rn = 1").collect()}
    assert set(held) == set(last) == {"A", "spare", "C#1"}
    assert all(round(held[v].clean, 2) == last[v].clean and held[v].us == last[v].us for v in last) and held["A"].capacity == 200 and held["C#1"].capacity is None


def test_a_reset_clears_both_states_in_order(spark, tmp_path):
    rows = [("A", i, i * 120_000_000, 100.0 + i, 0.0, None, None, None, "reset" if i == 3 else "point") for i in range(6)]
    spark.createDataFrame(rows, POINT).coalesce(1).write.parquet(str(tmp_path / "in/0"))
    source = spark.readStream.schema(POINT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    start(spark, tmp_path, source, None, S.keep_results(str(tmp_path / "out")))
    got = S.kept(spark, str(tmp_path / "out"), "measurements").orderBy("seq").collect()
    assert [(r.seq, r.signal_state) for r in got] == [(0, "INIT"), (1, "STABLE_JITTER"), (2, "STABLE_JITTER"), (4, "INIT"), (5, "STABLE_JITTER")]
    assert S.kept(spark, str(tmp_path / "none"), "events") is None


def test_two_versions_of_the_latest_points_are_kept(spark, tmp_path):
    write = keep_latest(str(tmp_path / "t"))
    for b in range(4):
        batch = spark.createDataFrame([("A", b, b), (f"V{b}", 0, b)], "vehicle_id string, seq long, us long")
        write(batch, b)
        write(batch, b)
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["batch=000000002", "batch=000000003"]
    assert sorted((r.vehicle_id, r.us) for r in latest(spark, str(tmp_path / "t")).collect()) == [("A", 3), ("V0", 0), ("V1", 1), ("V2", 2), ("V3", 3)]


def test_closed_sessions_are_the_batch_segments(spark, tmp_path):
    minute = 60_000_000
    at = {"A": [0, 10, 40, 70.5, 71, 200], "B": [5, 35, 66, 300]}
    rows = [(v, i, int(m * minute), 1.0) for v, x in at.items() for i, m in enumerate(x)]
    schema = "vehicle_id string, seq long, us long, fuel double"
    for n, part in enumerate([rows[::2], rows[1::2], [("Z", 0, 10_000 * minute, 1.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = S.sessions(source, delay="1000 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = W.steps(spark.createDataFrame(rows, schema)).groupBy("vehicle_id", "segment_id").agg(F.min("us"), F.max("us"), F.count("*")).drop("segment_id")
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 6  # the session of Z is still open


def test_documents_with_long_names_are_read():
    state = tracking.fresh()
    levels = [100.0, 99.0, 140.0, 141.0]
    for i, x in enumerate(levels):
        tracking.step(state, 1_700_000_000_000_000 + i * 120_000_000, x, 20.0, 300.0, None, 21.0, 105.0 + i / 1000)
    long = {
        "capacity_est": 300.0, "kalman_x": state["x"], "kalman_p": state["p"], "last_clean_fuel": state["clean"], "last_time": "2023-11-14T22:19:20", "recent_refuel_steps": state["grace"], "pending_drain_count": state["falls"],
        "drop_count": state["drops"], "rise_count": 0, "refuel_anchor": state["anchor"], "refuel_samples": state["rising"], "history_fuel": state["fuel"], "history_time": [], "history_speed": state["speed"], "history_coordinates": state["coords"],
    }
    again = decode(json.dumps({"schema_version": 1, "vehicle_id": "A", "context": long, "stats": {}}))
    assert {k: v for k, v in again.items() if k != "mode"} == {k: v for k, v in json.loads(json.dumps(state)).items() if k != "mode"} and again["mode"] == "STABLE"
    newer = {k.replace("refuel_steps", "upward_steps").replace("drain_count", "downward_count").replace("refuel_", "upward_"): v for k, v in long.items()}
    assert decode(json.dumps({"schema_version": 1, "context": newer})) == again
    args = (1_700_000_000_000_000 + 5 * 120_000_000, 142.0, 0.0, 300.0)
    assert tracking.step(again, *args)["clean"] == tracking.step(state, *args)["clean"]
    assert decode(encode(state)) == json.loads(json.dumps(state))
    with pytest.raises(ValueError, match="another version"):
        decode(json.dumps({"schema_version": 2, "context": long}))


def test_outputs_are_described(spark):
    got = serving.described(spark.createDataFrame([("SPIKE",), ("odd",), (None,)], "signal_state string")).collect()
    text = dict(serving.STATE_MEANINGS)
    assert {r.signal_state: r.signal_state_description for r in got} == {"SPIKE": text["SPIKE"], "odd": text["UNCERTAIN"], None: text["UNCERTAIN"]}
