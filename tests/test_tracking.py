import pandas as pd
import pytest

from tankwise.operators.tracking import INPUT, fresh, run, step, track
from tankwise.streaming.tracking import decode, encode, json_points, keep_latest, latest, track_stream

MINUTES_2 = 120_000_000


def curve(values, cap=None, labels=None, speeds=None):
    s = fresh()
    return [step(s, i * MINUTES_2, v, speeds[i] if speeds else 0.0, cap, labels[i] if labels else None) for i, v in enumerate(values)]


def clean(values, **k):
    return [o["clean"] for o in curve(values, **k)]


def test_stationary_u_shape():
    got = clean([360.0] + [345.0] * 4 + [360.0] * 7, cap=800.0, labels=["STABLE_JITTER"] * 12)
    assert got == [360.0, 359.79, 359.68, 359.57, 352.37, 352.56, 352.75, 352.93, 353.1, 353.26, 353.57, 353.87]


def test_level_shift():
    got = clean([200.0, 180, 180, 180, 196, 194, 192], cap=300.0, labels=["STABLE_JITTER"] * 4 + ["GRADUAL_CHANGE"] * 3, speeds=[30.0, 0, 0, 0, 25, 30, 35])
    assert got == [200.0, 200.0, 200.0, 180.0, 180.0, 180.0, 192.0]


def test_strong_rise_is_pending_once():
    flags = [o["quality_flag"] for o in curve([100.0, 170, 220, 220.5], cap=800.0)]
    assert flags[1:3] == ["PENDING_UPWARD_SHIFT_HELD", "UPWARD_SHIFT_TRACKED"]


def test_deep_excursion_is_held():
    out = curve([100.0] + [20.0] * 35 + [70.0, 100.0, 99.8], cap=200.0)
    assert min(o["clean"] for o in out) > 95
    flags = [o["quality_flag"] for o in out]
    assert not any("SHIFT" in f for f in flags)
    assert flags[1:36] == ["DOWN_EXCURSION_HELD"] * 35 and flags[36] == "REBOUND_RECOVERY_HELD" and out[5]["operational_state"] == "LOW_PLATEAU_UNCERTAIN"


def test_excursion_forgets_what_was_pending():
    s = fresh()
    for i, v in enumerate([200.0, 212.0]):
        step(s, i * MINUTES_2, v)
    assert s["anchor"] == 200.0 and s["rising"]
    assert step(s, 2 * MINUTES_2, 60.0)["quality_flag"] == "DOWN_EXCURSION_HELD"
    assert s["anchor"] is None and s["rising"] == [] and s["falls"] == 0
    assert step(s, 3 * MINUTES_2, 198.0)["quality_flag"] == "SMOOTH_KALMAN" and s["dip"] is None


def test_excursion_depth_is_that_of_its_lowest_level():
    # 25 of 100 is 75 % deep, so the plateau at 40 is never taken, however long it lasts
    out = curve([100.0, 25.0] + [40.0] * 60)
    assert {o["quality_flag"] for o in out[1:]} == {"DOWN_EXCURSION_HELD"} and out[-1]["clean"] == 100.0
    out = curve([100.0] + [40.0] * 60)
    assert out[30]["quality_flag"] == "DOWN_EXCURSION_HELD" and "DOWNWARD_SHIFT_TRANSITION" in [o["quality_flag"] for o in out[31:34]] and abs(out[-1]["clean"] - 40) < 2


def test_rebound_counts_after_the_lower_level_was_taken():
    out = curve([100.0] + [40.0] * 32 + [85.0, 86.0])
    flags = [o["quality_flag"] for o in out]
    taken = flags.index("DOWNWARD_SHIFT_TRANSITION")
    assert flags[-1] == "REBOUND_RECOVERY_HELD" and taken < len(flags) - 2


def test_invalid_prefix_and_dropout():
    assert clean([0.0, float("nan"), -1.0, 120.0]) == [None, None, None, 120.0]
    s = fresh()
    for i, v in enumerate([120.0, 119.8, 0, 0, 119.5]):
        step(s, i * MINUTES_2, v)
    assert 0 not in s["fuel"]


@pytest.mark.parametrize(("coords", "speed", "states"), [
    ([(21.0, 105.0), (21.00001, 105.0), (21.0, 105.00001), (21.0, 105.0)], 0.0, ["UNCERTAIN"] * 2 + ["LOW_MOTION"] * 2),
    ([(21.0 + i * 0.0004, 105.0) for i in range(4)], 35.0, ["UNCERTAIN"] * 2 + ["MOVING"] * 2),
    ([(21.0, 105.0)] * 4, 35.0, ["UNCERTAIN"] * 4),
])
def test_motion(coords, speed, states):
    s = fresh()
    assert [step(s, i * MINUTES_2, 100.0, speed, None, None, *c)["motion_state"] for i, c in enumerate(coords)] == states


def test_causal_and_restorable():
    v = [200.0, 198.5, 197, 199, 196, 195, 150, 150, 149, 230, 231, 232]
    whole = clean(v, cap=300.0)
    assert clean(v[:7], cap=300.0) == whole[:7]
    s, got = fresh(), []
    for i, x in enumerate(v):
        got.append(step(s, i * MINUTES_2, x, 0.0, 300.0)["clean"])
        s = decode(encode(s))
    assert got == whole


def points():
    return pd.DataFrame([{"vehicle_id": v, "seq": i, "us": i * MINUTES_2, "fuel": 200.0 - i * k + (30 if i > 6 else 0), "speed": 20.0, "kind": "point"} for v, k in (("a", 0.5), ("b", 2.0)) for i in range(14)])


def test_stream_equals_batch_and_resets(spark, tmp_path):
    p = points()
    reset = pd.DataFrame([{"vehicle_id": "b", "seq": -1, "us": 5 * MINUTES_2 - 1, "fuel": None, "speed": None, "kind": "reset"}])
    rows = pd.DataFrame(p.to_dict("records") + reset.to_dict("records")).sort_values(["us", "seq"])
    schema = "vehicle_id string, seq long, us long, fuel double, speed double, kind string"
    for n, part in enumerate([rows.iloc[:12], rows.iloc[12:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = track_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["vehicle_id"], r["seq"], r["clean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    b = p[p.vehicle_id == "b"]
    tuples = lambda x: [tuple(r.get(c) for c in INPUT) for r in x.to_dict("records")]
    want = [o for x in (p[p.vehicle_id == "a"], b[b.us < 5 * MINUTES_2 - 1], b[b.us > 5 * MINUTES_2 - 1]) for o in run(fresh(), tuples(x))]
    assert got == sorted((r["vehicle_id"], r["seq"], r["clean"]) for r in want)
    batch = track(spark.createDataFrame(p, schema).drop("kind"))
    assert sorted((r["seq"], r["clean"]) for r in batch.where("vehicle_id = 'a'").collect()) == sorted((s, c) for v, s, c in got if v == "a")


def test_stream_restarts_from_its_checkpoint_with_json_messages_and_latest_points(spark, tmp_path):
    import json

    p = points()
    p["us"] += 1_700_000_000_000_000
    messages = [(json.dumps(r),) for r in p.to_dict("records")]
    want = sorted((r["vehicle_id"], r["seq"], r["clean"]) for r in track(spark.createDataFrame(p, "vehicle_id string, seq long, us long, fuel double, speed double, kind string")).collect())
    for n, part in enumerate([messages[:10] + [("broken {",), ('{"seq": 1}',)], messages[10:20] + messages[12:14], messages[20:]]):
        spark.createDataFrame(part, "value string").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        source = spark.readStream.schema("value string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = track_stream(json_points(source, delay="1 day")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()  # and a new query goes on from the checkpoint
        q = json_points(source).writeStream.foreachBatch(keep_latest(str(tmp_path / "latest"))).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r["vehicle_id"], r["seq"], r["clean"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want
    assert sorted((r["vehicle_id"], r["seq"]) for r in latest(spark, str(tmp_path / "latest")).collect()) == [("a", 13), ("b", 13)]
    assert latest(spark, str(tmp_path / "none")) is None
