"""The adaptive filter by its rules: gates and gains computed by hand for small series, and properties of random ones."""

import json
import math
import random

import pytest

from tankwise.operators.adaptive import INPUT, enhance, fresh, step
from tankwise.streaming.tracking import enhance_stream

MINUTE = 60_000_000
#: With these, a rise opens at 10 litres, a fall at 8, a hill at 2; a level is flat within 3 and counts as returned within 1.5.
POINT = {"label": "STABLE_JITTER", "jitter": 0.8, "noise": 0.8, "event": 5.0, "rolling_std": 0.5, "speed": 0.0, "capacity": 200.0}


def run(levels, state=None, every=2.0, **columns):
    """Outputs of levels, one each `every` minutes; a column is one value or one for each level. The state is stored between points."""
    state, out = state or fresh(), []
    for i, level in enumerate(levels):
        more = {c: v[i] if isinstance(v, list) else v for c, v in (POINT | columns).items()}
        state = json.loads(json.dumps(state))
        out.append(step(state, int(i * every * MINUTE), level, **more))
    return out


def gain(p, q, r):
    return (p + q) / (p + q + r)


def test_a_calm_point_moves_the_level_by_the_gain():
    # calm and parked: R 15, Q 0.15 for the measured noise; the innovation is softened at 1.5
    want = 300 + gain(4.0, 0.15, 15.0) * 1.5 * math.tanh(-1 / 1.5)
    assert run([300.0, 299.0]) == [300.0, pytest.approx(want)]


def test_an_impulse_hardly_moves_it():
    assert run([300.0, 304.0, 250.0], label=["STABLE_JITTER", "SPIKE", " impulse_noise"])[1:] == pytest.approx([300.0, 300.0], abs=1e-3)


@pytest.mark.parametrize(("levels", "last"), [([150.0, 151.0, 150.5], 150.5), ([150.0, 160.0, 171.0], 171.0), ([150.0, 151.0, 151.2], 151.2), ([131.0, 130.5, 130.0], 130.5)])
def test_a_rise_is_confirmed_at_its_third_point(levels, last):
    """The median of a plateau; the newest level of what still climbs."""
    assert run([120.0, *levels]) == [120.0, 120.0, 120.0, last]


def test_a_rise_below_the_threshold_is_no_new_level():
    assert max(run([120.0] + [129.5] * 3)) < 122


def test_a_rise_that_turns_back_is_forgotten():
    out = run([120.0, 150.0, 121.0, 120.5, 150.0, 151.0])
    assert out[1] == 120.0 and all(120 < x < 121.1 for x in out[2:])


@pytest.mark.parametrize(("speed", "points"), [(0.0, 3), (30.0, 4)])
def test_a_fall_takes_a_point_more_while_driving(speed, points):
    assert run([120.0] + [105.0] * points, speed=speed) == [120.0] * points + [105.0]


def test_a_candidate_needs_four_minutes_and_ends_at_a_gap():
    assert run([120.0] + [150.0] * 4, every=1.0) == [120.0] * 5
    assert run([120.0] + [150.0] * 6, every=1.0)[-2:] == [150.0, 150.0]
    assert max(run([120.0] + [150.0] * 4, every=8.0)) == 120.0


def test_a_small_hill_is_held_until_it_lasts():
    out = run([100.0, 104.0, 104.2, 104.1, 104.0])
    assert out[:3] == [100.0] * 3 and 100 < out[3] < out[4] < 104
    assert run([100.0, 104.0, 101.0])[1] == 100.0


def test_a_parked_noisy_vehicle_is_frozen():
    assert run([100.0, 101.5, 98.5, 101.0], label="OSCILLATION_NOISE") == [100.0] * 4
    assert run([100.0, 101.0], label="OSCILLATION_NOISE", speed=30.0)[1] > 100.0


@pytest.mark.parametrize("bad", [0.0, 4.9, None, math.nan])
def test_a_dropout_is_held_until_three_points_recover(bad):
    assert run([80.0, bad, bad, 60.0, 61.0, 60.5])[:6] == [80.0] * 6  # the recovered level, 20 lower, is a candidate then
    assert run([80.0, bad, 79.0, bad, 79.0, 79.0]) == [80.0] * 6


def test_a_named_dropout_is_held_at_any_level():
    assert run([80.0, 70.0], quality_reason=["", "LONG_GAP|sensor_dropout"]) == [80.0, 80.0]
    assert run([80.0, 1.0], quality_flag=["", "1"]) == [80.0, 80.0]


def test_what_follows_a_named_dropout_may_be_a_lower_level():
    named = {"quality_reason": ["", "DROPOUT"] + [""] * 40}
    told = run([80.0] + [50.0] * 8, quality_reason=named["quality_reason"][:9], label="DRAIN", confidence=0.6)
    assert told[:4] == [80.0, 80.0, 80.0, pytest.approx(80.0, abs=12)] and told[-1] < 60
    doubtful = run([80.0] + [50.0] * 33, quality_reason=named["quality_reason"][:34], label="DRAIN", confidence=0.5)
    assert doubtful == [80.0] * 34
    assert run([80.0] + [0.0] * 50) == [80.0] * 51


def test_nothing_is_known_before_the_first_level():
    assert run([None, math.nan, 55.0]) == [None, None, 55.0]


def test_segments_and_long_gaps_begin_anew():
    assert run([90.0, 140.0, 140.0], segment_id=["a", "b", None]) == [90.0, 140.0, 140.0]
    assert run([90.0, 140.0], every=120.5) == [90.0, 140.0] and run([90.0, 140.0], every=120.0) == [90.0, 90.0]


def test_the_reporting_period_is_learnt_from_usual_gaps():
    state = fresh()
    for at in (0, 10, 10.1, 40):
        step(state, int(at * MINUTE), 100.0, **POINT)
    assert state["period"] == pytest.approx(0.8 * 2 + 0.2 * 10)


@pytest.mark.parametrize("seed", range(6))
def test_the_level_stays_between_the_levels_seen(seed):
    r = random.Random(seed)
    levels = [r.choice([r.uniform(20, 180), r.gauss(100, 3), 0.0]) for _ in range(200)]
    kinds = ["STABLE_JITTER", "OSCILLATION_NOISE", "GRADUAL_CHANGE", "UPWARD_SHIFT", "DOWNWARD_SHIFT", "SPIKE", None]
    out = run(levels, label=[r.choice(kinds) for _ in levels], speed=[r.choice([0.0, 40.0]) for _ in levels], rolling_std=[r.uniform(0, 9) for _ in levels], confidence=0.9)
    seen = []
    for level, x in zip(levels, out, strict=True):
        seen.append(level)
        assert x is None or min(seen) - 1e-9 <= x <= max(seen) + 1e-9


def test_batch_and_stream_are_the_step(spark, tmp_path):
    r = random.Random(1)
    rows = [(v, i, i * 2 * MINUTE, r.choice([0.0, r.gauss(base, 2), r.gauss(base + 40, 2)]), *POINT.values()) for v, base in (("a", 100), ("b", 60)) for i in range(30)]
    schema = "vehicle_id string, seq long, us long, fuel double, label string, jitter double, noise double, event double, rolling_std double, speed double, capacity double"
    df = spark.createDataFrame(rows, schema)
    want = {v: run([x[3] for x in rows if x[0] == v]) for v in "ab"}
    assert set(schema.replace(",", "").split()[::2]) <= set(INPUT)
    assert {v: [x.enhanced for x in enhance(df).where(f"vehicle_id = '{v}'").orderBy("seq").collect()] for v in "ab"} == want
    for n in (0, 1, 2):
        df.where(f"seq div 10 = {n}").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = enhance_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {v: [x.enhanced for x in got.where(f"vehicle_id = '{v}'").orderBy("seq").collect()] for v in "ab"} == want
