"""The labeller's rules on short series. At a calm 100 litres the thresholds are flat 1, spike 2, event 5, low 5 (by hand)."""

import pytest

from tankwise.operators.profile import labelled

MINUTES_2 = 120_000_000


def rules(spark, values, speed=0.0, moves=False, before=60, after=20):
    level = [100.0] * before + values + [values[-1] if values else 100.0] * after
    rows = [("v", i, i * MINUTES_2, v, speed, 21.0 + (0.01 * i if moves else 0.0), 105.0) for i, v in enumerate(level)]
    out = labelled(spark.createDataFrame(rows, "vehicle_id string, seq long, us long, fuel double, speed double, lat double, lng double")).orderBy("seq").collect()
    assert (out[0]["flat"], out[0]["spike"], out[0]["event"]) == (1.0, 2.0, 5.0)
    return [(r["rule"], r["label"]) for r in out[before : before + len(values)]]


OSC = "OSCILLATION_NOISE"


@pytest.mark.parametrize(("values", "want"), [
    ([0.0, 100.0], [("INVALID", None), ("UNKNOWN", None)]),
    ([3.0, 4.0], [("DROPOUT", OSC)]),
    ([106.0, 100.0], [("TRANSIENT_UP_NOISE", OSC)]),
    ([94.0, 100.0], [("TRANSIENT_DOWN_NOISE", OSC)]),
    ([140.0, 100.0], [("SPIKE", OSC), ("DRAIN", "DOWNWARD_SHIFT")]),
    ([60.0, 100.0, 100.0], [("SPIKE", OSC), ("SPIKE", OSC)]),
    ([60.0, 60.0, 60.0, 60.0, 60.0, 60.0], [("DRAIN", "DOWNWARD_SHIFT"), ("SLOSHING_NOISE", OSC), ("SLOSHING_NOISE", OSC)]),
    ([101.9, 101.9], [("UNKNOWN", None), ("STABLE_JITTER", "STABLE_JITTER")]),
    ([100.5, 100.0], [("STABLE_JITTER", "STABLE_JITTER")] * 2),
])
def test_rules(spark, values, want):
    # the large spike of the fifth case is above 99.5 % of the levels only with more points around it
    got = rules(spark, values, before=300 if max(values) > 110 else 60)
    assert got[: len(want)] == want


def test_rise_is_a_shift(spark):
    rows = [("v", i, i * MINUTES_2, 60.0 if i < 60 else 100.0, 0.0, 21.0, 105.0) for i in range(120)]
    out = labelled(spark.createDataFrame(rows, "vehicle_id string, seq long, us long, fuel double, speed double, lat double, lng double")).orderBy("seq").collect()
    assert [(r["rule"], r["label"]) for r in out[60:62]] == [("REFUEL", "UPWARD_SHIFT"), ("SLOSHING_NOISE", OSC)]


@pytest.mark.parametrize(("speed", "moves", "rule"), [(20.0, False, "CONSUMPTION"), (0.0, True, "CONSUMPTION"), (0.0, False, "STABLE_JITTER")])
def test_slow_fall_counts_as_use_by_given_or_gps_speed(spark, speed, moves, rule):
    got = rules(spark, [100 - 0.6 * i for i in range(1, 9)], speed, moves)
    assert [r for r, _ in got[2:6]] == [rule] * 4
