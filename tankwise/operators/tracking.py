"""Causal smooth tracking of one vehicle's level: a pure step over a JSON-able state, and its batch harness.

The same step runs in batch (one group a vehicle) and in streams (tankwise.streaming), so both give the same output.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

RING, SAMPLES = 12, 24
OUT = (
    "vehicle_id string, seq long, us long, raw double, clean double, signal_state string, quality_flag string, motion_state string, motion_confidence double, "
    "displacement double, fuel_rate double, is_stopped int, operational_state string, previous double"
)
# Signal states.
STATES = ("UNINITIALIZED", "INIT", "STABLE_JITTER", "OSCILLATION_NOISE", "SLOSHING", "GRADUAL_CHANGE", "UPWARD_SHIFT", "DOWNWARD_SHIFT", "SPIKE", "UNCERTAIN")
# Names of signal states that other producers use.
STATE_NAMES = {
    "NORMAL": "STABLE_JITTER",
    "IMPULSE_NOISE": "SPIKE",
    "SPIKE_UP": "SPIKE",
    "SPIKE_DOWN": "SPIKE",
    "RISING": "UPWARD_SHIFT",
    "REFUEL": "UPWARD_SHIFT",
    "DRAIN": "DOWNWARD_SHIFT",
} | dict.fromkeys(["DROPOUT", "TRANSIENT_NOISE", "TRANSIENT_UP_NOISE", "TRANSIENT_DOWN_NOISE", "TRANSIENT_CLUSTER_NOISE"], "OSCILLATION_NOISE")
# Measurement and process noise, parked and driving; both are scaled where speed and coordinates disagree.
R_LOW, Q_LOW, R_PARKED, Q_PARKED, R_DRIVING, Q_DRIVING = 28.0, 0.06, 35.0, 0.03, 45.0, 0.08
R_CONFLICT, Q_CONFLICT = 1.3, 0.75
EARTH_METRES = 6_371_000


def median(v: Iterable[float]) -> float:
    s = sorted(v)
    n = len(s)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def deviation(v: list[float]) -> float:
    """Population deviation."""
    mean = sum(v) / len(v)
    return math.sqrt(sum((x - mean) ** 2 for x in v) / len(v))


def fresh() -> dict:
    return {"x": None, "p": 1.0, "clean": None, "us": None, "cap": None, "grace": 0, "falls": 0, "drops": 0, "anchor": None, "rising": [], "mode": "UNINITIALIZED", "dip": None, "fuel": [], "speed": [], "coords": []}


def _metres(a: list[float], b: list[float]) -> float:
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_METRES * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def _coordinate(lat, lng) -> list[float] | None:
    try:
        lat, lng = float(lat), float(lng)
    except (TypeError, ValueError):
        return None
    return [lat, lng] if abs(lat) <= 90 and abs(lng) <= 180 and (lat or lng) else None


def motion(s: dict, speed: float, here: list[float] | None) -> tuple[str, float, float, int]:
    """State, confidence, displacement and number of places among the last four points and this one."""
    at = [c for c in [*s["coords"][-4:], here] if c]
    n = len(at)
    if n < 2:
        return "UNCERTAIN", 0.0, 0.0, n
    far = _metres(at[0], at[-1])
    if n >= 3:
        centre = [sum(c[i] for c in at) / n for i in (0, 1)]
        if speed <= 1 and max(_metres(c, centre) for c in at) <= 30:
            return "LOW_MOTION", min(1.0, 0.65 + 0.1 * n), far, n
        if speed > 5 and far >= 25:
            return "MOVING", min(1.0, 0.65 + 0.1 * n), far, n
    return "UNCERTAIN", 0.4 if n >= 3 else 0.2, far, n


def _push(s: dict, name: str, value) -> None:
    s[name] = [*s[name], value][-RING:]


def _clamp(v: float, cap: float | None) -> float:
    return max(0.0, v) if cap is None else min(max(0.0, v), 1.05 * cap)


def _noise(values: list[float]) -> float:
    """Robust spread of successive differences, at least 0.5."""
    if len(values) < 3:
        return 0.5
    d = [b - a for a, b in zip(values, values[1:], strict=False)]
    m = median(d)
    return max(0.5, 1.4826 * median(abs(v - m) for v in d))


def _quiet(s: dict, mode: str = "STABLE") -> None:
    """The end or the start of an excursion forgets what was pending."""
    s |= {"anchor": None, "rising": [], "falls": 0, "mode": mode}


def _dip(s: dict, raw: float, us: int, minutes: float, shift: float) -> tuple[float, str] | None:
    """Guard against deep excursions: (level, flag) while it decides, else None."""
    noise, clean, dip = _noise(s["fuel"]), s["clean"], s["dip"]
    if dip is None:
        if clean - raw < max(0.3 * max(abs(clean), 1.0), 12 * noise, 2 * shift):
            return None
        s["dip"] = {"base": clean, "low": raw, "since": us, "last": [raw], "sure": False, "back": False}
        _quiet(s, "DOWN_EXCURSION")
        return clean, "DOWN_EXCURSION_HELD"
    base, size = dip["base"], max(abs(dip["base"]), 1.0)
    dip["low"] = min(dip["low"], raw)
    dip["last"] = [*dip["last"], raw][-SAMPLES:]
    depth = max(base - dip["low"], 1e-6)
    rebound = max(0.0, (raw - dip["low"]) / depth)
    if rebound >= 0.6:
        dip["back"], s["mode"] = True, "REBOUND_RECOVERY"
    if dip["back"]:
        if abs(raw - base) <= max(shift, 0.05 * size):
            s["dip"] = None
            _quiet(s)
            return None
        return clean, "REBOUND_RECOVERY_HELD"
    four, wide = dip["last"][-4:], max(2.0, 3 * noise)
    flat = len(four) == 4 and max(four) - min(four) <= wide and rebound <= 0.25
    if not dip["sure"] and depth / size < 0.7 and us - dip["since"] >= 3_600_000_000 and flat:
        dip["sure"], s["mode"] = True, "DOWNWARD_CONFIRMED"
    if dip["sure"]:
        goal = median(four)
        level = clean + min(max(minutes / 12, 0.15), 0.45) * (goal - clean)
        if abs(level - goal) <= wide:
            s["dip"] = None
            _quiet(s, "BASELINE_REACQUISITION")
        return level, "DOWNWARD_SHIFT_TRANSITION"
    s["mode"] = "LOW_PLATEAU_UNCERTAIN"
    return clean, "DOWN_EXCURSION_HELD"


def _trend(s: dict, raw: float, speed: float, j: float) -> float | None:
    """Fitted level at this point if the last ten points fall steadily while driving, else None."""
    v = [*s["fuel"][-9:], raw]
    n = len(v)
    if n < 6 or not any(x > 5 for x in [*s["speed"][-9:], speed]):
        return None
    mid, mean = (n - 1) / 2, sum(v) / n
    slope = sum((i - mid) * (y - mean) for i, y in enumerate(v)) / sum((i - mid) ** 2 for i in range(n))
    drop = median(v[: n // 2]) - median(v[n // 2 :])
    return mean + slope * mid if drop >= max(2.0, 1.25 * j) and slope <= -max(0.2, 0.12 * j) else None


def _kalman(s: dict, raw: float, speed: float, minutes: float, state: str, j: float, moved: str, places: int, goal: float | None) -> float:
    v = [*s["fuel"][-5:], raw]
    path = sum(abs(b - a) for a, b in zip(v, v[1:], strict=False))
    straight = abs(v[-1] - v[0]) / path if path > 1e-6 else 0.0
    falling = v[-1] - v[0] <= -max(1.5, 0.75 * j) and straight >= 0.65
    parked, driving = moved == "LOW_MOTION" or (places < 3 and speed <= 1), moved == "MOVING" or (places < 3 and speed > 1)
    if parked:
        r, q = (R_LOW, Q_LOW) if moved == "LOW_MOTION" else (R_PARKED, Q_PARKED)
    elif driving:
        r, q = R_DRIVING, Q_DRIVING
    else:
        r, q = max(R_PARKED, R_DRIVING) * R_CONFLICT, min(Q_PARKED, Q_DRIVING) * Q_CONFLICT
    if state in ("OSCILLATION_NOISE", "SLOSHING") and max(v) - min(v) >= max(5.0, 3 * j) and straight <= 0.5 and goal is None:
        r, q = max(r, 250.0), min(q, 0.01)
    elif state == "STABLE_JITTER" and (deviation(v) if len(v) >= 3 else 0.0) <= j:
        r, q = min(r, 18.0), max(q, 0.12)
    s["drops"] = s["drops"] + 1 if raw < s["x"] - max(0.8 * j, 0.6) else 0
    gradual, steady = state == "GRADUAL_CHANGE", goal is not None
    supported = gradual or state == "DOWNWARD_SHIFT" or (driving and s["drops"] >= 3 and falling) or steady
    if supported and s["drops"] >= 2:
        lag = min(4.0, (s["x"] - raw) / max(0.5 * j, 0.4))
        r, q = max(10.0, r / lag), max(q, 0.15 * lag)
        if falling:
            r, q = min(r, 8.0), max(q, 1.0)
        if steady:
            r, q = min(r, 6.0), max(q, 1.5)
    p = s["p"] + q * min(max(minutes / 2, 0.1), 10.0)
    d = (min(raw, goal) if steady else raw) - s["x"]
    if driving and d > 0:
        d = min(d, max(0.4, 0.25 * j))
    elif d < 0 and (driving or supported):
        d = d if supported and (falling or steady or gradual) else max(d, -max(1.5, 1.2 * j))
    else:
        scale = max(1.5, 1.5 * j)
        d = scale * math.tanh(d / scale)
    gain = p / (p + r)
    move = gain * d
    if (driving and falling) or steady or gradual:
        move = max(move, -max(2.5, 1.8 * j))
    s["p"] = (1 - gain) * p
    return s["x"] + move


def step(s: dict, us: int, raw: float | None, speed: float | None = 0.0, cap: float | None = None, label: str | None = None, lat=None, lng=None) -> dict:
    """Take one point in; changes s and returns the output columns without ids."""
    raw = float(raw) if raw is not None and math.isfinite(raw) else math.nan
    speed = float(speed) if speed is not None and math.isfinite(speed) else 0.0
    if cap is not None and math.isfinite(cap) and cap > 0:
        s["cap"] = float(cap)
    cap, here = s["cap"], _coordinate(lat, lng)
    thr = lambda floor, share: max(floor, share * cap) if cap else floor
    j, shift, flat = thr(0.8, 0.003), thr(10.0, 0.04), thr(3.0, 0.006)
    moved, sure, far, places = motion(s, speed, here)
    previous = s["clean"]

    def out(clean: float | None, state: str, flag: str, rate: float = 0.0) -> dict:
        return {"raw": None if math.isnan(raw) else raw, "clean": None if clean is None else round(clean, 2), "signal_state": state, "quality_flag": flag, "motion_state": moved, "motion_confidence": round(sure, 3), "displacement": round(far, 2), "fuel_rate": round(rate, 4), "is_stopped": int(speed <= 0.5), "operational_state": s["mode"], "previous": previous}

    if s["x"] is None:
        if not raw > 0:
            return out(None, "UNINITIALIZED", "INITIAL_INVALID_DISCARDED")
        s |= {"x": raw, "clean": raw, "p": 1.0, "us": us, "mode": "STABLE", "fuel": [raw], "speed": [speed], "coords": [here]}
        return out(raw, "INIT", "VALID")
    minutes = (us - s["us"]) / 60_000_000
    minutes = max(0.1, 2.0 if minutes < 0 else minutes)
    if minutes > 30 and raw > 0:
        s |= {"x": raw, "clean": raw, "p": 1.0, "grace": 0, "falls": 0, "anchor": None, "rising": [], "dip": None, "mode": "STABLE", "fuel": [], "speed": [], "coords": []}
    d = raw - s["clean"]
    if label and label not in ("nan", "None", "MODEL_NOT_FOUND"):
        state = label.strip().upper()
        state = STATE_NAMES.get(state, state if state in STATES else "UNCERTAIN")
    else:
        state = "UPWARD_SHIFT" if d >= shift else "DOWNWARD_SHIFT" if d <= -shift else "GRADUAL_CHANGE" if speed > 5 and d < -0.3 else "OSCILLATION_NOISE" if abs(d) > 2 else "STABLE_JITTER"
    s["us"] = us
    if not raw > 0 or state == "SPIKE":
        _push(s, "speed", speed)
        _push(s, "coords", here)
        return out(s["clean"], state, "SPIKE_HELD" if state == "SPIKE" else "ZERO_DROPOUT_HELD")

    was = s["clean"]
    if (held := _dip(s, raw, us, minutes, shift)) is not None:
        level, flag = held
    else:
        if s["grace"]:
            s["grace"] -= 1
        goal = _trend(s, raw, speed, j)
        four = [*s["fuel"][-3:], raw]
        lower = len(four) == 4 and max(four) - min(four) <= max(1.0, 0.8 * j) and median(four) <= was - max(0.8, 0.5 * j)
        up = waiting = False
        if s["anchor"] is not None:
            if raw <= s["anchor"] + 0.4 * shift:
                s["anchor"], s["rising"] = None, []
            else:
                s["rising"] = r = [*s["rising"], raw][-RING:]
                strong = len(r) >= 2 and min(r[-2:]) >= s["anchor"] + 2 * shift and r[-1] >= r[-2] - flat
                ahead = len(r) >= 3 and all(b >= a - 1.5 for a, b in zip(r[-3:], r[-2:], strict=False))
                plateau = len(r) >= 3 and max(r[-3:]) - min(r[-3:]) <= 1.5 * flat
                up = strong or ahead or plateau or (len(r) >= 2 and state == "UPWARD_SHIFT")
                waiting = not up
        elif d >= shift:
            if s["grace"]:
                up = True
            else:
                s["anchor"], s["rising"], waiting = was, [raw], True
        elif s["grace"] and d >= 1.0:
            up = True
        if up:
            level, flag = raw, "UPWARD_SHIFT_TRACKED"
            s |= {"x": raw, "p": 4.0, "grace": 4, "falls": 0, "drops": 0, "anchor": None, "rising": [], "mode": "UPWARD_CONFIRMED"}
        elif waiting:
            level, flag, s["mode"] = was, "PENDING_UPWARD_SHIFT_HELD", "PENDING_UPWARD"
        elif s["grace"] and d <= -0.5 * shift:
            level, flag = raw, "UPWARD_REVERSAL_RESET"
            s |= {"x": raw, "grace": 0}
        elif d <= -shift:
            s["falls"] += 1
            if s["falls"] >= 3:
                level, flag = raw, "DOWNWARD_SHIFT_TRACKED"
                s |= {"x": raw, "p": 4.0, "falls": 0, "drops": 0, "mode": "DOWNWARD_CONFIRMED"}
            else:
                level, flag, s["mode"] = was, "PENDING_DOWNWARD_SHIFT_HELD", "PENDING_DOWNWARD"
        elif lower:
            most = max(4.0, 3 * j)
            level, flag = s["x"] + min(max(0.65 * (median(four) - s["x"]), -most), most), "STABLE_LEVEL_TRACKING"
            s |= {"p": 2.0, "falls": 0, "drops": 0, "mode": "STABLE"}
        else:
            s["falls"] = 0
            level, flag = _kalman(s, raw, speed, minutes, state, j, moved, places, goal), "SMOOTH_KALMAN"
            s["mode"] = "GRADUAL_TRACKING" if state == "GRADUAL_CHANGE" else "STABLE"
    level = _clamp(level, cap)
    s |= {"x": level, "clean": level}
    _push(s, "fuel", raw)
    _push(s, "speed", speed)
    _push(s, "coords", here)
    return out(level, state, flag, (level - was) / minutes)


INPUT = ("vehicle_id", "seq", "us", "fuel", "speed", "capacity", "label", "lat", "lng")


def run(s: dict, points: Iterable[tuple]) -> Iterator[dict]:
    """Outputs of points, rows of INPUT of one vehicle in time order."""
    for point in points:
        yield _point(s, point)


def by_vehicle_in_order(t: DataFrame, columns: tuple[str, ...], fresh_state, one_step, out: str, keys: int = 1) -> DataFrame:
    """A causal step over the points of each vehicle (or of each value of the first `keys` columns), as a stream: they are dealt to
    partitions and sorted by time, and only the state of the one at hand is held. Columns that t lacks are null.
    """
    have = t.selectExpr(*[c if c in t.columns else f"null as {c}" for c in columns])
    names, kinds = zip(*(f.split() for f in out.split(", ")), strict=True)
    arrow = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    types = [arrow[k] for k in kinds]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            rows = []
            for point in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or point[:keys] != own:
                    own, state = point[:keys], fresh_state()
                rows.append(one_step(state, point))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, types, strict=True)], names)

    key = columns[:keys]
    return have.repartition(*key).sortWithinPartitions(*key, "us", "seq").mapInArrow(each, out)


def _point(s: dict, point: tuple) -> dict:
    vehicle_id, seq, us, *rest = point
    return {"vehicle_id": vehicle_id, "seq": seq, "us": us} | step(s, us, *rest)


def track(t: DataFrame) -> DataFrame:
    """Batch: the step over each vehicle's points in time order."""
    return by_vehicle_in_order(t, INPUT, fresh, _point, OUT)


def _segment_point(s: dict, point: tuple) -> dict:
    vehicle_id, segment_id, *rest = point
    return {"segment_id": segment_id} | _point(s, (vehicle_id, *rest))


def track_segments(t: DataFrame) -> DataFrame:
    """Batch: the step over the points of each (vehicle_id, segment_id) in time order, each with a fresh state and dealt by both."""
    return by_vehicle_in_order(t, ("vehicle_id", "segment_id", *INPUT[1:]), fresh, _segment_point, f"segment_id long, {OUT}", keys=2)
