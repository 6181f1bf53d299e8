"""The alternative causal filter: an adaptive Kalman filter whose level moves only on confirmed evidence.

A pure step over a JSON-able state, run by the same harness as the tracking step. A point passes these gates in turn:
sensor dropouts are held at the last valid level until it recovers or a lower level is confirmed; small noise is frozen; a
possible new level (a candidate) and a small hill are watched over several points; what is left moves the Kalman estimate,
by how noisy the window is and how steadily the level falls.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import DataFrame

from tankwise.operators.tracking import by_vehicle_in_order, median

INPUT = ("vehicle_id", "seq", "us", "fuel", "label", "jitter", "noise", "event", "rolling_std", "speed", "distance", "quality_flag", "quality_reason", "confidence", "capacity", "segment_id", "observed")
OUT = "vehicle_id string, seq long, us long, raw double, enhanced double"
MINUTE = 60_000_000

# Names of other producers, reasons that mean a dropout, and limits.
LABELS = {
    "REFUEL": "UPWARD_SHIFT",
    "UPWARD_LEVEL_SHIFT": "UPWARD_SHIFT",
    "DRAIN": "DOWNWARD_SHIFT",
    "DOWNWARD_LEVEL_SHIFT": "DOWNWARD_SHIFT",
    "CONSUMPTION": "GRADUAL_CHANGE",
    "SLOSHING": "OSCILLATION_NOISE",
    "SLOSHING_NOISE": "OSCILLATION_NOISE",
    "SPIKE": "IMPULSE_NOISE",
}
DROPOUT_REASONS = ("FUEL_ZERO", "SENSOR_DROPOUT", "DROPOUT")
RESET_GAP, RECOVERY_RATIO, RECOVERY_POINTS = 120.0, 0.70, 3
LOW_POINTS, LOW_POINTS_ALONE, LOW_CONFIDENCE, LOW_GAP = 3, 35, 0.55, 30.0
CANDIDATE_POINTS, CANDIDATE_MINUTES, CANDIDATE_GAP, CANDIDATE_MEMORY = 3, 4.0, 7.5, 5
HILL_RELEASE, AFTER_RISE = 8, 10
# Measurement and process noise by what the point is.
SPIKE_NOISE, RISE_NOISE, FALL_NOISE, WILD_NOISE, GRADUAL_NOISE = (10_000.0, 0.0001), (1.0, 5.0), (5.0, 2.0), (1000.0, 0.001), (25.0, 0.15)
CALM_R, VERY_CALM_R, CALM_Q = 35.0, 15.0, 0.05


def fresh() -> dict:
    return _cleared() | {"period": 2.0, "segment": None, "us": None}


def _cleared() -> dict:
    return {"x": None, "p": 4.0, "valid": None, "falls": 0, "lows": 0, "grace": 0, "before": None, "before2": None, "held": None, "candidate": None, "hill": None, "release": 0}


def _number(v, default: float) -> float:
    return default if v is None or v != v else float(v)


def _remember(s: dict, z: float) -> None:
    s["before2"], s["before"] = s["before"], z


def _watch(z: float, us: int, **more) -> dict:
    return {"centre": z, "v": [z], "t": [us]} | more


def _add(c: dict, z: float, us: int) -> None:
    c["v"], c["t"] = [*c["v"], z][-CANDIDATE_MEMORY:], [*c["t"], us][-CANDIDATE_MEMORY:]


def _minutes(c: dict) -> float:
    return max(0.0, (c["t"][-1] - c["t"][0]) / MINUTE)


def _through_dropout(s: dict, seen: float, gap: float, label: str, sure: float) -> tuple[float | None, bool]:
    """While a dropout is held: (its level, False) to go on holding, (None, whether a lower level is confirmed) to go on."""
    held = s["held"]
    limit = held["level"] * RECOVERY_RATIO
    if seen >= limit:
        held["back"] += 1
        if held["back"] < RECOVERY_POINTS:
            return held["level"], False
    elif seen <= limit:
        held["back"] = 0
        held["zero"] |= seen <= 5.0
        held["low"] += 0.0 <= gap <= LOW_GAP
        supported = label == "DOWNWARD_SHIFT" and sure >= LOW_CONFIDENCE and held["low"] >= LOW_POINTS
        if held["zero"] or not (supported or held["low"] >= LOW_POINTS_ALONE):
            return held["level"], False
        s["held"] = None
        return None, True
    s["held"] = None
    return None, False


def _hill(s: dict, z: float, us: int, gap: float, opens_up: float, jitter: float, noise: float, restless: bool) -> None:
    """A small rise below the size of a new level is watched: held until it lasts, forgotten when it returns."""
    hill, x, least = s["hill"], s["x"], max(1.25 * jitter, 1.5 * noise, 2.0)
    if hill is not None:
        over = abs(z - hill["anchor"]) <= max(1.25 * jitter, 1.5 * noise, 1.5) or gap > CANDIDATE_GAP or z >= x + opens_up
        if not over and abs(z - hill["centre"]) <= max(1.5 * jitter, 2 * noise, 2.5) and z >= hill["anchor"] + least:
            _add(hill, z, us)
            hill["centre"] = median(hill["v"])
            if len(hill["v"]) >= (4 if restless else 3) and _minutes(hill) >= 4.0:
                s["hill"], s["release"] = None, HILL_RELEASE
        else:
            s["hill"] = None
    if s["hill"] is None and not s["release"] and s["candidate"] is None and not s["grace"] and x + least <= z < x + opens_up:
        s["hill"] = _watch(z, us, anchor=x)


def _candidate(s: dict, z: float, us: int, gap: float, label: str, sure: float, opens_up: float, jitter: float, noise: float, event: float, capacity: float, restless: bool) -> tuple[str, float] | None:
    """A possible new level: (direction, level) once it is confirmed."""
    x, c = s["x"], s["candidate"]
    flat = max(2 * jitter, 2.5 * noise, 3.0)
    if c is not None and (abs(z - c["anchor"]) <= max(1.25 * jitter, 1.5 * noise, 1.5) or gap > CANDIDATE_GAP):
        c = s["candidate"] = None
    if c is None:
        opens_down = max(0.35 * event, 0.0125 * capacity, 3 * jitter, 4 * noise, 8.0)
        fell = s["before"] - z if s["before"] is not None else 0.0
        abrupt = fell >= max(0.35 * event, 2 * jitter, 3 * noise, 5.0)
        told = label == "DOWNWARD_SHIFT" and sure >= LOW_CONFIDENCE and fell >= max(1.5 * jitter, 2 * noise, 2.5)
        if z >= x + opens_up:
            c = _watch(z, us, up=True, anchor=x, least=opens_up, need=CANDIDATE_POINTS)
        elif z <= x - opens_down and (abrupt or told):
            c = _watch(z, us, up=False, anchor=x, least=opens_down, need=CANDIDATE_POINTS + restless)
    else:
        away = z - x if c["up"] else x - z
        beyond = z - c["centre"] if c["up"] else c["centre"] - z
        if abs(z - c["centre"]) <= flat and away >= c["least"]:
            _add(c, z, us)
            c["centre"] = median(c["v"])
        elif beyond > flat:  # a further step in the same direction
            _add(c, z, us)
            c["centre"] = z
        else:
            c = None
    s["candidate"] = c
    if c is None or label == "IMPULSE_NOISE" or len(c["v"]) < max(2, c["need"]) or _minutes(c) < CANDIDATE_MINUTES:
        return None
    v = c["v"]
    line = [c["anchor"], *v]
    path = sum(abs(b - a) for a, b in pairwise(line))
    straight = abs(line[-1] - line[0]) / path if path > 1e-9 else 1.0
    slack = max(0.25 * noise, 0.3)
    advancing = v[-1] >= max(v[:-1]) - slack if c["up"] else v[-1] <= min(v[:-1]) + slack
    ramp = straight >= 0.85 and advancing and abs(v[-1] - c["anchor"]) >= 1.5 * c["least"]
    if not ramp and not (max(v) - min(v) <= flat and straight >= 0.5):
        return None
    s["candidate"] = None
    return "UP" if c["up"] else "DOWN", v[-1] if ramp else median(v)


def step(s: dict, us: int, fuel, label=None, jitter=None, noise=None, event=None, rolling_std=None, speed=None, distance=None, quality_flag=None, quality_reason=None, confidence=None, capacity=None, segment_id=None, observed=None) -> float | None:
    """Take one point in; changes s and returns the enhanced level, None before the first valid one."""
    z = _number(fuel, math.nan)
    gap = (us - s["us"]) / MINUTE if s["us"] is not None else 0.0
    segment = str(segment_id) if segment_id not in (None, "") else None
    if 0.25 <= gap <= 15.0:
        s["period"] = 0.8 * s["period"] + 0.2 * gap
    if (s["segment"] is not None and segment is not None and segment != s["segment"]) or gap > RESET_GAP:
        s |= _cleared()
    s["us"], s["segment"] = us, segment if segment is not None else s["segment"]
    label = (label or "UNKNOWN").strip().upper()
    label = LABELS.get(label, label)
    sure, wobble, speed = _number(confidence, 0.0), _number(rolling_std, 0.0), max(_number(speed, 0.0), 0.0)
    capacity, noise, jitter = max(_number(capacity, 200.0), 50.0), max(_number(noise, 0.8), 0.1), max(_number(jitter, 0.8), 0.1)
    event = max(_number(event, 5.0), 5 * jitter, 4 * noise, 2.0)
    wild = wobble >= max(1.5 * jitter, 3 * noise)
    seen = _number(observed, z)
    reason = str(quality_reason or "").upper()
    bad = any(r in reason for r in DROPOUT_REASONS) or (z <= 1.0 and str(quality_flag) in ("1", "1.0"))

    confirmed_low = False
    if s["held"] is not None:
        level, confirmed_low = _through_dropout(s, seen, gap, label, sure)
        if level is not None:
            return level
    dropout = not confirmed_low and (z != z or bad or (seen <= 5.0 and s["valid"] is not None and s["valid"] >= 15.0))
    if dropout:
        s["candidate"] = s["hill"] = None
        if s["valid"] is not None and s["valid"] > 3.0:
            s["held"] = {"level": s["valid"], "low": 1, "back": 0, "zero": seen <= 5.0}
            return s["valid"]
        if z != z or z <= 0:
            return s["x"]
    if s["x"] is None:
        s["x"] = s["valid"] = z
        _remember(s, z)
        return z
    x = s["x"]
    if not dropout and x > 3.0 and z > 3.0:
        s["valid"] = x
    parked = speed <= 1.0 or (distance is not None and distance <= 15.0 and speed <= 3.0)
    s["grace"], s["release"] = max(0, s["grace"] - 1), max(0, s["release"] - 1)
    s["lows"] = s["lows"] + 1 if z <= x - max(1.5 * jitter, 1.2) else 0
    if confirmed_low:
        label, s["falls"] = "DOWNWARD_SHIFT", max(s["falls"], 2)
    else:
        s["falls"] = s["falls"] + 1 if label == "DOWNWARD_SHIFT" and sure >= LOW_CONFIDENCE and z <= x - max(event, 0.03 * capacity, 5.0) else 0

    noisy = wild or label in ("OSCILLATION_NOISE", "IMPULSE_NOISE")
    shaking = parked and label not in ("UPWARD_SHIFT", "DOWNWARD_SHIFT") and not s["grace"] and abs(z - x) <= max(2 * jitter, 1.8) and noisy
    first_low = s["lows"] == 1 and x - z <= 1.5 * jitter and label in ("STABLE_JITTER", "OSCILLATION_NOISE")
    if shaking or first_low:
        _remember(s, z)
        return x

    stuck = parked and label == "STABLE_JITTER" and x - z >= max(1.5 * event, 0.05 * capacity, 10.0) and s["lows"] >= 4
    opens_up = max(1.5 * jitter, 2 * noise, 0.005 * capacity, 3.0) if s["grace"] else max(0.8 * event, 0.03 * capacity, 3 * jitter, 4 * noise, 10.0)
    restless = not parked or wild
    _hill(s, z, us, gap, opens_up, jitter, noise, restless)
    confirmed = _candidate(s, z, us, gap, label, sure, opens_up, jitter, noise, event, capacity, restless)
    pending = s["candidate"] is not None or s["hill"] is not None
    if confirmed and confirmed[0] == "DOWN":
        label, s["falls"] = "DOWNWARD_SHIFT", max(s["falls"], 2)

    spike, jumps = label == "IMPULSE_NOISE", False
    if spike:
        r, q = SPIKE_NOISE
    elif stuck:
        x, r, q = x + 0.5 * (z - x), CALM_R, 0.5
    elif confirmed:
        r, q = RISE_NOISE if confirmed[0] == "UP" else FALL_NOISE
        jumps, s["grace"] = True, AFTER_RISE if confirmed[0] == "UP" else s["grace"]
    elif label == "OSCILLATION_NOISE" or wild:
        r, q = WILD_NOISE
    elif s["falls"] >= 2:
        r, q = FALL_NOISE
    elif label == "GRADUAL_CHANGE" or not parked:
        r, q = GRADUAL_NOISE
    else:
        r, q = VERY_CALM_R if wobble <= max(0.8 * jitter, 1.0) else CALM_R, CALM_Q
    if not spike and not jumps and s["falls"] < 2 and not stuck:  # the measured noise of the window counts
        local = max(0.25, wobble)
        if label == "OSCILLATION_NOISE" or wild:
            r = max(r, (6 * local) ** 2)
        elif label == "GRADUAL_CHANGE":
            r, q = max(r, (2 * min(local, max(noise, 1.0))) ** 2), max(q, 0.5)
        else:
            r, q = max(r, (3 * local) ** 2), max(q, 0.15)
    if not spike and not jumps and z < x - max(0.4 * jitter, 0.3):  # a steady fall is followed more closely
        straight_down = s["before"] is not None and s["before2"] is not None and z <= s["before"] <= s["before2"]
        if s["falls"] >= 2:
            lag = max(1.0, (x - z) / jitter)
            r, q = max(2.0, r / lag**1.2), max(q, 0.25 * lag)
        elif straight_down and (not parked or label in ("GRADUAL_CHANGE", "UNKNOWN")):
            lag = min(5.0, (x - z) / max(0.5 * jitter, 0.3))
            r, q = max(4.0, r / lag), max(q, 0.35 * lag)
    if jumps:
        x, s["p"] = confirmed[1], 4.0
        s["grace"] = 0 if confirmed[0] == "DOWN" else s["grace"]
    else:
        p = s["p"] + q * (min(3.0, max(0.5, gap / max(0.5, s["period"]))) if gap > 0 else 1.0)
        gain, soft = p / (p + r), max(1.5, 1.5 * jitter)
        s["p"] = (1 - gain) * p
        if not pending:
            x += gain * soft * math.tanh((z - x) / soft)
    s["x"] = max(0.0, x)
    if not dropout:
        s["valid"] = s["x"]
        _remember(s, z)
    return s["x"]


def _point(s: dict, point: tuple) -> dict:
    vehicle_id, seq, us, fuel, *rest = point
    return {"vehicle_id": vehicle_id, "seq": seq, "us": us, "raw": fuel, "enhanced": step(s, us, fuel, *rest)}


def enhance(t: DataFrame) -> DataFrame:
    """The filter over each vehicle's points in time order; columns of INPUT that t lacks take their usual values."""
    return by_vehicle_in_order(t, INPUT, fresh, _point, OUT)
