"""Gated Kalman filter of levels: one causal fold for each segment of a vehicle, its inputs prepared by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankwise.operators.tracking import by_vehicle_in_order
from tankwise.operators.windows import rolling_std, rounded

# Noise of levels and process, first variance, lowest gate in litres and as a share of the capacity, points that confirm a shift.
LEVEL_NOISE, PROCESS_NOISE, VARIANCE, GATE, GATE_SHARE, CONFIRM = 9.0, 0.2, 4.0, 5.0, 0.02, 3


INPUT = ("vehicle_id", "segment_id", "seq", "us", "fuel", "speed", "noise", "acceleration", "periods")
OUT = "vehicle_id string, segment_id long, seq long, us long, fuel double, estimate double"


def inputs(steps: DataFrame) -> DataFrame:
    """Points with the time since the last valid one of their segment in reporting periods, acceleration and noise.

    A period is the vehicle's median positive gap, 5 minutes without one; gaps of points that are not valid add up.
    """
    own, w = Window.partitionBy("vehicle_id"), Window.partitionBy("vehicle_id", "segment_id").orderBy("us", "seq")
    t = steps.withColumn("period", F.coalesce(F.percentile(F.when(F.col("gap_min") > 0, F.col("gap_min")), 0.5).over(own), F.lit(5.0)))
    gap = F.when(F.col("gap_min") > 0, F.col("gap_min")).otherwise(F.col("period"))
    seconds = F.greatest(F.coalesce("gap_min", "period"), F.lit(1.0)) * 60
    faster = F.coalesce(F.col("speed") - F.lag("speed").over(w), F.lit(0.0))
    t = t.withColumns({"elapsed": F.sum(gap).over(w), "acceleration": faster / 3.6 / seconds, "noise": rounded(rolling_std(), 9)})
    before = F.last(F.when(F.col("fuel") > 0, F.col("elapsed")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("periods", (F.col("elapsed") - before) / F.col("period"))


def _variances(gate: float, falling: bool, speed: float, noise: float, acceleration: float, periods: float) -> tuple[float, float]:
    """Noise of this level and of the process before it."""
    r, q = LEVEL_NOISE, PROCESS_NOISE * max(periods, 0.1)
    if speed <= 3 and noise <= max(3.0, gate * 0.75) and abs(acceleration) <= 0.12:
        r, q = max(3.0, r * 0.35), q * 4
    elif falling:
        r, q = max(4.0, r * 0.55), q * 8
    if speed > 5:
        r *= 2.0 if speed <= 40 else 1.5 if speed <= 70 else 2.5
    return (r * 3 if abs(acceleration) > 0.1 else r), q


def step(s: dict, gate: float, level: float, speed: float, noise: float, acceleration: float, periods: float | None) -> float:
    """Take one valid level in; changes s and returns the estimate."""
    if s["x"] is None:
        s["x"] = level
        return level
    off, limit = level - s["x"], max(gate, 2 * noise)
    now = (off > 0) - (off < 0)
    s["far"] = 0 if abs(off) <= limit else s["far"] + 1 if s["side"] in (0, now) else 1
    shaken = speed > 10 or noise > max(3.0, gate * 0.75) or abs(acceleration) > 0.12
    falling = off < -limit and shaken and s["far"] >= 2
    s["side"] = now
    if s["far"] >= CONFIRM:
        s |= {"x": level, "p": VARIANCE, "far": 0, "side": 0}
    elif s["far"] == 0 or falling:
        r, q = _variances(gate, falling, speed, noise, acceleration, periods)
        gain = (s["p"] + q) / (s["p"] + q + r)
        s |= {"x": max(0.0, s["x"] + gain * off), "p": (1 - gain) * (s["p"] + q)}
    return s["x"]


def gated_kalman(steps: DataFrame, capacity: float = 200.0) -> DataFrame:
    """(vehicle_id, segment_id, seq, us, fuel, estimate) of every point of steps(); null estimate where the level is not valid.

    The filter is causal: the points of a segment stream by in order, and segments of one vehicle are dealt apart.
    """
    gate = max(GATE, GATE_SHARE * capacity)

    def one(s: dict, point: tuple) -> dict:
        vehicle_id, segment_id, seq, us, level, *more = point
        estimate = step(s, gate, level, *more) if level is not None and level > 0 else None
        return {"vehicle_id": vehicle_id, "segment_id": segment_id, "seq": seq, "us": us, "fuel": level, "estimate": estimate}

    fresh = lambda: {"x": None, "p": VARIANCE, "far": 0, "side": 0}
    return by_vehicle_in_order(inputs(steps), INPUT, fresh, one, OUT, keys=2)


# Measurement and process noise at rest and in use, and the share of a new level that is taken at once.
REST, USE_R, USE_R_FAR, USE_Q, TAKEN = (45.0, 0.01), 12.0, 30.0, 0.08, 0.9


def phased_kalman(t: DataFrame, rest_minutes: float = 30.0, shift_minutes: float = 45.0) -> DataFrame:
    """(vehicle_id, seq, us, fuel, estimate): the illustrative filter whose gate opens by the clock of each vehicle.

    At rest the level is nearly locked; in the shift that follows the first level is taken whole and others nearly so; after that
    it is smoothed as in use, more where it is more than 2 litres off. Levels must be numbers: rows without one go.
    """

    def one(s: dict, point: tuple) -> dict:
        vehicle_id, seq, us, z = point
        if s["x"] is None:
            s |= {"x": z, "first": us}
        minutes = (us - s["first"]) / 60_000_000
        if rest_minutes <= minutes <= shift_minutes:
            s |= {"x": z if not s["shifted"] else TAKEN * z + (1 - TAKEN) * s["x"], "p": 1.0, "shifted": True}
        else:
            off = z - s["x"]
            r, q = REST if minutes < rest_minutes else (USE_R_FAR if abs(off) > 2 else USE_R, USE_Q)
            gain = (s["p"] + q) / (s["p"] + q + r)
            s |= {"x": s["x"] + gain * off, "p": (1 - gain) * (s["p"] + q)}
        return {"vehicle_id": vehicle_id, "seq": seq, "us": us, "fuel": z, "estimate": s["x"]}

    known = t.where("fuel is not null and not isnan(fuel)")
    fresh = lambda: {"x": None, "p": 1.0, "first": None, "shifted": False}
    return by_vehicle_in_order(known, ("vehicle_id", "seq", "us", "fuel"), fresh, one, "vehicle_id string, seq long, us long, fuel double, estimate double")
