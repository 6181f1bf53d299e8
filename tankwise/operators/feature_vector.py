"""The 28 features of the state model, with two faces: offline, which looks around a point, and causal, which sees only what came."""

from __future__ import annotations

import math
import statistics
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankwise.operators import tracking
from tankwise.operators.windows import VEHICLE, epochs, library_haversine, middle, motion, rounded, valid_history

# Names of the features, in the order of the model's vector.
NAMES = [
    "FuelLevel",
    "FuelPct",
    "Speed",
    "MotionSpeedKmh",
    "TimeGapMinutes",
    "DeltaFuel",
    "DeltaPct",
    "AbsDeltaFuel",
    "DeltaOverNoise",
    "RollingStd12",
    "RollingStdPct",
    "DistanceMeters",
    "GpsSpeedKmh",
    "HasGPS",
    "capacity_est",
    "noise_sigma_liters",
    "flat_jitter_threshold",
    "spike_threshold",
    "event_threshold",
    "PrevMedian3",
    "FutureMedian3",
    "FutureMedian5",
    "ReturnToPrevLevel",
    "LocalRange5",
    "LocalRange7",
    "PeakReversalFlag",
    "ValleyReversalFlag",
    "TransientScore",
]
#: Before the name of a feature that stands as a column beside those of the points, since names differ by case alone.
IN = "_in_"
# Floor in litres and share of capacity of the causal thresholds.
NOISE, FLAT, SPIKE, EVENT = (0.5, 0.002), (0.8, 0.003), (3.0, 0.012), (6.0, 0.035)


def _shares(of: dict[str, Column], capacity: Column) -> dict[str, Column]:
    """The features that are others as shares of the capacity, or in noise; 0 without one."""
    share = lambda c: F.coalesce(F.try_divide(c, capacity), F.lit(0.0))
    return of | {
        "FuelPct": share(of["FuelLevel"]), "DeltaPct": share(of["DeltaFuel"]), "RollingStdPct": share(of["RollingStd12"]), "AbsDeltaFuel": F.abs(of["DeltaFuel"]),
        "DeltaOverNoise": F.coalesce(F.try_divide(of["DeltaFuel"], of["noise_sigma_liters"]), F.lit(0.0)), "capacity_est": capacity,
    }


def offline(t: DataFrame) -> DataFrame:
    """profile.featured(t), or what is made from it, with features: the 28 as doubles, 0 for one without a value."""
    c = F.col
    of = _shares({
        "FuelLevel": c("fuel"), "Speed": c("speed"), "MotionSpeedKmh": c("motion_speed"), "TimeGapMinutes": c("gap0"), "DeltaFuel": c("delta0"), "RollingStd12": c("std12"), "DistanceMeters": c("distance"),
        "GpsSpeedKmh": c("gps_speed"), "HasGPS": (c("lat").isNotNull() & c("lng").isNotNull()), "noise_sigma_liters": c("sigma"), "flat_jitter_threshold": c("flat"), "spike_threshold": c("spike"),
        "event_threshold": c("event"), "PrevMedian3": c("prev3"), "FutureMedian3": c("next3"), "FutureMedian5": c("next5"), "ReturnToPrevLevel": c("return_level"), "LocalRange5": c("range_m2p5"),
        "LocalRange7": c("range_pm3"), "PeakReversalFlag": c("is_peak"), "ValleyReversalFlag": c("is_valley"), "TransientScore": c("transient_score"),
    }, c("capacity"))
    return _added(t, of)


def _added(t: DataFrame, of: dict[str, Column]) -> DataFrame:
    """t with the struct features: one double for each name."""
    return t.withColumn("features", F.struct(*[F.coalesce(of[n].cast("double"), F.lit(0.0)).alias(n) for n in NAMES]))


def _deviation(values: str | Column) -> Column:
    """Population deviation of an array in one pass, value by value, as the SQL takes it: the same to the last bit, so ties round alike."""
    state = lambda n, mean, m2: F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    def add(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return state(s["n"] + 1, mean, s["m2"] + (x - mean) * (x - s["mean"]))

    zero = F.lit(0.0)
    return F.aggregate(values, state(zero, zero, zero), add, lambda s: F.sqrt(s["m2"] / s["n"]))


#: Levels before the own one that the causal face remembers.
PAST = 12


def _of_levels(levels: Column) -> dict[str, Column]:
    """The features that follow from the levels of the open epoch alone, the own one last."""
    n = F.size(levels)
    last = lambda k: F.slice(levels, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
    span = lambda k: F.array_max(last(k)) - F.array_min(last(k))
    return {
        "DeltaFuel": F.when(n > 1, F.get(levels, n - 1) - F.get(levels, n - 2)).otherwise(0.0), "RollingStd12": F.when(n >= 3, _deviation(levels)).otherwise(0.0), "PrevMedian3": middle(last(3)), "LocalRange5": span(5),
        "LocalRange7": span(7),
    }


def _thresholds(capacity: Column) -> dict[str, Column]:
    at_least = lambda pair: F.greatest(F.lit(pair[0]), pair[1] * F.coalesce(capacity, F.lit(0.0)))
    return {"noise_sigma_liters": at_least(NOISE), "flat_jitter_threshold": at_least(FLAT), "spike_threshold": at_least(SPIKE), "event_threshold": at_least(EVENT)}


def _known(of: dict[str, Column], capacity: Column) -> dict[str, Column]:
    """All features of remembered() points from those of their levels and the capacity, null without one."""
    speed, nothing = F.coalesce("speed", F.lit(0.0)), F.lit(0.0)
    return _shares(of | _thresholds(capacity) | {
        "FuelLevel": F.col("fuel"), "Speed": speed, "MotionSpeedKmh": speed, "TimeGapMinutes": F.greatest("since_min", F.lit(0.1)), "DistanceMeters": F.col("displacement"), "GpsSpeedKmh": speed, "HasGPS": F.col("places") > 0,
        "FutureMedian3": of["PrevMedian3"], "FutureMedian5": of["PrevMedian3"],
        "ReturnToPrevLevel": nothing, "PeakReversalFlag": nothing, "ValleyReversalFlag": nothing, "TransientScore": nothing,
    }, capacity)


def remembered(t: DataFrame, keys: tuple[str, ...] = VEHICLE, far: Callable[..., Column] | None = None) -> DataFrame:
    """epochs(t) with motion() and past, the last levels of the epoch before each point."""
    return valid_history(motion(epochs(t, keys), keys=keys, far=far), PAST, keys)


def _usable(capacity: Column) -> Column:
    return F.when((capacity > 0) & (capacity < float("inf")), capacity)


def causal(t: DataFrame, keys: tuple[str, ...] = VEHICLE) -> DataFrame:
    """epochs(t) with features: the 28 as they are known when a point comes, null where no model is asked.

    A model is asked for valid levels after the first of the keys. Levels are those of the open epoch, at most twelve and the own;
    coordinates those of motion(); what needs the future is filled as if nothing followed. capacity, if t has it, counts
    where it is above zero.
    """
    t = remembered(t, keys).withColumn("_levels", F.concat("past", F.array("fuel")))
    t = t.withColumn("_cap", _usable(F.col("capacity")) if "capacity" in t.columns else F.lit(None).cast("double"))
    first = F.col("opens") & (F.col("epoch") == 1)
    out = _added(t, _known(_of_levels(F.col("_levels")), F.col("_cap")))
    return out.withColumn("features", F.when(F.col("valid") & ~first, F.col("features"))).drop("_levels", "_cap", "past")


def causal_by_capacity(t: DataFrame, capacities: DataFrame, decimals: int) -> DataFrame:
    """The points for which causal() asks a model, once for each row that capacities (vehicle_id, capacity) has for the vehicle:
    vehicle_id, seq, epoch and the 28 features with so many decimals.

    Such copies of a point follow each other, by capacity, and each counts as a level for those after it; epochs, gaps and motion are
    those of the points. A vehicle that is not in capacities has one copy without a capacity. What the copies share is computed
    and rounded once: for a point, for a capacity, and for each of the first thirteen copies, as all further ones see the own
    level alone. A row itself takes four quotients.
    """
    r = lambda c: rounded(c, decimals) + F.lit(0.0)
    first = F.col("opens") & (F.col("epoch") == 1)  # nothing was remembered before it
    cap = F.coalesce(_usable(F.col("capacity")), F.lit(0.0))
    limits = _thresholds(cap)
    of_capacity = F.struct(cap.alias("cap"), limits["noise_sigma_liters"].alias("noise"), r(cap).alias("capacity_est"), *[r(c).alias(n) for n, c in limits.items()])
    held = capacities.select("vehicle_id", of_capacity.alias("of")).groupBy("vehicle_id").agg(F.sort_array(F.collect_list("of")).alias("_caps"))
    none = F.array(F.struct(*[F.lit(x).alias(n) for n, x in {"cap": 0.0, "noise": NOISE[0], "capacity_est": 0.0, "noise_sigma_liters": NOISE[0], "flat_jitter_threshold": FLAT[0], "spike_threshold": SPIKE[0], "event_threshold": EVENT[0]}.items()]))
    of_point = {"FuelLevel": F.col("fuel"), "Speed": F.coalesce("speed", F.lit(0.0)), "TimeGapMinutes": F.greatest(F.when(~first, F.col("since_min")), F.lit(0.1)), "DistanceMeters": F.col("displacement")}
    t = remembered(t, far=library_haversine).where("valid").select("vehicle_id", "seq", "epoch", first.alias("_first"), "fuel", "past", (F.col("places") > 0).cast("double").alias("HasGPS"), *[r(c).alias(n) for n, c in of_point.items()])
    t = t.join(held, "vehicle_id", "left").withColumn("_caps", F.coalesce("_caps", none))
    t = t.withColumn("_seen", seen_by_copies(decimals)("past", "fuel", F.least(F.size("_caps"), F.lit(PAST + 1)))).select("*", F.posexplode("_caps").alias("_copy", "_cap"))
    t = t.where((F.col("_copy") > 0) | ~F.col("_first")).withColumn("_own", F.get("_seen", F.least("_copy", F.lit(PAST))))
    own, of = F.col("_own"), F.col("_cap")
    share = lambda c: F.when(of["cap"] > 0, r(c / of["cap"])).otherwise(0.0)
    quotients = {"FuelPct": share(F.col("fuel")), "DeltaPct": share(own["delta"]), "RollingStdPct": share(own["deviation"]), "DeltaOverNoise": r(own["delta"] / of["noise"])}
    same = {"MotionSpeedKmh": "Speed", "GpsSpeedKmh": "Speed", "FutureMedian3": "PrevMedian3", "FutureMedian5": "PrevMedian3"}

    def column(n: str) -> Column:
        n = same.get(n, n)
        return quotients[n] if n in quotients else own[n] if n in OF_COPY else of[n] if n in limits or n == "capacity_est" else F.col(n) if n in of_point or n == "HasGPS" else F.lit(0.0)

    return t.select("vehicle_id", "seq", "epoch", *[column(n).alias(n) for n in NAMES])


# Features of a copy that follow from its levels, rounded; before them the bare difference and deviation.
OF_COPY = ("DeltaFuel", "AbsDeltaFuel", "RollingStd12", "PrevMedian3", "LocalRange5", "LocalRange7")


def seen_by_copies(decimals: int):
    """A function of (past, fuel, copies): what the levels tell each copy of a point, where each level of the past came as many times.

    Column by column over the points of a batch, levels from the oldest to the own: the operations are those of _of_levels().
    """

    @F.arrow_udf(f"array<struct<delta:double,deviation:double,{','.join(f'{n}:double' for n in OF_COPY)}>>")
    def seen(past: pa.Array, fuel: pa.Array, copies: pa.Array) -> pa.Array:
        held, starts, c = np.append(past.flatten().to_numpy(zero_copy_only=False), np.nan), past.offsets.to_numpy(), copies.to_numpy()
        starts, ends = starts[:-1] - starts[0], starts[1:] - starts[0]
        offsets = np.concatenate([[0], np.cumsum(c)])
        point = np.repeat(np.arange(len(c)), c)
        copy, c = np.arange(offsets[-1]) - offsets[point], c[point]
        own, starts, ends = fuel.to_numpy()[point], starts[point], ends[point]

        def level(k: int) -> np.ndarray:  # the k-th before the own one; NaN before the epoch
            at = ends - 1 - (k - copy - 1) // c
            return np.where(k <= copy, own, held[np.where(at >= starts, at, -1)])

        levels = [level(k) for k in range(PAST + 1)]
        n, mean, m2 = (np.zeros(len(own)) for _ in range(3))
        for x in reversed(levels):
            there = ~np.isnan(x)
            n = n + there
            new = np.where(there, mean + (x - mean) / np.maximum(n, 1), mean)
            m2 = np.where(there, m2 + (x - new) * (x - mean), m2)
            mean = new
        delta = np.where(n > 1, own - levels[1], 0.0)
        deviation = np.where(n >= 3, np.sqrt(m2 / n), 0.0)
        low, high = np.fmin(own, levels[1]), np.fmax(own, levels[1])
        mid = np.where(n >= 3, np.fmax(low, np.fmin(high, levels[2])), (low + high) / 2)
        span = lambda k: np.fmax.reduce(levels[:k]) - np.fmin.reduce(levels[:k])
        scale = 10.0**decimals

        def nearest(v: np.ndarray) -> np.ndarray:  # windows.rounded()
            size = np.abs(v * scale)
            below = np.floor(size)
            return np.where(size < 2.0**52, np.copysign(below + (size - below >= 0.5), v), v * scale) / scale + 0.0

        columns = [delta, deviation, *map(nearest, (delta, np.abs(delta), deviation, mid, span(5), span(7)))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in columns], ["delta", "deviation", *OF_COPY]))

    return seen


#: What the point step takes and gives: the point, what is known without a model, whether the last six levels fall steadily, the features.
STEP_INPUT = ("vehicle_id", "seq", "us", "fuel", "speed", "capacity", "lat", "lng")
STEP_OUT = "vehicle_id string, seq long, us long, fuel double, speed double, capacity double, lat double, lng double, kind string, known string, falling int, " + ", ".join(f"{IN}{n} double" for n in NAMES)


def fresh() -> dict:
    return {"us": None, "levels": [], "coords": [], "six": []}


def step(s: dict, point: tuple) -> dict:
    """causal() for streams: takes one point (STEP_INPUT) in, changes the JSON-able state s and returns STEP_OUT.

    known is the state where no model is asked (UNINITIALIZED, INIT, STABLE_JITTER), else null.
    """
    vehicle_id, seq, us, fuel, speed, capacity, lat, lng = point
    out = dict(zip(STEP_INPUT, point, strict=True)) | {"kind": "point", "known": None, "falling": 0} | dict.fromkeys([IN + n for n in NAMES], 0.0)
    valid = fuel is not None and math.isfinite(fuel) and fuel > 0
    speed = speed if speed is not None and math.isfinite(speed) else 0.0
    cap = float(capacity) if capacity is not None and math.isfinite(capacity) and capacity > 0 else None
    here = tracking._coordinate(lat, lng)
    s["six"] = [*s["six"], fuel][-6:]
    out["falling"] = int(_falls(s["six"], cap))
    if s["us"] is None:
        if valid:
            s |= {"us": us, "levels": [fuel], "coords": [here]}
        return out | {"known": "INIT" if valid else "UNINITIALIZED"}
    minutes = max((us - s["us"]) / 60_000_000, 0.1)
    _, _, far, places = tracking.motion(s, speed, here)
    if valid and minutes > 30:
        s |= {"levels": [], "coords": []}
    s["us"], s["coords"] = us, [*s["coords"], here][-12:]
    if not valid:
        return out | {"known": "STABLE_JITTER"}
    levels = [*s["levels"], fuel]
    s["levels"] = levels[-12:]
    at_least = lambda pair: max(pair[0], pair[1] * (cap or 0.0))
    span = lambda k: max(levels[-k:]) - min(levels[-k:])
    delta, spread, middle_ = fuel - levels[-2] if len(levels) > 1 else 0.0, statistics.pstdev(levels) if len(levels) >= 3 else 0.0, statistics.median(levels[-3:])
    share = lambda x: x / cap if cap else 0.0
    features = {
        "FuelLevel": fuel, "FuelPct": share(fuel), "Speed": speed, "MotionSpeedKmh": speed, "TimeGapMinutes": minutes, "DeltaFuel": delta, "DeltaPct": share(delta), "AbsDeltaFuel": abs(delta), "DeltaOverNoise": delta / at_least(NOISE),
        "RollingStd12": spread, "RollingStdPct": share(spread), "DistanceMeters": far, "GpsSpeedKmh": speed, "HasGPS": float(places > 0), "capacity_est": cap or 0.0, "noise_sigma_liters": at_least(NOISE), "flat_jitter_threshold": at_least(FLAT),
        "spike_threshold": at_least(SPIKE), "event_threshold": at_least(EVENT), "PrevMedian3": middle_, "FutureMedian3": middle_, "FutureMedian5": middle_, "LocalRange5": span(5), "LocalRange7": span(7),
    }
    return out | {IN + n: float(x) for n, x in features.items()}


def _falls(six: list, cap: float | None) -> bool:
    """The rule of preparation.gradual_override() for the last six levels."""
    if len(six) < 6 or any(x is None or not math.isfinite(x) for x in six):
        return False
    moves = [b - a for a, b in zip(six, six[1:], strict=False)]
    path, net = sum(map(abs, moves)), six[-1] - six[0]
    return net <= -max(1.2, 0.005 * (cap or 0.0)) and path > 1e-5 and -net >= 0.55 * path and max(moves) <= 2
