"""Window evidence: every feature over one partitioning and order, so one exchange and one sort serve all of them."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

GAP_MINUTES = 30
VEHICLE = ("vehicle_id",)


def by_vehicle() -> WindowSpec:
    return Window.partitionBy("vehicle_id").orderBy("us", "seq")


def rounded(c: str | Column, places: int) -> Column:
    """c with so many decimals, halves away from zero, as the SQL rounds: the nearest whole number of the scaled value.

    F.round goes by the decimal digits of the double instead, so a half that a sum missed by its last bit (11.913499999999999) fell,
    and through a decimal number, which takes longer than all else that a row needs. Doubles from 2 ** 52 on are whole.
    """
    scale = 10.0**places
    value = (F.col(c) if isinstance(c, str) else c) * scale
    size = F.abs(value)
    below = F.floor(size).cast("double")
    nearest = below + F.when(size - below >= 0.5, 1.0).otherwise(0.0)
    return F.when(size < 2.0**52, F.when(value < 0, 0.0 - nearest).otherwise(nearest)).otherwise(value) / scale


def r6(c: str | Column) -> Column:
    return rounded(c, 6) + F.lit(0.0)


def median(c: str, lo: int, hi: int, w: WindowSpec | None = None) -> Column:
    return F.percentile(c, 0.5).over((w or by_vehicle()).rowsBetween(lo, hi))


def spread(c: str, lo: int, hi: int) -> Column:
    w = by_vehicle().rowsBetween(lo, hi)
    return F.max(c).over(w) - F.min(c).over(w)


def steps(t: DataFrame) -> DataFrame:
    """gap_min, delta, abs_delta against the previous point, and the segment number (a gap over 30 minutes begins one)."""
    w = by_vehicle()
    t = t.withColumns({"gap_min": (F.col("us") - F.lag("us").over(w)) / 60_000_000, "delta": F.col("fuel") - F.lag("fuel").over(w)})
    t = t.withColumn("abs_delta", F.abs("delta"))
    return t.withColumn("segment_id", 1 + F.sum(F.when(F.col("gap_min") > GAP_MINUTES, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rolling_std(c: str = "fuel", size: int = 12, least: int = 2, per_segment: bool = True) -> Column:
    """Population deviation of the last size points, 0 below least points."""
    w = (Window.partitionBy("vehicle_id", "segment_id") if per_segment else Window.partitionBy("vehicle_id")).orderBy("us", "seq").rowsBetween(1 - size, 0)
    return F.when(F.count(c).over(w) >= least, F.stddev_pop(c).over(w)).otherwise(0.0)


def offline_gap() -> Column:
    """Minutes since the point before; 0 for the first point, for time that stands still or runs back, and above a day."""
    return F.when((F.col("gap_min") > 0) & (F.col("gap_min") <= 1440), F.col("gap_min")).otherwise(0.0)


def epochs(t: DataFrame, keys: tuple[str, ...] = VEHICLE, minutes: float = GAP_MINUTES) -> DataFrame:
    """t with valid (a finite level above zero), since_min (minutes since the row before, of any kind) and epoch.

    An epoch is what a causal filter remembers together. The first opens at the first valid row of the keys (rows before it are of
    epoch 0); another opens at a valid row that comes more than minutes after the row before, whatever kind that was: a
    dropout never opens one, and since it moves the time, it hides the gap before it from the rows that follow.
    """
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    valid = F.coalesce((F.col("fuel") > 0) & (F.col("fuel") < float("inf")), F.lit(False))  # NaN is above infinity
    t = t.withColumns({"valid": valid, "since_min": (F.col("us") - F.lag("us").over(w)) / 60_000_000})
    started = F.coalesce(F.max("valid").over(before), F.lit(False))
    t = t.withColumn("opens", F.col("valid") & (~started | F.coalesce(F.col("since_min") > minutes, F.lit(False))))
    return t.withColumn("epoch", F.sum(F.col("opens").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def by_epoch(keys: tuple[str, ...] = VEHICLE) -> WindowSpec:
    return Window.partitionBy(*keys, "epoch").orderBy("us", "seq")


def trend_window(t: DataFrame, jitter: float = 0.8) -> DataFrame:
    """Points with a level above zero and, over the last six of them in the epoch: net change, total variation, directionality
    (0 without movement), deviation (0 below three), range, and whether the window falls steadily.
    """
    t = epochs(t).where("valid")
    w, six = by_epoch(), by_epoch().rowsBetween(-5, 0)
    t = t.withColumn("step_size", F.abs(F.col("fuel") - F.lag("fuel").over(w)))
    within = F.coalesce(F.sum("step_size").over(w.rowsBetween(-4, 0)), F.lit(0.0))
    t = t.withColumns({"net": F.col("fuel") - F.first("fuel").over(six), "variation": F.when(F.count("fuel").over(six) > 1, within).otherwise(0.0)})
    t = t.withColumns({
        "directionality": F.when(F.col("variation") > 1e-6, F.abs("net") / F.col("variation")).otherwise(0.0),
        "window_std": F.when(F.count("fuel").over(six) >= 3, F.stddev_pop("fuel").over(six)).otherwise(0.0), "window_range": F.max("fuel").over(six) - F.min("fuel").over(six),
    })
    falls = (F.col("net") <= -max(1.5, 0.75 * jitter)) & (F.col("directionality") >= 0.65)
    return t.withColumn("directional_down", falls).drop("step_size")


def online_deviation(t: DataFrame) -> DataFrame:
    """Points with a level above zero and the deviation of it and the twelve such levels before in the epoch; 0 below three."""
    frame = by_epoch().rowsBetween(-12, 0)
    return epochs(t).where("valid").withColumn("online_std", F.when(F.count("fuel").over(frame) >= 3, F.stddev_pop("fuel").over(frame)).otherwise(0.0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def middle(a: Column) -> Column:
    """Median of an array without nulls, null if it is empty."""
    at = lambda ordered, i: F.get(ordered, F.floor(i).cast("int"))
    return let(F.sort_array(a), lambda o: (at(o, (F.size(o) - 1) / 2) + at(o, F.size(o) / 2)) / 2)


def near_levels(t: DataFrame) -> DataFrame:
    """t with near: an array of the four levels before, the own and the five after, null beyond the vehicle's points."""
    w = by_vehicle()
    before = [F.lag("fuel", k).over(w) for k in (4, 3, 2, 1)]
    return t.withColumn("near", F.array(*before, F.col("fuel"), *[F.lead("fuel", k).over(w) for k in (1, 2, 3, 4, 5)]))


def look_around(t: DataFrame) -> DataFrame:
    """Offline features of steps(t) with near levels and the vehicle's flat threshold: medians and ranges before and after a
    point, changes of direction beyond flat among the seven steps around it, reversals, and how far a bump returns.
    """
    level = lambda i: F.get("near", F.lit(4 + i))
    between = lambda lo, hi: F.filter(F.slice("near", 5 + lo, hi - lo + 1), lambda x: x.isNotNull())
    spread_of = lambda a, least: F.when(F.size(a) >= least, F.array_max(a) - F.array_min(a))
    t = t.withColumns({"prev_fuel": F.coalesce(level(-1), F.col("fuel")), "delta0": F.coalesce("delta", F.lit(0.0)), "next_fuel": level(1)})
    t = t.withColumns({
        "prev3": F.coalesce(middle(between(-3, -1)), F.col("fuel")), "next3": F.coalesce(middle(between(1, 3)), F.col("fuel")), "next5": F.coalesce(middle(between(1, 5)), F.col("fuel")),
        "range_m2p5": F.coalesce(spread_of(between(-2, 5), 5), F.lit(0.0)), "local_range": F.coalesce(spread_of(between(-3, 3), 3), F.lit(0.0)),
    })
    moves = F.zip_with(F.slice("near", 1, 7), F.slice("near", 2, 7), lambda a, b: F.when(b - a > F.col("flat"), 1).when(b - a < -F.col("flat"), -1))
    moves = F.filter(moves, lambda x: x.isNotNull())
    t = t.withColumn("moves", moves)
    pairs = F.zip_with(F.slice("moves", 1, F.greatest(F.size("moves") - 1, F.lit(0))), F.slice("moves", 2, F.greatest(F.size("moves") - 1, F.lit(0))), lambda a, b: a != b)
    ahead, turn = F.col("next_fuel") - F.col("fuel"), 1.5 * F.col("flat")
    back = F.abs(F.col("next5") - F.col("prev3"))
    return t.withColumns({
        "sign_changes": F.size(F.filter(pairs, lambda x: x)), "range_pm3": F.coalesce(spread_of(between(-3, 3), 5), F.col("range_m2p5")), "return_level": back,
        "is_peak": F.coalesce((F.col("delta0") > turn) & (ahead < -turn), F.lit(False)).cast("int"), "is_valley": F.coalesce((F.col("delta0") < -turn) & (ahead > turn), F.lit(False)).cast("int"),
        "transient_score": F.when(F.col("range_m2p5") > 0, F.greatest(F.lit(0.0), 1 - back / F.greatest("range_m2p5", F.lit(1e-6)))).otherwise(0.0),
    }).drop("moves", "near")


def valid_history(t: DataFrame, n: int, keys: tuple[str, ...] = VEHICLE) -> DataFrame:
    """epochs(t) with past: the last n valid levels of the epoch before each point, oldest first, however many others lie between."""
    t = t if "epoch" in t.columns else epochs(t, keys)
    number = F.sum(F.col("valid").cast("int")).over(by_epoch(keys).rowsBetween(Window.unboundedPreceding, 0))
    frame = Window.partitionBy(*keys, "epoch").orderBy("valid_no").rangeBetween(-n, 0)
    # a number has one valid row, so the frame holds the levels in order; the last one of a valid row is its own
    t = t.withColumn("valid_no", number).withColumn("past", F.collect_list(F.when(F.col("valid"), F.col("fuel"))).over(frame))
    earlier = F.size("past") - F.col("valid").cast("int")
    return t.withColumn("past", F.slice("past", F.greatest(earlier - n + 1, F.lit(1)), F.least(earlier, F.lit(n)))).drop("valid_no")


def robust_noise(floor: float = 0.5) -> Column:
    """max(floor, 1.4826 MAD of successive differences) of the levels in the array past; floor below 3 of them."""
    n = F.greatest(F.size("past") - 1, F.lit(0))
    diffs = F.zip_with(F.slice("past", F.lit(1), n), F.slice("past", F.lit(2), n), lambda a, b: b - a)
    mad = let(diffs, lambda ds: let(middle(ds), lambda m: middle(F.transform(ds, lambda d: F.abs(d - m)))))
    return F.when(F.size("past") >= 3, F.greatest(F.lit(floor), 1.4826 * mad)).otherwise(floor)


def motion(t: DataFrame, points: int = 5, keys: tuple[str, ...] = VEHICLE, far: Callable[[Column, Column, Column, Column], Column] | None = None) -> DataFrame:
    """Motion state, confidence and displacement from the coordinates (places: how many) among the last points, up to this one.

    far measures the displacement (haversine() by default). Only points of the epoch that was open before this one count: a point that opens an epoch is still seen with the one before it.
    """
    t = t if "epoch" in t.columns else epochs(t, keys)
    w = Window.partitionBy(*keys).orderBy("us", "seq")
    valid = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lng") == 0))
    t = t.withColumns({"_here": F.when(valid, F.struct("lat", "lng")), "_of": F.coalesce(F.lag("epoch").over(w), F.lit(0))})
    before = F.collect_list(F.when(valid, F.struct("lat", "lng", "epoch"))).over(w.rowsBetween(1 - points, -1))
    same = F.transform(F.filter("_before", lambda p: (p["epoch"] == F.col("_of")) & (F.col("_of") > 0)), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng")))
    t = t.withColumn("_before", before).withColumn("_c", F.array_compact(F.concat(same, F.array("_here")))).drop("_before", "_here", "_of")
    t = t.withColumns({"_n": F.size("_c"), "_mid": F.struct(F.aggregate("_c", F.lit(0.0), lambda a, p: a + p["lat"]).alias("lat"), F.aggregate("_c", F.lit(0.0), lambda a, p: a + p["lng"]).alias("lng"))})
    mid_lat, mid_lng = F.col("_mid.lat") / F.greatest("_n", F.lit(1)), F.col("_mid.lng") / F.greatest("_n", F.lit(1))
    first, last = F.get("_c", F.lit(0)), F.get("_c", F.col("_n") - 1)
    shift = F.when(F.col("_n") >= 2, (far or haversine)(first["lat"], first["lng"], last["lat"], last["lng"])).otherwise(0.0)
    radius = F.array_max(F.transform("_c", lambda p: haversine(p["lat"], p["lng"], mid_lat, mid_lng)))
    t = t.withColumns({"displacement": shift, "radius": F.coalesce(radius, F.lit(0.0))})
    low = (F.col("_n") >= 3) & (F.col("speed") <= 1) & (F.col("radius") <= 30)
    moving = (F.col("_n") >= 3) & (F.col("speed") > 5) & (F.col("displacement") >= 25)
    state = F.when(low, "LOW_MOTION").when(moving, "MOVING").otherwise("UNCERTAIN")
    sure = F.when(low | moving, F.least(F.lit(1.0), 0.65 + 0.1 * F.col("_n"))).when(F.col("_n") >= 3, 0.4).when(F.col("_n") == 2, 0.2).otherwise(0.0)
    return t.withColumns({"motion_state": state, "motion_confidence": sure, "places": F.col("_n")}).drop("_c", "_n", "_mid")


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere of 6 371 000 m."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return 6_371_000 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def library_haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """haversine() by the C library's functions, as the SQL takes them: those of the JVM differ in the last bit now and then."""

    @F.arrow_udf("double")
    def far(lat1: pa.Array, lng1: pa.Array, lat2: pa.Array, lng2: pa.Array) -> pa.Array:
        def metres(a: float, b: float, c: float, d: float) -> float:
            half = lambda x: math.pow(math.sin(math.radians(x) / 2), 2)
            h = half(c - a) + math.cos(math.radians(a)) * math.cos(math.radians(c)) * half(d - b)
            return 12_742_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

        ends = zip(*[x.to_pylist() for x in (lat1, lng1, lat2, lng2)], strict=True)
        return pa.array([None if None in e else metres(*e) for e in ends], pa.float64())

    return far(lat1, lng1, lat2, lng2)


def candidates(t: DataFrame, size: int = 12) -> DataFrame:
    """First position, by vehicle, of a U valley, of steady consumption and of plain noise in windows of size points."""
    w = by_vehicle()
    own = w.rowsBetween(0, size - 1)
    inner = w.rowsBetween(1, size - 1)
    t = t.withColumns({"pos": F.row_number().over(w) - 1, "step": F.abs(F.col("fuel") - F.lag("fuel").over(w))})
    t = t.withColumns({
        "_p": median("fuel", -3, -1), "_c": median("fuel", 0, 2), "_f": median("fuel", 3, 5), "_k": F.count("fuel").over(w.rowsBetween(3, 5)), "_b": F.count("fuel").over(w.rowsBetween(-3, -1)), "_n": F.count("fuel").over(own), "_end": F.last("fuel").over(own),
        "_fast": F.avg(F.when(F.col("speed") > 5, 1.0).otherwise(0.0)).over(own), "_calm": F.avg(F.when(F.col("step") <= 1.5, 1.0).otherwise(0.0)).over(inner), "_sd": F.stddev_samp("fuel").over(own),
    })
    valley = (F.col("_b") == 3) & (F.col("_k") == 3) & (F.col("_p") - F.col("_c") >= 8) & (F.abs(F.col("_f") - F.col("_p")) <= 3)
    full = F.col("_n") == size
    use = full & (F.col("_fast") >= 0.75) & (F.col("fuel") - F.col("_end") >= 8) & (F.col("_calm") >= 0.75)
    noise = full & (F.col("_sd") >= 3) & (F.abs(F.col("_end") - F.col("fuel")) <= 3)
    return t.groupBy("vehicle_id").agg(*[F.min(F.when(c, F.col("pos"))).cast("long").alias(n) for n, c in (("valley_pos", valley), ("consumption_pos", use), ("noise_pos", noise))])
