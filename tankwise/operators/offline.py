"""Filters that look ahead or follow labels by fixed shares, as documented for offline use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankwise.operators.tracking import by_vehicle_in_order
from tankwise.operators.windows import by_vehicle, middle

MINUTE = 60_000_000


def fill_dropouts(t: DataFrame, drop: float = 6.0, back: float = 5.0, most_minutes: int = 360) -> DataFrame:
    """Each point with cleaned and dropout: null, SPIKE (one point) or SENSOR_DROPOUT (more).

    A point that falls by drop or more opens a dropout if within six hours a level returns to within back of the level before; until
    then levels are on the straight line between both in time. Of dropouts that overlap the first counts. Openings are few, so they
    are found first, and only they look for their end, in the slots of time that six hours can reach.
    """
    w = by_vehicle()
    t = t.withColumns({"before": F.lag("fuel").over(w), "before_us": F.lag("us").over(w), "place": F.struct("us", "seq")})
    opens = (F.col("before") - F.col("fuel") >= drop) & (F.col("fuel") < F.col("before") - back)
    t = t.withColumn("opens", F.coalesce(opens, F.lit(False)))
    span = most_minutes * MINUTE
    slot = lambda us: F.floor(us / F.lit(span)).cast("long")
    asked = t.where("opens").select("vehicle_id", F.col("place").alias("o"), F.col("before").alias("b"), F.explode(F.array(slot(F.col("us")), slot(F.col("us")) + 1)).alias("slot")).distinct()
    seen = t.select("vehicle_id", F.col("place").alias("p"), "fuel", slot(F.col("us")).alias("slot"))
    later = asked.join(seen, ["vehicle_id", "slot"]).where((F.col("p") > F.col("o")) & (F.col("p.us") <= F.col("o.us") + span) & F.col("fuel").between(F.col("b") - back, F.col("b") + back))
    ends = later.groupBy("vehicle_id", "o").agg(F.min(F.struct(F.col("p.us").alias("us"), F.col("p.seq").alias("seq"), "fuel")).alias("end"))
    t = t.join(ends.withColumnRenamed("o", "place"), ["vehicle_id", "place"], "left").withColumn("end", F.when(F.col("opens"), F.col("end")))
    # an opening inside an earlier dropout that has ended by its end does not count
    open_until = F.max(F.when(F.col("end").isNotNull(), F.col("end.us"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("real", F.col("end").isNotNull() & F.coalesce(F.col("us") >= open_until, F.lit(True)))
    span = F.when(F.col("real"), F.struct("us", "seq", F.col("before").alias("a"), F.col("before_us").alias("a_us"), F.col("end").alias("e")))
    t = t.withColumn("s", F.last(span, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.coalesce(F.col("place") < F.struct("s.e.us", "s.e.seq"), F.lit(False))
    ratio = (F.col("us") - F.col("s.a_us")) / (F.col("s.e.us") - F.col("s.a_us"))
    cleaned = F.when(inside, F.col("s.a") + ratio * (F.col("s.e.fuel") - F.col("s.a"))).otherwise(F.col("fuel"))
    t = t.withColumns({"cleaned": cleaned, "start": F.when(inside, F.struct("s.us", "s.seq"))})
    n = F.count("start").over(Window.partitionBy("vehicle_id", "start"))
    return t.withColumn("dropout", F.when(F.col("start").isNotNull(), F.when(n == 1, "SPIKE").otherwise("SENSOR_DROPOUT"))).drop("before", "before_us", "place", "opens", "end", "real", "s", "start")


# The share of the way to the measurement by label; rises during consumption are not followed.
ALPHA = {"SPIKE": 0.0, "TRANSIENT_UP_NOISE": 0.0, "TRANSIENT_DOWN_NOISE": 0.0, "STABLE_JITTER": 0.12, "SLOSHING_NOISE": 0.08, "CONSUMPTION": 0.58, "REFUEL": 1.0}
DRAIN_ALPHA, DRAIN_STEP, DRAIN_MOST, OTHER_ALPHA = 0.45, 0.235, 0.92, 0.25


def _follow(s: dict, point: tuple) -> dict:
    vehicle_id, seq, us, fuel, rule = point
    s["falls"] = s["falls"] + 1 if rule == "DRAIN" else 0
    if s["x"] is None:
        s["x"] = fuel if fuel is not None and fuel > 0 else None
    elif fuel is not None and fuel > 0:
        a = min(DRAIN_MOST, DRAIN_ALPHA + DRAIN_STEP * (s["falls"] - 1)) if rule == "DRAIN" else ALPHA.get(rule, OTHER_ALPHA)
        s["x"] += 0.0 if rule == "CONSUMPTION" and fuel > s["x"] else a * (fuel - s["x"])
    return {"vehicle_id": vehicle_id, "seq": seq, "us": us, "followed": s["x"]}


def follow_labels(t: DataFrame) -> DataFrame:
    """A filter that goes a share of the way to each level above zero, by rule; a drain is followed faster while it lasts."""
    return by_vehicle_in_order(t, ("vehicle_id", "seq", "us", "fuel", "rule"), lambda: {"x": None, "falls": 0}, _follow, "vehicle_id string, seq long, us long, followed double")


def flatten_bumps(t: DataFrame, spike: float = 2.0, flat: float = 1.0, least: int = 3, most: int = 12) -> DataFrame:
    """Each point with shape_clean: a level away from the median of the points before (twice most and one, so that a bump cannot
    carry it) that comes back to it, for two points in a row, least to most points later becomes that median.
    """
    w = by_vehicle()
    t = t.withColumns({"base": middle(F.collect_list("fuel").over(w.rowsBetween(-2 * most - 1, -1))), "ahead": F.collect_list("fuel").over(w.rowsBetween(1, most + 1))})
    near = lambda x: F.abs(x - F.col("base")) <= flat
    back = F.exists(F.sequence(F.lit(least - 1), F.lit(most - 1)), lambda i: F.coalesce(near(F.get("ahead", i)) & near(F.get("ahead", i + 1)), F.lit(False)))
    bump = (F.abs(F.col("fuel") - F.col("base")) >= spike) & back
    return t.withColumn("shape_clean", F.when(F.coalesce(bump, F.lit(False)), F.col("base")).otherwise(F.col("fuel"))).drop("base", "ahead")
