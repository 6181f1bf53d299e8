"""Vehicle profile and the ordered heuristic labeller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import by_vehicle, haversine, look_around, near_levels, offline_gap, rolling_std, steps


def profile(t: DataFrame) -> DataFrame:
    """Capacity (P99.5 of positive levels), noise sigma and the flat, spike and event thresholds of each vehicle."""
    d = t.select("vehicle_id", "fuel", F.abs(F.col("fuel") - F.lag("fuel").over(by_vehicle())).alias("d"))
    positive = F.when(F.col("fuel") > 0, F.col("fuel"))
    first = d.groupBy("vehicle_id").agg(F.percentile(positive, 0.995).alias("cap"), F.max("fuel").alias("top"), F.percentile("d", 0.6).alias("cut"))
    small = d.join(first.select("vehicle_id", "cut"), "vehicle_id").where("d <= cut").groupBy("vehicle_id").agg((1.4826 * F.percentile("d", 0.5)).alias("s"))
    p = first.join(small, "vehicle_id", "left").withColumn("capacity", F.coalesce("cap", F.when(F.col("top") > 0, F.col("top")), F.lit(200.0)))
    p = p.withColumn("sigma", F.when(F.col("s") > 0, F.col("s")).otherwise(F.greatest(F.lit(0.5), 0.002 * F.col("capacity"))))
    return _thresholds(p).select("vehicle_id", "capacity", "sigma", "flat", "spike", "event")


def with_profile(t: DataFrame) -> DataFrame:
    """steps(t) with the columns of profile, by windows over the vehicle: no exchange besides that of the steps."""
    whole = Window.partitionBy("vehicle_id")
    positive = F.when(F.col("fuel") > 0, F.col("fuel"))
    t = t.withColumns({"capacity": F.coalesce(F.percentile(positive, 0.995).over(whole), F.lit(200.0)), "cut": F.percentile("abs_delta", 0.6).over(whole)})
    small = F.when(F.col("abs_delta") <= F.col("cut"), F.col("abs_delta"))
    t = t.withColumn("small", 1.4826 * F.percentile(small, 0.5).over(whole))
    return _thresholds(t.withColumn("sigma", F.when(F.col("small") > 0, F.col("small")).otherwise(F.greatest(F.lit(0.5), 0.002 * F.col("capacity"))))).drop("cut", "small")


def _thresholds(t: DataFrame) -> DataFrame:
    of = lambda floor, share, times: F.greatest(F.lit(floor), share * F.col("capacity"), times * F.col("sigma"))
    return t.withColumns({"flat": of(0.5, 0.003, 2.0), "spike": of(2.0, 0.012, 4.0), "event": of(5.0, 0.035, 8.0)})


def featured(t: DataFrame) -> DataFrame:
    """Points with steps, profile and look-around features: all windows by vehicle, so one exchange and one sort."""
    x = near_levels(with_profile(steps(t)).withColumn("std12", rolling_std(per_segment=False)))
    w = by_vehicle()
    far = F.coalesce(haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")), F.lit(0.0))
    x = x.withColumns({"gap0": offline_gap(), "distance": far, "prev2_fuel": F.coalesce(F.get("near", F.lit(2)), F.get("near", F.lit(3)), F.col("fuel"))})
    gps = F.when(F.col("gap0") > 0, F.col("distance") / 1000 / (F.col("gap0") / 60)).otherwise(0.0)
    return look_around(x.withColumn("gps_speed", gps).withColumn("motion_speed", F.greatest("speed", "gps_speed"))).withColumn("prev_delta", F.coalesce(F.lag("delta").over(w), F.lit(0.0)))


def labelled(t: DataFrame) -> DataFrame:
    """Each point with its signal label: the first rule that holds, merged to five classes (null: none)."""
    c = F.col
    x, d = featured(t), c("delta0")
    low = F.greatest(F.lit(5.0), 0.03 * c("capacity"))
    near = F.greatest(c("flat"), 0.25 * F.abs(d))
    returns, holds = F.abs(c("next3") - c("prev_fuel")) <= near, F.abs(c("next5") - c("fuel")) <= near
    band = F.greatest(1.75 * c("flat"), 2 * c("sigma"), F.lit(0.8))
    wild = (
        (c("std12") > F.greatest(c("spike"), 2.2 * c("flat"), 4 * c("sigma"))) | ((c("local_range") >= c("event")) & (c("sign_changes") >= 2))
        | ((c("local_range") >= F.greatest(1.4 * c("spike"), 4 * c("flat"))) & (c("std12") > 2 * c("flat")))
    )
    recovers = (c("prev_delta") <= -c("spike")) & (d >= c("spike")) & (F.abs(c("fuel") - c("prev2_fuel")) <= F.greatest(2 * c("flat"), 0.35 * F.abs("prev_delta")))
    alone = (F.abs(d) >= c("spike")) & returns
    bump = (
        (c("range_m2p5") >= F.greatest(0.6 * c("event"), 1.2 * c("spike"), 4 * c("flat"))) & (c("return_level") <= F.greatest(2.5 * c("flat"), 0.3 * c("range_m2p5")))
        & (F.abs(c("fuel") - c("prev3")) >= F.greatest(0.8 * c("spike"), 3 * c("flat"))) & (F.abs(d) < F.greatest(1.25 * c("event"), c("range_m2p5")))
    )
    rule = (
        F.when(c("fuel") <= 0, "INVALID").when((c("prev_fuel") <= low) & (d >= c("event")), "UNKNOWN").when((c("fuel") <= low) & (c("prev_fuel") > F.greatest(F.lit(30.0), 0.2 * c("capacity"))), "DROPOUT")
        .when(bump & (c("fuel") > c("prev3")), "TRANSIENT_UP_NOISE").when(bump & (c("fuel") < c("prev3")), "TRANSIENT_DOWN_NOISE").when(recovers | alone, "SPIKE")
        .when((d >= c("event")) & holds, "REFUEL").when((d <= -c("event")) & holds & (c("fuel") > low), "DRAIN").when(wild & (F.abs(d) < c("event")), "SLOSHING_NOISE")
        .when((d < -0.5 * c("flat")) & (c("motion_speed") > 3) & (F.abs(d) < c("event")), "CONSUMPTION")
        .when((F.abs(d) <= band) & (c("std12") <= F.greatest(2 * band, 3 * c("sigma"))), "STABLE_JITTER").otherwise("UNKNOWN")
    )
    merged = F.create_map(*[F.lit(v) for kv in MERGED.items() for v in kv])
    return x.withColumn("rule", rule).withColumn("label", F.element_at(merged, F.col("rule")))


# Rules merged to the classes that are trained and compared; other rules have no class.
MERGED = {
    "REFUEL": "UPWARD_SHIFT",
    "DRAIN": "DOWNWARD_SHIFT",
    "CONSUMPTION": "GRADUAL_CHANGE",
    "STABLE_JITTER": "STABLE_JITTER",
    "NORMAL": "STABLE_JITTER",
} | dict.fromkeys(["SLOSHING_NOISE", "SPIKE", "DROPOUT", "TRANSIENT_UP_NOISE", "TRANSIENT_DOWN_NOISE", "TRANSIENT_NOISE", "TRANSIENT_CLUSTER_NOISE"], "OSCILLATION_NOISE")


def balanced(t: DataFrame, label: str, limit: int, capped: list[str] | None = None, rare: list[str] | None = None, least: int = 0) -> DataFrame:
    """At most limit rows of each label (or of the capped ones alone), by a hash of the row's identity, with their copy number; the
    rare labels' rows are repeated, the first by that hash once more than the others, until there are least of them.

    Counts of the labels' hashes by their first digits tell from which on none is among the limit, so that only rows up to there, and
    a few more, are sorted by label; all others are dealt by their hash.
    """
    digest = F.md5(F.concat_ws("|", "vehicle_id", F.col("seq").cast("string")))
    head = F.substring("_digest", 1, HEAD)
    t = t.where(F.col(label).isNotNull()).withColumn("_digest", digest)
    heads = t.groupBy(F.col(label).alias("_of"), head.alias("_head")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_of").orderBy("_head"))
    bounds = heads.withColumn("_upto", upto).groupBy("_of").agg(F.sum("_n").alias("_size"), F.min(F.when(F.col("_upto") >= limit, F.col("_head"))).alias("_last"))
    cap = F.lit(True) if capped is None else F.col(label).isin(capped)
    j = t.join(F.broadcast(bounds), F.col(label) == F.col("_of")).where(~cap | F.col("_last").isNull() | (head <= F.col("_last")))
    size = F.when(cap, F.least("_size", F.lit(limit))).otherwise(F.col("_size"))
    repeated = F.col(label).isin(rare or []) & (size < least)
    few = repeated | (cap & (F.col("_size") > limit))  # at most limit and those of the last head, or fewer than least
    dealt = F.when(few, F.lit("")).otherwise(head)
    j = j.withColumns({"_few": few, "_rn": F.row_number().over(Window.partitionBy(label, dealt).orderBy("_digest", "us"))})
    j = j.where(~(cap & F.col("_few")) | (F.col("_rn") <= limit)).withColumn("_s", size)
    times = F.when(repeated, F.floor(F.lit(least) / F.col("_s")) + (F.col("_rn") <= F.lit(least) % F.col("_s")).cast("int")).otherwise(1)
    return j.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).drop("_digest", "_of", "_size", "_last", "_few", "_rn", "_s")


#: Hexadecimal digits of the hash by which the rows of a label are counted: 4096 counts.
HEAD = 3
