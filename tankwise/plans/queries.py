"""One query for each operator of the telemetry engine; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankwise.operators import profile as P
from tankwise.operators import quality as Q
from tankwise.operators import serving as S
from tankwise.operators import tracking as T
from tankwise.operators import windows as W
from tankwise.sources.adapter import DENSE, GAPPY, table, telemetry, vehicles

KEY = ["vehicle_id", "seq"]
r6 = W.r6


def _r4(c: str | F.Column) -> F.Column:
    return W.rounded(c, 4) + F.lit(0.0)


def segment_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.steps(telemetry(spark, sf_dir, GAPPY)).withColumn("rolling", W.rolling_std())
    return t.groupBy("vehicle_id", "segment_id").agg(F.count("*").alias("points"), _r4(F.avg("rolling")).alias("mean_rolling_std"), _r4(F.max("rolling")).alias("max_rolling_std"))


def telemetry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir)


def point_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.steps(telemetry(spark, sf_dir, GAPPY)).withColumn("gap_us", F.col("us") - F.lag("us").over(W.by_vehicle()))
    return t.select(*KEY, "gap_us", F.when(W.offline_gap() > 0, F.col("gap_us")).otherwise(0).alias("offline_gap_us"), r6("delta").alias("delta"), r6("abs_delta").alias("abs_delta"), "segment_id")


def trend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("net", "variation", "directionality", "window_std", "window_range")
    return W.trend_window(telemetry(spark, sf_dir, GAPPY)).select(*KEY, "epoch", *[r6(c).alias(c) for c in columns], "directional_down")


def online_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.online_deviation(telemetry(spark, sf_dir, GAPPY)).select(*KEY, "epoch", r6("online_std").alias("online_std"))


def look_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("prev3", "next3", "next5", "range_pm3", "range_m2p5", "return_level", "transient_score")
    return P.featured(telemetry(spark, sf_dir)).select(*KEY, *[r6(c).alias(c) for c in columns], F.col("sign_changes").cast("long").alias("sign_changes"), "is_peak", "is_valley")


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.by_vehicle()
    return telemetry(spark, sf_dir).select(*KEY, r6(F.avg("fuel").over(w.rowsBetween(-7, 0))).alias("ma8"), r6(W.median("fuel", -2, 0)).alias("median3"), r6(W.spread("fuel", -4, 0)).alias("range5"), r6(W.spread("fuel", -6, 0)).alias("range7"))


def gap_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.steps(telemetry(spark, sf_dir)).withColumn("m", W.median("gap_min", -19, 0))
    limit = F.greatest(3 * F.col("m"), F.lit(5.0))
    return t.select(*KEY, r6(limit).alias("threshold"), F.coalesce((F.col("gap_min") > limit) & (F.col("speed") > 5), F.lit(False)).alias("suspicious"))


def acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Window.partitionBy("vehicle_id", "segment_id").orderBy("us", "seq")
    gap = F.greatest((F.col("us") - F.lag("us").over(g)) / 60_000_000, F.lit(1.0))
    by = (F.col("speed") - F.lag("speed").over(g)) / 3.6 / (gap * 60)
    return W.steps(telemetry(spark, sf_dir, GAPPY)).select(*KEY, r6(by).alias("acceleration"))


def robust_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.valid_history(telemetry(spark, sf_dir, GAPPY), 12).select(*KEY, r6(W.robust_noise()).alias("noise"))


def golden_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.candidates(telemetry(spark, sf_dir))


def vehicle_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.profile(telemetry(spark, sf_dir)).select("vehicle_id", *[(W.rounded(c, 9) + F.lit(0.0)).alias(c) for c in ("capacity", "sigma", "flat", "spike", "event")])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("abs_delta") <= 1, "STABLE_JITTER").when(F.col("delta") > 10, "UPWARD_SHIFT").when(F.col("delta") < -10, "DOWNWARD_SHIFT").when((F.col("delta") < 0) & (F.col("speed") > 5), "GRADUAL_CHANGE").otherwise("OSCILLATION_NOISE")
    return P.labelled(telemetry(spark, sf_dir)).withColumn("guess", guess)


def heuristic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select(*KEY, "rule", "label")


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.confusion(_labelled(spark, sf_dir), "label", "guess", "vehicle_id")


def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Q.confusion(_labelled(spark, sf_dir), "label", "guess", "vehicle_id").where("vehicle_id is null")
    return Q.scores(m, "label", "guess").select("label", "support", "called", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.balanced(_labelled(spark, sf_dir), "label", 300, capped=["STABLE_JITTER"], rare=["UPWARD_SHIFT", "DOWNWARD_SHIFT"], least=150)
    return t.select(*KEY, "label", "copy")


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _labelled(spark, sf_dir).withColumn("was", F.lag("label").over(W.by_vehicle()))
    return t.where("was is not null and label is not null").groupBy("was", "label").agg(F.count("*").alias("n"))


def curve_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumn("clean", F.avg("fuel").over(W.by_vehicle().rowsBetween(-7, 0)))
    return Q.curve_quality(t).select("vehicle_id", *[_r4(c).alias(c) for c in ("spike_attenuation", "level_mae", "mean_step", "final_lag", "noise_reduction")], "moving_rises")


def kalman_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.kalman_end(telemetry(spark, sf_dir)).select("vehicle_id", "n", r6("estimate").alias("estimate"), r6("variance").alias("variance"))


def latest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest(telemetry(spark, sf_dir), 5).select("vehicle_id", "seq", "us", "fuel", F.col("place").cast("long").alias("place"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.history(telemetry(spark, sf_dir), "v0000", 1704067200000000, 1704999999000000, 200).select("vehicle_id", "seq", "us", "fuel")


def fleet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fleet(telemetry(spark, sf_dir))


def capacity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("seq") % 3 == 0, 400.0).otherwise(0.0)
    return S.resolve_capacity(telemetry(spark, sf_dir), vehicles(spark, sf_dir), asked).select(*KEY, "capacity", "capacity_source")


def fleet_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = telemetry(spark, sf_dir).join(vehicles(spark, sf_dir), "vehicle_id").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("points"), F.countDistinct("vehicle_id").alias("vehicles"))


def downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.downsample(telemetry(spark, sf_dir), 20).select("vehicle_id", "seq", "us", "fuel")


def vehicle_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = telemetry(spark, sf_dir).select("vehicle_id", F.when(F.col("fuel") > 420, F.col("fuel")).alias("capacity_liters"))
    return S.upsert(vehicles(spark, sf_dir), seen)


def export_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumn("noise", F.abs(F.col("fuel") - F.avg("fuel").over(W.by_vehicle().rowsBetween(-7, 0))))
    return t.select(*KEY, (W.rounded("noise", 5) + F.lit(0.0)).alias("noise"), S.noise_band(F.col("noise")).alias("band"), S.speed_band(F.col("speed")).alias("speed_band"), (F.col("speed") <= 0.5).cast("int").alias("is_stopped"))


def motion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.motion(telemetry(spark, sf_dir, GAPPY)).select(*KEY, (W.rounded("displacement", 3) + F.lit(0.0)).alias("displacement"), "motion_state")


def smooth_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.lit(0.0)
    t = S.resolve_capacity(telemetry(spark, sf_dir, DENSE, whole=True), vehicles(spark, sf_dir, whole=True), asked).select("vehicle_id", "seq", "us", "fuel", "speed", "lat", "lng", "capacity")
    return T.track(t)


QUERIES = {f.__name__: f for f in (
    segment_noise, telemetry_points, point_steps, trend_window, online_deviation, look_around, moving_average, gap_threshold, acceleration, robust_noise, golden_candidates, vehicle_profile, heuristic_labels, label_counts, confusion, label_scores, balanced_sample,
    state_transitions, curve_quality, kalman_end, latest_points, history, fleet_status, capacity_resolution, fleet_by_region, downsampled, vehicle_upsert, export_bands, motion_states, smooth_tracking,
)}
