"""Filter quality, confusion matrices and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detrended_std(x: str, y: str) -> Column:
    """Population deviation of y around its least-squares line on x, in the same aggregation as other facts."""
    along = F.coalesce(F.try_divide(F.pow(F.covar_pop(x, y), 2), F.var_pop(x)), F.lit(0.0))
    return F.sqrt(F.greatest(F.var_pop(y) - along, F.lit(0.0)))


def curve_quality(t: DataFrame, raw: str = "fuel", clean: str = "clean") -> DataFrame:
    """Noise reduction, spike attenuation, level error, final lag and rises of a clean curve, by vehicle."""
    w = Window.partitionBy("vehicle_id").orderBy("us", "seq")
    t = t.withColumns({"pos": F.row_number().over(w) - 1, "rise": F.col(clean) - F.lag(clean).over(w)})
    span = lambda c: F.max(c) - F.min(c)
    at_end = lambda c: F.max_by(c, "pos")
    m = t.groupBy("vehicle_id").agg(
        F.greatest(F.lit(0.0), span(raw) - span(clean)).alias("spike_attenuation"), F.when(span(raw) <= 1, F.avg(F.abs(F.col(raw) - F.col(clean)))).alias("level_mae"), F.avg(F.abs("rise")).alias("mean_step"),
        F.when(F.min_by(raw, "pos") - at_end(raw) >= 2, F.greatest(at_end(clean) - at_end(raw), F.lit(0.0))).alias("final_lag"),
        F.sum(F.when((F.col("rise") > 0.01) & (F.col("speed") > 5), 1).otherwise(0)).alias("moving_rises"), detrended_std("pos", raw).alias("raw_std"), detrended_std("pos", clean).alias("clean_std"),
    )
    return m.withColumn("noise_reduction", F.when(F.col("raw_std") > 0, 100 * (1 - F.col("clean_std") / F.col("raw_std"))).otherwise(0.0))


def confusion(t: DataFrame, actual: str, predicted: str, by: str) -> DataFrame:
    """Counts of (actual, predicted) for each value of by and for all of them (by is null)."""
    pair = t.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return pair.groupingSets([[by, actual, predicted], [actual, predicted]], by, actual, predicted).agg(F.count("*").alias("n"))


def scores(matrix: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where a denominator is 0."""
    r = matrix.groupBy(F.col(actual).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    p = matrix.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("called"))
    j = r.join(p, "label", "full_outer").fillna(0)
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    j = j.withColumns({"precision": share(F.col("hit"), F.col("called")), "recall": share(F.col("hit"), F.col("support"))})
    return j.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def kalman_end(t: DataFrame, q: float = 0.5, r: float = 12.0, p0: float = 9.0) -> DataFrame:
    """Last estimate of a plain Kalman filter over each vehicle's valid levels, and how many there are.

    Gains follow from the number of a level alone, and what a level counts for shrinks with every gain after it: levels before the
    last few hundred weigh less than a double can tell. So each vehicle's last levels are enough, of which tasks send no
    more than those.
    """
    gains, variances, last = _gains(q, r, p0)
    valid = t.where("fuel > 0").select("vehicle_id", "us", "seq", "fuel")
    newest = Window.partitionBy("vehicle_id").orderBy(F.desc("us"), F.desc("seq"))
    few = valid.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= last)
    few = few.groupBy("vehicle_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("place"), "fuel"))).alias("v"))
    j = few.join(valid.groupBy("vehicle_id").agg(F.count("*").alias("n")), "vehicle_id")
    steady = len(gains)
    nth = lambda table, i: F.element_at(F.lit(table), F.least(i, F.lit(steady)).cast("int"))
    # a level's number among all is n + 1 + its (negative) place
    first = F.element_at("v", 1)["fuel"]
    estimate = F.aggregate(F.slice("v", 2, last), first, lambda x, e: x + nth(gains, F.col("n") + 1 + e["place"]) * (e["fuel"] - x))
    return j.select("vehicle_id", "n", estimate.alias("estimate"), nth(variances, F.col("n")).alias("variance"))


def _gains(q: float, r: float, p0: float) -> tuple[list[float], list[float], int]:
    """Gain and variance at the first, second, ... level until they stay, and how many levels weigh anything at the steady gain."""
    gains, variances = [1.0], [p0]
    while len(gains) < 10_000:
        gain = (variances[-1] + q) / (variances[-1] + q + r)
        gains.append(gain)
        variances.append((1 - gain) * (variances[-1] + q))
        if len(gains) > 2 and variances[-1] == variances[-2]:
            break
    return gains, variances, len(gains) + math.ceil(-40 / math.log(1 - gains[-1]))
