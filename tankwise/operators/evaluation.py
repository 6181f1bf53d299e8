"""Replay of segments and how well the clean curves do: scores, regression against expected curves, checks, report."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankwise.operators import forest, tracking
from tankwise.operators.quality import scores
from tankwise.operators.windows import rounded


SEGMENT = ("vehicle_id", "segment_id")


def replay(t: DataFrame) -> DataFrame:
    """The tracking step over each segment (vehicle_id, segment_id) with a fresh state, with the rolling deviations of the clean
    curve and of the levels in the segment. The column label, if t has it, gives the states.
    """
    out = tracking.track_segments(t)
    twelve = Window.partitionBy(*SEGMENT).orderBy("us", "seq").rowsBetween(-11, 0)
    deviation = lambda c: F.when(F.count(c).over(twelve) >= 2, F.stddev_pop(c).over(twelve)).otherwise(0.0)
    return out.withColumns({"clean_std": deviation("clean"), "rolling_std": deviation("raw")})


def replay_predicted(model: PipelineModel | None, t: DataFrame) -> DataFrame:
    """Each segment as a dashboard shows it: the model's states of its points, from its own past only, then the tracking step that
    takes them as labels, both with a fresh state. Labels that t has are not looked at.
    """
    predicted = forest.predict_causal(model, t.drop("label"), SEGMENT)
    return replay(predicted.withColumnRenamed("state", "label"))


def regression(actual: DataFrame, expected: DataFrame, key: list[str], a: str, e: str) -> DataFrame:
    """Mean absolute difference of two curves joined by key (the last of its columns is the position), and how many points lack one."""
    j = actual.select(*key, F.col(a).alias("a")).join(expected.select(*key, F.col(e).alias("e")), key, "full_outer")
    return j.groupBy(*key[:-1]).agg(F.avg(F.abs(F.col("a") - F.col("e"))).alias("regression_mae"), F.sum((F.col("a").isNull() | F.col("e").isNull()).cast("long")).alias("unmatched"))


def provenance(segments: DataFrame, source: DataFrame) -> DataFrame:
    """Whether each segment (id, pos, first_row, time, fuel, speed) still equals its rows (row, time, fuel, speed) of the source."""
    of = source.select(F.col("row").alias("s_row"), F.col("time").alias("s_time"), rounded("fuel", 2).alias("s_fuel"), rounded(F.coalesce("speed", F.lit(0.0)), 2).alias("s_speed"))
    j = segments.join(of, F.col("first_row") + F.col("pos") == F.col("s_row"), "left")
    same = F.col("time").eqNullSafe(F.col("s_time")) & (F.col("fuel") == F.col("s_fuel")) & (F.col("speed") == F.col("s_speed"))
    return j.groupBy("id").agg(F.count("*").alias("points"), F.sum(F.coalesce(same, F.lit(False)).cast("long")).alias("same"))


def score_report(matrix: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Scores of each label and of all: accuracy, mean over labels (macro) and mean by support (weighted)."""
    by_label = scores(matrix, actual, predicted)
    total = F.sum("support")
    accuracy = F.coalesce(F.try_divide(F.sum("hit"), total), F.lit(0.0))
    names = ("precision", "recall", "f1")
    wholes = by_label.agg(
        F.struct(F.lit("accuracy").alias("label"), total.alias("support"), *[accuracy.alias(n) for n in names]).alias("x"),
        F.struct(F.lit("macro avg").alias("label"), total.alias("support"), *[F.avg(n).alias(n) for n in names]).alias("y"),
        F.struct(F.lit("weighted avg").alias("label"), total.alias("support"), *[F.coalesce(F.try_divide(F.sum(F.col(n) * F.col("support")), total), F.lit(0.0)).alias(n) for n in names]).alias("z"),
    )
    rows = wholes.select(F.explode(F.array("x", "y", "z")).alias("r")).select("r.*")
    return by_label.select("label", "support", *names).unionByName(rows)


def fleet_summary(t: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """Rows, labelled rows, accuracy and the count of each label, by vehicle."""
    hit = F.avg(F.when(F.col(actual).isNotNull(), (F.col(actual) == F.col(predicted)).cast("double")))
    counts = [F.count(F.when(F.col(actual) == n, 1)).alias(n.lower()) for n in labels]
    return t.groupBy("vehicle_id").agg(F.count("*").alias("total_rows"), F.count(actual).alias("valid_rows"), F.coalesce(hit, F.lit(0.0)).alias("accuracy"), *counts)


def scoped_matrix(t: DataFrame, actual: str, predicted: str, held_out: Column) -> DataFrame:
    """Sums of the matrices of held-out vehicles and of all."""
    pair = t.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    scope = F.explode(F.when(held_out, F.array(F.lit("held_out"), F.lit("all"))).otherwise(F.array(F.lit("all"))))
    return pair.withColumn("scope", scope).groupBy("scope", actual, predicted).agg(F.count("*").alias("n"))


def latency(durations: DataFrame, ms: str = "ms") -> DataFrame:
    """P50, P95 and P99 of the durations of single points, and points a second."""
    p = F.percentile(ms, [0.5, 0.95, 0.99])
    rate = F.coalesce(F.try_divide(1000.0 * F.count(ms), F.sum(ms)), F.lit(0.0))
    return durations.agg(p.alias("p"), rate.alias("points_per_second")).select(*[F.col("p")[i].alias(f"p{n}_ms") for i, n in enumerate((50, 95, 99))], "points_per_second")


def held_at(outputs: DataFrame, positions: DataFrame) -> DataFrame:
    """Whether a vehicle's curve is held as a dropout, at the level before, at each of its positions (vehicle_id, pos)."""
    w = Window.partitionBy("vehicle_id").orderBy("us", "seq")
    o = outputs.withColumns({"pos": F.row_number().over(w) - 1, "was": F.lag("clean").over(w)})
    j = positions.join(o, ["vehicle_id", "pos"], "left")
    held = F.coalesce((F.col("quality_flag") == "ZERO_DROPOUT_HELD") & F.col("clean").eqNullSafe(F.col("was")), F.lit(False))
    return j.groupBy("vehicle_id").agg(F.min(held).alias("zero_dropout_indexes"))


def has_states(outputs: DataFrame, required: list[str]) -> DataFrame:
    """Whether all required motion states occur in a vehicle's outputs."""
    lacks = F.array_except(F.array(*[F.lit(s) for s in required]), F.collect_set("motion_state"))
    return outputs.groupBy("vehicle_id").agg((F.size(lacks) == 0).alias("required_motion_states"))


def write_report(summary: DataFrame, path: str) -> None:
    """The report as one JSON document a row, small by its nature (a row a segment)."""
    summary.coalesce(1).write.mode("overwrite").json(path)
