"""The replay report: golden segments through the tracking step, all metrics and nine behaviour checks of a segment in one aggregation."""

from __future__ import annotations

import math
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tankwise.operators import evaluation
from tankwise.operators.windows import rounded

# The checks that a segment may ask for; the first seven are limits.
AT_MOST = {"max_clean_span": "clean_range", "max_upward_step": "largest_rise", "max_final_lag_liters": "final_lag", "max_step_size": "largest_step"}
AT_LEAST = {"min_clean_liters": "least_clean", "min_valley_attenuation_liters": "valley", "min_total_clean_drop": "clean_drop"}
OTHERS = {"zero_dropout_indexes": "array<int>", "required_motion_states": "array<string>"}
CHECKS = [*AT_MOST, *AT_LEAST, *OTHERS]
SETTINGS = ", ".join([f"{n} double" for n in [*AT_MOST, *AT_LEAST]] + [f"{n} {kind}" for n, kind in OTHERS.items()])


def settings(checks: Column) -> Column:
    """The checks of a golden segment, whatever struct they were read as, with null for those it does not ask for."""
    return F.from_json(F.to_json(checks), SETTINGS)


def replayed(segments: DataFrame) -> DataFrame:
    """Points of files.read_segments() with the outputs of the tracking step, each segment with a fresh state."""
    points = segments.select(F.col("id").alias("vehicle_id"), F.lit(0).cast("long").alias("segment_id"), F.col("pos").cast("long").alias("seq"), F.unix_micros("time").alias("us"), "fuel", "speed", "lat", "lng", "capacity")
    out = evaluation.replay(points).select(F.col("vehicle_id").alias("id"), F.col("seq").cast("int").alias("pos"), "clean", "motion_state", "quality_flag")
    return segments.join(out, ["id", "pos"])


class Line:
    """Deviations of values y at places x, taken in one pass as they come: the operations of the SQL, so they agree to the last bit."""

    def __init__(self) -> None:
        self.n, self.x, self.y, self.xx, self.yy, self.xy = 0, 0.0, 0.0, 0.0, 0.0, 0.0

    def add(self, y: float, x: float) -> None:
        self.n += 1
        dx, dy = x - self.x, y - self.y
        self.x += dx / self.n
        self.y += dy / self.n
        self.xx += (x - self.x) * dx
        self.yy += (y - self.y) * dy
        self.xy += (y - self.y) * dx

    def deviation(self) -> float:
        """Population deviation; 0 below two values."""
        return math.sqrt(self.yy / self.n) if self.n > 1 else 0.0

    def around(self) -> float:
        """Population deviation around the least-squares line; 0 below three values."""
        if self.n < 3:
            return 0.0
        both = self.deviation() * math.sqrt(self.xx / self.n)
        along = self.xy / self.n / both if both else 0.0
        left = 1 - along * along
        return self.deviation() * math.sqrt(0.0 if left < 0 else left)


# What with_deviations() adds.
DEVIATIONS = ("raw_std", "clean_std", "raw_detrended_std", "clean_detrended_std")


def with_deviations(t: DataFrame, key: str) -> DataFrame:
    """t (key, pos, _raw, clean, _end: the last point of its key) with the deviations of _raw, of clean, and of both around their
    lines over the numbers of the points with _raw, at each last point, null at others. Points stream by; only sums are held.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws, cleans, pairs = Line(), Line(), Line()
        for batch in batches:
            found = []
            for raw, clean, end in zip(*[batch.column(n).to_pylist() for n in ("_raw", "clean", "_end")], strict=True):
                if raw is not None:
                    raws.add(raw, raws.n + 1.0)
                if clean is not None:
                    cleans.add(clean, 0.0)
                if raw is not None and clean is not None:
                    pairs.add(clean, float(raws.n))
                found.append((raws.deviation(), cleans.deviation(), raws.around(), pairs.around()) if end else (None,) * 4)
                if end:
                    raws, cleans, pairs = Line(), Line(), Line()
            added = [pa.array(list(c), pa.float64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.float64())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *DEVIATIONS])

    schema = t.schema
    for n in DEVIATIONS:
        schema = schema.add(n, "double")
    return t.repartition(key).sortWithinPartitions(key, "pos").mapInArrow(each, schema)


def segment_metrics(points: DataFrame, key: str = "id") -> DataFrame:
    """One row for each segment of points (key, pos, fuel, clean, expected, motion_state, quality_flag, review_status, checks as
    settings() gives them): metrics, the nine checks (null: not asked for), and how many were asked for and passed.
    """
    line = Window.partitionBy(key).orderBy("pos")
    level = F.when((F.col("fuel") > 0) & (F.col("fuel") < float("inf")), F.col("fuel"))
    t = points.select(key, "pos", "fuel", "clean", "expected", "motion_state", "quality_flag", "review_status", "checks", F.lag("clean").over(line).alias("_was"), level.alias("_raw"), F.lead("pos").over(line).isNull().alias("_end"))
    t = with_deviations(t, key).withColumns({"_rise": rounded(F.col("clean") - F.col("_was"), 6), "_valid": F.when(F.col("_raw").isNotNull(), F.col("clean"))})
    span = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    first, last = (lambda c: F.min_by(c, "pos")), (lambda c: F.max_by(c, "pos"))
    held = (F.col("quality_flag") == "ZERO_DROPOUT_HELD") & F.col("clean").eqNullSafe(F.col("_was"))
    lag = last("clean") - last("fuel")
    m = t.groupBy(key).agg(
        F.first("review_status").alias("review_status"), F.count("*").alias("points"), *[F.max(n).alias(n) for n in DEVIATIONS],
        span("_raw").alias("raw_range"), span("clean").alias("clean_range"), F.avg(F.abs(F.col("_valid") - F.col("_raw"))).alias("_mae"), F.when(first("fuel") - last("fuel") >= 2, F.greatest(lag, F.lit(0.0))).alias("downtrend_lag"),
        F.count_if((F.col("motion_state") == "MOVING") & (F.col("_rise") > 0.01)).alias("moving_upward_steps"), F.avg(F.abs(F.col("clean") - F.coalesce("expected", "clean"))).alias("regression_mae"),
        F.coalesce(F.max("_rise"), F.lit(0.0)).alias("largest_rise"), F.coalesce(F.max(F.abs("_rise")), F.lit(0.0)).alias("largest_step"), lag.alias("final_lag"), F.min("clean").alias("least_clean"), (F.min("clean") - F.min("fuel")).alias("valley"),
        (first("clean") - last("clean")).alias("clean_drop"), F.first("checks").alias("_asked"), F.count_if(held & F.array_contains("checks.zero_dropout_indexes", F.col("pos"))).alias("_held"), F.collect_set("motion_state").alias("_states"),
    )
    asked = F.col("_asked")
    checks = {n: rounded(c, 6) <= asked[n] for n, c in AT_MOST.items()} | {n: rounded(c, 6) >= asked[n] for n, c in AT_LEAST.items()}
    checks |= {"zero_dropout_indexes": F.col("_held") == F.size(F.array_distinct(asked["zero_dropout_indexes"])), "required_motion_states": F.size(F.array_except(asked["required_motion_states"], F.col("_states"))) == 0}
    m = m.withColumns({n: F.when(asked[n].isNotNull(), F.coalesce(c, F.lit(False))) for n, c in checks.items()})
    count = lambda c: sum((F.coalesce(c(F.col(n)).cast("long"), F.lit(0)) for n in CHECKS), F.lit(0).cast("long"))
    reduction = F.when(rounded("raw_detrended_std", 6) > 0, 100 * (1 - F.col("clean_detrended_std") / F.col("raw_detrended_std"))).otherwise(0.0)
    m = m.withColumns({
        "noise_reduction_percent": reduction, "spike_attenuation": F.greatest(F.lit(0.0), F.col("raw_range") - F.col("clean_range")), "stable_level_mae": F.when(F.col("raw_range") <= 1, F.col("_mae")),
        "checks_passed": count(lambda c: c), "checks_total": count(lambda c: c.isNotNull()),
    })
    places = {"noise_reduction_percent": 3, "raw_range": 3, "clean_range": 3, "spike_attenuation": 3, "downtrend_lag": 3} | dict.fromkeys(["raw_std", "clean_std", "raw_detrended_std", "clean_detrended_std", "stable_level_mae", "regression_mae"], 6)
    return m.select(key, "review_status", "points", *[(rounded(c, n) + F.lit(0.0)).alias(c) for c, n in places.items()], "moving_upward_steps", *CHECKS, "checks_passed", "checks_total")


def summary(metrics: DataFrame, durations: DataFrame, model_type: str = "fallback_rules") -> DataFrame:
    """One row: segments, points, approved and pending ones, checks passed and asked for, latency (durations: column ms) and model."""
    total = metrics.agg(F.count("*").alias("segments"), F.sum("points").alias("points"), F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_if(~F.col("review_status").eqNullSafe(F.lit("approved"))).alias("pending"), F.sum("checks_passed").alias("passed"), F.sum("checks_total").alias("total"))
    return total.crossJoin(evaluation.latency(durations)).withColumn("model_type", F.lit(model_type))  # one row each


class Latency(StreamingQueryListener):
    """Milliseconds a point of each batch of a streaming query, from its progress; add it by spark.streams.addListener."""

    def __init__(self) -> None:
        self.batches: list[tuple[float, int]] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            with self.lock:
                self.batches.append((float(p.batchDuration), int(p.numInputRows)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def durations(self, spark: SparkSession) -> DataFrame:
        """A row a point: the batch's milliseconds shared among its points."""
        with self.lock:
            rows = [(ms / n, n) for ms, n in self.batches]
        return spark.createDataFrame(rows, "ms double, n int").select(F.explode(F.array_repeat("ms", F.col("n"))).alias("ms"))


def write(metrics: DataFrame, totals: DataFrame, path: str, key: str = "id") -> None:
    """The report in three forms, a row a segment: metrics as JSON (totals and segments), segments as CSV, and a text."""
    rows = metrics.orderBy(key)
    segments = rows.agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in metrics.columns if c != key]))).alias("segment_metrics"))
    totals.crossJoin(segments).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")  # one row each
    rows.select([c for c in metrics.columns if c not in CHECKS]).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/segments")
    head = totals.select(F.explode(F.array(
        F.lit("Replay report"), F.format_string("segments: %d (%d approved, %d pending), points: %d", "segments", "approved", "pending", "points"), F.format_string("checks passed: %d of %d", "passed", "total"),
        F.format_string("latency P50, P95, P99: %.6f, %.6f, %.6f ms; %.3f points a second", "p50_ms", "p95_ms", "p99_ms", "points_per_second"), F.concat(F.lit("model: "), F.col("model_type")), F.lit("segment | review | noise reduction | regression error | checks"),
    )).alias("value")).select(F.lit(0).alias("part"), F.monotonically_increasing_id().alias("place"), "value")
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in CHECKS])), ", ")
    text = F.format_string("%s | %s | %.3f %% | %.6f l | %d of %d%s", key, F.coalesce("review_status", F.lit("-")), "noise_reduction_percent", F.coalesce("regression_mae", F.lit(0.0)), "checks_passed", "checks_total", F.when(failed != "", F.concat(F.lit("; failed: "), failed)).otherwise(""))
    body = rows.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(key)).cast("long").alias("place"), text.alias("value"))
    head.unionByName(body).orderBy("part", "place").select("value").coalesce(1).write.mode("overwrite").text(f"{path}/report")
