"""The service path as one stream: messages, vehicle defaults, capacity, states of a model, tracking, and sinks that write once.

Two stateful operators stand in a row, in append mode: one keeps what the features of a point need, the model looks at its
rows, and the tracking step takes the model's states as labels. A reset row clears both in order. The first is a stateful
processor, which needs Spark's RocksDB state store; clean_stream() sets that where the session still has the default.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tankwise.operators import feature_vector as V28
from tankwise.operators import forest, serving, tracking
from tankwise.streaming.tracking import _versions, track_stream

#: Flags of points at which the level has moved to another one.
SHIFTS = {"UPWARD_SHIFT_TRACKED": "UPWARD_SHIFT", "DOWNWARD_SHIFT_TRACKED": "DOWNWARD_SHIFT"}


def with_defaults(points: DataFrame, vehicle_id: str) -> DataFrame:
    """Points without a vehicle are those of vehicle_id; points without a number or kind get 0 and 'point'."""
    named = F.coalesce(F.nullif(F.trim("vehicle_id"), F.lit("")), F.lit(vehicle_id))
    own = {"seq": F.lit(0).cast("long"), "kind": F.lit("point")}
    more = {c: F.coalesce(c, v) if c in points.columns else v for c, v in own.items()}
    return points.withColumns({"vehicle_id": named} | more)


def with_capacity(points: DataFrame, vehicles: DataFrame, requested: str = "capacity") -> DataFrame:
    """capacity and capacity_source of each point by the static table of vehicles, else what the point asks for, else none."""
    asked = F.col("_asked")
    points = points.withColumnRenamed(requested, "_asked") if requested in points.columns else points.withColumn("_asked", F.lit(None).cast("double"))
    return serving.resolve_capacity(points, vehicles, asked).drop("_asked", "capacity_liters")


class Features(StatefulProcessor):
    """feature_vector.step() over the points of a vehicle; its state is one JSON document."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.held = handle.getValueState("features", "doc string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = json.loads(self.held.get()[0]) if self.held.exists() else V28.fresh()
        points = [r for b in rows for r in b.astype(object).where(b.notna(), None).to_dict("records")]
        made = []
        for r in sorted(points, key=lambda r: (r["us"], r["seq"])):
            if r["kind"] == "reset":
                state = V28.fresh()
                made.append(dict.fromkeys(V28.STEP_INPUT) | {c: r[c] for c in ("vehicle_id", "seq", "us")} | {"kind": "reset", "known": None, "falling": 0} | dict.fromkeys([V28.IN + n for n in V28.NAMES], 0.0))
            else:
                made.append(V28.step(state, tuple(r[c] for c in V28.STEP_INPUT)))
        self.held.update((json.dumps(state),))
        if made:
            yield pd.DataFrame(made).astype({c: "float64" for c in ("fuel", "speed", "capacity", "lat", "lng")})

    def close(self) -> None:
        pass


def featured(points: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Each point with its causal features (columns), stateful; a reset goes on as a row of kind 'reset'."""
    keyed = points.select(*V28.STEP_INPUT, "kind").groupBy("vehicle_id")
    return keyed.transformWithStateInPandas(Features(ttl_ms), V28.STEP_OUT, "Append", "ProcessingTime" if ttl_ms else "None")


def predicted(model: PipelineModel | None, points: DataFrame) -> DataFrame:
    """featured() rows with label: what is known, else the model's guess, a steady fall that it calls oscillation being gradual."""
    if model is None:
        guess = F.lit("STABLE_JITTER")
    else:
        points = forest.with_inputs(model).transform(points)
        guess = F.col("guess")
    label = F.coalesce("known", guess)
    label = F.when((label == "OSCILLATION_NOISE") & (F.col("falling") == 1), "GRADUAL_CHANGE").otherwise(label)
    return points.withColumn("label", label).select(*V28.STEP_INPUT, "kind", "label")


def clean_stream(points: DataFrame, vehicles: DataFrame, model: PipelineModel | None = None, default_vehicle: str = "UNKNOWN", ttl_ms: int | None = None) -> DataFrame:
    """Tracked points of a stream (or what is read of one): the whole path from points to outputs, one append-mode query."""
    conf, name = points.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if conf.get(name).endswith("HDFSBackedStateStoreProvider"):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    points = with_capacity(with_defaults(points, default_vehicle), vehicles)
    return track_stream(predicted(model, featured(points, ttl_ms)), ttl_ms)


def shifts(outputs: DataFrame) -> DataFrame:
    """(vehicle_id, seq, us, kind, from_liters, to_liters, change_liters) of the points at which a level shift was tracked."""
    kind: Column = F.create_map(*[F.lit(x) for pair in SHIFTS.items() for x in pair])[F.col("quality_flag")]
    moved = outputs.where(F.col("quality_flag").isin(list(SHIFTS)) & F.col("previous").isNotNull())
    return moved.select("vehicle_id", "seq", "us", kind.alias("kind"), F.col("previous").alias("from_liters"), F.col("clean").alias("to_liters"), F.round(F.col("clean") - F.col("previous"), 2).alias("change_liters"))


def keep_results(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: measurements and events of a batch, each in a folder with the batch's number, so that a batch that is
    repeated after a failure replaces what it wrote and nothing is stored twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            stored = batch.where("raw is not null and clean is not null").withColumn("state_code", serving.known_state(F.col("signal_state")))
            for name, rows in (("measurements", stored), ("events", shifts(batch))):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id:09d}")
        finally:
            batch.unpersist()

    return write


def kept(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """measurements or events of all finished batches, with the batch's number; None if there are none."""
    done = _versions(spark, f"{path}/{name}")
    return spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{name}/{n}" for n in done]) if done else None


def contexts(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """What a stopped (or running) query's checkpoint holds of each vehicle: (vehicle_id, us, clean, capacity, mode, levels).

    operator is the number of the tracking step among the query's stateful operators, from the last one in the path on.
    """
    rows = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    doc = F.col("value.groupState.doc")
    context = F.from_json(doc, "context struct<us: long, clean: double, cap: double, mode: string, fuel: array<double>>")["context"]
    found = rows.where(doc.isNotNull()).select(F.col("key.vehicle_id").alias("vehicle_id"), context.alias("c"))
    return found.select("vehicle_id", F.col("c.us").alias("us"), F.col("c.clean").alias("clean"), F.col("c.cap").alias("capacity"), F.col("c.mode").alias("mode"), F.size("c.fuel").alias("levels"))


def sessions(points: DataFrame, delay: str = "10 minutes", gap_minutes: int = 30) -> DataFrame:
    """(vehicle_id, first_us, last_us, points) of the segments of a stream, each once it is closed: a segment ends when no point comes
    for more than gap_minutes, so points exactly that far apart are of one.
    """
    marked = points.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", delay)
    window = F.session_window("event_time", f"{gap_minutes} minutes 1 microsecond")
    out = marked.groupBy("vehicle_id", window).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("points"))
    return out.select("vehicle_id", "first_us", "last_us", "points")
