"""The causal filters as keyed stateful streams; a control row with kind 'reset' clears a vehicle in order."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tankwise.operators import adaptive, tracking

STATE_VERSION = 1
POINT = "vehicle_id string, seq long, us long, fuel double, speed double, capacity double, label string, lat double, lng double, kind string"


def encode(state: dict) -> str:
    return json.dumps({"schema_version": STATE_VERSION, "context": state})


def decode(doc: str, fresh: Callable[[], dict] = tracking.fresh) -> dict:
    """The state of a document: one of encode(), or one that spells the names of the tracking state out (LONG_NAMES)."""
    found = json.loads(doc)
    if found.get("schema_version") != STATE_VERSION:
        raise ValueError("state of another version")
    context = found["context"]
    if any(name in context for names in LONG_NAMES.values() for name in names):
        context = _shortened(context)
    return fresh() | context


# Names of the tracking state in documents of other services, the newer name first.
LONG_NAMES = {
    "x": ["kalman_x"],
    "p": ["kalman_p"],
    "clean": ["last_clean_fuel"],
    "us": ["last_time"],
    "cap": ["capacity_est"],
    "grace": ["recent_upward_steps", "recent_refuel_steps"],
    "falls": ["pending_downward_count", "pending_drain_count"],
    "drops": ["drop_count"],
    "anchor": ["upward_anchor", "refuel_anchor"],
    "rising": ["upward_samples", "refuel_samples"],
    "fuel": ["history_fuel"],
    "speed": ["history_speed"],
    "coords": ["history_coordinates"],
}


def _shortened(context: dict) -> dict:
    """The tracking state of a document with long names; its mode is STABLE once a level was seen, as these documents do not keep it."""
    state = {}
    for short, names in LONG_NAMES.items():
        for name in names:
            if name in context:
                state[short] = context[name]
                break
    if isinstance(state.get("us"), str):
        at = datetime.fromisoformat(state["us"])
        at = at if at.tzinfo else at.replace(tzinfo=UTC)
        state["us"] = (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)
    for ring in ("fuel", "speed", "coords"):
        if ring in state:
            state[ring] = list(state[ring])[-tracking.RING :]
    return state | {"mode": "STABLE" if state.get("x") is not None else "UNINITIALIZED"}


def _filtered(points: DataFrame, columns: tuple[str, ...], fresh: Callable[[], dict], one_point, out: str, ttl_ms: int | None) -> DataFrame:
    """one_point over the points of each vehicle in time order; a reset clears its state.

    A vehicle's rows of one trigger are held in memory at once, so a source should bound its trigger (maxFilesPerTrigger, maxOffsetsPerTrigger).
    """
    own = [c for c in columns if c in points.columns]
    points = points.select(*own, *(["kind"] if "kind" in points.columns else []))

    def each(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = decode(state.get[0], fresh) if state.exists else fresh()
        # the points of one vehicle in one trigger, in time order
        rows = [r for b in batches for r in b.astype(object).where(b.notna(), None).to_dict("records")]
        made = []
        for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            if r.get("kind") == "reset":
                held = fresh()
            else:
                made.append(one_point(held, tuple(r.get(c) for c in columns)))
        state.update((encode(held),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        if made:
            yield pd.DataFrame(made)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return points.groupBy("vehicle_id").applyInPandasWithState(each, out, "doc string", "append", timeout)


def track_stream(points: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Append-mode stream of outputs; points may have a column kind ('point' or 'reset'). Idle state expires after ttl_ms if given."""
    return _filtered(points, tracking.INPUT, tracking.fresh, tracking._point, tracking.OUT, ttl_ms)


def enhance_stream(points: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The same for the adaptive filter."""
    return _filtered(points, adaptive.INPUT, adaptive.fresh, adaptive._point, adaptive.OUT, ttl_ms)


def json_points(messages: DataFrame, value: str = "value", delay: str | None = None) -> DataFrame:
    """Points of a stream (or table) of JSON messages; broken messages and those without vehicle or time go.

    delay: if given, a watermark on the event time lets duplicates of a message within it go; without it all are accepted.
    """
    points = messages.select(F.from_json(F.col(value).cast("string"), POINT).alias("p")).select("p.*")
    points = points.where("vehicle_id is not null and us is not null").withColumn("kind", F.coalesce("kind", F.lit("point")))
    if delay is None:
        return points
    marked = points.withColumn("event_time", F.timestamp_micros("us")).withWatermark("event_time", delay)
    return marked.dropDuplicatesWithinWatermark(["vehicle_id", "us", "seq", "kind"]).drop("event_time")


def keep_latest(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table of the latest point of each vehicle, a version a batch; a repeated batch gives the same version."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch
        before = latest(spark, path, batch_id)
        if before is not None:
            newest = before.unionByName(batch, allowMissingColumns=True)
        row = F.max_by(F.struct(*newest.columns), F.struct("us", "seq")).alias("row")
        newest.groupBy("vehicle_id").agg(row).select("row.*").write.mode("overwrite").parquet(f"{path}/batch={batch_id:09d}")
        # a repeated batch reads the version before its own, so two are kept
        for old in _versions(spark, path)[:-2]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return upsert


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished batches in a folder, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    return [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last version of the table that keep_latest writes (before a batch), None if there is none."""
    done = [n for n in _versions(spark, path) if before is None or int(n.removeprefix("batch=")) < before]
    return spark.read.parquet(f"{path}/{done[-1]}") if done else None
