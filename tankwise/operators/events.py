"""Shift events: runs of confirmed shifts made into one row each, stored, joined with vehicles and listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankwise.operators.windows import by_vehicle

# The event that a signal state becomes.
EVENT_TYPES = {"UPWARD_SHIFT": "REFUEL", "DOWNWARD_SHIFT": "DRAIN"}


def shift_events(t: DataFrame) -> DataFrame:
    """One row for each run of points of one shift label (vehicle_id, us, seq, fuel, lat, lng, label).

    The event starts at the point before the run and ends at its last point; the change is the difference of their levels.
    """
    w = by_vehicle()
    t = t.withColumns({"was": F.lag("label").over(w), "from_us": F.lag("us").over(w), "from_fuel": F.lag("fuel").over(w)})
    t = t.withColumn("run", F.sum(F.when(F.col("label").eqNullSafe(F.col("was")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shifts = t.where(F.col("label").isin(list(EVENT_TYPES)))
    at = F.struct("us", "seq")
    first, last = (f(F.struct("from_us", "us", "from_fuel", "fuel", "lat", "lng"), at) for f in (F.min_by, F.max_by))
    runs = shifts.groupBy("vehicle_id", "run", "label").agg(first.alias("a"), last.alias("b"))
    start = F.coalesce("a.from_fuel", "a.fuel")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv]), F.col("label"))
    return runs.select(
        "vehicle_id", kind.alias("event_type"), F.coalesce("a.from_us", "a.us").alias("start_us"), F.col("b.us").alias("end_us"), start.alias("start_fuel"),
        F.col("b.fuel").alias("end_fuel"), (F.col("b.fuel") - start).alias("change_liters"), F.col("b.lat").alias("lat"), F.col("b.lng").alias("lng"),
    )


def with_vehicles(events: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Events of known vehicles with their names."""
    return events.join(vehicles.select("vehicle_id", "vehicle_name"), "vehicle_id")


def save_events(events: DataFrame, path: str) -> None:
    """Append events, types in upper case, by type: a reader of one type reads its folder only."""
    events.withColumn("event_type", F.upper("event_type")).write.mode("append").partitionBy("event_type").parquet(path)


def newest_events(events: DataFrame, n: int) -> DataFrame:
    """The n events of each vehicle that start last, newest first by place."""
    w = Window.partitionBy("vehicle_id").orderBy(F.desc("start_us"), F.desc("end_us"), "event_type")
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def event_kind(noise: Column) -> Column:
    """What a deviation in litres is called in the log."""
    return F.when(F.abs(noise) > 10, "Burst").when(F.abs(noise) > 5, "Spike").otherwise("Dip")
