"""Telemetry points from the event table: integer arithmetic only, so that any engine gets the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE_US = 1_704_067_200_000_000
DENSE, GAPPY = 240, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vehicle_id(number: str, whole: bool) -> Column:
    """V and the number in five digits; longer numbers are cut to five, as the SQL of the queries has it, unless they are wanted whole."""
    digits = F.col(number).cast("string")
    padded = F.lpad(digits, 5, "0")
    return F.concat(F.lit("V"), F.when(F.length(digits) > 5, digits).otherwise(padded) if whole else padded)


def telemetry(spark: SparkSession, sf_dir: str, divisor: int = DENSE, whole: bool = False) -> DataFrame:
    """(vehicle_id, seq, us, fuel, speed, lat, lng): one row for each event; us are compressed microseconds.

    whole: vehicles with more than five digits keep their own id, here and in vehicles(); cut ones would mix the points of several
    vehicles and give each point once for every vehicle that shares its cut id.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("raw_us"))
    upto = Window.partitionBy("user_id").orderBy("raw_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("event_type")
    speed = F.when(kind.isin("purchase", "view", "click"), F.col("k")).otherwise(0)
    step = F.when((kind == "purchase") & (F.col("k") < 10), 6000).when((kind == "signup") & (F.col("k") < 10), -4500).otherwise(-30)
    noise = F.when((kind == "click") & (F.col("k") >= 90), -2500).when(kind == "view", 6 * (F.col("k") - 50)).otherwise(F.col("k") % 7 - 3)
    e = e.withColumn("speed", speed)
    level = F.greatest(F.lit(2000), F.lit(40000) + F.sum(step).over(upto) + noise)
    fuel = F.when((kind == "error") & (F.col("k") < 25), 0).otherwise(level) / 100
    lat = F.lit(21_000_000) + F.sum(F.when(F.col("speed") > 5, 40 * F.col("speed")).otherwise(F.col("k") % 5 - 2)).over(upto)
    lng = F.lit(105_000_000) + 1000 * F.col("user_id") + F.sum(F.when(F.col("speed") > 5, 25 * F.col("speed")).otherwise(F.col("k") % 3 - 1)).over(upto)
    there = F.col("k") % 17 != 0
    us = F.lit(BASE_US) + F.expr(f"(raw_us - {BASE_US}) div {divisor}")
    return e.select(
        vehicle_id("user_id", whole).alias("vehicle_id"), F.col("event_id").alias("seq"), us.alias("us"), fuel.cast("double").alias("fuel"), F.col("speed").cast("double").alias("speed"),
        F.when(there, lat / 1_000_000).alias("lat"), F.when(there, lng / 1_000_000).alias("lng"),
    )


def vehicles(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Vehicle dimension from customer: every fifth has no capacity, every seventh the 850.0 placeholder for unknown."""
    c = table(spark, sf_dir, "customer")
    capacity = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 7 == 0, 850.0).otherwise(300.0 + (F.col("c_custkey") % 11) * 20)
    return c.select(vehicle_id("c_custkey", whole).alias("vehicle_id"), F.col("c_name").alias("vehicle_name"), capacity.cast("double").alias("capacity_liters"), "c_nationkey")
