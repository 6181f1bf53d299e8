"""Telemetry in files: CSV and JSON sources under several column names, labelled rows, golden segments, and sinks."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwise.operators.adaptive import enhance
from tankwise.operators.gated import gated_kalman
from tankwise.operators.windows import steps

# Names a column may have, the first found counts.
NAMES = {
    "vehicle_id": ["vehicle_id", "bien_so", "car_id", "VehicleID"],
    "time": ["timestamp", "time", "thoi_gian", "FuelTime"],
    "fuel": ["raw_fuel", "fuel", "xang_tho", "FuelLevel", "raw"],
    "speed": ["speed", "van_toc", "Speed"],
    "distance_m": ["distance_m", "quang_duong", "DistanceMeters"],
    "lat": ["lat", "vi_do", "Lat"],
    "lng": ["lng", "kinh_do", "Lng"],
    "address": ["address", "dia_chi", "Address"],
    "capacity": ["capacity_est", "CapacityEst", "dung_tich", "capacity"],
}
# Formats of times, the first that fits counts; one digit does where two are usual. Day before month, where both are possible.
TIMES = ["yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "d/M/yyyy H:m:s", "d/M/yyyy H:m", "yyyy/M/d H:m:s", "M/d/yyyy H:m:s", "yyyy-M-d H:m", "yyyy-M-d'T'H:m", "yyyy-M-d"]
#: Numbers above are days since 1899-12-30, as spreadsheets count them; smaller ones are no times.
LEAST_SERIAL = 20_000


def number(c: Column) -> Column:
    """A double from text with a decimal point or comma; null if it is none."""
    return F.regexp_replace(F.trim(c.cast("string")), ",", ".").try_cast("double")


def moment(c: Column) -> Column:
    """A timestamp from text: fractions and zones are cut off, then the known formats are tried, then spreadsheet days."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"(?<=\d:\d\d)(\.\d*)?(Z|[+-]\d\d:?\d\d)?$", "")
    days = F.trim(c.cast("string")).try_cast("double")
    serial = F.when((days > LEAST_SERIAL) & (days < 200_000), F.timestamp_micros(F.round((days - 25_569) * 86_400_000_000).cast("long")))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMES], serial)


def parsed(raw: DataFrame, vehicle: Column | None = None) -> DataFrame:
    """The columns of NAMES from whichever names raw has, one row a row: what is no time or number is null, a missing speed or
    distance is 0. vehicle stands in where raw has no column for it. Raises ValueError without a time or level column.
    """
    found = {k: [F.col(f"`{n}`") for n in names if n in raw.columns] for k, names in NAMES.items()}
    if not found["vehicle_id"] and vehicle is not None:
        found["vehicle_id"] = [vehicle]
    if lacks := [k for k in ("vehicle_id", "time", "fuel") if not found[k]]:
        raise ValueError(f"no column for {', '.join(lacks)}")
    first = {k: F.coalesce(*[c.cast("string") for c in cs]) if cs else F.lit(None).cast("string") for k, cs in found.items()}
    real = {k: number(first[k]) for k in ("fuel", "speed", "distance_m", "lat", "lng", "capacity")}
    real |= {k: F.coalesce(real[k], F.lit(0.0)) for k in ("speed", "distance_m")}
    kept = [c for c in PLACE if c in raw.columns]
    return raw.select(first["vehicle_id"].alias("vehicle_id"), moment(first["time"]).alias("time"), *[c.alias(k) for k, c in real.items()], first["address"].alias("address"), *kept)


def canonical(raw: DataFrame, vehicle: Column | None = None) -> DataFrame:
    """parsed() without the rows that have no time; rejected() counts those."""
    return parsed(raw, vehicle).where("time is not null")


#: Where a row of a file stands: file, first byte of the split, and a number that grows in the split.
PLACE = ("file", "split_start", "place")


def _placed(raw: DataFrame) -> DataFrame:
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"), F.monotonically_increasing_id().alias("place"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, files): the different first lines of the CSV files and the files that have them."""
    first = _placed(spark.read.text(path)).where("split_start = 0").groupBy("file").agg(F.min_by("value", "place").alias("header"))
    return first.groupBy(F.regexp_replace("header", "^\ufeff", "").alias("header")).agg(F.sort_array(F.collect_list("file")).alias("files"))


def _columns(header: str) -> list[str]:
    """Names of a header line: one without a name is called after its place, one that is there already too."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([header]))):
        name = name.strip()
        names.append(name if name and name not in names else f"_c{i}")
    return names


def raw_csv(spark: SparkSession, path: str) -> list[DataFrame]:
    """Rows of the CSV files as text, with their place: one table for each different header, its files read by their own names."""
    groups = headers(spark, path).orderBy("header").collect()  # a row a header; Spark's reader holds the list of files anyway
    literal = lambda path: re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))  # noqa: E731  the reader takes patterns
    read = lambda g: spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in _columns(g["header"])])).option("header", True).csv([literal(f) for f in g["files"]])
    return [_placed(read(g)) for g in groups if g["header"]]


def _file_vehicle() -> Column:
    path = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))  # a plus sign is no space in a path
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(_processed)?\.csv$", "")


def parsed_csv(spark: SparkSession, path: str) -> DataFrame:
    """parsed() rows of CSV files whose headers may differ, with their place; a file of one vehicle without a column for it is
    named after it.
    """
    parts = raw_csv(spark, path)
    if not parts:
        raise ValueError(f"no header in the files of {path}")
    return union_sources(*[parsed(p, _file_vehicle()) for p in parts])


def read_csv(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """Points of CSV files: rows with a time. ordered adds seq, the number of the row in the files' order, from 0."""
    t = parsed_csv(spark, path)
    return (numbered(t) if ordered else t.drop(*PLACE)).where("time is not null")


def numbered(t: DataFrame) -> DataFrame:
    """t with seq instead of its place: rows are counted by split, and a split begins where those before it (by file, then byte) end."""
    sizes = t.groupBy("file", "split_start").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "split_start").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    starts = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    return t.join(starts, ["file", "split_start"]).withColumn("seq", F.col("before") + F.col("place") - F.col("first")).drop(*PLACE, "before", "first")


def rejected(t: DataFrame) -> DataFrame:
    """(vehicle_id, n_rows, without_time, without_level) of parsed rows: what canonical() drops, and what has no level."""
    return t.groupBy("vehicle_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("time").isNull()).alias("without_time"), F.count_if(F.col("fuel").isNull()).alias("without_level"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Points of JSON lines."""
    return canonical(spark.read.json(path))


def read_labelled(spark: SparkSession, path: str, features: list[str], labels: list[str]) -> DataFrame:
    """Feature rows of CSV files with one of the known labels; features that are missing or no numbers are 0."""
    raw = spark.read.option("header", True).csv(path)
    cols = [F.coalesce(number(F.col(f"`{f}`")), F.lit(0.0)).alias(f) if f in raw.columns else F.lit(0.0).alias(f) for f in features]
    return raw.select("VehicleID", "FuelTime", F.upper(F.trim("Label")).alias("label"), *cols).where(F.col("label").isin(labels))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Golden segments of a JSON array of documents, one row for each point: (id, pos, time, fuel, speed, lat, lng, expected,
    expected_state, capacity, source, first_row, review_status, checks). What a document lacks is null.
    """
    raw = spark.read.option("multiLine", True).json(path)
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None)
    curves = {"t": "timestamps", "fuel": "raw_liters", "speed": "speed_kmh", "lat": "latitudes", "lng": "longitudes", "expected": "expected_production_clean_liters", "state": "expected_production_states"}
    at = {k: F.get(has(c), F.col("pos")) if c in raw.columns else F.lit(None) for k, c in curves.items()}
    t = raw.select("*", F.explode(F.sequence(F.lit(0), F.size("timestamps") - 1)).alias("pos"))
    numbers = [at[k].cast("double").alias(k) for k in ("fuel", "speed", "lat", "lng", "expected")]
    first_row = F.get(has("source_rows"), F.lit(0)).cast("int") if "source_rows" in raw.columns else F.lit(None).cast("int")
    facts = [has("capacity_est_liters").cast("double").alias("capacity"), has("source").cast("string").alias("source"), first_row.alias("first_row"), has("review_status").cast("string").alias("review_status")]
    return t.select("id", "pos", moment(at["t"]).alias("time"), *numbers, at["state"].cast("string").alias("expected_state"), *facts, has("checks").alias("checks"))


def available_sources(spark: SparkSession, path: str) -> DataFrame:
    """(vehicle, path) of the CSV files in a folder, named without the endings of processed files; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode("path"), "/"), -1), r"\.csv$", "")
    return files.select(F.regexp_replace(stem, "_processed|_da_gop", "").alias("vehicle"), "path")


def stamps(spark: SparkSession, path: str) -> DataFrame:
    """(path, stamp): the first twelve hexadecimal digits of the SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 12).alias("stamp"))


def union_sources(*points: DataFrame) -> DataFrame:
    """Points of several data sets, columns by name, those that one lacks null."""
    out = points[0]
    for p in points[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def enhance_files(spark: SparkSession, source: str, target: str, kind: str = "adaptive") -> None:
    """A causal filter over all CSV files of a folder, written by vehicle: the adaptive one, or the gated one with its segments."""
    t = read_csv(spark, source, ordered=True).withColumn("us", F.unix_micros("time"))
    t = t.withColumn("seq", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("us", "seq")).cast("long"))
    if kind == "gated":
        out = gated_kalman(steps(t.where("fuel is not null"))).withColumnRenamed("estimate", "enhanced")
    elif kind == "adaptive":
        out = enhance(t)
    else:
        raise ValueError(f"no filter {kind}")
    write_points(out, target, "csv")


def write_table(t: DataFrame, url: str, name: str, enabled: bool = True, mode: str = "append", **options: str) -> bool:
    """Rows into a database table by Spark's JDBC writer; does nothing, and says so, while the database is switched off."""
    if enabled:
        t.write.format("jdbc").mode(mode).options(url=url, dbtable=name, **options).save()
    return enabled


def read_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table; partitionColumn, lowerBound, upperBound and numPartitions as options deal the read over tasks."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_points(t: DataFrame, path: str, kind: str = "parquet") -> None:
    """Points by vehicle, so that reading one vehicle reads its folder only; kind is a format of DataFrameWriter."""
    t.repartition("vehicle_id").write.mode("append").partitionBy("vehicle_id").option("header", True).format(kind).save(path)
