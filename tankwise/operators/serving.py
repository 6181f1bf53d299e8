"""History, fleet, top-k, export and dimension queries over telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankwise.operators import tracking
from tankwise.operators.windows import rounded

# The dictionary of signal states.
SIGNAL_STATES = [("STABLE_JITTER", "Stable"), ("OSCILLATION_NOISE", "Oscillation"), ("GRADUAL_CHANGE", "Gradual change"), ("UPWARD_SHIFT", "Upward shift"), ("DOWNWARD_SHIFT", "Downward shift")]


def latest(t: DataFrame, n: int) -> DataFrame:
    """The last n points of each vehicle, newest first by place."""
    w = Window.partitionBy("vehicle_id").orderBy(F.desc("us"), F.desc("seq"))
    return t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def history(t: DataFrame, like: str, first_us: int | None, last_us: int | None, limit: int) -> DataFrame:
    """Newest points, limit at most, of one vehicle in a time range, given back oldest first: of the vehicle with that id in any
    case, else of the first whose id contains it.
    """
    v = F.lower("vehicle_id")
    near = t.where(v.contains(like.lower())).groupBy("vehicle_id").agg(F.max(v == like.lower()).alias("exact"))
    one = F.broadcast(near.orderBy(F.desc("exact"), "vehicle_id").limit(1).select("vehicle_id"))
    newest = _between(t.join(one, "vehicle_id", "left_semi"), first_us, last_us).orderBy(F.desc("us"), F.desc("seq")).limit(limit)
    return newest.orderBy("us", "seq")


def _between(t: DataFrame, first_us: int | None, last_us: int | None) -> DataFrame:
    t = t if first_us is None else t.where(F.col("us") >= first_us)
    return t if last_us is None else t.where(F.col("us") <= last_us)


def log(t: DataFrame, vehicle_id: str, first_us: int | None, last_us: int | None, limit: int) -> DataFrame:
    """The first points of a vehicle in a time range, oldest first."""
    return _between(t.where(F.col("vehicle_id") == vehicle_id), first_us, last_us).orderBy("us", "seq").limit(limit)


def known_state(c: Column) -> Column:
    """A code of the dictionary; any other becomes the first."""
    return F.when(c.isin([s for s, _ in SIGNAL_STATES]), c).otherwise(SIGNAL_STATES[0][0])


# What the signal states mean, for those who read results.
STATE_MEANINGS = [
    ("UNINITIALIZED", "No valid level has come yet"),
    ("INIT", "The first valid level of the vehicle"),
    ("STABLE_JITTER", "The level rests; only sensor noise moves it"),
    ("OSCILLATION_NOISE", "The level swings to and fro around its course"),
    ("SLOSHING", "The liquid sloshes while the vehicle moves"),
    ("GRADUAL_CHANGE", "The level falls or rises slowly and steadily"),
    ("UPWARD_SHIFT", "The level has moved to a higher one"),
    ("DOWNWARD_SHIFT", "The level has moved to a lower one"),
    ("SPIKE", "A single reading far from its neighbours"),
    ("UNCERTAIN", "The signal fits no known state"),
]


def described(outputs: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """outputs with signal_state_description from the dictionary, a fixed ten rows; a state that it lacks is described as UNCERTAIN."""
    names = (spark or outputs.sparkSession).createDataFrame(STATE_MEANINGS, "signal_state string, signal_state_description string")
    other = dict(STATE_MEANINGS)["UNCERTAIN"]
    return outputs.join(F.broadcast(names), "signal_state", "left").withColumn("signal_state_description", F.coalesce("signal_state_description", F.lit(other)))


def clean_batch(t: DataFrame) -> DataFrame:
    """The tracking step over a batch of points of many vehicles, given back in the order of seq, the number of the row in the batch.

    Points of a vehicle that share a time are taken in the order of seq.
    """
    return tracking.track(t).orderBy("seq")


def in_segment(t: DataFrame, segment_id: int | None) -> DataFrame:
    """Points of one segment number, or of all."""
    return t if segment_id is None else t.where(F.col("segment_id") == segment_id)


def without_vehicle(t: DataFrame, vehicle_id: str) -> DataFrame:
    return t.where(F.col("vehicle_id") != vehicle_id)


def axis_bounds(t: DataFrame, columns: list[str]) -> DataFrame:
    """Whole litres below and above all positive levels of the columns, with a tenth of their range to spare, by vehicle."""
    values = F.explode(F.array(*columns)).alias("x")
    b = t.select("vehicle_id", values).where("x > 0").groupBy("vehicle_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    spare = (F.col("hi") - F.col("lo")) * 0.1
    return b.select("vehicle_id", F.greatest(F.lit(0).cast("long"), F.floor(F.col("lo") - spare)).alias("y_min"), F.ceil(F.col("hi") + spare).alias("y_max"))


def fleet(t: DataFrame) -> DataFrame:
    """Points, first and last time and the latest values of each vehicle."""
    last = F.max_by(F.struct("fuel", "speed"), F.struct("us", "seq"))
    return t.groupBy("vehicle_id").agg(F.count("*").alias("points"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), last.alias("l")).select("vehicle_id", "points", "first_us", "last_us", F.col("l.fuel").alias("last_fuel"), F.col("l.speed").alias("last_speed"))


def resolve_capacity(t: DataFrame, vehicles: DataFrame, requested: Column, placeholder: float = 850.0) -> DataFrame:
    """Master capacity, else the requested one, else none; the placeholder counts as unknown."""
    j = t.join(vehicles.select("vehicle_id", "capacity_liters"), "vehicle_id", "left")
    master = F.when((F.col("capacity_liters") > 0) & (F.col("capacity_liters") != placeholder), F.col("capacity_liters"))
    asked = F.when(requested > 0, requested)
    return j.withColumn("capacity", F.coalesce(master, asked)).withColumn("capacity_source", F.when(master.isNotNull(), "MASTER_DATA").when(asked.isNotNull(), "REQUEST").otherwise("NONE"))


def downsample(t: DataFrame, most: int) -> DataFrame:
    """Every k-th point of each vehicle, k = ceil(n / most), and its last."""
    w = Window.partitionBy("vehicle_id")
    t = t.withColumns({"rn": F.row_number().over(w.orderBy("us", "seq")), "n": F.count("*").over(w)})
    return t.where(((F.col("rn") - 1) % F.ceil(F.col("n") / most) == 0) | (F.col("rn") == F.col("n")))


def upsert(vehicles: DataFrame, seen: DataFrame) -> DataFrame:
    """vehicles and those of seen (vehicle_id, capacity_liters) that it lacks, named by their id; a capacity that seen knows
    replaces its own, other columns of vehicles stay.
    """
    new = seen.groupBy("vehicle_id").agg(F.max("capacity_liters").alias("new"))
    j = vehicles.join(new, "vehicle_id", "full_outer")
    known = {"capacity_liters": F.coalesce("new", "capacity_liters")}
    if "vehicle_name" in vehicles.columns:
        known["vehicle_name"] = F.coalesce("vehicle_name", "vehicle_id")
    return j.withColumns(known).drop("new")


def noise_band(noise: Column) -> Column:
    return F.when(noise > 4, "Spike").when(noise > 1.5, "Sloshing").otherwise("Normal")


def speed_band(speed: Column) -> Column:
    return F.when(speed <= 3, "0-3").when(speed <= 10, "3-10").when(speed <= 30, "10-30").when(speed <= 60, "30-60").otherwise("60+")


def largest_rise(t: DataFrame, before: int = 30, after: int = 50) -> DataFrame:
    """Position of each vehicle's largest rise (the first of equal ones) and the range of positions to show around it."""
    w = Window.partitionBy("vehicle_id")
    line = w.orderBy("us", "seq")
    t = t.withColumns({"jump": rounded(F.col("fuel") - F.lag("fuel").over(line), 6), "pos": F.row_number().over(line).cast("long") - 1, "n": F.count("*").over(w)})
    top = t.where("jump > 0").groupBy("vehicle_id").agg(F.max_by(F.struct("pos", "jump", "n"), F.struct("jump", -F.col("pos"))).alias("b"))
    return top.select("vehicle_id", F.col("b.pos").alias("at_pos"), F.col("b.jump").alias("jump"), F.greatest(F.lit(0), F.col("b.pos") - before).alias("start_pos"), F.least(F.col("b.n") - 1, F.col("b.pos") + after).alias("end_pos"))


def nearest(t: DataFrame, at_us: int) -> DataFrame:
    """The point of each vehicle nearest to a time, the earlier of two as near."""
    best = F.min_by(F.struct("seq", "us", "fuel"), F.struct(F.abs(F.col("us") - at_us), "us", "seq"))
    return t.groupBy("vehicle_id").agg(best.alias("b")).select("vehicle_id", "b.*")


def recent(t: DataFrame, hours: int) -> DataFrame:
    """Points within hours of the vehicle's last one."""
    return t.withColumn("_top", F.max("us").over(Window.partitionBy("vehicle_id"))).where(F.col("us") >= F.col("_top") - hours * 3_600_000_000).drop("_top")


def ring(t: DataFrame, size: int) -> DataFrame:
    """The last size valid levels of each vehicle in hundredths of a litre, oldest first, comma-joined."""
    last = latest(t.where("fuel > 0"), size)
    return last.groupBy("vehicle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("us", "seq", F.round(F.col("fuel") * 100).cast("long").alias("v")))), lambda p: p["v"].cast("string")), ",").alias("ring"))


def report(t: DataFrame) -> DataFrame:
    """The eleven columns of a vehicle's export in time order, from points with raw, clean, speed, lat, lng and address."""
    w = Window.partitionBy("vehicle_id").orderBy("us", "seq")
    raw = rounded(F.coalesce("raw", F.lit(0.0)), 2)
    t = t.withColumns({"no": F.row_number().over(w), "raw_liters": raw, "clean_liters": rounded(F.coalesce("clean", raw), 2)})
    off = rounded(F.col("raw_liters") - F.col("clean_liters"), 2)
    return t.select(
        "no", "vehicle_id", "us", "raw_liters", "clean_liters", off.alias("noise_liters"), noise_band(F.abs(off)).alias("signal"), F.coalesce("speed", F.lit(0.0)).alias("speed_kmh"),
        F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lng", F.lit(0.0)).alias("lng"), F.coalesce("address", F.lit("")).alias("address"),
    )


# The region that maps show.
MAP_LAT, MAP_LNG = (5, 30), (90, 120)


def map_bounds(t: DataFrame) -> DataFrame:
    """Points inside the region, and their least and greatest coordinates, by vehicle; swapped coordinates are put right first."""
    swapped = (F.col("lat") > 50) & (F.col("lng") < 50)
    lat, lng = (F.when(swapped, F.col(a)).otherwise(F.col(b)) for a, b in (("lng", "lat"), ("lat", "lng")))
    p = t.select("vehicle_id", lat.alias("lat"), lng.alias("lng"))
    p = p.where((F.col("lat") > MAP_LAT[0]) & (F.col("lat") < MAP_LAT[1]) & (F.col("lng") > MAP_LNG[0]) & (F.col("lng") < MAP_LNG[1]))
    return p.groupBy("vehicle_id").agg(F.count("*").alias("points"), *[f(c).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("min", F.min), ("max", F.max))])


def on_days(t: DataFrame, time: str, first: str | None, last: str | None) -> DataFrame:
    """Rows whose time, as text, begins with a day from first to last (yyyy-MM-dd, either may be open); rows without a time stay."""
    day = F.substring(F.col(time).cast("string"), 1, 10)
    inside = (F.lit(True) if first is None else day >= first) & (F.lit(True) if last is None else day <= last)
    return t.where(F.col(time).isNull() | inside)


def save_measurements(outputs: DataFrame, path: str) -> None:
    """Append cleaned points, by vehicle; rows without a raw or clean level are not stored, unknown states become the first known."""
    rows = outputs.where("raw is not null and clean is not null").withColumn("state_code", known_state(F.col("signal_state")))
    rows.repartition("vehicle_id").write.mode("append").partitionBy("vehicle_id").parquet(path)
