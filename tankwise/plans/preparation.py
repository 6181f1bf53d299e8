"""Queries of the preparation, gated filter and views, and the DuckDB SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankwise.operators import feature_vector as V28
from tankwise.operators import forest as M
from tankwise.operators import gated as G
from tankwise.operators import preparation as R
from tankwise.operators import profile as P
from tankwise.operators import quality as Q
from tankwise.operators import serving as S
from tankwise.operators import windows as W
from tankwise.plans.oracles import AROUND, EPOCHS, LABELS, PROFILE, STEPS, TELE, VEHICLES, V, inline_haversine, recursive, sql
from tankwise.sources import files
from tankwise.sources.adapter import GAPPY, telemetry, vehicles

KEY = ["vehicle_id", "seq"]
LIMITS = {"max_clean_span": 120.0, "max_upward_step": 6.0, "max_final_lag_liters": 2.5, "max_step_size": 8.0, "min_clean_liters": 20.0, "min_total_clean_drop": 2.0}
r6 = W.r6


def _noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).withColumn("clean", F.avg("fuel").over(W.by_vehicle().rowsBetween(-7, 0)))


def gated_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gated_kalman(W.steps(telemetry(spark, sf_dir, GAPPY))).select(*KEY, "segment_id", r6("estimate").alias("estimate"))


def phased_kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.phased_kalman(telemetry(spark, sf_dir, 2 * GAPPY)).select(*KEY, r6("estimate").alias("estimate"))


def prepared_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r4 = [(W.rounded(c, 4) + F.lit(0.0)).alias(c) for c in ("delta", "fuel_rate", "rolling_median", "rolling_std")]
    return R.prepared(telemetry(spark, sf_dir, GAPPY)).select(*KEY, "segment_id", "is_start", *r4, "rolling_count", "ready", "movement", "status", "quality_flag", "quality_reason")


def trend_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trend_evidence(telemetry(spark, sf_dir, GAPPY)).select(*KEY, "epoch", *[r6(c).alias(c) for c in ("early", "late", "level_drop", "slope", "target", "moving_ratio")], "robust_downtrend")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(telemetry(spark, sf_dir))


def gradual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gradual_override(_labelled(spark, sf_dir)).select(*KEY, "label", "state")


def canonical_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("rule", R.canonical_state(F.col("rule")).alias("state")).agg(F.count("*").alias("n"))


def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and motion states under the names of other producers, as the event types of the table stand for them."""
    kind = F.col("k") % 8
    said = [" refuel_tracked", "DRAIN_CONFIRMED", "Valid ", "SPIKE_HELD", "REVERSAL_REJECTED", "nothing", None, "pending_refuel_held"]
    moved = ["moving", " LOW_MOTION", "PARKED", None, "MOVING", "uncertain", "", "LOW_MOTION"]
    t = telemetry(spark, sf_dir).withColumn("k", F.col("seq"))
    of = lambda names: F.get(F.array(*[F.lit(n) for n in names]), kind.cast("int"))
    return t.groupBy(R.canonical_flag(of(said)).alias("flag"), R.canonical_motion(of(moved)).alias("motion")).agg(F.count("*").alias("n"))


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in each of the known formats, by row number, read back."""
    at, day = F.timestamp_micros("us"), F.date_trunc("day", F.timestamp_micros("us"))
    serial = F.floor(F.col("us") / 21_600_000_000) / 4 + 25_569
    shapes = [
        F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z")), F.date_format(at, "dd/MM/yyyy HH:mm"), F.date_format(at, "d/M/yyyy H:mm:ss"), serial.cast("string"),
        F.date_format(at, "yyyy/MM/dd HH:mm:ss"), F.lit("never"), F.lit("12"), F.date_format(day, "yyyy-MM-dd"), F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit("+07:00")),
    ]
    text = F.get(F.array(*shapes), (F.col("seq") % len(shapes)).cast("int"))
    return telemetry(spark, sf_dir, GAPPY).select(*KEY, F.unix_micros(files.moment(text)).alias("read_us"))


def state_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(S.SIGNAL_STATES, "state string, state_name string")
    return canonical_states(spark, sf_dir).join(F.broadcast(names), "state", "left").groupBy(F.coalesce("state_name", "state").alias("state_name")).agg(F.sum("n").alias("n"))


def repaired_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.col("seq") % 5 == 0
    t = telemetry(spark, sf_dir)
    return R.repair_swapped(t.withColumns({"lat": F.when(odd, t.lng).otherwise(t.lat), "lng": F.when(odd, t.lat).otherwise(t.lng)})).select(*KEY, "lat", "lng")


def central_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.central_times(telemetry(spark, sf_dir, GAPPY)).select(*KEY, "us")


def nominal_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.when(F.col("gap_min") > 0, F.col("gap_min"))
    return W.steps(telemetry(spark, sf_dir)).groupBy("vehicle_id").agg(r6(F.coalesce(F.percentile(gap, 0.5), F.lit(5.0))).alias("period"))


def learnt_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.learnt_period(W.steps(telemetry(spark, sf_dir))).select("vehicle_id", r6("period").alias("period"))


def behaviour_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.behaviour_checks(_noisy(spark, sf_dir), LIMITS)


def step_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.steps(telemetry(spark, sf_dir))
    return t.groupBy("vehicle_id").agg(*[r6(F.percentile("abs_delta", q / 100)).alias(f"p{q}") for q in (50, 95, 99)], r6(F.avg("abs_delta")).alias("mean_step"))


def active_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.resolve_capacity(S.latest(telemetry(spark, sf_dir), 1), vehicles(spark, sf_dir), F.lit(0.0))
    return t.select("vehicle_id", "us", "fuel", "capacity", r6(F.greatest(F.lit(0.5), F.coalesce(0.002 * F.col("capacity"), F.lit(0.0)))).alias("noise_sigma"))


def vehicle_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("us") / 86_400_000_000)
    return telemetry(spark, sf_dir, GAPPY).groupBy("vehicle_id").agg(F.count("*").alias("points"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(day).alias("days"))


def largest_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.largest_rise(telemetry(spark, sf_dir))


def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(telemetry(spark, sf_dir), 1_704_100_000_000_000).select("vehicle_id", "seq", "us", "fuel")


def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent(telemetry(spark, sf_dir, GAPPY), 24).select(*KEY, "us")


def recent_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spikes = _noisy(spark, sf_dir).where(F.abs(W.rounded(F.col("fuel") - F.col("clean"), 6)) > 4)
    return S.latest(spikes, 10).select(*KEY, F.col("place").cast("long").alias("place"))


def level_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ring(telemetry(spark, sf_dir), 12)


def segment_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.steps(telemetry(spark, sf_dir, GAPPY)).groupBy("vehicle_id", "segment_id").agg(F.min("us").alias("from_us"), F.count("*").alias("points"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("from_us", "segment_id")).cast("long"))


def motion_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.by_vehicle()
    far = W.haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    t = W.steps(telemetry(spark, sf_dir)).withColumn("gps_speed", F.when(F.col("gap_min") > 0, F.coalesce(far, F.lit(0.0)) / 1000 / (F.col("gap_min") / 60)).otherwise(0.0))
    factor = F.when(F.col("speed") <= 5, 1.0).when(F.col("speed") <= 40, 2.0).when(F.col("speed") <= 70, 1.5).otherwise(2.5)
    return t.select(*KEY, (W.rounded("gps_speed", 3) + F.lit(0.0)).alias("gps_speed"), (W.rounded(F.greatest("speed", "gps_speed"), 3) + F.lit(0.0)).alias("motion_speed"), factor.alias("noise_factor"))


def row_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select(*KEY, F.sha2(F.concat_ws("|", "vehicle_id", "seq", "us"), 256).alias("stamp"))


def offline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V28.offline(P.featured(telemetry(spark, sf_dir))).select(*KEY, *[(W.rounded(F.col("features")[n], 9) + F.lit(0.0)).alias(n) for n in V28.NAMES])


def day_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.col("us") / 86_400_000_000).alias("day")
    return _labelled(spark, sf_dir).where("label is not null").groupBy("vehicle_id", day).agg(F.count("*").alias("points"), F.sum((F.col("label") == "STABLE_JITTER").cast("long")).alias("stable"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def forest_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of label and guess over the vehicles that the forest was not trained on, each and all (null)."""
    t = M.held_out(V28.offline(P.labelled(telemetry(spark, sf_dir, whole=True))))
    return Q.confusion(M.classify(M.train(t.where("not held_out"), trees=60, depth=12), t.where("held_out")), "label", "guess", "vehicle_id")


QUERIES = {f.__name__: f for f in (
    gated_kalman, phased_kalman, prepared_points, trend_evidence, gradual_override, canonical_states, canonical_names, parsed_times, state_names, repaired_coordinates, central_times, nominal_period,
      learnt_period, behaviour_checks, step_percentiles, active_contexts,
    vehicle_days, largest_rise, nearest_point, recent_window, recent_spikes, level_ring, segment_options, motion_speed, row_stamps, day_states, offline_features, forest_confusion,
)}

NOISY = f", c as (select *, avg(fuel) over (v rows between 7 preceding and current row) as clean from t {V})"
STATE = """
        case when rule in ('REFUEL', 'RISING') then 'UPWARD_SHIFT' when rule = 'DRAIN' then 'DOWNWARD_SHIFT' when rule in ('DROPOUT', 'TRANSIENT_UP_NOISE',
          'TRANSIENT_DOWN_NOISE') then 'OSCILLATION_NOISE' when rule in ('STABLE_JITTER', 'SPIKE') then rule else 'UNCERTAIN' end"""
SEG = "window w as (partition by vehicle_id, segment_id order by us, seq)"
FAR = "hav(lag(lat) over v, lag(lng) over v, lat, lng)"

GATED = f"""with recursive {TELE.format(d=40)}{STEPS}, nom as (
  select vehicle_id, coalesce(quantile_cont(gap_min, 0.5) filter (gap_min > 0), 5.0) as nom from s group by 1
), e as (
  select s.*, nom, sum(case when gap_min > 0 then gap_min else nom end) over (w rows between unbounded preceding and current row) as el,
    coalesce(speed - lag(speed) over w, 0) / 3.6 / (greatest(coalesce(gap_min, nom), 1.0) * 60) as acc,
    round(case when count(fuel) over (w rows between 11 preceding and current row) >= 2 then stddev_pop(fuel) over (w rows between 11 preceding and
      current row) else 0 end, 9) as sd from s join nom using (vehicle_id) {SEG}
), z as (
  select vehicle_id, segment_id, seq, fuel, speed, acc, sd, (el - lag(el) over w) / nom as ratio, row_number() over w as i from e where fuel > 0 {SEG}
), f as (
  select vehicle_id, segment_id, seq, i, fuel as x, 4.0::double as p, 0 as n, 0 as sg from z where i = 1
  union all
  select vehicle_id, segment_id, seq, i, case when n2 >= 3 then fuel when n2 > 0 and not fall then x else greatest(0, x + (p + q) / (p + q + r) * off) end,
    case when n2 >= 3 then 4.0 when n2 > 0 and not fall then p else (1 - (p + q) / (p + q + r)) * (p + q) end, case when n2 >= 3 then 0 else n2 end, case when n2 >= 3 then 0 else s2 end
  from (select *, (case when calm then greatest(3.0, 9 * 0.35::double) when fall then greatest(4.0, 9 * 0.55::double) else 9.0 end)::double * (case when
    speed <= 5 then 1 when speed <= 40 then 2 when speed <= 70 then 1.5 else 2.5 end)::double * (case when abs(acc) > 0.1 then 3 else 1 end) as r,
      0.2::double * greatest(ratio, 0.1) * (case when calm then 4 when fall then 8 else 1 end) as q
    from (select *, off < -lim and (speed > 10 or sd > 3.75 or abs(acc) > 0.12) and n2 >= 2 as fall, speed <= 3 and sd <= 3.75 and abs(acc) <= 0.12 as calm
      from (select *, case when abs(off) <= lim then 0 when sg = 0 or sg = s2 then n + 1 else 1 end as n2
        from (select z.*, f.x, f.p, f.n, f.sg, z.fuel - f.x as off, greatest(5.0, 2 * z.sd) as lim, cast(sign(z.fuel - f.x) as int) as s2
          from f join z on z.vehicle_id = f.vehicle_id and z.segment_id = f.segment_id and z.i = f.i + 1))))
) select s.vehicle_id, s.seq, cast(s.segment_id as bigint) as segment_id, round(x, 6) + 0.0 as estimate from s left join f on s.vehicle_id = f.vehicle_id and s.seq = f.seq"""

PREPARED = f""", a0 as (
  select *, (us - lag(us) over v) / 60000000.0::double as gap, {FAR} as far, nullif(fuel, 0) as known from t {V}
), b0 as (
  select *, case when gap is null or gap >= 120 then 1 else 0 end as is_start, sum(case when gap is null or gap >= 120 then 1 else 0 end) over (v rows
    between unbounded preceding and current row) as segment_id, greatest(3 * quantile_cont(gap, 0.5) over (v rows between 19 preceding and current row),
    5.0) as lim from a0 {V}
), c0 as (
  select *, known - lag(known) over w as delta, quantile_cont(known, 0.5) over (w rows between 4 preceding and current row) as rm, stddev_samp(known)
    over (w rows between 4 preceding and current row) as rs, count(known) over (w rows between 4 preceding and current row) as rc,
    case when fuel = 0 then 'FUEL_ZERO' when lag(fuel) over w = 0 then 'PREVIOUS_INVALID' else 'VALID' end as status from b0 {SEG}
), d0 as (
  select *, coalesce(abs(delta) >= 10 or abs(delta) > quantile_cont(abs(delta), 0.99) over (partition by vehicle_id), false) as large from c0
), e0 as (
  select *, concat_ws('|', case when fuel = 0 then 'FUEL_ZERO' end, case when gap >= 120 then 'LONG_GAP' end, case when large then 'LARGE_DELTA' end,
    case when gap > lim and (speed > 5 or coalesce(far, 0) > 50) then 'SIGNAL_LOSS_MOVING' end, case when gap = 0 then 'DUPLICATE_TIME' end) as why from
    d0
)"""

ORACLES = {
    "gated_kalman": GATED,
    "phased_kalman": recursive("""
        , z as (
          select vehicle_id, seq, fuel, (us - min(us) over (partition by vehicle_id)) / 60000000.0::double as m, row_number() over v as i from t window v as (partition by vehicle_id order by us, seq)
        ), y as (
          select *, case when m < 30 then 0 when m <= 45 then 1 else 2 end as phase, sum(case when m >= 30 and m <= 45 then 1 else 0 end) over (partition by vehicle_id order by i) as nth from z
        ), f as (
          select vehicle_id, seq, i, fuel as x, (1 - 1.01::double / 46.01::double) * 1.01::double as p from y where i = 1
          union all
          select y.vehicle_id, y.seq, y.i, case when y.phase = 1 then case when y.nth = 1 then y.fuel else 0.9::double * y.fuel + 0.1::double * f.x end else f.x + (f.p + q) / (f.p + q + r) * (y.fuel - f.x) end,
            case when y.phase = 1 then 1.0::double else (1 - (f.p + q) / (f.p + q + r)) * (f.p + q) end
          from (select f.*, case when y.phase = 0 then 0.01::double else 0.08::double end as q,
            case when y.phase = 0 then 45.0::double when abs(y.fuel - f.x) > 2 then 30.0::double else 12.0::double end as r from f join y on y.vehicle_id = f.vehicle_id and y.i = f.i + 1) as f
          join y on y.vehicle_id = f.vehicle_id and y.i = f.i + 1
        ) select vehicle_id, seq, round(x, 6) + 0.0 as estimate from f""", d=80),
    "prepared_points": inline_haversine(sql("""
        select vehicle_id, seq, cast(segment_id as bigint) as segment_id, is_start, round(delta, 4) + 0.0 as delta, round(case when gap > 0 then delta / gap
          end, 4) + 0.0 as fuel_rate, round(rm, 4) + 0.0 as rolling_median, round(rs, 4) + 0.0 as rolling_std, rc as rolling_count, cast(rc >= 5 as int) as
          ready, case when speed > 0 then 'Moving' when speed <= 0 then 'Stopped' else 'Uncertain' end as movement, status, cast(why <> '' as int) as
          quality_flag, case when why = '' then 'VALID' else why end as quality_reason from e0""", PREPARED, d=40)),
    "trend_evidence": recursive("""
        , w10 as (
          select *, avg(case when speed > 5 then 1.0 else 0.0 end) over (partition by vehicle_id, epoch order by us, seq rows between 9 preceding and current row) as mr from e
        ), q as (
          select *, row_number() over (partition by vehicle_id, epoch order by us, seq) as j from w10 where fuel > 0
        ), h as (
          select vehicle_id, seq, epoch, j, fuel, mr, list(fuel) over o as a, regr_slope(fuel, j) over o as m, regr_intercept(fuel, j) over o as b from q window o as
            (partition by vehicle_id, epoch order by us, seq rows between 9 preceding and current row)
        ), k as (
          select *, len(a) >= 6 as ok, list_median(a[1:len(a) // 2]) as e, list_median(a[len(a) // 2 + 1:]) as l from h
        ) select vehicle_id, seq, epoch, round(case when ok then e end, 6) + 0.0 as early, round(case when ok then l end, 6) + 0.0 as late, round(case when ok then e - l end, 6) + 0.0 as level_drop,
          round(case when ok then m end, 6) + 0.0 as slope, round(case when ok then b + m * j else fuel end, 6) + 0.0 as target, round(mr, 6) + 0.0 as moving_ratio,
          coalesce(ok and mr > 0 and e - l >= 2 and m <= -0.2, false) as robust_downtrend from k""", EPOCHS, d=40),
    "gradual_override": sql(f"""
        , g as (select *, fuel - lag(fuel, 5) over v as net, sum(abs_delta) over (v rows between 4 preceding and current row) as va, max(delta) over (v rows
          between 4 preceding and current row) as up, row_number() over v as pos from labelled {V}) select vehicle_id, seq, label, case when label =
          'OSCILLATION_NOISE' and pos > 5 and net <= -greatest(1.2, 0.005 * capacity) and va > 0.00001 and -net >= 0.55 * va and up <= 2 then 'GRADUAL_CHANGE'
          else label end as state from g""", STEPS, PROFILE, AROUND, LABELS),
    "canonical_states": sql(f"select rule, {STATE} as state, count(*) as n from labelled group by 1, 2", STEPS, PROFILE, AROUND, LABELS),
    "canonical_names": sql("""
        select case seq % 8 when 0 then 'UPWARD_SHIFT_TRACKED' when 1 then 'DOWNWARD_SHIFT_TRACKED' when 3 then 'SPIKE_HELD' when 4 then 'UPWARD_REVERSAL_REJECTED' when 7 then
          'PENDING_UPWARD_SHIFT_HELD' else 'VALID' end as flag, case when seq % 8 in (0, 4) then 'MOVING' when seq % 8 in (1, 7) then 'LOW_MOTION' else 'UNCERTAIN' end as motion, count(*) as n
        from t group by 1, 2"""),
    "parsed_times": sql("""
        select vehicle_id, seq, case seq % 10 when 2 then us - us % 60000000 when 4 then us - us % 21600000000 when 6 then null when 7 then null when 8 then us - us % 86400000000
          else us - us % 1000000 end as read_us from t""", d=40),
    "state_names": sql(f"""
        select case {STATE} when 'STABLE_JITTER' then 'Stable' when 'OSCILLATION_NOISE' then 'Oscillation' when 'GRADUAL_CHANGE' then 'Gradual change' when
          'UPWARD_SHIFT' then 'Upward shift' when 'DOWNWARD_SHIFT' then 'Downward shift' else {STATE} end as state_name, count(*) as n from labelled group by 1""", STEPS, PROFILE, AROUND, LABELS),
    "repaired_coordinates": sql("select vehicle_id, seq, lat, lng from t"),
    "central_times": sql(f"""
        select vehicle_id, seq, us from (select *, max(case when rn = n // 2 + 1 then us end) over (partition by vehicle_id) as mid from (select *, count(*)
          over (partition by vehicle_id) as n, row_number() over v as rn from t {V})) where n <= 2 or abs(us - mid) <= 86400000000""", d=40),
    "nominal_period": sql("select vehicle_id, round(coalesce(quantile_cont(gap_min, 0.5) filter (gap_min > 0), 5.0), 6) + 0.0 as period from s group by 1", STEPS),
    "learnt_period": f"""
        with recursive {TELE.format(d=240)}{STEPS}, z as (select vehicle_id, gap_min, row_number() over v as i from s where gap_min between 0.25 and 15 {V}),
          f as (select distinct vehicle_id, 0::bigint as i, 5.0::double as x from t union all select z.vehicle_id, z.i, 0.8::double * f.x + 0.2::double *
          z.gap_min from f join z on z.vehicle_id = f.vehicle_id and z.i = f.i + 1) select vehicle_id, round(max_by(x, i), 6) + 0.0 as period from f group by 1""",
    "behaviour_checks": sql(f"""
        , m as (select vehicle_id, max(clean) - min(clean) as span, min(clean) as least, min_by(clean, (us, seq)) - max_by(clean, (us, seq)) as drop_,
          max(rise) as up, max_by(clean, (us, seq)) - max_by(fuel, (us, seq)) as lag_, max(abs(rise)) as step from (select *, round(clean - lag(clean) over
          v, 6) as rise from c {V}) group by 1), k as (select vehicle_id, round(span, 6) <= 120 as max_clean_span, up <= 6 as max_upward_step, round(lag_, 6) <=
          2.5 as max_final_lag_liters, step <= 8 as max_step_size, round(least, 6) >= 20 as min_clean_liters, cast(null as boolean) as
          min_valley_attenuation_liters, round(drop_, 6) >= 2 as min_total_clean_drop from m) select *, cast(max_clean_span::int + max_upward_step::int +
          max_final_lag_liters::int + max_step_size::int + min_clean_liters::int + min_total_clean_drop::int as bigint) as passed, 6::bigint as asked from k""", NOISY),
    "step_percentiles": sql("select vehicle_id, " + ", ".join(f"round(quantile_cont(abs_delta, {q / 100}), 6) + 0.0 as p{q}" for q in (50, 95, 99)) + ", round(avg(abs_delta), 6) + 0.0 as mean_step from s group by 1", STEPS),
    "active_contexts": sql(f"""
        , l as (select * from (select *, row_number() over (partition by vehicle_id order by us desc, seq desc) as rn from t) where rn = 1), k as (select l.*,
          case when capacity_liters > 0 and capacity_liters <> 850 then capacity_liters end as capacity from l left join vehicles using (vehicle_id)) select
          vehicle_id, us, fuel, capacity, round(greatest(0.5, coalesce(0.002 * capacity, 0)), 6) + 0.0 as noise_sigma from k""", VEHICLES),
    "vehicle_days": sql("""
        select vehicle_id, count(*) as points, min(us // 86400000000) as first_day, max(us // 86400000000) as last_day, count(distinct us // 86400000000) as
          days from t group by 1""", d=40),
    "largest_rise": sql(f"""
        , j as (select *, round(fuel - lag(fuel) over v, 6) as jump, row_number() over v - 1 as pos, count(*) over (partition by vehicle_id) as n from t {V}),
          b as (select *, row_number() over (partition by vehicle_id order by jump desc, pos) as rn from j where jump > 0) select vehicle_id, pos as at_pos,
          jump, greatest(0, pos - 30) as start_pos, least(n - 1, pos + 50) as end_pos from b where rn = 1"""),
    "nearest_point": sql("select vehicle_id, seq, us, fuel from (select *, row_number() over (partition by vehicle_id order by abs(us - 1704100000000000), us, seq) as rn from t) where rn = 1"),
    "recent_window": sql("select vehicle_id, seq, us from (select *, max(us) over (partition by vehicle_id) as top from t) where us >= top - 86400000000", d=40),
    "recent_spikes": sql("""
        select vehicle_id, seq, place from (select vehicle_id, seq, row_number() over (partition by vehicle_id order by us desc, seq desc) as place from c
          where abs(round(fuel - clean, 6)) > 4) where place <= 10""", NOISY),
    "level_ring": sql("""
        select vehicle_id, string_agg(cast(cast(round(fuel * 100) as bigint) as varchar), ',' order by us, seq) as ring from (select *, row_number() over
          (partition by vehicle_id order by us desc, seq desc) as rn from t where fuel > 0) where rn <= 12 group by 1"""),
    "segment_options": sql("""
        select *, row_number() over (partition by vehicle_id order by from_us, segment_id) as place from (select vehicle_id, cast(segment_id as bigint) as
          segment_id, min(us) as from_us, count(*) as points from s group by 1, 2)""", STEPS, d=40),
    "motion_speed": inline_haversine(sql(f"""
        select vehicle_id, seq, round(g, 3) + 0.0 as gps_speed, round(greatest(speed, g), 3) + 0.0 as motion_speed, case when speed <= 5 then 1.0::double when
          speed <= 40 then 2.0 when speed <= 70 then 1.5 else 2.5 end as noise_factor from (select *, case when gap_min > 0 then coalesce({FAR}, 0) / 1000 /
          (gap_min / 60) else 0 end as g from s {V})""", STEPS)),
    "row_stamps": sql("select vehicle_id, seq, sha256(concat_ws('|', vehicle_id, seq, us)) as stamp from t"),
    "offline_features": sql("""
        select vehicle_id, seq,
          round(fuel, 9) + 0.0 as FuelLevel,
          round(coalesce(fuel / nullif(capacity, 0), 0), 9) + 0.0 as FuelPct,
          round(speed, 9) + 0.0 as Speed,
          round(motion_speed, 9) + 0.0 as MotionSpeedKmh,
          round(gap0, 9) + 0.0 as TimeGapMinutes,
          round(d, 9) + 0.0 as DeltaFuel,
          round(coalesce(d / nullif(capacity, 0), 0), 9) + 0.0 as DeltaPct,
          round(abs(d), 9) + 0.0 as AbsDeltaFuel,
          round(d / sigma, 9) + 0.0 as DeltaOverNoise,
          round(std12, 9) + 0.0 as RollingStd12,
          round(coalesce(std12 / nullif(capacity, 0), 0), 9) + 0.0 as RollingStdPct,
          round(far, 9) + 0.0 as DistanceMeters,
          round(case when gap0 > 0 then far / 1000 / (gap0 / 60) else 0 end, 9) + 0.0 as GpsSpeedKmh,
          round(cast(lat is not null and lng is not null as double), 9) + 0.0 as HasGPS,
          round(capacity, 9) + 0.0 as capacity_est,
          round(sigma, 9) + 0.0 as noise_sigma_liters,
          round(flat, 9) + 0.0 as flat_jitter_threshold,
          round(spike, 9) + 0.0 as spike_threshold,
          round(event, 9) + 0.0 as event_threshold,
          round(prev3, 9) + 0.0 as PrevMedian3,
          round(next3, 9) + 0.0 as FutureMedian3,
          round(next5, 9) + 0.0 as FutureMedian5,
          round(return_level, 9) + 0.0 as ReturnToPrevLevel,
          round(range_m2p5, 9) + 0.0 as LocalRange5,
          round(range_pm3, 9) + 0.0 as LocalRange7,
          round(cast(is_peak as double), 9) + 0.0 as PeakReversalFlag,
          round(cast(is_valley as double), 9) + 0.0 as ValleyReversalFlag,
          round(transient_score, 9) + 0.0 as TransientScore
        from a""", STEPS, PROFILE, AROUND),
    "day_states": sql("""
        select vehicle_id, us // 86400000000 as day, count(*) as points, count(*) filter (label = 'STABLE_JITTER') as stable, string_agg(distinct label, ','
          order by label) as labels from labelled where label is not null group by 1, 2""", STEPS, PROFILE, AROUND, LABELS),
}
