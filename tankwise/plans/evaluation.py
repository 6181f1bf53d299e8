"""Queries of events, evaluation and offline filters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tankwise.operators import adaptive as A
from tankwise.operators import evaluation as E
from tankwise.operators import events as V
from tankwise.operators import feature_vector as V28
from tankwise.operators import forest, offline
from tankwise.operators import kpi as K
from tankwise.operators import profile as P
from tankwise.operators import serving as S
from tankwise.operators import windows as W
from tankwise.plans.oracles import AROUND, EPOCHS, LABELS, PLACES, PROFILE, STEPS, VEHICLES, recursive, sql
from tankwise.plans.queries import KEY, _labelled, r6
from tankwise.sources.adapter import GAPPY, telemetry, vehicles

CLASSES = [s for s, _ in S.SIGNAL_STATES]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_vehicles(V.shift_events(P.labelled(telemetry(spark, sf_dir))), vehicles(spark, sf_dir))


def shift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).withColumn("change_liters", r6("change_liters"))


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = V.newest_events(_events(spark, sf_dir), 3)
    return newest.select("vehicle_id", "event_type", "start_us", "end_us", F.col("place").cast("long").alias("place"))


def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = W.rounded(F.col("fuel") - F.avg("fuel").over(W.by_vehicle().rowsBetween(-7, 0)), 6)
    t = telemetry(spark, sf_dir).withColumn("kind", V.event_kind(off))
    return t.groupBy("vehicle_id", "kind").agg(F.count("*").alias("n"))


def fleet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fleet_summary(_labelled(spark, sf_dir), "label", "guess", CLASSES).withColumn("accuracy", r6("accuracy"))


def scoped_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.substring("vehicle_id", 2, 9).cast("int") % 4 == 0
    return E.scoped_matrix(_labelled(spark, sf_dir), "label", "guess", held_out)


def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _labelled(spark, sf_dir).where("label is not null").groupBy("label", "guess").agg(F.count("*").alias("n"))
    return E.score_report(t.withColumnRenamed("label", "actual"), "actual", "guess").select("label", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def axis_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumn("clean", W.rounded(F.avg("fuel").over(W.by_vehicle().rowsBetween(-7, 0)), 2))
    return S.axis_bounds(t, ["fuel", "clean"])


def collapsed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.labelled(telemetry(spark, sf_dir)).groupBy(S.known_state(F.col("label")).alias("state_code")).agg(F.count("*").alias("n"))


def segment_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.in_segment(W.steps(telemetry(spark, sf_dir, GAPPY)), 2)
    return t.groupBy("vehicle_id").agg(F.count("*").alias("points"), F.min("us").alias("first_us"))


def curve_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.by_vehicle()
    t = telemetry(spark, sf_dir).withColumns({"pos": F.row_number().over(w), "ma8": F.avg("fuel").over(w.rowsBetween(-7, 0)), "ma3": F.avg("fuel").over(w.rowsBetween(-2, 0))})
    return E.regression(t, t.where("pos % 10 > 0"), ["vehicle_id", "pos"], "ma8", "ma3").select("vehicle_id", r6("regression_mae").alias("regression_mae"), "unmatched")


def segment_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumn("row", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("us", "seq")) - 1)
    one = t.where("vehicle_id = 'V00001'").select("row", F.col("us").alias("time"), "fuel", "speed")
    segments = one.select((F.col("row") / 12).cast("int").alias("id"), (F.col("row") % 12).alias("pos"), (F.col("row") - F.col("row") % 12).alias("first_row"), "time", W.rounded("fuel", 2).alias("fuel"), (W.rounded("speed", 2) + F.when(F.col("row") % 25 == 7, 1).otherwise(0)).alias("speed"))
    return E.provenance(segments, one)


def vehicle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.log(telemetry(spark, sf_dir), "V00002", None, 1704999999000000, 100).select("vehicle_id", "seq", "us", "fuel")


def dropout_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.fill_dropouts(telemetry(spark, sf_dir)).select(*KEY, r6("cleaned").alias("cleaned"), "dropout")


def shape_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.flatten_bumps(telemetry(spark, sf_dir)).select(*KEY, r6("shape_clean").alias("shape_clean"))


def label_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.follow_labels(P.labelled(telemetry(spark, sf_dir))).select(*KEY, r6("followed").alias("followed"))


def online_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = F.when(F.col("capacity_liters") != 850, F.col("capacity_liters"))
    return V28.causal_by_capacity(telemetry(spark, sf_dir, GAPPY), vehicles(spark, sf_dir).select("vehicle_id", master.alias("capacity")), 9)


def enhanced_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.labelled(telemetry(spark, sf_dir, whole=True)).withColumn("segment_id", F.col("segment_id").cast("string"))
    return A.enhance(t.withColumnsRenamed({"flat": "jitter", "sigma": "noise", "std12": "rolling_std"}))


def segment_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replay(W.steps(telemetry(spark, sf_dir, GAPPY, whole=True)).drop("label"))


def trained(spark: SparkSession, sf_dir: str) -> forest.PipelineModel:
    """A forest that learnt from the labelled points of most vehicles."""
    t = forest.held_out(V28.offline(P.labelled(telemetry(spark, sf_dir, whole=True))))
    return forest.train(t.where("not held_out"), trees=60, depth=12)


def causal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forest that learnt from the labelled points of some vehicles says of the others' points as they come."""
    t = forest.held_out(telemetry(spark, sf_dir, whole=True)).where("held_out")
    return forest.predict_causal(trained(spark, sf_dir), t).select(*KEY, "state")


def predicted_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment with the model's states inside the causal step."""
    return replayed_with(spark, sf_dir, trained(spark, sf_dir))


def replayed_with(spark: SparkSession, sf_dir: str, model: forest.PipelineModel) -> DataFrame:
    t = S.resolve_capacity(W.steps(telemetry(spark, sf_dir, GAPPY, whole=True)), vehicles(spark, sf_dir, whole=True), F.lit(0.0))
    return E.replay_predicted(model, t)


def segment_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replay report's metrics and checks of each segment, for a moving average as the clean curve."""
    t = W.steps(telemetry(spark, sf_dir, GAPPY))
    of = W.Window.partitionBy("vehicle_id", "segment_id").orderBy("us", "seq")
    state = F.when(F.col("speed") > 5, "MOVING").otherwise("LOW_MOTION")
    checks = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in KPI_LIMITS.items()], F.array(F.lit(1)).alias("zero_dropout_indexes"), F.array(F.lit("MOVING"), F.lit("LOW_MOTION")).alias("required_motion_states"))
    t = t.withColumns({
        "id": F.concat_ws("/", "vehicle_id", F.col("segment_id").cast("string")), "pos": (F.row_number().over(of) - 1).cast("int"), "clean": F.when(F.col("fuel") == 0, F.lag("fuel").over(of)).otherwise(F.avg("fuel").over(of.rowsBetween(-7, 0))),
        "motion_state": state, "quality_flag": F.when(F.col("fuel") == 0, "ZERO_DROPOUT_HELD").otherwise("VALID"), "expected": F.when(F.col("seq") % 2 == 0, F.col("fuel")), "review_status": F.when(F.col("segment_id") % 2 == 0, "approved"), "checks": checks,
    })
    return K.segment_metrics(t)


KPI_LIMITS = {"max_clean_span": 60.0, "max_upward_step": 6.0, "max_final_lag_liters": 2.5, "max_step_size": 8.0, "min_clean_liters": 20.0, "min_valley_attenuation_liters": 5.0, "min_total_clean_drop": 2.0}


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).withColumn("clean", F.lag("fuel").over(W.by_vehicle()))
    return S.report(t.selectExpr("*", "fuel as raw", "cast(null as string) as address"))


def map_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.map_bounds(telemetry(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    shift_events, newest_events, event_kinds, fleet_summary, scoped_matrix, score_report, axis_bounds, collapsed_states, segment_scope, curve_regression,
      segment_provenance, vehicle_log, dropout_line, shape_clean,
    label_following, online_features, enhanced_levels, segment_replay, causal_states, predicted_replay, segment_kpis, report_rows, map_bounds,
)}

_EVENTS = """, runs as (
  select *, lag(us) over v as from_us, lag(fuel) over v as from_fuel, row_number() over v - row_number() over (partition by vehicle_id, label order by
    us, seq) as run from labelled window v as (partition by vehicle_id order by us, seq)
), ev as (
  select vehicle_id, case label when 'UPWARD_SHIFT' then 'REFUEL' else 'DRAIN' end as event_type, coalesce(min_by(from_us, (us, seq)), min(us)) as start_us, max(us) as end_us,
    coalesce(min_by(from_fuel, (us, seq)), min_by(fuel, (us, seq))) as start_fuel, max_by(fuel, (us, seq)) as end_fuel, arg_max_null(lat, (us, seq)) as lat, arg_max_null(lng, (us, seq)) as lng
  from runs where label in ('UPWARD_SHIFT', 'DOWNWARD_SHIFT') group by vehicle_id, label, run
), e as (
  select ev.*, vehicle_name from ev join vehicles using (vehicle_id)
)"""
_LABELLED = (STEPS, PROFILE, AROUND, LABELS)
_SCORES = """, sr_m as (
  select label as actual, guess, count(*) as n from labelled where label is not null group by 1, 2
), sr_r as (
  select actual as label, sum(n) as support, sum(case when actual = guess then n else 0 end) as hit from sr_m group by 1
), sr_p as (
  select guess as label, sum(n) as called from sr_m group by 1
), sr_j as (
  select coalesce(r.label, p.label) as label, coalesce(support, 0) as support, coalesce(hit, 0) as hit, coalesce(called, 0) as called from sr_r r full join sr_p p on r.label = p.label
), sr_k as (
  select *, case when called > 0 then hit / called else 0 end as precision, case when support > 0 then hit / support else 0 end as recall from sr_j
), sr_l as (
  select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from sr_k
), sr_w as (
  select label, support, precision, recall, f1 from sr_l
  union all select 'accuracy', sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support) from sr_l
  union all select 'macro avg', sum(support), avg(precision), avg(recall), avg(f1) from sr_l
  union all select 'weighted avg', sum(support), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) from sr_l
)"""
_V = "window v as (partition by vehicle_id order by us, seq)"

ORACLES = {
    "report_rows": sql(f""", c as (
          select *, row_number() over v as no, round(fuel, 2) as rl, round(coalesce(lag(fuel) over v, fuel), 2) as cl from t {_V}
        ), n as (
          select *, round(rl - cl, 2) as off from c
        ) select cast(no as int) as no, vehicle_id, us, rl as raw_liters, cl as clean_liters, off as noise_liters, case when abs(off) > 4 then 'Spike' when abs(off) > 1.5 then 'Sloshing' else 'Normal' end as signal,
          coalesce(speed, 0) as speed_kmh, coalesce(lat, 0) as lat, coalesce(lng, 0) as lng, '' as address from n"""),
    "map_bounds": sql("""select vehicle_id, count(*) as points, min(lat) as min_lat, max(lat) as max_lat, min(lng) as min_lng, max(lng) as max_lng
        from t where lat > 5 and lat < 30 and lng > 90 and lng < 120 group by 1"""),
    "shift_events": sql("""
        select vehicle_id, vehicle_name, event_type, start_us, end_us, start_fuel, end_fuel, round(end_fuel - start_fuel, 6) + 0.0 as change_liters, lat, lng
          from e""", *_LABELLED, VEHICLES, _EVENTS),
    "newest_events": sql(
        """select vehicle_id, event_type, start_us, end_us, place from (
        select *, row_number() over (partition by vehicle_id order by start_us desc, end_us desc, event_type) as place from e) where place <= 3""", *_LABELLED, VEHICLES, _EVENTS),
    "event_kinds": sql(f"""select vehicle_id, case when abs(off) > 10 then 'Burst' when abs(off) > 5 then 'Spike' else 'Dip' end as kind, count(*) as n from (
        select vehicle_id, round(fuel - avg(fuel) over (v rows between 7 preceding and current row), 6) as off from t {_V}) group by 1, 2"""),
    "fleet_summary": sql(
        """
        select vehicle_id, count(*) as total_rows, count(label) as valid_rows, round(coalesce(avg(case when label = guess then 1.0 else 0.0 end) filter (label
          is not null), 0), 6) + 0.0 as accuracy,"""
        + ", ".join(f"count(*) filter (label = '{c}') as {c.lower()}" for c in CLASSES) + " from labelled group by 1", *_LABELLED),
    "scoped_matrix": sql(
        """select scope, label, guess, count(*) as n from (
        select unnest(case when cast(substr(vehicle_id, 2) as int) % 4 = 0 then ['held_out', 'all'] else ['all'] end) as scope, label, guess from labelled where label is not null) group by 1, 2, 3""", *_LABELLED),
    "score_report": sql("""
        select label, cast(support as bigint) as support, round(precision, 6) + 0.0 as precision, round(recall, 6) + 0.0 as recall, round(f1, 6) + 0.0 as f1
          from sr_w""", *_LABELLED, _SCORES),
    "axis_bounds": sql(f""", c as (
          select vehicle_id, fuel, round(avg(fuel) over (v rows between 7 preceding and current row), 2) as clean from t {_V}
        ), b as (
          select vehicle_id, min(x) as lo, max(x) as hi from (select vehicle_id, fuel as x from c union all select vehicle_id, clean from c) where x > 0 group by 1
        ) select vehicle_id, greatest(0, cast(floor(lo - (hi - lo) * 0.1::double) as bigint)) as y_min, cast(ceil(hi + (hi - lo) * 0.1::double) as bigint) as y_max from b"""),
    "collapsed_states": sql("select coalesce(label, 'STABLE_JITTER') as state_code, count(*) as n from labelled group by 1", *_LABELLED),
    "segment_scope": sql("select vehicle_id, count(*) as points, min(us) as first_us from s where segment_id = 2 group by 1", STEPS, d=40),
    "curve_regression": sql(f""", c as (
          select vehicle_id, row_number() over v as pos, avg(fuel) over (v rows between 7 preceding and current row) as a, avg(fuel) over (v rows between 2 preceding and current row) as e from t {_V}
        ) select vehicle_id, round(avg(abs(a - e)) filter (pos % 10 > 0), 6) + 0.0 as regression_mae, cast(count(*) filter (pos % 10 = 0) as bigint) as unmatched from c group by 1"""),
    "segment_provenance": sql(f""", c as (
          select row_number() over v - 1 as r from t where vehicle_id = 'V00001' {_V}
        ) select cast(r // 12 as int) as id, count(*) as points, cast(count(*) filter (r % 25 <> 7) as bigint) as same from c group by 1"""),
    "vehicle_log": sql("select vehicle_id, seq, us, fuel from t where vehicle_id = 'V00002' and us <= 1704999999000000 order by us, seq limit 100"),
    "dropout_line": sql(f""", b as (
          select *, lag(fuel) over v as bf, lag(us) over v as bus from t {_V}
        ), o as (
          select b.*, case when bf - fuel >= 6 then (select min((x.us, x.seq, x.fuel)) from t x where x.vehicle_id = b.vehicle_id and (x.us, x.seq) > (b.us,
            b.seq) and x.us <= b.us + 21600000000 and x.fuel between b.bf - 5 and b.bf + 5) end as e from b
        ), q as (
          select *, e is not null and coalesce(us >= max(e[1]) over (v rows between unbounded preceding and 1 preceding), true) as real from o {_V}
        ), z as (
          select *, last_value(case when real then {{'us': us, 'seq': seq, 'a': bf, 'aus': bus, 'e': e}} end ignore nulls) over (v rows between unbounded preceding and current row) as s from q {_V}
        ), y as (
          select *, coalesce(us < s.e[1] or (us = s.e[1] and seq < s.e[2]), false) as inside from z
        ) select vehicle_id, seq, round(case when inside then s.a + (us - s.aus) / (s.e[1] - s.aus) * (s.e[3] - s.a) else fuel end, 6) + 0.0 as cleaned,
          case when inside then case when count(*) over (partition by vehicle_id, inside, s.us, s.seq) = 1 then 'SPIKE' else 'SENSOR_DROPOUT' end end as dropout from y"""),
    "shape_clean": sql(f""", b as (
          select *, list_median(list(fuel) over (v rows between 25 preceding and 1 preceding)) as base, list(fuel) over (v rows between 1 following and 13 following) as ah from t {_V}
        ) select vehicle_id, seq, round(case when coalesce(abs(fuel - base) >= 2 and len(list_filter(range(3, 13), lambda i: abs(ah[i] - base) <= 1 and abs(ah[i + 1] - base) <= 1)) > 0, false) then base else fuel end, 6) + 0.0 as shape_clean from b"""),
    "label_following": sql(
        """, z as (
          select vehicle_id, seq, fuel, rule, row_number() over (partition by vehicle_id order by us, seq) as i from labelled
        ), f as (
          select vehicle_id, seq, i, case when fuel > 0 then fuel end as x, case when rule = 'DRAIN' then 1 else 0 end as falls from z where i = 1
          union all
          select z.vehicle_id, z.seq, z.i, case when f.x is null then case when z.fuel > 0 then z.fuel end when z.fuel > 0 and not (z.rule = 'CONSUMPTION' and z.fuel > f.x) then f.x + (z.fuel - f.x) *
            case when z.rule = 'DRAIN' then least(0.92::double, 0.45::double + 0.235::double * f.falls) when z.rule in ('SPIKE', 'TRANSIENT_UP_NOISE',
              'TRANSIENT_DOWN_NOISE') then 0 when z.rule = 'STABLE_JITTER' then 0.12::double
            when z.rule = 'SLOSHING_NOISE' then 0.08::double when z.rule = 'CONSUMPTION' then 0.58::double when z.rule = 'REFUEL' then 1 else 0.25::double end
              else f.x end, case when z.rule = 'DRAIN' then f.falls + 1 else 0 end
          from f join z on z.vehicle_id = f.vehicle_id and z.i = f.i + 1
        ) select vehicle_id, seq, round(x, 6) + 0.0 as followed from f""", *_LABELLED).replace("with", "with recursive", 1),
    "online_features": recursive("""
        , x as (
          select m.*, case when capacity_liters > 0 and capacity_liters <> 850 then capacity_liters end as cap, list(fuel) over (partition by m.vehicle_id, epoch order by us, seq rows between 12 preceding and current row) as ls,
            row_number() over (partition by m.vehicle_id, epoch order by us, seq) as nth from m left join vehicles using (vehicle_id) where fuel > 0
        ), y as (
          select *, case when len(ls) > 1 then fuel - ls[-2] else 0 end as df, case when len(ls) >= 3 then list_aggregate(ls, 'stddev_pop') else 0 end as sd from x where epoch > 1 or nth > 1
        ) select vehicle_id, seq, epoch,
          round(fuel, 9) + 0.0 as FuelLevel,
          round(coalesce(fuel / cap, 0), 9) + 0.0 as FuelPct,
          round(speed, 9) + 0.0 as Speed,
          round(speed, 9) + 0.0 as MotionSpeedKmh,
          round(greatest(since_min, 0.1), 9) + 0.0 as TimeGapMinutes,
          round(df, 9) + 0.0 as DeltaFuel,
          round(coalesce(df / cap, 0), 9) + 0.0 as DeltaPct,
          round(abs(df), 9) + 0.0 as AbsDeltaFuel,
          round(df / greatest(0.5, 0.002 * coalesce(cap, 0)), 9) + 0.0 as DeltaOverNoise,
          round(sd, 9) + 0.0 as RollingStd12,
          round(coalesce(sd / cap, 0), 9) + 0.0 as RollingStdPct,
          round(displacement, 9) + 0.0 as DistanceMeters,
          round(speed, 9) + 0.0 as GpsSpeedKmh,
          round(cast(places > 0 as double), 9) + 0.0 as HasGPS,
          round(coalesce(cap, 0), 9) + 0.0 as capacity_est,
          round(greatest(0.5, 0.002 * coalesce(cap, 0)), 9) + 0.0 as noise_sigma_liters,
          round(greatest(0.8, 0.003 * coalesce(cap, 0)), 9) + 0.0 as flat_jitter_threshold,
          round(greatest(3.0, 0.012 * coalesce(cap, 0)), 9) + 0.0 as spike_threshold,
          round(greatest(6.0, 0.035 * coalesce(cap, 0)), 9) + 0.0 as event_threshold,
          round(list_median(ls[-3:]), 9) + 0.0 as PrevMedian3,
          round(list_median(ls[-3:]), 9) + 0.0 as FutureMedian3,
          round(list_median(ls[-3:]), 9) + 0.0 as FutureMedian5,
          round(0::double, 9) + 0.0 as ReturnToPrevLevel,
          round(list_max(ls[-5:]) - list_min(ls[-5:]), 9) + 0.0 as LocalRange5,
          round(list_max(ls[-7:]) - list_min(ls[-7:]), 9) + 0.0 as LocalRange7,
          round(0::double, 9) + 0.0 as PeakReversalFlag,
          round(0::double, 9) + 0.0 as ValleyReversalFlag,
          round(0::double, 9) + 0.0 as TransientScore
        from y""", EPOCHS, PLACES, VEHICLES, d=40),
    "segment_kpis": sql("""
        , p as (
          select *, vehicle_id || '/' || segment_id as id, row_number() over w - 1 as pos, case when fuel = 0 then lag(fuel) over w else avg(fuel) over (partition by vehicle_id, segment_id order by us, seq rows between 7 preceding and current row) end as clean
          from s window w as (partition by vehicle_id, segment_id order by us, seq)
        ), q as (
          select *, lag(clean) over w as was, round(clean - lag(clean) over w, 6) as rise, case when fuel > 0 then fuel end as raw, case when fuel > 0 then clean end as valid,
            case when fuel > 0 then sum(case when fuel > 0 then 1 else 0 end) over w end as i from p window w as (partition by vehicle_id, segment_id order by us, seq)
        ), m as (
          select id, case when any_value(segment_id) % 2 = 0 then 'approved' end as review_status, count(*) as points, case when count(raw) >= 2 then stddev_pop(raw) else 0 end as raw_std,
            case when count(clean) >= 2 then stddev_pop(clean) else 0 end as clean_std, case when count(raw) >= 3 then stddev_pop(raw) * sqrt(greatest(0, 1 - coalesce(regr_r2(raw, i), 0))) else 0 end as raw_detrended_std,
            case when count(valid) >= 3 then stddev_pop(valid) * sqrt(greatest(0, 1 - coalesce(case when stddev_pop(valid) > 0 then regr_r2(valid, i) end, 0))) else 0 end as clean_detrended_std,
            coalesce(max(raw) - min(raw), 0) as raw_range, coalesce(max(clean) - min(clean), 0) as clean_range, avg(abs(valid - raw)) as mae, max_by(clean, pos) filter (clean is not null) as last_of,
            first(fuel order by pos) as f0, last(fuel order by pos) as f1, first(clean order by pos) as c0, last(clean order by pos) as c1, count(*) filter (speed > 5 and rise > 0.01) as moving_upward_steps,
            avg(abs(clean - coalesce(case when seq % 2 = 0 then fuel end, clean))) as regression_mae, coalesce(max(rise), 0) as up, coalesce(max(abs(rise)), 0) as step, min(clean) as least, min(fuel) as least_raw,
            count(*) filter (fuel = 0 and clean is not distinct from was and pos = 1) as held, count(*) filter (speed > 5) as fast, count(*) filter (speed <= 5) as slow from q group by id
        ), k as (
          select *, round(clean_range, 6) <= 60 as max_clean_span, up <= 6 as max_upward_step, coalesce(round(c1 - f1, 6) <= 2.5, false) as max_final_lag_liters, step <= 8 as max_step_size, coalesce(round(least, 6) >= 20, false) as min_clean_liters,
            coalesce(round(least - least_raw, 6) >= 5, false) as min_valley_attenuation_liters, coalesce(round(c0 - c1, 6) >= 2, false) as min_total_clean_drop, held = 1 as zero_dropout_indexes, fast > 0 and slow > 0 as required_motion_states from m
        ) select id, review_status, points, round(raw_std, 6) + 0.0 as raw_std, round(clean_std, 6) + 0.0 as clean_std, round(raw_detrended_std, 6) + 0.0 as raw_detrended_std, round(clean_detrended_std, 6) + 0.0 as clean_detrended_std,
          round(case when round(raw_detrended_std, 6) > 0 then 100 * (1 - clean_detrended_std / raw_detrended_std) else 0 end, 3) + 0.0 as noise_reduction_percent, round(raw_range, 3) + 0.0 as raw_range, round(clean_range, 3) + 0.0 as clean_range,
          round(greatest(0, raw_range - clean_range), 3) + 0.0 as spike_attenuation, round(case when f0 - f1 >= 2 then greatest(0, c1 - f1) end, 3) + 0.0 as downtrend_lag, round(case when raw_range <= 1 then mae end, 6) + 0.0 as stable_level_mae,
          round(regression_mae, 6) + 0.0 as regression_mae, moving_upward_steps, max_clean_span, max_upward_step, max_final_lag_liters, max_step_size, min_clean_liters, min_valley_attenuation_liters, min_total_clean_drop, zero_dropout_indexes,
          required_motion_states, cast(max_clean_span::int + max_upward_step::int + max_final_lag_liters::int + max_step_size::int + min_clean_liters::int + min_valley_attenuation_liters::int + min_total_clean_drop::int + zero_dropout_indexes::int
          + required_motion_states::int as bigint) as checks_passed, 9::bigint as checks_total from k""", STEPS, d=40),
}
