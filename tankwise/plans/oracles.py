"""DuckDB SQL of the queries in tankwise.plans.queries, on the same tables."""

from __future__ import annotations

TELE = """
raw as (
  select event_id as seq, user_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k, epoch_us(ts) as raw_us from events
), sped as (
  select *, case when event_type in ('purchase', 'view', 'click') then k else 0 end as sp,
    case when event_type = 'purchase' and k < 10 then 6000 when event_type = 'signup' and k < 10 then -4500 else -30 end as st,
    case when event_type = 'click' and k >= 90 then -2500 when event_type = 'view' then 6 * (k - 50) else k % 7 - 3 end as noise from raw
), summed as (
  select *, sum(st) over u as lvl, sum(case when sp > 5 then 40 * sp else k % 5 - 2 end) over u as la, sum(case when sp > 5 then 25 * sp else k % 3 - 1 end) over u as lo
  from sped window u as (partition by user_id order by raw_us, seq rows between unbounded preceding and current row)
), t as (
  select 'V' || lpad(cast(user_id as varchar), 5, '0') as vehicle_id, seq, 1704067200000000 + (raw_us - 1704067200000000) // {d} as us,
    cast(case when event_type = 'error' and k < 25 then 0 else greatest(2000, 40000 + lvl + noise) end as double) / 100 as fuel, cast(sp as double) as speed,
    case when k % 17 <> 0 then (21000000 + la) / 1000000.0::double end as lat, case when k % 17 <> 0 then (105000000 + 1000 * user_id + lo) / 1000000.0::double end as lng from summed
)"""

STEPS = """, lagged as (
  select *, (us - lag(us) over v) / 60000000.0::double as gap_min, fuel - lag(fuel) over v as delta, abs(fuel - lag(fuel) over v) as abs_delta from t
    window v as (partition by vehicle_id order by us, seq)
), s as (
  select *, 1 + sum(case when gap_min > 30 then 1 else 0 end) over (partition by vehicle_id order by us, seq rows between unbounded preceding and current row) as segment_id from lagged
)"""

#: The reset rule as a walk over each vehicle's points: the time of the last point of any kind once a level was seen, and the epoch.
EPOCHS = """, numbered as (
  select *, row_number() over (partition by vehicle_id order by us, seq) as i from t
), walk as (
  select vehicle_id, i, case when fuel > 0 then us end as last_us, case when fuel > 0 then 1 else 0 end as epoch from numbered where i = 1
  union all
  select n.vehicle_id, n.i, case when w.epoch > 0 or n.fuel > 0 then n.us end,
    case when w.epoch = 0 then case when n.fuel > 0 then 1 else 0 end when n.fuel > 0 and n.us - w.last_us > 1800000000 then w.epoch + 1 else w.epoch end
  from walk as w join numbered as n on n.vehicle_id = w.vehicle_id and n.i = w.i + 1
), e as (
  select n.*, cast(epoch as bigint) as epoch, lag(epoch) over v as of_epoch, (us - lag(last_us) over v) / 60000000.0::double as since_min,
    sum(case when fuel > 0 then 1 else 0 end) over (partition by n.vehicle_id, epoch order by us, seq) as no
  from numbered as n join walk using (vehicle_id, i) window v as (partition by n.vehicle_id order by us, seq)
)"""

#: Coordinates up to each point: of the four points before those of the epoch that was open then, and the own.
PLACES = """, placed as (
  select *, lat between -90 and 90 and lng between -180 and 180 and not (lat = 0 and lng = 0) as known from e
), c as (
  select *, list_filter(list_append(list_filter(list({'lat': lat, 'lng': lng, 'epoch': epoch, 'known': known}) over (partition by vehicle_id order by us, seq rows between 4 preceding and 1 preceding),
    lambda p: p.epoch = of_epoch and of_epoch > 0), {'lat': lat, 'lng': lng, 'epoch': epoch, 'known': known}), lambda p: p.known) as c from placed
), m as (
  select *, len(c) as places, case when len(c) >= 2 then hav(c[1].lat, c[1].lng, c[-1].lat, c[-1].lng) else 0 end as displacement,
    coalesce(list_max(list_transform(c, lambda p: hav(p.lat, p.lng, list_avg(list_transform(c, lambda q: q.lat)), list_avg(list_transform(c, lambda q: q.lng))))), 0) as radius from c
)"""

VEHICLES = """, vehicles as (
  select 'V' || lpad(cast(c_custkey as varchar), 5, '0') as vehicle_id, c_name as vehicle_name, cast(case when c_custkey % 5 = 0 then null when
    c_custkey % 7 = 0 then 850.0 else 300.0 + (c_custkey % 11) * 20 end as double) as capacity_liters, c_nationkey from customer
)"""

PROFILE = """, pd as (
  select vehicle_id, fuel, abs(fuel - lag(fuel) over (partition by vehicle_id order by us, seq)) as d from t
), p1 as (
  select vehicle_id, quantile_cont(fuel, 0.995) filter (fuel > 0) as cap, max(fuel) as top, quantile_cont(d, 0.6) as cut from pd group by 1
), p2 as (
  select vehicle_id, 1.4826 * quantile_cont(d, 0.5) as s from pd join p1 using (vehicle_id) where d <= cut group by 1
), p3 as (
  select vehicle_id, coalesce(cap, case when top > 0 then top end, 200.0) as capacity, s from p1 left join p2 using (vehicle_id)
), p4 as (
  select vehicle_id, capacity, case when s > 0 then s else greatest(0.5, 0.002 * capacity) end as sigma from p3
), profile as (
  select *, greatest(0.5, 0.003 * capacity, 2 * sigma) as flat, greatest(2.0, 0.012 * capacity, 4 * sigma) as spike, greatest(5.0, 0.035 * capacity, 8 * sigma) as event from p4
)"""

AROUND = """, profiled as (
  select s.*, capacity, sigma, flat, spike, event from s join profile using (vehicle_id)
), a1 as (
  select *, coalesce(delta, 0) as d, coalesce(lag(delta) over v, 0) as prev_d, coalesce(lag(fuel) over v, fuel) as prev, coalesce(lag(fuel, 2) over v,
    lag(fuel) over v, fuel) as prev2, lead(fuel) over v as nxt,
    case when gap_min > 0 and gap_min <= 1440 then gap_min else 0 end as gap0, coalesce(hav(lag(lat) over v, lag(lng) over v, lat, lng), 0) as far,
    list_filter([lag(fuel, 3) over v, lag(fuel, 2) over v, lag(fuel) over v], lambda x: x is not null) as bef,
    list_filter([lead(fuel) over v, lead(fuel, 2) over v, lead(fuel, 3) over v], lambda x: x is not null) as aft3,
    list_filter([lead(fuel) over v, lead(fuel, 2) over v, lead(fuel, 3) over v, lead(fuel, 4) over v, lead(fuel, 5) over v], lambda x: x is not null) as aft5,
    list_filter([lag(delta, 3) over v, lag(delta, 2) over v, lag(delta) over v, delta, lead(delta) over v, lead(delta, 2) over v, lead(delta, 3) over v], lambda x: abs(x) > flat) as moves,
    count(fuel) over (v rows between 2 preceding and 5 following) as n8, max(fuel) over (v rows between 2 preceding and 5 following) - min(fuel) over (v
      rows between 2 preceding and 5 following) as r8,
    count(fuel) over (v rows between 3 preceding and 3 following) as n7, max(fuel) over (v rows between 3 preceding and 3 following) - min(fuel) over (v
      rows between 3 preceding and 3 following) as r7,
    case when count(fuel) over (v rows between 11 preceding and current row) >= 2 then stddev_pop(fuel) over (v rows between 11 preceding and current row) else 0 end as std12
  from profiled window v as (partition by vehicle_id order by us, seq)
), a2 as (
  select *, coalesce(list_median(bef), fuel) as prev3, coalesce(list_median(aft3), fuel) as next3, coalesce(list_median(aft5), fuel) as next5, case when
    n8 >= 5 then r8 else 0 end as range_m2p5, case when n7 >= 3 then r7 else 0 end as local_range,
    len(list_filter(range(1, len(moves)), lambda i: sign(moves[i]) <> sign(moves[i + 1]))) as sign_changes, greatest(speed, case when gap0 > 0 then far /
      1000 / (gap0 / 60) else 0 end) as motion_speed from a1
), a as (
  select *, abs(next5 - prev3) as return_level, case when n7 >= 5 then r7 else range_m2p5 end as range_pm3, cast(coalesce(d > 1.5 * flat and nxt - fuel < -1.5 * flat, false) as int) as is_peak,
    cast(coalesce(d < -1.5 * flat and nxt - fuel > 1.5 * flat, false) as int) as is_valley,
    case when range_m2p5 > 0 then greatest(0, 1 - abs(next5 - prev3) / greatest(range_m2p5, 0.000001)) else 0 end as transient_score from a2
)"""

LABELS = """, parts as (
  select *, greatest(5.0, 0.03 * capacity) as low, abs(next3 - prev) <= greatest(flat, 0.25 * abs(d)) as returns, abs(next5 - fuel) <= greatest(flat,
    0.25 * abs(d)) as holds, greatest(1.75 * flat, 2 * sigma, 0.8) as band,
    std12 > greatest(spike, 2.2 * flat, 4 * sigma) or (local_range >= event and sign_changes >= 2) or (local_range >= greatest(1.4 * spike, 4 * flat) and std12 > 2 * flat) as wild,
    prev_d <= -spike and d >= spike and abs(fuel - prev2) <= greatest(2 * flat, 0.35 * abs(prev_d)) as recovers,
    range_m2p5 >= greatest(0.6 * event, 1.2 * spike, 4 * flat) and return_level <= greatest(2.5 * flat, 0.3 * range_m2p5) and abs(fuel - prev3) >=
      greatest(0.8 * spike, 3 * flat) and abs(d) < greatest(1.25 * event, range_m2p5) as bump from a
), ruled as (
  select *, case when fuel <= 0 then 'INVALID' when prev <= low and d >= event then 'UNKNOWN' when fuel <= low and prev > greatest(30.0, 0.2 * capacity) then 'DROPOUT'
    when bump and fuel > prev3 then 'TRANSIENT_UP_NOISE' when bump and fuel < prev3 then 'TRANSIENT_DOWN_NOISE' when recovers or (abs(d) >= spike and returns) then 'SPIKE'
    when d >= event and holds then 'REFUEL' when d <= -event and holds and fuel > low then 'DRAIN' when wild and abs(d) < event then 'SLOSHING_NOISE'
    when d < -0.5 * flat and motion_speed > 3 and abs(d) < event then 'CONSUMPTION' when abs(d) <= band and std12 <= greatest(2 * band, 3 * sigma) then
      'STABLE_JITTER' else 'UNKNOWN' end as rule from parts
), labelled as (
  select *, case rule when 'REFUEL' then 'UPWARD_SHIFT' when 'DRAIN' then 'DOWNWARD_SHIFT' when 'CONSUMPTION' then 'GRADUAL_CHANGE' when 'STABLE_JITTER'
    then 'STABLE_JITTER' when 'INVALID' then null when 'UNKNOWN' then null else 'OSCILLATION_NOISE' end as label,
    case when abs_delta <= 1 then 'STABLE_JITTER' when delta > 10 then 'UPWARD_SHIFT' when delta < -10 then 'DOWNWARD_SHIFT' when delta < 0 and speed > 5
      then 'GRADUAL_CHANGE' else 'OSCILLATION_NOISE' end as guess from ruled
)"""


def inline_haversine(text: str) -> str:
    """hav(a, b, c, d) written out; DuckDB views have no macros here."""
    import re

    def once(m: re.Match) -> str:
        depth, parts, cur = 0, [], ""
        body = m.string[m.end() :]
        for n, ch in enumerate(body):
            if ch in "([{":
                depth += 1
            if ch in ")]}":
                if depth == 0 and ch == ")":
                    parts.append(cur)
                    break
                depth -= 1
            if ch == "," and depth == 0:
                parts.append(cur)
                cur = ""
            else:
                cur += ch
        a, b, c, d = (p.strip() for p in parts)
        h = f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))"
        return f"(12742000 * atan2(sqrt({h}), sqrt(1 - {h})))" + body[n + 1 :]

    while m := re.search(r"\bhav\(", text):
        text = text[: m.start()] + once(m)
    return text


def sql(body: str, *parts: str, d: int = 240) -> str:
    return inline_haversine(f"with {TELE.format(d=d)}{''.join(parts)} {body}")


def recursive(body: str, *parts: str, d: int = 240) -> str:
    return sql(body, *parts, d=d).replace("with", "with recursive", 1)


V = "window v as (partition by vehicle_id order by us, seq)"

ORACLES = {
    "segment_noise": sql("""
        select vehicle_id, segment_id, count(*) as points, round(avg(rolling), 4) + 0.0 as mean_rolling_std, round(max(rolling), 4) + 0.0 as max_rolling_std
          from (select *, case when count(fuel) over g >= 2 then stddev_pop(fuel) over g else 0 end as rolling from s window g as (partition by vehicle_id,
          segment_id order by us, seq rows between 11 preceding and current row)) group by 1, 2""", STEPS, d=40),
    "telemetry_points": sql("select vehicle_id, seq, us, fuel, speed, lat, lng from t"),
    "point_steps": sql(
        """select vehicle_id, seq, us - lag(us) over (partition by vehicle_id order by us, seq) as gap_us, case when gap_min > 0 and gap_min <= 1440 then us - lag(us) over (partition by vehicle_id order by us, seq) else 0 end as offline_gap_us,
        round(delta, 6) + 0.0 as delta, round(abs_delta, 6) + 0.0 as abs_delta, cast(segment_id as bigint) as segment_id from s""", STEPS, d=40),
    "trend_window": recursive(
        """, v6 as (
          select *, abs(fuel - lag(fuel) over v) as st, fuel - first_value(fuel) over w as net, count(fuel) over w as n, stddev_pop(fuel) over w as sd, max(fuel) over w - min(fuel) over w as rg
          from e where fuel > 0 window v as (partition by vehicle_id, epoch order by us, seq), w as (partition by vehicle_id, epoch order by us, seq rows between 5 preceding and current row)
        ), tv as (
          select *, case when n > 1 then coalesce(sum(st) over (partition by vehicle_id, epoch order by us, seq rows between 4 preceding and current row), 0) else 0 end as variation from v6
        ), td as (
          select *, case when variation > 0.000001 then abs(net) / variation else 0 end as dr from tv
        ) select vehicle_id, seq, epoch, round(net, 6) + 0.0 as net, round(variation, 6) + 0.0 as variation, round(dr, 6) + 0.0 as directionality, round(case when n
          >= 3 then sd else 0 end, 6) + 0.0 as window_std,
        round(rg, 6) + 0.0 as window_range, net <= -1.5 and dr >= 0.65 as directional_down from td""", EPOCHS, d=40),
    "online_deviation": recursive(
        """select vehicle_id, seq, epoch, round(case when count(fuel) over w >= 3 then stddev_pop(fuel) over w else 0 end, 6) + 0.0 as online_std
        from e where fuel > 0 window w as (partition by vehicle_id, epoch order by us, seq rows between 12 preceding and current row)""", EPOCHS, d=40),
    "look_around": sql(
        """select vehicle_id, seq, round(prev3, 6) + 0.0 as prev3, round(next3, 6) + 0.0 as next3, round(next5, 6) + 0.0 as next5, round(range_pm3, 6) + 0.0 as range_pm3, round(range_m2p5, 6) + 0.0 as range_m2p5,
        round(return_level, 6) + 0.0 as return_level, round(transient_score, 6) + 0.0 as transient_score, cast(sign_changes as bigint) as sign_changes, is_peak, is_valley from a""", STEPS, PROFILE, AROUND),
    "moving_average": sql(f"""
        select vehicle_id, seq, round(avg(fuel) over (v rows between 7 preceding and current row), 6) + 0.0 as ma8, round(quantile_cont(fuel, 0.5) over (v
          rows between 2 preceding and current row), 6) + 0.0 as median3, round(max(fuel) over (v rows between 4 preceding and current row) - min(fuel) over (v
          rows between 4 preceding and current row), 6) + 0.0 as range5, round(max(fuel) over (v rows between 6 preceding and current row) - min(fuel) over (v
          rows between 6 preceding and current row), 6) + 0.0 as range7 from t {V}"""),
    "gap_threshold": sql(f"""
        select vehicle_id, seq, round(greatest(3 * quantile_cont(gap_min, 0.5) over (v rows between 19 preceding and current row), 5.0), 6) + 0.0 as
          threshold, coalesce(gap_min > greatest(3 * quantile_cont(gap_min, 0.5) over (v rows between 19 preceding and current row), 5.0) and speed > 5, false)
          as suspicious from s {V}""", STEPS),
    "acceleration": sql("""
        select vehicle_id, seq, round((speed - lag(speed) over g) / 3.6 / (greatest((us - lag(us) over g) / 60000000.0::double, 1.0) * 60), 6) + 0.0 as
          acceleration from s window g as (partition by vehicle_id, segment_id order by us, seq)""", STEPS, d=40),
    "robust_noise": recursive(
        """, h as (
          select vehicle_id, seq, fuel, (select list(b.fuel order by b.no) from e b where b.vehicle_id = k.vehicle_id and b.epoch = k.epoch and b.fuel > 0 and b.no > k.no - (k.fuel >
            0)::int - 12 and b.no <= k.no - (k.fuel > 0)::int) as past from e as k
        ), g as (
          select *, list_transform(range(1, len(past)), lambda i: past[i + 1] - past[i]) as ds from h
        ) select vehicle_id, seq, round(case when len(past) >= 3 then greatest(0.5, 1.4826 * list_median(list_transform(ds, lambda x: abs(x - list_median(ds))))) else 0.5 end, 6) + 0.0 as noise from g""", EPOCHS, d=40),
    "golden_candidates": sql("""
        select vehicle_id, min(pos) filter (b = 3 and f = 3 and p - c >= 8 and abs(fo - p) <= 3) as valley_pos, min(pos) filter (n = 12 and fast >= 0.75 and
          fuel - e >= 8 and calm >= 0.75) as consumption_pos, min(pos) filter (n = 12 and sd >= 3 and abs(e - fuel) <= 3) as noise_pos from (select *,
          quantile_cont(fuel, 0.5) over (v rows between 3 preceding and 1 preceding) as p, quantile_cont(fuel, 0.5) over (v rows between current row and 2
          following) as c, quantile_cont(fuel, 0.5) over (v rows between 3 following and 5 following) as fo, count(fuel) over (v rows between 3 preceding and 1
          preceding) as b, count(fuel) over (v rows between 3 following and 5 following) as f, count(fuel) over w as n, last_value(fuel) over w as e, avg(case
          when speed > 5 then 1.0 else 0.0 end) over w as fast, avg(case when abs_delta <= 1.5 then 1.0 else 0.0 end) over (v rows between 1 following and 11
          following) as calm, stddev_samp(fuel) over w as sd from (select *, row_number() over (partition by vehicle_id order by us, seq) - 1 as pos from s)
          window v as (partition by vehicle_id order by us, seq), w as (partition by vehicle_id order by us, seq rows between current row and 11 following))
          group by 1""", STEPS),
    "vehicle_profile": sql("""
        select vehicle_id, round(capacity, 9) + 0.0 as capacity, round(sigma, 9) + 0.0 as sigma, round(flat, 9) + 0.0 as flat, round(spike, 9) + 0.0 as spike,
          round(event, 9) + 0.0 as event from profile""", PROFILE),
    "heuristic_labels": sql("select vehicle_id, seq, rule, label from labelled", STEPS, PROFILE, AROUND, LABELS),
    "label_counts": sql("select label, count(*) as n from labelled group by 1", STEPS, PROFILE, AROUND, LABELS),
    "confusion": sql("""
        select vehicle_id, label, guess, count(*) as n from labelled where label is not null group by grouping sets ((vehicle_id, label, guess), (label,
          guess))""", STEPS, PROFILE, AROUND, LABELS),
    "label_scores": sql("""
        , m as (select label, guess, count(*) as n from labelled where label is not null group by 1, 2), r as (select label, sum(n) as support, sum(case when
          label = guess then n else 0 end) as hit from m group by 1), p as (select guess as label, sum(n) as called from m group by 1), j as (select
          coalesce(r.label, p.label) as label, coalesce(support, 0) as support, coalesce(hit, 0) as hit, coalesce(called, 0) as called from r full join p on
          r.label = p.label), k as (select *, case when called > 0 then hit / called else 0 end as precision, case when support > 0 then hit / support else 0
          end as recall from j) select label, cast(support as bigint) as support, cast(called as bigint) as called, round(precision, 6) + 0.0 as precision,
          round(recall, 6) + 0.0 as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) + 0.0 as f1
          from k""", STEPS, PROFILE, AROUND, LABELS),
    "balanced_sample": sql("""
        , bl as (
          select vehicle_id, seq, label, row_number() over (partition by label order by md5(vehicle_id || '|' || cast(seq as varchar)), us) as rn, count(*) over (partition by label) as size from labelled where label is not null
        ) select vehicle_id, seq, label, cast(unnest(generate_series(1, case when label in ('UPWARD_SHIFT', 'DOWNWARD_SHIFT') and size < 150 then 150 // size + case when rn <= 150 % size then 1 else 0 end else 1 end)) as int) as copy
          from bl where label <> 'STABLE_JITTER' or rn <= 300""", STEPS, PROFILE, AROUND, LABELS),
    "state_transitions": sql("""
        select was, label, count(*) as n from (select label, lag(label) over (partition by vehicle_id order by us, seq) as was from labelled) where was is not
          null and label is not null group by 1, 2""", STEPS, PROFILE, AROUND, LABELS),
    "curve_quality": sql("""
        , c as (select vehicle_id, us, seq, speed, fuel, avg(fuel) over (partition by vehicle_id order by us, seq rows between 7 preceding and current row) as
          clean, row_number() over (partition by vehicle_id order by us, seq) - 1 as pos from t), c2 as (select *, clean - lag(clean) over (partition by
          vehicle_id order by pos) as rise from c), l as (select vehicle_id, regr_slope(fuel, pos) as rm, regr_intercept(fuel, pos) as rb, regr_slope(clean,
          pos) as cm, regr_intercept(clean, pos) as cb from c2 group by 1) select vehicle_id, round(greatest(0, (max(fuel) - min(fuel)) - (max(clean) -
          min(clean))), 4) + 0.0 as spike_attenuation, round(case when max(fuel) - min(fuel) <= 1 then avg(abs(fuel - clean)) end, 4) + 0.0 as level_mae,
          round(avg(abs(rise)), 4) + 0.0 as mean_step, round(case when min_by(fuel, pos) - max_by(fuel, pos) >= 2 then greatest(max_by(clean, pos) -
          max_by(fuel, pos), 0) end, 4) + 0.0 as final_lag, cast(sum(case when rise > 0.01 and speed > 5 then 1 else 0 end) as bigint) as moving_rises,
          round(case when stddev_pop(fuel - (rm * pos + rb)) > 0 then 100 * (1 - stddev_pop(clean - (cm * pos + cb)) / stddev_pop(fuel - (rm * pos + rb))) else
          0 end, 4) + 0.0 as noise_reduction from c2 join l using (vehicle_id) group by 1"""),
    "kalman_end": "with recursive " + TELE.format(d=240) + """
        , z as (select vehicle_id, fuel, row_number() over (partition by vehicle_id order by us, seq) as i from t where fuel > 0), f as (select vehicle_id, i,
          fuel as x, 9.0::double as p from z where i = 1 union all select z.vehicle_id, z.i, f.x + (f.p + 0.5) / (f.p + 12.5) * (z.fuel - f.x), (1 - (f.p + 0.5)
          / (f.p + 12.5)) * (f.p + 0.5) from f join z on z.vehicle_id = f.vehicle_id and z.i = f.i + 1) select vehicle_id, max(i) as n, round(max_by(x, i), 6) +
          0.0 as estimate, round(max_by(p, i), 6) + 0.0 as variance from f group by 1""",
    "latest_points": sql("""
        select vehicle_id, seq, us, fuel, cast(place as bigint) as place from (select *, row_number() over (partition by vehicle_id order by us desc, seq
          desc) as place from t) where place <= 5"""),
    "history": sql(
        """select vehicle_id, seq, us, fuel from t where vehicle_id = (select min(vehicle_id) from t where contains(lower(vehicle_id), 'v0000')) and us between 1704067200000000 and 1704999999000000
        order by us desc, seq desc limit 200"""),
    "fleet_status": sql("""
        select vehicle_id, count(*) as points, min(us) as first_us, max(us) as last_us, max_by(fuel, (us, seq)) as last_fuel, max_by(speed, (us, seq)) as
          last_speed from t group by 1"""),
    "capacity_resolution": sql("""
        select vehicle_id, seq, case when capacity_liters > 0 and capacity_liters <> 850 then capacity_liters when asked > 0 then asked end as capacity, case
          when capacity_liters > 0 and capacity_liters <> 850 then 'MASTER_DATA' when asked > 0 then 'REQUEST' else 'NONE' end as capacity_source from (select
          t.vehicle_id, seq, capacity_liters, cast(case when seq % 3 = 0 then 400 else 0 end as double) as asked from t left join vehicles using (vehicle_id))""", VEHICLES),
    "fleet_by_region": sql("""
        select r_name as region, n_name as nation, count(*) as points, count(distinct t.vehicle_id) as vehicles from t join vehicles using (vehicle_id) join
          nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""", VEHICLES),
    "downsampled": sql("""
        select vehicle_id, seq, us, fuel from (select *, row_number() over (partition by vehicle_id order by us, seq) as rn, count(*) over (partition by
          vehicle_id) as n from t) where (rn - 1) % cast(ceil(n / 20) as bigint) = 0 or rn = n"""),
    "vehicle_upsert": sql(
        """, n as (
          select vehicle_id, max(case when fuel > 420 then fuel end) as new from t group by 1
        ) select coalesce(vehicles.vehicle_id, n.vehicle_id) as vehicle_id, coalesce(vehicle_name, n.vehicle_id) as vehicle_name, coalesce(new, capacity_liters) as capacity_liters, c_nationkey
        from vehicles full join n on vehicles.vehicle_id = n.vehicle_id""", VEHICLES),
    "export_bands": sql(f"""
        select vehicle_id, seq, round(noise, 5) + 0.0 as noise, case when noise > 4 then 'Spike' when noise > 1.5 then 'Sloshing' else 'Normal' end as band,
          case when speed <= 3 then '0-3' when speed <= 10 then '3-10' when speed <= 30 then '10-30' when speed <= 60 then '30-60' else '60+' end as speed_band,
          cast(speed <= 0.5 as int) as is_stopped from (select *, abs(fuel - avg(fuel) over (v rows between 7 preceding and current row)) as noise from t {V})"""),
    "motion_states": recursive("""
        select vehicle_id, seq, round(displacement, 3) + 0.0 as displacement, case when places >= 3 and speed <= 1 and radius <= 30 then 'LOW_MOTION' when
          places >= 3 and speed > 5 and displacement >= 25 then 'MOVING' else 'UNCERTAIN' end as motion_state from m""", EPOCHS, PLACES, d=40),
}


