import duckdb
import pytest
from compare import rows_of_spark, rows_of_sql

from tankwise.operators.feature_vector import _deviation
from tankwise.operators.windows import library_haversine, rounded
from tankwise.plans import evaluation, oracles, preparation, queries

ORACLES, QUERIES = oracles.ORACLES | preparation.ORACLES | evaluation.ORACLES, queries.QUERIES | preparation.QUERIES | evaluation.QUERIES
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert rows_of_spark(df) == rows_of_sql(SF, ORACLES[name], df.columns)


def test_forest_agrees_with_the_labels_of_other_vehicles(spark):
    rows = QUERIES["forest_confusion"](spark, SF).where("vehicle_id is null").collect()
    assert sum(r.n for r in rows if r.label == r.guess) >= 0.8 * sum(r.n for r in rows)


def test_queries_without_sql():
    assert set(QUERIES) - set(ORACLES) == {"smooth_tracking", "forest_confusion", "enhanced_levels", "segment_replay", "causal_states", "predicted_replay"}


def test_halves_that_a_sum_missed_by_a_bit_round_as_in_sql(spark):
    values = [11.913499999999999, 400.12499999999994, -11.913499999999999, 0.0, 2.675, 1e300, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", *[rounded("x", n) for n in (2, 3, 6)]).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == [duckdb.sql(f"select round(v, 2), round(v, 3), round(v, 6) from (select {'null' if v is None else repr(v)}::double as v)").fetchall()[0] for v in values]


def test_deviation_has_the_bits_of_the_sql(spark):
    """Levels whose deviation ends in a half of the ninth decimal or nearly so round alike only if the last bits agree."""
    levels = [[round(400 + (i * 7919 + j * j * 104729) % 6007 / 100, 2) for j in range(2 + i % 12)] for i in range(400)]
    got = spark.createDataFrame(list(enumerate(levels)), "i int, v array<double>").select("i", _deviation("v")).collect()
    assert [r[1] for r in sorted(got)] == [x for (x,) in duckdb.sql(f"select list_aggregate(v, 'stddev_pop') from (select unnest({levels}::double[][]) as v)").fetchall()]


def test_tracking_takes_each_point_once_with_its_own_vehicle(spark, tmp_path):
    """Numbers that agree in their first five digits are several vehicles, and a point of one has one row of master data."""
    users = [12345, 123451, 123452, 1234567]
    duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_minutes(i) as ts, (list_value{tuple(users)})[i % 4 + 1]::bigint as user_id, 'view' as event_type, 1.0 as value, '{{\"k\": 50}}' as props from range(40) as r(i)) to '{tmp_path}/events.parquet'")
    duckdb.sql(f"copy (select unnest({users})::bigint as c_custkey, 'c' as c_name, 1 as c_nationkey) to '{tmp_path}/customer.parquet'")
    got = QUERIES["smooth_tracking"](spark, str(tmp_path)).groupBy("vehicle_id").count().collect()
    assert {r.vehicle_id: r["count"] for r in got} == {f"V{u}": 10 for u in users}


def _cut_ids(path, keys):
    """Points of two vehicles, one with a dropout first and a long gap, and customers with these keys."""
    kinds = "['error', 'purchase', 'view', 'click', 'view', 'signup']"
    duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_hours(i + i // 30 * 40) as ts, case when i % 2 = 0 then 12346 else 4 end::bigint as user_id, {kinds}[1 + i // 2 % 6] as event_type, 1.0 as value, '{{\"k\": ' || (i * 37 % 100 + case when i = 0 then 3 else 0 end) || '}}' as props from range(90) as r(i)) to '{path}/events.parquet'")
    duckdb.sql(f"copy (select unnest({keys})::bigint as c_custkey, 'c' as c_name, 1 as c_nationkey) to '{path}/customer.parquet'")
    return str(path)


def test_online_features_where_customers_share_a_cut_id(spark, tmp_path):
    """Gaps and motion are those of points, not of their copies; with one capacity for all copies the SQL leaves no order open."""
    for n in (2, 5, 17):
        keys = [k for k in range(1234600, 1234700) if k % 5 == 0 or k % 7 == 0][:n]  # no capacity, or 850 for none
        sf = tmp_path / str(n)
        sf.mkdir()
        df = QUERIES["online_features"](spark, _cut_ids(sf, keys))
        got = rows_of_spark(df)
        assert len(got) > 44 * n and got == rows_of_sql(str(sf), ORACLES["online_features"], df.columns)


def test_online_features_of_copies_with_different_capacities(spark, tmp_path):
    """Which of a point's copies comes first is open in the SQL; all that does not follow from the capacity is the same."""
    sf = _cut_ids(tmp_path, [4, 12346, 123461, 123462, 123463])
    free = [n for n in QUERIES["online_features"](spark, sf).columns if n not in ("FuelPct", "DeltaPct", "DeltaOverNoise", "RollingStdPct", "capacity_est", "noise_sigma_liters", "flat_jitter_threshold", "spike_threshold", "event_threshold")]
    df = QUERIES["online_features"](spark, sf).select(*free)
    assert rows_of_spark(df) == rows_of_sql(sf, f"select {', '.join(free)} from ({ORACLES['online_features']})", free)
    assert {r[0] for r in QUERIES["online_features"](spark, sf).where("vehicle_id = 'V12346' and seq > 10").groupBy("seq").agg({"capacity_est": "count"}).select("count(capacity_est)").distinct().collect()} == {4}


def test_distances_have_the_bits_of_the_sql(spark):
    ends = [(21 + i * 7919 % 50021 / 1e6, 105 + i * 104729 % 90000007 / 1e6, i * 31 % 8009 / 1e6, i * 37 % 8011 / 1e6) for i in range(20000)]
    rows = [(i, a, b, round(a + c, 6), round(b + d, 6)) for i, (a, b, c, d) in enumerate(ends)] + [(20000, None, 105.0, 21.0, 105.0), (20001, 21.0, 105.0, 21.0, 105.0)]
    t = spark.createDataFrame(rows, "i int, a double, b double, c double, d double")
    got = [r[1] for r in sorted(t.select("i", library_haversine(*[t[n] for n in "abcd"])).collect())]
    values = ", ".join(str(r).replace("None", "null") for r in rows)
    assert got == [x for (x,) in duckdb.sql(oracles.inline_haversine(f"select hav(a, b, c, d) from (select i, a::double as a, b::double as b, c::double as c, d::double as d from (values {values}) as v(i, a, b, c, d)) order by i")).fetchall()]
