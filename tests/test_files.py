import datetime as dt
import json

import pytest

from tankwise.operators import feature_vector as V28
from tankwise.operators import forest as M
from tankwise.operators import gated as G
from tankwise.operators import windows as W
from tankwise.sources import files as S


def test_csv_with_other_names_commas_and_bad_times(spark, tmp_path):
    (tmp_path / "29H-1_processed.csv").write_text('thoi_gian,xang_tho,van_toc\n2026-01-01 10:00:00,"93,5",61\n01/02/2026 08:30:00,90,\nnever,80,1\n2026-01-01T11:00:00.250Z,x,2\n46023.5,70,3\n')
    rows = {r.time: (r.vehicle_id, r.fuel, r.speed, r.lat) for r in S.read_csv(spark, str(tmp_path)).collect()}
    assert rows == {
        dt.datetime(2026, 1, 1, 10): ("29H-1", 93.5, 61.0, None), dt.datetime(2026, 2, 1, 8, 30): ("29H-1", 90.0, 0.0, None),
        dt.datetime(2026, 1, 1, 11): ("29H-1", None, 2.0, None), dt.datetime(2026, 1, 1, 12): ("29H-1", 70.0, 3.0, None),
    }


def test_json_points_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"car_id": "A", "time": "2026-01-01 00:00:00", "raw": 5, "Lat": 21.5}\n{"car_id": "A", "time": null, "raw": 6}\n')
    assert [(r.vehicle_id, r.fuel, r.lat, r.capacity) for r in S.read_json(spark, str(tmp_path)).collect()] == [("A", 5.0, 21.5, None)]
    with pytest.raises(ValueError, match="fuel"):
        S.canonical(spark.createDataFrame([("A", "2026-01-01")], "car_id string, time string"))


def test_labelled_rows_keep_known_labels_only(spark, tmp_path):
    (tmp_path / "l.csv").write_text("VehicleID,FuelTime,Label,a\nV,t1, stable_jitter ,1\nV,t2,OTHER,2\nV,t3,STABLE_JITTER,z\n")
    assert [(r.FuelTime, r.a, r.b) for r in S.read_labelled(spark, str(tmp_path), ["a", "b"], ["STABLE_JITTER"]).orderBy("FuelTime").collect()] == [("t1", 1.0, 0.0), ("t3", 0.0, 0.0)]


def test_segments_and_sink(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"id": "s", "timestamps": ["2026-01-01 00:00:00", "2026-01-01 00:02:00"], "raw_liters": [5.0, 4.5], "speed_kmh": [0.0, 3.0]}]))
    t = S.read_segments(spark, str(tmp_path / "g.json"))
    assert [(r.id, r.pos, r.fuel, r.speed) for r in t.orderBy("pos").collect()] == [("s", 0, 5.0, 0.0), ("s", 1, 4.5, 3.0)]
    S.write_points(t.withColumnRenamed("id", "vehicle_id"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("vehicle_id = 's'").count() == 2


def _points(spark, levels):
    return W.steps(spark.createDataFrame([("V", i, i * 120_000_000, float(x), 0.0, None, None) for i, x in enumerate(levels)], "vehicle_id string, seq long, us long, fuel double, speed double, lat double, lng double"))


def test_gated_filter_holds_two_points_of_a_rise_and_takes_the_third(spark):
    got = [r.estimate for r in G.gated_kalman(_points(spark, [100] * 12 + [200, 200, 200])).orderBy("seq").collect()]
    assert got[12:] == [100.0, 100.0, 200.0]


def test_gated_filter_skips_levels_of_zero_and_takes_no_points(spark):
    assert [r.estimate for r in G.gated_kalman(_points(spark, [100, 0, 100])).orderBy("seq").collect()] == [100.0, None, 100.0]
    assert G.gated_kalman(_points(spark, [])).count() == 0


def test_gated_filter_follows_the_second_point_of_a_noisy_fall(spark):
    got = [r.estimate for r in G.gated_kalman(_points(spark, [200] * 12 + [100, 100])).orderBy("seq").collect()]
    assert got[12] == 200.0 and 100 < got[13] < 200


def test_forest_learns_rules_of_other_vehicles(spark):
    base = spark.range(1200).selectExpr("concat('V', id % 12) as vehicle_id", "id as seq", "id as us", "if(id % 3 = 0, 20.0d, if(id % 3 = 1, -20.0d, 0.1d)) as delta")
    of = {"DeltaFuel": "delta", "AbsDeltaFuel": "abs(delta)", "RollingStd12": "abs(delta) / 3"}
    features = ", ".join(f"'{n}', double({of.get(n, '1')})" for n in V28.NAMES)
    t = base.selectExpr("*", f"named_struct({features}) as features", "if(delta > 10, 'UPWARD_SHIFT', if(delta < -10, 'DOWNWARD_SHIFT', 'STABLE_JITTER')) as label")
    t = M.held_out(t)
    got = M.classify(M.train(t.where("not held_out")), t.where("held_out"))
    assert got.count() > 0 and got.where("guess != label or confidence < 0.5").count() == 0


def times(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(S.moment(W.F.col("x"))).collect()]


def test_times_of_all_known_formats(spark):
    day = dt.datetime(2024, 3, 5)
    half = day.replace(hour=7, minute=30)
    assert times(spark, "05/03/2024 07:30", "5/3/2024 07:30:00", "2024-03-05T07:30:00.123456+07:00", "2024-03-05 07:30:00.", "2024/03/05 07:30:00", "2024-03-05", "2024-3-5 7:30") == [half] * 5 + [day, half]
    assert times(spark, "03/25/2024 10:00:00", "45356.25", "12", "20000", "", None, "x", "31/02/2024 10:00:00") == [dt.datetime(2024, 3, 25, 10), day.replace(hour=6), *[None] * 6]


def test_files_with_unlike_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FuelTime,FuelLevel,Speed\n2026-01-01 10:00:00,200,7\nnever,1,1\n")
    (tmp_path / "b.csv").write_text("Speed,FuelTime,FuelLevel,,Speed\n7,2026-01-01 10:00:00,200,x,9\n")
    (tmp_path / "c.csv").write_text("\ufeffVehicleID,time,raw\nC,2026-01-01 10:00:00,\n")
    (tmp_path / "d.csv").write_text("FuelTime,FuelLevel,Speed\n")
    (tmp_path / "e + {1}[2] %20_processed.csv").write_text("FuelTime,FuelLevel\n2026-01-01,5\n")
    got = S.read_csv(spark, str(tmp_path))
    assert sorted((r.vehicle_id, r.fuel, r.speed) for r in got.collect()) == [("C", None, 0.0), ("a", 200.0, 7.0), ("b", 200.0, 7.0), ("e + {1}[2] %20", 5.0, 0.0)]
    assert sorted(map(tuple, S.rejected(S.parsed_csv(spark, str(tmp_path))).collect())) == [("C", 1, 0, 1), ("a", 2, 1, 0), ("b", 1, 0, 0), ("e + {1}[2] %20", 1, 0, 0)]


def test_rows_of_files_keep_their_order(spark, tmp_path):
    n = 3000
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("FuelTime,FuelLevel,Speed\n" + "".join(f"2026-01-01 {i % 24:02}:00:00,{i},{i % 7}\n" for i in range(n)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits a file
    try:
        got = S.read_csv(spark, str(tmp_path), ordered=True)
        assert [(r.seq, r.vehicle_id, r.fuel) for r in got.orderBy("seq").collect()] == [(i, "ab"[i // n], float(i % n)) for i in range(2 * n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_batch_in_mixed_order_comes_back_in_that_order(spark):
    from tankwise.operators import serving, tracking

    points = [("B", 4, 50.0), ("A", 2, 90.0), ("B", 0, 51.0), ("A", 0, 91.0), ("B", 2, 0.0), ("A", 2, 89.0)]
    batch = spark.createDataFrame([([(v, m * 60_000_000, f) for v, m, f in points],)], "points array<struct<vehicle_id: string, us: long, fuel: double>>")
    got = serving.clean_batch(batch.selectExpr("posexplode(points) as (seq, p)").selectExpr("cast(seq as long) as seq", "p.*")).collect()
    assert [(r.vehicle_id, r.us // 60_000_000, r.raw) for r in got] == points
    state, line = tracking.fresh(), sorted((p for p in enumerate(points) if p[1][0] == "A"), key=lambda p: (p[1][1], p[0]))
    want = {i: tracking.step(state, m * 60_000_000, f)["clean"] for i, (_, m, f) in line}
    assert {i: got[i].clean for i in want} == want


def test_gated_filter_over_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.csv").write_text("FuelTime,FuelLevel\n" + "".join(f"2026-01-01 10:{2 * i:02}:00,{x}\n" for i, x in enumerate([100] * 12 + [200, 200, 200])))
    S.enhance_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), kind="gated")
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).selectExpr("cast(seq as int) as seq", "double(enhanced) as x").orderBy("seq").collect()
    assert [r.x for r in got][12:] == [100.0, 100.0, 200.0]


def test_a_database_table_is_written_and_read_in_parts(spark, tmp_path):
    url, more = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    try:
        spark._jvm.java.lang.Class.forName(more["driver"])
    except Exception:
        pytest.skip("Spark's jars hold no database")
    points = spark.range(50).selectExpr("id as seq", "cast(id as double) as fuel")
    assert S.write_table(points, url, "points", mode="overwrite", **more) and S.write_table(points, url, "points", **more)
    back = S.read_table(spark, url, "points", partitionColumn="seq", lowerBound="0", upperBound="50", numPartitions="4", **more)
    assert back.count() == 100 and back.rdd.getNumPartitions() == 4 and back.agg({"fuel": "sum"}).first()[0] == 2450
