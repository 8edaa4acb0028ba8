import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetsense.sources import readers, sinks
from tests.helpers import frame, trip

A = "자전거번호,대여일시,대여 대여소번호,반납일시,반납대여소번호,이용거리(M),생년,성별,기타\n"
B = "﻿자전거번호,대여일시,대여_대여소ID,반납일시,반납_대여소ID,이용거리(km)\n"


def test_city_a_file(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes((A + "SPB-1,2026-06-01 08:00:00,00101,2026-06-01 08:01:00,00101,50,1990,F,x\n"
                   "SPB-1,2026-06-01 09:00:00,00101,2026-06-01 09:01:00,00102,,1990,,x\n"
                   "SPB-2,bad,00101,2026-06-01 09:01:00,00102,10,,M,x\n"
                   "SPB-2,2026-06-01 10:00:00,00101,2026-06-01 10:01:00,00102,10,,M,x\n").encode("cp949"))
    got = readers.scan_trips_city_a(spark, str(f)).orderBy("bike", "t0").collect()
    assert [(r.bike, r.st0, r.dist_m, r.who) for r in got] == [("SPB-1", "00101", 50.0, "1990F"), ("SPB-1", "00101", 0.0, "1990?"), ("SPB-2", "00101", 10.0, None)]


def test_city_b_file(spark, tmp_path):
    f = tmp_path / "b.csv"
    f.write_text(B + "7,2025-05-01 08:00:00,12,2025-05-01 08:01:00,12,0.25\n7,2025-05-01 09:00:00,12,2025-05-01 09:01:00,13,x\n", encoding="utf-8")
    got = readers.scan_trips_city_b(spark, str(f)).orderBy("t0").collect()
    assert [(r.bike, r.dist_m, r.who) for r in got] == [("7", 250.0, None), ("7", 0.0, None)]


def test_missing_columns_are_named():
    with pytest.raises(KeyError, match="st1.*received"):
        readers.resolve_names(["bikeNo", "rentDt", "RENT_ID", "RTN_DT"])


def test_optional_column_in_some_rows_only(spark):
    row = '{"BIKE_ID":"SPB-1","RENT_DT":"2026-06-01 0%d:00:00","RENT_ID":"101","RTN_DT":"2026-06-01 0%d:01:00","RTN_ID":"101","USE_DST":"5","BIRTH_YEAR":"1990"%s}'
    for order in (("", ',"SEX_CD":"m"'), (',"SEX_CD":"m"', "")):
        body = '{"rentData":{"list_total_count":2,"row":[%s,%s]}}' % (row % (8, 8, order[0]), row % (9, 9, order[1]))
        got = readers.json_pages(spark.createDataFrame([(body, 1)], "body string, page long")).orderBy("t0").collect()
        assert sorted(r.who for r in got) == ["1990?", "1990M"] and {r.st0 for r in got} == {"00101"}


def test_last_ordinal_wins(spark):
    row = '{"BIKE_ID":"SPB-1","RENT_DT":"2026-06-01 08:00:00","RENT_ID":"101","RTN_DT":"%s","RTN_ID":"%s","USE_DST":"5"}'
    body = '{"rentData":{"row":[%s,%s,%s]}}' % (row % ("2026-06-01 08:01:00", "1"), row % ("2026-06-01 08:02:00", "2"), row % ("", "3"))
    got = readers.json_pages(spark.createDataFrame([(body, 1)], "body string, page long")).collect()
    assert [r.st1 for r in got] == ["00002"]


def test_envelopes_and_quarantine(spark):
    bodies = ['{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":[{"id":"1"},{"id":"2"}]}}}}', '{"data":[{"id":"3"}]}',
              '{"items":{"item":{"id":"4"}}}', '{"items":[{"id":"5"}]}', '{"response":{"header":{"resultCode":"30"},"body":{"items":[{"id":"6"}]}}}', "<html>"]
    good, bad = readers.unwrap(spark.createDataFrame([(b,) for b in bodies], "body string"), "struct<id:string>")
    assert sorted(r.id for r in good.collect()) == ["1", "2", "3", "4", "5"]
    assert sorted(r.reason for r in bad.collect()) == ["30", "no items"]


def test_station_sheet(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text("101,Hall,Jung,addr,37.5,126.9\n102,None,Jung,addr,,126.9\n,X,Y,addr,37,126\n", encoding="utf-8")
    assert [tuple(r) for r in readers.scan_stations(spark, str(f)).collect()] == [("00101", "Hall", "Jung", 37.5, 126.9)]


def test_upsert_marks_only_real_changes_and_rewrites_only_their_days(spark, tmp_path):
    old = frame(spark, [trip("A", 0, 60, who="x"), trip("A", 1500, 60), trip("B", 0, 60)])
    new = frame(spark, [trip("A", 0, 60, who="x"), trip("A", 1500, 90), trip("C", 0, 60)])
    got = {(r.bike, r.t0.day): r.changed for r in sinks.upsert_trips(old, new).collect()}
    assert got == {("A", 1): False, ("A", 2): True, ("B", 1): False, ("C", 1): True}
    path = str(tmp_path / "t")
    old.withColumn("day", F.to_date("t0")).write.partitionBy("day").parquet(path)
    sinks.replace_partitions(new.where("bike = 'A'").withColumn("day", F.to_date("t0")).where("day = '2026-06-02'"), path, "day")
    assert spark.read.parquet(path).count() == 3


def test_write_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    old = frame(spark, [trip("A", 0, 60, who="x"), trip("A", 1500, 60), trip("B", 0, 60)])
    old.withColumn("day", F.to_date("t0")).write.partitionBy("day").parquet(path)
    new = frame(spark, [trip("A", 1500, 90), trip("C", 1500, 60)])
    sinks.write_upsert(path, new, ["bike", "t0"], sinks.TRIP_VALUES, F.to_date("t0"))
    got = spark.read.parquet(path)
    assert got.count() == 4
    assert got.where("bike = 'A' and day = '2026-06-02'").select((F.unix_seconds("t1") - F.unix_seconds("t0")).alias("s")).first().s == 90


def test_crew_csv(spark, tmp_path):
    e = spark.createDataFrame([(1, "00101", "Hall", "Jung", 37.5, 126.9, "A", 2, "06-01 08:00", None), (2, "00102", "X", "Jung", 37.5, 126.9, "B", 3, "06-01 08:00", True)],
                              "rank int, station string, station_name string, gu string, lat double, lon double, bike string, chain long, last_dud string, reported boolean")
    sinks.write_crew_csv(e, str(tmp_path / "c"))
    data = next((tmp_path / "c").glob("part-*.csv")).read_bytes()
    assert data.startswith(b'"\xef\xbb\xbfrank"') or data.startswith(b'\xef\xbb\xbf')
    lines = data.decode("utf-8-sig").split("\r\n")
    assert '"unknown"' in lines[1] and '"yes"' in lines[2] and lines[1].count('","') == 9


def test_daily_lists_and_index(spark, tmp_path):
    d = spark.createDataFrame([(dt.date(2026, 6, 1), "A", "1", 2, "r"), (dt.date(2026, 6, 2), "B", "1", 2, "r")], "day date, bike string, station string, chain long, level string")
    sinks.write_daily_lists(d, str(tmp_path))
    sinks.write_daily_lists(d.where("bike = 'B'"), str(tmp_path), latest_only=True)
    assert spark.read.json(str(tmp_path / "lists")).count() == 2
    sinks.record_list(d, str(tmp_path / "rec"))
    sinks.record_list(d.where("bike = 'B'").withColumn("chain", F.lit(3).cast("long")), str(tmp_path / "rec"))
    assert sorted((r.bike, r.chain) for r in spark.read.parquet(str(tmp_path / "rec")).collect()) == [("A", 2), ("B", 3)]


def test_cached_marked_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return frame(spark, [trip("A", 0, 60), trip(None, 0, 60)])
    for _ in range(2):
        assert readers.cached_marked(spark, str(tmp_path / "m"), build).count() == 1
    assert calls == [1]
