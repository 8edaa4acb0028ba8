import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetsense.operators import chains, ev, lists, metrics, quality, survey
from fleetsense.schema import STATIONS, TRIPS

U = dt.timezone.utc


def ride(bike, t0, seconds, who, station="00101"):
    t = dt.datetime.fromisoformat(t0).replace(tzinfo=U)
    return (bike, t, station, t + dt.timedelta(seconds=seconds), station, 0.0 if seconds < 180 else 3000.0, who)


def table(spark, rows):
    return spark.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(rows)], TRIPS)


def at(text):
    return F.lit(text).cast("timestamp")


@pytest.fixture()
def stations(spark):
    return spark.createDataFrame([("00101", "City hall", "Jung", 37.56, 126.97)], STATIONS)


def test_live_list(spark, stations):
    rows = [ride("A", "2026-09-25 08:00:00", 60, "x"), ride("A", "2026-09-25 10:00:00", 60, "y"),
            ride("B", "2026-09-23 08:00:00", 60, "x"), ride("B", "2026-09-23 09:00:00", 60, "y"),
            ride("C", "2026-09-25 08:00:00", 60, "x"), ride("C", "2026-09-25 08:05:00", 60, "x")]
    got = lists.live_list(table(spark, rows), at("2026-09-25 12:00:00"), stations).collect()
    assert [(r.bike, r.chain, r.minutes_ago, r.station_name) for r in got] == [("A", 2, 119, "City hall")]
    alarms = chains.mark(table(spark, rows)).where("alarm").select("bike").collect()
    assert sorted(r.bike for r in alarms) == ["A", "B"]


def test_retry_keeps_the_chain(spark, stations):
    rows = [ride("A", "2026-09-25 08:00:00", 60, "x"), ride("A", "2026-09-25 09:00:00", 60, "y"), ride("A", "2026-09-25 09:05:00", 60, "y")]
    t = table(spark, rows)
    assert [r.chain for r in lists.live_list(t, at("2026-09-25 12:00:00"), stations).collect()] == [2]
    morning = lists.morning_lists(chains.mark_timeline(t), None, stations).collect()
    assert [(str(r.day), r.chain, r.reported, r.truth_first_rider_dud) for r in morning] == [("2026-09-26", 2, None, None)]


def test_list_then_score(spark, stations):
    rows = [ride("A", "2026-06-01 08:00:00", 60, "x"), ride("A", "2026-06-01 09:00:00", 60, "y"),
            ride("A", "2026-06-02 07:00:00", 60, "z"), ride("A", "2026-06-02 08:00:00", 1800, "w")]
    t = table(spark, rows)
    got = metrics.day_scores(chains.mark_timeline(t)).collect()
    assert [(str(r.day), r.listed, r.rode, r.first_dud) for r in got] == [("2026-06-02", 1, 1, 1)]
    assert lists.morning_list_of(t, F.lit("2026-06-02").cast("date"), stations).count() == 1
    assert lists.morning_list_of(t, F.lit("2026-06-03").cast("date"), stations).count() == 0


def ledger(spark, today):
    rows = [(dt.datetime(2026, 9, 18 + d, 14, tzinfo=U), 5700 + 220 * d * (d != 0)) for d in range(7)]
    rows += [(dt.datetime(2026, 9, 18 + d, 13, tzinfo=U), 6000) for d in range(8)]
    return spark.createDataFrame(rows + [(dt.datetime(2026, 9, 25, 14, tzinfo=U), today)], "t timestamp, rows long")


def test_thin_hour(spark):
    now = at("2026-09-25 15:10:00")
    h = quality.hour_health(ledger(spark, 380), now)
    got = {r.t: r for r in h.collect()}
    last = got[dt.datetime(2026, 9, 25, 14)] if dt.datetime(2026, 9, 25, 14) in got else None
    last = last or [r for k, r in got.items() if k.hour == 14 and k.day == 25][0]
    past = sorted([5700] + [5700 + 220 * d for d in range(1, 7)])
    assert last.thin and abs(last.ratio - 380 / past[3]) < 1e-12
    s = quality.feed_status(h, now).first()
    assert not s.ok and abs(s.ratio - 380 / past[3]) < 1e-12
    assert quality.feed_status(quality.hour_health(ledger(spark, 6000), now), now).first().ok


def test_held_score(spark):
    h = quality.hour_health(ledger(spark, 380), at("2026-09-25 17:10:00"))
    a = spark.createDataFrame([("A", dt.datetime(2026, 9, 25, 13, 30, tzinfo=U), dt.datetime(2026, 9, 25, 15, 0, tzinfo=U), True),
                               ("B", dt.datetime(2026, 9, 25, 12, 30, tzinfo=U), dt.datetime(2026, 9, 25, 13, 0, tzinfo=U), True),
                               ("C", dt.datetime(2026, 9, 25, 13, 30, tzinfo=U), None, None)], "bike string, at timestamp, next_t0 timestamp, next_dud boolean")
    assert {r.bike: r.held for r in quality.held_scores(a, h).collect()} == {"A": True, "B": False, "C": False}


def test_missing_hours_newest_first(spark):
    led = spark.createDataFrame([(dt.datetime(2026, 9, 25, h, tzinfo=U),) for h in (1, 2, 4)], "t timestamp")
    got = quality.missing_hours(led, at("2026-09-25 00:00:00"), at("2026-09-25 05:30:00"), 2).select(F.hour("t").alias("h")).collect()
    assert [r.h for r in got] == [5, 3]


def test_ev_sessions_and_chains(spark):
    def s(c, start, minutes):
        b = dt.datetime(2026, 9, 25, tzinfo=U) + dt.timedelta(minutes=start)
        return (c, b, b + dt.timedelta(minutes=minutes))
    rows = [s("A-01", 0, 2), s("A-01", 30, 1), s("A-01", 33, 1), s("A-01", 60, 2), s("B-01", 0, 40), s("B-01", 100, 2), s("A-01", 0, 2)]
    snaps = spark.createDataFrame(rows, "charger string, start timestamp, end timestamp")
    x = ev.sessions(snaps)
    assert x.count() == 6
    m = ev.mark_ev(x).done().where("charger = 'A-01'").orderBy("start").collect()
    assert [r.retry for r in m] == [False, False, True, False]
    assert [r.streak for r in m] == [0, 1, 1, 2]
    assert [r.alarm for r in m] == [False, True, False, False]
    z = ev.zombies(x, at("2026-09-25 12:00:00")).collect()
    assert [(r.charger, r.chain) for r in z] == [("A-01", 3)]


def test_zombie_meaning_and_literal_form(spark):
    b = dt.datetime(2026, 9, 25, tzinfo=U)
    rows = [("A", b + dt.timedelta(minutes=m), b + dt.timedelta(minutes=m + d)) for m, d in ((0, 1), (30, 1), (60, 40))]
    x = ev.sessions(spark.createDataFrame(rows, "charger string, start timestamp, end timestamp"))
    assert ev.zombies(x, at("2026-09-25 12:00:00")).count() == 0
    assert ev.zombies(x, at("2026-09-25 12:00:00"), literal=True).count() == 1


def test_segments_split_only_beyond_the_gap(spark):
    b = dt.datetime(2026, 9, 25, tzinfo=U)
    times = spark.createDataFrame([(b + dt.timedelta(minutes=m),) for m in (0, 5, 30, 56, 60)], "at timestamp")
    got = ev.segments(times, 25).orderBy("at").collect()
    assert [r.seg for r in got] == [0, 0, 0, 1, 1]


def test_survey_state_and_rates(spark):
    rows = [ride("A", "2026-06-01 08:00:00", 60, "x"), ride("A", "2026-06-01 09:00:00", 60, "y"), ride("A", "2026-06-01 09:30:00", 60, "z"),
            ride("B", "2026-06-01 08:00:00", 1800, "x")]
    sv = spark.createDataFrame([(1, "A", dt.datetime(2026, 6, 1, 12, tzinfo=U), "타이어"), (2, "B", dt.datetime(2026, 6, 1, 12, tzinfo=U), "멀쩡함"),
                                (3, "A", dt.datetime(2026, 6, 1, 9, 0, 30, tzinfo=U), "타이어")], "id long, bike string, at timestamp, status string")
    st = survey.state_before(sv, chains.mark(table(spark, rows)))
    assert {r.id: r.chain for r in st.collect()} == {1: 3, 2: 0, 3: 1}
    v = survey.validate(st.where("id < 3")).first()
    assert (v.precision_pct, v.false_alarm_pct, v.recall_pct) == (100.0, 0.0, 100.0)


def test_wilson(spark):
    from fleetsense.functions.scalars import wilson
    d = spark.createDataFrame([(10, 20), (0, 10)], "k long, n long")
    lo, hi = wilson(F.col("k"), F.col("n"))
    a, b = d.orderBy(F.desc("n")).select(F.round(lo, 1).alias("lo"), F.round(hi, 1).alias("hi")).collect()
    assert (a.lo, a.hi) == (29.9, 70.1)
    assert abs(b.lo) < 1e-9 and b.hi > 20
