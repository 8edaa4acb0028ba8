"""The whole tick: interruptions, repeated batches, corrections, retention, against marking everything at once."""

import datetime as dt

import pytest
from helpers import frame, random_trips, trip
from pyspark.sql import functions as F

from fleetsense.operators import chains
from fleetsense.streaming import store as R
from fleetsense.streaming import ticks as K

STATIONS = "id string, name string"


class Stop(Exception):
    pass


def snapshot_of(store):
    """Every table's rows, but for the wall-clock step times."""
    state = store.state()
    return {t: sorted(map(repr, store.read(t, state=state).collect())) for t in store.tables if t != "steps"}


def setup(spark, tmp_path, name):
    store = K.live_store(spark, f"file://{tmp_path}/{name}")
    return store, spark.createDataFrame([("00101", "one")], STATIONS)


def pages(spark, rows, times):
    """One batch per time: rows returned since the last one; a tenth arrives a batch late."""
    d = frame(spark, rows)
    out, before = [], None
    for k, at in enumerate(times):
        late = F.col("ord") % 10 == 3
        upto = lambda t: F.col("t1") <= F.lit(t.isoformat()).cast("timestamp")
        own = (upto(at) & ~late) | (upto(before) & late if before else F.lit(False))
        seen = F.lit(False) if before is None else (upto(before) & ~late) | (upto(times[k - 2]) & late if k > 1 else F.lit(False))
        out.append(d.where(own & ~seen).withColumn("landed_at", F.lit(at.isoformat()).cast("timestamp")))
        before = at
    return out


def test_interrupted_at_every_stage_and_run_again(spark, tmp_path):
    rows = random_trips(n=300)
    start = dt.datetime(2026, 6, 2, 9)
    one, two = pages(spark, rows, [start, start + dt.timedelta(hours=3)])
    plain, stations = setup(spark, tmp_path, "plain")
    run = K.tick(plain, stations, F.max("landed_at"))
    run(one, 0)
    first = snapshot_of(plain)
    run(two, 1)
    wanted = snapshot_of(plain)
    assert wanted["alarms"] and wanted["samples"] and wanted["lists"] and wanted != first

    broken, _ = setup(spark, tmp_path, "broken")
    K.tick(broken, stations, F.max("landed_at"))(one, 0)
    for stage in [*K.STAGES[1::2], "commit"]:
        def fail(name, at=stage):
            if name == at:
                raise Stop(name)

        with pytest.raises(Stop):
            K.tick(broken, stations, F.max("landed_at"), before=fail)(two, 1)
        assert broken.commits() == [0]
    assert snapshot_of(broken) == first
    again = K.tick(broken, stations, F.max("landed_at"))
    again(two, 1)
    assert snapshot_of(broken) == wanted
    again(two, 1)       # the same batch
    again(one, 0)
    assert broken.commits() == [0, 1]
    again(one.unionByName(two).withColumn("landed_at", F.lit((start + dt.timedelta(hours=3)).isoformat()).cast("timestamp")), 2)     # the same pages, read again
    after = snapshot_of(broken)
    assert {t: after[t] for t in ("rides", "last", "alarms", "samples", "hours", "lists")} == {t: wanted[t] for t in ("rides", "last", "alarms", "samples", "hours", "lists")}


def test_corrections_and_late_rows_give_the_marks_of_one_pass(spark, tmp_path):
    rows = random_trips(seed=7, n=250)
    d = frame(spark, rows).withColumn("landed_at", F.lit("2026-06-02 20:00:00").cast("timestamp"))
    store, stations = setup(spark, tmp_path, "s")
    run = K.tick(store, stations, F.max("landed_at"))
    wrong = d.where("ord % 5 <> 2").withColumn("st1", F.when(F.col("ord") % 7 == 1, "00999").otherwise(F.col("st1")))
    run(wrong, 0)
    run(d.where("ord % 7 = 1 or ord % 5 = 2"), 1)
    keys = ["bike", "t0", "dud", "retry", "streak", "alarm"]
    wanted = chains.mark(d, identity="person").where("t1 >= timestamp '2026-05-24 20:00:00'").select(*keys)
    assert sorted(map(repr, store.read("rides").select(*keys).collect())) == sorted(map(repr, wanted.collect()))


def test_rows_without_a_bike_are_counted_and_left_out(spark, tmp_path):
    store, stations = setup(spark, tmp_path, "s")
    rows = [trip(None, 10 * i, 20, who=f"p{i}") for i in range(10)] + [trip("b", 5, 20, who="p1"), trip("b", 9, 30, who="p2")]
    at = dt.datetime(2026, 6, 1, 12).isoformat()
    K.tick(store, stations, F.max("landed_at"))(frame(spark, rows).withColumn("landed_at", F.lit(at).cast("timestamp")), 0)
    assert [(r.bike, r.chain) for r in store.read("alarms").collect()] == [("b", 2)]
    assert store.read("steps").where("step like 'rows without%'").first().ms == 10


def test_retention_keeps_what_the_rule_keeps(spark, tmp_path):
    store = R.Store(spark, f"file://{tmp_path}/r", {"rides": R.Table("bike string, t1 timestamp", "t1", 9), "alarms": R.Table("at timestamp, next_dud boolean", "at", 10, "next_dud is not null"),
                                                     "steps": R.Table("at timestamp, ms long", "at", 3)})
    now = dt.datetime(2026, 9, 25, 12)
    us = int((now - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    hours = spark.range(0, 15 * 24).withColumn("t1", F.timestamp_micros(F.lit(us) - F.col("id") * 3_600_000_000))
    change = store.change("main", 0)
    part = F.date_format("t1", "yyyy-MM-dd")
    change.replace("rides", hours.select(F.lit("A").alias("bike"), "t1"), part, [])
    change.replace("alarms", hours.select(F.col("t1").alias("at"), F.when(F.col("id") % 2 == 0, True).alias("next_dud")), F.date_format("at", "yyyy-MM-dd"), [])
    change.replace("steps", hours.select(F.col("t1").alias("at"), F.col("id").alias("ms")), F.date_format("at", "yyyy-MM-dd"), [])
    change.commit()
    before = store.state()
    reader = store.read("rides", state=before)
    change = store.change("main", 1)
    change.retain(us)
    change.commit()
    assert store.read("rides").count() == 9 * 24 + 1 and store.read("steps").count() == 3 * 24 + 1
    assert store.read("alarms").count() == 10 * 24 + 1 + (15 * 24 - 10 * 24 - 1) // 2
    kept, old = store.state().parts["rides"], before.parts["rides"]
    assert set(kept) < set(old) and all(kept[p] == old[p] for p in kept)        # kept files untouched, not rewritten
    assert store.vacuum(keep=2) == 0 and reader.count() == 15 * 24              # a running reader is left alone
    store.change("main", 2).commit()
    assert store.vacuum(keep=2) > 0 and store.read("rides").count() == 9 * 24 + 1 and store.commits() == [1, 2]


def test_pages_come_from_one_reading_of_the_source(spark, tmp_path):
    from fleetsense.plans import tick_queries as Q

    rows = [(i, dt.datetime(2024, 1, 26) + dt.timedelta(hours=2 * i) if i % 11 else None) for i in range(70)]
    d = spark.createDataFrame(rows, "ord long, t1 timestamp")
    got = Q.pages(d, f"file://{tmp_path}/pages")
    ticks = [dt.datetime.fromisoformat(t) for t in Q.TICKS]
    wanted = []
    for i, t1 in rows:
        first = t1 and next((k for k, at in enumerate(ticks) if t1 + dt.timedelta(hours=30 * (i % 10 == 3)) <= at), None)
        if first is not None:
            wanted += [(i, first)] + ([(i, first + 1)] if i % 7 == 0 and first + 1 < len(ticks) else [])
    assert sorted((r.ord, r.page) for r in got.collect()) == sorted(wanted)


def test_work_of_a_tick_follows_what_changed(spark, tmp_path, monkeypatch):
    """Joins with tables that have no parts fall away, and labels read no day before the first open alarm or sample."""
    store, stations = setup(spark, tmp_path, "s")
    keys = spark.range(5).select(F.col("id").cast("string").alias("bike"))
    assert "Join" not in keys.join(store.read("rides"), "bike", "left")._jdf.queryExecution().optimizedPlan().toString()
    rows, start = random_trips(n=900), dt.datetime(2026, 6, 5, 9)
    one, two = pages(spark, rows, [start, start + dt.timedelta(hours=6)])
    run = K.tick(store, stations, F.max("landed_at"))
    run(one, 0)
    days, plain, stage = [], K.Tick.rides, []

    def rides(self, since=None, until=None, buckets=None):
        if stage[-1] == "settle":
            days.append(since)
        return plain(self, since, until, buckets)

    monkeypatch.setattr(K.Tick, "rides", rides)
    K.tick(store, stations, F.max("landed_at"), before=stage.append)(two, 1)
    assert len(days) == 1 and days[0] >= start.replace(hour=0) - dt.timedelta(days=2)


def test_newest_marked_row_is_told_in_the_same_scan(spark):
    d = frame(spark, random_trips(seed=3, n=120))
    first = chains.mark(d.where("ord < 60"), identity="person")
    got = chains.mark_on(d.where("ord >= 60"), chains.last_row(first, "bike"))
    wanted = chains.last_row(got, "bike").select("bike", "ord")
    assert sorted(got.where("newest").select("bike", "ord").collect()) == sorted(wanted.collect())
