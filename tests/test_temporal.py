import random

import pytest
from pyspark.sql import functions as F

from fleetsense.functions.stats import top_by_count
from fleetsense.operators import stationnoise, temporal, timeline
from fleetsense.operators.timeline import Timeline, find_heavy, previous, running_sum
from tests.helpers import frame, random_trips


def points(spark, seed, n, name):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", rng.randrange(400), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"k string, s long, {name} long").withColumn("t", F.timestamp_seconds("s"))


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("direction,equal", [("backward", True), ("backward", False), ("forward", True), ("forward", False)])
def test_asof(spark, direction, equal, split):
    a, left = points(spark, 1, 120, "i")
    b, right = points(spark, 2, 90, "j")
    heavy = find_heavy(left, "k", "t", 20) if split else None
    got = {r.i: r.m for r in temporal.asof(left, right.withColumnRenamed("t", "u"), "k", "t", "u", F.struct("u"), "m", direction, equal, heavy)
           .select("i", F.unix_seconds("m.u").alias("m")).collect()}
    for k, s, i in a:
        if direction == "backward":
            c = [x for kk, x, _ in b if kk == k and (x <= s if equal else x < s)]
            want = max(c) if c else None
        else:
            c = [x for kk, x, _ in b if kk == k and (x >= s if equal else x > s)]
            want = min(c) if c else None
        assert got[i] == want


@pytest.mark.parametrize("lo_open,hi_open", [(True, True), (False, True), (True, False), (False, False)])
def test_range_count(spark, lo_open, hi_open):
    a, probes = points(spark, 3, 80, "i")
    b, starts = points(spark, 4, 200, "j")
    probes = probes.withColumns({"hi": F.timestamp_seconds(F.col("s") + 25), "_id": F.col("i")})
    for heavy in (None, find_heavy(starts, "k", "t", 20)):
        got = {r.i: r.n for r in temporal.range_count(starts, probes, "k", "t", "k", "t", "hi", "n", lo_open, hi_open, heavy=heavy).collect()}
        for k, s, i in a:
            want = sum(1 for kk, x, _ in b if kk == k and (x > s if lo_open else x >= s) and (x < s + 25 if hi_open else x <= s + 25))
            assert got[i] == want


def test_cooldown_is_sequential(spark):
    rng = random.Random(5)
    rows = sorted({(f"s{rng.randrange(3)}", rng.randrange(0, 60_000)) for _ in range(300)})
    fires = spark.createDataFrame(rows, "st1 string, s long").select("st1", F.timestamp_seconds("s").alias("t1"))
    got = {(r.st1, r.s) for r in stationnoise.cooled(fires, 60).select("st1", F.unix_seconds("t1").alias("s")).collect()}
    want, free = set(), {}
    for st, s in rows:
        if st not in free or s > free[st]:
            want.add((st, s))
            free[st] = s + 3600
    assert got == want


def test_distinct_other_bikes_before(spark):
    rows = random_trips(6, n=500)
    d = frame(spark, rows).select("bike", "ord", "st1", "t1")
    for heavy in (None, find_heavy(d, "st1", "t1", 40)):
        got = {r.ord: r.others for r in stationnoise.distinct_before(d, heavy).collect()}
        data = [(r[4].timestamp(), r[0], i, r[5]) for i, r in enumerate(rows)]
        for t, b, i, st in data:
            want = {x[1] for x in data if x[3] == st and x[1] != b and x[0] >= t - 3600 and x[:3] < (t, b, i)}
            assert got[i] == len(want)


def test_split_scans_give_the_same_features_and_rehearsal(spark):
    from fleetsense.operators import chains, features, rehearsal

    df = frame(spark, random_trips(7, n=700))
    later = 3 * (F.unix_micros("t0") - df.agg(F.unix_micros(F.min("t0"))).scalar())      # two weeks of rentals: the first is warm-up
    df = df.withColumns({"t0": F.timestamp_micros(F.unix_micros("t0") + later), "t1": F.timestamp_micros(F.unix_micros("t1") + later)})
    heavy, station = find_heavy(df, "bike", "t0", 60), find_heavy(df, "st0", "t0", 60)
    assert heavy is not None and station is not None
    a = features.list_samples(chains.mark(df, identity="person"))
    b = features.list_samples(chains.mark(df, identity="person", heavy=heavy), heavy, station)
    cols = sorted(a.columns)
    rows = sorted(map(str, a.select(cols).collect()))
    assert rows and rows == sorted(map(str, b.select(cols).collect()))
    x = sorted(map(str, rehearsal.rehearse(df, (1, 3)).collect()))
    assert x and x == sorted(map(str, rehearsal.rehearse(df, (1, 3), heavy=heavy).collect()))


def test_lead_times_match_brute_force(spark):
    import datetime as dt

    from fleetsense.operators import chains
    from tests.helpers import BASE, fold

    rows = random_trips(8, n=400)
    rng = random.Random(9)
    reports = sorted({(rng.choice(["hot", "b1", "b2"]), BASE + dt.timedelta(minutes=rng.randrange(2800))) for _ in range(60)})
    d = frame(spark, rows)
    f = spark.createDataFrame([(b, t, "k") for b, t in reports], "bike string, t timestamp, kind string")
    marks = fold(rows)
    want = []
    for b, t in reports:
        if not min(r[2] for r in rows) <= t <= max(r[2] for r in rows):
            continue
        alarms = [rows[i][4] for (bb, i), v in marks.items() if bb == b and v[3] and t - dt.timedelta(days=7) < rows[i][4] < t]
        n = sum(1 for (bb, i), v in marks.items() if alarms and bb == b and v[0] and min(alarms) < rows[i][2] < t)
        want.append((b, round(t.timestamp()), round(min(alarms).timestamp()) if alarms else None, n if alarms else None))
    for heavy in (None, find_heavy(d, "bike", "t0", 40)):
        m = chains.mark(d, identity="person", heavy=heavy)
        got = temporal.lead_times(m, f, heavy=heavy, span=d).select("bike", F.unix_seconds("t").alias("t"), F.unix_seconds("alarm_at").alias("a"), "duds_between").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_null_key_and_null_time_split_like_any_other(spark):
    rng = random.Random(8)
    rows = [(None if i % 3 == 0 else f"k{rng.randrange(4)}", None if i % 17 == 0 else rng.randrange(500), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, s long, i long, v long").withColumn("t", F.timestamp_seconds("s"))
    heavy = find_heavy(df, "k", "t", 30)
    assert heavy is not None and heavy.frame.where("_hkey is null").count() == 1

    def scan(h):
        d = Timeline(df, "k", ["t", "i"], h).add(a=running_sum(F.col("v")), b=previous(F.struct("i"))).done()
        return sorted((r.i, r.a, r.b and r.b.i) for r in d.collect())
    assert scan(None) == scan(heavy)


def test_null_and_nan_scores_are_the_same_at_both_sizes(spark, monkeypatch):
    rows = [(i, None if i % 5 == 0 else float("nan") if i == 7 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, s double")

    def chosen():
        return sorted(r.i for r in top_by_count(df, F.col("s"), ["i"], F.lit(5)).where("chosen").collect())
    small = chosen()
    monkeypatch.setattr(timeline, "MAX_ROWS", 10)
    assert small == chosen() and len(small) == 5 and all(i % 5 for i in small)
