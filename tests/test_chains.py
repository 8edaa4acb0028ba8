import pytest
from pyspark.sql import functions as F

from fleetsense.functions.scalars import chain_after
from fleetsense.operators import chains, metrics
from fleetsense.operators.timeline import Timeline, find_heavy, last_known, next_known, running_max, running_sum
from fleetsense.rules import Rule
from tests.helpers import fold, frame, random_trips, trip


def marks(spark, rows, **kw):
    d = chains.mark(frame(spark, rows), **kw)
    return [tuple(r) for r in d.orderBy("bike", "t0").select("dud", "retry", "streak", "alarm").collect()]


def test_dud_bounds(spark):
    rows = [trip("A", 0, 60, True, 50), trip("A", 30, 300, True, 0), trip("A", 60, 60, False, 50), trip("A", 90, 60, True, 900),
            trip("A", 120, 180, True, 299), trip("A", 150, 181, True, 0), trip("A", 180, 60, True, 300)]
    assert [m[0] for m in marks(spark, rows)] == [True, False, False, False, True, False, False]


def test_two_people_make_an_alarm(spark):
    rows = [trip("A", 0, 60, who="1990F"), trip("A", 10, 60, who="2001M"), trip("A", 20, 1800, False, 3000, "1980M")]
    assert [(m[2], m[3]) for m in marks(spark, rows)] == [(0, False), (1, True), (2, False)]


def test_same_person_is_a_retry(spark):
    rows = [trip("A", 0, 60, who="1990F"), trip("A", 2, 60, who="1990F"), trip("A", 20, 1800, False, 3000, "1980M")]
    m = marks(spark, rows)
    assert [x[1] for x in m] == [False, True, False]
    assert [x[2] for x in m] == [0, 0, 1]
    assert not any(x[3] for x in m)


def test_normal_ride_resets(spark):
    rows = [trip("A", 0, 60, who="a"), trip("A", 10, 1800, False, 3000, "b"), trip("A", 60, 60, who="c"), trip("B", 5, 60, who="d")]
    # the ride itself still sees the chain of one before it
    assert [m[2] for m in marks(spark, rows)] == [0, 1, 0, 0]


def test_gap_mode(spark):
    rows = [trip("A", 0, 30), trip("A", 1, 30), trip("A", 10, 30), trip("A", 40, 1800, False, 3000)]
    m = marks(spark, rows)     # no person key anywhere: the gap rule is chosen
    assert [x[1] for x in m] == [False, True, False, False]
    assert [x[2] for x in m] == [0, 0, 1, 2]
    assert [x[3] for x in m] == [False, False, True, False]


def test_next_dud_table_and_prevented(spark):
    rows = [trip("A", 0, 60, who="a"), trip("A", 10, 60, who="b"), trip("A", 20, 60, who="c")]
    m = chains.mark(frame(spark, rows))
    assert {r.k: r.next_dud_pct for r in metrics.next_dud_table(m).collect()}[2] == 100.0
    assert metrics.prevented(m).first().prevented == 1


@pytest.mark.parametrize("mode", ["person", "gap", "none"])
@pytest.mark.parametrize("seed", [1, 2])
def test_window_form_equals_sequential_fold(spark, mode, seed):
    rows = random_trips(seed)
    want = fold(rows, mode=mode)
    got = chains.mark(frame(spark, rows), identity=mode).select("bike", "ord", "dud", "retry", "streak", "alarm").collect()
    assert {(r.bike, r.ord): (r.dud, r.retry, r.streak, r.alarm) for r in got} == want


def test_partition_count_does_not_matter(spark):
    rows = frame(spark, random_trips(3))
    want = sorted(map(tuple, chains.mark(rows, identity="person").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(tuple, chains.mark(rows, identity="person").collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def all_features(df, heavy):
    m = chains.mark(df, identity="person", heavy=heavy)
    rows = chains.last_normal(chains.run_features(chains.history(m, 7, heavy)))
    rows = chains.with_next_any(chains.with_next_rider(rows)).with_columns(chain=chain_after())
    return rows.done().drop("_at", "_leave")


def test_heavy_keys_are_split_without_changing_results(spark):
    df = frame(spark, random_trips(4, n=900))
    heavy = find_heavy(df, "bike", "t0", max_rows=60)
    assert heavy is not None and heavy.rows >= 2
    sliced = Timeline(df, "bike", ["t0", "ord"], heavy).df.where("bike = 'hot'")
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) > 10 and max(sizes) <= 60          # the hot bike is in many groups, none above the limit
    cols = sorted(all_features(df, None).columns)
    plain = sorted(map(str, all_features(df, None).select(cols).collect()))
    assert sorted(map(str, all_features(df, heavy).select(cols).collect())) == plain
    a = chains.mark(df, identity="person")
    b = chains.mark(df, identity="person", heavy=heavy)
    key = ["bike", "ord", "next_t0", "next_dud"]
    x = chains.next_rider_after_return(a, F.col("alarm"), None).select(key)
    y = chains.next_rider_after_return(b, F.col("alarm"), heavy).select(key)
    assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    grid = metrics.rule_grid(df)
    assert sorted(map(str, grid.collect())) == sorted(map(str, metrics.rule_grid(df, heavy=heavy).collect()))


def test_timeline_scans_in_slices(spark):
    df = spark.range(200).select(F.lit("k").alias("key"), F.col("id").alias("t"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("v"))

    def scans(tl):
        return sorted(map(str, tl.add(s=running_sum(F.col("t")), p=running_sum(F.lit(1), here=False), m=running_max(F.col("v")), l=last_known(F.col("v")),
                                      h=last_known(F.col("v"), here=True), n=next_known(F.col("v")), g=next_known(F.col("v"), here=True)).done().collect()))
    want = scans(Timeline(df, "key", ["t"]))
    assert scans(Timeline(df, "key", ["t"], slice_by=F.floor(F.col("t") / 9))) == want
    assert scans(Timeline(df, [], ["t"], slice_by=F.floor(F.col("t") / 31))) == want


def test_run_return_and_before_normal(spark):
    rows = [trip("A", 0, 60, who="a"), trip("A", 10, 60, who="b"), trip("A", 20, 60, who="b"), trip("A", 60, 1800, False, 9000, "c"), trip("A", 120, 60, who="d")]
    m = chains.mark(frame(spark, rows), identity="person")
    ends = {r.ord: r.run_end for r in chains.run_last_return(m).collect()}
    assert ends[0] == ends[1] == ends[2] and ends[3] is None and ends[4] is not None
    left = chains.before_normal(m.withColumn("day", F.to_date("t0")), "day", "bike")
    assert sorted(r.ord for r in left.collect()) == [0, 1]
    assert chains.before_normal(m.withColumn("day", F.to_date("t0")), "day", "bike", skip_retry=False).count() == 3


def test_rule_values():
    r = Rule()
    assert (r.max_sec, r.max_m, r.alarm_k, r.retry_gap_sec) == (180, 300.0, 2, 120)
