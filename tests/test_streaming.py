import datetime as dt

from pyspark.sql import functions as F

from fleetsense.operators import chains
from fleetsense.schema import STATIONS, TRIPS
from fleetsense.streaming import live, streams
from tests.helpers import BASE, fold, frame, random_trips


def landed(spark, tmp_path, rows, parts, order):
    """Rows as parquet files that arrive one after another."""
    d = frame(spark, rows)
    path = tmp_path / "in"
    ranked = sorted(range(len(rows)), key=order)
    size = -(-len(rows) // parts)
    for p in range(parts):
        ids = ranked[p * size:(p + 1) * size]
        d.where(F.col("ord").isin(ids)).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(TRIPS).option("maxFilesPerTrigger", 1).parquet(str(path))


def batch_alarms(spark, rows):
    return {(b, i) for (b, i), v in fold(rows).items() if v[3]}


def test_live_alarms_in_return_order(spark, tmp_path):
    rows = random_trips(11, n=300)
    tables = live.LiveTables(spark, str(tmp_path / "live"))
    stream = landed(spark, tmp_path, rows, 4, lambda i: rows[i][4])
    live.run_available(stream, tables.root, live.tick(tables))
    marked = chains.mark(tables.rentals().drop("day"), identity="person")
    got = {(r.bike, r.ord) for r in marked.where("alarm").collect()}
    assert got == batch_alarms(spark, rows)
    # everything that is an alarm in the end was recorded; late rows may leave earlier records behind, as a log should
    ends = {(r.bike, r.at) for r in tables.alarms().collect()}
    assert {(r.bike, r.t1) for r in marked.where("alarm").collect()} <= ends
    assert tables.alarms().groupBy("bike", "at").count().where("count > 1").count() == 0
    assert {r.step for r in tables.timings_frame().collect()} == {"upsert", "alarms"}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    rows = random_trips(12, n=120)
    tables = live.LiveTables(spark, str(tmp_path / "live"))
    run = live.tick(tables)
    d = frame(spark, rows)
    for _ in range(2):
        run(d, 0)
    assert tables.rentals().count() == len(rows)
    assert tables.alarms().groupBy("bike", "at").count().where("count > 1").count() == 0
    assert tables.alarms().count() == len(batch_alarms(spark, rows))


def test_corrections_win_and_snapshot_is_written(spark, tmp_path):
    now = F.lit("2026-06-01 12:00:00").cast("timestamp")
    t = [("A", 0, BASE, "1", BASE + dt.timedelta(seconds=60), "1", 0.0, "x"), ("A", 1, BASE + dt.timedelta(minutes=10), "1", BASE + dt.timedelta(minutes=40), "1", 0.0, "y")]
    fixed = [("A", 2, BASE + dt.timedelta(minutes=10), "1", BASE + dt.timedelta(minutes=11), "1", 0.0, "y")]
    tables = live.LiveTables(spark, str(tmp_path / "live"))
    run = live.tick(tables)
    run(spark.createDataFrame(t, TRIPS), 0)
    assert tables.alarms().count() == 0
    run(spark.createDataFrame(fixed, TRIPS), 1)
    assert [(r.bike, r.chain) for r in tables.alarms().collect()] == [("A", 2)]
    doc = live.live_document(tables, now, spark.createDataFrame([], STATIONS)).first()
    assert '"bike":"A"' in doc.body and '"alarms":1' in doc.score and '"waiting":1' in doc.score


def test_ordered_alarms_over_files(spark, tmp_path):
    rows = random_trips(13, n=300)
    stream = landed(spark, tmp_path, rows, 3, lambda i: rows[i][2])
    got = spark.read.parquet(streams.ordered_alarms(stream, str(tmp_path / "s"))).collect()
    assert {(r.bike, r.ord) for r in got if r.kind == "alarm"} == batch_alarms(spark, rows)
    assert not [r for r in got if r.kind == "late"]


def test_rows_out_of_order_are_handed_back(spark, tmp_path):
    rows = random_trips(14, n=60)
    stream = landed(spark, tmp_path, rows, 2, lambda i: -rows[i][2].timestamp())
    got = spark.read.parquet(streams.ordered_alarms(stream, str(tmp_path / "s"))).collect()
    assert [r for r in got if r.kind == "late"]


def test_report_limit(spark, tmp_path):
    rows = [(i, f"b{i % 3}", BASE + dt.timedelta(seconds=40 * i)) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, bike string, at timestamp")
    for p in range(2):
        d.where(F.col("id") % 2 == p).unionByName(d.where(F.col("id") < 10 * p)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))    # late and repeated
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.id: r.accepted for r in streams.limit_reports(s, str(tmp_path / "s")).read("reports").collect()}
    assert len(got) == len(rows) and not all(got.values())
    kept = {}
    for i, b, t in rows:
        recent = [x for x in kept.get(b, []) if x > t - dt.timedelta(minutes=10)]
        assert got[i] == (len(recent) < 3)
        kept[b] = recent + [t] * (len(recent) < 3)


def test_changes_and_ledger_over_batches(spark, tmp_path):
    rows = [(f"c{i % 4}", BASE + dt.timedelta(minutes=5 * i), i, "2" if i % 16 < 8 else "3") for i in range(80)]
    d = spark.createDataFrame(rows, "charger string, at timestamp, ord long, stat string")
    for p in range(4):
        d.where(F.floor(F.col("ord") / 20) == p).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.ord for r in streams.changes(stream(), F.col("stat"), str(tmp_path / "s")).read("changes").collect()}
    last, want = {}, set()
    for c, _, o, s in rows:
        if last.get(c) != s:
            want.add(o)
        last[c] = s
    assert got == want
    # a page that is read again does not double its hours
    d.where("ord < 30").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = streams.hourly_ledger(stream().withColumnsRenamed({"at": "t0", "charger": "bike"}), str(tmp_path / "h"))
    assert streams.ledger_of(spark, path).agg(F.sum("rows").alias("n")).first().n == 80
    assert streams.ledger_of(spark, path).count() == d.select(F.date_trunc("hour", "at")).distinct().count()


def test_runs_longer_than_the_window_over_many_batches(spark, tmp_path):
    # A: one run of 40 days; B: a normal rental, then duds; C: nothing but duds, 12 days apart; who None on some days
    rows = []
    for bike, step, normal in (("A", 1, ()), ("B", 1, (3,)), ("C", 12, ())):
        for i in range(0, 40, step):
            t = BASE + dt.timedelta(days=i)
            rows.append((bike, len(rows), t, "1", t + dt.timedelta(minutes=30 if i in normal else 1), "1", 0.0, None if i % 5 == 4 else f"p{i // 2 % 7}"))
    tables = live.LiveTables(spark, str(tmp_path / "live"))
    stream = landed(spark, tmp_path, rows, 5, lambda i: rows[i][2])
    live.run_available(stream, tables.root, live.tick(tables))
    marked = chains.mark(frame(spark, rows), identity="person").where("alarm")
    want = sorted((r.bike, r.t1, r.streak + 1) for r in marked.collect())
    assert sorted((r.bike, r.at, r.chain) for r in tables.alarms().collect()) == want and want


def test_repeats_late_and_far_apart_over_batches(spark, tmp_path):
    rows = [(f"c{i % 3}", None if i % 2 else "x", BASE + dt.timedelta(days=d), i) for d in (100, 0, 400, 1) for i in range(6)]
    rows += [("late", "x", BASE - dt.timedelta(days=300), 0)]
    d = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "charger string, stat string, at timestamp, i long, n long")
    for p in range(4):
        d.where(F.floor(F.col("n") / 7) == p).drop("n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.drop("n").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.drop_repeats(stream, ["charger", "stat"], "at", str(tmp_path / "s")).read("seen").collect()
    assert len(got) == 7 and {(r.charger, r.stat) for r in got} == {(r[0], r[1]) for r in rows}


def test_a_batch_reads_the_days_that_it_touches(spark, tmp_path):
    """Over many batches the stored rows that one of them reads stay as few as those of its days."""
    read, plain = [], streams.Change.read

    def watched(self, table, parts=None):
        out = plain(self, table, parts)
        read.append(out.count())
        return out

    d = spark.range(0, 24 * 15).select((F.col("id") % 7).alias("key"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 3_600_000_000).alias("at"), F.col("id").alias("n"))
    for p in range(15):
        d.where((F.col("n") >= 24 * p) & (F.col("n") < 24 * (p + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.Change.read = watched
    try:
        store = streams.drop_repeats(stream, ["key", "at"], "at", str(tmp_path / "s"), "at")
    finally:
        streams.Change.read = plain
    assert store.read("seen").count() == 24 * 15 and len(read) >= 15 and max(read) <= 48


def test_sessions_in_any_order(spark, tmp_path):
    minutes = [0, 10, 35, 61, 80, 200, 226, 250, 1400, 1420, 1446, 2900]      # gaps of 25 stay joined, longer ones part
    rows = [(k, BASE + dt.timedelta(minutes=m)) for k in ("a", "b") for m in minutes if k == "a" or m % 20 == 0]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "op string, at timestamp, n long")
    want = []
    for k in ("a", "b"):
        own = sorted(t for op, t in rows if op == k)
        for t in own:
            if want and want[-1][0] == k and t - want[-1][2] <= dt.timedelta(minutes=25):
                want[-1] = (k, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((k, t, t, 1))
    for part in (1, 0, 2):
        d.where(F.col("n") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("op", "at")
    got = streams.collection_sessions(stream, "op", "at", str(tmp_path / "s")).read("segments").collect()
    assert sorted(tuple(r) for r in got) == sorted((k, a.replace(tzinfo=None), b.replace(tzinfo=None), n) for k, a, b, n in want)
