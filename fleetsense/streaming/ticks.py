"""The whole live tick: rentals, marks, alarms with their probability at first sight, labels, samples, morning list and score,
hours, the current list as a document, retention and step times, all in one change of a ``Store``.

Nothing is marked twice. Rentals are stored with their marks, by day and bucket of bikes, and the last marked rental of
every bike is a table of its own. A tick marks the changed rentals on top of it; only for bikes with a late or corrected
rental are stored rentals from that one on marked again. Features count stored marks of the bikes in question.

Rows without a bike or a start are left out and counted in the step log. Late rows may come while their bike's earlier
rentals are kept. The same batch run again, whole or after an interruption at any stage, changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chains, features as X, model as M
from ..operators.lists import with_station
from ..operators.metrics import alarm_score
from ..operators.timeline import Heavy, saved
from ..rules import FRESH_HOURS, KEEP_DAYS, SETTLE_HOURS, Rule
from ..sources import sinks
from .live import TRIP_COLS
from .store import Change, Store, Table

RIDE = ("bike string, t0 timestamp, ord long, st0 string, t1 timestamp, st1 string, dist_m double, who string, "
        "dud boolean, retry boolean, streak long, alarm boolean")
NEXT = "next_t0 timestamp, next_dud boolean"
ENTRY = "bike string, station string, station_name string, chain long, level string, last_dud string"
# Days that each table keeps, minutes within which an alarm counts as seen live, when the morning list is made.
TABLES = {
    "rides": Table(RIDE, "t1", KEEP_DAYS),
    "last": Table(RIDE),
    "hours": Table("t timestamp, rows long", "t", KEEP_DAYS),
    "alarms": Table(f"bike string, at timestamp, station string, chain long, seen_at timestamp, p double, {NEXT}", "at", 10, "next_dud is not null"),
    "samples": Table(f"at timestamp, bike string, last_t0 timestamp, chain long, hist7_duds long, hist7_rentals long, prior_alarms7 long, dur_sec double, age_h double, shun double, p double, {NEXT}", "at"),
    "lists": Table(f"day date, {ENTRY}, generated timestamp"),
    "scores": Table("day date, listed long, rode long, first_dud long, scored_at timestamp"),
    "current": Table(f"{ENTRY}, minutes_ago long, t0 timestamp, t1 timestamp, p double"),
    "snapshot": Table("at timestamp, body string"),
    "steps": Table("at timestamp, step string, ms long", "at", 3),
}
SEEN_MINUTES_LIVE = 15
LIST_Q = -1.2816        # bound of a list before one is fitted: a tenth of normal outcomes lie below it
MORNING = (6, 10)
SAMPLE_DAYS = 8
DAY_US = 86_400_000_000
BROADCAST_ROWS = 500_000        # bikes, or keys of rentals, that every task may hold
STAGES = ["collect", "mark", "alarms", "settle", "hours", "morning", "samples", "list", "retention"]


def live_store(spark: SparkSession, root: str) -> Store:
    return Store(spark, root, TABLES)


def small(df: DataFrame, rows: int) -> DataFrame:
    """What stored rentals are looked up in; up to a checked size they are not moved for it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def day_of(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


class Tick:
    """One change of the tables at the time ``now`` (wall clock of the data, without a zone)."""

    def __init__(self, change: Change, now: datetime, stations: DataFrame, rule: Rule = Rule(), buckets: int = 2, heavy: Heavy | None = None,
                 q: float = LIST_Q):
        self.q = q
        self.c, self.now, self.stations, self.rule, self.buckets, self.heavy = change, now, stations, rule, buckets, heavy
        self.at = F.lit(now.isoformat(sep=" ")).cast("timestamp")
        self.changed: DataFrame | None = None       # new and corrected rentals of the batch, the days they began on, and how many
        self.days: list[str] = []                   # of them replace a stored one
        self.corrected = 0
        self.marked: DataFrame | None = None        # rentals that got marks in this tick
        self.open: DataFrame | None = None          # unlabelled alarms and samples with what is known so far
        self.scored: DataFrame | None = None        # features and probabilities of the bikes on the list

    # parts are named day.bucket, so both can be chosen without reading
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("bike"), F.lit(self.buckets)).cast("string")

    def part(self) -> Column:
        return F.concat_ws(".", day_of("t0"), self.bucket())

    def rides(self, since: datetime | None = None, until: datetime | None = None, buckets: list[str] | None = None) -> DataFrame:
        """Stored rentals that started on the days from ``since`` to ``until``, of some buckets of bikes."""
        def wanted(p: str) -> bool:
            day, bucket = p.rsplit(".", 1)
            return ((since is None or day >= since.strftime("%Y-%m-%d")) and (until is None or day <= until.strftime("%Y-%m-%d"))
                    and (buckets is None or bucket in buckets))
        return self.c.read("rides", [p for p in self.c.parts("rides") if wanted(p)])

    def collect(self, batch: DataFrame) -> bool:
        """Find what is new or different; the larger ordinal of a key that comes twice stands. False if nothing is."""
        batch = batch.where(F.col("bike").isNotNull() & F.col("t0").isNotNull())
        parts = [r[0] for r in batch.select(self.part()).distinct().collect()]
        latest = Window.partitionBy("bike", "t0").orderBy(*[F.desc(c) for c in ("ord", "t1", "st0", "st1", "dist_m", "who")])
        new = batch.select(*TRIP_COLS, F.row_number().over(latest).alias("_n")).where("_n = 1")
        values = F.struct(*sinks.TRIP_VALUES)
        old = self.c.read("rides", parts).select("bike", "t0", values.alias("_o"))
        new = new.join(old, ["bike", "t0"], "left").where(~values.eqNullSafe(F.col("_o")))
        self.changed = saved(new.select(*TRIP_COLS, F.col("_o").isNotNull().alias("_known")))
        found = self.changed.groupBy(day_of("t0").alias("day")).agg(F.count_if("_known").alias("known")).collect()
        self.days, self.corrected = [r.day for r in found], sum(r.known for r in found)
        return bool(found)

    def mark(self) -> None:
        """Mark the changed rentals on top of their bikes' last rental; bikes with an older one from that one on.

        Stored rentals of a bike that is not late all began before its changed ones, so only those of late bikes are replaced."""
        first = self.changed.groupBy("bike").agg(F.min("t0").alias("_from"))
        both = saved(first.join(self.c.read("last"), "bike", "left").withColumn("_late", F.coalesce(F.col("t0") >= F.col("_from"), F.lit(False))))
        touched = both.groupBy(self.bucket().alias("b")).agg(F.count_if("_late").alias("late")).collect()
        buckets = [r.b for r in touched]
        columns = [f.split()[0] for f in RIDE.split(", ")]
        seeds, rows, late = both.where(~F.col("_late") & F.col("t0").isNotNull()).select(*columns), self.changed.select(*TRIP_COLS), None
        if any(r.late for r in touched):
            late = small(both.where("_late").select("bike", "_from"), sum(r.late for r in touched))
            past = saved(self.rides(buckets=[r.b for r in touched if r.late]).join(late, "bike"))
            seeds = seeds.unionByName(chains.last_row(past.where(F.col("t0") < F.col("_from")).drop("_from"), "bike").select(*columns))
            after = past.where(F.col("t0") >= F.col("_from"))
            if self.corrected:
                after = after.join(small(self.changed.where("_known").select("bike", "t0"), self.corrected), ["bike", "t0"], "left_anti")
            rows = rows.unionByName(after.select(*rows.columns))
        self.marked = saved(chains.mark_on(rows, seeds, self.rule, "person", self.heavy))
        parts = [r[0] for r in self.marked.select(self.part()).distinct().collect()]
        kept = self.c.read("rides", parts)
        if late is not None:
            kept = kept.join(late, "bike", "left").where(F.col("_from").isNull() | (F.col("t0") < F.col("_from"))).select(*columns)
        self.c.replace("rides", kept.unionByName(self.marked.select(*columns)), self.part(), parts)
        newest = self.marked.where("newest").select(*columns)
        self.c.replace("last", self.c.read("last", buckets).join(newest, "bike", "left_anti").unionByName(newest), self.bucket(), buckets)

    def standing(self) -> DataFrame:
        """Bikes whose last rental leaves an unbroken chain and came back within a day."""
        rows = self.c.read("last").withColumn("chain", S.chain_after())
        return rows.where((F.col("chain") >= self.rule.alarm_k) & (F.col("t1") >= self.at - F.expr(f"interval {FRESH_HOURS} hours")))

    def features(self) -> DataFrame:
        """The seven live features at now, and their probability, of the bikes that stand on the list.

        Every bike whose alarm rang within a day and whose last rental is a dud is among them."""
        if self.scored is not None:
            return self.scored
        last = saved(self.standing().select("bike", "t0", "t1", "st1", "chain", S.seconds_between("t0", "t1").alias("dur_sec")))
        past = self.rides(self.now - timedelta(days=9)).select("bike", F.col("t0").alias("_t"), "dud", "alarm")
        week = (F.col("_t") <= F.col("t0")) & (F.unix_micros("_t") >= F.unix_micros("t0") - 7 * DAY_US)
        listed = last.count()
        counts = past.join(small(last.select("bike", "t0"), listed), "bike").where(week).groupBy("bike").agg(
            F.count("*").alias("hist7_rentals"), F.count_if("dud").alias("hist7_duds"), F.count_if("alarm").alias("_alarms"))
        rows = last.join(counts, "bike").withColumns({
            "prior_alarms7": F.col("_alarms") - F.when(F.col("chain") >= 2, 1).otherwise(0), "at": self.at,
            "age_h": F.greatest(F.lit(0.0), (F.unix_micros(self.at) - F.unix_micros("t1")) / 3.6e9), "_id": F.col("bike")}).drop("_alarms")
        back = self.now - timedelta(hours=25)
        starts = self.rides(back - timedelta(days=1)).where((F.col("t1") >= F.lit(back.isoformat(sep=" ")).cast("timestamp")) & (F.col("t0") < self.at))
        starts = starts.select("st0", "t0").join(small(last.select(F.col("st1").alias("st0")).distinct(), listed), "st0", "left_semi")
        self.scored = saved(M.explain(X.with_shun(rows, starts)))
        return self.scored

    def alarms(self) -> None:
        """Alarms of the marked rentals returned within a day are stored once, with the probability of this moment."""
        since = self.now - timedelta(hours=FRESH_HOURS)
        fresh = self.marked.where(F.col("alarm") & (F.col("t1") >= F.lit(since.isoformat(sep=" ")).cast("timestamp")))
        fresh = fresh.select("bike", F.col("t1").alias("at"), F.col("st1").alias("station"), (F.col("streak") + 1).alias("chain"), self.at.alias("seen_at"))
        days = [p for p in self.c.parts("alarms") if p >= since.strftime("%Y-%m-%d")]
        fresh = fresh.join(self.c.read("alarms", days), ["bike", "at"], "left_anti").join(self.features().select("bike", "p"), "bike", "left")
        fresh = saved(fresh.withColumns({"next_t0": F.lit(None).cast("timestamp"), "next_dud": F.lit(None).cast("boolean")}))
        parts = [r[0] for r in fresh.select(day_of("at")).distinct().collect()]
        if parts:
            self.c.replace("alarms", self.c.read("alarms", parts).unionByName(fresh), day_of("at"), parts)

    def settle(self) -> None:
        """Next other rider of alarms and samples without a label, as far as known; what is old enough to be final is stored."""
        def unlabelled(table: str, anchor: str, rows: DataFrame) -> DataFrame:
            return rows.where("next_dud is null").select("bike", "at", F.col(anchor).alias("_from"), F.lit(table).alias("_table"))

        rows = unlabelled("alarms", "at", self.c.read("alarms"))
        if self.now.minute % 30 < 5:
            since = self.now - timedelta(days=SAMPLE_DAYS)
            samples = self.c.read("samples", [p for p in self.c.parts("samples") if p >= since.strftime("%Y-%m-%d")])
            rows = rows.union(unlabelled("samples", "last_t0", samples.where(F.col("at") > F.lit(since.isoformat(sep=" ")).cast("timestamp"))))
        rows = saved(rows)
        size = rows.agg(F.count("*").alias("n"), day_of(F.min("_from")).alias("day")).first()
        # the next rider starts after the anchor: rentals of the days before the first one are not read
        rides = self.rides(datetime.fromisoformat(size.day)) if size.n else self.c.read("rides", [])
        rides = rides.join(small(rows.select("bike").distinct(), size.n), "bike", "left_semi")
        self.open = saved(chains.next_rider_after(rides, rows, "_from", self.heavy))
        sure = F.col("next_t0") < self.at - F.expr(f"interval {SETTLE_HOURS} hours")
        final = self.open.where(sure)
        parts = final.select("_table", day_of("at").alias("day")).distinct().collect()
        for table in sorted({r[0] for r in parts}):
            days = [r.day for r in parts if r[0] == table]
            out = self.c.read(table, days).join(final.where(F.col("_table") == table).select("bike", "at", F.struct("next_t0", "next_dud").alias("_n")), ["bike", "at"], "left")
            self.c.replace(table, out.withColumns({c: F.coalesce(c, f"_n.{c}") for c in ("next_t0", "next_dud")}), day_of("at"), days)

    def hours(self) -> None:
        """Rentals per hour of the days that changed, counted anew."""
        days = self.days
        rows = self.c.read("rides", [p for p in self.c.parts("rides") if p.rsplit(".", 1)[0] in days])
        counts = rows.groupBy(F.date_trunc("hour", "t0").alias("t")).agg(F.count("*").alias("rows"))
        self.c.replace("hours", counts, day_of("t"), days)

    def morning(self) -> None:
        """Once a day: the list from yesterday's last rentals, and the score of yesterday's list."""
        today, yesterday = self.now.strftime("%Y-%m-%d"), self.now - timedelta(days=1)
        if (self.now.hour, self.now.minute) < MORNING or today in self.c.parts("lists"):
            return
        rides = self.rides(yesterday, yesterday)
        last = chains.last_row(rides, "bike").withColumn("chain", S.chain_after()).where(F.col("chain") >= self.rule.alarm_k)
        out = with_station(last.withColumn("station", F.col("st1")), self.stations)
        day = F.lit(today).cast("date")
        out = out.select(day.alias("day"), "bike", "station", "station_name", "chain", S.alert_level(F.col("chain")).alias("level"),
                         S.short_time("t1").alias("last_dud"), self.at.alias("generated"))
        self.c.replace("lists", out, F.date_format("day", "yyyy-MM-dd"), [today])
        before = yesterday.strftime("%Y-%m-%d")
        if before in self.c.parts("lists"):
            listed = self.c.read("lists", [before]).select("day", "bike")
            first = chains.first_row(rides.where(~F.col("retry")), "bike").select("bike", "dud")
            score = listed.join(first, "bike", "left").groupBy("day").agg(
                F.count("*").alias("listed"), F.count("dud").alias("rode"), F.count_if("dud").alias("first_dud")).withColumn("scored_at", self.at)
            self.c.replace("scores", score, F.date_format("day", "yyyy-MM-dd"), [before])

    def samples(self) -> None:
        """Every three hours the current list with its features, where it is not stored yet."""
        if self.now.hour % 3 or self.now.minute >= 5:
            return
        own = self.now.strftime("%Y-%m-%d")
        old = self.c.read("samples", [own])
        new = self.features().where(F.col("t1") <= self.at).select(
            "at", "bike", F.col("t0").alias("last_t0"), *X.FEATURES7, "p", F.lit(None).cast("timestamp").alias("next_t0"), F.lit(None).cast("boolean").alias("next_dud"))
        self.c.replace("samples", old.unionByName(new.join(old, ["at", "bike"], "left_anti")), day_of("at"), [own])

    def list(self) -> None:
        """The current list with probabilities and reasons, and the document that clients read."""
        now = with_station(self.features().withColumn("station", F.col("st1")), self.stations)
        now = now.select("bike", "station", "station_name", "chain", S.alert_level(F.col("chain")).alias("level"), S.short_time("t1").alias("last_dud"),
                         S.minutes_ago("t1", self.at).alias("minutes_ago"), "t0", "t1", "p", "why")
        self.c.replace("current", now, F.lit("now"), ["now"])
        body = sinks.snapshot(now, self.at)
        today = self.now.strftime("%Y-%m-%d")
        rang = self.rides(self.now - timedelta(days=1)).where(F.col("alarm") & (F.col("t1") >= F.lit(today).cast("timestamp"))).agg(F.count("*").alias("n"))
        week = (F.date_trunc("hour", self.at - F.expr("interval 7 days")), F.date_trunc("hour", self.at))
        total = self.c.read("hours").where((F.col("t") > week[0]) & (F.col("t") <= week[1])).agg(F.sum("rows").alias("n"))
        newest = self.c.read("last").where(F.col("t1") <= self.at + F.expr("interval 5 minutes")).agg(F.date_format(F.max("t1"), "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
        sd = F.sqrt(F.sum(F.col("p") * (1 - F.col("p"))))
        sums = now.agg(F.to_json(F.struct(F.coalesce(F.round(F.sum("p"), 1), F.lit(0.0)).alias("expected"),
                                          F.greatest(F.lit(0), F.coalesce(F.floor(F.sum("p") + self.q * sd), F.lit(0))).alias("at_least"))).alias("m"))
        doc = body.select(self.at.alias("at"), F.to_json(F.struct(
            "body", sums.scalar().alias("model"), rang.scalar().alias("today_alarms"), total.scalar().alias("rentals_in_window"),
            newest.scalar().alias("latest_return"), self.score().select(F.to_json(F.struct("*"))).scalar().alias("score"))).alias("body"))
        self.c.replace("snapshot", doc, F.lit("now"), ["now"])

    def score(self) -> DataFrame:
        """How the alarms seen live came out, with what is known now of those that are not final."""
        rows = self.c.read("alarms").where(F.unix_micros("seen_at") - F.unix_micros("at") <= SEEN_MINUTES_LIVE * 60_000_000)
        rows = rows.join(self.open.where("_table = 'alarms'").select("bike", "at", F.col("next_dud").alias("_d")), ["bike", "at"], "left")
        return alarm_score(rows.select("at", F.col("p").alias("p_next"), F.coalesce("next_dud", "_d").alias("next_dud")))

    def retention(self) -> None:
        us = int((self.now - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        self.c.retain(us)

    def log(self, steps: list[tuple[str, int]]) -> None:
        rows = self.c.spark.createDataFrame(steps, "step string, ms long").select(self.at.alias("at"), "step", "ms")
        own = self.now.strftime("%Y-%m-%d")
        self.c.replace("steps", self.c.read("steps", [own]).unionByName(rows), day_of("at"), [own])


def tick(store: Store, stations: DataFrame, now: Column | None = None, rule: Rule = Rule(), buckets: int = 2, heavy: Heavy | None = None,
         q: float = LIST_Q, stream: str = "main", before: Callable[[str], None] | None = None):
    """Batch function of the live stream. ``now`` is an aggregate over the batch (default: the clock); ``before`` is called with
    the name of each stage, and of the commit."""
    def run(batch: DataFrame, batch_id: int) -> None:
        change = store.change(stream, batch_id)
        if change is None:
            return
        stamp = F.date_format(F.max(F.current_timestamp()) if now is None else now, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        head = batch.agg(stamp.alias("at"), F.count_if(F.col("bike").isNull() | F.col("t0").isNull()).alias("without")).first()
        if head.at is None:
            return
        t = Tick(change, datetime.fromisoformat(head.at), stations, rule, buckets, heavy, q)
        steps, fresh = [("rows without a bike or a start", head.without)], True
        for name in STAGES:
            if before is not None:
                before(name)
            began = time.monotonic()
            if name == "collect":
                fresh = t.collect(batch)
            elif fresh or name not in ("mark", "alarms", "hours"):
                getattr(t, name)()
            steps.append((name, int(1000 * (time.monotonic() - began))))
        t.log(steps)
        if before is not None:
            before("commit")
        change.commit()
        store.vacuum()
    return run
