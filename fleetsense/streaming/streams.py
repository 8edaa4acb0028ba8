"""Smaller streams: duplicates, hourly ledger, charger changes, collection segments, report limits, ordered alarms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ev import GAP_MINUTES
from ..operators.timeline import Timeline, previous, running_max, running_sum, saved
from ..rules import Rule
from ..sources.sinks import replace_partitions
from .live import read_or_none, run_available
from .store import Change, Store, Table

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def committed(stream: DataFrame, store: Store, apply: Callable[[Change, DataFrame], None], name: str) -> Store:
    """Run a stream whose batches are changes of a store; a batch that is committed is not applied again."""
    def each(batch: DataFrame, batch_id: int) -> None:
        change = store.change(name, batch_id)
        if change is not None:
            apply(change, batch)
            change.commit()
            store.vacuum()

    run_available(stream, store.root, each, name)
    return store


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)


def drop_repeats(stream: DataFrame, keys: list[str], time: str, root: str, day: str | None = None, buckets: int = 8) -> Store:
    """Identical rows of pages that are read again are dropped, however late or far apart; corrections differ in a key and
    pass. Of the equal rows of a batch the earliest stays. A time among the keys may be given as
    ``day``: equal rows share it, so a batch reads the stored rows of its own days only; else those of its own buckets of
    keys. The rows are in the table "seen"."""
    rest = sorted((c for c in stream.columns if c not in keys), key=lambda c: c != time)
    store = Store(stream.sparkSession, f"{root}/seen", {"seen": Table(ddl(stream))})
    part = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string") if day is None else F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("none"))

    def apply(change: Change, batch: DataFrame) -> None:
        new = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else batch.select(*keys).distinct()
        new = saved(new)
        days = [r[0] for r in new.select(part).distinct().collect()]
        old = change.read("seen", change.of_days("seen", days)).select(*[F.col(k).alias(f"_{k}") for k in keys])
        new = new.join(old, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti")
        change.append("seen", new, part)

    return committed(stream, store, apply, "seen")


def hourly_ledger(stream: DataFrame, root: str) -> str:
    """Rentals per hour. Keys are stored once, and the hours of a touched day are counted anew from them, so a page that is
    read again, or a replayed batch, changes nothing."""
    path, seen = f"{root}/ledger", f"{root}/ledger-keys"

    def each(batch: DataFrame, batch_id: int) -> None:
        keys = batch.select("bike", "t0").withColumn("day", F.to_date("t0"))
        old = read_or_none(batch.sparkSession, seen)
        if old is not None:
            keys = keys.unionByName(old.join(keys.select("day").distinct(), "day", "left_semi"))
        keys = saved(keys.distinct())
        replace_partitions(keys, seen, "day")
        hours = keys.groupBy("day", F.date_trunc("hour", "t0").alias("t")).agg(F.count("*").alias("rows"))
        replace_partitions(hours, path, "day")

    run_available(stream, root, each, "ledger")
    return path


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("t", "rows")


def changes(stream: DataFrame, signature: Column, root: str, buckets: int = 4, keep_days: int | None = None) -> Store:
    """Charger snapshots whose signature differs from the last stored one, in the table "changes", by day; the last signature
    of each charger is a table "last", by bucket: a batch reads and replaces the buckets of its own chargers only. With
    ``keep_days``, older changes go, as seen from the newest snapshot of a batch."""
    cols = ["charger", "at", "ord", "sig"]
    kinds = dict(stream.dtypes)
    schema = f"charger {kinds['charger']}, at timestamp, ord {kinds['ord']}, sig string"
    store = Store(stream.sparkSession, f"{root}/ev", {"changes": Table(schema, "at", keep_days), "last": Table(schema)})
    bucket = F.pmod(F.xxhash64("charger"), F.lit(buckets)).cast("string")

    def apply(change: Change, batch: DataFrame) -> None:
        rows = saved(batch.withColumn("sig", signature.cast("string")).select(*cols, F.lit(False).alias("_old")))
        mine = [r[0] for r in rows.select(bucket).distinct().collect()]
        last = change.read("last", mine)
        both = rows.unionByName(last.select(*cols, F.lit(True).alias("_old")))
        m = saved(Timeline(both, "charger", ["at", "ord"]).add(_p=previous(F.struct("sig"))).done())
        new = m.where(~F.col("_old") & (F.col("_p").isNull() | ~F.col("_p.sig").eqNullSafe(F.col("sig"))))
        change.append("changes", new.select(*cols), F.date_format("at", "yyyy-MM-dd"))
        newest = m.groupBy("charger").agg(F.max_by(F.struct("at", "ord", "sig"), F.struct("at", "ord")).alias("r")).select("charger", "r.*")
        change.replace("last", newest, bucket, mine)
        if keep_days is not None:
            change.retain(rows.agg(F.max(F.unix_micros("at"))).first()[0])

    return committed(stream, store, apply, "changes")


def collection_sessions(stream: DataFrame, key: str, time: str, root: str, gap_minutes: int = GAP_MINUTES,
                        name: str = "sessions") -> Store:
    """Segments of collection per source, in the table "segments": runs not more than the gap apart, however late or out of
    order they come. A batch makes segments of its own runs and merges them with the stored ones that they touch; parts by
    day of start whose segments all ended long before are not read."""
    gap = gap_minutes * 60_000_000
    kind = dict(stream.dtypes)[key]
    store = Store(stream.sparkSession, f"{root}/segments", {"segments": Table(f"{key} {kind}, start timestamp, until timestamp, runs long", "until")})
    day = F.date_format("start", "yyyy-MM-dd")

    def joined(rows: DataFrame) -> DataFrame:
        """Segments (key, start, until, runs) that overlap or lie within the gap become one."""
        d = Timeline(rows, key, ["start", "until"]).add(_end=running_max(F.unix_micros("until"), here=False))
        d = d.with_columns(_new=F.coalesce((F.unix_micros("start") - F.col("_end") > gap).cast("int"), F.lit(1))).add(_g=running_sum(F.col("_new"))).done()
        return d.groupBy(key, "_g").agg(F.min("start").alias("start"), F.max("until").alias("until"), F.sum("runs").alias("runs")).drop("_g")

    def apply(change: Change, batch: DataFrame) -> None:
        new = saved(joined(batch.where(F.col(time).isNotNull()).select(key, F.col(time).alias("start"), F.col(time).alias("until"), F.lit(1).cast("long").alias("runs"))))
        span = new.agg(F.min(F.unix_micros("start")).alias("lo"), F.date_format(F.max(F.timestamp_micros(F.unix_micros("until") + gap)), "yyyy-MM-dd").alias("hi")).first()
        if span.lo is None:
            return
        near = [p for p, (_, high) in change.state.parts.get("segments", {}).items() if p <= span.hi and high >= span.lo - gap]
        change.replace("segments", joined(change.read("segments", near).unionByName(new)), day, near)

    return committed(stream, store, apply, name)


def _stateful(stream: DataFrame, key: str, processor, schema: str, root: str, name: str) -> str:
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    d = stream.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "None")
    path = f"{root}/{name}"
    q = (d.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{root}/offsets-{name}")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def limit_reports(stream: DataFrame, root: str, most: int = 3, minutes: int = 10, name: str = "reports") -> Store:
    """Accept at most three reports per bike in ten minutes, counting accepted ones only, in the order of (at, id).

    The table "reports" holds every report with its decision, by day. The answer does not depend on how the input is cut into
    batches or ordered: a batch decides its bikes' reports anew from its earliest one on, from the accepted ones in the
    window before it; nothing is dropped for being late. Reports that come twice count once. A task passes over sorted
    reports and holds at most ``most`` times. Reports without a time are left out."""
    window = minutes * 60_000_000
    kinds = dict(stream.dtypes)
    store = Store(stream.sparkSession, f"{root}/reports", {"reports": Table(f"id {kinds['id']}, bike {kinds['bike']}, at timestamp, accepted boolean", "at")})
    day = F.date_format("at", "yyyy-MM-dd")

    def decide(batches):
        import pyarrow as pa

        bike, kept = None, []
        for batch in batches:
            flags = []
            for b, us, seed in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                if b != bike:
                    bike, kept = b, []
                kept = [k for k in kept if k > us - window]
                flags.append(seed or len(kept) < most)
                if flags[-1]:
                    kept.append(us)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(flags, pa.bool_())], ["id", "bike", "us", "seed", "accepted"])

    def apply(change: Change, batch: DataFrame) -> None:
        new = saved(batch.where(F.col("at").isNotNull()).select("id", "bike", "at").distinct())
        low = new.agg(F.date_format(F.timestamp_micros(F.min(F.unix_micros("at")) - window), "yyyy-MM-dd")).first()[0]
        if low is None:
            return
        parts = [p for p in change.parts("reports") if p >= low]
        old = change.read("reports", parts)
        new = saved(new.join(old.select("id"), "id", "left_anti"))
        first = new.groupBy(F.col("bike").alias("_bike")).agg(F.min("at").alias("_first"))
        old = old.join(first, F.col("bike").eqNullSafe(F.col("_bike")), "left")
        stay = F.col("_first").isNull() | (F.col("at") < F.col("_first"))
        seeds = old.where(F.col("accepted") & (F.col("at") < F.col("_first")) & (F.unix_micros("at") > F.unix_micros("_first") - window))
        row = ["id", "bike", F.unix_micros("at").alias("us")]
        todo = new.select(*row, F.lit(False).alias("seed")).unionByName(old.where(~stay).select(*row, F.lit(False).alias("seed")))
        todo = todo.unionByName(seeds.select(*row, F.lit(True).alias("seed")))
        done = todo.repartition("bike").sortWithinPartitions("bike", "us", "id").mapInArrow(decide, f"id {kinds['id']}, bike {kinds['bike']}, us long, seed boolean, accepted boolean")
        done = done.where("not seed").select("id", "bike", F.timestamp_micros("us").alias("at"), "accepted")
        change.replace("reports", old.where(stay).select("id", "bike", "at", "accepted").unionByName(done), day, parts)

    return committed(stream, store, apply, name)


def ordered_alarms(stream: DataFrame, root: str, rule: Rule = Rule()) -> str:
    """Alarm at once, from keyed state, for rows that arrive in order; an older row is handed back as 'late'."""
    from pyspark.sql.streaming import StatefulProcessor

    max_us, max_m, alarm_at = int(rule.max_sec * 1e6), rule.max_m, rule.alarm_k - 1

    class Chain(StatefulProcessor):
        def init(self, handle):
            self.state = handle.getValueState("last", "us bigint, ord bigint, who string, dud boolean, streak bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            last = self.state.get() if self.state.exists() else None
            for pdf in rows:
                pdf = pdf.sort_values(["u0", "ord"])
                out = []
                for r in pdf.itertuples(index=False):
                    if last is not None and (r.u0, r.ord) < (last[0], last[1]):
                        out.append((r.bike, r.ord, "late", r.u1, r.st1, None))
                        continue
                    who = None if pd.isna(r.who) else r.who
                    dud = bool(r.st0 == r.st1 and r.u1 - r.u0 <= max_us and r.dist_m < max_m)
                    retry = last is not None and who is not None and who == last[2]
                    streak = last[4] + (not retry) if last is not None and last[3] else 0
                    if dud and not retry and streak == alarm_at:
                        out.append((r.bike, r.ord, "alarm", r.u1, r.st1, streak + 1))
                    last = (int(r.u0), int(r.ord), who, dud, int(streak))
                yield pd.DataFrame(out, columns=["bike", "ord", "kind", "at_us", "station", "chain"])
            if last is not None:
                self.state.update(last)

        def close(self):
            pass

    d = stream.select("bike", "ord", "st0", "st1", "dist_m", "who", F.unix_micros("t0").alias("u0"), F.unix_micros("t1").alias("u1"))
    return _stateful(d, "bike", Chain(), "bike string, ord bigint, kind string, at_us bigint, station string, chain bigint", root, "ordered")
