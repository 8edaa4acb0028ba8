"""The live job: a stream of rentals kept in a table, with lists and alarms refreshed every micro-batch.

Late and corrected rows are normal (a long trip arrives hours after its start), so nothing is dropped by a
watermark: each batch is upserted on (bike, t0) and the touched bikes are marked again from the stored window.
Every step is idempotent, so a replayed batch changes nothing.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_dud
from ..operators import chains, lists, training
from ..operators.metrics import alarm_score
from ..operators.timeline import Heavy, ensure_checkpoint_dir, saved
from ..rules import KEEP_DAYS, Rule
from ..sources import sinks

TRIP_COLS = ["bike", "t0", "ord", "st0", "t1", "st1", "dist_m", "who"]
ALARMS = "bike string, at timestamp, station string, chain long, seen_at timestamp, day date"
ALARM_COLS = ["bike", "at", "station", "chain", "seen_at"]


def workspace(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder for tables and stream offsets."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


@dataclass
class LiveTables:
    """Rentals by day, alarms by day, and step timings below one root folder."""

    spark: SparkSession
    root: str

    @property
    def rentals_path(self) -> str:
        return f"{self.root}/rentals"

    @property
    def alarms_path(self) -> str:
        return f"{self.root}/alarms"

    def rentals(self) -> DataFrame:
        return self.spark.read.parquet(self.rentals_path)

    def alarms(self) -> DataFrame:
        found = read_or_none(self.spark, self.alarms_path)
        return self.spark.createDataFrame([], ALARMS) if found is None else found

    def upsert(self, batch: DataFrame) -> DataFrame:
        """Store the batch; returns the bikes that changed. Only days that hold a changed row are rewritten."""
        new = batch.select(*TRIP_COLS).withColumn("day", F.to_date("t0"))
        # a key may come more than once in a batch; the larger ordinal is the later reading
        new = new.groupBy("bike", "t0").agg(F.max_by(F.struct(*new.columns), "ord").alias("r")).select("r.*")
        old = read_or_none(self.spark, self.rentals_path)
        if old is None:
            old = new.where(F.lit(False))
        else:
            old = old.join(new.select("day").distinct(), "day", "left_semi")
        merged = saved(sinks.upsert(old, new, ["bike", "t0"], TRIP_COLS[2:]).withColumn("day", F.to_date("t0")))
        changed = merged.where("changed").select("day", "bike")
        sinks.replace_partitions(merged.join(changed.select("day").distinct(), "day", "left_semi").drop("changed"),
                                 self.rentals_path, "day")
        return changed.select("bike").distinct()

    def since_normal(self, bikes: DataFrame, since: date, days: int, rule: Rule) -> tuple[DataFrame, date]:
        """Rentals of the bikes from a day on, and the first day read. A bike that begins with a dud there is read back, in
        growing steps, to a rental that was not given up, or to its first one: a run never reaches across a normal rental."""
        table = self.rentals()
        oldest = table.agg(F.min("day")).first()[0]

        def part(on: Column, which: DataFrame) -> tuple[DataFrame, DataFrame]:
            d = saved(table.where(on).join(which, "bike", "left_semi"))
            start = d.groupBy("bike").agg(F.min_by(is_dud(rule), F.struct("t0", "ord")).alias("dud"))
            return d, start.where(~F.coalesce("dud", F.lit(False))).select("bike")

        rows, closed = part(F.col("day") >= since, bikes)
        left = saved(bikes.join(closed, "bike", "left_anti"))
        while oldest < since and not left.isEmpty():
            until, since, days = since, max(oldest, since - timedelta(days=max(days, 1))), 2 * max(days, 1)
            more, closed = part((F.col("day") >= since) & (F.col("day") < until), left)
            rows, left = rows.unionByName(more), saved(left.join(closed, "bike", "left_anti"))
        return rows, since

    def record_alarms(self, bikes: DataFrame, seen_at: Column, first: DataFrame, rule: Rule = Rule(),
                      heavy: Heavy | None = None, days: int = KEEP_DAYS) -> None:
        """Insert alarms of the changed bikes that are not recorded yet; known ones keep their first seen time.

        ``first`` is the earliest time in the batch (one row). Day folders from ``days`` before it are read, and older
        ones for bikes whose run of duds may reach back further.
        """
        since = first.toDF("t").select(F.date_sub(F.to_date("t"), days)).first()[0]
        rows, since = self.since_normal(bikes, since, days, rule)
        m = chains.mark(rows.drop("day"), rule, "person", heavy)
        found = m.where("alarm").select("bike", F.col("t1").alias("at"), F.col("st1").alias("station"),
                                        (F.col("streak") + 1).alias("chain"), seen_at.alias("seen_at"))
        known = self.alarms().where(F.col("day") >= since).select("bike", "at")
        found = found.join(known, ["bike", "at"], "left_anti")
        # append per batch: a replay finds its own alarms and adds none
        saved(found).withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(self.alarms_path)

    def prune(self, now: Column, days: int = KEEP_DAYS) -> DataFrame:
        return sinks.retention(self.rentals(), now, "t1", days)

    def log_steps(self, batch_id: int, steps: list[tuple[str, int]]) -> None:
        """Store the milliseconds of the steps of a batch; a replay adds its own."""
        rows = self.spark.createDataFrame(steps, "step string, ms long").withColumn("batch", F.lit(batch_id).cast("long"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/steps")

    def timings_frame(self) -> DataFrame:
        return self.spark.read.schema("step string, ms long, batch long").parquet(f"{self.root}/steps")


def tick(tables: LiveTables, seen_at: Column | None = None, rule: Rule = Rule(), heavy: Heavy | None = None):
    """Batch function of the live stream: upsert, then alarms of the touched bikes."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch = saved(batch)
        start = time.monotonic()
        bikes = tables.upsert(batch)
        stored = time.monotonic()
        now = F.current_timestamp() if seen_at is None else seen_at
        tables.record_alarms(bikes, now, batch.agg(F.min("t0")), rule, heavy)
        tables.log_steps(batch_id, [("upsert", int(1000 * (stored - start))), ("alarms", int(1000 * (time.monotonic() - stored)))])
    return run


def run_available(stream: DataFrame, root: str, each, name: str = "main") -> None:
    """Process what is there now and stop; a production job uses a five-minute trigger with the same function.

    Offsets live under the root by stream name, so the next call goes on where this one ended.
    """
    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/offsets-{name}")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def settled_alarms(tables: LiveTables, now: Column, heavy: Heavy | None = None, rule: Rule = Rule()) -> DataFrame:
    """Stored alarms with the outcome of the next rider, once that is old enough to be final."""
    m = chains.mark(tables.rentals().drop("day"), rule, "person", heavy)
    a = chains.next_rider_after(m, tables.alarms().select(*ALARM_COLS), "at", heavy)
    return training.settle(a, now)


def live_document(tables: LiveTables, now: Column, stations: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    """The list as one JSON document plus the running score of past alarms."""
    now_list = lists.live_list(tables.rentals().drop("day"), now, stations, heavy=heavy)
    score = alarm_score(settled_alarms(tables, now, heavy).withColumn("p_next", F.lit(None).cast("double")))
    doc = sinks.snapshot(now_list, now)
    return doc.withColumn("score", score.select(F.to_json(F.struct("alarms", "scored", "next_rider_dud", "waiting"))).scalar())
