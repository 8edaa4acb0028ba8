"""What a feed of station stock alone would show: a bike leaving and coming back within minutes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent
from ..rules import Rule
from .timeline import Heavy, Timeline, following, previous, saved

WINDOW_HOURS = 3


def flickers(trips: DataFrame, step: int, rule: Rule = Rule(), heavy: Heavy | None = None) -> DataFrame:
    """Stock changes per station and bucket of ``step`` seconds; -1 followed by +1 soon enough is a flicker.

    Changes are summed per (station, bucket) before any ordering, so a busy station shrinks to its buckets.
    """
    def bucket(c: str):
        return F.floor(F.unix_micros(c) / (step * 1_000_000))

    ends = trips.select(F.explode(F.array(
        F.struct(F.col("st0").alias("st"), bucket("t0").alias("b"), F.lit(-1).alias("d")),
        F.struct(F.col("st1").alias("st"), bucket("t1").alias("b"), F.lit(1).alias("d")))).alias("e")).select("e.*")
    net = ends.groupBy("st", "b").agg(F.sum("d").alias("d")).where("d != 0")
    net = net.withColumn("_at", F.timestamp_micros(F.col("b") * step * 1_000_000))
    rows = Timeline(net, "st", ["_at"], heavy).add(_n=following(F.struct("b", "d"))).done()
    limit = math.ceil(rule.max_sec / step) + 1
    gap = F.col("_n.b") - F.col("b")
    return rows.where((F.col("d") == -1) & (F.col("_n.d") == 1) & gap.between(1, limit)).select("st", F.col("b").alias("b0"), F.col("_n.b").alias("b1"))


def match(trips: DataFrame, marked: DataFrame, step: int, rule: Rule = Rule(), heavy: Heavy | None = None) -> DataFrame:
    """Recall and precision of flickers against true duds, and of station alarms against bike alarms."""
    def bucket(c: str):
        return F.floor(F.unix_micros(c) / (step * 1_000_000))

    fl = saved(flickers(trips, step, rule, heavy))
    marked = saved(marked.where("dud").select("st0", "st1", "t0", "t1", "alarm"))
    duds = marked.select(F.col("st0").alias("st"), bucket("t0").alias("b0"), bucket("t1").alias("b1"))
    hit = duds.distinct().join(fl.distinct(), ["st", "b0", "b1"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    order = fl.withColumn("_at", F.timestamp_micros(F.col("b1") * step * 1_000_000))
    rows = Timeline(order, "st", ["_at"], heavy).add(_p=previous(F.col("b1"))).done()
    station = rows.where((F.col("b1") - F.col("_p")) * step <= WINDOW_HOURS * 3600).select("st", F.col("b1").alias("b"))
    true = marked.where("alarm").select(F.col("st1").alias("st"), bucket("t1").alias("b"))

    def matched(a: DataFrame, b: DataFrame):
        near = b.select("st", F.explode(F.array(*[F.col("b") + s for s in (-1, 0, 1)])).alias("b")).distinct()
        return a.distinct().join(near, ["st", "b"], "left_semi").agg(F.count(F.lit(1)).alias("n")).scalar()

    n = F.count(F.lit(1))
    base = duds.agg(n.alias("duds"), F.max(hit).alias("hits"))
    base = base.withColumns({"flickers": fl.agg(n.alias("n")).scalar(), "true_alarms": true.agg(n.alias("n")).scalar(),
                             "station_alarms": station.agg(n.alias("n")).scalar(), "_r": matched(true, station), "_p": matched(station, true)})
    return base.select(F.lit(step).cast("long").alias("step"), "duds", "flickers", percent(F.col("hits"), F.col("duds")).alias("dud_recall_pct"),
                       percent(F.col("hits"), F.col("flickers")).alias("flicker_precision_pct"), "true_alarms", "station_alarms",
                       percent(F.col("_r"), F.col("true_alarms")).alias("alarm_recall_pct"),
                       percent(F.col("_p"), F.col("station_alarms")).alias("alarm_precision_pct"))


def traffic_tiers(trips: DataFrame) -> DataFrame:
    """Start stations by rentals per day: quiet below 20, busy from 60."""
    days = trips.agg(F.count_distinct(F.to_date("t0")).alias("d")).scalar()
    per = trips.groupBy(F.col("st0").alias("st")).agg((F.count(F.lit(1)) / days).alias("per_day"))
    return per.withColumn("tier", F.when(F.col("per_day") < 20, "quiet").when(F.col("per_day") < 60, "normal").otherwise("busy"))


def match_by_tier(trips: DataFrame, marked: DataFrame, tiers: DataFrame, tier: str, step: int, rule: Rule = Rule(),
                  heavy: Heavy | None = None) -> DataFrame:
    """The match restricted to rentals that touch a station of the tier."""
    ids = tiers.where(F.col("tier") == tier).select("st")

    def touching(df: DataFrame) -> DataFrame:
        a = ids.withColumn("_a", F.lit(True)).withColumnRenamed("st", "st0")
        b = ids.withColumn("_b", F.lit(True)).withColumnRenamed("st", "st1")
        return df.join(a, "st0", "left").join(b, "st1", "left").where("_a or _b").drop("_a", "_b")

    out = match(touching(trips), touching(marked), step, rule, heavy)
    return out.withColumns({"tier": F.lit(tier), "stations": ids.agg(F.count(F.lit(1)).alias("n")).scalar()})
