"""Feed health from the hourly ledger: one row per hour, so a year is under ten thousand rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import RECHECK_HOURS, SETTLE_HOURS, THIN_SHARE
from .timeline import saved

HOUR = "interval 1 hour"


def hourly_counts(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.date_trunc("hour", "t0").alias("t")).agg(F.count(F.lit(1)).alias("rows"))


def hour_health(hours: DataFrame, now: Column, thin: float = THIN_SHARE) -> DataFrame:
    """Rows of each finished hour against the same hour of the past seven days (at least three, none empty).

    The ledger is joined to itself on the hour of day after spreading each row over the next seven days.
    """
    done = hours.where(F.col("t") < F.date_trunc("hour", now))
    past = done.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)),
                                             lambda d: F.timestamp_micros(F.unix_micros("t") + d.cast("long") * 86_400_000_000))).alias("t"),
                       F.col("rows").alias("p"))
    base = past.groupBy("t").agg(F.count("p").alias("n"), F.min("p").alias("lo"), F.median("p").alias("mid"))
    d = done.join(base, "t").where((F.col("n") >= 3) & (F.col("lo") > 0))
    return d.select("t", "rows", (F.col("rows") / F.col("mid")).alias("ratio"), (F.col("rows") < thin * F.col("lo")).alias("thin"))


def feed_status(health: DataFrame, now: Column) -> DataFrame:
    """The unbroken run of thin hours that ends at the last full hour: its start and latest ratio."""
    last = F.date_trunc("hour", now) - F.expr(HOUR)
    index = F.unix_micros("t").cast("long") / 3_600_000_000
    thin = health.where("thin").withColumn("_g", F.floor(index) - F.row_number().over(Window.orderBy("t")))
    runs = thin.groupBy("_g").agg(F.min("t").alias("since"), F.max("t").alias("until"), F.max_by("ratio", "t").alias("ratio"))
    hit = runs.where(F.col("until") == last)
    return hit.agg((F.count(F.lit(1)) == 0).alias("ok"), F.max("since").alias("since"), F.max("ratio").alias("ratio"))


def held_scores(scored: DataFrame, health: DataFrame) -> DataFrame:
    """Flag alarms whose wait for the next rider touches a thin hour; those are not scored.

    Counting thin hours up to each hour of the ledger turns the range test into two equi-joins on the hour.
    """
    health = saved(health)
    first, last = health.agg(F.min("t")).scalar(), health.agg(F.max("t")).scalar()
    spine = health.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(HOUR))).alias("t"))
    upto = F.count_if(F.coalesce("thin", F.lit(False))).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    count = spine.join(health.select("t", "thin"), "t", "left").select("t", upto.alias("n"))

    def at_or_before(c: Column) -> Column:
        return F.greatest(F.least(F.date_trunc("hour", c), last), first - F.expr(HOUR))

    low = count.select((F.col("t") + F.expr(HOUR)).alias("_lo"), F.col("n").alias("_n0"))
    high = count.select(F.col("t").alias("_hi"), F.col("n").alias("_n1"))
    d = scored.withColumns({"_lo": F.greatest(F.least(F.date_trunc("hour", "at"), last + F.expr(HOUR)), first), "_hi": at_or_before(F.col("next_t0"))})
    d = d.join(low, "_lo", "left").join(high, "_hi", "left")
    thin = F.coalesce("_n1", F.lit(0)) > F.coalesce("_n0", F.lit(0))
    return d.withColumn("held", F.col("next_t0").isNotNull() & thin).drop("_lo", "_hi", "_n0", "_n1")


def missing_hours(ledger: DataFrame, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Hours of the span that are not in the ledger, newest first."""
    spark = ledger.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", end), F.expr(HOUR))).alias("t"))
    gaps = spine.join(ledger.select("t"), "t", "left_anti").orderBy(F.desc("t"))
    return gaps if limit is None else gaps.limit(limit)


def unsettled_hours(ledger: DataFrame, start: Column, end: Column, settle_hours: int = 3) -> DataFrame:
    """Hours to read again: never read, or last read before they were ``settle_hours`` over."""
    spark = ledger.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.date_trunc("hour", start), end - F.expr("interval 1 second"), F.expr(HOUR))).alias("t"))
    early = F.unix_micros("fetched_at") < F.unix_micros("t") + (1 + settle_hours) * 3_600_000_000
    return spine.join(ledger.select("t", "fetched_at"), "t", "left").where(F.col("fetched_at").isNull() | early).select("t")


def recheck_hours(health: DataFrame, now: Column) -> DataFrame:
    """Thin hours of the last two days that the regular re-reads no longer cover."""
    return health.where(F.col("thin") & (F.col("t") >= now - F.expr(f"interval {RECHECK_HOURS} hours"))
                        & (F.col("t") < now - F.expr(f"interval {SETTLE_HOURS} hours"))).select("t")


def rows_in_window(hours: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return hours.where((F.col("t") >= now - F.expr(f"interval {days} days")) & (F.col("t") <= now)).agg(
        F.sum("rows").alias("rows_in_window"))
