"""Model features and labelled samples, known at the moment of return or of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chain_after, micros, seconds_between
from . import chains
from .temporal import range_count
from .timeline import Heavy

# The names and order that a model expects.
FEATURES17 = ["chain", "run_len", "run_retries", "run_span_min", "dur_sec", "dist_m", "idle_before_min",
              "idle_before_run_min", "hour", "weekend", "last_normal_ago_h", "last_normal_dur_min", "hist7_rentals",
              "hist7_duds", "prior_alarms7", "st_dud_rate", "st_log_volume"]
FEATURES7 = ["chain", "hist7_duds", "hist7_rentals", "prior_alarms7", "dur_sec", "age_h", "shun"]
STEP_US = 3 * 3_600_000_000
WARMUP_DAYS = 7


def base_features(marked: DataFrame, heavy: Heavy | None = None):
    """Timeline with the 15 features that need only the bike's own past, plus next-row columns."""
    rows = chains.history(marked, 7, heavy)
    rows = chains.last_normal(chains.run_features(rows))
    rows = chains.with_next_any(chains.with_next_rider(rows))
    chain = chain_after()
    return rows.with_columns(
        chain=chain, dur_sec=seconds_between("t0", "t1"), hour=F.hour("t1").cast("long"),
        weekend=F.when(F.weekday("t1") >= 5, 1).otherwise(0).cast("long"),
        hist7_rentals=F.col("hist_rentals"), hist7_duds=F.col("hist_duds"),
        # can be -1; never clamp
        prior_alarms7=F.col("hist_alarms") - F.when(chain >= 2, 1).otherwise(0))


def station_stats(marked: DataFrame) -> DataFrame:
    """Dud share and log volume per return station over the reference period."""
    days = marked.agg(F.count_distinct(F.to_date("t0")).alias("d")).scalar()
    return marked.groupBy(F.col("st1").alias("st")).agg(
        (F.count_if("dud") / F.count(F.lit(1))).alias("st_dud_rate"),
        F.log1p(F.count(F.lit(1)) / days).alias("st_log_volume"))


def features17(marked: DataFrame, stats: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    rows = base_features(marked, heavy).done()
    # one row per station; joined by size, never forced
    return rows.join(stats, rows.st1 == stats.st, "left").drop("st")


def warm(rows: DataFrame, first: Column | None) -> Column:
    """Whether a week of history lies before the day of t0. ``first`` is the earliest t0 of the data, that of the rows if
    not given."""
    first = rows.agg(F.min("t0")).scalar() if first is None else first
    return F.to_date("t0") >= F.date_add(F.to_date(first), WARMUP_DAYS)


def realtime_rows(features: DataFrame, first: Column | None = None) -> DataFrame:
    """Every dud return after the warm-up with the outcome of the next other person."""
    return features.where(F.col("dud") & F.col("next_dud").isNotNull() & warm(features, first)).withColumns(
        {"y": F.col("next_dud"), "day": F.to_date("t1")})


def morning_rows(features: DataFrame, first: Column | None = None) -> DataFrame:
    """Bikes whose last rental of a day was a dud, with the outcome of their next rental on a later day."""
    d = features.withColumn("_d", F.to_date("t0"))
    last = F.col("any_t0").isNotNull() & (F.to_date("any_t0") > F.col("_d"))
    d = d.where(last & F.col("dud") & warm(features, first)).withColumn("day", F.date_add("_d", 1))
    return d.withColumns({"y": F.col("any_dud"),
                          "hours_to_midnight": (micros(F.col("day").cast("timestamp")) - micros("t1")) / 3.6e9}).drop("_d")


def with_shun(rows: DataFrame, starts: DataFrame, name: str = "shun", heavy: Heavy | None = None) -> DataFrame:
    """log1p of rentals others started at the same station between return and list time (both open). Needs _id."""
    out = range_count(starts.select("st0", "t0"), rows, "st0", "t0", "st1", "t1", "at", "_others", heavy=heavy)
    return out.withColumn(name, F.log1p(F.greatest(F.col("_others"), F.lit(0)))).withColumnRenamed("_others", "others")


def list_samples(marked: DataFrame, heavy: Heavy | None = None, heavy_station: Heavy | None = None,
                 labelled: bool = True) -> DataFrame:
    """One row per list time (every 3 h) at which a bike with chain >= 2 stood on the list, with label y."""
    rows = base_features(marked, heavy).done()
    base = marked.agg(F.unix_micros(F.date_trunc("day", F.min("t1"))).alias("b")).scalar()
    keep = F.col("dud") & (F.col("chain") >= 2) & (micros("t1") >= base + WARMUP_DAYS * 86_400_000_000)
    if labelled:
        keep = keep & F.col("next_dud").isNotNull()
    end = F.least(F.coalesce(micros("any_t0"), micros("t1") + 86_400_000_000), micros("t1") + 86_400_000_000)
    c = rows.where(keep).select(
        "bike", "ord", "t0", "t1", "st1", F.col("next_dud").alias("y"), "chain", "hist7_duds", "hist7_rentals",
        "prior_alarms7", "dur_sec",
        F.ceil((micros("t1") - base) / STEP_US).alias("_f"),
        F.floor((end - base - 1_000_000) / STEP_US).alias("_z"))
    c = c.where(F.col("_z") >= F.col("_f")).withColumn("_g", F.explode(F.sequence("_f", "_z")))
    c = c.withColumn("at", F.timestamp_micros(base + F.col("_g") * STEP_US)).drop("_f", "_z", "_g")
    c = c.withColumns({"age_h": (micros("at") - micros("t1")) / 3.6e9, "_id": F.struct("bike", "ord", "at")})
    return with_shun(c, marked, heavy=heavy_station)


def live_features(marked: DataFrame, trips: DataFrame, now, heavy: Heavy | None = None,
                  heavy_station: Heavy | None = None) -> DataFrame:
    """The seven live features of bikes whose last known rental is a dud, at list time ``now``.

    ``marked`` is the window already cut to what was returned by ``now``.
    """
    rows = chains.history(marked, 7, heavy).with_columns(chain=chain_after()).done()
    last = chains.last_row(rows, "bike").where("dud")
    last = last.select(
        "bike", "t0", "t1", "st1", "chain", F.col("hist_duds").alias("hist7_duds"),
        F.col("hist_rentals").alias("hist7_rentals"),
        (F.col("hist_alarms") - F.when(F.col("chain") >= 2, 1).otherwise(0)).alias("prior_alarms7"),
        seconds_between("t0", "t1").alias("dur_sec"))
    last = last.withColumn("at", now).withColumns(
        {"age_h": F.greatest(F.lit(0.0), (micros("at") - micros("t1")) / 3.6e9), "_id": F.col("bike")})
    returned = trips.where((F.col("t1") >= now - F.expr("interval 25 hours")) & (F.col("t0") < now) & (F.col("t1") <= now))
    return with_shun(last, returned, heavy=heavy_station)
