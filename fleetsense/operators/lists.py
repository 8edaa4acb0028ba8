"""Lists people act on: suspicious now, suspicious this morning, ranked stations, guarantees, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..rules import FRESH_HOURS, LOOKBACK_DAYS, OTHER_DISTRICT, Rule
from . import chains
from .temporal import asof
from .timeline import Heavy, Timeline



def with_station(df: DataFrame, stations: DataFrame, key: str = "station") -> DataFrame:
    """Names from the station table, the id itself where unknown. Join strategy follows the table's size."""
    s = stations.select(F.col("id").alias("_sid"), F.col("name").alias("_name"))
    return df.join(s, F.col(key) == F.col("_sid"), "left").withColumn(
        "station_name", F.coalesce("_name", key)).drop("_sid", "_name")


def known_window(trips: DataFrame, now: Column, days: int = LOOKBACK_DAYS) -> DataFrame:
    return trips.where((F.col("t0") >= now - F.expr(f"interval {days} days")) & (F.col("t1") <= now))


def live_list(trips: DataFrame, now: Column, stations: DataFrame, rule: Rule = Rule(), identity: str = "person",
              heavy: Heavy | None = None) -> DataFrame:
    """Bikes whose chain is unbroken now: last rental within 24 h, given up, second person or later.

    The week is read and moved once: marks and the last rental of a bike come from the same exchange.
    """
    m = chains.mark(known_window(trips, now), rule, identity, heavy)
    last = chains.last_row(m, "bike").withColumn("chain", S.chain_after())
    last = last.where((F.col("chain") >= rule.alarm_k) & (F.col("t1") >= now - F.expr(f"interval {FRESH_HOURS} hours")))
    out = with_station(last.withColumn("station", F.col("st1")), stations)
    return out.select("bike", "station", "station_name", "chain", S.alert_level(F.col("chain")).alias("level"),
                      S.short_time("t1").alias("last_dud"), S.minutes_ago("t1", now).alias("minutes_ago"), "t0", "t1")


def morning_lists(rows: Timeline, faults: DataFrame | None, stations: DataFrame, rule: Rule = Rule(),
                  heavy: Heavy | None = None) -> DataFrame:
    """For every day: bikes whose last rental of the day before left an unbroken chain, with later truth.

    ``rows`` is a marked timeline. ``reported`` is null when no fault data exist.
    """
    rows = chains.with_next_any(rows).with_columns(_d=F.to_date("t0"), chain=S.chain_after())
    last = F.col("any_t0").isNull() | (F.to_date("any_t0") > F.col("_d"))
    d = rows.done().where(last & (F.col("chain") >= rule.alarm_k)).select(
        F.date_add("_d", 1).alias("day"), "bike", F.col("st1").alias("station"), "chain", "t1",
        F.col("any_dud").alias("truth_first_rider_dud"))
    if faults is None:
        d = d.withColumn("reported", F.lit(None).cast("boolean"))
    else:
        d = d.withColumn("_nd", F.col("day").cast("timestamp"))
        d = asof(d, faults, "bike", "_nd", "t", F.struct("t"), "_f", "backward", False, heavy)
        recent = F.unix_micros("_f.t") >= F.unix_micros("t1") - 7 * 86_400_000_000
        d = d.withColumn("reported", F.coalesce(recent, F.lit(False))).drop("_f", "_nd")
    d = with_station(d, stations)
    return d.select("day", "bike", "station", "station_name", "chain", S.alert_level(F.col("chain")).alias("level"),
                    S.short_time("t1").alias("last_dud"), "reported", "truth_first_rider_dud", "t1")


def morning_list_of(trips: DataFrame, day: Column, stations: DataFrame, days: int = LOOKBACK_DAYS, rule: Rule = Rule(),
                    identity: str = "person", heavy: Heavy | None = None) -> DataFrame:
    """The operational form: one day from only the days before it (filters reach the scan)."""
    end = day.cast("timestamp")
    rows = trips.where((F.col("t0") >= end - F.expr(f"interval {days} days")) & (F.col("t0") < end))
    yesterday = rows.where(F.col("t0") >= end - F.expr("interval 1 day")).select("bike").distinct()
    m = chains.mark(rows.join(yesterday, "bike", "left_semi"), rule, identity, heavy)
    last = chains.last_row(m, "bike").withColumn("chain", S.chain_after()).where(F.col("chain") >= rule.alarm_k)
    out = with_station(last.withColumn("station", F.col("st1")), stations)
    return out.select(day.alias("day"), "bike", "station", "station_name", "chain",
                      S.alert_level(F.col("chain")).alias("level"), S.short_time("t1").alias("last_dud"))


def first_rider_retro(lists: DataFrame) -> DataFrame:
    truth = F.col("truth_first_rider_dud")
    return lists.groupBy("day").agg(F.count(truth).alias("known"), F.count_if(truth).alias("hits"),
                                    (F.count("*") - F.count(truth)).alias("never_ridden"))


def rank_stations(entries: DataFrame, broken: DataFrame | None = None, *by: str) -> DataFrame:
    """Stations of a list in visiting order: confirmed broken, expected hits, chain sum, bikes, then id."""
    if broken is not None:
        entries = entries.join(broken.select("bike", F.col("broken").alias("_b")), "bike", "left")
    else:
        entries = entries.withColumn("_b", F.lit(0))
    p = F.col("p") if "p" in entries.columns else F.lit(None).cast("double")
    g = entries.groupBy(*by, "station").agg(
        F.count_if(F.coalesce(F.col("_b"), F.lit(0)) > 0).alias("confirmed"), F.sum(p).alias("expected"),
        F.sum("chain").alias("chain_sum"), F.count("*").alias("bikes"))
    w = Window.partitionBy(*by).orderBy(F.desc("confirmed"), F.desc_nulls_last("expected"), F.desc("chain_sum"), F.desc("bikes"), "station")
    return g.withColumn("rank", F.row_number().over(w))


def filter_district(entries: DataFrame, stations: DataFrame, gu: str | None = None) -> DataFrame:
    s = stations.select(F.col("id").alias("station"), "gu")
    out = entries.join(s, "station", "left").withColumn("gu", F.coalesce("gu", F.lit(OTHER_DISTRICT)))
    return out if gu is None else out.where(F.col("gu") == gu)


def top_per_list(samples: DataFrame, k: int, order: list[Column], at: str = "at") -> DataFrame:
    """Best k of each list; lists shorter than k are skipped. A list holds only bikes standing at that moment."""
    w = Window.partitionBy(at).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(at))
    return samples.withColumns({"_r": F.row_number().over(w), "_n": n}).where(
        (F.col("_r") <= k) & (F.col("_n") >= k)).withColumnRenamed("_r", "rank").drop("_n")


def freshest_source(feeds: DataFrame, now: Column, limits: dict[str, int]) -> DataFrame:
    """Newest feed (source, at, body) inside its own freshness limit in minutes."""
    limit = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col("source")]
    fresh = feeds.where((F.unix_micros(now) - F.unix_micros("at") <= limit.cast("long") * 60_000_000) & (F.col("at") <= now))
    return fresh.agg(F.max_by(F.struct(*feeds.columns), F.struct("at", "source")).alias("r")).where("r is not null").select("r.*")


def default_day(days: DataFrame, today: Column, demo: str, max_age: int = 3) -> DataFrame:
    latest = F.max("day")
    return days.agg(F.when(F.datediff(today, latest) < max_age, latest).otherwise(F.lit(demo).cast("date")).alias("day"))


def nearest_stations(entries: DataFrame, stations: DataFrame, lat: float, lon: float, k: int = 10) -> DataFrame:
    s = stations.join(entries.select(F.col("station").alias("id")).distinct(), "id", "left_semi")
    d = S.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return s.withColumn("metres", d).orderBy("metres", "id").limit(k).select("id", "metres")


def guarantee(entries: DataFrame, q: float, *by: str) -> DataFrame:
    """Expected hits and the cautious lower bound of a list; null if any probability is missing."""
    mu, sd = F.sum("p"), F.sqrt(F.sum(F.col("p") * (1 - F.col("p"))))
    full = F.count("*") == F.count("p")
    return entries.groupBy(*by).agg(F.count("*").alias("n"), F.when(full, mu).alias("expected"),
                                    F.when(full, F.greatest(F.lit(0), F.floor(mu + q * sd))).cast("long").alias("at_least"))


def replay_events(marked: DataFrame, faults: DataFrame, day: Column, rule: Rule = Rule()) -> DataFrame:
    """One day's duds typed dud / alarm / prevented, and reports of the next two days on alarmed bikes."""
    start = day.cast("timestamp")
    duds = marked.where((F.col("t0") >= start) & (F.col("t0") < start + F.expr("interval 1 day")) & F.col("dud"))
    ev = duds.select(
        F.floor((F.unix_micros("t1") - F.unix_micros(start)) / 1_000_000).alias("s"), S.replay_type(rule).alias("type"), "bike",
        F.col("st0").alias("station"), (F.col("streak") + F.when(F.col("retry"), 0).otherwise(1)).alias("chain"),
        F.lit(None).cast("string").alias("kind"))
    rep = faults.where((F.col("t") >= start) & (F.col("t") < start + F.expr("interval 2 days")))
    rep = rep.join(ev.where("type = 'alarm'").select("bike").distinct(), "bike", "left_semi").select(
        F.floor((F.unix_micros("t") - F.unix_micros(start)) / 1_000_000).alias("s"), F.lit("fault").alias("type"), "bike",
        F.lit(None).cast("string").alias("station"), F.lit(None).cast("long").alias("chain"), "kind")
    return ev.unionByName(rep)


def replay_counters(events: DataFrame) -> DataFrame:
    """Running counts per type by second, after adding up each second. One day has at most 172,800 seconds."""
    types = ("dud", "alarm", "prevented", "fault")
    per = events.groupBy("s").agg(*[F.count_if(F.col("type") == x).alias(x) for x in types])
    w = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("s", *[F.sum(x).over(w).alias(x) for x in types])


def overlap(left: DataFrame, right: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """Size of both sides, common entries, missing entries and Jaccard per cent."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(True))
    j = a.join(b, keys, "full_outer")
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return j.groupBy(*by).agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"), both.alias("common"),
                              F.count_if(F.col("_a").isNull()).alias("missed"), S.percent(both, F.count("*")).alias("jaccard_pct"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only on one side."""
    return (left.subtract(right).withColumn("side", F.lit("left"))
            .unionByName(right.subtract(left).withColumn("side", F.lit("right"))))
