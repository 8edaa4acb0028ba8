"""Sinks: what is written, and idempotent ways to write it (key upsert, partition replace)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import saved
from ..rules import KEEP_DAYS

TRIP_VALUES = ["st0", "t1", "st1", "dist_m", "who"]


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Old and new rows by key, new ones winning; ``changed`` tells rows that are new or differ (null-safe).

    Rows of one key on one side are ordered by their values, in the order given; the largest stands."""
    cols = key + values
    both = old.select(*cols, F.lit(0).alias("_g")).unionByName(new.select(*cols, F.lit(1).alias("_g")))
    row = F.struct(*values)
    g = both.groupBy(*key).agg(F.max(F.when(F.col("_g") == 0, row)).alias("_o"), F.max(F.when(F.col("_g") == 1, row)).alias("_n"))
    changed = F.col("_n").isNotNull() & ~F.col("_o").eqNullSafe(F.col("_n"))
    return g.select(*key, F.coalesce("_n", "_o").alias("_v"), changed.alias("changed")).select(*key, "_v.*", "changed")


def upsert_trips(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["bike", "t0"], TRIP_VALUES)


def replace_partitions(df: DataFrame, path: str, *by: str, fmt: str = "parquet") -> None:
    """Only the partitions present in ``df`` are replaced; committed by the file committer."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def write_upsert(old_path: str, new: DataFrame, key: list[str], values: list[str], day: Column) -> None:
    """Upsert into a table partitioned by day: only days that hold a changed row are read and rewritten."""
    spark = new.sparkSession
    new = new.withColumn("day", day)
    touched = new.select("day").distinct()
    old = spark.read.parquet(old_path).join(touched, "day", "left_semi")
    # evaluated before the folders it was read from are replaced
    merged = saved(upsert(old, new, key, values).withColumn("day", day))
    days = merged.where("changed").select("day").distinct()
    replace_partitions(merged.join(days, "day", "left_semi").drop("changed"), old_path, "day")


def list_days(lists: DataFrame) -> DataFrame:
    return lists.select("day").distinct()


def write_daily_lists(lists: DataFrame, path: str, latest_only: bool = False) -> None:
    """One JSON folder per day and an index of days."""
    if latest_only:
        lists = lists.where(F.col("day") == lists.agg(F.max("day")).scalar())
    replace_partitions(lists, f"{path}/lists", "day", fmt="json")
    list_days(lists).coalesce(1).write.mode("overwrite").json(f"{path}/index")


def record_list(lists: DataFrame, path: str) -> None:
    replace_partitions(lists.select("day", "bike", "station", "chain", "level"), path, "day")


def score_json(scores: DataFrame) -> DataFrame:
    return scores.select("day", F.to_json(F.struct("listed", "rode", "first_dud")).alias("body"))


def snapshot(entries: DataFrame, now: Column) -> DataFrame:
    """The nested 'now' document: scalars and the ordered list. A live list is a few hundred bikes at most."""
    cols = [c for c in ("bike", "station", "station_name", "chain", "level", "last_dud", "minutes_ago", "p", "why") if c in entries.columns]
    rank = F.struct(F.coalesce(-F.col("p"), F.lit(1.0)).alias("a") if "p" in entries.columns else F.lit(0.0).alias("a"),
                    (-F.col("chain")).alias("b"), (-F.unix_micros("t1")).alias("c"), F.struct(*cols).alias("v"))
    return entries.agg(F.to_json(F.struct(
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["v"]).alias("bikes"))).alias("body"))


def crew_csv(entries: DataFrame) -> DataFrame:
    """Ten text columns for the crew, in station rank order."""
    reported = F.when(F.col("reported").isNull(), "unknown").when(F.col("reported"), "yes").otherwise("no")
    return entries.select(F.col("rank"), "station", "station_name", "gu", "lat", "lon", "bike", "chain", "last_dud",
                          reported.alias("reported"))


def write_crew_csv(entries: DataFrame, path: str) -> None:
    """Quoted, CRLF, with a byte-order mark in the header text; one file because people open it."""
    d = crew_csv(entries).orderBy("rank", "bike")
    d = d.withColumnRenamed("rank", "﻿rank").coalesce(1)
    d.write.mode("overwrite").option("header", True).option("quoteAll", True).option("lineSep", "\r\n").csv(path)


EVENT_CODES = {"dud": 0, "alarm": 1, "prevented": 2, "fault": 3}   # fixed values


def compact_events(events: DataFrame) -> DataFrame:
    codes = F.create_map(*[x for k, v in EVENT_CODES.items() for x in (F.lit(k), F.lit(v))])
    return events.select("s", codes[F.col("type")].cast("long").alias("c"), "bike", "station")


def map_layer(marked: DataFrame, stations: DataFrame) -> DataFrame:
    """Alarms per station with its place; stations without coordinates stay off the map."""
    a = marked.where("alarm").groupBy(F.col("st1").alias("id")).agg(F.count(F.lit(1)).alias("alarms"))
    return a.join(stations, "id").select("id", "name", "gu", "lat", "lon", "alarms")


def top_districts(layer: DataFrame, k: int = 10) -> DataFrame:
    return layer.groupBy("gu").agg(F.sum("alarms").alias("alarms")).orderBy(F.desc("alarms"), "gu").limit(k)


def incremental(old: DataFrame, new: DataFrame, at: str = "at", back_seconds: int = 3600) -> DataFrame:
    """Re-pull from an hour before the newest stored row: older rows stay, later ones come from the pull. An empty store
    takes all pulled rows with a time; stored rows without a time stay."""
    newest = old.agg(F.max(F.unix_micros(at)).alias("m")).scalar()
    cut = F.coalesce(newest, F.lit(-(1 << 62))) - back_seconds * 1_000_000
    return (old.where((F.unix_micros(at) < cut) | F.col(at).isNull()).withColumn("origin", F.lit("kept"))
            .unionByName(new.where(F.unix_micros(at) >= cut).withColumn("origin", F.lit("pulled"))))


def retention(trips: DataFrame, now: Column, column: str = "t1", days: int = KEEP_DAYS) -> DataFrame:
    return trips.where(F.col(column) >= now - F.expr(f"interval {days} days"))


def busy_json(busy: DataFrame) -> DataFrame:
    return busy.select("station", F.to_json(F.struct(F.round("avg", 1).alias("avg"), F.array(*[f"h{h}" for h in range(24)]).alias("h"))).alias("body"))


