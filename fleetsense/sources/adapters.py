"""Domain tables as views over the given parquet tables (nothing is stored)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import shift_seconds, STATUSES
from ..operators import chains
from ..operators.timeline import Heavy, find_heavy

NOW = "2024-01-30 12:00:00"
# read as instants: no cast stands between a time filter and the scan
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
_PROFILES: dict[tuple, object] = {}


class Tables:
    """One data folder. Frames are lazy; the heavy-key profile is measured once per folder and session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self._events(self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events.parquet"))

    @staticmethod
    def _events(raw: DataFrame) -> DataFrame:
        return raw.select("event_id", "ts", "user_id", "event_type", "value",
                          F.regexp_extract("props", r'"k": *([0-9]+)', 1).try_cast("int").alias("k"))

    @cached_property
    def now(self):
        return F.lit(NOW).cast("timestamp")

    @cached_property
    def station_count(self) -> int:
        """One number, from the file footers."""
        at = (self.spark.sparkContext.applicationId, self.folder, "stations")
        if at not in _PROFILES:
            _PROFILES[at] = self.read("supplier").count()
        return _PROFILES[at]

    @cached_property
    def trips(self) -> DataFrame:
        user, event, n = F.col("user_id"), F.col("event_id"), F.lit(self.station_count)
        home = 1 + user % n
        moved = 1 + (user + event) % n
        return self.events.select(
            user.cast("string").alias("bike"),
            event.alias("ord"),
            F.col("ts").alias("t0"),
            home.cast("string").alias("st0"),
            F.expr("timestampadd(SECOND, cast(round(value * 6) as bigint), ts)").alias("t1"),
            F.when(event % 5 == 0, moved).otherwise(home).cast("string").alias("st1"),
            ((event * 37) % 400).cast("double").alias("dist_m"),
            F.when(F.col("k") % 10 != 0, (F.col("k") % 7).cast("string")).alias("who"))

    def heavy_of(self, label: str, df: DataFrame, key: str, time: str) -> Heavy | None:
        at = (self.spark.sparkContext.applicationId, self.folder, label)
        if at not in _PROFILES:
            _PROFILES[at] = find_heavy(df, key, time)
        return _PROFILES[at]

    @cached_property
    def heavy(self) -> Heavy | None:
        """Bikes too large for one task."""
        return self.heavy_of("bike", self.trips, "bike", "t0")

    @cached_property
    def heavy_station(self) -> Heavy | None:
        return self.heavy_of("station", self.trips, "st0", "t0")

    @cached_property
    def marked(self) -> DataFrame:
        return chains.mark(self.trips, identity="person", heavy=self.heavy)

    @cached_property
    def marked_rows(self):
        return chains.mark_timeline(self.trips, identity="person", heavy=self.heavy)

    @cached_property
    def faults(self) -> DataFrame:
        return self.events.where(F.col("event_type") == "error").select(
            F.col("user_id").cast("string").alias("bike"),
            shift_seconds("ts", 6 * 3600).alias("t"),
            F.concat(F.lit("k"), F.col("k") % 4).alias("kind")).dropDuplicates(["bike", "t"])

    @cached_property
    def stations(self) -> DataFrame:
        s, n, r = self.read("supplier"), self.read("nation"), self.read("region")
        return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"),
                        F.col("n_name").alias("gu"), F.col("r_name").alias("region"),
                        (37.45 + (F.col("s_suppkey") * 7 % 50) * 0.004).alias("lat"),
                        (126.85 + (F.col("s_suppkey") * 13 % 50) * 0.006).alias("lon")))

    @cached_property
    def hours(self) -> DataFrame:
        h = F.floor((F.unix_micros("t0") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3_600_000_000)
        kept = self.trips.withColumn("_h", h).where(
            (F.col("_h") % 53 != 7) & ((F.col("_h") % 37 != 5) | (F.col("ord") % 20 == 0)))
        return kept.groupBy(F.date_trunc("hour", "t0").alias("t")).agg(F.count(F.lit(1)).alias("rows"))

    @cached_property
    def ev_snapshots(self) -> DataFrame:
        e = self.events
        minutes = F.when((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0), F.lit(0)).otherwise(
            F.expr("cast(round(value * 60) as bigint)"))
        s = e.select(
            F.concat(F.upper(F.substring("event_type", 1, 2)), F.lit("-"), F.col("user_id")).alias("charger"),
            F.col("event_type").alias("op"), F.col("event_id").alias("ord"), F.col("ts").alias("start"),
            F.timestamp_micros(F.unix_micros("ts") + minutes * 1_000_000).alias("end"),
            F.when(F.col("event_id") % 11 == 0, "5").when(F.col("event_id") % 3 == 0, "3").otherwise("2").alias("stat"))
        first = F.timestamp_micros(F.ceil(F.unix_micros("end") / 300_000_000) * 300_000_000)
        return s.withColumn("at", F.explode(F.array(first, shift_seconds(first, 300))))

    @cached_property
    def surveys(self) -> DataFrame:
        return self.events.where(F.col("event_type") == "signup").select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("bike"),
            shift_seconds("ts", 3600).alias("at"),
            F.element_at(F.array(*[F.lit(s) for s in STATUSES]), F.col("k") % 6 + 1).alias("status"))
