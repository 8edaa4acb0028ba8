"""Scans. Schemas are explicit or resolved by name at plan time; bad values become null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import ALIASES, REQUIRED, TRIPS

UNIFIED = ["bike", "ord", "t0", "st0", "t1", "st1", "dist_m", "who"]


def finish_trips(df: DataFrame) -> DataFrame:
    """Coerce times and distance, drop rentals without both times, ids to text."""
    def time(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        return S.safe_ts(F.col(c)) if kind == "string" else F.col(c).cast("timestamp")

    # without an ingest ordinal, ties of (bike, t0) are ordered by content, the same on every recomputation
    order = F.col("ord") if "ord" in df.columns else F.xxhash64("st0", "t1", "st1", "dist_m", "who")
    out = df.select(F.col("bike").cast("string").alias("bike"), order.alias("ord"), time("t0").alias("t0"), "st0",
                    time("t1").alias("t1"), "st1", S.coerce_distance(F.col("dist_m")).alias("dist_m"), "who")
    return out.dropna(subset=["bike", "t0", "t1"])      # rentals without an asset form no chain


def resolve_names(columns: list[str]) -> dict[str, str]:
    """Unified name -> column in hand: first known alias, else the first that matches without case."""
    found = {}
    for unified, names in ALIASES.items():
        exact = [n for n in names if n in columns]
        folded = {n.lower() for n in names}
        loose = [c for c in columns if c.lower() in folded]
        if exact or loose:
            found[unified] = (exact or loose)[0]
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise KeyError(f"columns not found: {missing}; received: {columns}")
    return found


def resolve_columns(df: DataFrame, order: str | None = None) -> DataFrame:
    """Any known column naming to the unified rental table."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], TRIPS)
    names = resolve_names(df.columns)
    c = {u: F.col(f"`{n}`") for u, n in names.items()}
    text = {u: x.cast("string") for u, x in c.items()}
    who = S.person_key(text["born"], text.get("sex")) if "born" in c else F.lit(None).cast("string")
    cols = [c["bike"].alias("bike"), c["t0"].alias("t0"), S.norm_station(text["st0"]).alias("st0"), c["t1"].alias("t1"),
            S.norm_station(text["st1"]).alias("st1"), c.get("dist_m", F.lit(0.0)).alias("dist_m"), who.alias("who")]
    if order:
        cols.append(F.col(order).alias("ord"))
    return finish_trips(df.select(*cols))


def _csv(spark: SparkSession, path, encoding: str) -> DataFrame:
    reader = spark.read.option("header", True)
    if encoding != "utf-8":
        # stock Spark accepts only a few charsets unless the legacy switch is on
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = reader.option("encoding", encoding)
    return reader.csv(path)


def trips_city_a(df: DataFrame) -> DataFrame:
    """Rental file with birth year and sex: the person key keeps the sex as written, '?' if missing."""
    who = F.when(F.col("생년").isNotNull(), F.concat(F.col("생년"), F.coalesce(F.col("성별"), F.lit("?"))))
    order = [F.col("ord")] if "ord" in df.columns else []
    return finish_trips(df.select(
        F.col("자전거번호").alias("bike"), F.col("대여일시").alias("t0"), F.col("대여 대여소번호").alias("st0"),
        F.col("반납일시").alias("t1"), F.col("반납대여소번호").alias("st1"), F.col("`이용거리(M)`").alias("dist_m"),
        who.alias("who"), *order))


def trips_city_b(df: DataFrame) -> DataFrame:
    """Rental file in kilometres without any person key."""
    km = F.col("`이용거리(km)`").try_cast("double") * 1000
    order = [F.col("ord")] if "ord" in df.columns else []
    return finish_trips(df.select(
        F.col("자전거번호").alias("bike"), F.col("대여일시").alias("t0"), F.col("대여_대여소ID").alias("st0"),
        F.col("반납일시").alias("t1"), F.col("반납_대여소ID").alias("st1"), km.alias("dist_m"),
        F.lit(None).cast("string").alias("who"), *order))


def scan_trips_city_a(spark: SparkSession, path) -> DataFrame:
    return trips_city_a(_csv(spark, path, "cp949"))


def scan_trips_city_b(spark: SparkSession, path) -> DataFrame:
    return trips_city_b(_csv(spark, path, "utf-8"))


def faults_of(df: DataFrame) -> DataFrame:
    """Three columns (bike, time, kind): kind trimmed, one report per bike and time."""
    b, t, k = df.columns[:3]
    time = S.safe_ts(F.col(t)) if dict(df.dtypes)[t] == "string" else F.col(t)
    return df.select(F.col(b).alias("bike"), time.alias("t"), F.trim(F.col(k)).alias("kind")).dropDuplicates(["bike", "t"])


def scan_faults(spark: SparkSession, path, encoding: str = "cp949") -> DataFrame:
    return faults_of(_csv(spark, path, encoding))


def stations_of(df: DataFrame) -> DataFrame:
    """Columns no, name, gu, lat, lon as text: rows without number or place dropped, id padded to five."""
    d = df.select(F.col("no").try_cast("int").alias("no"), "name", "gu", F.col("lat").try_cast("double").alias("lat"),
                  F.col("lon").try_cast("double").alias("lon")).dropna(subset=["no", "lat", "lon"])
    return d.select(S.norm_station(F.col("no").cast("string")).alias("id"), "name", "gu", "lat", "lon")


def scan_stations(spark: SparkSession, path) -> DataFrame:
    """Station sheet exported to CSV (the spreadsheet format needs a one-off conversion)."""
    raw = spark.read.csv(path, schema="no string, name string, gu string, address string, lat string, lon string")
    return stations_of(raw)


PAGE_ROW = ("struct<BIKE_ID:string,RENT_DT:string,RENT_ID:string,RTN_DT:string,RTN_ID:string,USE_DST:string,"
            "BIRTH_YEAR:string,SEX_CD:string>")
PAGE = f"struct<rentData:struct<list_total_count:bigint,row:array<{PAGE_ROW}>>>"


def json_pages(pages: DataFrame, body: str = "body", order: str = "page") -> DataFrame:
    """Landed API pages to rentals: the last row of a (bike, t0) wins, rows without both times are dropped."""
    rows = pages.select(F.col(order).alias("_page"), F.posexplode(F.from_json(body, PAGE)["rentData"]["row"]).alias("_o", "r"))
    d = resolve_columns(rows.select("r.*", (F.col("_page") * 1_000_000 + F.col("_o")).alias("_ord")), "_ord")
    return latest_by(d, ["bike", "t0"], F.col("ord"))


def latest_by(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key, the last by ``order``; combined map-side."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def unwrap(text: DataFrame, item: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Items of a service answer in any of its envelopes, and the answers that carry an error or no items.

    Accepted: {response:{header,body:{items:{item:…}}}}, {response:{body:{items:…}}}, {items:{item:…}}, {items:…},
    {data:[…]}; an item list may also be a single object.
    """
    places = [F.get_json_object(body, p) for p in (
        "$.response.body.items.item", "$.response.body.items", "$.items.item", "$.items", "$.data")]
    found = F.coalesce(*places)
    many = F.when(F.startswith(F.ltrim(found), F.lit("[")), F.from_json(found, f"array<{item}>")).otherwise(
        F.array(F.from_json(found, item)))
    code = F.coalesce(F.get_json_object(body, "$.response.header.resultCode"), F.get_json_object(body, "$.resultCode"))
    bad = found.isNull() | ~F.coalesce(code, F.lit("00")).isin("00", "0", "INFO-000")
    good = text.where(~bad).select(F.explode(many).alias("r")).select("r.*")
    return good, text.where(bad).select(F.col(body), F.coalesce(code, F.lit("no items")).alias("reason"))


STATUS_ITEM = ("struct<stationId:string,stationName:string,rackTotCnt:string,parkingBikeTotCnt:string,"
               "stationLatitude:string,stationLongitude:string>")


def station_status(df: DataFrame) -> DataFrame:
    """Current stock per station with typed counts and coordinates."""
    return df.select(F.col("stationId").alias("id"), F.trim("stationName").alias("name"),
                     F.col("rackTotCnt").try_cast("int").alias("racks"), F.col("parkingBikeTotCnt").try_cast("int").alias("bikes"),
                     F.col("stationLatitude").try_cast("double").alias("lat"), F.col("stationLongitude").try_cast("double").alias("lon"))


EV_TIME = "yyyyMMddHHmmss"


def ev_of(df: DataFrame) -> DataFrame:
    """Charger snapshots: compact times parsed, charger key, operator from the first two letters of the site."""
    carried = [F.col("ord")] if "ord" in df.columns else []
    return df.select(*carried, S.safe_ts(F.col("at")).alias("at"), F.concat_ws("-", "statId", "chgerId").alias("charger"),
                     F.substring("statId", 1, 2).alias("op"), "stat", S.safe_ts(F.col("lastTsdt"), EV_TIME).alias("start"),
                     S.safe_ts(F.col("lastTedt"), EV_TIME).alias("end"), S.safe_ts(F.col("nowTsdt"), EV_TIME).alias("now_start"))


def clip_and_dedup(trips: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """One rental per (bike, t0, st0), inside [lo, hi + 1 day)."""
    rows = trips.where((F.col("t0") >= lo) & (F.col("t0") < hi + F.expr("interval 1 day")))
    return latest_by(rows, ["bike", "t0", "st0"], -F.col("ord"))


def scan_window(trips: DataFrame, now: Column, days: int) -> DataFrame:
    return trips.where(F.col("t0") >= now - F.expr(f"interval {days} days"))


def survey_of(df: DataFrame) -> DataFrame:
    """Human checks with Seoul wall-clock time."""
    return df.withColumn("at_local", F.date_format(S.seoul_time("at"), "yyyy-MM-dd HH:mm:ss"))


def labelled_samples(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("next_dud").isNotNull())


def cached_marked(spark: SparkSession, path: str, build) -> DataFrame:
    """Marked month computed once and stored; rentals without a bike id never enter a window."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    build().where("bike is not null").write.parquet(path)
    return spark.read.parquet(path)
