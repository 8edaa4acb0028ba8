"""Column functions: text clean-up, geography, time and list arithmetic. No Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import LEVEL_HIGH, LEVEL_LOW, Rule, Shift

EARTH_M = 6371000.0
# Fixed values of the form checks.
BIKE_FORM = r"^SPB-[0-9]{5,6}$"
FINE = "멀쩡함"
VERDICTS = ("체인·기어", "타이어", "안장·핸들", "브레이크", "멀쩡함")
STATUSES = ("체인·기어", "타이어", "안장·핸들", "브레이크", "멀쩡함", "기타 고장")
RESCUE_STATUSES = STATUSES[:5]     # the last one is for surveys only
PHOTO_FORM = r"^[0-9a-f]{16}\.jpg$"
LAT_RANGE = (33.0, 39.0)
LON_RANGE = (124.0, 132.0)
NOTE_MAX = 200
STATION_MAX = 10


def micros(c) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def seconds_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def shift_seconds(c, seconds: float) -> Column:
    return F.timestamp_micros(micros(c) + int(seconds * 1_000_000))


def norm_station(c: Column) -> Column:
    """Trim; ids made of digits are padded to five, longer ones are left alone."""
    s = F.trim(c)
    return F.when(s.rlike("^[0-9]+$") & (F.length(s) < 5), F.lpad(s, 5, "0")).otherwise(s)


def safe_ts(c: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(c) if fmt is None else F.try_to_timestamp(c, F.lit(fmt))


def person_key(born: Column, sex: Column | None = None) -> Column:
    b = F.when(~born.isin("", "\\N"), born)
    s = F.lit("?") if sex is None else F.coalesce(F.upper(F.nullif(sex, F.lit(""))), F.lit("?"))
    return F.concat(b, s)


def coerce_distance(c: Column, factor: float = 1.0) -> Column:
    return F.coalesce(c.try_cast("double") * factor, F.lit(0.0))


def norm_bike(c: Column) -> Column:
    """'spb 69683' or 'SPB-1234' to 'SPB-69683' / 'SPB-01234'; anything else to null."""
    digits = F.regexp_extract(F.upper(c), r"SPB\s*-?\s*(\d{3,6})", 1)
    return F.when(digits != "", F.format_string("SPB-%05d", F.nullif(digits, F.lit("")).cast("int")))


def is_dud(rule: Rule = Rule()) -> Column:
    """Back at the same place, in time (inclusive), without moving far (exclusive)."""
    return F.coalesce((F.col("st0") == F.col("st1")) & (seconds_between("t0", "t1") <= rule.max_sec)
                      & (F.col("dist_m") < rule.max_m), F.lit(False))


def chain_after() -> Column:
    return F.when(F.col("dud"), F.col("streak") + 1).otherwise(F.lit(0)).cast("long")


def alert_level(chain: Column) -> Column:
    return F.when(chain >= 3, F.lit(LEVEL_HIGH)).otherwise(F.lit(LEVEL_LOW))


def replay_type(rule: Rule = Rule()) -> Column:
    late = ~F.col("retry") & (F.col("streak") >= rule.alarm_k)
    return F.when(late, "prevented").when(F.col("alarm"), "alarm").otherwise("dud")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def travel_minutes(metres: Column, shift: Shift = Shift()) -> Column:
    return metres * (shift.detour * 60 / (1000 * shift.kmh))


def share_after(hourly: Column, minute: Column) -> Column:
    """Share of a day's 24 hourly counts that still lies after ``minute``; nothing is left after 24 h."""
    hour = F.floor(minute / 60).cast("int")
    rest = F.aggregate(F.slice(hourly, F.least(hour, F.lit(23)) + 2, F.lit(24)), F.lit(0.0), lambda a, x: a + x)
    now = F.try_element_at(hourly, F.least(hour, F.lit(23)) + 1) * (1 - (minute - hour * 60) / 60)
    total = F.aggregate(hourly, F.lit(0.0), lambda a, x: a + x)
    return F.when(hour >= 24, F.lit(0.0)).when(total == 0, (1440 - minute) / 1440).otherwise((now + rest) / total)


def chain_bucket(chain: Column) -> Column:
    return F.least(F.greatest(chain, F.lit(2)), F.lit(4)).cast("long")


def busy_level(busy: Column, cut1: Column, cut2: Column) -> Column:
    return F.when(busy >= cut2, 2).when(busy >= cut1, 1).otherwise(0).cast("long")


def minutes_ago(t, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - micros(t)) / 60_000_000).cast("long")


def short_time(t) -> Column:
    return F.date_format(t, "MM-dd HH:mm")


def hour_key(t) -> Column:
    return F.date_format(t, "yyyy-MM-dd/HH")


def seoul_time(t) -> Column:
    return F.from_utc_timestamp(t, "Asia/Seoul")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of k/n in per cent; null without trials."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return (F.when(n > 0, 100 * (mid - half)), F.when(n > 0, 100 * (mid + half)))


def log_loss_term(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def report_problem(statuses: tuple[str, ...] = STATUSES) -> Column:
    """First broken rule of a human report, null when it is valid. Rescue reports take ``RESCUE_STATUSES``."""
    return (
        F.when(~F.coalesce(F.col("bike").rlike(BIKE_FORM), F.lit(False)), "bike")
        .when(~F.coalesce(F.col("verdict").isin(*statuses), F.lit(False)), "verdict")
        .when(F.length(F.coalesce("note", F.lit(""))) > NOTE_MAX, "note")
        .when(F.col("lat").isNotNull() & ~F.col("lat").between(*LAT_RANGE), "lat")
        .when(F.col("lon").isNotNull() & ~F.col("lon").between(*LON_RANGE), "lon")
        .when(F.col("photo").isNotNull() & ~F.col("photo").rlike(PHOTO_FORM), "photo")
        .when(F.length(F.coalesce("station", F.lit(""))) > STATION_MAX, "station")
    )


def status_signature(*cols: str) -> Column:
    return F.concat_ws("|", *cols)


def percent(hits: Column, n: Column) -> Column:
    return F.when(n > 0, 100.0 * hits / n)
