"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics as A
from .oracle import NOW, STATUS_LIST, sql
from .registry import query

DIRTY_STATION = "case event_id % 4 when 0 then ' ' || {u} || ' ' when 1 then {u} when 2 then 'ST-' || {u} else '12345' || {u} end"


@query("norm_station", sql("ev0", f"""select event_id, case when regexp_full_match(s, '[0-9]+') and length(s) < 5 then lpad(s, 5, '0') else s end station
    from (select event_id, trim({DIRTY_STATION.format(u='cast(user_id as varchar)')}) s from ev0)"""))
def _(t):
    return t.events.select("event_id", S.norm_station(F.expr(DIRTY_STATION.format(u="cast(user_id as string)"))).alias("station"))


@query("safe_ts", sql("ev0", """select event_id, try_cast(case when event_id % 9 = 0 then 'n/a' when event_id % 10 = 0 then '' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as timestamp) t from ev0"""))
def _(t):
    text = F.when(F.col("event_id") % 9 == 0, "n/a").when(F.col("event_id") % 10 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", S.safe_ts(text).alias("t"))


@query("person_key", sql("ev0", r"""select event_id, case when born not in ('', '\N') then born || coalesce(upper(nullif(sex, '')), '?') end who from
    (select event_id, case when k % 10 = 0 then '' when k % 10 = 1 then '\N' else cast(1950 + k % 60 as varchar) end born,
      case k % 4 when 0 then 'm' when 1 then 'F' when 2 then '' end sex from ev0)"""))
def _(t):
    k = F.col("k")
    born = F.when(k % 10 == 0, "").when(k % 10 == 1, "\\N").otherwise((1950 + k % 60).cast("string"))
    sex = F.when(k % 4 == 0, "m").when(k % 4 == 1, "F").when(k % 4 == 2, "")
    return t.events.select("event_id", S.person_key(born, sex).alias("who"))


@query("coerce_distance", sql("ev0", """select event_id, coalesce(try_cast(v as double), 0) dist_m, coalesce(try_cast(v as double) * 1000, 0) dist_km_m
    from (select event_id, case when k % 8 = 0 then 'unknown' when k % 8 = 1 then null else cast(value as varchar) end v from ev0)"""))
def _(t):
    v = F.when(F.col("k") % 8 == 0, "unknown").when(F.col("k") % 8 != 1, F.col("value").cast("string"))
    return t.events.select("event_id", S.coerce_distance(v).alias("dist_m"), S.coerce_distance(v, 1000).alias("dist_km_m"))


DIRTY_BIKE = ("case event_id % 5 when 0 then concat(' spb ', {u}) when 1 then concat('SPB-', {u}) when 2 then concat('scan: spb', {u}, ' ok')"
              " when 3 then concat('SPB - 00', {u}) else {u} end")


@query("norm_bike", sql("ev0", f"""select event_id, case when d <> '' then 'SPB-' || case when length(n) < 5 then lpad(n, 5, '0') else n end end bike from
    (select *, cast(cast(nullif(d, '') as int) as varchar) n from (select event_id,
      regexp_extract(upper({DIRTY_BIKE.format(u='cast(user_id * 37 as varchar)')}), 'SPB\\s*-?\\s*(\\d{{3,6}})', 1) d from ev0))"""))
def _(t):
    return t.events.select("event_id", S.norm_bike(F.expr(DIRTY_BIKE.format(u="cast(user_id * 37 as string)"))).alias("bike"))


@query("chain_after", sql("marked", "select bike, ord, chain from marked"))
def _(t):
    return t.marked.select("bike", "ord", S.chain_after().alias("chain"))


@query("alert_level", sql("marked", "select bike, ord, case when chain >= 3 then '빨강' else '노랑' end as level from marked where chain >= 2"))
def _(t):
    return t.marked.withColumn("chain", S.chain_after()).where("chain >= 2").select(
        "bike", "ord", S.alert_level(F.col("chain")).alias("level"))


@query("replay_type", sql("marked", """select bike, ord, case when not retry and streak >= 2 then 'prevented' when alarm then 'alarm' else 'dud' end as type,
    streak + case when retry then 0 else 1 end as chain from marked where dud"""))
def _(t):
    return t.marked.where("dud").select("bike", "ord", S.replay_type().alias("type"),
                                        (F.col("streak") + F.when(F.col("retry"), 0).otherwise(1)).alias("chain"))


HAV = """2 * 6371000.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)
    + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"""


@query("haversine", sql("trips stations", f"""select t.bike, t.ord, round({HAV.format(a='a', b='b')}, 3) metres from trips t join stations a on a.id = t.st0 join stations b on b.id = t.st1"""))
def _(t):
    a = t.stations.select(F.col("id").alias("st0"), F.col("lat").alias("la"), F.col("lon").alias("loa"))
    b = t.stations.select(F.col("id").alias("st1"), F.col("lat").alias("lb"), F.col("lon").alias("lob"))
    m = S.haversine(F.col("la"), F.col("loa"), F.col("lb"), F.col("lob"))
    return t.trips.join(a, "st0").join(b, "st1").select("bike", "ord", F.round(m, 3).alias("metres"))


@query("travel_minutes", sql("trips", "select bike, ord, round(dist_m * 1.3 / 1000 / 18 * 60, 6) as travel_min from trips"))
def _(t):
    return t.trips.select("bike", "ord", F.round(S.travel_minutes(F.col("dist_m")), 6).alias("travel_min"))


@query("share_after", sql("profile", """select station, "day", at_min, round((h[cast(at_min / 60 as int) + 1] * (1 - (at_min % 60) / 60.0)
      + list_sum(h[cast(at_min / 60 as int) + 2:])) / list_sum(h), 9) share from
    (select station, "day", [""" + ", ".join(f"h{h}" for h in range(24)) + """] h, v.m at_min from profile, (values (0), (540), (660), (1380)) v(m))""")
       .replace("cast(at_min / 60 as int)", "(at_min // 60)").replace("v.m at_min", "cast(v.m as bigint) at_min").replace("list_sum(h[(at_min // 60) + 2:])", "coalesce(list_sum(h[(at_min // 60) + 2:]), 0)"))
def _(t):
    p = A.station_profile(t.trips).withColumn("at_min", F.explode(F.array(*[F.lit(m) for m in (0, 540, 660, 1380)])))
    share = S.share_after(F.array(*[F.col(c) for c in A.HOURS]), F.col("at_min"))
    return p.select("station", "day", F.col("at_min").cast("long").alias("at_min"), F.round(share, 9).alias("share"))


@query("buckets", sql("marked profile", """, c as (select quantile_cont(avg, [0.3333333333333333, 0.6666666666666666]) q from profile)
    select p.station, p.day, case when avg >= q[2] then 2 when avg >= q[1] then 1 else 0 end lvl from profile p, c""").replace("end lvl", "end::bigint lvl"))
def _(t):
    from ..functions.stats import quantiles
    from ..operators.timeline import saved
    p = saved(A.station_profile(t.trips).select("station", "day", "avg"))
    q = quantiles(p, F.col("avg"), [1 / 3, 2 / 3], ["c1", "c2"])
    return p.select("station", "day", S.busy_level(F.col("avg"), q.select("c1").scalar(), q.select("c2").scalar()).alias("lvl"))


@query("chain_bucket", sql("marked", "select bike, ord, least(greatest(chain, 2), 4) bucket from marked where dud"))
def _(t):
    return t.marked.where("dud").select("bike", "ord", S.chain_bucket(S.chain_after()).alias("bucket"))


@query("age_format", sql("trips", f"""select bike, ord, cast(floor((epoch_us({NOW}) - epoch_us(t1)) / 60000000.0) as bigint) minutes_ago,
    strftime(t1, '%m-%d %H:%M') last_seen, strftime(t0, '%Y-%m-%d/%H') hour_key from trips"""))
def _(t):
    return t.trips.select("bike", "ord", S.minutes_ago("t1", t.now).alias("minutes_ago"), S.short_time("t1").alias("last_seen"),
                          S.hour_key("t0").alias("hour_key"))


@query("local_time", sql("ev0", f"""select event_id, ts + interval 9 hours seoul, cast(ts + interval 9 hours as date) seoul_day,
    cast(ts + interval 9 hours as date) < cast({NOW} + interval 9 hours as date) is_past from ev0"""))
def _(t):
    s = S.seoul_time("ts")
    return t.events.select("event_id", s.alias("seoul"), F.to_date(s).alias("seoul_day"),
                           (F.to_date(s) < F.to_date(S.seoul_time(t.now))).alias("is_past"))


@query("wilson_ci", sql("marked", """select st1 station, k, n, round(100 * ((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) lo,
    round(100 * ((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) hi
    from (select st1, count(*) filter (where dud) k, cast(count(*) as double) nd, count(*) n, cast(count(*) filter (where dud) as double) / count(*) p from marked group by 1)"""))
def _(t):
    d = t.marked.groupBy(F.col("st1").alias("station")).agg(F.count_if("dud").alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return d.select("station", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("log_loss", sql("marked", """select count(*) n, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 9) log_loss from
    (select case when dud then 1.0::double else 0 end y, least(greatest(cast(ord % 101 as double) / 100, 1e-6::double), 1 - 1e-6::double) q from marked)"""))
def _(t):
    y, p = F.col("dud").cast("double"), (F.col("ord") % 101) / 100
    return t.marked.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.log_loss_term(y, p)), 9).alias("log_loss"))


REPORTS = f"""(select event_id id, 'SPB-' || case when user_id % 13 = 0 then cast(user_id as varchar) else lpad(cast(user_id as varchar), 5, '0') end bike,
    case when k % 11 = 0 then 'odd' else {STATUS_LIST}[k % 6 + 1] end verdict, repeat('x', cast(k * 3 as int)) note,
    case when k % 7 = 0 then null else 30 + k % 10 end lat, 126.5 + k % 9 lon, case when k % 5 = 0 then null when k % 5 = 1 then 'x.jpg' else lpad(cast(event_id as varchar), 16, '0') || '.jpg' end photo,
    cast(user_id * 100000 as varchar) station from ev0)"""


@query("validate_reports", sql("ev0", f"""select id, case when not regexp_full_match(bike, 'SPB-[0-9]{{5,6}}') then 'bike' when verdict = 'odd' then 'verdict' when length(note) > 200 then 'note'
    when lat < 33 or lat > 39 then 'lat' when lon < 124 or lon > 132 then 'lon' when photo is not null and not regexp_full_match(photo, '[0-9a-f]{{16}}\\.jpg') then 'photo'
    when length(station) > 10 then 'station' end problem from {REPORTS}"""))
def _(t):
    user, k = F.col("user_id"), F.col("k")
    d = t.events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("SPB-"), F.when(user % 13 == 0, user.cast("string")).otherwise(F.lpad(user.cast("string"), 5, "0"))).alias("bike"),
        F.when(k % 11 == 0, "odd").otherwise(F.element_at(F.array(*[F.lit(s) for s in S.STATUSES]), k % 6 + 1)).alias("verdict"),
        F.repeat(F.lit("x"), k * 3).alias("note"), F.when(k % 7 != 0, 30 + k % 10).cast("double").alias("lat"), (126.5 + k % 9).alias("lon"),
        F.when(k % 5 == 1, "x.jpg").when(k % 5 != 0, F.concat(F.lpad(F.col("event_id").cast("string"), 16, "0"), F.lit(".jpg"))).alias("photo"),
        (user * 100000).cast("string").alias("station"))
    return d.select("id", S.report_problem().alias("problem"))


@query("json_fields", """select event_id, try_cast(json_extract_string(props, '$.k') as double) k, json_extract_string(props, '$.none') none,
    regexp_full_match(json_extract_string(props, '$.k'), '[0-9]+(\\.[0-9]+)?') is_number from events""")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t.read("events").select("event_id", k.try_cast("double").alias("k"), F.get_json_object("props", "$.none").alias("none"),
                                   k.rlike(r"^[0-9]+(\.[0-9]+)?$").alias("is_number"))


@query("status_signature", sql("ev_snapshots", """select charger, ord, "at", concat_ws('|', stat, strftime(start, '%Y%m%d%H%M%S'), strftime("end", '%Y%m%d%H%M%S'),
    case when ord % 3 = 0 then strftime(start, '%Y%m%d%H%M%S') end) sig from ev_snapshots"""))
def _(t):
    def f(c):
        return F.date_format(c, "yyyyMMddHHmmss")
    d = t.ev_snapshots.select("charger", "ord", "at", "stat", f("start").alias("ts"), f("end").alias("te"),
                              F.when(F.col("ord") % 3 == 0, f("start")).alias("now_ts"))
    return d.select("charger", "ord", "at", S.status_signature("stat", "ts", "te", "now_ts").alias("sig"))


@query("date_parts", sql("trips", """select bike, ord, hour(t1) as hour, isodow(t1) >= 6 weekend, day(t0) >= 8 warm, date_trunc('day', t0)::timestamp midnight from trips"""))
def _(t):
    return t.trips.select("bike", "ord", F.hour("t1").alias("hour"), (F.weekday("t1") >= 5).alias("weekend"),
                          (F.dayofmonth("t0") >= 8).alias("warm"), F.date_trunc("day", "t0").alias("midnight"))


@query("text_contains", sql("stations", "select id, contains(name, '7') pier from stations"))
def _(t):
    return t.stations.select("id", F.contains("name", F.lit("7")).alias("pier"))
