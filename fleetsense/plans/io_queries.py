"""Sources and sinks: the rows that are read from raw shapes and the rows that would be written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.stats import quantiles
from ..operators import lists as L, metrics as A, report
from ..operators.temporal import asof, lead_times, within_hours
from ..operators.timeline import saved
from ..sources import readers as I, sinks as O
from .list_queries import LIVE, live, morning
from .metric_queries import DAYSCORE, H24, LEAD
from .oracle import NOW, sql
from .registry import query

TEXT = "yyyy-MM-dd HH:mm:ss"


def raw_text(t):
    """Trips back in the text shape files and services deliver, with the usual faults in it."""
    e = t.events.select(F.col("event_id").alias("ord"), "k")
    d = t.trips.join(e, "ord")
    return d.select(
        "ord", "bike", F.when(F.col("ord") % 41 == 0, "").otherwise(F.date_format("t0", TEXT)).alias("a0"), "st0",
        F.when(F.col("ord") % 43 == 0, "-").otherwise(F.date_format("t1", TEXT)).alias("a1"), "st1",
        F.when(F.col("ord") % 29 == 0, "x").otherwise(F.col("dist_m").cast("string")).alias("d"),
        F.when(F.col("k") % 10 != 0, (1950 + F.col("k") % 60).cast("string")).alias("born"),
        F.when(F.col("k") % 4 == 0, "m").when(F.col("k") % 4 == 1, "F").alias("sex"))


RAW = """, rw as (select t.*, e.k, date_trunc('second', t0) a0, date_trunc('second', t1) a1, case when ord % 29 = 0 then 0 else dist_m end d,
      case when k % 10 <> 0 then cast(1950 + k % 60 as varchar) end born, case k % 4 when 0 then 'm' when 1 then 'F' end sex
    from trips t join ev0 e on e.event_id = t.ord where ord % 41 <> 0 and ord % 43 <> 0)
"""


@query("scan_trips_city_a", sql("trips", RAW + "select bike, ord, a0 t0, st0, a1 t1, st1, d dist_m, born || coalesce(sex, '?') who from rw"))
def _(t):
    r = raw_text(t)
    return I.trips_city_a(r.select("ord", F.col("bike").alias("자전거번호"), F.col("a0").alias("대여일시"), F.col("st0").alias("대여 대여소번호"), F.col("a1").alias("반납일시"),
                                   F.col("st1").alias("반납대여소번호"), F.col("d").alias("이용거리(M)"), F.col("born").alias("생년"), F.col("sex").alias("성별")))


@query("scan_trips_city_b", sql("trips", RAW + "select bike, ord, a0 t0, st0, a1 t1, st1, d * 1000 dist_m, cast(null as varchar) who from rw"))
def _(t):
    r = raw_text(t)
    return I.trips_city_b(r.select("ord", F.col("bike").alias("자전거번호"), F.col("a0").alias("대여일시"), F.col("st0").alias("대여_대여소ID"), F.col("a1").alias("반납일시"),
                                   F.col("st1").alias("반납_대여소ID"), F.col("d").alias("이용거리(km)")))


UNIFIED = RAW + """select bike, ord, a0 t0, lpad(st0, 5, '0') st0, a1 t1, lpad(st1, 5, '0') st1, d dist_m, born || coalesce(upper(sex), '?') who from rw"""


@query("resolve_columns", sql("trips", UNIFIED))
def _(t):
    r = raw_text(t)
    return I.resolve_columns(r.select("ord", F.col("bike").alias("bike_no"), F.col("a0").alias("RENT_DT"), F.col("st0").alias("RENT_STATION_NO"), F.col("a1").alias("rtn_dt"),
                                      F.col("st1").alias("RTN_STATION_NO"), F.col("d").alias("USE_DST"), F.col("born").alias("BIRTH_YEAR"), F.col("sex").alias("gender")), "ord")


@query("finish_trips", sql("trips", RAW + "select bike, ord, a0 t0, st0, a1 t1, st1, d dist_m, who from rw"))
def _(t):
    r = raw_text(t).join(t.trips.select("ord", "who"), "ord")
    return I.finish_trips(r.select("ord", "bike", F.col("a0").alias("t0"), "st0", F.col("a1").alias("t1"), "st1", F.col("d").alias("dist_m"), "who"))


@query("scan_faults", sql("ev0", """select cast(user_id as varchar) bike, date_trunc('hour', ts) t, 'k' || event_type kind from (select distinct user_id, date_trunc('hour', ts) ts, 'x' event_type from ev0 where event_type = 'error')"""))
def _(t):
    raw = t.events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("자전거번호"), F.date_format(F.date_trunc("hour", "ts"), TEXT).alias("등록일시"), F.lit(" kx ").alias("구분"))
    return I.faults_of(raw)


@query("scan_stations", sql("stations", "select case when length(id) < 5 then lpad(id, 5, '0') else id end id, name, gu, lat, lon from stations where cast(id as int) % 9 <> 4"))
def _(t):
    s = t.stations.select(F.col("id").alias("no"), "name", "gu", F.when(F.col("id").cast("int") % 9 != 4, F.col("lat").cast("string")).alias("lat"), F.col("lon").cast("string").alias("lon"))
    return I.stations_of(s)


def pages(t):
    """Rentals packed in JSON pages of a hundred by ordinal; each is sent twice, the second time corrected."""
    r = raw_text(t)
    r = r.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    row = F.struct(F.col("bike").alias("BIKE_ID"), F.col("a0").alias("RENT_DT"), F.col("st0").alias("RENT_ID"), F.col("a1").alias("RTN_DT"), F.col("st1").alias("RTN_ID"),
                   F.when(F.col("v") == 1, F.col("d")).otherwise("1").alias("USE_DST"), F.col("born").alias("BIRTH_YEAR"), F.col("sex").alias("SEX_CD"))
    page = F.floor(F.col("ord") / 100) * 2 + F.col("v")
    g = r.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("ord", row.alias("r")))).alias("rows"))
    body = F.to_json(F.struct(F.struct(F.size("rows").alias("list_total_count"), F.transform("rows", lambda x: x["r"]).alias("row")).alias("rentData")))
    return g.select("page", body.alias("body"))


@query("ingest_json_pages", sql("trips", RAW + """select bike, a0 t0, lpad(st0, 5, '0') st0, a1 t1, lpad(st1, 5, '0') st1, d dist_m, born || coalesce(upper(sex), '?') who from
    (select *, row_number() over (partition by bike, a0 order by ord desc) r from rw) where r = 1"""))
def _(t):
    return I.json_pages(pages(t)).drop("ord")


@query("unwrap_envelopes", sql("stations", """select id, name from stations where cast(id as int) % 5 <> 4"""))
def _(t):
    item = F.struct("id", "name")
    n = F.col("id").cast("int") % 5
    body = (F.when(n == 0, F.to_json(F.struct(F.struct(F.struct(F.lit("00").alias("resultCode")).alias("header"), F.struct(F.struct(F.array(item).alias("item")).alias("items")).alias("body")).alias("response"))))
            .when(n == 1, F.to_json(F.struct(F.array(item).alias("data")))).when(n == 2, F.to_json(F.struct(F.struct(item.alias("item")).alias("items"))))
            .when(n == 3, F.to_json(F.struct(F.array(item).alias("items")))).otherwise('{"response":{"header":{"resultCode":"99"}}}'))
    return I.unwrap(t.stations.select(body.alias("body")), "struct<id:string,name:string>")[0]


@query("scan_station_status", sql("stations", "select id, trim(name) as name, cast(cast(id as int) % 20 as bigint) racks, cast(case when cast(id as int) % 7 = 0 then null else cast(id as int) % 15 end as bigint) bikes, lat, lon from stations"))
def _(t):
    n = F.col("id").cast("int")
    return I.station_status(t.stations.select(
        F.col("id").alias("stationId"), F.concat(F.lit(" "), "name").alias("stationName"), (n % 20).cast("string").alias("rackTotCnt"),
        F.when(n % 7 == 0, "-").otherwise((n % 15).cast("string")).alias("parkingBikeTotCnt"), F.col("lat").cast("string").alias("stationLatitude"), F.col("lon").cast("string").alias("stationLongitude")))


@query("clip_and_dedup", sql("trips", """select bike, t0, st0, min(ord) ord from trips where t0 >= timestamp '2024-01-10' and t0 < timestamp '2024-01-13' group by 1, 2, 3"""))
def _(t):
    twice = t.trips.unionByName(t.trips.withColumn("ord", F.col("ord") + 1_000_000))
    return I.clip_and_dedup(twice, F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")).select("bike", "t0", "st0", "ord")


@query("scan_window", sql("trips", f"select bike, ord, t0 from trips where t0 >= {NOW} - interval 7 days"))
def _(t):
    return I.scan_window(t.trips, t.now, 7).select("bike", "ord", "t0")


@query("cached_marked_month", sql("marked", """select strftime(t0, '%Y-%m') as month, count(*) n, count(*) filter (where dud) duds, count(*) filter (where alarm) alarms from marked where bike is not null group by 1"""))
def _(t):
    m = t.marked.where("bike is not null")
    return m.groupBy(F.date_format("t0", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if("dud").alias("duds"), F.count_if("alarm").alias("alarms"))


@query("scan_survey", sql("surveys", """select id, bike, status, strftime("at" + interval 9 hours, '%Y-%m-%d %H:%M:%S') at_local from surveys"""))
def _(t):
    return I.survey_of(t.surveys).select("id", "bike", "status", "at_local")


# ---- sinks

def corrections(t):
    d = t.trips.where(F.col("ord") % 3 == 0)
    return d.withColumns({"dist_m": F.when(F.col("ord") % 6 == 0, F.col("dist_m") + 1).otherwise(F.col("dist_m"))})


@query("upsert_trips", sql("trips", """select bike, t0, st0, t1, st1, case when ord % 6 = 0 then dist_m + 1 else dist_m end dist_m, who, ord % 3 = 0 and (ord % 6 = 0 or ord % 5 = 0) changed from trips"""))
def _(t):
    return O.upsert_trips(t.trips.where(F.col("ord") % 15 != 0), corrections(t))


@query("upsert_changed", sql("trips", "select count(*) n, count(*) filter (where ord % 3 = 0 and (ord % 6 = 0 or ord % 5 = 0)) changed from trips"))
def _(t):
    d = O.upsert_trips(t.trips.where(F.col("ord") % 15 != 0), corrections(t))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))


@query("write_daily_lists", sql("morning", """select "day", count(*) bikes from morning group by 1"""))
def _(t):
    return morning(t).groupBy("day").agg(F.count(F.lit(1)).alias("bikes"))


@query("record_list", sql("morning", """select "day", bike, station, chain, level from morning"""))
def _(t):
    return morning(t).select("day", "bike", "station", "chain", "level")


@query("write_scores", sql("marked", DAYSCORE + """select "day", '{"listed":' || listed || ',"rode":' || rode || ',"first_dud":' || first_dud || '}' body from sc"""))
def _(t):
    return O.score_json(A.day_scores(t.marked_rows))


@query("snapshot_json")
def _(t):
    return O.snapshot(live(t), t.now)


@query("snapshot_order", LIVE + "select row_number() over (order by chain desc, t1 desc) as pos, bike, chain from live")
def _(t):
    doc = O.snapshot(live(t), t.now).select(F.from_json("body", "struct<bikes:array<struct<bike:string,chain:bigint>>>").alias("d"))
    return doc.select(F.posexplode("d.bikes").alias("p", "b")).select((F.col("p") + 1).alias("pos"), "b.bike", "b.chain")


@query("export_busy", sql("trips", f""", w as (select * from trips where t0 >= {NOW} - interval 7 days and t0 < {NOW}),
    b as (select st0 station, round(cast(count(*) as double) / (select count(distinct cast(t0 as date)) from w), 1) as avg, {H24} from w group by 1)
    select station, avg, concat_ws(',', {', '.join(f'h{h}' for h in range(24))}) h from b"""))
def _(t):
    b = O.busy_json(A.station_busy(t.trips, t.now)).select("station", F.from_json("body", "struct<avg:double,h:array<bigint>>").alias("b"))
    return b.select("station", "b.avg", F.array_join(F.col("b.h").cast("array<string>"), ",").alias("h"))


@query("export_maintenance_csv", sql("morning stations", """select r as "rank", m.station, station_name, s.gu, s.lat, s.lon, bike, chain, last_dud, case when reported then 'yes' else 'no' end reported from morning m
    left join stations s on s.id = m.station join (select "day", station, row_number() over (partition by "day" order by sum(chain) desc, count(*) desc, station) r from morning group by 1, 2) k on k.day = m.day and k.station = m.station
    where m.day = date '2024-01-20'"""))
def _(t):
    e = saved(morning(t).where(F.col("day") == F.lit("2024-01-20").cast("date")))
    rank = L.rank_stations(e, None, "day").select("day", "station", "rank")
    s = t.stations.select(F.col("id").alias("station"), "gu", "lat", "lon")
    return O.crew_csv(e.join(rank, ["day", "station"]).join(s, "station", "left"))


@query("export_map_layer", sql("marked stations", "select s.id, s.name, s.gu, s.lat, s.lon, count(*) alarms from marked m join stations s on s.id = m.st1 where alarm group by all"))
def _(t):
    return O.map_layer(t.marked, t.stations)


@query("top_districts", sql("marked stations", "select s.gu, count(*) alarms from marked m join stations s on s.id = m.st1 where alarm group by 1 order by 2 desc, 1 limit 10"))
def _(t):
    return O.top_districts(O.map_layer(t.marked, t.stations))


@query("incremental_pull", sql("ev_snapshots", """, o as (select * from ev_snapshots where "at" <= timestamp '2024-01-20'), c as (select max("at") - interval 1 hour cut from o)
    select charger, ord, "at", 'kept' origin from o, c where "at" < cut union all select charger, ord, "at", 'pulled' from ev_snapshots, c where "at" >= cut"""))
def _(t):
    s = t.ev_snapshots.select("charger", "ord", "at")
    return O.incremental(s.where(F.col("at") <= F.lit("2024-01-20").cast("timestamp")), s)


@query("result_report", sql("marked faults", LEAD + """, u as (select cast(100 as double) * count(*) filter (where not exists (select 1 from faults f where f.bike = m.bike and f.t > m.t1 and f.t <= m.t1 + interval 7 days)) / count(*) un
      from marked m where dud and not retry and streak >= 1),
    k as (select streak kk, cast(100 as double) * count(*) filter (where dud) / count(*) v from marked where not retry and streak <= 3 group by 1)
    select 'all' dataset, count(*) trips, cast(100 as double) * count(*) filter (where dud) / count(*) dud_pct, (select v from k where kk = 0) k0, (select v from k where kk = 1) k1, (select v from k where kk = 2) k2, (select v from k where kk = 3) k3,
      cast(count(*) filter (where not retry and streak >= 2 and dud) as double) / count(distinct cast(t0 as date)) per_day,
      (select cast(100 as double) * count(alarm_at) / count(*) from lead) lead_share_pct, (select round(quantile_cont(lead_h, 0.5), 9) from lead) lead_h_median, (select un from u) unreported_pct from marked"""))
def _(t):
    return reduce(DataFrame.unionByName, [report_row(t, "all")])


@query("result_report_by_set", sql("trips faults", """, r0 as (select * exclude (who), case when cast(bike as bigint) % 3 = 0 then 'B' else 'A' end city, strftime(t0, '%Y-%m') as month,
      case when cast(bike as bigint) % 3 <> 0 then who end who, st0 = st1 and t1 - t0 <= interval 180 seconds and dist_m < 300 dud from trips),
    r1 as (select *, coalesce(lag(dud) over w, false) pd, case city when 'A' then coalesce(who = lag(who) over w, false)
      else coalesce(lag(dud) over w and epoch_us(t0) - epoch_us(lag(t1) over w) < 120000000, false) end retry from r0 window w as (partition by city, month, bike order by t0, ord)),
    r2 as (select *, sum(case when pd then 0 else 1 end) over (partition by city, month, bike order by t0, ord) run from r1),
    r3 as (select *, row_number() over (partition by city, month, bike, run order by t0, ord) rn from r2),
    r4 as (select *, cast(sum(case when rn > 1 and not retry then 1 else 0 end) over (partition by city, month, bike, run order by t0, ord) as bigint) streak from r3),
    mk as materialized (select *, dud and not retry and streak = 1 alarm from r4),
    sp as (select city, month, min(t0) lo, max(t0) hi from mk group by 1, 2),
    fa as (select sp.city, sp.month, f.*, f.t between lo and hi inspan from faults f join sp on sp.city = 'A' where cast(f.bike as bigint) % 3 <> 0),
    ld as (select f.city, f.month, f.bike, f.t, min(a.t1) alarm_at from fa f left join mk a on a.alarm and a.city = f.city and a.month = f.month and a.bike = f.bike
      and a.t1 < f.t and a.t1 > f.t - interval 7 days where f.inspan group by all),
    le as (select *, (epoch_us(t) - epoch_us(alarm_at)) / 3.6e9 lead_h, case when alarm_at is not null then (select count(*) from mk m where m.city = ld.city and m.month = ld.month
      and m.bike = ld.bike and m.dud and m.t0 > alarm_at and m.t0 < t) end duds_between from ld),
    l2 as (select city, month, cast(100 as double) * count(alarm_at) / count(*) lead_share_pct, round(quantile_cont(lead_h, 0.5), 9) lead_h_median,
      cast(sum(duds_between) as double) / nullif(count(alarm_at), 0) victims_mean from le group by 1, 2),
    u as (select city, month, cast(100 as double) * count(*) filter (where not exists (select 1 from fa f where f.city = m.city and f.month = m.month and f.bike = m.bike and f.t > m.t1 and f.t <= m.t1 + interval 7 days)) / count(*) unreported_pct
      from mk m where city = 'A' and dud and not retry and streak >= 1 group by 1, 2),
    g as (select city, month, count(*) trips, cast(100 as double) * count(*) filter (where dud) / count(*) dud_pct, """
    + ", ".join(f"cast(100 as double) * count(*) filter (where dud and not retry and streak = {k}) / nullif(count(*) filter (where not retry and streak = {k}), 0) k{k}" for k in range(4))
    + """, cast(count(*) filter (where not retry and streak >= 2 and dud) as double) / count(distinct cast(t0 as date)) per_day from mk group by 1, 2)
    select g.*, lead_share_pct, lead_h_median, victims_mean, unreported_pct from g left join l2 using (city, month) left join u using (city, month)"""))
def _(t):
    # the second city has neither person keys nor fault reports
    second = F.col("bike").cast("long") % 3 == 0
    trips = t.trips.withColumns({"city": F.when(second, "B").otherwise("A"), "month": F.date_format("t0", "yyyy-MM"), "who": F.when(~second, F.col("who"))})
    return report.by_city_and_month(trips, t.faults.where(~second).withColumn("city", F.lit("A")))


def report_row(t, name: str) -> DataFrame:
    """One headline row per data set; reports of several are a union of these."""
    m = t.marked
    # lead times and unreported chains need only the duds: marked once, a few per cent of the rows
    duds = saved(m.where("dud").select("bike", "t0", "t1", "dud", "retry", "streak", "alarm"))
    lead = saved(lead_times(duds, t.faults, heavy=t.heavy, span=t.trips))
    med = quantiles(lead, F.col("lead_h"), [0.5], ["m"]).select(F.round("m", 9)).scalar()
    share = lead.agg(S.percent(F.count("alarm_at"), F.count(F.lit(1))).alias("v")).scalar()
    c = asof(duds.where(~F.col("retry") & (F.col("streak") >= 1)).select("bike", "t1"), t.faults, "bike", "t1", "t", F.struct("t"), "f", "forward", False, t.heavy)
    miss = c.agg(S.percent(F.count_if(~within_hours(F.col("f.t"), F.col("t1"), 168)), F.count(F.lit(1))).alias("v")).scalar()
    other, dud, n = ~F.col("retry"), F.col("dud"), F.count(F.lit(1))

    def at(k):
        on = other & (F.col("streak") == k)
        return S.percent(F.count_if(on & dud), F.count_if(on)).alias(f"k{k}")

    return m.agg(F.lit(name).alias("dataset"), n.alias("trips"), S.percent(F.count_if(dud), n).alias("dud_pct"), *[at(k) for k in range(4)],
                 (F.count_if(other & (F.col("streak") >= 2) & dud) / F.count_distinct(F.to_date("t0"))).alias("per_day"),
                 F.max(share).alias("lead_share_pct"), F.max(med).alias("lead_h_median"), F.max(miss).alias("unreported_pct"))


@query("retention", sql("trips", f"select bike, ord, t1 from trips where t1 >= {NOW} - interval 9 days"))
def _(t):
    return O.retention(t.trips, t.now).select("bike", "ord", "t1")


