"""Crew routes on the morning lists of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as A, routes as R
from ..operators.timeline import saved
from ..rules import Shift
from .list_queries import morning
from .oracle import cte, sql
from .registry import query

HS = "[" + ", ".join(f"h{h}" for h in range(24)) + "]"
cte("ent", ("morning", "profile", "trips"), f"""select m.day, m.bike, m.station, m.chain, coalesce(p.avg, 0) busy,
    case when p.avg is null then [1.0::double for x in range(24)] else {HS} end h from morning m left join profile p on p.station = m.station and p.day = m.day
    where m.day >= (select cast(min(t0) as date) + 7 from trips)""")
cte("ld", ("morning", "marked"), """select "day", bike, (epoch_us(t0) - epoch_us(cast("day" as timestamp))) / 6e7 at_min from
    (select l.day, l.bike, m.t0, m.ord, m.dud, max(case when m.dud then 0 else 1 end) over (partition by l.day, l.bike order by m.t0, m.ord) stopped
      from morning l join marked m on m.bike = l.bike and cast(m.t0 as date) = l.day where not m.retry) where stopped = 0""")
cte("cuts", ("ent",), "select quantile_cont(busy, 0.3333333333333333) cut1, quantile_cont(busy, 0.6666666666666666) cut2 from ent")
cte("entl", ("ent", "cuts"), "select ent.*, least(greatest(chain, 2), 4) bucket, cast(case when busy >= cut2 then 2 when busy >= cut1 then 1 else 0 end as bigint) lvl from ent, cuts")
cte("vtab", ("entl", "ld"), """select bucket, lvl, count(*) n, cast(sum(c) as double) / count(*) as value from
    (select e.*, (select count(*) from ld where ld.day = e.day and ld.bike = e.bike) c from entl e) group by 1, 2""")
cte("stops", ("entl", "vtab", "stations"), """select e.day, e.station, count(*) n, sum(v.value) as value, cast(sum(chain) as bigint) chain_sum, any_value(h) h, any_value(s.region) area, any_value(s.lat) lat, any_value(s.lon) lon
    from entl e join vtab v using (bucket, lvl) join stations s on s.id = e.station group by 1, 2""")
DIST = """2 * 6371000.0 * asin(sqrt(pow(sin(radians({b2} - {a2}) / 2), 2) + cos(radians({a2})) * cos(radians({b2})) * pow(sin(radians({d2} - {c2}) / 2), 2)))"""
cte("starts", ("stations",), f"""select area, id start, lat start_lat, lon start_lon from (select *, row_number() over (partition by area order by round({DIST.format(a2='cla', b2='lat', c2='clo', d2='lon')}, 6), id) r from
    (select region area, id, lat, lon, avg(lat) over (partition by region) cla, avg(lon) over (partition by region) clo from stations)) where r = 1""")


def entries(t):
    lists = morning(t).where(F.col("day") >= F.date_add(F.to_date(t.trips.agg(F.min("t0")).scalar()), 7)).select("day", "bike", "station", "chain")
    return saved(R.with_profile(lists, A.station_profile(t.trips)))


def fitted(t):
    e = entries(t)
    duds = saved(R.list_duds(t.marked, e))
    table, cuts = R.fit_value_table(e, duds)
    return e, duds, saved(table), cuts


def stops(t):
    e, duds, table, cuts = fitted(t)
    return saved(R.station_stops(R.with_value(e, table, cuts), t.stations, "region")), e, duds


@query("fit_value_table", sql("vtab", "select bucket, lvl, n, round(value, 9) as value from vtab"))
def _(t):
    return fitted(t)[2].withColumn("value", F.round("value", 9))


@query("export_value_table", sql("vtab cuts", """select bucket, round(max(value) filter (where lvl = 0), 3) v0, round(max(value) filter (where lvl = 1), 3) v1, round(max(value) filter (where lvl = 2), 3) v2,
    round(any_value(cut1), 1) cut1, round(any_value(cut2), 1) cut2 from vtab, cuts group by 1"""))
def _(t):
    _, _, table, cuts = fitted(t)
    v = [F.round(F.max(F.when(F.col("lvl") == i, F.col("value"))), 3).alias(f"v{i}") for i in range(3)]
    return table.groupBy("bucket").agg(*v).withColumns({c: F.round(cuts.select(c).scalar(), 1) for c in ("cut1", "cut2")})


@query("station_value", sql("stops", """select "day", station, n, at_min, round(value * (h[at_min // 60 + 1] * (1 - (at_min % 60) / 60.0) + coalesce(list_sum(h[at_min // 60 + 2:]), 0)) / list_sum(h), 9) as value
    from stops, (values (540::bigint), (650::bigint)) v(at_min)"""))
def _(t):
    s, _, _ = stops(t)
    s = s.withColumn("at_min", F.explode(F.array(F.lit(540), F.lit(650))))
    return s.select("day", "station", "n", F.col("at_min").cast("long").alias("at_min"), F.round(R.expected_value(F.col("at_min")), 9).alias("value"))


@query("area_centroid_start", sql("starts", "select area, start from starts"))
def _(t):
    return R.area_starts(t.stations, "region").select("area", "start")


ORDERED = f""", o as (select s.*, t.start_lat, t.start_lon, row_number() over (partition by "day", s.area order by chain_sum desc, n desc, station) pos from stops s join starts t on t.area = s.area),
    o1 as (select *, {DIST.format(a2='coalesce(lag(lat) over w, start_lat)', b2='lat', c2='coalesce(lag(lon) over w, start_lon)', d2='lon')} * 1.3 * 60 / 18000 leg, 6 + 4 * n stop_min
      from o where pos <= 10 window w as (partition by "day", area order by pos)),
    o2 as (select *, sum(leg + stop_min) over (partition by "day", area order by pos) end_min from o1)"""


def ordered(t):
    s, e, duds = stops(t)
    pool = s.join(R.area_starts(t.stations, "region"), "area")
    return R.evaluate_order(R.ranked_order(pool, ["day", "area"]), ["day", "area"]), e, duds


@query("score_routes", sql("stops starts", ORDERED + """select "day", area, station, pos as pos, round(540 + end_min - stop_min, 6) arrive, round(end_min, 6) end_min from o2"""))
def _(t):
    d, _, _ = ordered(t)
    return d.select("day", "area", "station", "pos", F.round("arrive", 6).alias("arrive"), F.round("end_min", 6).alias("end_min"))


CUT = """, o3 as (select *, max(case when end_min > 60 then 1 else 0 end) over (partition by "day", area order by pos) o from o2)"""


@query("cut_to_shift", sql("stops starts", ORDERED + CUT + """select "day", area, station, pos from o3 where o = 0"""))
def _(t):
    d, _, _ = ordered(t)
    return R.cut_to_shift(d, ["day", "area"], Shift(minutes=60)).select("day", "area", "station", "pos")


@query("prevented_actual", sql("stops starts ld ent", ORDERED + """select o2.day, o2.area, o2.station, (select count(*) from ent e join ld using ("day", bike) where e.day = o2.day and e.station = o2.station and ld.at_min > 540 + o2.end_min - o2.stop_min) prevented from o2"""))
def _(t):
    d, e, duds = ordered(t)
    return R.prevented(d, e, duds, ["day", "area"])


@query("plan_routes")
def _(t):
    s, _, _ = stops(t)
    pool = s.join(R.area_starts(t.stations, "region"), "area")
    return R.plan_routes(pool, ["day", "area"]).select("day", "area", "station", "pos")


@query("route_backtest")
def _(t):
    s, e, duds = stops(t)
    return R.summarize(R.backtest(s, e, duds, R.area_starts(t.stations, "region"), Shift(minutes=90)))


@query("choose_mode")
def _(t):
    s, e, duds = stops(t)
    first = s.where(F.col("day") < F.lit("2024-01-19").cast("date"))
    starts = R.area_starts(t.stations, "region")
    return R.choose_mode({m: R.backtest(first, e, duds, starts, Shift(minutes=90), m) for m in ("ratio", "multi")})
