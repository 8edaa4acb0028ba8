"""Lists, set comparisons, feed quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chains, lists as L, metrics as A, quality as Q


from .chain_queries import ASOF, LISTED, _limited, listed
from .metric_queries import CHECKED, alarms, rescue
from .oracle import NOW, PARTS, cte, sql
from .registry import query

STATION_CTE = ", stations as materialized (" + PARTS["stations"][1] + ")"
KNOWN = f"t0 >= {NOW} - interval 7 days and t1 <= {NOW}"
LIVE = _limited(KNOWN) + STATION_CTE + f""", live as (select m.bike, m.st1 station, coalesce(s.name, m.st1) station_name, chain, case when chain >= 3 then '빨강' else '노랑' end as level,
    strftime(t1, '%m-%d %H:%M') last_dud, cast(floor((epoch_us({NOW}) - epoch_us(t1)) / 60000000.0) as bigint) minutes_ago, t1
    from (select *, row_number() over (partition by bike order by t0 desc, ord desc) r from marked) m left join stations s on s.id = m.st1
    where r = 1 and chain >= 2 and t1 >= {NOW} - interval 24 hours)"""


def live(t):
    return L.live_list(t.trips, t.now, t.stations, heavy=t.heavy)


@query("live_list", LIVE + "select * exclude (t1) from live")
def _(t):
    return live(t).drop("t0", "t1")


@query("today_alarms", _limited(KNOWN) + f"""select count(*) alarms_in_window, count(*) filter (where t1 >= date_trunc('day', {NOW})) today_alarms from marked where alarm""")
def _(t):
    m = chains.mark(L.known_window(t.trips, t.now), identity="person", heavy=t.heavy).where("alarm")
    return m.agg(F.count(F.lit(1)).alias("alarms_in_window"), F.count_if(F.col("t1") >= F.date_trunc("day", t.now)).alias("today_alarms"))


cte("morning", ("marked", "faults", "stations"), """select cast(d + interval 1 day as date) as "day", m.bike, m.st1 station, coalesce(s.name, m.st1) station_name, chain,
    case when chain >= 3 then '빨강' else '노랑' end as level, strftime(t1, '%m-%d %H:%M') last_dud,
    exists (select 1 from faults f where f.bike = m.bike and f.t >= m.t1 - interval 7 days and f.t < m.d + interval 1 day) reported, nd truth_first_rider_dud, t1
    from (select *, cast(t0 as date) d, row_number() over (partition by bike, cast(t0 as date) order by t0 desc, ord desc) r,
      lead(dud) over (partition by bike order by t0, ord) nd from marked) m left join stations s on s.id = m.st1 where r = 1 and chain >= 2""")


def morning(t):
    return L.morning_lists(t.marked_rows, t.faults, t.stations, heavy=t.heavy)


@query("morning_lists", sql("morning", "select * exclude (t1) from morning"))
def _(t):
    return morning(t).drop("t1")


DAY = "2024-01-20"
WEEK = f"t0 >= timestamp '{DAY}' - interval 7 days and t0 < timestamp '{DAY}'"


@query("morning_list_of", _limited(WEEK) + STATION_CTE + f"""select date '{DAY}' as "day", m.bike, m.st1 station, coalesce(s.name, m.st1) station_name, chain,
    case when chain >= 3 then '빨강' else '노랑' end as level, strftime(t1, '%m-%d %H:%M') last_dud
    from (select *, row_number() over (partition by bike order by t0 desc, ord desc) r from marked) m left join stations s on s.id = m.st1
    where r = 1 and chain >= 2 and t0 >= timestamp '{DAY}' - interval 1 day""")
def _(t):
    return L.morning_list_of(t.trips, F.lit(DAY).cast("date"), t.stations, heavy=t.heavy)


@query("reported_flag", sql("morning", """select "day", bike, reported from morning"""))
def _(t):
    return morning(t).select("day", "bike", "reported")


RANK = """, e as (select m.*, coalesce(c.broken, 0) b from morning m left join (select bike, coalesce(sum(n) filter (where verdict <> '멀쩡함'), 0) broken from c group by 1) c using (bike))
  select "day", station, count(*) filter (where b > 0) confirmed, cast(null as double) expected, cast(sum(chain) as bigint) chain_sum, count(*) bikes,
    row_number() over (partition by "day" order by count(*) filter (where b > 0) desc, sum(chain) desc, count(*) desc, station) as rank from e group by 1, 2"""


@query("rank_stations", sql("morning rescue surveys", CHECKED + RANK))
def _(t):
    broken = A.checked_summary(A.checked_counts(rescue(t), t.surveys))
    return L.rank_stations(morning(t), broken, "day")


@query("checked_boost", sql("morning rescue surveys", CHECKED + """select "day", station, count(*) filter (where coalesce(s.broken, 0) > 0) confirmed
    from morning m left join (select bike, coalesce(sum(n) filter (where verdict <> '멀쩡함'), 0) broken from c group by 1) s using (bike) group by 1, 2"""))
def _(t):
    broken = A.checked_summary(A.checked_counts(rescue(t), t.surveys))
    return L.rank_stations(morning(t), broken, "day").select("day", "station", "confirmed")


@query("filter_district", sql("morning stations", """select m.day, m.bike, m.station, coalesce(s.gu, '기타') gu from morning m left join stations s on s.id = m.station
    where coalesce(s.gu, '기타') in ('NATION_3', '기타')"""))
def _(t):
    e = morning(t).select("day", "bike", "station")
    return L.filter_district(e, t.stations).where(F.col("gu").isin("NATION_3", "기타")).select("day", "bike", "station", "gu")


@query("freshest_source", sql("ev0", f"""select source, "at", body from (select 'cloud' source, max(ts) as at, max(event_id) body from ev0 where event_type = 'view' and ts <= {NOW}
    union all select 'server', max(ts), max(event_id) from ev0 where event_type = 'click' and ts <= {NOW} - interval 1 hour
    union all select 'demo', max(ts), max(event_id) from ev0 where event_type = 'error' and ts <= {NOW} - interval 5 hours)
    where "at" >= {NOW} - to_minutes(case source when 'cloud' then 20 when 'server' then 180 else 180 end) order by "at" desc, source desc limit 1"""))
def _(t):
    def feed(kind, source, back):
        d = t.events.where((F.col("event_type") == kind) & (F.col("ts") <= t.now - F.expr(f"interval {back} hours")))
        return d.agg(F.lit(source).alias("source"), F.max("ts").alias("at"), F.max("event_id").alias("body"))
    feeds = feed("view", "cloud", 0).unionByName(feed("click", "server", 1)).unionByName(feed("error", "demo", 5))
    return L.freshest_source(feeds, t.now, {"cloud": 20, "server": 180, "demo": 180})


@query("default_day", sql("morning", """select case when date '2024-02-01' - max("day") < 3 then max("day") else date '2024-01-15' end as "day" from morning"""))
def _(t):
    return L.default_day(morning(t), F.lit("2024-02-01").cast("date"), "2024-01-15")


@query("lookup_bike", sql("morning ev0", """, q as (select distinct cast(user_id as varchar) raw, 'SPB-' || case when user_id < 100000 then lpad(cast(user_id as varchar), 5, '0') else cast(user_id as varchar) end id from ev0),
    l as (select 'SPB-' || case when length(bike) < 5 then lpad(bike, 5, '0') else bike end id, max_by(chain, "day") chain, max("day") as "day" from morning group by 1)
    select raw, q.id, l.day, l.chain, l.day is not null on_list from q left join l using (id)"""))
def _(t):
    q = t.events.select(F.col("user_id").cast("string").alias("raw")).distinct()
    padded = F.when(F.length("raw") < 5, F.lpad("raw", 5, "0")).otherwise(F.col("raw"))
    q = q.withColumn("id", S.norm_bike(F.concat(F.lit(" spb "), padded)))
    e = morning(t).groupBy(F.format_string("SPB-%05d", F.col("bike").cast("int")).alias("id")).agg(
        F.max_by("chain", "day").alias("chain"), F.max("day").alias("day"))
    return q.join(e, "id", "left").withColumn("on_list", F.col("day").isNotNull())


@query("nearest_stations", sql("morning stations", """select id, round(2 * 6371000.0 * asin(sqrt(pow(sin(radians(lat - 37.55) / 2), 2)
    + cos(radians(37.55)) * cos(radians(lat)) * pow(sin(radians(lon - 126.99) / 2), 2))), 3) metres from stations where id in (select station from morning)
    order by metres, id limit 10""").replace("order by metres", "order by round(metres, 6)").replace("order by round(metres, 6)", "order by metres"))
def _(t):
    return L.nearest_stations(morning(t), t.stations, 37.55, 126.99).withColumn("metres", F.round("metres", 3))


REPLAY_DAY = "2024-01-15"
cte("replay", ("marked", "faults"), f"""select cast(floor((epoch_us(t1) - epoch_us(timestamp '{REPLAY_DAY}')) / 1e6) as bigint) s,
      case when not retry and streak >= 2 then 'prevented' when alarm then 'alarm' else 'dud' end as type, bike, st0 station,
      streak + case when retry then 0 else 1 end as chain, cast(null as varchar) kind
    from marked where dud and t0 >= timestamp '{REPLAY_DAY}' and t0 < timestamp '{REPLAY_DAY}' + interval 1 day
    union all select cast(floor((epoch_us(t) - epoch_us(timestamp '{REPLAY_DAY}')) / 1e6) as bigint), 'fault', bike, null, null, kind from faults
    where t >= timestamp '{REPLAY_DAY}' and t < timestamp '{REPLAY_DAY}' + interval 2 days and bike in (select bike from marked
      where alarm and t0 >= timestamp '{REPLAY_DAY}' and t0 < timestamp '{REPLAY_DAY}' + interval 1 day)""")


def replay(t):
    return L.replay_events(t.marked, t.faults, F.lit(REPLAY_DAY).cast("date"))


@query("export_replay_day", sql("replay", "select * from replay"))
def _(t):
    return replay(t)


@query("replay_counters", sql("replay", """select s, cast(sum(d) over w as bigint) dud, cast(sum(a) over w as bigint) alarm, cast(sum(p) over w as bigint) prevented, cast(sum(f) over w as bigint) fault from
    (select s, count(*) filter (where type = 'dud') d, count(*) filter (where type = 'alarm') a, count(*) filter (where type = 'prevented') p, count(*) filter (where type = 'fault') f
     from replay group by 1) window w as (order by s)"""))
def _(t):
    return L.replay_counters(replay(t))


@query("export_compact", sql("replay", "select s, cast(case type when 'dud' then 0 when 'alarm' then 1 when 'prevented' then 2 else 3 end as bigint) c, bike, station from replay"))
def _(t):
    from ..sources.sinks import compact_events
    return compact_events(replay(t))


@query("name_lookup", sql("trips stations", "select t.bike, t.ord, coalesce(s.name, t.st1) station_name from trips t left join stations s on s.id = t.st1"))
def _(t):
    d = t.trips.select("bike", "ord", F.col("st1").alias("station"))
    return L.with_station(d, t.stations).select("bike", "ord", "station_name")


@query("restrict_assets", sql("marked", LISTED + """select bike, ord, dud, retry from marked m where exists (select 1 from listed l where l.bike = m.bike and l.day = cast(m.t0 as date))"""))
def _(t):
    return t.marked.withColumn("day", F.to_date("t0")).join(listed(t), ["day", "bike"], "left_semi").select("bike", "ord", "dud", "retry")


@query("lateral_prev", sql("trips", "select bike, ord, lag(t0) over w prev_t0, lag(st1) over w prev_st1 from trips window w as (partition by bike order by t0, ord)"))
def _(t):
    from ..operators.timeline import previous
    d = chains.timeline(t.trips, t.heavy).add(p=previous(F.struct("t0", "st1"))).done()
    return d.select("bike", "ord", F.col("p.t0").alias("prev_t0"), F.col("p.st1").alias("prev_st1"))


SURV = """, sv as (select s.id, s.bike, s.at, s.status, coalesce(arg_max(m.chain, (m.t0, m.ord)), 0) chain from surveys s
    left join marked m on m.bike = s.bike and m.t1 <= s.at group by 1, 2, 3, 4)"""


def surveyed(t):
    """Latest rental in row order among those returned by the survey time."""
    bikes = t.surveys.select("bike").distinct()
    m = chains.mark(t.trips.join(bikes, "bike", "left_semi"), identity="person", heavy=t.heavy)
    from ..operators.survey import state_before
    return state_before(t.surveys, m, t.heavy)


@query("survey_asof", sql("marked surveys", SURV + "select id, bike, chain, chain >= 2 alarm from sv"))
def _(t):
    return surveyed(t).select("id", "bike", "chain", "alarm")


CI = """round(100 * (({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) {s} 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4 * {n} * {n})) / (1 + 3.8416 / {n})), 6)"""


def _rate(name, hit, of):
    n, p = f"nullif(cast(count(*) filter (where {of}) as double), 0)", f"(cast(count(*) filter (where {of} and {hit}) as double) / nullif(count(*) filter (where {of}), 0))"
    return (f"cast(100 as double) * count(*) filter (where {of} and {hit}) / nullif(count(*) filter (where {of}), 0) {name}_pct, "
            + CI.format(p=p, n=n, s="-") + f" {name}_lo, " + CI.format(p=p, n=n, s="+") + f" {name}_hi")


@query("field_validation", sql("marked surveys", SURV + """select count(*) checked, count(*) filter (where status <> '멀쩡함') broken, count(*) filter (where chain >= 2) alarmed, """
       + ", ".join([_rate("recall", "chain >= 2", "status <> '멀쩡함'"), _rate("false_alarm", "chain >= 2", "status = '멀쩡함'"), _rate("precision", "status <> '멀쩡함'", "chain >= 2")]) + " from sv"))
def _(t):
    from ..operators.survey import validate
    d = validate(surveyed(t))
    return d.select(*[F.round(c, 6).alias(c) if c.endswith(("_lo", "_hi")) else F.col(c) for c in d.columns])


@query("survey_by_status", sql("marked surveys", SURV + "select status, count(*) n, count(*) filter (where chain >= 2) alarmed from sv group by 1"))
def _(t):
    return surveyed(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("alarm").alias("alarmed"))


# ---- feed quality

cte("health", ("hours",), f"""select h.t, h.rows, h.rows / median(p.rows) ratio, h.rows < 0.3::double * min(p.rows) thin from hours h
    join hours p on hour(p.t) = hour(h.t) and p.t < h.t and p.t >= h.t - interval 7 days and p.t < date_trunc('hour', {NOW})
    where h.t < date_trunc('hour', {NOW}) group by h.t, h.rows having count(*) >= 3 and min(p.rows) > 0""")


def health(t):
    return Q.hour_health(t.hours, t.now)


@query("hour_health", sql("health", "select * from health"))
def _(t):
    return health(t)


@query("tumbling_hours", sql("trips", """select date_trunc('hour', t0) t, count(*) as "rows" from trips group by 1"""))
def _(t):
    return Q.hourly_counts(t.trips)


@query("feed_status", sql("health", f""", th as (select t, ratio, epoch(t) / 3600 - row_number() over (order by t) g from health where thin),
    r as (select min(t) since, max(t) until, arg_max(ratio, t) ratio from th group by g)
    select count(*) = 0 ok, max(since) since, max(ratio) ratio from r where until = date_trunc('hour', {NOW}) - interval 1 hour"""))
def _(t):
    return Q.feed_status(health(t), t.now)


@query("thin_runs", sql("health", """, th as (select t, ratio, epoch(t) / 3600 - row_number() over (order by t) g from health where thin)
    select min(t) since, max(t) until, arg_max(ratio, t) ratio from th group by g"""))
def _(t):
    from pyspark.sql import Window
    thin = health(t).where("thin").withColumn("_g", F.unix_micros("t") / 3_600_000_000 - F.row_number().over(Window.orderBy("t")))
    return thin.groupBy("_g").agg(F.min("t").alias("since"), F.max("t").alias("until"), F.max_by("ratio", "t").alias("ratio")).drop("_g")


@query("held_scores", sql("marked health", f""", a as ({ASOF}), b as (select a.bike, m.t1 as at, a.next_t0, a.next_dud from a join marked m on m.bike = a.bike and m.ord = a.ord)
    select bike, "at", next_t0, next_dud, exists (select 1 from health h where thin and h.t >= date_trunc('hour', "at") and h.t <= date_trunc('hour', next_t0)) held from b"""))
def _(t):
    a = alarms(t).select("bike", "at", "next_t0", "next_dud")
    return Q.held_scores(a, health(t))


@query("rows_in_window", sql("hours", f"select cast(sum(rows) as bigint) rows_in_window from hours where t >= {NOW} - interval 7 days and t <= {NOW}"))
def _(t):
    return Q.rows_in_window(t.hours, t.now)


@query("missing_hours", sql("hours", f"""select t from (select unnest(generate_series(timestamp '2024-01-01', {NOW}, interval 1 hour)) t) where t not in (select t from hours)"""))
def _(t):
    return Q.missing_hours(t.hours, F.lit("2024-01-01").cast("timestamp"), t.now)


@query("unsettled_hours", sql("hours", f"""select s.t from (select unnest(generate_series(timestamp '2024-01-01', {NOW} - interval 1 second, interval 1 hour)) t) s left join hours h on h.t = s.t
    where h.t is null or h.t + to_hours(cast(rows % 7 as int)) < h.t + interval 4 hours"""))
def _(t):
    ledger = t.hours.select("t", F.timestamp_micros(F.unix_micros("t") + F.col("rows") % 7 * 3_600_000_000).alias("fetched_at"))
    return Q.unsettled_hours(ledger, F.lit("2024-01-01").cast("timestamp"), t.now)


@query("recheck_hours", sql("health", f"select t from health where thin and t >= timestamp '2024-01-27' - interval 48 hours and t < timestamp '2024-01-27' - interval 7 hours"))
def _(t):
    return Q.recheck_hours(health(t), F.lit("2024-01-27").cast("timestamp"))


# ---- set comparisons



@query("list_overlap", sql("morning", """select "day", count(*) n_left, count(*) filter (where bike_ok) n_right, count(*) filter (where bike_ok) common, 0 missed,
    cast(100 as double) * count(*) filter (where bike_ok) / count(*) jaccard_pct from (select *, chain >= 3 bike_ok from morning) group by 1""").replace(", 0 missed", ", cast(0 as bigint) missed"))
def _(t):
    a = morning(t).select("day", "bike", "chain")
    return L.overlap(a, a.where("chain >= 3"), ["day", "bike"], "day")


@query("list_diff", sql("morning", """(select "day", bike, 'left' side from morning where chain < 4 except select "day", bike, 'left' from morning where chain > 2)
    union all (select "day", bike, 'right' from morning where chain > 2 except select "day", bike, 'right' from morning where chain < 4)"""))
def _(t):
    a = morning(t).select("day", "bike", "chain")
    return L.diff(a.where("chain < 4").select("day", "bike"), a.where("chain > 2").select("day", "bike"))


@query("union_reports", sql("rescue surveys", "select bike, verdict from rescue union all select bike, status from surveys"))
def _(t):
    return rescue(t).select("bike", "verdict").unionByName(t.surveys.select("bike", F.col("status").alias("verdict")))


@query("months_concat", sql("trips", "select 'a' part, bike, ord from trips where day(t0) < 16 union all select 'b', bike, ord from trips where day(t0) >= 16"))
def _(t):
    a = t.trips.where(F.dayofmonth("t0") < 16).select(F.lit("a").alias("part"), "bike", "ord")
    return a.unionByName(t.trips.where(F.dayofmonth("t0") >= 16).select(F.lit("b").alias("part"), "bike", "ord"))


@query("dedup", sql("ev_snapshots", """select charger, start, "end", min("at") first_at from ev_snapshots group by 1, 2, 3"""))
def _(t):
    return t.ev_snapshots.groupBy("charger", "start", "end").agg(F.min("at").alias("first_at"))


PARITY = """, l as (select * from trips where ord % 101 <> 0), r as (select bike, t0, st0, t1, st1, dist_m + ord % 3 dist_m, case when ord % 17 = 0 then null else who end who from trips where ord % 103 <> 0),
    j as (select l.bike lb, r.bike rb, l.st0 is not distinct from r.st0 st0, l.t1 is not distinct from r.t1 t1, abs(l.dist_m - r.dist_m) <= 1 d, l.who is not distinct from r.who w
      from l full join r on l.bike = r.bike and l.t0 = r.t0)
    select count(*) filter (where lb is not null and rb is not null) n_both, count(*) filter (where rb is null) left_only, count(*) filter (where lb is null) right_only,
      cast(100 as double) * count(*) filter (where lb is not null and rb is not null and st0) / count(*) filter (where lb is not null and rb is not null) st0_equal_pct,
      cast(100 as double) * count(*) filter (where lb is not null and rb is not null and t1) / count(*) filter (where lb is not null and rb is not null) t1_equal_pct,
      cast(100 as double) * count(*) filter (where lb is not null and rb is not null and d) / count(*) filter (where lb is not null and rb is not null) dist_equal_pct,
      cast(100 as double) * count(*) filter (where lb is not null and rb is not null and w) / count(*) filter (where lb is not null and rb is not null) who_equal_pct from j"""


@query("feed_parity", sql("trips", PARITY))
def _(t):
    from ..operators.parity import feed_parity
    left = t.trips.where(F.col("ord") % 101 != 0)
    right = t.trips.where(F.col("ord") % 103 != 0).withColumns(
        {"dist_m": F.col("dist_m") + F.col("ord") % 3, "who": F.when(F.col("ord") % 17 != 0, F.col("who"))})
    return feed_parity(left, right).drop("st1_equal_pct")




@query("rehearsal", sql("marked", """, w as (select cast(v as bigint) win from (values (1), (3), (7)) x(v)),
    base as (select w.win, cast(d.d + interval 1 day as date) as "day", t.bike, t.t0, t.ord, t.dud, t.who, t.st1
      from w, (select distinct cast(t0 as date) d from marked) d join marked t on t.t0 < d.d + interval 1 day and t.t0 >= d.d + interval 1 day - to_days(cast(w.win as int))),
    r1 as (select *, coalesce(who = lag(who) over q, false) retry, coalesce(lag(dud) over q, false) pd from base window q as (partition by win, "day", bike order by t0, ord)),
    r2 as (select *, sum(case when pd then 0 else 1 end) over (partition by win, "day", bike order by t0, ord) run from r1),
    r3 as (select *, row_number() over (partition by win, "day", bike, run order by t0, ord) rn, row_number() over (partition by win, "day", bike order by t0 desc, ord desc) lr from r2),
    r4 as (select *, sum(case when rn > 1 and not retry then 1 else 0 end) over (partition by win, "day", bike, run order by t0, ord) streak from r3),
    ls as (select win, "day", bike from r4 where lr = 1 and dud and streak + 1 >= 2 and cast(t0 as date) = "day" - 1),
    fl as (select cast(cast(t0 as date) + interval 1 day as date) as "day", bike from (select *, row_number() over (partition by bike, cast(t0 as date) order by t0 desc, ord desc) r from marked) where r = 1 and chain >= 2),
    jj as (select w.win, f.day, f.bike fb, cast(null as varchar) lb from w, fl f union all select win, "day", null, bike from ls),
    k as (select win, "day", coalesce(fb, lb) bike, count(fb) f, count(lb) l from jj group by 1, 2, 3),
    fr as (select bike, cast(t0 as date) as "day", arg_min(dud, (t0, ord)) d from marked group by 1, 2),
    sc as (select win as "days", "day", count(*) rode, count(*) filter (where d) fd from ls join fr using ("day", bike) group by 1, 2),
    o as (select win as "days", "day", count(*) filter (where l > 0) n_left, count(*) filter (where f > 0) n_right, count(*) filter (where l > 0 and f > 0) common,
      count(*) filter (where l = 0) missed, cast(100 as double) * count(*) filter (where l > 0 and f > 0) / count(*) jaccard_pct from k group by 1, 2)
    select o.*, case when o.day <= (select max(cast(t0 as date)) from marked) then coalesce(rode, 0) end rode,
      case when o.day <= (select max(cast(t0 as date)) from marked) then coalesce(fd, 0) end first_dud from o left join sc using ("days", "day")"""))
def _(t):
    from ..operators.rehearsal import rehearse
    return rehearse(t.trips, (1, 3, 7), heavy=t.heavy)


