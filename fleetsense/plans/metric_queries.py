"""Aggregations and validation summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.stats import quantiles
from ..operators import chains, metrics as A
from ..operators.temporal import faults_after, lead_times, range_count, within_hours
from ..operators.timeline import saved
from ..rules import SEEN_MINUTES
from .chain_queries import ASOF, EARLY, LISTED, listed
from .oracle import NOW, cte, sql
from .registry import query

PCT = "cast(100 as double) * {0} / nullif({1}, 0)"


def pct(hits: str, n: str = "count(*)") -> str:
    return PCT.format(hits, n)


def countif(c: str) -> str:
    return f"count(*) filter (where {c})"


@query("prevented", sql("marked", f"""select {countif('not retry and streak >= 2')} after_alarm_rentals,
    {countif('not retry and streak >= 2 and dud')} prevented,
    cast({countif('not retry and streak >= 2 and dud')} as double) / count(distinct cast(t0 as date)) per_day from marked"""))
def _(t):
    return A.prevented(t.marked)


GRID = """, v as (select s.sec, m.m from (values (60),(120),(180)) s(sec), (values (100),(200),(300)) m(m)),
 gd as (select sec, m, bike, ord, t0, who, st0 = st1 and t1 - t0 <= to_seconds(sec) and dist_m < m dud from trips, v),
 g1 as (select *, coalesce(who = lag(who) over w, false) retry, coalesce(lag(dud) over w, false) pd
   from gd window w as (partition by sec, m, bike order by t0, ord)),
 g2 as (select *, sum(case when pd then 0 else 1 end) over (partition by sec, m, bike order by t0, ord) run from g1),
 g3 as (select *, row_number() over (partition by sec, m, bike, run order by t0, ord) rn from g2),
 g4 as (select *, sum(case when rn > 1 and not retry then 1 else 0 end) over (partition by sec, m, bike, run order by t0, ord) streak from g3),
 grid as (select cast(sec as bigint) sec, cast(m as bigint) m, cast(kk as bigint) k,
   cast(100 as double) * count(*) filter (where not retry and streak >= kk and dud) / nullif(count(*) filter (where not retry and streak >= kk), 0) precision_pct,
   cast(100 as double) * count(*) filter (where not retry and streak = 0 and dud) / nullif(count(*) filter (where not retry and streak = 0), 0) base_pct,
   cast(count(*) filter (where not retry and streak >= kk and dud) as double) / count(distinct cast(t0 as date)) prevented_per_day,
   cast(count(*) filter (where not retry and streak = kk - 1 and dud) as double) / count(distinct cast(t0 as date)) alarms_per_day
   from g4, (values (2),(3)) k(kk) group by all)
"""


@query("rule_grid", sql("trips", GRID + "select * from grid"))
def _(t):
    return A.rule_grid(t.trips, heavy=t.heavy)


@query("rule_choice", sql("trips", GRID + "select * from grid where precision_pct >= 25 order by prevented_per_day desc, sec, m, k limit 1"))
def _(t):
    return A.choose_rule(A.rule_grid(t.trips, heavy=t.heavy), 25.0)


H24 = ", ".join(f"count(*) filter (where hour(t0) = {h}) h{h}" for h in range(24))


@query("station_busy", sql("trips", f""", w as (select * from trips where t0 >= {NOW} - interval 7 days and t0 < {NOW})
    select st0 station, cast(count(*) as double) / (select count(distinct cast(t0 as date)) from w) as avg, {H24} from w group by 1"""))
def _(t):
    return A.station_busy(t.trips, t.now)


cte("profile", ("trips",), f"""select station, "day", (""" + " + ".join(f"h{h}" for h in range(24)) + """) / 7 as avg, * exclude (station, "day") from (
    select a.st0 station, cast(a.d + interval (n) day as date) as "day", """ + ", ".join(f"cast(sum(h{h}) as double) + 0.5 h{h}" for h in range(24))
    + f""" from (select st0, cast(t0 as date) d, {H24} from trips group by all) a, (values (1),(2),(3),(4),(5),(6),(7)) v(n) group by 1, 2)""")


@query("station_profile", sql("profile", "select * from profile"))
def _(t):
    return A.station_profile(t.trips)


cte("spots", ("marked",), """select station, alarms, rentals,
    cast(sum(alarms) over (order by alarms desc, station rows unbounded preceding) as double) / sum(alarms) over () cum_share
    from (select st0 station, count(*) filter (where alarm) alarms, count(*) rentals from marked group by 1) where alarms > 0""")


@query("station_hotspots", sql("spots", "select * from spots"))
def _(t):
    return A.hotspots(t.marked)


@query("station_hotspot_top", sql("spots", "select * exclude (cum_share) from spots order by alarms desc, station limit 15"))
def _(t):
    return A.hotspots(t.marked).drop("cum_share").orderBy(F.desc("alarms"), "station").limit(15)


@query("station_hotspot_share", sql("spots", """, s as (select count(distinct st0) s from trips)
    select count(*) filter (where cum_share < 0.25) + 1 n25, count(*) filter (where cum_share < 0.5) + 1 n50,
    cast(100 as double) * (count(*) filter (where cum_share < 0.25) + 1) / max(s) pct25,
    cast(100 as double) * (count(*) filter (where cum_share < 0.5) + 1) / max(s) pct50 from spots, s"""))
def _(t):
    return A.hotspot_share(A.hotspots(t.marked), F.max(t.trips.agg(F.count_distinct("st0").alias("s")).scalar()))


@query("alarm_hours", sql("marked", "select hour(t1) as hour, count(*) n from marked where alarm group by 1"))
def _(t):
    return t.marked.where("alarm").groupBy(F.hour("t1").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


cte("ststats", ("marked",), """select st1 st, cast(count(*) filter (where dud) as double) / count(*) st_dud_rate,
    ln(1 + cast(count(*) as double) / (select count(distinct cast(t0 as date)) from marked)) st_log_volume from marked group by 1""")


@query("station_stats", sql("ststats", "select st, st_dud_rate, round(st_log_volume, 9) st_log_volume from ststats"))
def _(t):
    from ..operators.features import station_stats
    return station_stats(t.marked).withColumn("st_log_volume", F.round("st_log_volume", 9))


@query("fault_kind_profile", sql("marked faults", f""", x as (select m.bike, m.ord, epoch_us(any_value(m.t1) - any_value(m.t0)) / 1e6 sec,
      any_value(m.dist_m) dist_m, any_value(m.t1) t1, arg_min(f.kind, f.t) kind, min(f.t) ft
      from marked m join faults f on f.bike = m.bike and f.t > m.t1 where m.dud group by 1, 2)
    select kind, count(*) n, {pct(countif('sec < 30'))} under_30s_pct, {pct(countif('dist_m >= 50'))} moved_50m_pct,
      quantile_cont(sec, 0.5) sec_median, quantile_cont(dist_m, 0.5) m_median
    from x where ft <= t1 + interval 24 hours group by 1 having count(*) >= 100"""))
def _(t):
    return A.fault_kind_profile(t.marked, t.faults, heavy=t.heavy)


@query("distinct_asset_counts", sql("trips evs0", """select 'bikes' what, count(distinct bike) n from trips
    union all select 'chargers ' || op, count(distinct charger) from evs0 group by 1"""))
def _(t):
    bikes = t.trips.agg(F.lit("bikes").alias("what"), F.count_distinct("bike").alias("n"))
    ev = t.ev_snapshots.groupBy(F.concat(F.lit("chargers "), "op").alias("what")).agg(F.count_distinct("charger").alias("n"))
    return bikes.unionByName(ev)


cte("rescue", ("ev0",), """select event_id id, cast(user_id as varchar) bike, ts as at,
    ['체인·기어','타이어','안장·핸들','브레이크','멀쩡함'][k % 5 + 1] verdict from ev0 where event_type = 'purchase'""")


def rescue(t):
    verdicts = F.array(*[F.lit(v) for v in S.VERDICTS])
    return t.events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("bike"), F.col("ts").alias("at"),
        F.element_at(verdicts, F.col("k") % 5 + 1).alias("verdict"))


CHECKED = """, c as (select bike, verdict, count(*) n from (select bike, verdict from rescue union all select bike, status from surveys) group by 1, 2)"""


@query("checked_counts", sql("rescue surveys", CHECKED + "select * from c"))
def _(t):
    return A.checked_counts(rescue(t), t.surveys)


@query("checked_summary", sql("rescue surveys", CHECKED + """select bike, cast(sum(n) as bigint) total,
    cast(coalesce(sum(n) filter (where verdict <> '멀쩡함'), 0) as bigint) broken from c group by 1"""))
def _(t):
    return A.checked_summary(A.checked_counts(rescue(t), t.surveys))


# alarms noticed after 3..22 minutes; p is the chain-only share, enough to check the arithmetic
ALARMS = f""", al as ({ASOF}), a2 as (select m.bike, m.t1 as at, m.t1 + to_seconds(60 * (m.ord % 20)) seen_at,
    case when m.ord % 7 <> 0 then cast((m.ord % 10) as double) / 10 end p_next, al.next_t0, al.next_dud
    from marked m join al on al.bike = m.bike and al.ord = m.ord)"""


def alarms(t):
    a = chains.next_rider_after_return(t.marked, F.col("alarm"), t.heavy)
    return a.select("bike", "ord", F.col("t1").alias("at"), F.col("st1").alias("station"), (F.col("streak") + 1).alias("chain"),
                    F.timestamp_micros(F.unix_micros("t1") + F.col("ord") % 20 * 60_000_000).alias("seen_at"),
                    F.when(F.col("ord") % 7 != 0, (F.col("ord") % 10) / 10).alias("p_next"), "next_t0", "next_dud")


@query("alarm_score", sql("marked", ALARMS + f"""select count(*) alarms, count(next_dud) scored, {countif('next_dud')} next_rider_dud,
    {pct(countif('next_dud'), 'count(next_dud)')} precision_pct, count(*) - count(next_dud) waiting, min(cast("at" as date)) since,
    {countif('next_dud is not null and p_next is not null')} model_n,
    100 * round(avg(p_next) filter (where next_dud is not null), 9) model_pred_pct,
    {pct(countif('next_dud and p_next is not null'), countif('next_dud is not null and p_next is not null'))} model_real_pct
    from a2 where seen_at - "at" <= interval {SEEN_MINUTES} minutes"""))
def _(t):
    a = alarms(t)
    return A.alarm_score(a.where(F.unix_micros("seen_at") - F.unix_micros("at") <= SEEN_MINUTES * 60_000_000))


@query("seen_latency", sql("marked", ALARMS + """select bike, "at", seen_at, (epoch_us(seen_at) - epoch_us("at")) / 6e7 as waited_min,
    seen_at - "at" <= interval 10 minutes live from a2"""))
def _(t):
    m = (F.unix_micros("seen_at") - F.unix_micros("at")) / 6e7
    return alarms(t).select("bike", "at", "seen_at", m.alias("waited_min"), (m <= SEEN_MINUTES).alias("live"))


DAYSCORE = LISTED + """, f as (select l.day, l.bike, arg_min(m.dud, (m.t0, m.ord)) dud from listed l
      join marked m on m.bike = l.bike and cast(m.t0 as date) = l.day and not m.retry group by 1, 2),
    sc as (select l.day, count(*) listed, count(f.dud) rode, count(*) filter (where f.dud) first_dud
      from listed l left join f on f.day = l.day and f.bike = l.bike group by 1)"""


@query("day_score", sql("marked", DAYSCORE + "select * from sc"))
def _(t):
    return A.day_scores(t.marked_rows)


@query("day_score_of_lists", sql("marked", DAYSCORE + "select * from sc"))
def _(t):
    return A.day_score(t.marked, listed(t))


@query("first_rider_retro", sql("marked", LISTED + """, x as (select l.day, arg_min(m.dud, (m.t0, m.ord)) truth from listed l
      left join marked m on m.bike = l.bike and cast(m.t0 as date) >= l.day group by l.day, l.bike)
    select "day", count(truth) known, count(*) filter (where truth) hits, count(*) - count(truth) never_ridden from x group by 1"""))
def _(t):
    from ..operators.lists import first_rider_retro, morning_lists
    return first_rider_retro(morning_lists(t.marked_rows, t.faults, t.stations, heavy=t.heavy))


@query("dataset_summary", sql("marked faults", f"""select count(*) rentals, count(distinct bike) bikes, {pct(countif('dud'))} dud_pct,
    (select count(*) from faults) faults from marked"""))
def _(t):
    return A.dataset_summary(t.marked, t.faults)


@query("fault_kinds", sql("faults", "select kind, count(*) n from faults group by 1 order by n desc, kind limit 8"))
def _(t):
    return t.faults.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind").limit(8)


@query("next_day_summary", sql("marked faults", LISTED + """, x as (select l.*, nx.dud first_dud,
      exists (select 1 from faults f where f.bike = l.bike and f.t >= l.t1 - interval 7 days and f.t < l.dayts) reported
      from listed l join (select bike, ord, lead(dud) over (partition by bike order by t0, ord) dud from marked) nx
        on nx.bike = l.bike and nx.ord = l.ord where nx.dud is not null),
    d as (select x.day, x.bike, m.dud, max(case when m.dud then 0 else 1 end) over (partition by x.day, x.bike order by m.t0, m.ord) stopped
      from x join marked m on m.bike = x.bike and cast(m.t0 as date) = x.day)
    select cast(count(*) as double) / count(distinct "day") per_day, cast(100 as double) * count(*) filter (where first_dud) / count(*) first_rider_dud_pct,
      (select cast(count(*) as double) from d where stopped = 0) / count(distinct "day") preventable_per_day,
      cast(100 as double) * count(*) filter (where not reported) / count(*) not_yet_reported_pct from x"""))
def _(t):
    from ..operators.lists import morning_lists
    lists = morning_lists(t.marked_rows, t.faults, t.stations, heavy=t.heavy).where("truth_first_rider_dud is not null")
    day = t.marked.withColumn("day", F.to_date("t0")).join(lists.select("day", "bike"), ["day", "bike"], "left_semi")
    today = chains.before_normal(day, "day", "bike", skip_retry=False).agg(F.count(F.lit(1)).alias("n")).scalar()
    n, days = F.count(F.lit(1)), F.count_distinct("day")
    return lists.agg((n / days).alias("per_day"), S.percent(F.count_if("truth_first_rider_dud"), n).alias("first_rider_dud_pct"),
                     (F.max(today) / days).alias("preventable_per_day"),
                     S.percent(F.count_if(~F.col("reported")), n).alias("not_yet_reported_pct"))


LEAD = """, sp as (select min(t0) lo, max(t0) hi from marked),
    ld as (select f.bike, f.t, min(a.t1) alarm_at from sp, faults f left join marked a on a.alarm and a.bike = f.bike
      and a.t1 < f.t and a.t1 > f.t - interval 7 days where f.t between sp.lo and sp.hi group by 1, 2),
    lead as (select ld.*, (epoch_us(t) - epoch_us(alarm_at)) / 3.6e9 lead_h,
      case when alarm_at is not null then (select count(*) from marked m where m.bike = ld.bike and m.dud and m.t0 > alarm_at and m.t0 < t) end duds_between from ld)"""


@query("lead_time", sql("marked faults", LEAD + "select bike, t, alarm_at, lead_h, duds_between from lead"))
def _(t):
    return lead_times(t.marked, t.faults, heavy=t.heavy, span=t.trips).select("bike", "t", "alarm_at", "lead_h", "duds_between")


@query("lead_time_summary", sql("marked faults", LEAD + """select count(*) faults, count(alarm_at) with_prior_alarm,
    cast(100 as double) * count(alarm_at) / count(*) share_pct, round(quantile_cont(lead_h, 0.5), 9) lead_h_median,
    cast(sum(duds_between) as double) / count(alarm_at) victims_mean from lead"""))
def _(t):
    d = saved(lead_times(t.marked, t.faults, heavy=t.heavy, span=t.trips))
    med = quantiles(d, F.col("lead_h"), [0.5], ["m"]).select("m").scalar()
    n = F.count("alarm_at")
    return d.agg(F.count(F.lit(1)).alias("faults"), n.alias("with_prior_alarm"), S.percent(n, F.count(F.lit(1))).alias("share_pct"),
                 F.round(F.max(med), 9).alias("lead_h_median"), (F.sum("duds_between") / n).alias("victims_mean"))


@query("rank_concentration", sql("marked faults", LEAD + """select round(quantile_cont(lead_h, 0.25), 9) q25, round(quantile_cont(lead_h, 0.5), 9) q50,
    round(quantile_cont(lead_h, 0.75), 9) q75 from lead"""))
def _(t):
    d = A.quartiles(lead_times(t.marked, t.faults, heavy=t.heavy, span=t.trips), F.col("lead_h"))
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


@query("unreported_chains", sql("marked faults", """, x as (select m.bike, m.ord, exists (select 1 from faults f where f.bike = m.bike and f.t > m.t1
      and f.t <= m.t1 + interval 7 days) reported from marked m where dud and not retry and streak >= 1)
    select count(*) chains, count(*) filter (where not reported) unreported,
      cast(100 as double) * count(*) filter (where not reported) / count(*) unreported_pct from x"""))
def _(t):
    from ..operators.temporal import asof
    d = t.marked.where(F.col("dud") & ~F.col("retry") & (F.col("streak") >= 1)).select("bike", "t1")
    d = asof(d, t.faults, "bike", "t1", "t", F.struct("t"), "f", "forward", False, t.heavy)
    miss = F.count_if(~within_hours(F.col("f.t"), F.col("t1"), 7 * 24))
    return d.agg(F.count(F.lit(1)).alias("chains"), miss.alias("unreported"), S.percent(miss, F.count(F.lit(1))).alias("unreported_pct"))


FAULT24 = """, fw as (select m.*, exists (select 1 from faults f where f.bike = m.bike and f.t >= m.t1 + interval 10 minutes
    and f.t <= m.t1 + interval 10 minutes + interval {h} hours) hit from marked m)"""


@query("fault_within", sql("marked faults", FAULT24.format(h=24) + """, a as (select count(*) filter (where dud) duds, count(*) filter (where not dud) normal,
      cast(100 as double) * count(*) filter (where dud and hit) / count(*) filter (where dud) after_dud_pct,
      cast(100 as double) * count(*) filter (where not dud and hit) / count(*) filter (where not dud) after_normal_pct from fw)
    select *, after_dud_pct / after_normal_pct lift from a"""))
def _(t):
    return A.fault_rate(t.marked, t.faults, heavy=t.heavy)


PRE = """, pf as (select f.bike, f.t, count(m.bike) filter (where m.dud) duds, count(m.bike) rentals
    from faults f left join marked m on m.bike = f.bike and m.t1 <= f.t - interval 10 minutes and m.t1 > f.t - interval 48 hours
    where f.bike in (select bike from trips) group by 1, 2)"""


def before_faults(t):
    f = t.faults.join(t.trips.select("bike").distinct(), "bike", "left_semi").withColumns({
        "_lo": S.shift_seconds("t", -48 * 3600), "_hi": S.shift_seconds("t", -600), "_id": F.struct("bike", "t")})
    ends = t.marked.select("bike", "t1", "dud")
    f = range_count(ends, f, "bike", "t1", "bike", "_lo", "_hi", "rentals", lo_open=True, hi_open=False, heavy=t.heavy)
    f = f.withColumn("_id", F.struct("bike", "t"))
    return range_count(ends, f, "bike", "t1", "bike", "_lo", "_hi", "duds", lo_open=True, hi_open=False,
                       weight=F.col("dud").cast("int"), heavy=t.heavy)


@query("pre_fault_duds", sql("marked faults", PRE + "select bike, t, duds, rentals from pf"))
def _(t):
    return before_faults(t).select("bike", "t", "duds", "rentals")


@query("pre_fault_summary", sql("marked faults", PRE + """select count(*) faults, cast(100 as double) * count(*) filter (where duds > 0) / count(*) with_dud_pct,
    cast(sum(duds) as double) / nullif(count(*) filter (where duds > 0), 0) duds_mean from pf"""))
def _(t):
    has = F.count_if(F.col("duds") > 0)
    return before_faults(t).agg(F.count(F.lit(1)).alias("faults"), S.percent(has, F.count(F.lit(1))).alias("with_dud_pct"),
                                F.when(has > 0, F.sum("duds") / has).alias("duds_mean"))


HELP = """, a as (select *, lead(t0) over (partition by bike order by t0, ord) nt from marked),
    hp as (select a.bike, a.ord, (epoch_us(nt) - epoch_us(t1)) / 6e7 wait_min, greatest(0,
      (select count(*) from trips s where s.st0 = a.st1 and s.t0 < a.nt) - (select count(*) from trips s where s.st0 = a.st1 and s.t0 < a.t1) - 1) helpers
      from a where alarm and nt is not null and st1 in (select st0 from trips))"""


@query("helper_count", sql("marked", HELP + "select * from hp"))
def _(t):
    return A.helpers(t.marked_rows, t.trips, t.heavy_station)


@query("helper_summary", sql("marked", HELP + f"""select round(quantile_cont(wait_min, 0.25), 6) w25, round(quantile_cont(wait_min, 0.5), 6) w50,
    round(quantile_cont(wait_min, 0.75), 6) w75,
    {pct(countif('helpers >= 1'))} one_pct, {pct(countif('helpers >= 3'))} three_pct, quantile_cont(cast(helpers as double), 0.5) helpers_median from hp"""))
def _(t):
    d = saved(A.helpers(t.marked_rows, t.trips, t.heavy_station))
    w = quantiles(d, F.col("wait_min"), [0.25, 0.5, 0.75], ["w25", "w50", "w75"])
    h = quantiles(d, F.col("helpers"), [0.5], ["helpers_median"]).select("helpers_median").scalar()
    n = F.count(F.lit(1))
    s = d.agg(S.percent(F.count_if(F.col("helpers") >= 1), n).alias("one_pct"), S.percent(F.count_if(F.col("helpers") >= 3), n).alias("three_pct"))
    w = w.select(*[F.round(c, 6).alias(c) for c in w.columns])
    return w.withColumns({"one_pct": s.select("one_pct").scalar(), "three_pct": s.select("three_pct").scalar(), "helpers_median": h})


@query("sleeping_assets", sql("marked", """, a as (select *, lead(t0) over w nt, lead(dud) over w nd, lead(st0) over w ns
      from marked window w as (partition by bike order by t0, ord)),
    g as (select (epoch_us(nt) - epoch_us(t1)) / 3.6e9 gap, nd, (select count(*) from trips s where s.st0 = a.st1 and s.t0 >= a.t1 and s.t0 < a.nt) o
      from a where nt is not null and ns = st1 and (epoch_us(nt) - epoch_us(t1)) / 3.6e9 >= 6)
    select case when gap < 24 then '6-24' when gap < 72 then '24-72' else '72+' end as hours,
      case when o < 10 then '0-10' when o < 50 then '10-50' else '50+' end others, count(*) n,
      cast(100 as double) * count(*) filter (where nd) / count(*) wake_dud_pct from g group by 1, 2 having count(*) >= 30"""))
def _(t):
    return A.sleeping(t.marked_rows, t.trips, t.heavy_station)


@query("per_alarm_precision", sql("marked", f""", a as ({ASOF}) select count(next_dud) n, {countif('next_dud')} hits,
    {pct(countif('next_dud'), 'count(next_dud)')} precision_pct from a"""))
def _(t):
    a = chains.next_rider_after_return(t.marked, F.col("alarm"), t.heavy)
    n, hits = F.count("next_dud"), F.count_if("next_dud")
    return a.agg(n.alias("n"), hits.alias("hits"), S.percent(hits, n).alias("precision_pct"))


@query("warning_rules", sql("marked faults", FAULT24.format(h=24) + """, x as (select * from fw where t1 >= timestamp '2024-01-16'),
    b as (select cast(count(*) filter (where hit) as double) / count(*) base, count(*) filter (where hit) hits from x),
    r as (select kk, count(*) filter (where dud and streak >= kk - 1) n, count(*) filter (where dud and streak >= kk - 1 and hit) h from x, (values (1),(2),(3)) v(kk) group by 1)
    select cast(kk as bigint) duds_in_row, n warnings, 100 * (cast(h as double) / n) precision_pct, cast(h as double) / n / base lift,
      cast(100 as double) * h / hits recall_pct from r, b"""))
def _(t):
    return A.warning_rules(t.marked, t.faults, F.lit("2024-01-16").cast("timestamp"), t.heavy)


@query("same_person_share", sql("trips", """, d as (select *, (st0 = st1 and t1 - t0 <= interval 120 seconds and dist_m < 200) dud from trips),
    x as (select coalesce(who = lag(who) over w, false) same, (epoch_us(t0) - epoch_us(lag(t1) over w)) / 6e7 gap, lag(dud) over w pd
      from d window w as (partition by bike order by t0, ord))
    select count(*) n, cast(100 as double) * count(*) filter (where same) / count(*) same_person_pct, round(quantile_cont(gap, 0.5), 9) gap_median_min from x where pd"""))
def _(t):
    return A.same_person_share(t.trips, EARLY, t.heavy).withColumn("gap_median_min", F.round("gap_median_min", 9))


@query("by_month", sql("marked faults", FAULT24.format(h=24) + f"""select strftime(t0, '%Y-%m') as month, count(*) rentals, {pct(countif('dud'))} dud_pct,
    {pct(countif('not retry and streak >= 2 and dud'), countif('not retry and streak >= 2'))} next_dud_pct,
    {countif('not retry and streak >= 2 and dud')} prevented, {pct(countif('dud and hit'), countif('dud'))} fault_after_dud_pct from fw group by 1"""))
def _(t):
    d = faults_after(t.marked.select("bike", "t0", "t1", "dud", "retry", "streak"), t.faults, 10, "f", t.heavy)
    hit = within_hours(F.col("f.t"), S.shift_seconds("t1", 600), 24)
    after, dud, n = ~F.col("retry") & (F.col("streak") >= 2), F.col("dud"), F.count(F.lit(1))
    return d.groupBy(F.date_format("t0", "yyyy-MM").alias("month")).agg(
        n.alias("rentals"), S.percent(F.count_if(dud), n).alias("dud_pct"),
        S.percent(F.count_if(after & dud), F.count_if(after)).alias("next_dud_pct"), F.count_if(after & dud).alias("prevented"),
        S.percent(F.count_if(dud & hit), F.count_if(dud)).alias("fault_after_dud_pct"))


@query("city_compare", sql("trips", """, d as (select *, (st0 = st1 and t1 - t0 <= interval 120 seconds and dist_m < 200) dud from trips),
    g as (select *, sum(case when dud then 0 else 1 end) over (partition by bike order by t0, ord rows between unbounded preceding and 1 preceding) gid from d),
    s as (select *, cast(coalesce(sum(case when dud then 1 else 0 end) over (partition by bike, coalesce(gid, 0) order by t0, ord
      rows between unbounded preceding and 1 preceding), 0) as bigint) streak from g)
    select streak k, count(*) n, cast(100 as double) * count(*) filter (where dud) / count(*) next_dud_pct from s where streak <= 4 group by 1"""))
def _(t):
    return A.next_dud_table(chains.simple_streak(t.trips, EARLY, t.heavy))


@query("pier_split", sql("marked faults stations", FAULT24.format(h=168) + """, n as (select fw.*, lead(dud) over (partition by bike order by t0, ord) nd from fw)
    select coalesce(contains(s.name, '1'), false) pier, count(*) alarms, cast(100 as double) * count(*) filter (where hit) / count(*) fault7_pct,
      cast(100 as double) * count(*) filter (where nd) / count(*) next_dud_pct from n left join stations s on s.id = n.st0 where alarm group by 1"""))
def _(t):
    m = chains.with_next_any(t.marked_rows).done().where("alarm").select("bike", "t1", "st0", "any_dud")
    d = faults_after(m, t.faults, 10, "f", t.heavy)
    d = d.join(t.stations.select(F.col("id").alias("st0"), "name"), "st0", "left")
    hit = within_hours(F.col("f.t"), S.shift_seconds("t1", 600), 168)
    n = F.count(F.lit(1))
    return d.groupBy(F.coalesce(F.contains("name", F.lit("1")), F.lit(False)).alias("pier")).agg(
        n.alias("alarms"), S.percent(F.count_if(hit), n).alias("fault7_pct"), S.percent(F.count_if("any_dud"), n).alias("next_dud_pct"))


