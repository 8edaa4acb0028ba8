"""Chain core: marks, neighbours, runs and per-asset history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import chain_after, is_dud
from ..operators import chains, metrics
from ..rules import Rule
from .oracle import NOW, sql
from .registry import query

KEY = ["bike", "ord"]


@query("is_dud", sql("duds", "select bike, ord, dud from duds"))
def _(t):
    return t.trips.select(*KEY, is_dud().alias("dud"))


@query("retry_by_person", sql("marked", "select bike, ord, retry from marked"))
def _(t):
    return t.marked.select(*KEY, "retry")


GAP = """, g as (select *, coalesce(lag(dud) over w, false) and coalesce(t0 - lag(t1) over w < interval 120 seconds, false) gretry,
    coalesce(lag(dud) over w, false) gpd from duds window w as (partition by bike order by t0, ord)),
g2 as (select *, sum(case when gpd then 0 else 1 end) over (partition by bike order by t0, ord) run from g),
g3 as (select *, row_number() over (partition by bike, run order by t0, ord) rn from g2)
select bike, ord, gretry retry, cast(sum(case when rn > 1 and not gretry then 1 else 0 end)
    over (partition by bike, run order by t0, ord) as bigint) streak from g3"""


@query("retry_by_gap", sql("duds", GAP))
def _(t):
    return chains.mark(t.trips, identity="gap", heavy=t.heavy).select(*KEY, "retry", "streak")


@query("streak", sql("marked", "select bike, ord, streak from marked"))
def _(t):
    return t.marked.select(*KEY, "streak")


@query("alarm", sql("marked", 'select bike, ord, t1 as "at", st1 station, streak + 1 as chain from marked where alarm'))
def _(t):
    return t.marked.where("alarm").select(*KEY, F.col("t1").alias("at"), F.col("st1").alias("station"),
                                          (F.col("streak") + 1).alias("chain"))


@query("mark", sql("marked", "select bike, ord, t0, t1, st0, st1, dist_m, who, dud, retry, streak, alarm from marked"))
def _(t):
    return t.marked.select("bike", "ord", "t0", "t1", "st0", "st1", "dist_m", "who", "dud", "retry", "streak", "alarm")


def _limited(where: str) -> str:
    """Marks recomputed on a filtered trip table."""
    return f"""with s as (select count(*) s from supplier),
ev0 as (select event_id, ts, user_id, event_type, value, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int) as k from events),
trips as materialized (select * from (select cast(user_id as varchar) bike, event_id ord, ts t0,
  cast(1 + user_id % s.s as varchar) st0, ts + to_seconds(cast(round(value * 6) as bigint)) t1,
  cast(case when event_id % 5 = 0 then 1 + (user_id + event_id) % s.s else 1 + user_id % s.s end as varchar) st1,
  cast((event_id * 37) % 400 as double) dist_m, case when k % 10 <> 0 then cast(k % 7 as varchar) end who from ev0, s)
  where {where}),
duds as (select *, (st0 = st1 and t1 - t0 <= interval 180 seconds and dist_m < 300) dud from trips),
m1 as (select *, coalesce(who = lag(who) over w, false) retry, coalesce(lag(dud) over w, false) pd
  from duds window w as (partition by bike order by t0, ord)),
m2 as (select *, sum(case when pd then 0 else 1 end) over (partition by bike order by t0, ord) run from m1),
m3 as (select *, row_number() over (partition by bike, run order by t0, ord) rn from m2),
m4 as (select * exclude (pd), cast(sum(case when rn > 1 and not retry then 1 else 0 end)
  over (partition by bike, run order by t0, ord) as bigint) streak from m3),
marked as materialized (select * exclude (run, rn), dud and not retry and streak = 1 alarm,
  cast(case when dud then streak + 1 else 0 end as bigint) chain from m4)
"""


@query("mark_rows", _limited(f"t0 >= {NOW} - interval 7 days and t0 <= {NOW}")
       + "select bike, ord, dud, retry, streak, alarm from marked where bike in (select bike from marked where alarm)")
def _(t):
    week = t.now - F.expr("interval 7 days")
    recent = t.trips.where((F.col("t0") >= week) & (F.col("t0") <= t.now))
    listed = chains.mark(recent, identity="person", heavy=t.heavy).where("alarm").select("bike")
    return chains.mark_window(t.trips, week, t.now, listed, heavy=t.heavy).select(
        *KEY, "dud", "retry", "streak", "alarm")


@query("candidates", sql("duds", f"""select distinct bike from (select *, lag(dud) over (partition by bike order by t0, ord) pd from duds)
    where dud and pd and t1 >= {NOW} - interval 24 hours"""))
def _(t):
    return chains.candidates(t.trips, t.now, heavy=t.heavy)


@query("last_per_asset", sql("marked", """select bike, ord, t0, dud, streak from
    (select *, row_number() over (partition by bike, cast(t0 as date) order by t0 desc, ord desc) r from marked) where r = 1"""))
def _(t):
    return chains.last_row(t.marked.withColumn("day", F.to_date("t0")), "bike", "day").select(
        *KEY, "t0", "dud", "streak")


@query("next_rider_row", sql("marked", """select bike, ord,
    first_value(case when retry then null else dud end ignore nulls) over (partition by bike order by t0, ord
      rows between 1 following and unbounded following) next_dud from marked"""))
def _(t):
    return chains.with_next_rider(t.marked_rows).done().select(*KEY, "next_dud")


ASOF = """select a.bike, a.ord, min(n.t0) next_t0, arg_min(n.dud, n.t0) next_dud from marked a
    left join marked n on n.bike = a.bike and n.t0 > a.t1 and not n.retry where a.alarm group by 1, 2"""


@query("next_rider_asof", sql("marked", ASOF))
def _(t):
    return chains.next_rider_after_return(t.marked, F.col("alarm"), t.heavy).select(*KEY, "next_t0", "next_dud")


@query("next_any_row", sql("marked", """select bike, ord, lead(t0) over w next_t0, lead(dud) over w next_dud
    from marked window w as (partition by bike order by t0, ord)"""))
def _(t):
    return chains.with_next_any(t.marked_rows).done().select(
        *KEY, F.col("any_t0").alias("next_t0"), F.col("any_dud").alias("next_dud"))


@query("run_features", sql("marked", """, p as (select *, lag(dud) over w pd, (epoch_us(t0) - epoch_us(lag(t1) over w)) / 6e7 idle
      from marked window w as (partition by bike order by t0, ord)),
    q as (select *, sum(case when dud and not coalesce(pd, false) then 1 else 0 end) over (partition by bike order by t0, ord) r from p),
    u as (select bike, ord, t0, r, row_number() over w n, sum(case when retry then 1 else 0 end) over w rt,
        (epoch_us(t1) - epoch_us(first_value(t1) over w)) / 6e7 span, first_value(idle) over w idle0
      from q where dud window w as (partition by bike, r order by t0, ord))
    select q.bike, q.ord, coalesce(u.n, 0) run_len, cast(coalesce(u.rt, 0) as bigint) run_retries, u.span run_span_min,
      q.idle idle_before_min, u.idle0 idle_before_run_min from q left join u using (bike, ord)"""))
def _(t):
    return chains.run_features(t.marked_rows).done().select(
        *KEY, "run_len", "run_retries", "run_span_min", "idle_before_min", "idle_before_run_min")


@query("last_normal", sql("marked", """, n as (select *, last_value(case when not dud then t0 end ignore nulls) over w n0,
      last_value(case when not dud then t1 end ignore nulls) over w n1 from marked
      window w as (partition by bike order by t0, ord rows between unbounded preceding and current row))
    select bike, ord, (epoch_us(t1) - epoch_us(n1)) / 3.6e9 last_normal_ago_h, (epoch_us(n1) - epoch_us(n0)) / 6e7 last_normal_dur_min from n"""))
def _(t):
    return chains.last_normal(t.marked_rows).done().select(*KEY, "last_normal_ago_h", "last_normal_dur_min")


@query("hist7", sql("marked", """select bike, ord, count(*) over w hist7_rentals, count(*) filter (where dud) over w hist7_duds,
      count(*) filter (where alarm) over w hist7_alarms from marked
      window w as (partition by bike order by t0 range between interval 7 days preceding and current row)"""))
def _(t):
    return chains.history(t.marked, 7, t.heavy).done().select(
        *KEY, F.col("hist_rentals").alias("hist7_rentals"), F.col("hist_duds").alias("hist7_duds"),
        F.col("hist_alarms").alias("hist7_alarms"))


EARLY = Rule(max_sec=120, max_m=200)


@query("simple_streak", sql("trips", """, d as (select *, (st0 = st1 and t1 - t0 <= interval 120 seconds and dist_m < 200) dud from trips),
    g as (select *, sum(case when dud then 0 else 1 end) over (partition by bike order by t0, ord rows between unbounded preceding and 1 preceding) gid from d)
    select bike, ord, dud, cast(coalesce(sum(case when dud then 1 else 0 end) over (partition by bike, coalesce(gid, 0) order by t0, ord
      rows between unbounded preceding and 1 preceding), 0) as bigint) streak from g"""))
def _(t):
    return chains.simple_streak(t.trips, EARLY, t.heavy).select(*KEY, "dud", "streak")


LISTED = """, listed as (select bike, d + interval 1 day as dayts, cast(d + interval 1 day as date) as "day", st1 station, chain, t1, ord from
    (select *, cast(t0 as date) d, row_number() over (partition by bike, cast(t0 as date) order by t0 desc, ord desc) r from marked)
    where r = 1 and chain >= 2)"""


def listed(t):
    """(day, bike) pairs of the morning lists."""
    last = chains.last_row(t.marked.withColumn("d", F.to_date("t0")), "bike", "d").withColumn("chain", chain_after())
    return last.where("chain >= 2").select(F.date_add("d", 1).alias("day"), "bike", F.col("st1").alias("station"), "chain", "t1")


@query("first_rider_of_day", sql("marked", LISTED + """select l.day, l.bike, arg_min(m.dud, (m.t0, m.ord)) dud, min(m.t0) t0
    from listed l join marked m on m.bike = l.bike and cast(m.t0 as date) = l.day and not m.retry group by 1, 2"""))
def _(t):
    return chains.first_rider_of_day(t.marked, listed(t)).select("day", "bike", "dud", "t0")


@query("duds_until_normal", sql("marked", LISTED + """, x as (select l.day, l.bike, m.t0, m.ord, m.dud,
      max(case when m.dud then 0 else 1 end) over (partition by m.bike, l.day order by m.t0, m.ord) stopped
      from listed l join marked m on m.bike = l.bike and cast(m.t0 as date) = l.day where not m.retry)
    select "day", bike, ord, (epoch_us(t0) - epoch_us(cast("day" as timestamp))) / 6e7 at_minute from x where stopped = 0"""))
def _(t):
    days = t.marked.withColumn("day", F.to_date("t0")).join(
        listed(t).select("day", "bike"), ["day", "bike"], "left_semi")
    minute = (F.unix_micros("t0") - F.unix_micros(F.col("day").cast("timestamp"))) / 6e7
    return chains.before_normal(days, "day", "bike").select("day", "bike", "ord", minute.alias("at_minute"))


@query("long_run_after_alarm", sql("marked", """, lim as (select date_trunc('day', max(t1)) - interval 3 days e from marked),
    x as (select *, first_value(case when retry then null else {'dud': dud, 't0': t0} end ignore nulls) over f nr,
        sum(case when dud then 0 else 1 end) over (partition by bike order by t0, ord) g
      from marked window f as (partition by bike order by t0, ord rows between 1 following and unbounded following)),
    y as (select *, last_value(t1) over (partition by bike, g, dud order by t0, ord rows between unbounded preceding and unbounded following) e from x),
    z as (select case when nr is null or nr.t0 - t1 > interval 24 hours then 'nobody' when nr.dud then 'dud' else 'ride' end outcome,
        y.e - t1 >= interval 24 hours h24, y.e - t1 >= interval 48 hours h48 from y, lim where alarm and t1 < lim.e)
    select outcome, count(*) n, count(*) filter (where h24) still_24h, count(*) filter (where h48) still_48h from z group by 1"""))
def _(t):
    rows = chains.with_next_rider(t.marked_rows)
    m = chains.run_last_return(rows.done(), t.heavy)
    end = t.trips.agg((F.date_trunc("day", F.max("t1")) - F.expr("interval 3 days")).alias("e")).scalar()
    a = m.where(F.col("alarm") & (F.col("t1") < end))
    late = F.col("next_t0").isNull() | (F.col("next_t0") - F.col("t1") > F.expr("interval 24 hours"))
    outcome = F.when(late, "nobody").when(F.col("next_dud"), "dud").otherwise("ride")
    still = F.col("run_end") - F.col("t1")
    return a.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(still >= F.expr("interval 24 hours")).alias("still_24h"),
        F.count_if(still >= F.expr("interval 48 hours")).alias("still_48h"))


NEXT_TABLE = """select streak k, count(*) n, 100.0 * count(*) filter (where dud) / count(*) next_dud_pct
    from marked where not retry and streak between 0 and 4 group by 1"""


@query("next_dud_table", sql("marked", NEXT_TABLE.replace("100.0 *", "cast(100 as double) *")))
def _(t):
    return metrics.next_dud_table(t.marked)


