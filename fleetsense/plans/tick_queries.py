"""The whole live tick over ten pages, each table against the SQL that marks everything anew at every tick."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X, model as M
from ..streaming import live as V, ticks as K
from .oracle import cte, sql
from .registry import query
from .stream_queries import setup

# The whole tick over landed pages: a page holds what came back since the last one, late rows (returned 30 hours before) and rows
# that are read again. The times of the ticks.
TICKS = ["2024-01-26 12:00:00", "2024-01-26 21:00:00", "2024-01-27 06:00:00", "2024-01-27 15:00:00", "2024-01-28 00:00:00", "2024-01-28 09:00:00",
         "2024-01-28 18:00:00", "2024-01-29 03:00:00", "2024-01-29 12:00:00", "2024-01-30 06:00:00"]
_RUNS: dict[tuple, object] = {}


def pages(trips, folder):
    """Every tick's rows from one reading of the source: a row is in the page of the first tick after it came, and some are
    in the next page again."""
    came = F.when(F.col("ord") % 10 == 3, F.timestamp_micros(F.unix_micros("t1") + 30 * 3_600_000_000)).otherwise(F.col("t1"))
    own = sum((F.col("_c") > F.lit(at).cast("timestamp")).cast("int") for at in TICKS)
    both = F.when(F.col("ord") % 7 == 0, F.array("_i", F.col("_i") + 1)).otherwise(F.array("_i"))
    rows = trips.withColumn("_c", came).withColumn("_i", own).withColumn("page", F.explode(both)).where(F.col("page") < len(TICKS))
    rows.drop("_c", "_i").write.partitionBy("page").parquet(folder)
    return trips.sparkSession.read.schema(trips.withColumn("page", F.lit(0)).schema).parquet(folder)


def ticked(t):
    """The store after all ticks; one run per folder and application."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _RUNS:
        s, _, root = setup(t)
        landing, schema = f"{root}/landing", t.trips.withColumn("landed_at", t.now).schema
        stored = K.live_store(t.spark, f"{root}/store")
        each = K.tick(stored, t.stations, F.max("landed_at"), heavy=t.heavy)
        rows = pages(t.trips, f"{root}/pages")
        for i, at in enumerate(TICKS):
            now = F.lit(at).cast("timestamp")
            rows.where(F.col("page") == i).drop("page").withColumn("landed_at", now).write.mode("append").parquet(landing)
            V.run_available(t.spark.readStream.schema(schema).parquet(landing), root, each, "ticks")
        _RUNS[key] = stored
    return _RUNS[key]


LAST = len(TICKS) - 1
cte("pages", (), "select * from (values " + ", ".join(f"({i}, timestamp '{t}')" for i, t in enumerate(TICKS)) + ") v(i, now_)")
cte("came", ("trips",), "select *, case when ord % 10 = 3 then t1 + interval 30 hours else t1 end came from trips")
cte("km0", ("pages", "came"), """select i, now_, c.* exclude (came), coalesce(st0 = st1 and t1 - t0 <= interval 180 seconds and dist_m < 300, false) dud
    from pages join came c on came <= now_ qualify row_number() over (partition by i, bike, t0 order by ord desc) = 1""")
cte("km1", ("km0",), """select *, coalesce(who = lag(who) over w, false) retry, coalesce(lag(dud) over w, false) pd from km0 window w as (partition by i, bike order by t0, ord)""")
cte("km2", ("km1",), "select *, sum(case when pd then 0 else 1 end) over (partition by i, bike order by t0, ord) run from km1")
cte("km3", ("km2",), "select *, row_number() over (partition by i, bike, run order by t0, ord) rn from km2")
cte("km4", ("km3",), """select * exclude (pd, run, rn), cast(sum(case when rn > 1 and not retry then 1 else 0 end) over (partition by i, bike, run order by t0, ord) as bigint) streak from km3""")
cte("km", ("km4",), "select *, dud and not retry and streak = 1 alarm, cast(case when dud then streak + 1 else 0 end as bigint) chain from km4")
cte("on_list", ("km",), """select * from (select * from km qualify row_number() over (partition by i, bike order by t0 desc, ord desc) = 1)
    where chain >= 2 and t1 >= now_ - interval 24 hours""")
cte("on_list7", ("on_list",), """select s.*, s.now_ as "at", h.hist7_rentals, h.hist7_duds, h.alarms - 1 as prior_alarms7, epoch_us(s.t1 - s.t0) / 1e6 dur_sec,
      greatest(0, (epoch_us(s.now_) - epoch_us(s.t1)) / 3.6e9) age_h, ln(1 + cast((select count(*) from km o where o.i = s.i and o.st0 = s.st1 and o.t0 > s.t1 and o.t0 < s.now_ and o.t1 >= s.now_ - interval 25 hours) as double)) shun
    from on_list s join (select s.i, s.bike, count(*) hist7_rentals, count(*) filter (where k.dud) hist7_duds, count(*) filter (where k.alarm) alarms
      from on_list s join km k on k.i = s.i and k.bike = s.bike and k.t0 <= s.t0 and k.t0 >= s.t0 - interval 7 days group by 1, 2) h on h.i = s.i and h.bike = s.bike""")
cte("on_listp", ("on_list7",), f"select *, {M.to_sql()} p from on_list7")
cte("rang", ("km",), """select bike, t1 as "at", arg_min(st1, i) station, arg_min(streak + 1, i) as chain, min(i) i, min(now_) seen_at from km where alarm and t1 >= now_ - interval 24 hours group by 1, 2""")


def next_of(rows: str, anchor: str) -> str:
    """Next other rider of rows (bike, at, i) at the first tick where it is old enough, and at the last tick."""
    return f"""select bike, "at", arg_min(nt, j) filter (where nt < now_ - interval 7 hours) next_t0, arg_min(nd, j) filter (where nt < now_ - interval 7 hours) next_dud,
      max(nd) filter (where j = {LAST}) at_last from (select a.bike, a."at", k.i j, k.now_, min(k.t0) nt, arg_min(k.dud, (k.t0, k.ord)) nd
        from {rows} a join km k on k.bike = a.bike and k.i >= a.i and k.t0 > a.{anchor} and not k.retry group by all) group by 1, 2"""


cte("rang_next", ("rang",), next_of("rang", '"at"'))
cte("sampled", ("on_listp",), "select * from on_listp where t1 <= now_")
cte("sampled_next", ("sampled",), next_of("sampled", "t0"))
cte("mornings", ("pages",), "select cast(now_ as date) d, min(i) i, min(now_) now_ from pages where cast(now_ as time) >= time '06:10:00' group by 1")
cte("morning_rows_", ("mornings", "km", "stations"), """select m.d as "day", k.bike, k.st1 station, coalesce(s.name, k.st1) station_name, k.chain, case when k.chain >= 3 then '빨강' else '노랑' end as level,
      strftime(k.t1, '%m-%d %H:%M') last_dud, m.now_ as generated
    from (select m.d, k.* from mornings m join km k on k.i = m.i and cast(k.t0 as date) = m.d - 1 qualify row_number() over (partition by m.d, k.bike order by k.t0 desc, k.ord desc) = 1) k
    join mornings m on m.d = k.d left join stations s on s.id = k.st1 where k.chain >= 2""")


@query("live_tick_rides", sql("km", f"""select bike, ord, t0, dud, retry, streak, alarm from km where i = {LAST} and t1 >= now_ - interval 9 days"""))
def _(t):
    return ticked(t).read("rides").select("bike", "ord", "t0", "dud", "retry", "streak", "alarm")


@query("live_tick_alarms", sql("rang_next on_listp", """select a.bike, a."at", a.station, a.chain, a.seen_at, round(l.p, 9) p, n.next_t0, n.next_dud
    from rang a left join on_listp l on l.i = a.i and l.bike = a.bike left join rang_next n on n.bike = a.bike and n."at" = a."at\""""))
def _(t):
    return ticked(t).read("alarms").withColumn("p", F.round("p", 9))


@query("live_tick_samples", sql("sampled_next", """select s."at", s.bike, s.t0 last_t0, chain, hist7_duds, hist7_rentals, prior_alarms7, dur_sec, age_h, round(shun, 9) shun, round(p, 9) p, n.next_t0, n.next_dud
    from sampled s left join sampled_next n on n.bike = s.bike and n."at" = s."at\""""))
def _(t):
    return ticked(t).read("samples").select("at", "bike", "last_t0", *X.FEATURES7[:-1], F.round("shun", 9).alias("shun"), F.round("p", 9).alias("p"), "next_t0", "next_dud")


@query("live_tick_hours", sql("km", f"""select date_trunc('hour', t0) t, count(*) as "rows" from km where i = {LAST} and date_trunc('hour', t0) >= now_ - interval 9 days group by 1"""))
def _(t):
    return ticked(t).read("hours")


@query("live_tick_lists", sql("morning_rows_", "select * from morning_rows_"))
def _(t):
    return ticked(t).read("lists")


@query("live_tick_scores", sql("morning_rows_", """select l."day", count(*) listed, count(f.dud) rode, count(*) filter (where f.dud) first_dud, m.now_ scored_at
    from morning_rows_ l join mornings m on m.d = l."day" + 1 left join (select m.d, k.bike, arg_min(k.dud, (k.t0, k.ord)) dud from mornings m join km k on k.i = m.i and cast(k.t0 as date) = m.d - 1 and not k.retry group by 1, 2) f
      on f.d = m.d and f.bike = l.bike group by l."day", m.now_"""))
def _(t):
    return ticked(t).read("scores")


@query("live_tick_list", sql("on_listp stations", f"""select bike, st1 station, coalesce(s.name, st1) station_name, chain, case when chain >= 3 then '빨강' else '노랑' end as level,
    strftime(t1, '%m-%d %H:%M') last_dud, cast(floor((epoch_us(now_) - epoch_us(t1)) / 6e7) as bigint) minutes_ago, t0, t1, round(p, 9) p from on_listp left join stations s on s.id = st1 where i = {LAST}"""))
def _(t):
    return ticked(t).read("current").withColumn("p", F.round("p", 9))


@query("live_tick_snapshot", sql("on_listp rang_next", f"""select l.now_ as "at", l.n, l.expected, l.at_least, k.today_alarms, h.rentals_in_window, k.latest_return, r.alarms, r.scored, r.next_rider_dud
    from (select max(now_) now_, count(*) n, round(sum(p), 1) expected, greatest(0, cast(floor(sum(p) - 1.2816 * sqrt(sum(p * (1 - p)))) as bigint)) at_least from on_listp where i = {LAST}) l,
      (select count(*) filter (where alarm and t1 >= date_trunc('day', now_)) today_alarms, strftime(max(t1) filter (where t1 <= now_ + interval 5 minutes), '%Y-%m-%dT%H:%M:%S') latest_return from km where i = {LAST}) k,
      (select count(*) rentals_in_window from km where i = {LAST} and date_trunc('hour', t0) > date_trunc('hour', now_ - interval 7 days) and date_trunc('hour', t0) <= now_) h,
      (select count(*) alarms, count(coalesce(next_dud, at_last)) scored, count(*) filter (where coalesce(next_dud, at_last)) next_rider_dud
        from rang a left join rang_next n on n.bike = a.bike and n."at" = a."at" where a.seen_at - a."at" <= interval 15 minutes) r"""))
def _(t):
    j = lambda path, kind: F.get_json_object("body", path).cast(kind)
    d = ticked(t).read("snapshot").withColumns({c: F.get_json_object("body", f"$.{c}") for c in ("model", "score")} | {"list": F.get_json_object("body", "$.body")})
    return d.select("at", F.get_json_object("list", "$.n").cast("long").alias("n"), F.get_json_object("model", "$.expected").cast("double").alias("expected"),
                    F.get_json_object("model", "$.at_least").cast("long").alias("at_least"), j("$.today_alarms", "long").alias("today_alarms"),
                    j("$.rentals_in_window", "long").alias("rentals_in_window"), F.get_json_object("body", "$.latest_return").alias("latest_return"),
                    *(F.get_json_object("score", f"$.{c}").cast("long").alias(c) for c in ("alarms", "scored", "next_rider_dud")))
