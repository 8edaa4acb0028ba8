"""Streams over the given event files, run with the available data; results must equal the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chains
from ..sources.adapters import EVENTS, Tables
from ..streaming import live as V, streams as W
from .list_queries import rescue
from .oracle import NOW, sql
from .registry import query


class StreamTables(Tables):
    """The same domain tables with ``events`` as a stream of landed files."""

    @property
    def events(self):
        return self._events(self.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(self.folder))


def setup(t):
    s = StreamTables(t.spark, t.folder)
    root = V.workspace(t.spark)
    return s, V.LiveTables(t.spark, root), root


def filled(t):
    s, tables, root = setup(t)
    V.run_available(s.trips, root, V.tick(tables, t.now, heavy=t.heavy))
    return tables


@query("stream_alarms", sql("marked", f"""select bike, t1 as "at", st1 station, streak + 1 as chain, {NOW} seen_at from marked where alarm"""))
def _(t):
    return filled(t).alarms().select(*V.ALARM_COLS)


@query("stream_alarms_ordered", sql("marked", """select bike, ord, 'alarm' kind, epoch_us(t1) at_us, st1 station, streak + 1 as chain from marked where alarm"""))
def _(t):
    s, _, root = setup(t)
    return t.spark.read.parquet(W.ordered_alarms(s.trips, root))


@query("late_data", sql("marked", "select bike, ord, dud, retry, streak, alarm from marked"))
def _(t):
    s, tables, root = setup(t)
    late = F.col("ord") % 10 == 3
    V.run_available(s.trips.where(~late), root, V.tick(tables, t.now, heavy=t.heavy), "on-time")
    V.run_available(s.trips.where(late), root, V.tick(tables, t.now, heavy=t.heavy), "late")
    return chains.mark(tables.rentals(), identity="person", heavy=t.heavy).select("bike", "ord", "dud", "retry", "streak", "alarm")


@query("stream_dedup", sql("ev_snapshots", """select charger, start, "end", count(distinct stat) states from ev_snapshots group by 1, 2, 3"""))
def _(t):
    s, _, root = setup(t)
    seen = W.drop_repeats(s.ev_snapshots.select("charger", "start", "end", "stat", "at"), ["charger", "start", "end", "stat"], "at", root, "start")
    # every (charger, start, end, stat) must be there once
    return seen.read("seen").groupBy("charger", "start", "end").agg(F.count("stat").alias("states"))


@query("settle_delay", sql("marked", f""", a as (select m.bike, m.t1 as at, min(n.t0) t0, arg_min(n.dud, n.t0) d from marked m left join marked n on n.bike = m.bike and n.t0 > m.t1 and not n.retry where m.alarm group by 1, 2)
    select bike, "at", case when t0 < {NOW} - interval 7 hours then t0 end next_t0, case when t0 < {NOW} - interval 7 hours then d end next_dud from a"""))
def _(t):
    return V.settled_alarms(filled(t), t.now, t.heavy).select("bike", "at", "next_t0", "next_dud")


@query("stream_hours", sql("trips", """select date_trunc('hour', t0) t, count(*) as "rows" from trips group by 1"""))
def _(t):
    s, _, root = setup(t)
    return W.ledger_of(t.spark, W.hourly_ledger(s.trips, root))


SIG = """concat_ws('|', stat, strftime(start, '%Y%m%d%H%M%S'), strftime("end", '%Y%m%d%H%M%S'))"""


@query("stream_ev_changes", sql("ev_snapshots", f"""select charger, ord, "at" from (select *, lag({SIG}) over w p, row_number() over w rn, {SIG} sig from ev_snapshots
    window w as (partition by charger order by "at", ord)) where rn = 1 or p is distinct from sig"""))
def _(t):
    s, _, root = setup(t)

    def f(c):
        return F.date_format(c, "yyyyMMddHHmmss")
    return W.changes(s.ev_snapshots, S.status_signature("stat", f("start"), f("end")), root).read("changes").select("charger", "ord", "at")


@query("stream_sessions", sql("ev_snapshots", """, a as (select op, "at", case when "at" - lag("at") over (partition by op order by "at") > interval 25 minutes then 1 else 0 end n from ev_snapshots),
    b as (select op, "at", sum(n) over (partition by op order by "at") g from a)
    select op, min("at") start, max("at") "until", count(*) runs from b group by op, g"""))
def _(t):
    s, _, root = setup(t)
    for part in (2, 0, 1):      # three streams into one table, each with runs from everywhere: nothing comes in order
        done = W.collection_sessions(s.ev_snapshots.where(F.col("ord") % 3 == part).select("op", "at"), "op", "at", root, name=f"part-{part}")
    return done.read("segments")


@query("rate_limit", sql("rescue", """, r as (select id, bike, "at", row_number() over (partition by bike order by "at", id) n from rescue where "at" is not null),
    d(bike, n, id, kept, accepted) as (select bike, n, id, ["at"], true from r where n = 1
      union all select r.bike, r.n, r.id, case when len(k) < 3 then list_append(k, r."at") else k end, len(k) < 3
        from d join r on r.bike = d.bike and r.n = d.n + 1, lateral (select list_filter(d.kept, lambda x: x > r."at" - interval 10 minutes) k) l)
    select id, bike, accepted from d""", recursive=True))
def _(t):
    s, _, root = setup(t)
    for part in (1, 2, 0):      # reports from everywhere in each stream: nothing comes in order
        done = W.limit_reports(rescue(s).where(F.col("id") % 3 == part), root, name=f"part-{part}")
    return done.read("reports").select("id", "bike", "accepted")


@query("live_snapshot")
def _(t):
    return V.live_document(filled(t), t.now, t.stations, t.heavy)


@query("step_timings")
def _(t):
    return filled(t).timings_frame()
