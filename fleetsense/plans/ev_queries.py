"""Chargers, station-level feeds, station noise, identity variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.stats import auc
from ..operators import chains, ev as E, flicker as K, metrics as A, stationnoise as N
from ..operators.temporal import range_count
from ..operators.timeline import saved
from ..rules import Rule
from .oracle import NOW, cte, sql
from .registry import query

cte("evx", ("ev_snapshots",), """select distinct charger, start, "end", (epoch_us("end") - epoch_us(start)) / 6e7 as minutes from ev_snapshots where "end" >= start""")
MARK = """, e1 as (select *, minutes <= 3 dud from {src}),
 e2 as (select *, coalesce(lag(dud) over w, false) pd, coalesce(lag(dud) over w and (epoch_us(start) - epoch_us(lag("end") over w)) / 6e7 < 10, false) retry
   from e1 window w as (partition by {key} order by start, "end")),
 e3 as (select *, sum(case when pd then 0 else 1 end) over (partition by {key} order by start, "end") run from e2),
 e4 as (select *, row_number() over (partition by {key}, run order by start, "end") rn from e3),
 e5 as (select *, cast(sum(case when rn > 1 and not retry then 1 else 0 end) over (partition by {key}, run order by start, "end") as bigint) streak from e4),
 evm as (select *, dud and not retry and streak = 1 alarm from e5)
"""
ALL = MARK.format(src="evx", key="charger")


def heavy(t):
    return t.heavy_of("charger", t.ev_snapshots, "charger", "start")


@query("scan_ev", sql("evs0", """select charger, ord, upper(substring(op, 1, 2)) op, try_strptime(case when ord % 19 = 0 then 'x' else strftime(start, '%Y%m%d%H%M%S') end, '%Y%m%d%H%M%S') start,
    try_strptime(strftime("end", '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S') "end" from evs0"""))
def _(t):
    from ..sources.readers import ev_of
    e = t.ev_snapshots.groupBy("charger", "ord", "op", "start", "end", "stat").agg(F.min("at").alias("at"))
    raw = e.select("ord", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.upper(F.substring("op", 1, 2)).alias("statId"),
                   F.split("charger", "-")[1].alias("chgerId"), "stat", F.date_format("end", "yyyyMMddHHmmss").alias("lastTedt"),
                   F.when(F.col("ord") % 19 == 0, "x").otherwise(F.date_format("start", "yyyyMMddHHmmss")).alias("lastTsdt"), F.lit(None).cast("string").alias("nowTsdt"))
    return ev_of(raw).select("charger", "ord", "op", "start", "end")


@query("ev_sessions", sql("evx", "select * from evx"))
def _(t):
    return E.sessions(t.ev_snapshots)


@query("ev_mark", sql("evx", ALL + """select charger, start, "end", minutes, dud, retry, streak, alarm from evm"""))
def _(t):
    return E.mark_ev(E.sessions(t.ev_snapshots), heavy=heavy(t)).done().select("charger", "start", "end", "minutes", "dud", "retry", "streak", "alarm")


ZOMBIE = ALL + """, l as (select *, row_number() over (partition by charger order by start desc, "end" desc) r from evm)
    select charger, {c} as chain, "end", (epoch_us(""" + NOW + """) - epoch_us("end")) / 3.6e9 hours_since from l where r = 1 and {c} >= 2"""


@query("zombie_chargers", sql("evx", ZOMBIE.format(c="case when dud then streak + 1 else 0 end")))
def _(t):
    return E.zombies(E.sessions(t.ev_snapshots), t.now, heavy=heavy(t))


@query("zombie_chargers_literal", sql("evx", ZOMBIE.format(c="(streak + case when dud and not retry then 1 else 0 end)")))
def _(t):
    return E.zombies(E.sessions(t.ev_snapshots), t.now, literal=True, heavy=heavy(t))


SIG = """concat_ws('|', stat, strftime(start, '%Y%m%d%H%M%S'), strftime("end", '%Y%m%d%H%M%S'))"""


@query("ev_changes_only", sql("ev_snapshots", f"""select charger, ord, "at" from (select *, lag({SIG}) over w p, row_number() over w rn, {SIG} sig from ev_snapshots
    window w as (partition by charger order by "at", ord)) where rn = 1 or p is distinct from sig"""))
def _(t):
    def f(c):
        return F.date_format(c, "yyyyMMddHHmmss")
    return E.changes_only(t.ev_snapshots, S.status_signature("stat", f("start"), f("end")), heavy(t)).select("charger", "ord", "at")


# the adapter sees many chargers, so gaps of 25 minutes are rare there; a shorter gap shows the splitting
GAP = 10
cte("evt", ("ev_snapshots",), """select distinct "at" from ev_snapshots""")
cte("evg", ("evt",), f"""select "at", cast(sum(n) over (order by "at") as bigint) seg from
    (select "at", case when "at" - lag("at") over (order by "at") > interval {GAP} minutes then 1 else 0 end n from evt)""")
cte("evseg", ("evg",), """select "at", seg, min("at") over (partition by seg) seg_start from evg""")


def segs(t):
    return E.segments(E.run_times(t.ev_snapshots), GAP)


@query("run_segments", sql("evseg", """select seg, min("at") start, max("at") "end", count(*) runs, (epoch_us(max("at")) - epoch_us(min("at"))) / 3.6e9 as "hours" from evseg group by 1"""))
def _(t):
    return E.spans(segs(t))


cte("evss", ("ev_snapshots", "evseg"), """select charger, charger || '#' || cast(seg as varchar) as "key", seg, op, start, "end", (epoch_us("end") - epoch_us(start)) / 6e7 as minutes,
    "end" = start zero from (select charger, start, "end", min("at") as "at", arg_min(op, ("at", op)) op from ev_snapshots group by 1, 2, 3) join evseg using ("at")
    where "end" >= start and "end" >= seg_start - interval 10 minutes""")


def seg_sessions(t):
    return E.segment_sessions(t.ev_snapshots, segs(t))


@query("segment_sessions", sql("evss", "select * from evss"))
def _(t):
    return seg_sessions(t)


cte("evq", ("evss",), """select op, count(*) sessions, count(distinct charger) chargers, cast(count(*) filter (where zero) as double) / count(*) zero,
    cast(count(*) filter (where minutes > 0 and minutes <= 3) as double) / count(*) short,
    cast(count(*) filter (where zero) as double) / count(*) < 0.01::double and cast(count(*) filter (where minutes > 0 and minutes <= 3) as double) / count(*) < 0.1::double clean from evss group by 1""")


@query("operator_quality", sql("evq", "select * from evq"))
def _(t):
    return E.operator_quality(seg_sessions(t))


SEGM = MARK.format(src='(select * from evss where not zero and op in (select op from evq where clean))', key='"key"')


def clean_sessions(t):
    s = saved(seg_sessions(t))
    good = E.operator_quality(s).where("clean").select("op")
    return s.join(good, "op", "left_semi")


@query("ev_persistence", sql("evq", SEGM + """, n as (select *, first_value(case when retry then null else dud end ignore nulls) over (partition by "key" order by start, "end" rows between 1 following and unbounded following) nd from evm),
    b as (select count(*) sessions, cast(count(*) filter (where dud) as double) / count(*) base from evm)
    select sessions, base, cast(kk as bigint) k, count(*) filter (where dud and not retry and streak = kk - 1 and nd is not null) n,
      count(*) filter (where dud and not retry and streak = kk - 1 and nd) hits from n, b, (values (1), (2), (3)) v(kk) group by 1, 2, 3"""))
def _(t):
    return E.persistence(clean_sessions(t), heavy=heavy(t) and t.heavy_of("evkey", seg_sessions(t), "key", "start"))


@query("alarm_offline", sql("evq ev_snapshots", SEGM + """, f as (select charger, min("end") first from evm where alarm group by 1),
    o as (select charger, max("at") last_off from ev_snapshots where stat in ('1', '4', '5') group by 1),
    d as (select distinct charger from evss where op in (select op from evq where clean))
    select count(first) alarmed, count(*) filter (where last_off > first) alarmed_off, count(*) filter (where first is null) others,
      count(*) filter (where first is null and last_off is not null) others_off from d left join f using (charger) left join o using (charger)"""))
def _(t):
    return E.offline_after(t.ev_snapshots, clean_sessions(t), heavy=heavy(t) and t.heavy_of("evkey", seg_sessions(t), "key", "start"))


@query("collection_gaps", sql("evt", """select count(*) runs, median(g) median_gap_min, max(g) max_gap_min, (epoch_us(max("at")) - epoch_us(min("at"))) / 3.6e9 as "hours" from
    (select "at", (epoch_us("at") - epoch_us(lag("at") over (order by "at"))) / 6e7 g from evt)"""))
def _(t):
    return E.collection_gaps(E.run_times(t.ev_snapshots))


# ---- station-level feed

def flick(step: int, src: str = "marked") -> str:
    return f""", fe as (select st0 st, epoch_us(t0) // ({step} * 1000000) b, -1 d from {src} union all select st1, epoch_us(t1) // ({step} * 1000000), 1 from {src}),
 fn as (select st, b, sum(d) d from fe group by 1, 2 having sum(d) <> 0),
 fl as (select st, b b0, nb b1 from (select *, lead(b) over w nb, lead(d) over w nd from fn window w as (partition by st order by b)) where d = -1 and nd = 1 and nb - b between 1 and {-(-180 // step) + 1}),
 du as (select st0 st, epoch_us(t0) // ({step} * 1000000) b0, epoch_us(t1) // ({step} * 1000000) b1 from {src} where dud),
 sa as (select st, b1 b from (select *, lag(b1) over (partition by st order by b1) p from fl) where (b1 - p) * {step} <= 10800),
 ta as (select st1 st, epoch_us(t1) // ({step} * 1000000) b from {src} where alarm),
 fc as (select (select count(*) from du) duds, (select count(*) from fl) flickers, (select count(*) from (select distinct * from du intersect select * from fl)) hits,
   (select count(*) from ta) true_alarms, (select count(*) from sa) station_alarms,
   (select count(*) from (select distinct * from ta) x where exists (select 1 from sa where sa.st = x.st and sa.b between x.b - 1 and x.b + 1)) r,
   (select count(*) from (select distinct * from sa) x where exists (select 1 from ta where ta.st = x.st and ta.b between x.b - 1 and x.b + 1)) p)
select cast({step} as bigint) step, duds, flickers, cast(100 as double) * hits / nullif(duds, 0) dud_recall_pct, cast(100 as double) * hits / nullif(flickers, 0) flicker_precision_pct, true_alarms, station_alarms,
  cast(100 as double) * r / nullif(true_alarms, 0) alarm_recall_pct, cast(100 as double) * p / nullif(station_alarms, 0) alarm_precision_pct"""


@query("flicker_match", sql("marked", flick(60) + " from fc"))
def _(t):
    return K.match(t.trips, t.marked, 60, heavy=t.heavy_station)


@query("flicker_match_30", sql("marked", flick(30) + " from fc"))
def _(t):
    return K.match(t.trips, t.marked, 30, heavy=t.heavy_station)


@query("flicker_match_120", sql("marked", flick(120) + " from fc"))
def _(t):
    return K.match(t.trips, t.marked, 120, heavy=t.heavy_station)


TIERS = """, tr as (select st0 st, cast(count(*) as double) / (select count(distinct cast(t0 as date)) from trips) per_day from trips group by 1),
  ti as (select *, case when per_day < 20 then 'quiet' when per_day < 60 then 'normal' else 'busy' end tier from tr)"""


@query("traffic_tiers", sql("trips", TIERS + " select * from ti"))
def _(t):
    return K.traffic_tiers(t.trips)


TIER_NAMES = ("quiet", "normal", "busy")
BY_TIER = " union all ".join(
    f"select * from (with src as (select m.* from marked m where st0 in (select st from ti where tier = '{x}') or st1 in (select st from ti where tier = '{x}'))"
    + flick(60, "src") + f", '{x}' tier, (select count(*) from ti where tier = '{x}') stations from fc)" for x in TIER_NAMES)


@query("flicker_by_tier", sql("marked", TIERS + BY_TIER))
def _(t):
    tiers = saved(K.traffic_tiers(t.trips))
    return reduce(DataFrame.unionByName, [K.match_by_tier(t.trips, t.marked, tiers, x, 60, heavy=t.heavy_station) for x in TIER_NAMES])


# ---- station noise

NOISE = """, nz as (select a.bike, a.ord, a.t1, a.st1, a.alarm, count(distinct b.bike) others from marked a left join marked b on b.dud and b.st1 = a.st1 and b.bike <> a.bike
    and b.t1 >= a.t1 - interval 60 minutes and (b.t1, b.bike, b.ord) < (a.t1, a.bike, a.ord) where a.dud group by 1, 2, 3, 4, 5)"""


@query("station_noise", sql("marked", NOISE + "select bike, ord, others from nz"))
def _(t):
    return N.distinct_before(t.marked.where("dud"), t.heavy_station, t.heavy).select("bike", "ord", "others")


@query("station_noise_alarms", sql("marked", NOISE + """, nr as (select bike, ord, first_value(case when retry then null else dud end ignore nulls) over (partition by bike order by t0, ord rows between 1 following and unbounded following) nd from marked)
    select case when others >= 3 then '3+' else cast(others as varchar) end noise, count(*) alarms, cast(100 as double) * count(*) filter (where nd) / count(*) next_dud_pct
    from nz join nr using (bike, ord) where alarm and nd is not null group by 1"""))
def _(t):
    near = N.distinct_before(t.marked.where("dud"), t.heavy_station, t.heavy).select("bike", "ord", "others")
    a = chains.with_next_rider(t.marked_rows).done().where(F.col("alarm") & F.col("next_dud").isNotNull()).select("bike", "ord", "next_dud")
    d = a.join(near, ["bike", "ord"])
    return d.groupBy(F.when(F.col("others") >= 3, "3+").otherwise(F.col("others").cast("string")).alias("noise")).agg(
        F.count(F.lit(1)).alias("alarms"), S.percent(F.count_if("next_dud"), F.count(F.lit(1))).alias("next_dud_pct"))


@query("station_alarm", sql("marked", NOISE + """, ks as (select cast(v as bigint) k from (values (2), (3), (4)) x(v)),
    fr as (select distinct k, st1, t1 from nz, ks where others + 1 >= k),
    kp as (select k, st1, min(t1) t1 from fr group by 1, 2 union all
      select k.k, k.st1, (select min(f.t1) from fr f where f.k = k.k and f.st1 = k.st1 and f.t1 > k.t1 + interval 60 minutes) from kp k
      where exists (select 1 from fr f where f.k = k.k and f.st1 = k.st1 and f.t1 > k.t1 + interval 60 minutes)),
    ow as (select st0, cast(count(*) filter (where dud) as double) / count(*) own from marked group by 1),
    hx as (select k.k, k.st1, k.t1, count(m.bike) n, count(m.bike) filter (where m.dud) h from kp k left join marked m on m.st0 = k.st1 and m.t0 > k.t1 and m.t0 <= k.t1 + interval 60 minutes group by 1, 2, 3)
    select ks.k, count(hx.t1) alarms, cast(sum(n) as bigint) rentals, cast(sum(h) as bigint) duds, round(sum(n * coalesce(own, 0)), 6) expected
    from ks left join hx on hx.k = ks.k left join ow on ow.st0 = hx.st1 group by 1""", recursive=True))
def _(t):
    return N.station_alarms(t.marked, (2, 3, 4), t.heavy_station, t.heavy).withColumn("expected", F.round("expected", 6))


# ---- identity variants

VARIANT = """, {n}a as (select *, {retry} retry, coalesce(lag(dud) over w, false) pd from duds window w as (partition by bike order by t0, ord)),
 {n}b as (select *, sum(case when pd then 0 else 1 end) over (partition by bike order by t0, ord) run from {n}a),
 {n}c as (select *, row_number() over (partition by bike, run order by t0, ord) rn from {n}b),
 {n} as (select bike, ord, t0, dud, retry, cast(sum(case when rn > 1 and not retry then 1 else 0 end) over (partition by bike, run order by t0, ord) as bigint) streak from {n}c)"""
SECS = (30, 60, 120, 300, 600)
VSQL = (VARIANT.format(n="vnone", retry="false")
        + "".join(VARIANT.format(n=f"v{g}", retry=f"coalesce(lag(dud) over w and t0 - lag(t1) over w < interval {g} seconds, false)") for g in SECS))
VROWS = " union all ".join(
    f"""select '{n}' variant, cast(100 as double) * count(*) filter (where not m.retry and v.streak >= 2 and v.dud) / nullif(count(*) filter (where not m.retry and v.streak >= 2), 0) precision_pct,
    cast(count(*) filter (where v.dud and not v.retry and v.streak = 1) as double) / count(distinct cast(v.t0 as date)) alarms_per_day,
    cast(count(*) filter (where not m.retry and v.streak >= 2 and v.dud) as double) / count(distinct cast(v.t0 as date)) prevented_per_day from {src} v join marked m using (bike, ord)"""
    for n, src in [("who", "marked"), ("none", "vnone")] + [(f"gap {g}", f"v{g}") for g in SECS])


def variants(t) -> DataFrame:
    choices = [("who", Rule(), "person"), ("none", Rule(), "none")] + [(f"gap {g}", Rule(retry_gap_sec=g), "gap") for g in SECS]
    out = []
    for name, rule, mode in choices:
        # the judge is the true person key; it is one lag on the same ordered rows, so no join is needed
        rows = chains.mark_timeline(t.trips, rule, mode, t.heavy)
        m = rows.add(_w=chains.previous(F.struct("who"))).done()
        truth = F.coalesce(F.col("who") == F.col("_w.who"), F.lit(False))
        after, days = ~truth & (F.col("streak") >= 2), F.count_distinct(F.to_date("t0"))
        out.append(m.agg(F.lit(name).alias("variant"), S.percent(F.count_if(after & F.col("dud")), F.count_if(after)).alias("precision_pct"),
                         (F.count_if("alarm") / days).alias("alarms_per_day"), (F.count_if(after & F.col("dud")) / days).alias("prevented_per_day")))
    return reduce(DataFrame.unionByName, out)


@query("identity_variants", sql("marked", VSQL + VROWS))
def _(t):
    return variants(t)


@query("identity_gap", sql("marked", VSQL + ", vr as (" + VROWS + """), ok as (select *, cast(substring(variant, 5) as int) g from vr
      where variant like 'gap %' and precision_pct >= (select precision_pct from vr where variant = 'who') - 0.5::double)
    select variant, precision_pct, alarms_per_day, prevented_per_day from ok order by prevented_per_day desc, g limit 1"""))
def _(t):
    return A.choose_gap(saved(variants(t)))


# ---- fault kind from the shape of the duds before it

FK = """, sp as (select min(t0) lo, max(t0) hi from marked),
 fk as (select f.bike, f.t, f.kind = 'k1' terminal, count(*) n_dud, cast(count(*) filter (where m.t1 - m.t0 < interval 30 seconds and m.dist_m < 50) as double) / count(*) fast
   from sp, faults f join marked m on m.dud and m.bike = f.bike and m.t1 < f.t and m.t1 >= f.t - interval 24 hours where f.t between sp.lo and sp.hi group by 1, 2, 3)"""


def fault_kinds(t):
    span = t.trips.agg(F.min("t0").alias("lo"), F.max("t0").alias("hi"))
    f = t.faults.where((F.col("t") >= span.select("lo").scalar()) & (F.col("t") <= span.select("hi").scalar()))
    f = f.withColumns({"_lo": S.shift_seconds("t", -86400), "_id": F.struct("bike", "t")})
    duds = t.marked.where("dud").select("bike", "t0", "t1", "dist_m")
    fast = ((S.seconds_between("t0", "t1") < 30) & (F.col("dist_m") < 50)).cast("int")
    d = range_count(duds, f, "bike", "t1", "bike", "_lo", "t", "n_dud", lo_open=False, hi_open=True, heavy=t.heavy)
    d = d.withColumn("_id", F.struct("bike", "t"))
    d = range_count(duds, d, "bike", "t1", "bike", "_lo", "t", "n_fast", lo_open=False, hi_open=True, weight=fast, heavy=t.heavy)
    return d.where("n_dud > 0").select("bike", "t", (F.col("kind") == "k1").alias("terminal"), "n_dud", (F.col("n_fast") / F.col("n_dud")).alias("fast"))


@query("fault_kind_label", sql("marked faults", FK + """, fm as (select least_duds, fk.* from fk, (select cast(v as bigint) least_duds from (values (1), (2), (3)) x(v)) where n_dud >= least_duds),
    g as (select least_duds, fast, count(*) filter (where terminal) p, count(*) filter (where not terminal) q from fm group by 1, 2),
    a as (select least_duds, sum(p * (below + q / 2.0)) / nullif(sum(p) * sum(q), 0) auc from
      (select *, coalesce(sum(q) over (partition by least_duds order by fast rows between unbounded preceding and 1 preceding), 0) below from g) group by 1)
    select least_duds, count(*) faults, cast(100 as double) * count(*) filter (where terminal) / count(*) terminal_pct, cast(100 as double) * count(*) filter (where fast = 1 and terminal) / nullif(count(*) filter (where fast = 1), 0) precision_pct,
      cast(100 as double) * count(*) filter (where fast = 1 and terminal) / nullif(count(*) filter (where terminal), 0) recall_pct, round(cast(max(auc) as double), 9) auc from fm join a using (least_duds) group by 1"""))
def _(t):
    d = saved(fault_kinds(t))
    term, all_fast, n = F.count_if("terminal"), F.col("fast") == 1, F.count(F.lit(1))
    hit = F.count_if(all_fast & F.col("terminal"))

    def row(least: int) -> DataFrame:
        some = d.where(F.col("n_dud") >= least)
        a = auc(some, F.col("fast"), F.col("terminal")).select("auc").scalar()
        return some.agg(F.lit(least).cast("long").alias("least_duds"), n.alias("faults"), S.percent(term, n).alias("terminal_pct"),
                        S.percent(hit, F.count_if(all_fast)).alias("precision_pct"), S.percent(hit, term).alias("recall_pct"), F.round(F.max(a), 9).alias("auc"))

    return reduce(DataFrame.unionByName, [row(k) for k in (1, 2, 3)]).where("faults > 0")
