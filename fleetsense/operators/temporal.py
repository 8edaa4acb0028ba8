"""As-of and range-count joins as one ordered scan over the union of both sides.

No pair of rows is ever formed, so a busy asset or station costs n log n instead of n squared, and the scan
splits heavy keys like every other timeline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import micros
from .timeline import Heavy, Timeline, last_known, next_known, running_sum


def _stack(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, value: Column, left_rank: int) -> DataFrame:
    """Both sides as (key, _t, _k, _l, _v); left rows keep all columns in _l."""
    lrow = F.struct(*left.columns)
    ltype = left.select(lrow.alias("x")).schema[0].dataType
    vtype = right.select(value.alias("x")).schema[0].dataType
    a = left.select(F.col(key).alias("_key"), F.col(lt).alias("_t"), F.lit(left_rank).alias("_k"),
                    lrow.alias("_l"), F.lit(None).cast(vtype).alias("_v"))
    b = right.select(F.col(key).alias("_key"), F.col(rt).alias("_t"), F.lit(1).alias("_k"),
                     F.lit(None).cast(ltype).alias("_l"), value.alias("_v"))
    return a.unionByName(b)


def asof(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, value: Column, name: str,
         direction: str = "backward", allow_equal: bool = True, heavy: Heavy | None = None) -> DataFrame:
    """Left rows plus the nearest right ``value`` (must be non-null, use a struct) before or after their time."""
    back = direction == "backward"
    # where the left row stands among right rows of the same instant decides whether equality counts
    rank = 2 if back == allow_equal else 0
    scan = (last_known if back else next_known)(F.col("_v"))
    rows = Timeline(_stack(left, right, key, lt, rt, value, rank), "_key", ["_t", "_k"], heavy).add(_m=scan).done()
    return rows.where(F.col("_l").isNotNull()).select("_l.*", F.col("_m").alias(name))


def range_count(starts: DataFrame, probes: DataFrame, key: str, time: str, probe_key: str, lo: str, hi: str,
                name: str, lo_open: bool = True, hi_open: bool = True, weight: Column | None = None,
                heavy: Heavy | None = None) -> DataFrame:
    """Probe rows plus the count (or weight sum) of starts of their key between lo and hi. Needs ``_id`` on probes."""
    prow = F.struct(*probes.columns)
    ptype = probes.select(prow.alias("x")).schema[0].dataType
    ends = probes.select(
        F.col(probe_key).alias("_key"), prow.alias("_p"),
        F.explode(F.array(F.struct(F.col(lo).alias("t"), F.lit(2 if lo_open else 0).alias("k"), F.lit(-1).alias("s")),
                          F.struct(F.col(hi).alias("t"), F.lit(0 if hi_open else 2).alias("k"), F.lit(1).alias("s")))).alias("_e"),
    ).select("_key", "_p", F.col("_e.t").alias("_t"), F.col("_e.k").alias("_k"), F.col("_e.s").alias("_s"),
             F.lit(0).cast("long").alias("_w"))
    events = starts.select(
        F.col(key).alias("_key"), F.lit(None).cast(ptype).alias("_p"), F.col(time).alias("_t"),
        F.lit(1).alias("_k"), F.lit(0).alias("_s"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    rows = Timeline(events.unionByName(ends), "_key", ["_t", "_k"], heavy).add(_c=running_sum(F.col("_w"))).done()
    # the two ends of a probe meet again by id; map-side sums keep this to one small row per end
    return (rows.where(F.col("_p").isNotNull()).groupBy(F.col("_p._id").alias("_id"))
            .agg(F.first("_p").alias("_p"), F.sum(F.col("_s") * F.col("_c")).alias("_n"))
            .select("_p.*", F.col("_n").cast("long").alias(name)).drop("_id"))


def faults_after(rows: DataFrame, faults: DataFrame, wait_min: int, name: str = "fault",
                 heavy: Heavy | None = None) -> DataFrame:
    """Next fault of the bike at or after return + wait, as struct(t, kind)."""
    rows = rows.withColumn("_after", F.timestamp_micros(micros("t1") + wait_min * 60_000_000))
    return asof(rows, faults, "bike", "_after", "t", F.struct("t", "kind"), name, "forward", True, heavy).drop("_after")


def within_hours(later: Column, earlier: Column, hours: float) -> Column:
    return F.coalesce(micros(later) - micros(earlier) <= int(hours * 3_600_000_000), F.lit(False))


def lead_times(marked: DataFrame, faults: DataFrame, days: int = 7, heavy: Heavy | None = None,
               span: DataFrame | None = None) -> DataFrame:
    """Per fault inside the data's own time span: first alarm in the open week before it, duds in between.

    ``marked`` may hold the duds only if ``span`` gives all rentals for the time span.

    One scan per bike over four kinds of events: dud starts (counted), alarms (carrying the count so far), and for
    each fault a look from a week earlier (next alarm) and one from its own time (count so far).
    """
    day = 86_400_000_000
    trip = F.col("dud").cast("int")
    kinds = F.array(
        F.struct(F.col("t0").alias("_t"), F.lit(2).alias("_k"), trip.alias("_w"), F.lit(False).alias("_a")),
        F.struct(F.col("t1").alias("_t"), F.lit(4).alias("_k"), F.lit(0).alias("_w"), F.lit(True).alias("_a")))
    ev = marked.where("dud").select("bike", F.explode(F.when(F.col("alarm"), kinds).otherwise(F.slice(kinds, 1, 1))).alias("e"))
    ev = ev.select("bike", "e.*").withColumns({"_f": F.lit(None).cast("timestamp"), "kind": F.lit(None).cast("string")})
    span = (marked if span is None else span).agg(F.min("t0").alias("lo"), F.max("t0").alias("hi"))
    f = faults.where((F.col("t") >= span.select("lo").scalar()) & (F.col("t") <= span.select("hi").scalar()))
    # equal times: a look back a week stands after alarms of that instant, a look from the fault before duds and alarms
    looks = F.array(F.struct(F.timestamp_micros(micros("t") - days * day).alias("_t"), F.lit(5).alias("_k")),
                    F.struct(F.col("t").alias("_t"), F.lit(1).alias("_k")))
    pr = f.select("bike", F.explode(looks).alias("e"), F.col("t").alias("_f"), "kind").select(
        "bike", "e.*", F.lit(0).alias("_w"), F.lit(False).alias("_a"), "_f", "kind")
    rows = Timeline(ev.unionByName(pr), "bike", ["_t", "_k"], heavy).add(_c=running_sum(F.col("_w")))
    rows = rows.add(_n=next_known(F.when(F.col("_a"), F.struct(F.col("_t").alias("at"), F.col("_c").alias("c"))))).done()
    g = rows.where(F.col("_f").isNotNull()).groupBy("bike", F.col("_f").alias("t")).agg(
        F.max("kind").alias("kind"), F.max(F.when(F.col("_k") == 5, F.col("_n"))).alias("_n"),
        F.max(F.when(F.col("_k") == 1, F.col("_c"))).alias("_c"))
    hit = F.col("_n.at") < F.col("t")
    return g.select("bike", "t", "kind", F.when(hit, F.col("_n.at")).alias("alarm_at"),
                    F.when(hit, F.col("_c") - F.col("_n.c")).cast("long").alias("duds_between"),
                    F.when(hit, (micros("t") - micros("_n.at")) / 3.6e9).alias("lead_h"))
