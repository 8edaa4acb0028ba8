"""The same chain idea for chargers: sessions from snapshots, collection segments, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..rules import EvRule
from .timeline import Heavy, Timeline, next_known, ordered, previous, running_max, running_sum

# Fixed values of the data-quality test and the collection schedule.
ZERO_MAX, SHORT_MAX = 0.01, 0.10
GAP_MINUTES = 25
OFFLINE = ("1", "4", "5")


def minutes() -> Column:
    return (F.unix_micros("end") - F.unix_micros("start")) / 6e7


def sessions(snapshots: DataFrame) -> DataFrame:
    """Finished charges, one per (charger, start, end)."""
    d = snapshots.where(F.col("start").isNotNull() & (F.col("end") >= F.col("start")))
    return d.select("charger", "start", "end").distinct().withColumn("minutes", minutes())


def mark_ev(sess: DataFrame, rule: EvRule = EvRule(), key: str = "charger", heavy: Heavy | None = None) -> Timeline:
    rows = Timeline(sess.withColumn("dud", F.col("minutes") <= rule.max_min), key, ["start", "end"], heavy)
    rows = rows.add(_p=previous(F.struct("dud", "end")))
    prev = F.coalesce(F.col("_p.dud"), F.lit(False))
    gap = (F.unix_micros("start") - F.unix_micros("_p.end")) / 6e7
    rows = rows.with_columns(retry=prev & F.coalesce(gap < rule.gap_min, F.lit(False)), _new=~prev)
    rows = rows.add(_people=running_sum(F.when(F.col("retry"), 0).otherwise(1)))
    rows = rows.add(_s=running_max(F.when(F.col("_new"), F.col("_people"))))
    rows = rows.with_columns(streak=(F.col("_people") - F.col("_s")).cast("long"))
    rows = rows.with_columns(alarm=F.col("dud") & ~F.col("retry") & (F.col("streak") == rule.alarm_k - 1))
    return rows._copy(rows.df.drop("_p", "_new", "_people", "_s"))


def zombies(sess: DataFrame, now: Column, rule: EvRule = EvRule(), literal: bool = False, heavy: Heavy | None = None) -> DataFrame:
    """Chargers whose last session left an unbroken chain. ``literal`` keeps chargers whose last charge was normal."""
    m = mark_ev(sess, rule, heavy=heavy).done()
    last = m.groupBy("charger").agg(F.max_by(F.struct(*m.columns), F.struct("start", "end")).alias("_r")).select("_r.*")
    if literal:
        chain = F.col("streak") + F.when(F.col("dud") & ~F.col("retry"), 1).otherwise(0)
    else:
        chain = S.chain_after()
    return last.withColumn("chain", chain.cast("long")).where(F.col("chain") >= rule.alarm_k).select(
        "charger", "chain", "end", ((F.unix_micros(now) - F.unix_micros("end")) / 3.6e9).alias("hours_since"))


def changes_only(snapshots: DataFrame, signature: Column, heavy: Heavy | None = None) -> DataFrame:
    """Snapshots whose signature differs from the charger's previous one."""
    rows = Timeline(snapshots.withColumn("sig", signature), "charger", ["at", "ord"], heavy).add(_p=previous(F.struct("sig")))
    return rows.done().where(F.col("_p").isNull() | ~F.col("_p.sig").eqNullSafe(F.col("sig"))).drop("_p")


def run_times(snapshots: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    t = snapshots.select("at")
    if runs is not None:
        t = t.unionByName(runs.select("at"))
    return t.where("at is not null").distinct()


def segments(times: DataFrame, gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Each collection time with the number and start of its unbroken segment (new after more than the gap).

    There is one row per collection run, one every few minutes.
    """
    rows = ordered(times, [], ["at"]).add(_p=previous(F.struct("at")))
    new = F.col("_p.at").isNotNull() & (F.unix_micros("at") - F.unix_micros("_p.at") > gap_minutes * 60_000_000)
    rows = rows.with_columns(_new=new).add(seg=running_sum(F.when(F.col("_new"), 1).otherwise(0)),
                                           seg_start=running_max(F.when(F.col("_new") | F.col("_p").isNull(), F.col("at"))))
    return rows.done().select("at", F.col("seg").cast("long").alias("seg"), "seg_start")


def spans(segs: DataFrame) -> DataFrame:
    return segs.groupBy("seg").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("runs")).withColumn(
        "hours", (F.unix_micros("end") - F.unix_micros("start")) / 3.6e9)


def collection_gaps(times: DataFrame) -> DataFrame:
    """Runs, median and largest gap in minutes, hours covered."""
    rows = ordered(times, [], ["at"]).add(_p=previous(F.struct("at"))).done()
    gap = (F.unix_micros("at") - F.unix_micros("_p.at")) / 6e7
    # gaps are counted by value before the median, so its input is the few distinct gaps
    per = rows.groupBy(gap.alias("g")).agg(F.count("*").alias("c"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    return per.agg(F.sum("c").alias("runs"), F.percentile("g", F.lit(0.5), F.col("c")).alias("median_gap_min"), F.max("g").alias("max_gap_min"),
                   ((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / 3.6e9).alias("hours"))


def segment_sessions(snapshots: DataFrame, segs: DataFrame) -> DataFrame:
    """Sessions by first sighting, ended no earlier than ten minutes before their segment began; chains stay in it."""
    d = snapshots.where("start is not null and end is not null and at is not null")
    d = d.groupBy("charger", "start", "end").agg(F.min_by(F.struct("at", "op"), F.struct("at", "op")).alias("_f")).select(
        "charger", "start", "end", "_f.*")
    d = d.join(segs, "at").where((F.col("end") >= F.col("start")) & (F.unix_micros("end") >= F.unix_micros("seg_start") - 600_000_000))
    d = d.withColumn("minutes", minutes())
    return d.select("charger", F.concat_ws("#", "charger", F.col("seg").cast("string")).alias("key"), "seg", "op", "start", "end", "minutes",
                    (F.col("minutes") == 0).alias("zero"))


def operator_quality(sess: DataFrame, rule: EvRule = EvRule()) -> DataFrame:
    zero = F.count_if("zero") / F.count("*")
    short = F.count_if((F.col("minutes") > 0) & (F.col("minutes") <= rule.max_min)) / F.count("*")
    return sess.groupBy("op").agg(F.count("*").alias("sessions"), F.count_distinct("charger").alias("chargers"), zero.alias("zero"),
                                  short.alias("short"), ((zero < ZERO_MAX) & (short < SHORT_MAX)).alias("clean"))


def persistence(sess: DataFrame, rule: EvRule = EvRule(), ks=(1, 2, 3), heavy: Heavy | None = None) -> DataFrame:
    """After the k-th dud of a chain: is the next session by another person a dud too? With the base rate."""
    d = sess.where(~F.col("zero"))
    rows = mark_ev(d, rule, key="key", heavy=heavy)
    m = rows.add(_n=next_known(F.when(~F.col("retry"), F.struct("dud")))).done()
    known = F.col("dud") & ~F.col("retry") & F.col("_n").isNotNull()
    cells = [F.struct(F.lit(k).cast("long").alias("k"), F.count_if(known & (F.col("streak") == k - 1)).alias("n"),
                      F.count_if(known & (F.col("streak") == k - 1) & F.col("_n.dud")).alias("hits")) for k in ks]
    return m.agg(F.count("*").alias("sessions"), (F.count_if("dud") / F.count("*")).alias("base"), F.array(*cells).alias("c")).select(
        "sessions", "base", F.explode("c").alias("c")).select("sessions", "base", "c.*")


def offline_after(snapshots: DataFrame, sess: DataFrame, rule: EvRule = EvRule(), heavy: Heavy | None = None) -> DataFrame:
    """Chargers with an alarm that later went off line, and the others that ever did."""
    m = mark_ev(sess.where(~F.col("zero")), rule, key="key", heavy=heavy).done()
    first = m.where("alarm").groupBy("charger").agg(F.min("end").alias("first"))
    off = snapshots.where(F.col("stat").isin(*OFFLINE)).groupBy("charger").agg(F.max("at").alias("last_off"))
    d = sess.select("charger").distinct().join(first, "charger", "left").join(off, "charger", "left")
    a = F.col("first").isNotNull()
    return d.agg(F.count_if(a).alias("alarmed"), F.count_if(a & (F.col("last_off") > F.col("first"))).alias("alarmed_off"),
                 F.count_if(~a).alias("others"), F.count_if(~a & F.col("last_off").isNotNull()).alias("others_off"))


