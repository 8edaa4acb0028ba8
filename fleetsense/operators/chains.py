"""Runs of given-up rentals by different people: the core marks and what is read off them.

Every function takes unified rentals (bike, ord, t0, st0, t1, st1, dist_m, who) and orders each bike by
(t0, ord). ``heavy`` comes from ``timeline.find_heavy`` and only changes how the scan is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chain_after, is_dud, micros, seconds_between
from ..rules import Rule
from .timeline import Heavy, Timeline, following, last_known, next_known, previous, running_max, running_sum

ORDER = ["t0", "ord"]


def timeline(df: DataFrame, heavy: Heavy | None = None) -> Timeline:
    return Timeline(df, "bike", ORDER, heavy)


def identity_mode(trips: DataFrame, rule: Rule = Rule()) -> str:
    """Person keys if the table has any, else the gap proxy. Decide on the whole table, never on a subset."""
    if not rule.same_person:
        return "none"
    if trips.where(F.col("who").isNotNull()).limit(1).count():
        return "person"
    return "gap" if rule.retry_gap_sec > 0 else "none"


def mark_timeline(trips: DataFrame, rule: Rule = Rule(), identity: str = "auto",
                  heavy: Heavy | None = None) -> Timeline:
    if identity == "auto":
        identity = identity_mode(trips, rule)
    rows = timeline(trips.withColumn("dud", is_dud(rule)), heavy).add(
        _prev=previous(F.struct("who", "dud", "t1")))
    prev_dud = F.coalesce(F.col("_prev.dud"), F.lit(False))
    retry = {
        "person": F.coalesce(F.col("who") == F.col("_prev.who"), F.lit(False)),
        "gap": prev_dud & F.coalesce(seconds_between("_prev.t1", "t0") < rule.retry_gap_sec, F.lit(False)),
        "none": F.lit(False),
    }[identity]
    rows = rows.with_columns(retry=retry, _new=~prev_dud).add(
        _people=running_sum(F.when(F.col("retry"), 0).otherwise(1)))
    # people counts only grow, so the latest run start is the largest one seen so far
    rows = rows.add(_start=running_max(F.when(F.col("_new"), F.col("_people"))))
    rows = rows.with_columns(streak=(F.col("_people") - F.col("_start")).cast("long"))
    rows = rows.with_columns(alarm=F.col("dud") & ~F.col("retry") & (F.col("streak") == rule.alarm_k - 1))
    return rows._copy(rows.df.drop("_prev", "_new", "_people", "_start"))


def mark(trips: DataFrame, rule: Rule = Rule(), identity: str = "auto", heavy: Heavy | None = None) -> DataFrame:
    """Add dud, retry, streak (different people who gave up just before) and alarm."""
    return mark_timeline(trips, rule, identity, heavy).done()


def mark_on(trips: DataFrame, seeds: DataFrame, rule: Rule = Rule(), identity: str = "person", heavy: Heavy | None = None) -> DataFrame:
    """Marks of rentals whose bikes are marked up to a seed: its last marked rental before them. A bike has one seed or none;
    the result equals marking its whole past. ``newest`` tells the last row of each bike."""
    cols = ["bike", "t0", "ord", "st0", "t1", "st1", "dist_m", "who"]
    d = trips.select(*cols, is_dud(rule).alias("dud"), F.lit(None).cast("long").alias("_seed"))
    d = d.unionByName(seeds.select(*cols, "dud", F.col("streak").alias("_seed")))
    rows = timeline(d, heavy).add(_prev=previous(F.struct("who", "dud", "t1")))
    prev_dud, seed = F.coalesce(F.col("_prev.dud"), F.lit(False)), F.col("_seed").isNotNull()
    retry = {
        "person": F.coalesce(F.col("who") == F.col("_prev.who"), F.lit(False)),
        "gap": prev_dud & F.coalesce(seconds_between("_prev.t1", "t0") < rule.retry_gap_sec, F.lit(False)),
        "none": F.lit(False),
    }[identity]
    rows = rows.with_columns(retry=retry, _new=~prev_dud).add(
        _people=running_sum(F.when(seed, F.col("_seed")).when(F.col("retry"), 0).otherwise(1)))
    rows = rows.add(_start=running_max(F.when(seed, 0).when(F.col("_new"), F.col("_people"))))
    rows = rows.with_columns(streak=(F.col("_people") - F.col("_start")).cast("long"))
    rows = rows.add(_next=following(F.struct("t0")))
    rows = rows.with_columns(alarm=F.col("dud") & ~F.col("retry") & (F.col("streak") == rule.alarm_k - 1), newest=F.col("_next").isNull())
    return rows.where(~seed).done().select(*cols, "dud", "retry", "streak", "alarm", "newest")


def simple_streak(trips: DataFrame, rule: Rule, heavy: Heavy | None = None) -> DataFrame:
    """Given-up rentals in a row without asking who."""
    return mark(trips, rule, "none", heavy)


def mark_window(trips: DataFrame, since, until, bikes: DataFrame | None = None, identity: str = "person",
                rule: Rule = Rule(), heavy: Heavy | None = None) -> DataFrame:
    """Mark only rentals of a time window and, if given, of some bikes. Filters sit below the windows."""
    rows = trips.where(F.col("t0") >= since)
    if until is not None:
        rows = rows.where(F.col("t0") <= until)
    if bikes is not None:
        rows = rows.join(bikes.select("bike").distinct(), "bike", "left_semi")
    return mark(rows, rule, identity, heavy)


def candidates(trips: DataFrame, now, hours: int = 24, rule: Rule = Rule(), heavy: Heavy | None = None) -> DataFrame:
    """Bikes with a dud returned lately whose previous rental is a dud too. Every list entry is among them."""
    rows = timeline(trips.withColumn("dud", is_dud(rule)), heavy).add(_prev=previous(F.col("dud"))).done()
    recent = F.col("t1") >= now - F.expr(f"interval {hours} hours")
    return rows.where(recent & F.col("dud") & F.col("_prev")).select("bike").distinct()


def last_row(marked: DataFrame, *by: str) -> DataFrame:
    """Latest rental per group; partial aggregation, so a heavy group costs one row per map task."""
    row = F.struct(*marked.columns)
    return (marked.groupBy(*by).agg(F.max_by(row, F.struct(*ORDER)).alias("_r")).select("_r.*"))


def first_row(marked: DataFrame, *by: str) -> DataFrame:
    row = F.struct(*marked.columns)
    return (marked.groupBy(*by).agg(F.min_by(row, F.struct(*ORDER)).alias("_r")).select("_r.*"))


def with_next_rider(rows: Timeline) -> Timeline:
    """Dud flag and time of the next row by another person, in row order."""
    return rows.add(_nr=next_known(F.when(~F.col("retry"), F.struct("dud", "t0")))).with_columns(
        next_dud=F.col("_nr.dud"), next_t0=F.col("_nr.t0"))


def with_next_any(rows: Timeline) -> Timeline:
    return rows.add(_na=following(F.struct("dud", "t0", "st0", "who"))).with_columns(
        any_dud=F.col("_na.dud"), any_t0=F.col("_na.t0"), any_st0=F.col("_na.st0"))


def next_rider_after(marked: DataFrame, anchors: DataFrame, at: str, heavy: Heavy | None = None) -> DataFrame:
    """Forward as-of: first rental by another person with t0 strictly after ``at``. Anchors keep their columns."""
    keep = anchors.columns
    events = marked.where(~F.col("retry")).select(
        "bike", F.col("t0").alias("_t"), F.lit(0).alias("_k"), F.col("ord").alias("_o"),
        F.struct("t0", "dud").alias("_v"), F.lit(None).cast(anchors.select(F.struct(*keep)).schema[0].dataType).alias("_a"))
    probes = anchors.select(
        "bike", F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_o"),
        F.lit(None).cast("struct<t0:timestamp,dud:boolean>").alias("_v"), F.struct(*keep).alias("_a"))
    rows = Timeline(events.unionByName(probes), "bike", ["_t", "_k", "_o"], heavy).add(
        _n=next_known(F.col("_v"))).done()
    return rows.where(F.col("_k") == 1).select("_a.*", F.col("_n.t0").alias("next_t0"), F.col("_n.dud").alias("next_dud"))


def next_rider_after_return(marked: DataFrame, which, heavy: Heavy | None = None) -> DataFrame:
    """The as-of above for rows of the table itself: rows with ``which`` true, looked at from their return time.

    Each such row is emitted twice, as an event at t0 and as a probe at t1, so the table is read and moved once.
    """
    both = marked.withColumn("_k", F.explode(F.when(which, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    both = both.withColumn("_t", F.when(F.col("_k") == 0, F.col("t0")).otherwise(F.col("t1")))
    rows = Timeline(both, "bike", ["_t", "_k", "ord"], heavy).add(
        _n=next_known(F.when((F.col("_k") == 0) & ~F.col("retry"), F.struct("t0", "dud")))).done()
    return rows.where(F.col("_k") == 1).withColumns(
        {"next_t0": F.col("_n.t0"), "next_dud": F.col("_n.dud")}).drop("_k", "_t", "_n")


def run_features(rows: Timeline) -> Timeline:
    """Length, retries, span and idle time of the current run of duds; null outside a run."""
    rows = rows.add(_p=previous(F.struct("dud", "t1")), _n=running_sum(F.lit(1)),
                    _rt=running_sum(F.when(F.col("retry") & F.col("dud"), 1).otherwise(0)))
    idle = (micros("t0") - micros("_p.t1")) / 6e7
    start = F.col("dud") & ~F.coalesce(F.col("_p.dud"), F.lit(False))
    first = F.struct(F.col("_n").alias("n"), (F.col("_rt") - F.when(F.col("retry"), 1).otherwise(0)).alias("rt"),
                     F.col("t1").alias("t1"), idle.alias("idle"))
    rows = rows.with_columns(idle_before_min=idle).add(_s=last_known(F.when(start, first), here=True))
    d = F.col("dud")
    return rows.with_columns(
        run_len=F.when(d, F.col("_n") - F.col("_s.n") + 1).otherwise(0).cast("long"),
        run_retries=F.when(d, F.col("_rt") - F.col("_s.rt")).otherwise(0).cast("long"),
        run_span_min=F.when(d, (micros("t1") - micros("_s.t1")) / 6e7),
        idle_before_run_min=F.when(d, F.col("_s.idle")))


def last_normal(rows: Timeline) -> Timeline:
    """Hours since, and minutes of, the latest rental that was not given up (this one included)."""
    rows = rows.add(_ln=last_known(F.when(~F.col("dud"), F.struct("t0", "t1")), here=True))
    return rows.with_columns(last_normal_ago_h=(micros("t1") - micros("_ln.t1")) / 3.6e9,
                             last_normal_dur_min=(micros("_ln.t1") - micros("_ln.t0")) / 6e7)


def history(marked: DataFrame, days: int = 7, heavy: Heavy | None = None) -> Timeline:
    """Rentals, duds and alarms of the bike in the last days, both ends inclusive.

    Each rental enters at t0 and leaves just after t0 + days; the counts are running sums over both, which stays
    linear where a sliding frame would rescan a busy bike. (bike, t0) is unique after the upsert.
    """
    both = marked.withColumn("_leave", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_at", F.timestamp_micros(micros("t0") + F.col("_leave") * (days * 86_400_000_000)))
    sign = F.when(F.col("_leave") == 1, -1).otherwise(1)
    rows = Timeline(both, "bike", ["_at", "_leave", "ord"], heavy, time="_at").add(
        hist_rentals=running_sum(sign),
        hist_duds=running_sum(F.when(F.col("dud"), sign).otherwise(0)),
        hist_alarms=running_sum(F.when(F.col("alarm"), sign).otherwise(0)))
    rows = rows.where(F.col("_leave") == 0)
    return rows._copy(rows.df.withColumns({c: F.col(c).cast("long") for c in ("hist_rentals", "hist_duds", "hist_alarms")}))


def first_rider_of_day(marked: DataFrame, listed: DataFrame) -> DataFrame:
    """First rental by another person on the list day of each listed (day, bike)."""
    day = marked.where(~F.col("retry")).withColumn("day", F.to_date("t0"))
    day = day.join(listed.select("day", "bike").distinct(), ["day", "bike"], "left_semi")
    return first_row(day, "day", "bike")


def before_normal(marked: DataFrame, *by: str, skip_retry: bool = True) -> DataFrame:
    """Given-up rentals of a group before its first normal one: rows earlier than that rental, duds only."""
    rows = marked.where(~F.col("retry")) if skip_retry else marked
    stop = rows.where(~F.col("dud")).groupBy(*by).agg(F.min(F.struct(*ORDER)).alias("_stop"))
    rows = rows.where(F.col("dud")).join(stop, list(by), "left")
    return rows.where(F.col("_stop").isNull() | (F.struct(*ORDER) < F.col("_stop"))).drop("_stop")


def run_last_return(marked: DataFrame, heavy: Heavy | None = None) -> DataFrame:
    """Marked rows with ``run_end``: return time of the last dud of the run the row belongs to."""
    rows = timeline(marked, heavy).add(_n=following(F.struct("dud")))
    rows = rows.with_columns(_last=F.when(F.col("dud") & ~F.coalesce(F.col("_n.dud"), F.lit(False)), F.col("t1")))
    rows = rows.add(_end=next_known(F.col("_last"), here=True)).with_columns(run_end=F.when(F.col("dud"), F.col("_end")))
    return rows._copy(rows.df.drop("_n", "_last", "_end")).done()
