"""Aggregated answers: persistence of chains, prevention, busy stations, scores of lists and alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FINE, chain_after, is_dud, percent, seconds_between
from ..functions.stats import quantiles
from ..rules import Rule
from . import chains
from .temporal import asof, faults_after, range_count, within_hours
from .timeline import Heavy, Timeline, previous, running_max, running_sum, saved



def next_dud_table(marked: DataFrame, max_k: int = 4) -> DataFrame:
    """Chain length k just before a rental by another person, and how often that person gave up too."""
    rows = marked.where(~F.col("retry") & F.col("streak").between(0, max_k))
    return rows.groupBy(F.col("streak").alias("k")).agg(
        F.count("*").alias("n"), percent(F.count_if("dud"), F.count("*")).alias("next_dud_pct"))


def prevented(marked: DataFrame, rule: Rule = Rule()) -> DataFrame:
    after = ~F.col("retry") & (F.col("streak") >= rule.alarm_k)
    days = F.greatest(F.count_distinct(F.to_date("t0")), F.lit(1))
    return marked.agg(F.count_if(after).alias("after_alarm_rentals"), F.count_if(after & F.col("dud")).alias("prevented"),
                      (F.count_if(after & F.col("dud")) / days).alias("per_day"))


def rule_grid(trips: DataFrame, seconds=(60, 120, 180), metres=(100, 200, 300), ks=(2, 3),
              heavy: Heavy | None = None) -> DataFrame:
    """All rule variants in one pass: one shuffle and one sort by bike, one column set per variant."""
    variants = [(s, m) for s in seconds for m in metres]
    duds = {f"_d{i}": is_dud(Rule(max_sec=s, max_m=m)) for i, (s, m) in enumerate(variants)}
    names = list(duds)
    rows = chains.timeline(trips.select("bike", "ord", "t0", "t1", "st0", "st1", "dist_m", "who").withColumns(duds), heavy)
    rows = rows.add(_p=previous(F.struct("who", *names)))
    rows = rows.with_columns(_retry=F.coalesce(F.col("who") == F.col("_p.who"), F.lit(False)))
    rows = rows.add(_people=running_sum(F.when(F.col("_retry"), 0).otherwise(1)))
    start = {f"_s{i}": running_max(F.when(~F.coalesce(F.col(f"_p._d{i}"), F.lit(False)), F.col("_people")))
             for i in range(len(variants))}
    df = rows.add(**start).done()
    aggs = [F.count_distinct(F.to_date("t0")).alias("days")]
    other = ~F.col("_retry")
    for i in range(len(variants)):
        streak = F.col("_people") - F.col(f"_s{i}")
        d = F.col(f"_d{i}")
        aggs += [F.count_if(other & (streak == 0)).alias(f"b{i}"), F.count_if(other & (streak == 0) & d).alias(f"bd{i}")]
        for k in ks:
            aggs += [F.count_if(other & (streak >= k)).alias(f"n{i}_{k}"),
                     F.count_if(other & (streak >= k) & d).alias(f"h{i}_{k}"),
                     F.count_if(d & other & (streak == k - 1)).alias(f"a{i}_{k}")]
    one = df.agg(*aggs)
    cells = [F.struct(F.lit(s).cast("long").alias("sec"), F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k"),
                      percent(F.col(f"h{i}_{k}"), F.col(f"n{i}_{k}")).alias("precision_pct"),
                      percent(F.col(f"bd{i}"), F.col(f"b{i}")).alias("base_pct"),
                      (F.col(f"h{i}_{k}") / F.col("days")).alias("prevented_per_day"),
                      (F.col(f"a{i}_{k}") / F.col("days")).alias("alarms_per_day"))
             for i, (s, m) in enumerate(variants) for k in ks]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def choose_rule(grid: DataFrame, min_precision: float = 30.0) -> DataFrame:
    best = grid.where(F.col("precision_pct") >= min_precision).agg(
        F.max_by(F.struct(*grid.columns), F.struct("prevented_per_day", (-F.col("sec")).alias("a"), (-F.col("m")).alias("b"),
                                                   (-F.col("k")).alias("c"))).alias("r"))
    return best.where("r is not null").select("r.*")


HOURS = [f"h{h}" for h in range(24)]


def hourly(df: DataFrame, *by: str) -> DataFrame:
    """24 hourly counts as columns; one aggregation with a fixed pivot."""
    return df.groupBy(*by).agg(*[F.count_if(F.hour("t0") == h).alias(c) for h, c in enumerate(HOURS)])


def station_busy(trips: DataFrame, end: Column, days: int = 7) -> DataFrame:
    """Rentals per day present and hourly counts per start station, over the days before ``end``."""
    rows = trips.where((F.col("t0") >= end - F.expr(f"interval {days} days")) & (F.col("t0") < end))
    n = rows.agg(F.greatest(F.count_distinct(F.to_date("t0")), F.lit(1)).alias("n")).scalar()
    total = sum((F.col(c) for c in HOURS[1:]), F.col(HOURS[0]))
    return hourly(rows, "st0").select(F.col("st0").alias("station"), (total / n).alias("avg"), *HOURS)


def station_profile(trips: DataFrame, days: int = 7) -> DataFrame:
    """Per (station, day): hourly counts of the seven days before, smoothed by half a rental, and their daily mean.

    Rentals are counted per (station, day) first; those few rows are then handed to each of the next seven days.
    """
    counts = hourly(trips.withColumn("_d", F.to_date("t0")), "st0", "_d")
    spread = counts.withColumn("day", F.explode(F.sequence(F.date_add("_d", 1), F.date_add("_d", days))))
    sums = spread.groupBy(F.col("st0").alias("station"), "day").agg(*[F.sum(c).alias(c) for c in HOURS])
    smooth = [(F.col(c) + 0.5).alias(c) for c in HOURS]
    total = sum((F.col(c) + 0.5 for c in HOURS[1:]), F.col(HOURS[0]) + 0.5)
    return sums.select("station", "day", (total / days).alias("avg"), *smooth)


def hotspots(marked: DataFrame) -> DataFrame:
    """Alarms and rentals per station, with the running share of alarms from the worst station down.

    The window runs over one row per station, a number bounded by the station table.
    """
    a = marked.where("alarm").groupBy(F.col("st0").alias("station")).agg(F.count("*").alias("alarms"))
    r = marked.groupBy(F.col("st0").alias("station")).agg(F.count("*").alias("rentals"))
    w = Window.orderBy(F.desc("alarms"), "station")
    d = a.join(r, "station")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d.select("station", "alarms", "rentals",
                    (F.sum("alarms").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("alarms").over(every)).alias("cum_share"))


def hotspot_share(spots: DataFrame, stations: Column) -> DataFrame:
    """How many stations hold a quarter and a half of all alarms."""
    n = {q: F.count_if(F.col("cum_share") < q) + 1 for q in (0.25, 0.5)}
    return spots.agg(n[0.25].alias("n25"), n[0.5].alias("n50"), (100.0 * n[0.25] / stations).alias("pct25"),
                     (100.0 * n[0.5] / stations).alias("pct50"))


def fault_kind_profile(marked: DataFrame, faults: DataFrame, hours: int = 24, min_n: int = 100,
                       heavy: Heavy | None = None) -> DataFrame:
    """Shape of duds by the kind of the fault report that follows within the given hours."""
    d = marked.where("dud").select("bike", "ord", "t0", "t1", "dist_m")
    d = asof(d, faults, "bike", "t1", "t", F.struct("t", "kind"), "f", "forward", False, heavy)
    d = d.where(within_hours(F.col("f.t"), F.col("t1"), hours)).select(
        F.col("f.kind").alias("kind"), seconds_between("t0", "t1").alias("sec"), "dist_m")
    d = saved(d)
    g = d.groupBy("kind").agg(F.count("*").alias("n"), percent(F.count_if(F.col("sec") < 30), F.count("*")).alias("under_30s_pct"),
                              percent(F.count_if(F.col("dist_m") >= 50), F.count("*")).alias("moved_50m_pct")).where(F.col("n") >= min_n)
    sec = quantiles(d, F.col("sec"), [0.5], ["sec_median"], ("kind",))
    met = quantiles(d, F.col("dist_m"), [0.5], ["m_median"], ("kind",))
    return g.join(sec, "kind").join(met, "kind")


def fault_rate(marked: DataFrame, faults: DataFrame, hours: int = 24, wait_min: int = 10,
               heavy: Heavy | None = None) -> DataFrame:
    """Share of rentals followed by a fault report, after duds and after normal rentals, and the lift."""
    d = faults_after(marked.select("bike", "t1", "dud"), faults, wait_min, "f", heavy)
    hit = within_hours(F.col("f.t"), F.timestamp_micros(F.unix_micros("t1") + wait_min * 60_000_000), hours)
    a = percent(F.count_if(F.col("dud") & hit), F.count_if("dud"))
    b = percent(F.count_if(~F.col("dud") & hit), F.count_if(~F.col("dud")))
    return d.agg(F.count_if("dud").alias("duds"), F.count_if(~F.col("dud")).alias("normal"), a.alias("after_dud_pct"),
                 b.alias("after_normal_pct"), F.when(b > 0, a / b).alias("lift"))


def warning_rules(marked: DataFrame, faults: DataFrame, since: Column, heavy: Heavy | None = None) -> DataFrame:
    """Precision, lift and recall of one, two or three duds in a row as a warning of a fault within 24 h."""
    d = faults_after(marked.where(F.col("t1") >= since).select("bike", "t1", "dud", "streak"), faults, 10, "f", heavy)
    d = d.withColumn("hit", within_hours(F.col("f.t"), F.timestamp_micros(F.unix_micros("t1") + 600_000_000), 24))
    base = F.count_if("hit") / F.count("*")
    cells = []
    for k in (1, 2, 3):
        on = F.col("dud") & (F.col("streak") >= k - 1)
        prec = F.when(F.count_if(on) > 0, F.count_if(on & F.col("hit")) / F.count_if(on))
        cells.append(F.struct(F.lit(k).cast("long").alias("duds_in_row"), F.count_if(on).alias("warnings"),
                              (100 * prec).alias("precision_pct"), F.when(base > 0, prec / base).alias("lift"),
                              percent(F.count_if(on & F.col("hit")), F.count_if("hit")).alias("recall_pct")))
    return d.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def checked_counts(rescue: DataFrame, survey: DataFrame) -> DataFrame:
    """Human verdicts per bike from both kinds of reports."""
    both = rescue.select("bike", "verdict").unionByName(survey.select("bike", F.col("status").alias("verdict")))
    return both.groupBy("bike", "verdict").agg(F.count("*").alias("n"))


def checked_summary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("bike").agg(F.sum("n").alias("total"),
                                      F.sum(F.when(F.col("verdict") == FINE, 0).otherwise(F.col("n"))).alias("broken"))


def alarm_score(scored: DataFrame) -> DataFrame:
    """Alarms with next_dud (null while waiting) and p_next; precision and the model's own forecast."""
    known = F.col("next_dud").isNotNull()
    hit = F.coalesce(F.col("next_dud"), F.lit(False))
    modelled = known & F.col("p_next").isNotNull()
    return scored.agg(
        F.count("*").alias("alarms"), F.count_if(known).alias("scored"), F.count_if(hit).alias("next_rider_dud"),
        percent(F.count_if(hit), F.count_if(known)).alias("precision_pct"), F.count_if(~known).alias("waiting"),
        F.min(F.to_date("at")).alias("since"), F.count_if(modelled).alias("model_n"),
        (100 * F.round(F.avg(F.when(known, F.col("p_next"))), 9)).alias("model_pred_pct"),
        percent(F.count_if(modelled & hit), F.count_if(modelled)).alias("model_real_pct"))


def day_score(marked: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed bikes, those ridden by another person that day, and those given up again."""
    first = chains.first_rider_of_day(marked, listed).select("day", "bike", "dud")
    rows = listed.select("day", "bike").distinct().join(first, ["day", "bike"], "left")
    return rows.groupBy("day").agg(F.count("*").alias("listed"), F.count("dud").alias("rode"), F.count_if("dud").alias("first_dud"))


def day_scores(rows: Timeline, rule: Rule = Rule()) -> DataFrame:
    """Scores of all morning lists in one scan of a marked timeline.

    A listed rental is the last of its day, so the next rental by another person is the first rider of the list day
    if it falls on that day.
    """
    rows = chains.with_next_any(chains.with_next_rider(rows)).with_columns(_d=F.to_date("t0"))
    last = F.col("any_t0").isNull() | (F.to_date("any_t0") > F.col("_d"))
    d = rows.done().where(last & (chain_after() >= rule.alarm_k)).withColumn("day", F.date_add("_d", 1))
    rode = F.to_date("next_t0") == F.col("day")
    return d.groupBy("day").agg(F.count("*").alias("listed"), F.count_if(rode).alias("rode"), F.count_if(rode & F.col("next_dud")).alias("first_dud"))


def dataset_summary(marked: DataFrame, faults: DataFrame) -> DataFrame:
    f = faults.agg(F.count("*").alias("n")).scalar()
    return marked.agg(F.count("*").alias("rentals"), F.count_distinct("bike").alias("bikes"),
                      percent(F.count_if("dud"), F.count("*")).alias("dud_pct"), F.max(f).alias("faults"))


def sleeping(marked_rows, trips: DataFrame, heavy_station: Heavy | None = None, min_n: int = 30) -> DataFrame:
    """Bikes left alone for 6 h or more while others were rented at the same station, and the wake-up dud share."""
    d = chains.with_next_any(marked_rows).done()
    gap = (F.unix_micros("any_t0") - F.unix_micros("t1")) / 3.6e9
    d = d.withColumn("gap_h", gap).where((F.col("gap_h") >= 6) & (F.col("any_st0") == F.col("st1")))
    d = d.select("st1", "t1", "any_t0", "any_dud", "gap_h", F.struct("bike", "ord").alias("_id"))
    # every such station has starts: the wake-up itself is one
    d = range_count(trips.select("st0", "t0"), d, "st0", "t0", "st1", "t1", "any_t0", "others", lo_open=False,
                    hi_open=True, heavy=heavy_station)
    hours = F.when(F.col("gap_h") < 24, "6-24").when(F.col("gap_h") < 72, "24-72").otherwise("72+")
    others = F.when(F.col("others") < 10, "0-10").when(F.col("others") < 50, "10-50").otherwise("50+")
    return d.groupBy(hours.alias("hours"), others.alias("others")).agg(
        F.count("*").alias("n"), percent(F.count_if("any_dud"), F.count("*")).alias("wake_dud_pct")).where(F.col("n") >= min_n)


def helpers(marked_rows, trips: DataFrame, heavy_station: Heavy | None = None) -> DataFrame:
    """Per alarm with a later rental: minutes waited and other users at the station meanwhile."""
    d = chains.with_next_any(marked_rows).done().where(F.col("alarm") & F.col("any_t0").isNotNull())
    d = d.select("bike", "ord", "st1", "t1", "any_t0", F.struct("bike", "ord").alias("_id"))
    d = range_count(trips.select("st0", "t0"), d, "st0", "t0", "st1", "t1", "any_t0", "_n", lo_open=False, hi_open=True,
                    heavy=heavy_station)
    known = trips.select(F.col("st0").alias("st1")).distinct()
    d = d.join(known, "st1", "left_semi")
    return d.select("bike", "ord", ((F.unix_micros("any_t0") - F.unix_micros("t1")) / 6e7).alias("wait_min"),
                    F.greatest(F.lit(0), F.col("_n") - 1).cast("long").alias("helpers"))


def same_person_share(trips: DataFrame, rule: Rule, heavy: Heavy | None = None) -> DataFrame:
    """After a dud: share of next rentals by the same person, and the median gap in minutes."""
    rows = chains.timeline(trips.withColumn("dud", is_dud(rule)), heavy).add(_p=previous(F.struct("dud", "who", "t1"))).done()
    rows = rows.where("_p.dud").select((F.coalesce(F.col("who") == F.col("_p.who"), F.lit(False))).alias("same"),
                                       ((F.unix_micros("t0") - F.unix_micros("_p.t1")) / 6e7).alias("gap"))
    rows = saved(rows)
    med = quantiles(rows, F.col("gap"), [0.5], ["m"]).select("m").scalar()
    return rows.agg(F.count("*").alias("n"), percent(F.count_if("same"), F.count("*")).alias("same_person_pct"),
                    F.max(med).alias("gap_median_min"))


def quartiles(df: DataFrame, value: Column) -> DataFrame:
    return quantiles(df, value, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])


def choose_gap(variants: DataFrame, slack_pct: float = 0.5) -> DataFrame:
    """The gap that stands in for the person key: precision within the slack of the key's, then most prevented, then the shortest."""
    key = variants.where("variant = 'who'").agg(F.max("precision_pct").alias("v")).scalar()
    good = variants.where(F.startswith("variant", F.lit("gap ")) & (F.col("precision_pct") >= key - slack_pct))
    order = F.struct("prevented_per_day", -F.substring_index("variant", " ", -1).cast("int"))
    best = good.agg(F.max_by(F.struct(*variants.columns), order).alias("b"))
    return best.where("b is not null").select("b.*")
