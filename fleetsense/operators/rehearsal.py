"""The daily job replayed for every day with short windows, against the list from the full history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import chain_after, is_dud
from ..rules import Rule
from . import chains, lists
from .timeline import Heavy, saved


def rehearse(trips: DataFrame, windows: tuple[int, ...], rule: Rule = Rule(), heavy: Heavy | None = None) -> DataFrame:
    """Per window length and day: both list sizes, common and missed bikes, Jaccard per cent, and the score of the list.

    A run seen from inside a window is the end of the full run, so its chain is never longer: only bikes of the full
    list can be on a short one. Just their rentals of the window days are marked again, all days in one job.
    rode counts the listed bikes rented on the day, first_dud those whose first rental was a dud; null after the last day.
    """
    full = chains.last_row(chains.mark(trips, rule, "person", heavy).withColumn("_d", F.to_date("t0")), "bike", "_d")
    full = saved(full.where(chain_after() >= rule.alarm_k).select(F.date_add("_d", 1).alias("day"), "bike"))
    first = trips.withColumn("day", F.to_date("t0")).join(full, ["day", "bike"], "left_semi").groupBy("day", "bike")
    first = saved(first.agg(F.min_by(is_dud(rule), F.struct("t0", "ord")).alias("_dud")))
    known = F.col("day") <= trips.agg(F.max(F.to_date("t0")).alias("d")).scalar()
    out = []
    for w in windows:
        short = saved(_lists_of_window(trips, full, w, rule, heavy))
        score = short.join(first, ["day", "bike"]).groupBy("day").agg(F.count(F.lit(1)).alias("_rode"), F.count_if("_dud").alias("_first"))
        d = lists.overlap(short, full, ["day", "bike"], "day").join(score, "day", "left")
        d = d.withColumns({"rode": F.when(known, F.coalesce("_rode", F.lit(0))), "first_dud": F.when(known, F.coalesce("_first", F.lit(0)))})
        out.append(d.drop("_rode", "_first").select(F.lit(w).cast("long").alias("days"), "*"))
    return reduce(DataFrame.unionByName, out)


def _lists_of_window(trips: DataFrame, full: DataFrame, w: int, rule: Rule, heavy: Heavy | None) -> DataFrame:
    need = full.withColumn("_d", F.explode(F.sequence(F.date_sub("day", w), F.date_sub("day", 1))))
    d = trips.withColumn("_d", F.to_date("t0")).join(need, ["bike", "_d"])
    # a rental seen from another list day is another asset: the key carries both
    key = F.concat_ws("@", "bike", F.col("day").cast("string"))
    seen = d.select(key.alias("_key"), F.col("bike").alias("_bike"), "day", "ord", "t0", "t1", "st0", "st1", "dist_m", "who")
    m = chains.mark(seen.withColumnRenamed("_key", "bike"), rule, "person", None if heavy is None else _rekey(heavy, seen))
    last = chains.last_row(m, "bike").withColumn("chain", chain_after())
    return last.where((F.col("chain") >= rule.alarm_k) & (F.to_date("t0") == F.date_sub("day", 1))).select("day", F.col("_bike").alias("bike"))


def _rekey(heavy: Heavy, seen: DataFrame) -> Heavy:
    keys = seen.select("_key", "_bike").distinct().join(heavy.small(), F.col("_bike") == F.col("_hkey"))
    frame = saved(keys.select(F.col("_key").alias("_hkey"), "_hlo", "_hwidth"))
    return Heavy(frame, frame.count())
