"""The headline table: one row for each city and month of rentals, all sets marked and scored side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent
from ..rules import Rule
from . import chains
from .temporal import asof, lead_times, within_hours
from .timeline import find_heavy, saved

SET = ["city", "month"]


def by_city_and_month(trips: DataFrame, faults: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """city, month, trips, dud_pct, k0..k3, per_day, lead_share_pct, lead_h_median, victims_mean, unreported_pct.

    ``trips`` are rentals with city and month, ``faults`` reports with city. A city without person keys is marked by the gap
    rule; one without fault reports has null in the last four columns. Every set is marked on its own rentals only: sets
    share one exchange by (set, bike). Faults count inside the time span of a set."""
    cities = trips.groupBy("city").agg(F.max(F.col("who").isNotNull()).alias("person")).collect()
    person = [r.city for r in cities if r.person]
    rows = trips.withColumn("bike", F.concat_ws("|", "city", "month", "bike"))
    heavy = find_heavy(rows, "bike", "t0")
    by_person = F.coalesce(F.col("city").isin(person), F.lit(False))
    gap = chains.mark(rows.where(~by_person), rule, "gap" if rule.retry_gap_sec > 0 else "none", heavy)
    marked = chains.mark(rows.where(by_person), rule, "person" if rule.same_person else "none", heavy).unionByName(gap)
    duds = saved(marked.where("dud").select(*SET, "bike", "t0", "t1", "dud", "retry", "streak", "alarm"))

    spans = rows.groupBy(*SET).agg(F.min("t0").alias("_lo"), F.max("t0").alias("_hi"))
    every = saved(faults.join(spans, "city").withColumn("bike", F.concat_ws("|", "city", "month", "bike")))
    inside = every.where((F.col("t") >= F.col("_lo")) & (F.col("t") <= F.col("_hi"))).select("bike", "t", "kind")
    own = F.split("bike", "[|]")
    lead = lead_times(duds.drop(*SET), inside, heavy=heavy, span=rows).withColumns({"city": own[0], "month": own[1]})
    lead = lead.groupBy(*SET).agg(percent(F.count("alarm_at"), F.count("*")).alias("lead_share_pct"), F.round(F.percentile("lead_h", F.lit(0.5)), 9).alias("lead_h_median"),
                                  (F.sum("duds_between") / F.nullif(F.count("alarm_at"), F.lit(0))).alias("victims_mean"))
    chain = duds.where(~F.col("retry") & (F.col("streak") >= rule.alarm_k - 1)).select(*SET, "bike", "t1")
    chain = asof(chain.join(every.select("city").distinct(), "city", "left_semi"), every.select("bike", "t"), "bike", "t1", "t", F.struct("t"), "f", "forward", False, heavy)
    silent = chain.groupBy(*SET).agg(percent(F.count_if(~within_hours(F.col("f.t"), F.col("t1"), 168)), F.count("*")).alias("unreported_pct"))

    other, dud, n = ~F.col("retry"), F.col("dud"), F.count(F.lit(1))
    at = [percent(F.count_if(other & (F.col("streak") == k) & dud), F.count_if(other & (F.col("streak") == k))).alias(f"k{k}") for k in range(4)]
    out = marked.groupBy(*SET).agg(n.alias("trips"), percent(F.count_if(dud), n).alias("dud_pct"), *at,
                                   (F.count_if(other & (F.col("streak") >= rule.alarm_k) & dud) / F.count_distinct(F.to_date("t0"))).alias("per_day"))
    return out.join(lead, SET, "left").join(silent, SET, "left")
