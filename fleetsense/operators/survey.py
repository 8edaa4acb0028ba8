"""Human checks against the chain state of the bike at that moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..rules import Rule
from .timeline import Heavy, Timeline, running_max


def state_before(surveys: DataFrame, marked: DataFrame, heavy: Heavy | None = None, rule: Rule = Rule()) -> DataFrame:
    """Chain left by the latest rental (in row order) returned by the survey time; 0 if there is none.

    Rentals of one asset may overlap, so the scan runs in return order and keeps the largest (t0, ord) seen.
    """
    state = F.struct("t0", "ord", S.chain_after().alias("chain"), "t1", "st1")
    ev = marked.select("bike", F.col("t1").alias("_t"), F.lit(0).alias("_k"), state.alias("_v"))
    row = F.struct(*surveys.columns)
    kind = surveys.select(row.alias("x")).schema[0].dataType
    probes = surveys.select("bike", F.col("at").alias("_t"), F.lit(1).alias("_k"), row.alias("_s"))
    both = ev.withColumn("_s", F.lit(None).cast(kind)).unionByName(
        probes.withColumn("_v", F.lit(None).cast(ev.schema["_v"].dataType)))
    rows = Timeline(both, "bike", ["_t", "_k"], heavy, time="_t").add(_m=running_max(F.col("_v"))).done()
    chain = F.coalesce(F.col("_m.chain"), F.lit(0).cast("long"))
    return rows.where("_k = 1").select("_s.*", chain.alias("chain"), (chain >= rule.alarm_k).alias("alarm"),
                                       F.col("_m.t0").alias("last_t0"), F.col("_m.ord").alias("last_ord"))


def validate(state: DataFrame) -> DataFrame:
    """Recall, false alarms and precision of the alarm against what people saw, each with its Wilson interval."""
    broken = F.col("status") != S.FINE
    out = [F.count(F.lit(1)).alias("checked"), F.count_if(broken).alias("broken"), F.count_if("alarm").alias("alarmed")]
    for name, hit, of in (("recall", F.col("alarm"), broken), ("false_alarm", F.col("alarm"), ~broken),
                          ("precision", broken, F.col("alarm"))):
        k, n = F.count_if(of & hit), F.count_if(of)
        lo, hi = S.wilson(k, F.nullif(n, F.lit(0)))
        out += [S.percent(k, n).alias(f"{name}_pct"), lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi")]
    return state.agg(*out)


def alarmed_probability(surveys: DataFrame, marked: DataFrame, trips: DataFrame, heavy: Heavy | None = None,
                        heavy_station: Heavy | None = None) -> DataFrame:
    """Model probability, at survey time, of the bikes that were on alarm then."""
    from . import chains, features, model

    state = state_before(surveys, marked, heavy).where("alarm").select("id", "bike", "at", "status", F.col("last_ord").alias("ord"))
    hist = chains.history(marked, 7, heavy).with_columns(chain=S.chain_after()).done()
    hist = hist.where("chain >= 2").select("bike", "ord", "t1", "st1", "chain", F.col("hist_duds").alias("hist7_duds"), F.col("hist_rentals").alias("hist7_rentals"),
                                           (F.col("hist_alarms") - 1).alias("prior_alarms7"), S.seconds_between("t0", "t1").alias("dur_sec"))
    d = state.join(hist, ["bike", "ord"]).withColumns({"age_h": S.hours_between("t1", "at"), "_id": F.col("id")})
    return features.with_shun(d.select(*d.columns, F.col("id").alias("_keep")), trips, heavy=heavy_station).drop("_keep").withColumn("p", model.probability())
