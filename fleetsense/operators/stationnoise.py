"""Is it the bike or the station? Other bikes' duds nearby in time, and station-wide alarms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import micros
from .temporal import asof, range_count
from .timeline import Heavy, Timeline, following, previous, running_sum, saved

HOUR_US = 3_600_000_000


def distinct_before(duds: DataFrame, heavy: Heavy | None = None, heavy_bike: Heavy | None = None) -> DataFrame:
    """Per dud: how many other bikes gave a dud at the station in the hour before (rows earlier in (t1, bike, ord)).

    A bike is counted once at its latest dud in the window. Each dud is therefore alive until the same bike's next
    dud there, or until the hour is over, whichever comes first; the count is a running sum of births and deaths.
    """
    d = duds.select("bike", "ord", "st1", "t1")
    own = Timeline(d, ["bike", "st1"], ["t1", "ord"], heavy_bike, time="t1").add(_n=following(F.struct("t1", "bike", "ord"))).done()
    born = F.struct(F.col("t1").alias("t"), F.lit(0).alias("k"), F.col("bike").alias("b"), F.col("ord").alias("o"), F.lit(1).alias("w"), F.lit(True).alias("row"))
    # a death by age counts after every row of its instant; a death by renewal happens just before the newer row
    over = F.timestamp_micros(micros("t1") + HOUR_US)
    renewed = F.col("_n").isNotNull() & (F.col("_n.t1") <= over)
    death = F.when(renewed, F.struct(F.col("_n.t1").alias("t"), F.lit(0).alias("k"), F.col("_n.bike").alias("b"), (F.col("_n.ord")).alias("o"),
                                     F.lit(-1).alias("w"), F.lit(False).alias("row"))).otherwise(
        F.struct(over.alias("t"), F.lit(1).alias("k"), F.lit("").alias("b"), F.lit(0).cast("long").alias("o"), F.lit(-1).alias("w"), F.lit(False).alias("row")))
    ev = own.select("st1", F.explode(F.array(born, death)).alias("e")).select("st1", "e.*")
    # the newer row sees the older one gone: deaths sort before births of the same row
    rows = Timeline(ev, "st1", ["t", "k", "b", "o", "w"], heavy, time="t").add(_alive=running_sum(F.col("w"), here=False)).done()
    return rows.where("row").select(F.col("b").alias("bike"), F.col("o").alias("ord"), "st1", F.col("t").alias("t1"),
                                    F.col("_alive").cast("long").alias("others"))


def cooled(fires: DataFrame, minutes: int = 60, heavy: Heavy | None = None) -> DataFrame:
    """Firings kept after a pause: the next one only when later than the last kept one plus the pause.

    The rule is sequential, but each firing has one possible successor (the first one after its pause), and a firing
    after a quiet pause is kept in any case. The kept ones are those reachable from such starts; the pointers are
    doubled each round, so a station that never falls quiet takes logarithmic rounds, not one long task.
    """
    pause = minutes * 60_000_000
    rows = Timeline(fires, "st1", ["t1"], heavy).add(_p=previous(F.struct("t1"))).done()
    rows = rows.withColumn("_start", F.col("_p").isNull() | (micros("t1") - micros("_p.t1") > pause))
    rows = rows.select("st1", "t1", "_start", F.timestamp_micros(micros("t1") + pause).alias("_free"))
    rows = asof(rows, fires, "st1", "_free", "t1", F.struct("t1"), "_n", "forward", False, heavy)
    rows = saved(rows.select("st1", "t1", "_start", F.col("_n.t1").alias("to")))
    starts = rows.where("_start").select("st1", "t1")
    kept = starts
    # a pointer into the start of a block is not needed: starts are kept already
    step = saved(rows.where("to is not null").select("st1", "t1", "to").join(
        starts.withColumnRenamed("t1", "to"), ["st1", "to"], "left_anti"))
    while not step.isEmpty():
        more = kept.join(step, ["st1", "t1"]).select("st1", F.col("to").alias("t1"))
        kept = saved(kept.unionByName(more).distinct())
        far = step.select("st1", F.col("t1").alias("to"), F.col("to").alias("_far"))
        step = saved(step.join(far, ["st1", "to"]).select("st1", "t1", F.col("_far").alias("to")))
    return kept


def station_alarms(marked: DataFrame, ks: tuple[int, ...], heavy: Heavy | None = None, heavy_bike: Heavy | None = None) -> DataFrame:
    """Rentals in the hour after k different bikes failed at a station within an hour, against the station's own rate.

    One row for each k; the duds before each dud are counted once for all of them."""
    near = saved(distinct_before(marked.where("dud"), heavy, heavy_bike).select("st1", "t1", "others"))
    starts = marked.select("st0", "t0", "dud")
    own = marked.groupBy(F.col("st0").alias("st1")).agg((F.count_if("dud") / F.count(F.lit(1))).alias("own"))

    def row(k: int) -> DataFrame:
        # the bike itself is the k-th
        fires = near.where(F.col("others") + 1 >= k).select("st1", "t1").distinct()
        kept = cooled(saved(fires), heavy=heavy).withColumns({"_hi": F.timestamp_micros(micros("t1") + HOUR_US), "_id": F.struct("st1", "t1")})
        n = range_count(starts, kept, "st0", "t0", "st1", "t1", "_hi", "n", lo_open=True, hi_open=False, heavy=heavy)
        n = n.withColumn("_id", F.struct("st1", "t1"))
        n = range_count(starts, n, "st0", "t0", "st1", "t1", "_hi", "hits", lo_open=True, hi_open=False, weight=F.col("dud").cast("int"), heavy=heavy)
        n = n.join(own, "st1", "left").withColumn("expect", F.col("n") * F.coalesce("own", F.lit(0.0)))
        return n.agg(F.lit(k).cast("long").alias("k"), F.count(F.lit(1)).alias("alarms"), F.sum("n").alias("rentals"), F.sum("hits").alias("duds"),
                     F.sum("expect").alias("expected"))

    return reduce(DataFrame.unionByName, [row(k) for k in ks])
