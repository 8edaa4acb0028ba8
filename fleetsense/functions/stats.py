"""Exact order statistics that stay distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import ordered, running_sum


def quantiles(df: DataFrame, value: Column, probs: list[float], names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Values are counted first, then ranked by a running sum cut into value bins, so neither one group nor the
    whole table is sorted in one task.
    """
    counts = (df.select(*by, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
              .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")))
    rows = ordered(counts, list(by), ["_v"]).add(_cum=running_sum(F.col("_c"))).done()
    total = rows.groupBy(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)]).agg(F.sum("_c").alias("_n"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    if by:
        rows = rows.join(total, same)
    else:
        rows = rows.withColumn("_n", total.scalar())
    aggs, outs = [], []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (F.col("_n") - 1) * F.lit(p)
        aggs += [F.min(F.when(F.col("_cum") > F.floor(h), F.col("_v"))).alias(f"_a{i}"),
                 F.min(F.when(F.col("_cum") > F.ceil(h), F.col("_v"))).alias(f"_z{i}")]
        frac = (F.col("_nn") - 1) * F.lit(p)
        outs.append((F.col(f"_a{i}") + (F.col(f"_z{i}") - F.col(f"_a{i}")) * (frac - F.floor(frac))).alias(name))
    return rows.groupBy(*by).agg(F.max("_n").alias("_nn"), *aggs).select(*by, *outs)


def auc(df: DataFrame, score: Column, label: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank AUC with average ranks for ties, from counts per distinct score, one row per group."""
    counts = (df.select(*by, score.cast("double").alias("_v"), label.cast("int").alias("_y")).where(F.col("_v").isNotNull())
              .groupBy(*by, "_v").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg")))
    rows = ordered(counts, list(by), ["_v"]).add(_below=running_sum(F.col("_neg"), here=False)).done()
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    pairs = F.sum("_pos") * F.sum("_neg")
    return rows.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"),
                                 F.when(pairs > 0, wins / pairs).alias("auc"))


def top_by_count(df: DataFrame, score: Column, tie: list[str], k: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Flag ``chosen``: rows among the k best scores (ties by ``tie``); k is a column constant within ``by``.

    Global order is cut into score bins, so the whole table is never ranked in one task. Null scores are never chosen.
    """
    d = df.withColumn("_desc", -score.cast("double")).withColumn("_k", k)
    rows = ordered(d, list(by), ["_desc", *tie]).add(_rank=running_sum(F.col("_desc").isNotNull().cast("int"))).done()
    return rows.withColumn("chosen", F.col("_desc").isNotNull() & (F.col("_rank") <= F.col("_k"))).drop("_desc", "_k", "_rank")


def draws(seed: int, r: str, j: str, n: Column) -> Column:
    """Reproducible draw in 0..n-1 from the first 60 bits of the MD5 of "seed-replicate-position", which any engine can repeat."""
    text = F.concat_ws("-", F.lit(seed).cast("string"), F.col(r).cast("string"), F.col(j).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % n
