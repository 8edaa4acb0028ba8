"""Two extracts of the same rentals compared row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import percent


def feed_parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in both and on one side only by (bike, t0); per column, how many shared rows agree (null-safe)."""
    cols = ["st0", "t1", "st1", "dist_m", "who"]
    a = left.select("bike", "t0", F.struct(*cols).alias("_l"))
    b = right.select("bike", "t0", F.struct(*cols).alias("_r"))
    j = a.join(b, ["bike", "t0"], "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    n = F.count_if(both)

    def same(c: str):
        if c == "dist_m":
            return F.abs(F.col("_l.dist_m") - F.col("_r.dist_m")) <= 1
        return F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))

    names = {"st0": "st0", "t1": "t1", "st1": "st1", "dist_m": "dist", "who": "who"}
    return j.agg(n.alias("n_both"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"),
                 *[percent(F.count_if(both & same(c)), n).alias(f"{names[c]}_equal_pct") for c in cols])
