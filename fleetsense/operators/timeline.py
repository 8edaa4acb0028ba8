"""Ordered scans over (key, time) that no single task has to hold whole.

A plain window needs every row of a key in one task. That is fine for an ordinary asset and fatal for a
placeholder id that owns a third of the table. ``Timeline`` keeps the plain window for ordinary keys and cuts
the rows of heavy keys into time slices: the window runs inside (key, slice), a summary of one row per heavy
slice is aggregated map-side, scanned per key, and joined back as a broadcast carry. All scans are built from
associative pieces (running sum and maximum, last or first non-null), so the result is the same.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE = "_slice"
MAX_ROWS = 5_000_000      # rows of one key that one task may sort
BURST = 16                # slices are cut this much finer than needed, for uneven arrival
BROADCAST_ROWS = 2_000_000
FIRST_SLICE = -(1 << 62)  # rows without a time come first


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; make one only on a local master without the setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """Evaluate once into the shared checkpoint folder; what is built on top starts from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@dataclass(frozen=True)
class Heavy:
    """Keys above the row limit with the start and width (microseconds) of their slices."""

    frame: DataFrame
    rows: int

    def small(self) -> DataFrame:
        return F.broadcast(self.frame) if self.rows <= BROADCAST_ROWS else self.frame


def find_heavy(df: DataFrame, key: str, time: str, max_rows: int = MAX_ROWS) -> Heavy | None:
    """One counting pass (partial aggregation, two columns). At most rows/max_rows keys can come back."""
    counts = df.groupBy(F.col(key).alias("_hkey")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.unix_micros(time)).alias("lo"),
        F.max(F.unix_micros(time)).alias("hi"),
    )
    found = counts.where(F.col("n") > max_rows).select(
        "_hkey",
        F.coalesce("lo", F.lit(0)).alias("_hlo"),
        F.greatest(F.lit(1), ((F.col("hi") - F.col("lo")) * max_rows / (F.col("n") * BURST)).cast("long")).alias("_hwidth"),
    ).collect()
    if not found:
        return None
    schema = df.select(F.col(key).alias("_hkey"), F.lit(0).cast("long").alias("_hlo"),
                       F.lit(0).cast("long").alias("_hwidth")).schema
    return Heavy(df.sparkSession.createDataFrame(found, schema), len(found))


def ordered(df: DataFrame, key, order, bin_by: str | None = None, bins: int = 256) -> "Timeline":
    """Timeline over an already aggregated table, evaluated once, whose groups may still be large.

    Up to a checked size it uses plain windows; beyond it is cut into bins of the first order column (a number, or a
    time), so neither one group nor the whole table is scanned in one task. Nulls come first and NaN last, as in a sort.
    """
    df = saved(df)
    first = order[0] if bin_by is None else bin_by
    kind = dict(df.dtypes)[first]
    at = F.unix_micros(first) if kind == "timestamp" else F.nanvl(first, F.lit(None).cast(kind)) if kind in ("double", "float") else F.col(first)
    size = df.agg(F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if size.n <= MAX_ROWS:
        return Timeline(df, key, order)
    step = 0 if size.lo is None else (size.hi - size.lo) / bins
    cut = F.floor((at - F.lit(size.lo)) / F.lit(step)) if step > 0 else at * 0
    outside = F.when(F.col(first).isNull(), -1).otherwise(bins + 1)
    return Timeline(df, key, order, slice_by=F.coalesce(cut.cast("long"), outside.cast("long")))


@dataclass(frozen=True)
class Scan:
    kind: str           # sum | max | last | first | lag | lead
    expr: Column
    here: bool          # include the current row


def running_sum(expr: Column, here: bool = True) -> Scan:
    return Scan("sum", expr, here)


def running_max(expr: Column, here: bool = True) -> Scan:
    return Scan("max", expr, here)


def last_known(expr: Column, here: bool = False) -> Scan:
    """Latest non-null value before the row (or up to it)."""
    return Scan("last", expr, here)


def next_known(expr: Column, here: bool = False) -> Scan:
    """Earliest non-null value after the row (or from it on)."""
    return Scan("first", expr, here)


def previous(expr: Column) -> Scan:
    """Value of the row just before; use a struct so that it is never null itself."""
    return Scan("lag", expr, False)


def following(expr: Column) -> Scan:
    """Value of the row just after; use a struct so that it is never null itself."""
    return Scan("lead", expr, False)


BACKWARD = ("first", "lead")


class Timeline:
    """Rows of each key in order. ``add`` appends scan columns and returns a new timeline."""

    def __init__(self, df: DataFrame, key, order, heavy: Heavy | None = None, time: str | None = None,
                 slice_by: Column | None = None):
        self.key = [key] if isinstance(key, str) else list(key)
        self.order = [order] if isinstance(order, str) else list(order)
        self.sliced = heavy is not None or slice_by is not None
        if SLICE in df.columns:
            df = df.drop(SLICE)
        if heavy is not None:
            at = F.unix_micros(F.col(time or self.order[0]))
            # a null key may be heavy too; its rows and rows without a time have slices like any other
            df = (df.join(heavy.small(), F.col(self.key[0]).eqNullSafe(F.col("_hkey")), "left")
                  .withColumn(SLICE, F.when(F.col("_hwidth").isNotNull(),
                                            F.coalesce(F.floor((at - F.col("_hlo")) / F.col("_hwidth")), F.lit(FIRST_SLICE))))
                  .drop("_hkey", "_hlo", "_hwidth"))
        elif slice_by is not None:
            df = df.withColumn(SLICE, slice_by)
        self.df = df

    def _copy(self, df: DataFrame) -> "Timeline":
        out = object.__new__(Timeline)
        out.key, out.order, out.sliced, out.df = self.key, self.order, self.sliced, df
        return out

    def with_columns(self, **cols: Column) -> "Timeline":
        return self._copy(self.df.withColumns(cols))

    def where(self, cond: Column) -> "Timeline":
        return self._copy(self.df.where(cond))

    def done(self) -> DataFrame:
        return self.df.drop(SLICE) if self.sliced else self.df

    def _window(self, s: Scan):
        w = Window.partitionBy(*self.key, *([SLICE] if self.sliced else []))
        if s.kind in ("lag", "lead"):
            return w.orderBy(*self.order)
        if s.kind == "first":
            # read backwards: a frame that shrinks from the front would be recomputed for every row
            w = w.orderBy(*[F.desc(c) for c in self.order])
        else:
            w = w.orderBy(*self.order)
        return w.rowsBetween(Window.unboundedPreceding, 0 if s.here else -1)

    def add(self, **scans: Scan) -> "Timeline":
        if not self.sliced:
            return self._copy(self.df.withColumns({n: _over(s, self._window(s)) for n, s in scans.items()}))
        local = self.df.withColumns({f"_l_{n}": _over(s, self._window(s)) for n, s in scans.items()})
        out = local.join(self._carry(scans), _same(local, self.key + [SLICE]), "left")
        out = out.withColumns({n: _merge(s.kind, F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, s in scans.items()})
        drop = [f"_{p}_{n}" for n in scans for p in "lc"] + [f"_k{i}" for i in range(len(self.key) + 1)]
        return self._copy(out.drop(*drop))

    def _carry(self, scans: dict[str, Scan]) -> DataFrame:
        """What each slice inherits from the slices before (or after) it; one row per slice."""
        order = F.struct(*self.order)
        totals = []
        for n, s in scans.items():
            if s.kind == "sum":
                total = F.sum(s.expr)
            elif s.kind == "max":
                total = F.max(s.expr)
            else:
                pick = F.min_by if s.kind in BACKWARD else F.max_by
                total = pick(s.expr, F.when(s.expr.isNotNull(), order))
            totals.append(total.alias(f"_t_{n}"))
        keys = self.key + [SLICE]
        per_slice = saved(self.df.where(F.col(SLICE).isNotNull()).groupBy(*keys).agg(*totals))
        w = Window.partitionBy(*(self.key or [F.lit(0)]))
        before = w.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        after = w.orderBy(F.desc(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        pick = {"sum": "sum", "max": "max"}
        carry = per_slice.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            *[_over(Scan(pick.get(s.kind, "last"), F.col(f"_t_{n}"), False), after if s.kind in BACKWARD else before).alias(f"_c_{n}")
              for n, s in scans.items()])
        return F.broadcast(carry) if per_slice.count() <= BROADCAST_ROWS else carry


def _same(df: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return cond


def _over(s: Scan, w) -> Column:
    if s.kind == "sum":
        return F.coalesce(F.sum(s.expr).over(w), F.lit(0))
    if s.kind == "max":
        return F.max(s.expr).over(w)
    if s.kind in ("lag", "lead"):
        return (F.lag if s.kind == "lag" else F.lead)(s.expr).over(w)
    return F.last(s.expr, ignorenulls=True).over(w)


def _merge(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return local + F.coalesce(carry, F.lit(0))
    if kind == "max":
        return F.greatest(local, carry)
    return F.coalesce(local, carry)
