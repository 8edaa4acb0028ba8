"""Tables that change together: immutable part folders, and one commit that tells which of them count.

A change writes new folders for the parts it replaces and then one commit, a small JSON table that lists every part of
every table. Readers follow the newest commit whose writer finished, so they see all tables of one change or none. What an
interrupted change wrote is never listed, and the change can be run again. One writer at a time.

Retention moves a table's boundary, kept in the commit: rows before it are not read, parts that lie wholly before it are
dropped, and other parts are not touched. Folders that none of the newest commits lists are deleted by ``vacuum``, so a
reader of an older commit is left alone for that many changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "kind string, name string, part string, path string, high long"


@dataclass(frozen=True)
class Table:
    """Schema, and for retention the time column, how many days are kept, and which older rows stay."""

    schema: str
    time: str | None = None
    days: int | None = None
    unless: str = "false"


@dataclass
class State:
    """What one commit lists."""

    number: int = -1
    parts: dict[str, dict[str, tuple[str, int | None]]] = field(default_factory=dict)
    bounds: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), tables
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._read: dict[int, State] = {}

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _listed(self, pattern: str) -> list[str]:
        return [s.getPath().toString() for s in self._fs.globStatus(self._path(pattern)) or []]

    def commits(self) -> list[int]:
        """Numbers of the finished commits."""
        return sorted(int(p.split("/")[-2]) for p in self._listed(f"{self.root}/commits/*/_SUCCESS"))

    def state(self, number: int | None = None) -> State:
        """The newest commit, or a given one."""
        if number is None:
            done = self.commits()
            if not done:
                return State()
            number = done[-1]
        if number not in self._read:
            s = State(number)
            for r in self.spark.read.schema(COMMIT).json(f"{self.root}/commits/{number}").collect():
                if r.kind == "part":
                    s.parts.setdefault(r.name, {})[r.part] = (r.path, r.high)
                elif r.kind == "bound":
                    s.bounds[r.name] = r.high
                else:
                    s.batches[r.name] = r.high
            self._read[number] = s
        return self._read[number]

    def read(self, table: str, parts: Iterable[str] | None = None, state: State | None = None) -> DataFrame:
        """Rows of a table, or of some of its parts."""
        state = self.state() if state is None else state
        known = state.parts.get(table, {})
        paths = [known[p][0] for p in (known if parts is None else sorted(set(parts))) if p in known]
        t = self.tables[table]
        if not paths:       # known to be empty when a plan is made, so joins with it and their exchanges fall away
            return self.spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(t.schema)])
        rows = self.spark.read.schema(t.schema).parquet(*paths)
        if table in state.bounds:
            rows = rows.where((F.col(t.time) >= F.timestamp_micros(F.lit(state.bounds[table]))) | F.expr(t.unless))
        return rows

    def change(self, stream: str, batch: int) -> Change | None:
        """A change on top of the newest commit; None if this batch of the stream is committed."""
        base = self.state()
        if base.batches.get(stream, -1) >= batch:
            return None
        return Change(self, State(base.number + 1, {t: dict(p) for t, p in base.parts.items()}, dict(base.bounds), base.batches | {stream: batch}))

    def vacuum(self, keep: int = 3) -> int:
        """Delete part folders and commits that are older than the newest ``keep`` commits and not listed by them."""
        done = self.commits()
        used = {p[0] for n in done[-keep:] for parts in self.state(n).parts.values() for p in parts.values()}
        old = [p for p in self._listed(f"{self.root}/data/*/*/part=*") if p not in used]
        newest = done[-1] if done else -1
        gone = 0
        for p in old:
            # a folder's name begins with the number of its change; an unfinished newer change is not touched
            if int(p.split("/")[-2].split("-")[0]) <= newest:
                gone += bool(self._fs.delete(self._path(p), True))
        for n in done[:-keep]:
            self._read.pop(n, None)
            self._fs.delete(self._path(f"{self.root}/commits/{n}"), True)
        return gone


class Change:
    """New parts of several tables. ``read`` sees what this change wrote so far."""

    def __init__(self, store: Store, state: State):
        self.store, self.state, self.spark = store, state, store.spark
        self.tag = f"{state.number}-{uuid.uuid4().hex[:12]}"

    def read(self, table: str, parts: Iterable[str] | None = None) -> DataFrame:
        return self.store.read(table, parts, self.state)

    def parts(self, table: str) -> list[str]:
        return list(self.state.parts.get(table, {}))

    def replace(self, table: str, rows: DataFrame, part: Column, parts: Iterable[str]) -> None:
        """Put ``rows`` in place of ``parts``; a part that gets no row is gone. They may be read from what they replace, whose
        folders stay as they are."""
        t = self.store.tables[table]
        names = StructType.fromDDL(t.schema).names
        high = F.unix_micros(F.max(t.time)) if t.time else F.lit(None).cast("long")
        rows = rows.select(*names, part.alias("part"))
        folder = f"{self.store.root}/data/{table}/{self.tag}-{uuid.uuid4().hex[:6]}"
        rows.repartition("part").write.partitionBy("part").parquet(folder)
        written = self.spark.read.schema(t.schema + ", part string").parquet(folder)
        found = {r.part: r.high for r in written.groupBy("part").agg(high.alias("high")).collect()}
        base = self.store._path(folder).makeQualified(self.store._fs.getUri(), self.store._fs.getWorkingDirectory()).toString()
        known = self.state.parts.setdefault(table, {})
        for p in parts:
            known.pop(p, None)
        known.update({p: (f"{base}/part={p}", h) for p, h in found.items()})

    def of_days(self, table: str, days: Iterable[str]) -> list[str]:
        """Parts of a table of deltas (day@number) that belong to some days."""
        days = set(days)
        return [p for p in self.parts(table) if p.split("@")[0] in days]

    def append(self, table: str, rows: DataFrame, day: Column, most: int = 8) -> None:
        """Add a delta part for each day of ``rows``; a day that has ``most`` deltas is made one part again."""
        self.replace(table, rows, F.concat(day, F.lit(f"@{self.state.number}")), [])
        count: dict[str, int] = {}
        for p in self.parts(table):
            count[p.split("@")[0]] = count.get(p.split("@")[0], 0) + 1
        full = [d for d, n in count.items() if n > most]
        if full:
            own = self.of_days(table, full)
            self.replace(table, self.read(table, own), F.concat(day, F.lit(f"@{self.state.number}")), own)

    def retain(self, now_us: int) -> None:
        """Move the boundaries to what is kept at this time; drop parts that lie wholly before them."""
        for name, t in self.store.tables.items():
            if t.days is None:
                continue
            bound = now_us - t.days * 86_400_000_000
            self.state.bounds[name] = bound
            if t.unless == "false":
                parts = self.state.parts.get(name, {})
                for p in [p for p, (_, high) in parts.items() if high is not None and high < bound]:
                    del parts[p]

    def commit(self) -> None:
        s = self.state
        rows = [("part", t, p, path, high) for t, parts in s.parts.items() for p, (path, high) in parts.items()]
        rows += [("bound", t, None, None, b) for t, b in s.bounds.items()] + [("batch", n, None, None, b) for n, b in s.batches.items()]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.store.root}/commits/{s.number}")
