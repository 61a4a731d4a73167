"""Landed tables of a stream: batches that become visible as a whole, folded into days, dropped by the day.

A batch writes a partition of its own in each table of its stream and then, last, one entry in the stream's ledger.
Readers take the batches that have an entry, so the tables of a batch appear together or not at all, and a batch that is
run again replaces itself. `fold` rewrites the days that the batches since the last fold have touched, each as one new
version of a partition per day, and names the versions in force in a snapshot of the ledger. `retain` takes days out of
the snapshot, `vacuum` removes the files that no kept snapshot names. Readers so open the days in force and the batches
since the last fold, however many batches have ever landed.

One process writes the batches of a stream and one maintains it; they may differ and run at the same time.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.dates import interval

DAY, BATCH, VERSION = "event_date", "batch_id", "version"
NO_DAY = datetime.date(9999, 12, 31)  # of rows without a time, which no retention drops

LEDGER = "kind string, name string, day date, version long, up_to long, kept_from date, columns string, entry long"


@dataclass(frozen=True)
class Landed:
    """A table of a stream. With `keys` a later row replaces the earlier ones with its keys; else all rows count.

    Tables with the same `clock` are retained together, by the largest time that any of them holds.
    """

    name: str
    time: str = "event_time"
    keys: tuple[str, ...] = ()
    clock: str = "event"


@dataclass(frozen=True)
class State:
    """What the ledger says: batches up to `mark` are folded, those up to `last` have landed."""

    version: int = 0
    mark: int = -1
    last: int = -1
    columns: dict[str, str] = field(default_factory=dict)
    days: dict[str, dict[datetime.date, int]] = field(default_factory=dict)
    kept_from: dict[str, datetime.date] = field(default_factory=dict)


class Store:
    """The tables of one stream below `target`, a namespace or a folder."""

    def __init__(self, spark: SparkSession, target: str, stream: str, tables: Sequence[Landed], *, fmt: str = "parquet", by_day: bool = True) -> None:
        self.spark, self.target, self.stream, self.fmt, self.by_day = spark, target.rstrip("/"), stream, fmt, by_day
        self.tables = {t.name: t for t in tables}
        self.in_folder = "/" in target

    # --- tables and folders ---------------------------------------------------------------------------------------

    def _place(self, name: str) -> str:
        return f"{self.target}/{name}" if self.in_folder else f"{self.target}.{name}"

    def _exists(self, name: str) -> bool:
        if not self.in_folder:
            return self.spark.catalog.tableExists(self._place(name))
        files, path = self.files(self._place(name))
        return files.exists(path)

    def files(self, place: str):
        """The file system of a path, and the path."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _rows(self, name: str, columns: T.StructType) -> DataFrame:
        if self.in_folder:
            return self.spark.read.schema(columns).format(self.fmt).load(self._place(name))
        return self.spark.table(self._place(name)).select(*columns.fieldNames())

    def _put(self, rows: DataFrame, name: str, by: list[str]) -> None:
        """Write rows; each partition they have replaces the one that is there."""
        if self.in_folder:
            writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(self.fmt)
            writer.partitionBy(*by).save(self._place(name))
            return
        if not self._exists(name):
            rows.limit(0).write.format(self.fmt).partitionBy(*by).saveAsTable(self._place(name))
        session, mode = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
        before, order = session.conf.get(mode), session.table(self._place(name)).columns
        session.conf.set(mode, "dynamic")  # an option of the writer does not reach insertInto
        try:
            rows.select(*order).write.insertInto(self._place(name), overwrite=True)
        finally:
            session.conf.set(mode, before)

    def _partitions(self, name: str) -> list[dict[str, str]]:
        """The partitions a table has, each by the text of its values."""
        if not self._exists(name):
            return []
        if not self.in_folder:
            found = self.spark.sql(f"SHOW PARTITIONS {self._place(name)}").collect()
            return [dict(part.split("=", 1) for part in row.partition.split("/")) for row in found]
        out, pending = [], [(self._place(name), {})]
        while pending:
            place, values = pending.pop()
            files, path = self.files(place)
            inside = [(s.getPath().getName(), s.isDirectory()) for s in files.listStatus(path)]
            pending += [(f"{place}/{part}", values | dict([part.split("=", 1)])) for part, folder in inside if folder and "=" in part]
            if values and not all(folder for _, folder in inside):
                out.append(values)
        return out

    def _drop(self, name: str, values: dict[str, str]) -> None:
        if self.in_folder:
            files, path = self.files("/".join([self._place(name), *(f"{k}={v}" for k, v in values.items())]))
            files.delete(path, True)
        else:
            listed = ", ".join(f"{k} = '{v}'" for k, v in values.items())
            self.spark.sql(f"ALTER TABLE {self._place(name)} DROP IF EXISTS PARTITION ({listed})")

    # --- the ledger -----------------------------------------------------------------------------------------------

    @property
    def ledger(self) -> str:
        return f"{self.stream}_ledger"

    def _enter(self, rows: list[tuple]) -> None:
        """One entry of the ledger, in one file: readers see all of it or nothing."""
        self._put(self.spark.createDataFrame(rows, LEDGER).coalesce(1), self.ledger, ["entry"])

    def _entries(self) -> list:
        """The rows of the ledger: as many as there are kept days, and batches since the last fold but one."""
        if not self._exists(self.ledger):
            return []
        return self._rows(self.ledger, T.StructType.fromDDL(LEDGER)).collect()

    @staticmethod
    def _states(entries: list) -> list[State]:
        """The states the ledger names, newest first; the last one is that before any fold."""
        columns = {r.name: r.columns for r in sorted((r for r in entries if r.kind == "batch"), key=lambda r: r.entry)}
        last = max((r.entry for r in entries if r.kind == "batch"), default=-1)
        out = [State()]
        for entry in sorted({r.entry for r in entries if r.entry < 0}, reverse=True):
            state = State(version=-entry)
            for r in (r for r in entries if r.entry == entry):
                if r.kind == "mark":
                    state = replace(state, mark=r.up_to)
                elif r.kind == "table":
                    state.columns[r.name] = r.columns
                    if r.kept_from:
                        state.kept_from[r.name] = r.kept_from
                else:
                    state.days.setdefault(r.name, {})[r.day] = r.version
            out.insert(0, state)
        return [replace(s, last=max(last, out[0].mark), columns=s.columns | columns) for s in out]

    def state(self) -> State:
        return self._states(self._entries())[0]

    def _snapshot(self, state: State) -> None:
        rows = [("mark", None, None, state.version, state.mark, None, None, -state.version)]
        for name, columns in state.columns.items():
            rows.append(("table", name, None, None, None, state.kept_from.get(name), columns, -state.version))
        for name, days in state.days.items():
            rows += [("day", name, day, version, None, None, None, -state.version) for day, version in days.items()]
        self._enter(rows)

    # --- writing and reading --------------------------------------------------------------------------------------

    def write(self, batch: int, frames: dict[str, DataFrame]) -> None:
        """Land the rows of one batch in all its tables. They are visible once this has returned."""
        entry = []
        for name, rows in frames.items():
            day = F.coalesce(F.to_date(self.tables[name].time), F.lit(NO_DAY))
            rows = rows.withColumn(DAY, day) if self.by_day and self.tables[name].clock == "event" else rows
            rows = rows.withColumn(BATCH, F.lit(batch).cast("bigint"))
            self._put(rows, name, [c for c in (DAY, BATCH) if c in rows.columns])
            entry.append(("batch", name, None, None, batch, None, rows.schema.json(), batch))
        self._enter(entry)

    def _columns(self, state: State, name: str) -> T.StructType:
        if name not in state.columns:
            raise LookupError(f"nothing has landed in {self._place(name)}")
        return T.StructType.fromJson(json.loads(state.columns[name]))

    def _open(self, state: State, name: str) -> DataFrame:
        """The rows of the batches that have landed and are not folded."""
        rows = self._rows(name, self._columns(state, name)).where((F.col(BATCH) > state.mark) & (F.col(BATCH) <= state.last))
        if DAY not in rows.columns:
            rows = rows.withColumn(DAY, F.coalesce(F.to_date(self.tables[name].time), F.lit(NO_DAY)))
        keys = self.tables[name].keys
        if keys:
            newest = Window.partitionBy(*keys).orderBy(F.desc(BATCH))
            rows = rows.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")
        rows = rows.drop(BATCH)
        return rows.where(F.col(DAY) >= state.kept_from[name]) if name in state.kept_from else rows

    def _folded(self, state: State, name: str, days: dict[datetime.date, int]) -> DataFrame:
        """The rows of some days, each in the version in force."""
        plain = [f for f in self._columns(state, name).fields if f.name not in (BATCH, DAY)]
        columns = T.StructType([*plain, T.StructField(DAY, T.DateType()), T.StructField(VERSION, T.LongType())])

        def one(version: int) -> Column:
            return (F.col(VERSION) == version) & F.col(DAY).isin([d for d, v in days.items() if v == version])

        rows = self._rows(f"{name}_days", columns)
        return rows.where(reduce(or_, map(one, sorted(set(days.values()))))).drop(VERSION)

    def _both(self, state: State, name: str, opened: DataFrame, days: dict[datetime.date, int]) -> DataFrame:
        if not days:
            return opened
        folded, keys = self._folded(state, name, days), self.tables[name].keys
        if keys:  # what is open is newer
            folded = folded.join(opened.select(*keys).distinct(), list(keys), "left_anti")
        return opened.unionByName(folded)

    def read(self, name: str) -> DataFrame:
        """The rows that have landed and are retained, with the day of their time in `event_date`."""
        state = self.state()
        return self._both(state, name, self._open(state, name), state.days.get(name, {}))

    # --- maintenance ----------------------------------------------------------------------------------------------

    def fold(self, keep: str | None = None) -> bool:
        """Fold the batches since the last fold into their days; says whether there were any.

        Of the days that `retain(keep)` would take out of force no rows are rewritten.
        """
        state = self.state()
        if state.last <= state.mark:
            return False
        version, days = state.version + 1, {name: dict(of) for name, of in state.days.items()}
        bounds = self._bounds(state, keep) if keep else {}
        for name in self.tables:
            if name not in state.columns:
                continue
            opened, have = self._open(state, name), days.setdefault(name, {})
            if name in bounds:
                opened = opened.where(F.col(DAY) >= bounds[name])
            touched = [r[0] for r in opened.select(DAY).distinct().collect()]  # a row per day
            rows = self._both(state, name, opened, {day: have[day] for day in touched if day in have})
            rows = rows.withColumn(VERSION, F.lit(version).cast("bigint")).hint("rebalance", DAY)
            self._put(rows, f"{name}_days", [DAY, VERSION])
            have.update(dict.fromkeys(touched, version))
        self._snapshot(replace(state, version=version, mark=state.last, days=days))
        return True

    def _bound(self, state: State, names: list[str], keep: str) -> datetime.date | None:
        """The first day to keep: that of the largest time of the tables, less `keep`."""
        tops = []
        for name in names:
            time, days = self.tables[name].time, state.days.get(name, {})
            tops.append(self._open(state, name).select(F.col(time).alias("t")))
            newest = max((d for d in days if d != NO_DAY), default=None)
            if newest:
                tops.append(self._folded(state, name, {newest: days[newest]}).select(F.col(time).alias("t")))
        return reduce(DataFrame.union, tops).agg(F.to_date(F.max("t") - interval(keep))).first()[0]

    def _bounds(self, state: State, keep: str) -> dict[str, datetime.date]:
        """The first day to keep of each table that has a time."""
        out = {}
        for clock in {t.clock for t in self.tables.values()}:
            names = [t.name for t in self.tables.values() if t.clock == clock and t.name in state.columns]
            bound = self._bound(state, names, keep) if names else None
            out |= dict.fromkeys(names, bound) if bound else {}
        return out

    def retain(self, keep: str = "1 day") -> dict[str, datetime.date]:
        """Take the days out of force that lie wholly before the largest landed time less `keep`; the first day kept, by
        table. Rows that come later for such a day are not shown either. Running it again changes nothing."""
        state = self.state()
        days, kept_from = {name: dict(of) for name, of in state.days.items()}, dict(state.kept_from)
        for name, bound in self._bounds(state, keep).items():
            if bound > kept_from.get(name, datetime.date.min):
                kept_from[name] = bound
                days[name] = {d: v for d, v in days.get(name, {}).items() if d >= bound}
        if kept_from != state.kept_from:
            self._snapshot(replace(state, version=state.version + 1, days=days, kept_from=kept_from))
        return kept_from

    def vacuum(self, snapshots: int = 2) -> int:
        """Remove the files that none of the newest `snapshots` states needs; how many partitions went.

        Readers that started before the states kept here may fail; two leave them the time of one round of maintenance.
        """
        states = self._states(self._entries())[:snapshots]
        mark, gone = min(s.mark for s in states), 0
        oldest = states[-1]
        for name in self.tables:
            used = {(day.isoformat(), str(version)) for s in states for day, version in s.days.get(name, {}).items()}
            bound = min((s.kept_from.get(name, datetime.date.min) for s in states)).isoformat()
            for part in self._partitions(name):
                if int(part[BATCH]) <= mark or part.get(DAY, bound) < bound:
                    self._drop(name, part)
                    gone += 1
            for part in self._partitions(f"{name}_days"):
                if (part[DAY], part[VERSION]) not in used and int(part[VERSION]) <= states[0].version:
                    self._drop(f"{name}_days", part)
                    gone += 1
        for part in self._partitions(self.ledger):
            entry = int(part["entry"])
            if 0 <= entry <= mark or -oldest.version < entry < 0:
                self._drop(self.ledger, part)
        return gone

    def maintain(self, keep: str | None = "1 day", snapshots: int = 2) -> None:
        """Fold, retain `keep` (None: all), and remove what is not needed any more: the job to run every few minutes."""
        self.fold(keep)
        if keep:
            self.retain(keep)
        self.vacuum(snapshots)
