"""Tables as Parquet files under versioned manifests.

A database folder holds data files, one manifest a table version (schema, files
with their statistics, indexes, constraints), and numbered catalogue files that
name the manifests.  A commit creates the next catalogue file, which must not
exist yet: commits are atomic over all tables, and of two writers the second
sees a conflict.  That rests on a store where a file is created or renamed
without replacing another: local disks (hard links) and HDFS are such stores;
on a store whose rename replaces, use one writer at a time.  Old versions stay
readable until ``vacuum``.

Inserts add files.  Updates and deletes rewrite only the files that hold
matching rows, and whole files fall out of the manifest where all rows go.
Each file's least and greatest value of the key and index columns are in the
manifest: lookups and uniqueness checks read only the files that can matter.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types
from .functions.secure import decrypt_column, encrypt_column
from .scratch import fresh

#: Types whose least and greatest values are kept, and the longest text that is.
ORDERED = (T.LongType, T.DoubleType, T.StringType, T.DateType, T.TimestampNTZType)
LONGEST = 64
#: Rows of a file that compaction and index builds aim at.
ROWS_PER_FILE = 2_000_000


class ConstraintViolation(ValueError):
    """A NOT NULL, CHECK, PRIMARY KEY, UNIQUE or FOREIGN KEY constraint would not hold."""


class Conflict(RuntimeError):
    """Another writer committed first."""


class NoSuchTable(KeyError):
    pass


@dataclass(frozen=True)
class DmlResult:
    affected_rows: int


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    kind: str = "btree"
    unique: bool = False


@dataclass(frozen=True)
class Foreign:
    columns: tuple[str, ...]
    table: str
    to: tuple[str, ...]


def plain(v):
    """A value as the statistics hold it; None where it cannot be compared with them."""
    if isinstance(v, (date, datetime)):
        return v.isoformat()
    if isinstance(v, bool) or not isinstance(v, (int, float, str)):
        return None
    return None if isinstance(v, str) and len(v) > LONGEST else v


@dataclass(frozen=True)
class FileStats:
    """Rows of a file, and (least, greatest) of columns; (None, None) where all values are null."""

    rows: int
    bounds: dict[str, tuple] = field(default_factory=dict)

    def may_hold(self, column: str, low, high) -> bool:
        """False only if no value of the column lies from low to high (None: open)."""
        if column not in self.bounds:
            return True
        least, most = self.bounds[column]
        if least is None:
            return False  # a comparison with null is never true
        try:
            return not (low is not None and most < low or high is not None and least > high)
        except TypeError:  # another type: let the scan decide
            return True


@dataclass(frozen=True)
class TableState:
    schema: T.StructType
    files: tuple[str, ...] = ()
    rows: int = 0
    indexes: tuple[Index, ...] = ()
    stats: dict[str, FileStats] = field(default_factory=dict)
    checks: tuple[str, ...] = ()
    foreign: tuple[Foreign, ...] = ()

    def dump(self) -> str:
        return json.dumps(
            {
                "schema": self.schema.jsonValue(),
                "files": self.files,
                "rows": self.rows,
                "indexes": [[i.name, i.columns, i.kind, i.unique] for i in self.indexes],
                "stats": {f: [s.rows, s.bounds] for f, s in self.stats.items() if f in set(self.files)},
                "checks": self.checks,
                "foreign": [[f.columns, f.table, f.to] for f in self.foreign],
            }
        )

    @classmethod
    def load(cls, text: str) -> TableState:
        d = json.loads(text)
        return cls(
            T.StructType.fromJson(d["schema"]),
            tuple(d["files"]),
            d["rows"],
            tuple(Index(n, tuple(c), k, u) for n, c, k, u in d["indexes"]),
            {f: FileStats(n, {c: tuple(b) for c, b in bounds.items()}) for f, (n, bounds) in d.get("stats", {}).items()},
            tuple(d.get("checks", ())),
            tuple(Foreign(tuple(c), t, tuple(to)) for c, t, to in d.get("foreign", ())),
        )

    def watched(self) -> list[str]:
        """Columns of keys and indexes whose bounds are kept."""
        wanted = {c for key in types.unique_keys(self.schema) for c in key} | {c for i in self.indexes for c in i.columns}
        return [f.name for f in self.schema if f.name in wanted and isinstance(f.dataType, ORDERED) and not f.metadata.get("encrypted")]

    def sort(self) -> tuple[str, ...]:
        """The columns that files are sorted by: those of the first ordered index."""
        return next((i.columns for i in self.indexes if i.kind != "hash"), ())


class Files:
    """The few file operations needed, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        path = self.path(root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(path).toString()

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[str]:
        return sorted(self.times(folder))

    def times(self, folder: str) -> dict[str, float]:
        """What lies in a folder, with the time of its last change (seconds)."""
        p = self.path(f"{self.root}/{folder}")
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self.fs.listStatus(p)} if self.fs.exists(p) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file that appears whole; False if there is one of this name."""
        target, part = self.path(f"{self.root}/{name}"), self.path(f"{self.root}/{name}.{uuid.uuid4().hex}.tmp")
        if self.fs.exists(target):
            return False
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":  # a rename would replace; a hard link never does
                os.link(part.toUri().getPath(), target.toUri().getPath())
                return True
            return not self.fs.exists(target) and self.fs.rename(part, target)
        except FileExistsError:
            return False
        finally:
            if self.fs.exists(part):
                self.fs.delete(part, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def remove(self) -> None:
        """Deletes the whole folder."""
        self.fs.delete(self.path(self.root), True)


@dataclass
class Catalog:
    version: int = 0
    manifests: dict[str, str] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    #: The last batch of each stream that is in the tables.
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    """The tables of a database; changes are staged and committed together."""

    def __init__(self, spark: SparkSession, root: str, key: bytes | None = None):
        self.spark, self.files, self.key = spark, Files(spark, root), key
        self.base, self.states = Catalog(), {}
        self.reload()

    # ------------------------------------------------------------ versions
    def _versions(self) -> list[str]:
        return [n for n in self.files.names("catalog") if n.endswith(".json")]

    def reload(self) -> None:
        """The last committed version; what is staged is lost."""
        names = self._versions()
        self.base = Catalog(**json.loads(self.files.read(f"catalog/{names[-1]}"))) if names else Catalog()
        self.states: dict[str, TableState] = {name: TableState.load(self.files.read(m)) for name, m in self.base.manifests.items()}
        self.views: dict[str, str] = dict(self.base.views)
        self.batches: dict[str, int] = dict(self.base.batches)
        self.changed: set[str] = set()

    def refresh(self) -> None:
        """The last committed version, if it is not the one at hand."""
        names = self._versions()
        if self.staged() or names and names[-1] != f"{self.base.version:020d}.json":
            self.reload()

    def staged(self) -> bool:
        return bool(self.changed) or self.views != self.base.views or self.batches != self.base.batches

    def commit(self) -> int:
        if not self.staged():
            return self.base.version
        manifests = {k: v for k, v in self.base.manifests.items() if k in self.states}
        for name in sorted(self.changed & set(self.states)):
            manifests[name] = f"manifests/{name}-{uuid.uuid4().hex}.json"
            self.files.create(manifests[name], self.states[name].dump())
        new = Catalog(self.base.version + 1, manifests, dict(self.views), dict(self.batches))
        if not self.files.create(f"catalog/{new.version:020d}.json", json.dumps(new.__dict__)):
            self.reload()
            raise Conflict("another writer committed first")
        self.base, self.changed = new, set()
        return new.version

    def named(self, name: str) -> str:
        """The name as the table was created with; names are alike whatever their case."""
        return next((n for n in self.states if n.lower() == name.lower()), name)

    def put(self, name: str, state: TableState) -> None:
        self.states[name] = state
        self.changed.add(name)

    def state(self, name: str) -> TableState:
        try:
            return self.states[self.named(name)]
        except KeyError:
            raise NoSuchTable(name) from None

    def vacuum(self, retain_hours: float = 24.0) -> int:
        """Deletes what no version of the last ``retain_hours`` uses; the number of files and folders.

        Younger files stay too, as other writers may be about to commit them.
        With 0 hours only the last version stays: use it where no one else writes.
        """
        if self.staged():
            raise RuntimeError("changes are staged: commit or roll back before vacuum")
        self.reload()
        cut = time.time() - retain_hours * 3600
        times, versions = self.files.times("catalog"), self._versions()
        # a version counts as used until the one after it came
        kept = {v for v, after in zip(versions, versions[1:], strict=False) if retain_hours and times[after] >= cut} | set(versions[-1:])
        manifests = {m for v in kept for m in json.loads(self.files.read(f"catalog/{v}"))["manifests"].values()}
        used = {f.split("/")[1] for m in manifests for f in TableState.load(self.files.read(m)).files}
        old = lambda folder: [n for n, t in self.files.times(folder).items() if not retain_hours or t < cut]
        gone = [f"catalog/{n}" for n in old("catalog") if n not in kept]
        gone += [f"manifests/{n}" for n in old("manifests") if f"manifests/{n}" not in manifests]
        gone += [f"data/{n}" for n in old("data") if n not in used]
        for name in gone:
            self.files.delete(name)
        return len(gone)

    # ------------------------------------------------------------ reading
    def raw(self, name: str, files: tuple[str, ...] | None = None, path: str | None = None) -> DataFrame:
        """The table as stored; ``path`` names a column for the file of each row."""
        state = self.state(name)
        found = state.files if files is None else files
        schema = types.stored(state.schema)
        if not found:
            out = self.spark.createDataFrame([], schema).toDF(*state.schema.names)
            return out.withColumn(path, F.lit("")) if path else out
        df = self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{f}" for f in found])
        named = [F.col(f"`{types.stored_name(f)}`").alias(f.name) for f in state.schema]
        return df.select(*named, *([F.col("_metadata.file_path").alias(path)] if path else []))

    def read(self, name: str, files: tuple[str, ...] | None = None, path: str | None = None) -> DataFrame:
        """The table with encrypted columns in the clear, if there is a key."""
        name = self.named(name)
        df, schema = self.raw(name, files, path), self.state(name).schema
        if self.key:
            for f in schema:
                if f.metadata.get("encrypted"):
                    df = df.withColumn(f.name, decrypt_column(F.col(f.name), self.key, name).cast(f.dataType))
        return df

    def candidates(self, name: str, bounds: dict[str, tuple]) -> tuple[str, ...]:
        """The files that can hold rows with each column from low to high (None: open)."""
        state = self.state(name)
        near = {c: (plain(low), plain(high)) for c, (low, high) in bounds.items()}
        none = FileStats(0)
        return tuple(f for f in state.files if all(state.stats.get(f, none).may_hold(c, *b) for c, b in near.items()))

    # ------------------------------------------------------------ writing
    def _write(self, name: str, df: DataFrame, parts: int | None = None) -> tuple[str, ...]:
        """Writes the rows (in the clear) and returns the new files; ``parts`` deals them out anew, in order."""
        state = self.state(name)
        for c in types.encrypted(state.schema):
            if not self.key:
                raise ValueError(f"{name}.{c} is encrypted and the database was opened without a key")
            df = df.withColumn(c, encrypt_column(F.col(c).cast("string"), self.key, name))
        sort = state.sort()
        if parts:
            df = df.repartitionByRange(parts, *sort) if sort else df.repartition(parts)
        if sort:
            df = df.sortWithinPartitions(*sort)  # tight row-group ranges for lookups
        folder = f"data/{name}-{uuid.uuid4().hex}"
        stored = {f.name: types.stored_name(f) for f in state.schema}
        writer = df.toDF(*stored.values()).write
        for i in state.indexes:
            for c in i.columns if i.kind == "hash" else ():
                writer = writer.option(f"parquet.bloom.filter.enabled#{stored[c]}", "true")
        writer.parquet(f"{self.files.root}/{folder}")
        return tuple(f"{folder}/{n}" for n in self.files.names(folder) if n.endswith(".parquet"))

    def _measure(self, name: str, files: tuple[str, ...]) -> dict[str, FileStats]:
        """Statistics of new files that hold rows, and NOT NULL and CHECK on their rows, in one pass."""
        if not files:
            return {}
        state = self.state(name)
        watched, must = state.watched(), types.required(state.schema)
        checks = [*types.checks(state.schema).values(), *state.checks]
        rows = self.read(name, files, path="_file")
        short = lambda c: F.col(c) if not isinstance(state.schema[c].dataType, T.StringType) else F.when(F.length(c) <= LONGEST, F.col(c))
        bounds = [x for i, c in enumerate(watched) for x in (F.min(short(c)).alias(f"l{i}"), F.max(short(c)).alias(f"h{i}"), F.count(F.when(F.col(c).isNotNull() & short(c).isNull(), 1)).alias(f"long{i}"))]
        nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"null{i}") for i, c in enumerate(must)]
        # as in SQL, an unknown result passes
        failed = [F.count(F.when(~F.expr(t), 1)).alias(f"check{i}") for i, t in enumerate(checks)]
        found = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), *bounds, *nulls, *failed).collect()  # a row a file
        if bad := [c for i, c in enumerate(must) if any(r[f"null{i}"] for r in found)]:
            raise ConstraintViolation(f"{name}: null in {', '.join(bad)}")
        if bad := [t for i, t in enumerate(checks) if any(r[f"check{i}"] for r in found)]:
            raise ConstraintViolation(f"{name}: CHECK ({bad[0]}) does not hold")
        ends = {"/".join(f.split("/")[-2:]): f for f in files}
        return {
            ends["/".join(r["_file"].split("/")[-2:])]: FileStats(r["n"], {c: (plain(r[f"l{i}"]), plain(r[f"h{i}"])) for i, c in enumerate(watched) if not r[f"long{i}"]})
            for r in found
        }

    def _conform(self, name: str, df: DataFrame, columns: list[str] | None) -> DataFrame:
        schema = self.state(name).schema
        names = columns or schema.names
        if len(df.columns) != len(names):
            raise ValueError(f"{len(names)} columns, {len(df.columns)} values")
        lower = {c.lower(): c for c in schema.names}
        if unknown := [c for c in names if c.lower() not in lower]:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        given = df.toDF(*[lower[c.lower()] for c in names])
        missing = lambda f: F.expr(f.metadata["default"]) if "default" in f.metadata else F.lit(None)
        return given.select(*[(F.col(f"`{f.name}`") if f.name in given.columns else missing(f)).cast(f.dataType).alias(f.name) for f in schema])

    def keys(self, name: str) -> list[list[str]]:
        state = self.state(name)
        return types.unique_keys(state.schema) + [list(i.columns) for i in state.indexes if i.unique]

    def _unique(self, name: str, files: tuple[str, ...], stats: dict[str, FileStats], rest: tuple[str, ...]) -> None:
        """Keys of the new files among themselves and against the files of the rest that can hold one of them."""
        new = tuple(stats)
        state = self.state(name)
        for key in self.keys(name) if new else ():
            near = rest
            for c in key:
                bounds = [s.bounds.get(c, ()) for s in stats.values()]
                if all(bounds):
                    known = [b for b in bounds if b[0] is not None]
                    if not known:
                        near = ()  # nothing but nulls, which are equal to nothing
                        break
                    low, high = min(b[0] for b in known), max(b[1] for b in known)
                    near = tuple(f for f in near if state.stats.get(f, FileStats(0)).may_hold(c, low, high))
            mine = self.read(name, new).select(*key)
            mark = fresh(mine, "new_")
            both = mine.withColumn(mark, F.lit(1))
            if near:
                both = both.union(self.read(name, near).select(*key, F.lit(0)))
            some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
            twice = both.filter(some).groupBy(*key).agg(F.count(F.lit(1)).alias(f"{mark}n"), F.max(mark).alias(mark)).filter((F.col(f"{mark}n") > 1) & (F.col(mark) == 1))
            if not twice.isEmpty():
                raise ConstraintViolation(f"{name}: {', '.join(key)} is not unique")

    def _orphans(self, child: DataFrame, f: Foreign) -> bool:
        some = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in f.columns])
        parent = self.read(f.table).select(*[F.col(c).alias(f"to{i}") for i, c in enumerate(f.to)])
        asked = child.filter(some).select(*[F.col(c).alias(f"of{i}") for i, c in enumerate(f.columns)])
        same = reduce(lambda a, b: a & b, [F.col(f"of{i}") == F.col(f"to{i}") for i in range(len(f.to))])
        return not asked.join(parent, same, "left_anti").isEmpty()

    def _change(self, name: str, state: TableState, new: tuple[str, ...], kept: tuple[str, ...], changed: Iterable[str] | None, lost: bool) -> dict[str, FileStats]:
        """Puts the state with ``kept`` and ``new`` files in place, if all constraints hold.

        ``changed`` names the columns that have new values (None: all), ``lost``
        says that keys may have gone that another table refers to.
        """
        touched = lambda columns: changed is None or bool(set(columns) & set(changed))
        try:
            stats = self._measure(name, new)
            if any(touched(k) for k in self.keys(name)):
                self._unique(name, new, stats, kept)
            known = {f: s for f, s in state.stats.items() if f in set(kept)} | stats
            files = kept + tuple(f for f in new if f in stats)
            rows = sum(s.rows for s in known.values()) if len(known) == len(files) else state.rows - sum(state.stats[f].rows for f in state.files if f not in set(kept)) + sum(s.rows for s in stats.values())
            self.put(name, replace(state, files=files, rows=rows, stats=known))
            for f in state.foreign:
                if touched(f.columns) and self._orphans(self.read(name, tuple(stats)), f):
                    raise ConstraintViolation(f"{name}: {', '.join(f.columns)} is not in {f.table}")
            for other, s in self.states.items() if lost else ():
                for f in s.foreign:
                    if f.table.lower() == name.lower() and touched(f.to) and self._orphans(self.read(other), f):
                        raise ConstraintViolation(f"{other}: {', '.join(f.columns)} would not be in {name}")
        except ConstraintViolation:
            self.put(name, state)
            self._discard(new)
            raise
        return stats

    def _discard(self, files: tuple[str, ...]) -> None:
        for folder in {f.rsplit("/", 1)[0] for f in files}:
            self.files.delete(folder)

    def create(self, name: str, schema: T.StructType, if_not_exists: bool = False, unique: Iterable[list[str]] = (), checks: Iterable[str] = (), foreign: Iterable[tuple] = ()) -> None:
        if self.named(name) in self.states:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        found = []
        for columns, table, to in foreign:
            parent = TableState(schema) if table.lower() == name.lower() else self.state(table)
            if not any({c.lower() for c in to} == {c.lower() for c in k} for k in [*types.unique_keys(parent.schema), *(i.columns for i in parent.indexes if i.unique)]):
                raise ValueError(f"{', '.join(to)} is not a key of {table}")
            found.append(Foreign(tuple(columns), name if table.lower() == name.lower() else self.named(table), tuple(to)))
        indexes = tuple(Index(f"{name}_{'_'.join(u)}_key", tuple(u), "unique", True) for u in unique)
        self.put(name, TableState(schema, indexes=indexes, checks=tuple(checks), foreign=tuple(found)))

    def drop(self, name: str, if_exists: bool = False) -> None:
        name = self.named(name)
        if name not in self.states and if_exists:
            return
        self.state(name)
        if users := [n for n, s in self.states.items() if n != name and any(f.table == name for f in s.foreign)]:
            raise ConstraintViolation(f"{', '.join(users)} refers to {name}")
        del self.states[name]
        self.changed.add(name)

    def insert(self, name: str, df: DataFrame, columns: list[str] | None = None) -> DmlResult:
        name = self.named(name)
        state = self.state(name)
        # checked as written: a query may not give the same rows twice
        stats = self._change(name, state, self._write(name, self._conform(name, df, columns)), state.files, None, False)
        return DmlResult(sum(s.rows for s in stats.values()))

    def _touched(self, name: str, condition: Column) -> tuple[dict[str, int], int]:
        """Files with matching rows and their number of them; no other file is rewritten."""
        files = self.state(name).files
        if not files:
            return {}, 0
        rows = self.read(name, path="_file").alias(name).filter(condition).groupBy("_file").count().collect()
        end = lambda f: tuple(f.split("/")[-2:])
        mine = {end(f): f for f in files}
        hit = {mine[end(r["_file"])]: r["count"] for r in rows}
        return hit, sum(hit.values())

    def update(self, name: str, assignments: dict[str, Column], condition: Column | None) -> DmlResult:
        name = self.named(name)
        state = self.state(name)
        lower = {c.lower(): c for c in state.schema.names}
        if unknown := [c for c in assignments if c.lower() not in lower]:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        to = {lower[c.lower()]: v for c, v in assignments.items()}
        cond = F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)
        hit, n = self._touched(name, cond)
        if not n:
            return DmlResult(0)
        old = self.read(name, tuple(hit)).alias(name)
        new = old.select(*[(F.when(cond, to[f.name].cast(f.dataType)).otherwise(F.col(f.name)) if f.name in to else F.col(f.name)).alias(f.name) for f in state.schema])
        kept = tuple(f for f in state.files if f not in hit)
        self._change(name, state, self._write(name, new), kept, set(to), True)
        return DmlResult(n)

    def delete(self, name: str, condition: Column | None) -> DmlResult:
        name = self.named(name)
        state = self.state(name)
        if condition is None:
            self._change(name, state, (), (), None, True)
            return DmlResult(state.rows)
        cond = F.coalesce(condition, F.lit(False))
        hit, n = self._touched(name, cond)
        if not n:
            return DmlResult(0)
        kept = tuple(f for f in state.files if f not in hit)
        some = tuple(f for f, k in hit.items() if f not in state.stats or k < state.stats[f].rows)  # the others go whole
        files = self._write(name, self.read(name, some).alias(name).filter(~cond)) if some else ()
        self._change(name, state, files, kept, None, True)
        return DmlResult(n)

    def rebuild(self, name: str, rows_per_file: int = ROWS_PER_FILE) -> int:
        """Rewrites a table into files of about so many rows, in the order of its index; the number of files."""
        name = self.named(name)
        state = self.state(name)
        if state.files:
            files = self._write(name, self.read(name), max(1, -(-state.rows // rows_per_file)))
            stats = self._measure(name, files)
            self.put(name, replace(state, files=tuple(stats), stats=stats))
        return len(self.state(name).files)

    # ------------------------------------------------------------ changes of schema
    def add_column(self, name: str, new: T.StructField, spell: Callable[[object], str]) -> None:
        """A new last column; rows that are there have its default (or null), and no file is touched."""
        name = self.named(name)
        state = self.state(name)
        if new.name.lower() in {c.lower() for c in state.schema.names}:
            raise ValueError(f"column {new.name} exists")
        value = None
        if state.rows and "default" in new.metadata:
            if new.metadata.get("encrypted") or isinstance(new.dataType, T.BinaryType):
                raise ValueError(f"{new.name} cannot have a default in rows that are there")  # readers fill in no binary values
            value = self.spark.range(1).select(F.expr(new.metadata["default"]).cast(new.dataType)).first()[0]
        if state.rows and not new.nullable and value is None:
            raise ConstraintViolation(f"{name}: null in {new.name}")
        meta = new.metadata | {"stored": f"{new.name}-{uuid.uuid4().hex[:8]}"}
        if value is not None:
            meta["existing"] = spell(value)
        self.put(name, replace(state, schema=T.StructType([*state.schema.fields, T.StructField(new.name, new.dataType, new.nullable, meta)])))
        bad = types.checks(T.StructType([new]))
        if bad and state.rows and not self.read(name).filter(~F.expr(bad[new.name])).isEmpty():
            self.put(name, state)
            raise ConstraintViolation(f"{name}: CHECK ({bad[new.name]}) does not hold")

    def _used(self, name: str, state: TableState, column: str) -> str:
        found = next((c for c in state.schema.names if c.lower() == column.lower()), None)
        if found is None:
            raise ValueError(f"no such column: {column}")
        if any(found in i.columns for i in state.indexes):
            raise ValueError(f"column {column} has an index")
        if types.checks(state.schema) or state.checks:
            raise ValueError("the table has CHECK constraints")
        if any(found in f.columns for f in state.foreign) or any(f.table == name and found in f.to for s in self.states.values() for f in s.foreign):
            raise ValueError(f"column {column} is in a foreign key")
        return found

    def drop_column(self, name: str, column: str) -> None:
        """The column is no longer read; its data goes as files are rewritten."""
        name = self.named(name)
        state = self.state(name)
        column = self._used(name, state, column)
        if len(state.schema) == 1:
            raise ValueError("a table needs a column")
        self.put(name, replace(state, schema=T.StructType([f for f in state.schema if f.name != column])))

    def rename_column(self, name: str, column: str, to: str) -> None:
        name = self.named(name)
        state = self.state(name)
        column = self._used(name, state, column)
        if to.lower() in {c.lower() for c in state.schema.names if c != column}:
            raise ValueError(f"column {to} exists")
        change = lambda f: T.StructField(to, f.dataType, f.nullable, f.metadata | {"stored": types.stored_name(f)})
        stats = {f: FileStats(s.rows, {to if c == column else c: b for c, b in s.bounds.items()}) for f, s in state.stats.items()}
        self.put(name, replace(state, stats=stats, schema=T.StructType([change(f) if f.name == column else f for f in state.schema])))

    def rename_table(self, name: str, to: str) -> None:
        name = self.named(name)
        state = self.state(name)
        if self.named(to) in self.states and self.named(to) != name:
            raise ValueError(f"table {to} exists")
        if types.encrypted(state.schema):
            raise ValueError("the keys of encrypted columns depend on the table's name")
        del self.states[name]
        self.changed.add(name)
        self.put(to, state)
        for other, s in list(self.states.items()):
            if any(f.table == name for f in s.foreign):
                self.put(other, replace(s, foreign=tuple(replace(f, table=to) if f.table == name else f for f in s.foreign)))

    # ------------------------------------------------------------ indexes
    def create_index(self, name: str, table: str, columns: list[str], unique: bool, kind: str) -> None:
        """The first ordered index puts the table's rows in its order; a hash index gives files Bloom filters."""
        table = self.named(table)
        state = self.state(table)
        if any(i.name.lower() == name.lower() for s in self.states.values() for i in s.indexes):
            raise ValueError(f"index {name} exists")
        lower = {c.lower(): c for c in state.schema.names}
        if unknown := [c for c in columns if c.lower() not in lower]:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        index = Index(name, tuple(lower[c.lower()] for c in columns), "unique" if unique else kind, unique)
        self.put(table, replace(state, indexes=(*state.indexes, index)))
        try:
            if unique and state.files:
                self._unique(table, state.files, dict.fromkeys(state.files, FileStats(0)), ())
        except ConstraintViolation:
            self.put(table, state)
            raise
        if self.state(table).sort() != state.sort() or kind == "hash":
            self.rebuild(table)
        elif state.files:
            self.put(table, replace(self.state(table), stats=self._measure(table, state.files)))

    def index(self, name: str) -> tuple[str, Index]:
        for table, s in self.states.items():
            for i in s.indexes:
                if i.name.lower() == name.lower():
                    return table, i
        raise KeyError(name)

    def drop_index(self, name: str) -> None:
        table, found = self.index(name)
        state = self.state(table)
        self.put(table, replace(state, indexes=tuple(i for i in state.indexes if i != found)))
