"""The engine: statements against versioned tables, all row work in Spark."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.types import compare
from tessera.operators.relational import Counter, counters, filtered, joined
from tessera.plans import binder
from tessera.plans.parser import Copy, Create, Delete, Predicate, Select, Statement
from tessera.sources import csv_text
from tessera.sources.manifest import Catalog, DataFile, Table
from tessera.sources.tables import ParquetFolder, ScanStats, file_key, footers, prune, read_files, spark_schema, with_place

#: Rows of a partition (one Parquet file): files of a useful size, not of a page's.
MAX_ROWS = 1_000_000
#: Files whose footers the driver reads for statistics; the statistics of more come from a Spark job.
FOOTERS = 1_000


@dataclass(frozen=True)
class Query:
    """A planned SELECT: its rows, and what was pruned for each FROM entry."""

    rows: DataFrame
    stats: list[ScanStats]
    versions: list[int]
    placed: Callable[[], DataFrame] | None = None

    @property
    def ordered(self) -> DataFrame:
        """The rows in scan order, for a single table; joins have no order."""
        return self.placed() if self.placed else self.rows


@dataclass(frozen=True)
class CopyResult:
    rows: int
    partitions: int
    version: int


@dataclass(frozen=True)
class DeleteResult:
    deleted: int
    rewritten: int
    carried: int
    removed: int
    version: int


def session(builder=None) -> SparkSession:
    """A session with the settings that the language needs; cluster settings are left alone."""
    builder = builder or SparkSession.builder.appName("tessera")
    return builder.config("spark.sql.caseSensitive", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


class Engine:
    def __init__(self, spark: SparkSession, folder: str, *, max_rows: int = MAX_ROWS, before_commit: Callable[[], None] | None = None, log=None):
        if max_rows < 1:
            raise ValueError("Partition size must be positive")
        self.spark, self.max_rows, self.log = spark, max_rows, log or (lambda *a: None)
        spark.conf.set("spark.sql.caseSensitive", "true")
        self.catalog = Catalog(folder, before_commit)

    def execute(self, statement: Statement):
        """Table, CopyResult, DeleteResult or Query, by the statement's kind."""
        if isinstance(statement, Create):
            return self.create(statement)
        if isinstance(statement, Copy):
            return self.copy(statement)
        if isinstance(statement, Delete):
            return self.delete(statement)
        return self.select(statement)

    def create(self, statement: Create) -> Table:
        binder.bind_create(statement)
        return self.catalog.create(statement.table, list(statement.columns))

    def select(self, statement: Select) -> Query:
        # Snapshots are pinned first, one for all occurrences of a table.
        pinned = {t.table: self.catalog.get(t.table) for t in statement.tables}
        bound = binder.bind_select(statement, {n: t.kinds for n, t in pinned.items()})
        scans, stats, kept = [], [], []
        for e, ref in enumerate(statement.tables):
            table = pinned[ref.table]
            files = table.current.files
            kept = prune(files, [p for _, p in bound.filters[e]], self._decision(ref.exposed))
            stats.append(ScanStats(len(files), len(kept), len(files) - len(kept)))
            scans.append(read_files(self.spark, self.catalog, table, kept))
        rows = joined(scans, bound)

        def placed() -> DataFrame:
            return filtered(with_place(self.spark, scans[0], kept), bound.filters[0]).orderBy("__file", "__row").select(*rows.columns)

        return Query(rows, stats, [pinned[t.table].current.version for t in statement.tables], placed if len(scans) == 1 and kept else None)

    def analyze(self, statement: Select) -> list[Counter]:
        """Row counters of each operator of a SELECT, in FROM order; scans are counted by their files' row numbers.

        Each counter is a query of its own, so that none stands between a filter and its scan.
        """
        pinned = {t.table: self.catalog.get(t.table) for t in statement.tables}
        bound = binder.bind_select(statement, {n: t.kinds for n, t in pinned.items()})
        sizes, scans = [], []
        for e, ref in enumerate(statement.tables):
            kept = prune(pinned[ref.table].current.files, [p for _, p in bound.filters[e]])
            sizes.append(sum(f.rows for f in kept))
            scans.append(read_files(self.spark, self.catalog, pinned[ref.table], kept))
        return counters(scans, bound, sizes)

    def _decision(self, name: str):
        def told(k, p: Predicate | None, low, high, pruned):
            if p is None:
                self.log("DEBUG", "Planner", f"table={name} partition={k} decision=READ reason=noPredicate")
            else:
                word = {"=": "EQUALS", "<": "LESS_THAN", ">": "GREATER_THAN"}[p.op]
                self.log("DEBUG", "Planner", f"table={name} column={p.column} comparison={word} const={p.constant} partition={k} min={low} max={high} decision={'PRUNED' if pruned else 'READ'}")

        return told

    def copy(self, statement: Copy) -> CopyResult:
        """Append a headerless CSV file, all of it up to its present end or nothing."""
        binder.bind_copy(statement, self.catalog.tables)
        base = self.catalog.get(statement.table)
        size = csv_text.length(self.spark, statement.path)
        stage, done = self.catalog.stage(), False
        try:
            files = self._import(statement.path, base, stage, lambda: csv_text.length(self.spark, statement.path) == size)
            if files is None:
                # It grew meanwhile, as the engine's own log does: only its first bytes count.
                self.catalog.drop_stage(stage)
                copy = csv_text.bounded_copy(self.spark, statement.path, os.path.join(self.catalog.data, stage, "source", "part.csv"), size)
                files = self._import(copy, base, stage, lambda: True, statement.path)
                csv_text.remove(os.path.join(self.catalog.data, stage, "source"))
            table = self.catalog.commit(base, append=files)
            done = bool(files)
            return CopyResult(sum(f.rows for f in files), len(files), table.current.version)
        finally:
            if not done:
                self.catalog.drop_stage(stage)

    def _import(self, path: str, base: Table, stage: str, same: Callable[[], bool], name: str | None = None) -> list[DataFile] | None:
        """Files of a CSV file's rows, checked while they are written; None if it is not the same any more."""
        lines, n = csv_text.numbered_lines(self.spark, path)
        rows = csv_text.typed_rows(lines, list(base.columns))
        rows = rows.withColumn("__slice", F.floor(F.col("ordinal") / self.max_rows).cast("int")).withColumnRenamed("ordinal", "__order")
        try:
            files = self._write(rows, -(-n // self.max_rows), base, stage)
        except PySparkException:
            if not same():
                return None
            error = csv_text.first_error(lines, list(base.columns), name or path)
            if error is None:
                raise
            raise error from None
        return files if same() else None

    def _write(self, rows: DataFrame, slices: int, table: Table, stage: str) -> list[DataFile]:
        """One file for each __slice (from 0), rows by __order; the files in order of __slice, with statistics."""
        path = os.path.join(self.catalog.data, stage, "rows")
        columns = [n for n, _ in table.columns]
        # A slice is a partition, so that no two meet in a task while others idle.
        placed = rows.repartitionById(max(1, slices), "__slice").sortWithinPartitions("__slice", "__order").select("__slice", *(F.col(f"`{n}`") for n in columns))
        placed.write.partitionBy("__slice").parquet(path)
        found = {}
        for folder, _, names in os.walk(path):
            for name in names:
                if name.endswith(".parquet") and "__slice=" in folder:
                    found[int(folder.rsplit("=", 1)[1])] = os.path.relpath(os.path.join(folder, name), self.catalog.data)
        if not found:
            return []
        paths = [found[k] for k in sorted(found)]
        known = footers(self.catalog, paths, columns) if len(paths) <= FOOTERS else {}
        rest = [p for p in paths if p not in known]
        if rest:
            measures = [f(f"`{n}`").alias(f"{k}{i}") for i, n in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]
            read = self.spark.read.schema(spark_schema(table)).parquet(*(os.path.join(self.catalog.data, p) for p in rest))
            for r in read.groupBy(file_key().alias("f")).agg(F.count("*").alias("n"), *measures).collect():
                known[r.f] = DataFile(r.f, r.n, {n: [r[f"lo{i}"], r[f"hi{i}"]] for i, n in enumerate(columns)})
        return [known[p] for p in paths]

    def delete(self, statement: Delete) -> DeleteResult:
        """Copy-on-write: files without matches are carried, others rewritten or removed."""
        base = self.catalog.get(statement.table)
        bound = binder.bind_delete(statement, {base.name: base.kinds})
        files = base.current.files
        if statement.where is None:
            if not files:
                return DeleteResult(0, 0, 0, 0, base.current.version)
            table = self.catalog.commit(base, replace={f.path: [] for f in files})
            return DeleteResult(sum(f.rows for f in files), 0, 0, len(files), table.current.version)
        where = statement.where
        near = prune(files, [where], self._decision(base.name))
        hit = compare(F.col(f"`{bound.name}`"), where.op, where.constant)
        counts = {}
        if near:
            counts = {r.f: r.n for r in read_files(self.spark, self.catalog, base, near).groupBy(file_key().alias("f")).agg(F.count_if(hit).alias("n")).collect()}
        matched = [(f, n) for f in near if (n := counts.get(f.path, 0))]
        part = [f for f, n in matched if n < f.rows]
        if not matched:
            return DeleteResult(0, 0, len(files), 0, base.current.version)
        stage, done = self.catalog.stage(), False
        try:
            new: list[DataFile] = []
            if part:
                rest = with_place(self.spark, read_files(self.spark, self.catalog, base, part), part).where(~hit)
                new = self._write(rest.withColumnRenamed("__file", "__slice").withColumnRenamed("__row", "__order"), len(part), base, stage)
            replace = {f.path: [] for f, _ in matched} | {f.path: [g] for f, g in zip(part, new)}
            table = self.catalog.commit(base, replace=replace)
            done = bool(new)
        finally:
            if not done:
                self.catalog.drop_stage(stage)
        return DeleteResult(sum(n for _, n in matched), len(part), len(files) - len(matched), len(matched) - len(part), table.current.version)


def select_parquet(folder: ParquetFolder, statement: Select) -> DataFrame:
    """SELECT over a folder of Parquet tables, under the same rules."""
    bound = binder.bind_select(statement, {t.table: folder.kinds(t.table) for t in statement.tables})
    return joined([folder.frame(t.table) for t in statement.tables], bound)
