"""Where SELECT finds tables: versioned ones of a catalog, or a folder of Parquet tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.types import SPARK, may_match, type_of
from tessera.plans.parser import Predicate
from tessera.sources.manifest import Catalog, DataFile, Table


@dataclass(frozen=True)
class ScanStats:
    total: int
    read: int
    pruned: int


def spark_schema(table: Table) -> T.StructType:
    return T.StructType([T.StructField(n, SPARK[k]) for n, k in table.columns])


def prune(files: tuple[DataFile, ...], filters: list[Predicate], log=None) -> list[DataFile]:
    """Files whose statistics do not rule out any filter, in scan order.

    log(index, predicate or None, low, high, pruned) is told each check.
    """
    kept = []
    for k, f in enumerate(files):
        out = False
        if not filters and log:
            log(k, None, None, None, False)
        for p in filters:
            low, high = f.stats[p.column.name]
            out = not may_match(p.op, p.constant, low, high)
            if log:
                log(k, p, low, high, out)
            if out:
                break
        if not out:
            kept.append(f)
    return kept


def read_files(spark: SparkSession, catalog: Catalog, table: Table, files: list[DataFile]) -> DataFrame:
    """Rows of some files; the frame is pinned to them."""
    if not files:
        return spark.createDataFrame([], spark_schema(table))
    return spark.read.schema(spark_schema(table)).parquet(*(os.path.join(catalog.data, f.path) for f in files))


def file_key() -> Column:
    """The manifest's path of the file that a row of read_files is from: its last four parts."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -4)


def footers(catalog: Catalog, paths: list[str], columns: list[str]) -> dict[str, DataFile]:
    """Files by path, with the statistics of their footers; without those that lack some, as NaN or long strings do."""
    out = {}
    for path in paths:
        meta = pq.read_metadata(os.path.join(catalog.data, path))
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        stats = [[g.column(i).statistics for g in groups] for i in range(len(columns))]
        if groups and all(s is not None and s.has_min_max for xs in stats for s in xs):
            out[path] = DataFile(path, meta.num_rows, {n: [min(s.min for s in xs), max(s.max for s in xs)] for n, xs in zip(columns, stats)})
    return out


def with_place(spark: SparkSession, df: DataFrame, files: list[DataFile]) -> DataFrame:
    """df of read_files with __file (position among files) and __row (place in the file)."""
    names = spark.createDataFrame(pa.table({"__name": pa.array([f.path for f in files], pa.string()), "__file": pa.array(range(len(files)), pa.int32())}))
    placed = df.select("*", file_key().alias("__name"), F.col("_metadata.row_index").alias("__row"))
    # Joined by size: the names of a few files are broadcast, those of very many are not.
    return placed.join(names, "__name").drop("__name")


class ParquetFolder:
    """Read-only tables <name>.parquet of a folder. Integers are LONG, other types are carried along."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.frames = spark, folder, {}

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            self.frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.frames[name]

    def kinds(self, name: str) -> list[tuple[str, str | None]]:
        return [(f.name, type_of(f.dataType)) for f in self.frame(name).schema.fields]
