"""What the corpus operators share: batches, written intermediates, components.

Intermediates that are read twice, and the state of iterative operators, are
written to the folder in ``spark.checkpoint.dir``, so that a lost executor
costs a task and never a result. What a result still reads is removed when its
scope ends (see scope()), else when the interpreter does.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python operator holds at once, whatever Arrow's batch size is.
SLICE_ROWS = 256
#: Characters that a slice may hold unless a single text is longer.
SLICE_CHARS = 8_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode a temporary one stands in where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Memo(dict):
    """A bounded memo of make(key): two generations, the older is dropped when the younger is full."""

    def __init__(self, make: Callable, entries: int = 300_000):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


_KEPT: dict[str, tuple[int, object]] = {}


def kept(kind: str, data: bytes, make: Callable[[bytes], object]):
    """make(data), made once in a Python worker while its tasks ask with the same data; one object of a kind is kept."""
    key = hash(data)
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT[kind] = key, make(data)
    return _KEPT[kind][1]


#: Stores whose tables are still there, and those made in each open scope.
_STORES: dict[str, "Written"] = {}
_SCOPES: list[list["Written"]] = []


class Written:
    """Tables written to the shared folder, dropped when no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.n = 0
        self.frames: dict[int, tuple[DataFrame, str]] = {}
        self.fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        _STORES[self.base] = self
        for made in _SCOPES[-1:]:
            made.append(self)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def write(self, df: DataFrame, **options) -> DataFrame:
        """Write df and read it back: what follows does not recompute df."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.frames[id(out)] = out, path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.fs.delete(self._path(self.frames.pop(id(df))[1]), True)

    def close(self) -> None:
        """Drop all tables; nothing that reads them may run afterwards."""
        self.frames.clear()
        _STORES.pop(self.base, None)
        self.fs.delete(self._path(self.base), True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Tables of the stores that operators make inside are dropped at the end: write results inside."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for store in _SCOPES.pop():
            store.close()


@atexit.register
def _close_all() -> None:
    for store in list(_STORES.values()):
        with contextlib.suppress(Exception):  # the JVM may be gone
            store.close()


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of bounded rows and, by column text, bounded size."""
    for batch in batches:
        at = 0
        sizes = None if text is None else batch.column(text)
        while at < batch.num_rows:
            n = min(SLICE_ROWS, batch.num_rows - at)
            if sizes is not None:
                while n > 1 and batch.slice(at, n).column(text).nbytes > SLICE_CHARS:
                    n //= 2
            yield batch.slice(at, n)
            at += n


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, text: str | None = None) -> DataFrame:
    """Map slices of df (a dict of columns as Python lists) to rows of schema.

    make() is called once for each task and returns the function for slices.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        f = make()
        for part in slices(batches, text):
            out = f({name: part.column(i) if isinstance(part.column(i), pa.lib.ListArray) else part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(k).type) for k, v in ((k, out[k]) for k in arrow.names)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_texts(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema, text: str) -> DataFrame:
    """Map bounded slices of df's Arrow batches, by the size of column text, to batches of schema."""
    return df.mapInArrow(lambda batches: map(run, slices(batches, text)), schema)


def connected_components(edges: DataFrame, store: Written, *, u: str = "u", v: str = "v", limit: int = 64) -> DataFrame:
    """Components of an undirected graph, as (node, component): the smallest node.

    Alternates large-star and small-star steps: each joins a node's neighbours
    to their minimum, so that no task ever holds a node's neighbours together;
    minima are combined before the shuffle, and written, as are the links: the
    joins then have plain exchanges on both sides, and adaptive execution can
    split a hub's links over tasks. Self loops and repeated edges are allowed,
    null ends are ignored. Each step is written out.
    """
    # greatest() and least() pass over nulls, so these go first.
    e = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    e = store.write(e)
    for _ in range(limit):
        if _settled(e):
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = store.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        lows = store.write(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lows.select("u", F.col("m").alias("v"))).distinct()
        new = store.write(small)
        store.drop(e, least, large, lows)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _settled(e: DataFrame) -> bool:
    """Whether edges (u, v) are stars: no u has two rows or is a v. Repeated edges are not settled."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("rows"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("rows").alias("rows"), F.max("root").alias("root"))
    return nodes.where("rows > 1 or rows = 1 and root = 1").agg(F.count("*")).first()[0] == 0
