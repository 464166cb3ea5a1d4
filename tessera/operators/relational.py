"""SELECT as one DataFrame: scans, filters at their scans, equi-joins in FROM order.

Only acceptance follows FROM order. Of the tables that are connected, the
smallest is joined next, so that a join of many rows with many comes late. Small
tables are broadcast, and a small first table is dealt over all cores: where few
keys join many rows, tasks by the input's size or by key would be few, however
large the result is. Catalyst and adaptive execution choose the rest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import compare
from tessera.plans.binder import BoundSelect


#: Bytes, as Spark estimates them, up to which a table is broadcast, and a first table dealt over tasks; tasks a core then.
BROADCAST, DEALT, TASKS = 8 << 20, 64 << 20, 4


def output_names(entries: list[tuple[str, list[str]]]) -> list[list[str]]:
    """A column's own name where it is unique over FROM, else exposed_column."""
    every = [c for _, columns in entries for c in columns]
    return [[c if every.count(c) == 1 else f"{name}_{c}" for c in columns] for name, columns in entries]


def filtered(scan: DataFrame, filters) -> DataFrame:
    conditions = [compare(F.col(f"`{column.name}`"), p.op, p.constant) for column, p in filters]
    return scan.where(reduce(Column.__and__, conditions)) if conditions else scan


@dataclass(frozen=True)
class Counter:
    """Rows that an operator took and gave. A join's rows_in are those of its left side, probe those of its right, keys its left side's different keys."""

    operator: str
    table: str
    rows_in: int
    rows_out: int
    probe: int | None = None
    keys: int | None = None


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def counters(scans: list[DataFrame], bound: BoundSelect, sizes: list[int]) -> list[Counter]:
    """Row counters of a SELECT: each entry's scan and filter, and each join with what stands before it; sizes: rows of the scans."""
    out, names = [], bound.resolver.names
    before = 0
    for e, scan in enumerate(scans):
        out.append(Counter("scan", names[e], sizes[e], sizes[e]))
        rows = sizes[e]
        if bound.filters[e]:
            rows = filtered(scan, bound.filters[e]).count()
            out.append(Counter("filter", names[e], sizes[e], rows))
        if not e:
            before = rows
            continue
        left = joined(scans[:e], bound)
        places = [a.index for a, _ in bound.joins[e]]
        keys = left.select(*(F.col(f"`{left.columns[i]}`").alias(f"k{k}") for k, i in enumerate(places))).distinct().count()
        after = joined(scans[: e + 1], bound).count()
        out.append(Counter("join", names[e], before, after, rows, keys))
        before = after
    return out


def joined(scans: list[DataFrame], bound: BoundSelect) -> DataFrame:
    """The filtered scans joined; columns in FROM order under their output names."""
    names = output_names([(n, s.columns) for n, s in zip(bound.resolver.names, scans)])
    # Each scan under names of its own: a self-join needs no aliases, and reuses the exchange.
    inner = [[f"__{e}_{i}" for i in range(len(s.columns))] for e, s in enumerate(scans)]
    starts = [0]
    for s in scans:
        starts.append(starts[-1] + len(s.columns))
    sides = [filtered(s, bound.filters[e]).toDF(*inner[e]) for e, s in enumerate(scans)]
    at = lambda c: F.col(inner[c.entry][c.index - starts[c.entry]])
    on = [(a, b) for pairs in bound.joins[: len(scans)] for a, b in pairs]
    sizes, seen, out = [_bytes(x) for x in sides], {0}, sides[0]
    small = [n <= BROADCAST for n in sizes]
    if any(small[1:]) and sizes[0] <= DEALT:
        out = out.repartition(TASKS * out.sparkSession.sparkContext.defaultParallelism)
    while len(seen) < len(sides):
        near = {x.entry for a, b in on for x, y in ((a, b), (b, a)) if y.entry in seen and x.entry not in seen}
        e = min(near, key=lambda x: (sizes[x], x))
        both = [at(a) == at(b) for a, b in on if e in (a.entry, b.entry) and {a.entry, b.entry} <= seen | {e}]
        out = out.join(F.broadcast(sides[e]) if small[e] else sides[e], reduce(Column.__and__, both), "inner")
        seen.add(e)
    return out.select(*(F.col(i).alias(n) for e in range(len(scans)) for i, n in zip(inner[e], names[e])))
