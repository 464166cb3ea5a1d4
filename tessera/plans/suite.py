"""The registered queries of the language, and their SQL."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.types import type_of
from tessera.operators.engine import Engine, select_parquet
from tessera.operators.relational import counters
from tessera.plans.binder import bind_select
from tessera.plans.parser import parse
from tessera.sources.csv_text import result_lines
from tessera.sources.log_records import Log
from tessera.sources.tables import ParquetFolder

#: FROM ... WHERE ... of queries that mean the same here and in DuckDB.
PLAIN = {
    "scan_all": "customer",
    "filter_eq_string": "customer WHERE c_mktsegment = 'BUILDING'",
    "filter_lt_string": "customer WHERE c_mktsegment < 'BUILDING'",
    "filter_gt_string": "customer WHERE c_mktsegment > 'FURNITURE'",
    "filter_eq_long": "part WHERE p_size = 15",
    "filter_lt_long": "orders WHERE o_custkey < 100",
    "filter_gt_long": "orders WHERE o_custkey > 1400",
    "filter_eq_double": "lineitem WHERE l_discount = 0.05",
    "filter_lt_double": "lineitem WHERE l_quantity < 5.0",
    "filter_gt_double": "orders WHERE o_totalprice > 400000.0",
    "filter_and": "lineitem WHERE l_quantity > 10.0 AND l_quantity < 20.0 AND l_returnflag = 'R'",
    "join2": "orders, customer WHERE o_custkey = c_custkey",
    "join2_filtered": "orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING'",
    "join3": "supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "join4": "lineitem, orders, customer, nation WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' AND l_quantity > 45.0",
    "join_extra_eq": "customer, supplier, nation WHERE c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND c_nationkey = n_nationkey",
}
SELF = {"self_join": "supplier s1, supplier s2 WHERE s1.s_nationkey = s2.s_nationkey", "self_join_extra": "supplier s1, supplier s2 WHERE s1.s_nationkey = s2.s_nationkey AND s1.s_name = s2.s_name"}
_SUPPLIER = ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
_LONG = "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier"


def _select(text: str):
    return lambda spark, sf_dir: select_parquet(ParquetFolder(spark, sf_dir), parse(f"SELECT * FROM {text};")[0])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(PLAIN["join2_filtered"])(spark, sf_dir)


def _base(spark: SparkSession) -> str:
    """A folder for a scratch database, removed at the end: in the folder that driver and executors share on a cluster."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not os.path.isdir(shared):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("The scratch database needs a mounted folder in spark.checkpoint.dir")
        shared = None
    base = tempfile.mkdtemp(prefix="tessera-", dir=shared)
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def _exported(spark: SparkSession, sf_dir: str, table: str, base: str, order: str | None = None) -> tuple[str, str]:
    """A Parquet table as one headerless CSV file, and its CREATE statement."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.orderBy(order) if order else df
    path = os.path.join(base, f"{table}.csv")
    with open(path, "w", encoding="ascii") as out:
        for row in result_lines(df).toLocalIterator():
            out.write(f"{row.line}\n")
    return path, f"CREATE TABLE {table} ({', '.join(f'{f.name} {type_of(f.dataType)}' for f in df.schema.fields)});"


def _script(table: str, *statements: str, order: str | None = None, max_rows: int = 40, hook=None):
    """A query that creates the table, runs the statements ({csv} stands for its file), and returns the last SELECT."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = _base(spark)
        csv, create = _exported(spark, sf_dir, table, base, order)
        engine = Engine(spark, os.path.join(base, "db"), max_rows=max_rows)
        engine.execute(parse(create)[0])
        out = None
        for k, text in enumerate(statements):
            if hook and k == hook[0]:
                # Another statement commits while this one is about to.
                def meanwhile():
                    engine.catalog.before_commit = None
                    engine.execute(parse(hook[1].format(csv=csv))[0])

                engine.catalog.before_commit = meanwhile
            out = engine.execute(parse(text.format(csv=csv))[0])
        return out.rows

    return query


_COPY, _ALL = "COPY supplier FROM '{csv}';", "SELECT * FROM supplier;"
WRITES = {
    "copy_roundtrip": (_script("supplier", _COPY, _ALL), _LONG),
    "copy_twice": (_script("supplier", _COPY, _COPY, _ALL), f"{_LONG} UNION ALL {_LONG}"),
    "delete_eq": (_script("supplier", _COPY, "DELETE FROM supplier WHERE s_nationkey = 7;", _ALL), f"{_LONG} WHERE NOT (s_nationkey = 7)"),
    "delete_lt": (_script("supplier", _COPY, "DELETE FROM supplier WHERE s_acctbal < 2500.5;", _ALL), f"{_LONG} WHERE NOT (s_acctbal < 2500.5)"),
    "delete_gt": (_script("supplier", _COPY, "DELETE FROM supplier WHERE s_suppkey > 30;", _ALL), f"{_LONG} WHERE NOT (s_suppkey > 30)"),
    "delete_all": (_script("supplier", _COPY, "DELETE FROM supplier;", _ALL), f"{_LONG} WHERE false"),
    "delete_noop": (_script("supplier", _COPY, "DELETE FROM supplier WHERE s_suppkey < -1;", _ALL), _LONG),
    # A COPY commits during the DELETE: its rows stay, matching ones too.
    "delete_rebase": (_script("supplier", _COPY, "DELETE FROM supplier WHERE s_suppkey < 20;", _ALL, hook=(1, _COPY)), f"{_LONG} WHERE NOT (s_suppkey < 20) UNION ALL {_LONG}"),
    "prune_sorted": (_script("supplier", _COPY, "SELECT * FROM supplier WHERE s_suppkey > 50;", order="s_suppkey", max_rows=10), f"{_LONG} WHERE s_suppkey > 50"),
}


def _counted(text: str):
    """Row counters of a SELECT over Parquet tables as rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, statement = ParquetFolder(spark, sf_dir), parse(f"SELECT * FROM {text};")[0]
        scans = [folder.frame(t.table) for t in statement.tables]
        bound = bind_select(statement, {t.table: folder.kinds(t.table) for t in statement.tables})
        rows = [tuple(asdict(c).values()) for c in counters(scans, bound, [s.count() for s in scans])]
        return spark.createDataFrame(rows, "operator string, table string, rows_in long, rows_out long, probe long, keys long")

    return query


_COUNTED = "customer, orders WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING' AND o_totalprice > 400000.0"
_COUNTED_SQL = """
    WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_totalprice > 400000.0)
    SELECT 'scan' AS operator, 'customer' AS "table", count(*) AS rows_in, count(*) AS rows_out, CAST(NULL AS BIGINT) AS probe, CAST(NULL AS BIGINT) AS keys FROM customer
    UNION ALL SELECT 'filter', 'customer', (SELECT count(*) FROM customer), count(*), NULL, NULL FROM c
    UNION ALL SELECT 'scan', 'orders', count(*), count(*), NULL, NULL FROM orders
    UNION ALL SELECT 'filter', 'orders', (SELECT count(*) FROM orders), count(*), NULL, NULL FROM o
    UNION ALL SELECT 'join', 'orders', (SELECT count(*) FROM c), (SELECT count(*) FROM c JOIN o ON c_custkey = o_custkey), (SELECT count(*) FROM o), (SELECT count(DISTINCT c_custkey) FROM c)"""


def _pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SELECT of the version it was planned on: a COPY and a DELETE commit before its rows are read."""
    base = _base(spark)
    csv, create = _exported(spark, sf_dir, "supplier", base)
    engine = Engine(spark, os.path.join(base, "db"), max_rows=40)
    for text in (create, _COPY.format(csv=csv)):
        engine.execute(parse(text)[0])
    out = engine.execute(parse(_ALL)[0])
    for text in (_COPY.format(csv=csv), "DELETE FROM supplier WHERE s_suppkey < 50;"):
        engine.execute(parse(text)[0])
    return out.rows


def _live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and classes of a log that the engine wrote and imported while it wrote on."""
    base = _base(spark)
    csv, create = _exported(spark, sf_dir, "supplier", base)
    log = Log(os.path.join(base, "engine.log"))
    engine = Engine(spark, os.path.join(base, "db"), max_rows=40, log=log)
    columns = "t STRING, session STRING, statement LONG, thread LONG, level STRING, class STRING, message STRING"
    texts = [create, _COPY.format(csv=csv), "SELECT * FROM supplier WHERE s_suppkey < 30;", f"CREATE TABLE logs ({columns});", f"COPY logs FROM '{log.path}';"]
    for log.number, text in enumerate(texts, 1):
        engine.execute(parse(text)[0])
        log("INFO", "Executor", f"statement={log.number}")
    return engine.execute(parse("SELECT * FROM logs WHERE level = 'INFO';")[0]).rows.select("statement", "level", "class", "message")


WRITES |= {
    "counters": (_counted(_COUNTED), _COUNTED_SQL),
    "snapshot_pinned": (_pinned, _LONG),
    "live_log": (_live_log, "SELECT CAST(k AS BIGINT) AS statement, 'INFO' AS level, 'Executor' AS class, 'statement=' || k AS message FROM range(1, 5) r(k)"),
    "join_from_order": (_select("nation, region, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey AND r_name = 'ASIA'"), "SELECT * FROM nation, region, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey AND r_name = 'ASIA'"),
}


def queries():
    return {k: _select(v) for k, v in {**PLAIN, **SELF}.items()} | {k: q for k, (q, _) in WRITES.items()}


def oracle_sql() -> dict[str, str]:
    both = ", ".join(f"{t}.{c} AS {t}_{c}" for t in ("s1", "s2") for c in _SUPPLIER)
    out = {k: f"SELECT * FROM {v}" for k, v in PLAIN.items()} | {k: f"SELECT {both} FROM {v}" for k, v in SELF.items()}
    return out | {k: sql for k, (_, sql) in WRITES.items()}
