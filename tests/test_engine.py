"""Statements against versioned tables, transactions, CSV and the command line."""

import dataclasses
import io
import json
import os
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import run
from tessera.operators.engine import Engine, select_parquet
from tessera.plans.binder import BindError
from tessera.plans.parser import parse
from tessera.sources.csv_text import CsvError, result_lines
from tessera.sources.log_records import GROUPS, LogError, clean, records, summary, trial
from tessera.sources.manifest import Catalog, ConflictError
from tessera.sources.tables import ParquetFolder, ScanStats

TRIPS = "Copenhagen,12,23.5\nAarhus,187,301.0\nOdense,95,120.75\nCopenhagen,140,210.0\nAalborg,210,340.5\nRoskilde,31,45.0\nCopenhagen,88,99.99\nEsbjerg,299,450.25\n"
CREATE = "CREATE TABLE trips (city STRING, distance LONG, price DOUBLE);"


@pytest.fixture
def db(spark, tmp_path):
    def made(csv=TRIPS, create=CREATE, max_rows=2, **kw):
        path = tmp_path / "in.csv"
        path.write_bytes(csv.encode())
        e = Engine(spark, str(tmp_path / "db"), max_rows=max_rows, **kw)
        e.go = lambda sql: e.execute(parse(sql)[0])
        e.csv = str(path)
        e.go(create)
        e.go(f"COPY {create.split()[2]} FROM '{path}';")
        return e

    return made


def rows(q):
    return [tuple(r) for r in q.ordered.collect()]


def test_nine_predicates_pruning_and_order(db):
    e = db()
    for where, expected in {
        "city = 'Copenhagen'": [12, 140, 88], "city < 'Copenhagen'": [187, 210], "city > 'Copenhagen'": [95, 31, 299], "distance = 95": [95], "distance < 95": [12, 31, 88],
        "distance > 100": [187, 140, 210, 299], "price = 45.0": [31], "price < 50.0": [12, 31], "price > 45.0": [187, 95, 140, 210, 88, 299],
    }.items():
        assert [r[1] for r in rows(e.go(f"SELECT * FROM trips WHERE {where};"))] == expected, where
    assert e.go("SELECT * FROM trips WHERE distance > 1000;").stats == [ScanStats(4, 0, 4)]
    assert [f.stats["distance"] for f in e.catalog.get("trips").current.files] == [[12, 187], [95, 140], [31, 210], [88, 299]]
    assert [r.line for r in result_lines(e.go("SELECT * FROM trips WHERE distance > 200;").ordered).collect()] == ["Aalborg,210,340.5", "Esbjerg,299,450.25"]


def test_delete_agrees_with_select(db):
    e = db()
    for where in ("city = 'Copenhagen'", "distance < 95", "price > 300.0"):
        before = rows(e.go("SELECT * FROM trips;"))
        gone = rows(e.go(f"SELECT * FROM trips WHERE {where};"))
        done = e.go(f"DELETE FROM trips WHERE {where};")
        assert done.deleted == len(gone) and rows(e.go("SELECT * FROM trips;")) == [r for r in before if r not in gone]
    version = e.catalog.get("trips").current.version
    assert e.go("DELETE FROM trips WHERE distance = 12345;").version == version
    assert e.go("DELETE FROM trips;").version == version + 1 and rows(e.go("SELECT * FROM trips;")) == []


@pytest.mark.parametrize("zero,other", [("-0.0", "0.0"), ("0.0", "-0.0")])
def test_signed_zeros_and_nan(db, zero, other):
    e = db(csv=f"{zero}\n{zero}\n{zero}\nNaN\n", create="CREATE TABLE z (p DOUBLE);", max_rows=10)
    assert len(rows(e.go(f"SELECT * FROM z WHERE p = {other};"))) == 3
    assert len(rows(e.go("SELECT * FROM z WHERE p > 1.5;"))) == 1 and not rows(e.go("SELECT * FROM z WHERE p < 0.0;"))
    assert len(rows(e.go("SELECT * FROM z a, z b WHERE a.p = b.p;"))) == 10


def test_joins(db, tmp_path):
    e = db(csv="100,Anna,Bike,1\n101,Bob,Helmet,2\n102,Carol,Bike,1\n103,Anna,Helmet,1\n", create="CREATE TABLE orders (o_orderkey LONG, o_custname STRING, o_prodname STRING, o_quantity LONG);", max_rows=1)
    for name, spec, csv in (("products", "p_name STRING, p_price DOUBLE", "Bike,2999.0\nHelmet,299.0\n"), ("customers", "c_name STRING, c_city STRING", "Anna,Copenhagen\nBob,Aarhus\nCarol,Copenhagen\n"), ("cities", "ct_city STRING, ct_country STRING, ct_population LONG", "Copenhagen,Denmark,1400000\nAarhus,Denmark,290000\n")):
        (tmp_path / f"{name}.csv").write_text(csv)
        e.go(f"CREATE TABLE {name} ({spec});")
        e.go(f"COPY {name} FROM '{tmp_path}/{name}.csv';")
    count = lambda s: len(rows(e.go(s)))
    assert count("SELECT * FROM orders, customers, products, cities WHERE o_custname = c_name AND o_prodname = p_name AND c_city = ct_city;") == 4
    q = e.go("SELECT * FROM orders, customers, products WHERE o_custname = c_name AND o_prodname = p_name AND c_city = 'Copenhagen';")
    assert len(rows(q)) == 3 and q.stats == [ScanStats(4, 4, 0), ScanStats(3, 2, 1), ScanStats(2, 2, 0)]
    assert q.rows.columns == ["o_orderkey", "o_custname", "o_prodname", "o_quantity", "c_name", "c_city", "p_name", "p_price"]
    assert count("SELECT * FROM customers c1, customers c2 WHERE c1.c_city = c2.c_city;") == 5
    assert count("SELECT * FROM customers c1, customers c2 WHERE c1.c_city = c2.c_city AND c2.c_name = c1.c_name;") == 3
    with pytest.raises(BindError, match="No join predicate connects cities"):
        e.go("SELECT * FROM orders, cities, customers WHERE o_custname = c_name AND c_city = ct_city;")


def test_ingest_is_strict_and_whole(db, tmp_path):
    e = db(csv="1,\n", create="CREATE TABLE t (id LONG, name STRING);")
    assert rows(e.go("SELECT * FROM t;")) == [(1, "")]
    files = sorted(os.listdir(e.catalog.data))
    for bad, line in (("1,a\n2,b\nx,c\n", 3), ("3\n", 1), ("1,a,b\n", 1), ("1,ø\n", 1), ("9223372036854775808,a\n", 1), (" 5,a\n", 1), ("\n", 1)):
        (tmp_path / "bad.csv").write_bytes(bad.encode())
        with pytest.raises(CsvError, match=f"line {line}:"):
            e.go(f"COPY t FROM '{tmp_path}/bad.csv';")
    assert sorted(os.listdir(e.catalog.data)) == files and e.catalog.get("t").current.version == 1
    (tmp_path / "none.csv").write_text("")
    assert e.go(f"COPY t FROM '{tmp_path}/none.csv';").version == 2


def test_partitions_hold_exact_slices(db):
    e = db(csv="".join(f"{i}\n" for i in range(1001)), create="CREATE TABLE n (i LONG);", max_rows=1000)
    assert [f.rows for f in e.catalog.get("n").current.files] == [1000, 1] and [r[0] for r in rows(e.go("SELECT * FROM n;"))] == list(range(1001))


def test_rebase_and_conflict(db, tmp_path):
    e = db(csv="1,A\n2,B\n3,C\n4,D\n", create="CREATE TABLE t (id LONG, name STRING);")
    (tmp_path / "more.csv").write_text("1,E\n5,F\n")

    def during(sql):
        def hook():
            e.catalog.before_commit = None
            e.go(sql)

        e.catalog.before_commit = hook

    pinned = e.go("SELECT * FROM t;")
    during(f"COPY t FROM '{tmp_path}/more.csv';")
    assert e.go("DELETE FROM t WHERE id = 1;").version == 3
    assert [r[0] for r in rows(e.go("SELECT * FROM t;"))] == [2, 3, 4, 1, 5]
    assert [r[0] for r in rows(pinned)] == [1, 2, 3, 4]
    during("DELETE FROM t WHERE id = 3;")
    with pytest.raises(ConflictError) as c:
        e.go("DELETE FROM t WHERE id = 4;")
    assert (c.value.base_version, c.value.current_version) == (3, 4)
    during("DELETE FROM t WHERE id = 2;")
    e.go("DELETE FROM t WHERE id = 5;")
    assert [r[0] for r in rows(e.go("SELECT * FROM t;"))] == [4, 1]
    assert [r[0] for r in rows(Engine(e.spark, e.catalog.folder).execute(parse("SELECT * FROM t;")[0]))] == [4, 1]


def test_outcomes_of_races(db, tmp_path):
    """Statements on two threads that both have read before either commits: all pairs of COPY and DELETE."""
    (tmp_path / "more.csv").write_text("1,E\n5,F\n")
    copy, low, high, both = f"COPY t FROM '{tmp_path}/more.csv';", "DELETE FROM t WHERE id = 1;", "DELETE FROM t WHERE id = 4;", "DELETE FROM t WHERE id > 1;"
    for k, (first, second, ids) in enumerate([(copy, copy, [1, 2, 3, 4, 1, 5, 1, 5]), (low, copy, [2, 3, 4, 1, 5]), (low, high, [2, 3]), (both, high, None), (low, both, None)]):
        e = Engine(db(csv="1,A\n2,B\n3,C\n4,D\n", create=f"CREATE TABLE t{k} (id LONG, name STRING);").spark, str(tmp_path / f"race{k}"), max_rows=2)
        e.go = lambda sql, e=e: e.execute(parse(sql)[0])
        e.go("CREATE TABLE t (id LONG, name STRING);")
        (tmp_path / "in.csv").write_text("1,A\n2,B\n3,C\n4,D\n")
        e.go(f"COPY t FROM '{tmp_path}/in.csv';")
        gate, turn, failed = threading.Barrier(2, timeout=120), threading.Event(), []
        here = threading.local()

        def before():
            gate.wait()
            if not here.first:
                assert turn.wait(120)

        e.catalog.before_commit = before

        def go(sql, first):
            here.first = first
            try:
                e.go(sql)
            except ConflictError as c:
                failed.append((first, c.base_version, c.current_version))
            finally:
                if first:
                    turn.set()

        threads = [threading.Thread(target=go, args=(sql, first)) for sql, first in ((first, True), (second, False))]
        [t.start() for t in threads]
        [t.join(180) for t in threads]
        e.catalog.before_commit = None
        got = sorted(r[0] for r in e.go("SELECT * FROM t;").rows.collect())
        if ids is None:
            assert failed == [(False, 1, 2)] and e.catalog.get("t").current.version == 2
        else:
            assert not failed and got == sorted(ids) and e.catalog.get("t").current.version == 3
        left = {f.path.split("/")[0] for s in (e.catalog.get("t").current, e.catalog.get("t").previous) for f in s.files}
        assert {x for x in os.listdir(e.catalog.data)} >= left


def test_appended_lines_are_left_out(db, tmp_path, monkeypatch):
    from tessera.sources import csv_text

    e = db(csv="1\n2\n", create="CREATE TABLE t (i LONG);")
    grown, real, asked = tmp_path / "grown.csv", csv_text.length, []
    grown.write_text("3\n4\n")

    def length(spark, path):
        n = real(spark, path)
        if not asked:  # right after its length was taken
            with open(grown, "a") as f:
                f.write("5\nbad\n")
        asked.append(n)
        return n

    monkeypatch.setattr(csv_text, "length", length)
    assert e.go(f"COPY t FROM '{grown}';").rows == 2 and len(asked) == 2
    assert sorted(r[0] for r in rows(e.go("SELECT * FROM t;"))) == [1, 2, 3, 4]
    with pytest.raises(CsvError, match="line 4: Invalid LONG"):
        e.go(f"COPY t FROM 'file://{grown}';")
    with pytest.raises(FileNotFoundError):
        e.go(f"COPY t FROM '{tmp_path}/none.csv';")


def test_version_overflow_comes_before_publication(db):
    e = db()
    t = e.catalog.get("trips")
    last = 2**63 - 1
    e.catalog.tables["trips"] = dataclasses.replace(t, current=dataclasses.replace(t.current, version=last), previous=dataclasses.replace(t.previous, version=last - 1))
    files = sorted(os.listdir(e.catalog.data))
    for sql in (f"COPY trips FROM '{e.csv}';", "DELETE FROM trips WHERE distance = 12;", "DELETE FROM trips;"):
        with pytest.raises(OverflowError):
            e.go(sql)
    assert sorted(os.listdir(e.catalog.data)) == files and e.catalog.get("trips").current.version == last


DAMAGED = {
    "not JSON": lambda t: "{",
    "no object": lambda t: [],
    "an unsupported format": lambda t: t | {"format": 9},
    "no id": lambda t: {k: v for k, v in t.items() if k != "id"},
    "another id": lambda t: t | {"id": "0" * 32},
    "no columns": lambda t: t | {"columns": []},
    "an unknown type": lambda t: t | {"columns": [["a", "DATE"]]},
    "a gap in its history": lambda t: t | {"current": t["current"] | {"version": 7}},
    "a path outside": lambda t: _file(t, path="../x.parquet"),
    "a lost file": lambda t: _file(t, path="stage-0/x.parquet"),
    "no rows": lambda t: _file(t, rows=0),
    "statistics of another type": lambda t: _file(t, stats=t["current"]["files"][0]["stats"] | {"distance": ["1", "2"]}),
    "statistics the wrong way round": lambda t: _file(t, stats=t["current"]["files"][0]["stats"] | {"distance": [2, 1]}),
    "NaN below a number": lambda t: _file(t, stats=t["current"]["files"][0]["stats"] | {"price": [{"double": "nan"}, {"double": "1.0"}]}),
    "a column without statistics": lambda t: _file(t, stats={}),
}


def _file(t, **change):
    files = t["current"]["files"]
    return t | {"current": t["current"] | {"files": [files[0] | change, *files[1:]]}}


def test_damaged_manifests_are_refused(db):
    e = db()
    path = os.path.join(e.catalog.catalogs, f"{e.catalog.get('trips').id}.json")
    with open(path) as f:
        good = f.read()
    for what, change in DAMAGED.items():
        bad = change(json.loads(good))
        with open(path, "w") as f:
            f.write(bad if isinstance(bad, str) else json.dumps(bad))
        with pytest.raises(ValueError):
            Catalog(e.catalog.folder)
            pytest.fail(what)
    with open(path, "w") as f:
        f.write(good)
    assert Catalog(e.catalog.folder).get("trips") == e.catalog.get("trips")


def test_counters_of_operators(db, tmp_path):
    e = db()
    (tmp_path / "c.csv").write_text("Copenhagen,1\nCopenhagen,2\nOdense,3\nRibe,4\n")
    e.go("CREATE TABLE cities (name STRING, n LONG);")
    e.go(f"COPY cities FROM '{tmp_path}/c.csv';")
    got = e.analyze(parse("SELECT * FROM cities, trips WHERE city = name AND distance < 150;")[0])
    assert [dataclasses.astuple(c) for c in got] == [("scan", "cities", 4, 4, None, None), ("scan", "trips", 8, 8, None, None), ("filter", "trips", 8, 5, None, None), ("join", "trips", 4, 7, 5, 3)]


def test_statistics_without_footers(db):
    e = db(csv=f"NaN,{'x' * 3000}\n1.0,{'y' * 3000}\n", create="CREATE TABLE z (p DOUBLE, s STRING);", max_rows=10)
    (f,) = e.catalog.get("z").current.files
    assert f.stats["p"][0] == 1.0 and f.stats["p"][1] != f.stats["p"][1] and f.stats["s"] == ["x" * 3000, "y" * 3000]


def test_timings_from_logs(spark, tmp_path):
    log = str(tmp_path / "engine.log")
    (tmp_path / "a.csv").write_text(TRIPS)
    go = lambda sql: run(["-c", sql], io.StringIO(), io.StringIO(), data=str(tmp_path / "db"), log_path=log, spark=spark)
    assert go(f"CREATE TABLE trips (city STRING, distance LONG, price DOUBLE); COPY trips FROM '{tmp_path}/a.csv';") == 0
    took = trial(records(spark, log), rows=8, partitions=1)
    assert took["duration_ms"] > 0 and took["rows_imported"] == 8
    os.rename(log, f"{log}.1")
    assert go("SELECT * FROM trips WHERE distance > 100;") == 0
    took = trial(records(spark, log), rows=8, partitions=1, rows_out=4)
    assert (took["rows_out"], took["partitions_total"], took["partitions_read"], took["partitions_pruned"]) == (4, 1, 1, 0)
    for wrong in ({"rows_out": 5}, {"rows_out": 4, "partitions": 2}, {}):
        with pytest.raises(LogError):
            trial(records(spark, log), **{"rows": 8, "partitions": 1, **wrong})
    with pytest.raises(LogError, match="one session"):
        trial(records(spark, log, f"{log}.1"), rows=8, partitions=1)
    assert go("SELECT * FROM missing_table;") == 1
    with pytest.raises(LogError, match="ERROR"):
        trial(records(spark, log), rows=8, partitions=1, rows_out=4)
    # The session, the statement and the errors, as SQL over the imported log.
    both = records(spark, log)
    failed = both.where("level = 'ERROR'").first()
    assert "missing_table" in failed.message and both.where(f"session = '{failed.session}'").count() > 1 and failed.statement == 1
    (tmp_path / "odd.log").write_text("a,b\n")
    with pytest.raises(Exception, match="Malformed log record"):
        records(spark, str(tmp_path / "odd.log")).collect()
    base = dict.fromkeys(GROUPS, "g") | {"cache_state": "controlled", "status": "complete", "fresh_jvm": True}
    trials = [base | {"duration_ms": d, "repetition": k} for k, d in enumerate([5, 1, 4, 2, 9])] + [base | {"dataset": "few", "duration_ms": 1, "repetition": 0}, base | {"status": "failed", "duration_ms": 99, "repetition": 9}]
    (r,) = summary(spark.createDataFrame(trials)).collect()
    assert (r["count"], r.mean_ms, r.median_ms, r.min_ms, r.max_ms) == (5, 4.2, 4.0, 1, 9)


def test_killed_before_the_rename_leaves_the_old_version(tmp_path):
    code = f"""
import os
from tessera.sources.manifest import Catalog
c = Catalog({str(tmp_path)!r}); t = c.create('t', [('a', 'LONG')]); c.commit(t)
os.makedirs(os.path.join(c.data, c.stage())); os.replace = lambda *a: os._exit(37)
c.commit(c.get('t'))
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 37
    c = Catalog(str(tmp_path))
    assert c.get("t").current.version == 1 and os.listdir(c.data) == [] and len(os.listdir(c.catalogs)) == 1


def test_command_line(spark, tmp_path):
    def go(*args):
        out, err = io.StringIO(), io.StringIO()
        code = run(list(args), out, err, data=str(tmp_path / "db"), log_path=str(tmp_path / "logs/engine.log"), spark=spark)
        return code, out.getvalue(), err.getvalue()

    (tmp_path / "a.csv").write_text("1,A,1.0\n2,B,2.0\n3,C,3.0\n4,D,4.0\n")
    assert go()[0] == 0 and go("-x")[0] == 1 and go("SELECT")[0] == 1 and not (tmp_path / "db").exists()
    (tmp_path / "s.sql").write_text(f"CREATE TABLE tx (id LONG, city STRING, price DOUBLE); COPY tx FROM '{tmp_path}/a.csv'; DELETE FROM tx WHERE id < 3; SELECT * FROM tx; SELECT * FROM no; DELETE FROM tx;")
    code, out, err = go("-f", str(tmp_path / "s.sql"))
    assert (code, out, err) == (1, "3,C,3.0\n4,D,4.0\n", "Unknown table: no\n")
    assert go("-c", "SELECT * FROM tx WHERE price > 3.5") == (0, "4,D,4.0\n", "")
    log = (tmp_path / "logs/engine.log").read_text().splitlines()
    assert all(len(x.split(",")) == 7 for x in log) and any("statement=DELETE table=tx rowsDeleted=2 partitionsRewritten=1 partitionsCarried=0 partitionsRemoved=0 version=2 durationMs=" in x for x in log)
    # The live log is a source as well.
    code, out, _ = go("CREATE TABLE logs (t STRING, s STRING, n LONG, th LONG, l STRING, c STRING, m STRING); " + f"COPY logs FROM '{tmp_path}/logs/engine.log'; SELECT * FROM logs WHERE l = 'ERROR'")
    assert code == 0 and len(out.splitlines()) >= 3
    assert clean('a,"b\n😀') == "a  b \\uD83D\\uDE00"


def test_result_quoting(spark):
    df = spark.createDataFrame([('a"b', 1, -0.0), ("x,y", 2, 1e10)], "s string, n long, d double")
    assert sorted(r.line for r in result_lines(df).collect()) == ['"a""b",1,-0.0', '"x,y",2,1.0E10']


def test_numbers_are_parsed_strictly(spark):
    import re

    from tessera.functions.types import typed

    signs, ends = ["", "+", "-"], ["", " ", "\t", "\x00", "\x7f", "\n", " "]
    longs = ["0", "7", "9223372036854775807", "9223372036854775808", "1.0", "1e3", "", "-", "0x1", "1L", "1_0", "٣", "1 2"]
    doubles = [*longs, ".5", "5.", ".", "1e", "1e5", "1e999", "1f", "1D", "0x1p3", "0x1", "NaN", "nan", "Infinity", "inf", "INFINITY", "1,0"]
    texts = sorted({a + s + x + z for x in longs + doubles for s in signs for a in ends for z in ends})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    strict = re.compile(r"[\x00-\x20]*[+-]?(NaN|Infinity|(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|0[xX]([0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?)[\x00-\x20]*")
    value, ok = typed(df.t, "LONG")
    for r in df.select("t", value.alias("v"), ok.alias("ok")).collect():
        good = re.fullmatch("[+-]?[0-9]+", r.t, re.A) is not None and -(2**63) <= int(r.t) < 2**63
        assert r.ok == good and (not good or r.v == int(r.t)), repr(r.t)
    value, ok = typed(df.t, "DOUBLE")
    for r in df.select("t", value.alias("v"), ok.alias("ok")).collect():
        assert r.ok == (strict.fullmatch(r.t) is not None) and (not r.ok or r.v is not None), repr(r.t)


def test_joins_of_few_keys_use_all_tasks(spark, tmp_path):
    """Two one-file tables of two keys: 200 times 300 rows a key are made by many tasks, none of which makes most."""
    spark.range(400).selectExpr("id AS a", "id % 2 AS k").coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(600).selectExpr("id AS b", "id % 2 AS l").coalesce(1).write.parquet(str(tmp_path / "u.parquet"))
    spark.range(2).selectExpr("id AS m", "'x' AS x").coalesce(1).write.parquet(str(tmp_path / "v.parquet"))
    rows = select_parquet(ParquetFolder(spark, str(tmp_path)), parse("SELECT * FROM t, u, v WHERE k = l AND l = m AND k = m;")[0])
    assert rows.columns == ["a", "k", "b", "l", "m", "x"] and rows.where("k <> l OR l <> m").count() == 0
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 120_000 and len(counts) >= spark.sparkContext.defaultParallelism and max(counts) < 60_000
