"""The engine's log: writing its lines, reading them back, and timings of trials from them."""

from __future__ import annotations

import datetime
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What keeps trials apart when they are summarised.
GROUPS = ("machine_id", "run_id", "workload", "dataset", "input_order", "partition_rows", "cache_state")
SCHEMA = "time string, session string, statement long, thread long, level string, class string, message string"


def clean(message: str | None) -> str:
    """One ASCII log field: separators become spaces, other characters UTF-16 escapes."""
    out = []
    for c in message or "":
        if c in ',"\n\r':
            out.append(" ")
        elif ord(c) < 128:
            out.append(c)
        else:
            units = c.encode("utf-16-be", "surrogatepass")
            out += [f"\\u{units[i] << 8 | units[i + 1]:04X}" for i in range(0, len(units), 2)]
    return "".join(out)


class Log:
    """Seven comma-separated fields a line: time, session, statement number, thread, level, class, message."""

    def __init__(self, path: str):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        self.path, self.session, self.number = path, str(uuid.uuid4()), 0

    def __call__(self, level: str, name: str, message: str) -> None:
        now = datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S.%f")[:-3]
        with open(self.path, "a", encoding="ascii") as out:
            out.write(f"{now},{self.session},{self.number},{threading.get_ident()},{level},{name},{clean(message)}\n")


class LogError(ValueError):
    pass


def records(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of logs as rows: time, session, statement, thread, level, class, message and its name=value fields as a map.

    A line without seven fields is an error.
    """
    parts = F.split("value", ",", -1)
    names = [x.split() for x in SCHEMA.split(", ")]
    lines = spark.read.text(list(paths)).select(F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit("Malformed log record: "), "value"))).alias("p"))
    rows = lines.select(*(F.col("p")[i].cast(kind).alias(name) for i, (name, kind) in enumerate(names)))
    pairs = F.transform(F.regexp_extract_all("message", F.lit(r"(\w+=\S+)"), 1), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.instr(x, "=") + F.lit(1), F.length(x)).alias("v")))
    # Of a name that repeats the last value counts.
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return rows.withColumn("fields", F.map_from_entries(last))


def trial(log: DataFrame, *, rows: int, partitions: int, rows_out: int | None = None) -> dict:
    """Timing of one trial from records of its session: an import, or a SELECT if rows_out is given; checked against what is expected."""
    if log.where("level = 'ERROR'").limit(1).count():
        raise LogError("The log has an ERROR record")
    if log.select("session").distinct().limit(2).count() != 1:
        raise LogError("The log is not of one session")
    done = {k: [r.fields for r in log.where((F.col("class") == "Executor") & (F.col("fields")["statement"] == k)).limit(2).collect()] for k in ("CREATE_TABLE", "COPY", "SELECT")}

    def one(kind: str) -> dict:
        if len(done[kind]) != 1:
            raise LogError(f"Expected one {kind} record")
        return done[kind][0]

    if rows_out is None:
        create, copy = one("CREATE_TABLE"), one("COPY")
        if int(copy["rows"]) != rows or int(copy["partitions"]) != partitions:
            raise LogError("Imported rows or partitions are not those expected")
        return {"duration_ms": int(create["durationMs"]) + int(copy["durationMs"]), "rows_imported": rows, "partitions_total": partitions}
    select = one("SELECT")
    scans = [r.fields for r in log.where("fields['partitionsTotal'] is not null").limit(2).collect()]
    if len(scans) != 1:
        raise LogError("Expected one record of scanned partitions")
    total, read, pruned = (int(scans[0][k]) for k in ("partitionsTotal", "partitionsRead", "partitionsPruned"))
    if total != partitions or read + pruned != total or int(select["rowsOut"]) != rows_out:
        raise LogError("Selected rows or partitions are not those expected")
    return {"duration_ms": int(select["durationMs"]), "rows_out": rows_out, "partitions_total": total, "partitions_read": read, "partitions_pruned": pruned}


def summary(trials: DataFrame, *, least: int = 5) -> DataFrame:
    """Count, mean, median, minimum and maximum of duration_ms of each configuration with at least so many complete trials in a controlled cache."""
    good = trials.where("status = 'complete' and fresh_jvm and cache_state = 'controlled'")
    ms = F.col("duration_ms")
    return good.groupBy(*GROUPS).agg(F.count("*").alias("count"), F.avg(ms).alias("mean_ms"), F.median(ms).alias("median_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms")).where(F.col("count") >= least)
