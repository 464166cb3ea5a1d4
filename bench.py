"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

(50 MB) of headerless CSV, then select distance > 900.
"""

from __future__ import annotations

import json
import os
import random
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from tessera.operators.engine import Engine
from tessera.plans import suite
from tessera.plans.parser import parse

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
QUERIES = ("scan_all", "filter_eq_double", "filter_gt_double", "filter_and", "join2", "join3", "join4", "self_join", "join_extra_eq")
ROWS = 1_785_714


def trips(path: str) -> None:
    rng = random.Random(42)
    with open(path, "w", encoding="ascii") as out:
        for _ in range(ROWS):
            out.write(f"City{rng.randrange(10):02d},{rng.randrange(1000):010d},{rng.randrange(1_000_000) / 100:07.2f}\n")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run, took = suite.queries(), {}
    for name in QUERIES:
        best = []
        for _ in range(3):
            began = time.perf_counter()
            run[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(sorted(best)[1], 3)
    base = tempfile.mkdtemp(prefix="bench-")
    try:
        trips(f"{base}/trips.csv")
        # Of each partition size the second import and selection count, as the reference's JVM is measured without its start.
        for label, max_rows in (("", 250_000), ("_65536", 65_536)):
            for k in range(2):
                engine = Engine(spark, f"{base}/db{label}{k}", max_rows=max_rows)
                began = time.perf_counter()
                engine.execute(parse("CREATE TABLE trips (city STRING, distance LONG, price DOUBLE);")[0])
                engine.execute(parse(f"COPY trips FROM '{base}/trips.csv';")[0])
                took[f"trips_import{label}"] = round(time.perf_counter() - began, 3)
                for _ in range(2):
                    began = time.perf_counter()
                    engine.execute(parse("SELECT * FROM trips WHERE distance > 900;")[0]).rows.write.format("noop").mode("overwrite").save()
                    took[f"trips_select{label}"] = round(time.perf_counter() - began, 3)
    finally:
        shutil.rmtree(base, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
