"""Command line: ``python -m tessera [-c SQL | -f FILE | SQL]``."""

from __future__ import annotations

import sys
import time

from tessera.operators.engine import Engine, session
from tessera.plans.parser import Copy, Create, Delete, SqlParseError, Statement, parse
from tessera.sources.csv_text import result_lines
from tessera.sources.log_records import Log

USAGE = "Usage: tessera -c \"SQL\" | tessera -f FILE | tessera \"SQL\"\n"
DATA, LOG = "database", "logs/engine.log"


def script_of(args: list[str]) -> str | None:
    """The script that the arguments give; None if they are wrong."""
    if len(args) == 1 and not args[0].startswith("-") or len(args) == 2 and args[0] == "-c":
        sql = args[-1].strip()
        return sql if sql.endswith(";") else f"{sql};"
    if len(args) == 2 and args[0] == "-f":
        try:
            with open(args[1], encoding="utf-8") as f:
                return f.read()
        except OSError as e:
            raise ValueError(f"Cannot read SQL file {args[1]}") from e
    return None


def run_statement(engine: Engine, statement: Statement, out) -> str:
    """Run one statement, write a SELECT's rows to out, and describe what was done."""
    done = engine.execute(statement)
    if isinstance(statement, Create):
        return f"statement=CREATE_TABLE table={statement.table} rowsOut=0 version=0"
    if isinstance(statement, Copy):
        return f"statement=COPY table={statement.table} rows={done.rows} partitions={done.partitions} version={done.version}"
    if isinstance(statement, Delete):
        return f"statement=DELETE table={statement.table} rowsDeleted={done.deleted} partitionsRewritten={done.rewritten} partitionsCarried={done.carried} partitionsRemoved={done.removed} version={done.version}"
    n = 0
    for row in result_lines(done.ordered).toLocalIterator(prefetchPartitions=True):
        out.write(f"{row.line}\n")
        n += 1
    for ref, s in zip(statement.tables, done.stats):
        engine.log("DEBUG", "Executor", f"table={ref.exposed} partitionsTotal={s.total} partitionsRead={s.read} partitionsPruned={s.pruned}")
    return f"statement=SELECT table={'+'.join(t.table for t in statement.tables)} rowsOut={n} version={'+'.join(map(str, done.versions))}"


def run(args: list[str], out, err, *, data: str = DATA, log_path: str = LOG, spark=None) -> int:
    log = Log(log_path)
    log("DEBUG", "Engine", "operation=start")
    try:
        if not args:
            out.write(USAGE)
            return 0
        try:
            sql = script_of(args)
        except ValueError as e:
            log("ERROR", "Engine", f"operation=arguments error={e}")
            err.write(f"{e}\n")
            return 1
        if sql is None:
            log("ERROR", "Engine", "operation=arguments error=Invalid command-line arguments")
            err.write(USAGE)
            return 1
        try:
            statements = parse(sql)
        except SqlParseError as e:
            log("ERROR", "Engine", f"operation=parse error={e}")
            err.write(f"{e}\n")
            return 1
        try:
            engine = Engine(spark or session(), data, log=log)
            for log.number, statement in enumerate(statements, 1):
                began = time.monotonic()
                summary = run_statement(engine, statement, out)
                log("INFO", "Executor", f"{summary} durationMs={int((time.monotonic() - began) * 1000)}")
        except Exception as e:  # the first failure ends the script; what was committed stays
            log("ERROR", "Engine", f"operation=execute errorType={type(e).__name__} error={e}")
            err.write(f"{e}\n")
            return 1
        return 0
    finally:
        log.number = 0
        log("DEBUG", "Engine", "operation=stop")


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], sys.stdout, sys.stderr))
