"""Headerless CSV: strict typed import, and the result format."""

from __future__ import annotations

import shutil

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.types import SPARK, typed


class CsvError(ValueError):
    pass


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme; without one it is a local path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path if "://" in path else f"file://{path}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def length(spark: SparkSession, path: str) -> int:
    """Bytes that a file has now."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"No such file: {path}")
    return fs.getFileStatus(p).getLen()


def bounded_copy(spark: SparkSession, path: str, target: str, size: int) -> str:
    """Copy the first bytes of a file of any scheme: what was appended later is left out."""
    (source, p), (sink, q) = _hadoop(spark, path), _hadoop(spark, target)
    taken, given = source.open(p), sink.create(q)
    try:
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(taken, given, 0, size)
    finally:
        taken.close()
        given.close()
    return target


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(line, ordinal) of a text file, ordinals from 0 without gaps, in file order; and the number of lines.

    Rows are counted by split, so the numbering is distributed; one row a split
    reaches the driver.
    """
    # The high bits of the id are the task, so it grows within a split.
    raw = spark.read.text(path if "://" in path else f"file://{path}").select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    splits = sorted((r.block, r.first, r.n) for r in raw.groupBy("block").agg(F.min("mid").alias("first"), F.count("*").alias("n")).collect())
    shifts, at = [], 0
    for block, first, n in splits:
        shifts.append((block, at - first))
        at += n
    if not shifts:
        return raw.select("line", F.lit(0).cast("long").alias("ordinal")), 0
    # Joined by size: a few splits are broadcast, and of many none is sent to all.
    blocks, moves = zip(*shifts)
    shift = spark.createDataFrame(pa.table({"block": pa.array(blocks, pa.int64()), "shift": pa.array(moves, pa.int64())}))
    return raw.join(shift, "block").select("line", (F.col("mid") + F.col("shift")).alias("ordinal")), at


def _checked(columns: list[tuple[str, str]]) -> tuple[list[Column], list[Column]]:
    """Values of a row's fields, and for each rule why it is broken, or null; rows are (fields, ...)."""
    checks: list[Column] = [F.when(F.size("fields") != len(columns), F.concat(F.lit(f"Expected {len(columns)} fields but found "), F.size("fields").cast("string")))]
    values = []
    for i, (name, kind) in enumerate(columns):
        value, ok = typed(F.try_element_at("fields", F.lit(i + 1)), kind)
        values.append(value.alias(name))
        what = "Non-ASCII value" if kind == "STRING" else f"Invalid {kind} value"
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{what} in column {name}")))
    return values, checks


def typed_rows(lines: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """(ordinal, columns) of lines. A job that meets a bad line fails; first_error() then tells which is the first."""
    rows = lines.select("ordinal", F.split("line", ",", -1).alias("fields"), F.is_valid_utf8("line").alias("valid"), (F.octet_length("line") == F.length("line")).alias("ascii"))
    sound, out = (F.size("fields") == len(columns)) & F.col("valid") & F.col("ascii"), []
    for i, (name, kind) in enumerate(columns):
        # A line is held against ASCII as a whole: what is not fails in a field of any type.
        field = F.get("fields", F.lit(i))
        value, ok = (field, F.lit(True)) if kind == "STRING" else typed(field, kind)
        out.append(F.when(sound & ok, value).otherwise(F.raise_error(F.lit("bad line")).cast(SPARK[kind])).alias(name))
    return rows.select("ordinal", *out)


def first_error(lines: DataFrame, columns: list[tuple[str, str]], source: str) -> CsvError | None:
    """What is wrong with the first bad line, if any is."""
    rows = lines.select("ordinal", F.split("line", ",", -1).alias("fields"))
    bad = rows.select("ordinal", F.coalesce(*_checked(columns)[1]).alias("why")).where("why is not null").agg(F.min(F.struct("ordinal", "why")).alias("first")).first().first
    return None if bad is None else CsvError(f"{source} line {bad.ordinal + 1}: {bad.why}")


def result_lines(df: DataFrame) -> DataFrame:
    """One text column: values joined by commas; strings quoted only if they hold a comma, a quote or a line end."""
    shown = []
    for f in df.schema.fields:
        text = F.col(f"`{f.name}`").cast("string")
        if f.dataType.typeName() == "string":
            text = F.when(text.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
        shown.append(F.coalesce(text, F.lit("")))
    return df.select(F.concat_ws(",", *shown).alias("line"))


def remove(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)
