"""The three column types, their Spark types, literals and comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK = {"STRING": T.StringType(), "LONG": T.LongType(), "DOUBLE": T.DoubleType()}
LITERALS = {"STRING": str, "LONG": int, "DOUBLE": float}
_DOUBLE = r"^[\x00-\x20]*[+-]?(?:NaN|Infinity|(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|0[xX](?:[0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?)[\x00-\x20]*$"


def type_of(data_type: T.DataType) -> str | None:
    """Type class of a Spark type; None for types that can be carried but not compared."""
    if isinstance(data_type, T.IntegralType):
        return "LONG"
    return {T.StringType: "STRING", T.DoubleType: "DOUBLE"}.get(type(data_type))


def accepts(kind: str | None, constant) -> bool:
    return kind is not None and type(constant) is LITERALS[kind]


def compare(column: Column, op: str, constant) -> Column:
    """column op constant. A zero DOUBLE equals both zeros by name: Parquet dictionaries tell them apart."""
    if op == "=" and isinstance(constant, float) and constant == 0.0:
        return (column == F.lit(0.0)) | (column == F.lit(-0.0))
    value = F.lit(constant)
    return column == value if op == "=" else column < value if op == "<" else column > value


def typed(text: Column, kind: str) -> tuple[Column, Column]:
    """(value, ok) of a CSV field: strictly typed text, ASCII strings, no blanks around numbers of type LONG."""
    if kind == "STRING":
        return text, ~text.rlike(r"[^\x00-\x7F]")
    value = text.try_cast(SPARK[kind])
    if kind == "LONG":
        # Apart from blanks and control characters at its ends a cast takes signs and digits only.
        inner = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
        return value, F.coalesce(value.isNotNull() & inner, F.lit(False))
    # What a cast makes a finite number of is one in Java's grammar; other names of NaN and infinity are not.
    value = F.coalesce(value, F.when(text.rlike(_DOUBLE), F.regexp_replace(text, r"[\x00-\x20]", "").try_cast(SPARK[kind])))
    return value, F.coalesce(value.isNotNull() & ((F.abs(value) < float("inf")) | text.rlike(_DOUBLE)), F.lit(False))


def may_match(op: str, constant, low, high) -> bool:
    """Whether a column between low and high can hold a value for which ``value op constant``."""
    key = _key(constant)
    if op == "=":
        return _key(low) <= key <= _key(high)
    return _key(low) < key if op == "<" else _key(high) > key


def _key(value):
    """Order of values: NaN above everything, both zeros equal."""
    if isinstance(value, float):
        return (1, 0.0) if value != value else (0, value + 0.0)
    return (0, value)
