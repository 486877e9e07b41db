"""Column kinds, missing values, cell text and literals."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Texts that stand for a missing value, and for booleans.
NA_TOKENS = ("", "NA", "N/A", "na", "n/a", "NULL", "null", "NaN", "nan", "None", "-")
TRUE_TOKENS = ("true", "True", "TRUE", "1", "yes", "Yes", "YES")
FALSE_TOKENS = ("false", "False", "FALSE", "0", "no", "No", "NO")

_PHYSICAL = {"integer": "int64", "float": "float64", "string": "utf8", "boolean": "bool", "datetime": "datetime"}


def name(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{column.replace('`', '``')}`")


def unused(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores after it until no column has it, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def label(kind: T.DataType) -> str:
    """integer, float, string, boolean, datetime, or Spark's own name for other types."""
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return kind.simpleString()


def physical(kind: T.DataType) -> str:
    return _PHYSICAL.get(label(kind), kind.simpleString())


def kind_of(df: DataFrame, column: str) -> T.DataType:
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; there are {df.columns}")
    return df.schema[column].dataType


def may_be_nan(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def missing(df: DataFrame, column: str) -> Column:
    """Whether a cell is missing: null, or NaN in float columns."""
    c = name(column)
    return c.isNull() | F.isnan(c) if may_be_nan(kind_of(df, column)) else c.isNull()


def present(df: DataFrame, column: str) -> Column:
    """The cell, with NaN as null."""
    c = name(column)
    return F.when(~F.isnan(c), c) if may_be_nan(kind_of(df, column)) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def format_cell(df: DataFrame, column: str) -> Column:
    """A cell's text: datetimes as YYYY-MM-DD HH:MM:SS, missing as null."""
    c, kind = present(df, column), kind_of(df, column)
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if label(kind) == "datetime":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def group_key(df: DataFrame, column: str) -> Column:
    """The cell as something that Spark can group by: NaN as null, maps as their entries in order, other types that hold maps as JSON."""
    kind = kind_of(df, column)
    if isinstance(kind, T.MapType) and not holds_map(kind.keyType) and not holds_map(kind.valueType):
        return F.array_sort(F.map_entries(name(column)))
    return F.to_json(name(column)) if holds_map(kind) else present(df, column)


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return True
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind)
    return isinstance(kind, T.ArrayType) and holds_map(kind.elementType)


def py_literal(text: Any) -> Any:
    """What a typed parameter means: booleans, null and numbers by their form, all else text."""
    if not isinstance(text, str):
        return text
    if text in ("true", "True"):
        return True
    if text in ("false", "False"):
        return False
    if text in ("None", "null"):
        return None
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", text):
        return float(text)
    return text


def exact_number(value: Any) -> Column:
    """A number as a whole or decimal literal, exactly as written; a double only where 38 digits do not hold it."""
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        raise ValueError(f"{value!r} is no number") from None
    if not number.is_finite():
        return F.lit(float(number))
    if number == number.to_integral_value() and -(1 << 63) <= number < 1 << 63:
        return F.lit(int(number))
    plain = Decimal(format(number, "f"))
    _, digits, exponent = plain.as_tuple()
    return F.lit(plain) if max(len(digits), -exponent) <= 38 else F.lit(float(number))


def is_exact(kind: T.DataType) -> bool:
    """Whole and decimal numbers, which a double may not hold."""
    return isinstance(kind, (T.IntegralType, T.DecimalType))


def typed_literal(kind: T.DataType, value: Any) -> Column:
    """A literal of a column's kind; a value that isn't one raises ValueError. Decimals compare with what is written."""
    what = label(kind)
    if isinstance(kind, T.DecimalType):
        return exact_number(value)
    if what == "boolean":
        if str(value) not in ("true", "True", "1", "false", "False", "0"):
            raise ValueError(f"{value!r} is no boolean")
        return F.lit(str(value) in ("true", "True", "1"))
    if what == "integer":
        return exact_number(int(str(value).strip()))
    if what == "float":
        return F.lit(float(value))
    if what == "datetime":
        if isinstance(value, (dt.datetime, dt.date)):
            return F.lit(value)
        text = str(value).strip()
        if re.fullmatch(r"-?\d+", text):
            return F.timestamp_millis(F.lit(int(text)))
        moment = dt.datetime.fromisoformat(text.replace("/", "-"))
        moment = moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)
        return F.timestamp_micros(F.lit(int(moment.timestamp() * 1_000_000)))
    return F.lit(str(value))
