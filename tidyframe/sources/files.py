"""Delimited text, JSON lines and Parquet, with type inference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..dtypes import FALSE_TOKENS, NA_TOKENS, TRUE_TOKENS, label, name, physical, unused
from .quoted import records, split_starts, splittable, without_quoted

#: Keys of JSON lines that may become columns.
MOST_KEYS = 10_000
_INT = r"^[+-]?\d{1,19}$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# The date forms that are recognised.
_DATE_FORMATS = (("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$"), ("yyyy/MM/dd HH:mm:ss", r"^\d{4}/\d\d/\d\d \d\d:\d\d:\d\d$"), ("yyyy-MM-dd HH:mm", r"^\d{4}-\d\d-\d\d \d\d:\d\d$"), ("yyyy-MM-dd", r"^\d{4}-\d\d-\d\d$"))
_OFFSET = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"


def null_tokens(c: Column) -> Column:
    """Texts that stand for a missing value as null; others untouched."""
    return F.when(~F.trim(c).isin(*NA_TOKENS), c)


def parse_datetime(c: Column) -> Column:
    """RFC 3339 with an offset, or one of the plain forms, as a timestamp; else null."""
    t = F.trim(c)
    plain = [F.when(t.rlike(form), F.try_to_timestamp(t, F.lit(pattern))) for pattern, form in _DATE_FORMATS]
    return F.coalesce(F.when(t.rlike(_OFFSET), F.try_to_timestamp(t)), *plain)


def _parsed(c: Column, kind: str) -> Column:
    t = F.trim(c)
    if kind == "bigint":
        return F.when(t.rlike(_INT), t.try_cast("bigint"))
    if kind == "double":
        return F.when(t.rlike(_FLOAT), t.try_cast("double"))
    if kind == "boolean":
        return F.when(t.isin(*TRUE_TOKENS), True).when(t.isin(*FALSE_TOKENS), False)
    if kind == "timestamp":
        return parse_datetime(c)
    return c


def cast_inferred(df: DataFrame, kinds: dict[str, str], tokens: bool = True) -> DataFrame:
    """Text columns as these kinds; values that do not parse become missing."""
    clean = null_tokens if tokens else lambda c: c
    return df.select(*[(_parsed(clean(name(c)), kinds[c]) if c in kinds else name(c)).alias(c) for c in df.columns])


_ORDER = ("bigint", "double", "boolean", "timestamp")


def _tests(columns: list[str]) -> list[Column]:
    """Aggregates that tell which kinds all present values of each column are of."""
    tests = [F.bool_and(null_tokens(name(c)).isNull() | _parsed(name(c), k).isNotNull()).alias(f"{i}_{k}") for i, c in enumerate(columns) for k in _ORDER]
    return [*tests, *[F.count(null_tokens(name(c))).alias(f"{i}_n") for i, c in enumerate(columns)]]


def _kinds(columns: list[str], found: Row) -> dict[str, str]:
    return {c: next((k for k in _ORDER if found[f"{i}_n"] and found[f"{i}_{k}"]), "string") for i, c in enumerate(columns)}


def infer_kinds(df: DataFrame, sample: int | None = None) -> dict[str, str]:
    """For each text column the first of bigint, double, boolean, timestamp that all its present values are; else string.

    All rows are looked at, in one aggregate, so that a cast by these kinds loses nothing. With
    ``sample`` only that many, whichever Spark reads first: values that do not fit become missing.
    """
    columns = [f.name for f in df.schema if label(f.dataType) == "string"]
    if not columns:
        return {}
    rows = df.select(*[name(c) for c in columns])
    rows = rows if sample is None else rows.limit(sample)
    return _kinds(columns, rows.agg(*_tests(columns)).first())


def infer_types(df: DataFrame, sample: int | None = None, tokens: bool = True) -> DataFrame:
    return cast_inferred(df, infer_kinds(df, sample), tokens)


def _unrepeated(names: list[str]) -> list[str]:
    """Repeats, in whatever case, get _2, _3, ...; empty names are col_1, col_2, ... by position."""
    seen, out = set(), []
    for i, n in enumerate(names):
        base = n or f"col_{i + 1}"
        new, k = base, 1
        while new.lower() in seen:
            k += 1
            new = f"{base}_{k}"
        seen.add(new.lower())
        out.append(new)
    return out


def _texts(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _looked_at(records: Callable[..., DataFrame], delimiter: str, names: list[str], tests: bool) -> tuple[int, dict[str, str]]:
    """Most fields of any record, at least as many as ``names``, and with ``tests`` the kinds of these, in one pass.

    The reader itself cuts the records and hands on the text of those with another number of
    fields; in these, delimiters are counted once quoted fields are taken out.
    """
    (odd,) = unused(names, "_odd")
    rows = records([*names, odd], columnNameOfCorruptRecord=odd)
    bare = without_quoted(name(odd), delimiter)
    fields = (F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))) / len(delimiter) + 1
    every = F.count(F.coalesce(*[name(c) for c in names]))  # a reader asked for fewer columns counts no fields
    found = rows.agg(F.max(fields).alias("most"), every.alias("every"), *(_tests(names) if tests else [])).first()
    return max(len(names), int(found["most"] or 0)), _kinds(names, found) if tests else {}


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", has_header: bool = True, infer: bool = True, multi_line: bool | None = None, sample: int | None = None, width: int | None = None) -> DataFrame:
    """Delimited text with quoted fields and ragged rows.

    Short rows are filled with missing, surplus fields are columns col_{i+1}. Types come from all
    rows, in the pass that finds the most fields of a row; ``sample`` limits how many are looked at
    for types, ``width`` gives the fields. Line ends in quotes stay as they are; files that hold such
    are split like others, for one more pass over the lines (``multi_line=False``: there are none). Only
    files in an encoding of wider units than bytes are read by one task each. A quote inside an
    unquoted field is a character like any other. Names that differ in case only count as repeats.
    """
    options = {"sep": delimiter, "encoding": encoding, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    starts = split_starts(spark, path, delimiter, encoding) if splittable(encoding) and multi_line is not False else None
    whole_files = str(not splittable(encoding) or starts is not None).lower()
    reader = spark.read.options(**options, enforceSchema="true", multiLine=whole_files)
    first = reader.options(header="false").csv(path).limit(1)
    head = first.first()
    named = [str(v) if v is not None else "" for v in head] if head and has_header else []
    if named:
        named[0] = named[0].lstrip("\ufeff")
    names, kinds = _unrepeated(named or [""] * len(head or ())), None
    joined = records(spark, path, delimiter, encoding, starts) if starts is not None else None
    if joined is not None and has_header:
        joined = joined.filter("not head")

    def parsed(columns: list[str], **more: str) -> DataFrame:
        if joined is None:
            return spark.read.options(**options, enforceSchema="true", multiLine=whole_files, header=str(has_header).lower(), nullValue="", **more).schema(_texts(columns)).csv(path)
        return joined.select(F.from_csv("value", _texts(columns).toDDL(), options | {"multiLine": "true", "nullValue": ""} | more).alias("record")).select("record.*")

    if width is None:
        width, kinds = _looked_at(parsed, delimiter, names, infer and sample is None) if names else (0, {})
    every = _unrepeated([*named, *[""] * max(0, width - len(named))])
    df = parsed(every)
    if not infer:
        return df
    if not kinds:
        return infer_types(df, sample)
    return cast_inferred(df, kinds | (infer_kinds(df.select(*[name(c) for c in every[len(names) :]])) if len(every) > len(names) else {}))


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, delimiter="\t", **options)


def read_jsonl(spark: SparkSession, path: str, infer: bool = True, sample: int | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
    """JSON lines: the union of all keys as columns, in order of name.

    Types are inferred from all rows, in one aggregate, or from the first ``sample`` if given.
    Blank lines are skipped; a line that is no object is the column ``value``; nested values are
    JSON text. Bad JSON is an error when the rows are read. Keys that differ in case only are
    columns of their own, the later ones numbered; more than ``most_keys`` keys are refused.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bad = F.raise_error(F.concat(F.lit("bad JSON: "), F.col("value")))
    whole = F.col("value").try_cast("string")
    checked = lines.select(F.when(F.try_parse_json(whole).isNull() & (F.trim("value") != "null"), bad).otherwise(F.trim("value")).alias("value"))
    is_object = F.col("value").startswith("{")
    pairs = F.when(is_object, F.from_json("value", "map<string,string>")).otherwise(F.create_map(F.lit("value"), F.when(F.col("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")).otherwise(F.col("value"))))
    mapped = checked.select(pairs.alias("m"))
    keys = sorted(r[0] for r in mapped.select(F.explode(F.map_keys("m"))).distinct().limit(most_keys + 1).collect())
    if len(keys) > most_keys:
        raise ValueError(f"more than {most_keys} keys: raise the limit, or keep the lines as text")
    rows = mapped.select(*[F.col("m").getItem(k).alias(c) for k, c in zip(keys, _unrepeated(keys))])
    return infer_types(rows, sample, tokens=False) if infer else rows


def normalize_types(df: DataFrame) -> DataFrame:
    """Integers as bigint, floats as double, dates and timestamps as timestamps in whole milliseconds."""
    def wide(f: T.StructField) -> Column:
        c = name(f.name)
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c.cast("double")
        elif label(f.dataType) == "datetime":
            c = F.date_trunc("millisecond", c.cast("timestamp"))
        return c.alias(f.name)

    return df.select(*[wide(f) for f in df.schema])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalize_types(spark.read.parquet(path))


def dataset_info(df: DataFrame) -> DataFrame:
    """A row for each column: position, name, dtype, label, and the table's rows and columns."""
    one = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(physical(f.dataType)).alias("dtype"), F.lit(label(f.dataType)).alias("label")) for i, f in enumerate(df.schema)])
    return df.agg(F.count("*").alias("row_count")).select(F.inline(one), "row_count", F.lit(len(df.columns)).alias("column_count"))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Header, missing as an empty field, white space kept, datetimes as YYYY-MM-DD HH:MM:SS, rows in the order given."""
    shown = [F.date_format(name(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name) if label(f.dataType) == "datetime" else name(f.name) for f in df.schema]
    out = df.select(*shown)
    (out.coalesce(1) if single_file else out).write.option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Snappy Parquet; datetimes in milliseconds without a zone."""
    plain = [F.date_trunc("millisecond", name(f.name)).cast("timestamp_ntz").alias(f.name) if label(f.dataType) == "datetime" else name(f.name) for f in df.schema]
    df.select(*plain).write.option("compression", "snappy").parquet(path)


