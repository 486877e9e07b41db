"""Records of delimited text whose quoted fields hold line ends, from splits of any size.

A line changes one thing only: whether the text after it is inside quotes. What it does from outside
and from inside is told by the line alone. These steps compose, so that a split's effect is one row;
the effects of all splits of a file, taken in order, tell how each split begins, and lines are then
joined to records by many tasks. Records that span splits are put together from their pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import checkpointed

#: Encodings in which line ends, quotes and delimiters are the bytes they are in ASCII.
_PLAIN = ("utf-8", "utf8", "us-ascii", "ascii", "iso-8859", "latin", "windows-125", "cp125")
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'


def splittable(encoding: str) -> bool:
    return encoding.lower().replace("_", "-").startswith(_PLAIN)


def field_edge(delimiter: str) -> str:
    """A pattern for the start of a field."""
    return "(^|\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E)"


def without_quoted(line: Column, delimiter: str) -> Column:
    """The line without its complete quoted fields; what follows a closing quote up to the next delimiter stays."""
    return F.regexp_replace(line, f'{field_edge(delimiter)}"{_INSIDE}"', "$1")


def _opens(line: Column, delimiter: str) -> Column:
    """Whether a line that begins outside quotes ends inside them."""
    return without_quoted(line, delimiter).rlike(f'{field_edge(delimiter)}"')


def _lines(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame:
    """(file, start, value, opens, stays): lines in order within their split; opens, stays: inside after it, from outside and from inside.

    Lines end at a line feed; carriage returns are part of the value.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    if not encoding.lower().replace("_", "-").startswith(("utf-8", "utf8")):
        text = text.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    text = text.withColumn("value", F.when((F.col("start") == 0) & F.col("value").startswith("\ufeff"), F.expr("substring(value, 2)")).otherwise(F.col("value")))
    line, quoted = F.col("value"), F.col("value").contains('"')
    closed = line.rlike(f'^{_INSIDE}"')
    rest = F.concat(F.lit("x"), F.regexp_replace(line, f'^{_INSIDE}"', ""))  # what follows a closing quote starts no field
    return text.select("file", "start", "value", (quoted & _opens(line, delimiter)).alias("opens"), (~quoted | ~closed | _opens(rest, delimiter)).alias("stays"))


def _after(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """Whether the text is inside quotes after each line: what the last line that settles it says, turned by each line since that swaps."""
    settles = opens == stays
    last = np.maximum.accumulate(np.where(settles, np.arange(len(opens)), -1))
    swaps = np.cumsum(opens & ~stays)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return np.where(last >= 0, opens[last], inside) ^ (since % 2 == 1)


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """A batch's parts by split."""
    file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield (int(file[a]), int(start[a])), batch.slice(a, b - a)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, opens, stays): the effect of each split's lines together."""
    found: dict[tuple[int, int], tuple[bool, bool]] = {}
    for batch in batches:
        for key, part in _cut(batch):
            opens, stays = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            found[key] = tuple(bool(_after(opens, stays, before)[-1]) for before in found.get(key, (False, True)))
    columns = zip(*[(*k, *v) for k, v in found.items()]) if found else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.bool_()))], ["file", "start", "opens", "stays"])


def split_starts(spark: SparkSession, path: str, delimiter: str, encoding: str) -> DataFrame | None:
    """(file, start) of the splits that begin inside quotes; None if no quoted field holds a line end anywhere."""
    lines = _lines(spark, path, delimiter, encoding).select("file", "start", "opens", "stays")
    if not lines.filter("opens").take(1):
        return None
    effects = lines.mapInArrow(_effects, "file bigint, start bigint, opens boolean, stays boolean")
    # one row a split: what the last split before that settles it says, turned by each split since that swaps
    order = Window.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("opens") & ~F.col("stays")).cast("int")).over(order), F.lit(0))
    marked = effects.withColumn("swaps", swaps).withColumn("settled", F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").alias("value"), "swaps")))
    last, upto = F.last("settled", ignorenulls=True).over(earlier), F.coalesce(F.lag("swaps").over(order), F.lit(0))
    inside = F.coalesce(last["value"], F.lit(False)) != ((upto - F.coalesce(last["swaps"], F.lit(0))) % 2 == 1)
    return checkpointed(marked.withColumn("inside", inside).filter("inside").select("file", "start", "inside"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, head, piece, file, start) of (file, start, opens, stays, value, inside): a split's records, and the pieces of those it has in part.

    piece is null for a whole record, 0 for the end of one that began earlier, 1 for what such a one has
    of a split without its end, 2 for the beginning of one; head marks a file's first record.
    """
    key, held, inside, begun, first = None, [], False, True, False

    def out(values: list | pa.Array, piece: int | None, head: list[bool] | None = None) -> pa.RecordBatch:
        n = len(values)
        columns = [pa.array(values, pa.string()) if isinstance(values, list) else values, pa.array(head or [False] * n), pa.array([piece] * n, pa.int32()), pa.array([key[0]] * n, pa.int64()), pa.array([key[1]] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["value", "head", "piece", "file", "start"])

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield out(["\n".join(held)], 2 if begun else 1, [first and begun])

    for batch in batches:
        for own, part in _cut(batch):
            if own != key:
                yield from rest()
                key, held, inside = own, [], part.column(5)[0].as_py()
                begun, first = not inside, own[1] == 0
            opens, stays = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            after, lines = _after(opens, stays, inside), part.column(4)
            ends, at = np.flatnonzero(~after), 0
            if len(ends) and (held or not begun):
                at = int(ends[0]) + 1
                yield out(["\n".join(held + lines[:at].to_pylist())], None if begun else 0, [first and begun])
                held, begun, first, ends = [], True, False, ends[1:]
            if len(ends):
                offsets = np.concatenate(([at], ends + 1)).astype(np.int32)
                at = int(offsets[-1])
                whole = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n") if len(ends) < at - offsets[0] else lines[offsets[0] : at]
                whole = whole.filter(pc.invert(pc.is_in(whole, pa.array(["", "\r"]))))
                yield out(whole, None, [first] + [False] * (len(whole) - 1) if len(whole) else [])
                first = first and not len(whole)
            held += lines[at:].to_pylist()
            inside = bool(after[-1])
    yield from rest()


def records(spark: SparkSession, path: str, delimiter: str, encoding: str, starts: DataFrame) -> DataFrame:
    """(value, head): the records of all files, with the line ends inside their quotes; head marks each file's first.

    ``starts`` is what ``split_starts`` gave, a row at most for each split. Blank lines are no records. A
    quoted field that never ends takes the rest of its file.
    """
    lines = _lines(spark, path, delimiter, encoding)
    joined = lines.join(F.broadcast(starts), ["file", "start"], "left").select("file", "start", "opens", "stays", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    made = joined.mapInArrow(_records, "value string, head boolean, piece int, file bigint, start bigint")
    # two pieces a split at most: a beginning, then what follows until the next beginning
    number = F.sum((F.col("piece") == 2).cast("int")).over(Window.partitionBy("file").orderBy("start", "piece"))
    parts = F.array_sort(F.collect_list(F.struct("start", "piece", "value", "head")))
    spanning = made.filter("piece is not null").withColumn("record", number).groupBy("file", "record").agg(parts.alias("p"))
    spanning = spanning.select(F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"), F.exists("p", lambda x: x["head"]).alias("head"))
    return made.filter("piece is null").select("value", "head").unionByName(spanning).withColumn("value", F.regexp_replace("value", "\r$", ""))
