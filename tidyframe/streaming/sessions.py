"""Sessions of events by key, on tables and on streams alike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..dtypes import group_key, kind_of, label, missing, name, present
from ..session import shared_folder


def sessions(df: DataFrame, at: str, gap: float, by: Sequence[str] = (), value: str | None = None, delay: float | None = None) -> DataFrame:
    """(by..., session_start, last_event, events, total): runs of a key's events at most ``gap`` seconds apart.

    total adds up the present numbers of ``value``. A missing key is a key; events without a moment are left out. On a stream a
    session comes out once the watermark, ``delay`` seconds behind the latest event, has passed its end, and events that are later
    than that are left out. For any order of arrival within the delay the sessions are those of the whole table; what is still
    open comes with the events that move the watermark on.
    """
    if label(kind_of(df, at)) != "datetime":
        raise ValueError(f"{at} holds no datetimes")
    if df.isStreaming and delay is None:
        raise ValueError("a stream needs the delay after which an event is too late")
    keys = [f"k{i}" for i in range(len(by))]
    number = present(df, value).cast("double") if value is not None else F.lit(None).cast("double")
    cells = [group_key(df, c).alias(k) for c, k in zip(by, keys)]
    rows = df.filter(~missing(df, at)).select(name(at).cast("timestamp").alias("at"), *cells, number.alias("value"))
    if delay is not None:
        rows = rows.withWatermark("at", f"{round(delay * 1000)} milliseconds")
    found = rows.groupBy(F.session_window("at", f"{round(gap * 1_000_000)} microseconds").alias("w"), *keys).agg(F.max("at").alias("last_event"), F.count("*").alias("events"), F.sum("value").alias("total"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.col("w.start").alias("session_start"), "last_event", "events", "total")


def all_available(stream: DataFrame, name: str = "stream") -> DataFrame:
    """What a stream gives for all the input that is there now, from the shared folder; it is run to its end."""
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
