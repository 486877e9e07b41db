"""Exact duplicates by content sort.

Sampled splitters range-partition the rows on (the normalised text's first PREFIX_CHARS characters,
its SHA-256, id): equal texts follow each other however many they are, and a large group spreads
over as many partitions as its share asks for. Each partition is sorted by content (Spark's
external sort) and walked once, comparing whole texts of neighbours. A run that touches its
partition's edge keeps its text, and is joined to the next partition's first run if the whole
texts are equal. The prefix and the digest keep the splitters small; they decide only where rows
go, never what is equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import checkpointed, name, shuffle_partitions, unused

PREFIX_CHARS = 64
_COLUMNS = "doc_id bigint, sha binary, part int, run int, size bigint, least bigint, most bigint, place bigint, edge int, text string"
#: Bits of ``edge``: the run begins, ends its partition.
_BEGINS, _ENDS = 1, 2


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, sha, text) of a sorted partition, with the run of equal texts each is in.

    Of an open run only copies of its ids are held, and its text once. The first row of a run at
    an edge has its text.
    """
    part = TaskContext.get().partitionId()
    run, ids, text, sha = 0, [], None, None

    def closed(edge: int) -> pa.RecordBatch:
        own = pa.concat_arrays(ids)
        ends = pc.min_max(own)
        n = len(own)
        same = lambda v, t: pa.repeat(pa.scalar(v, t), n)
        shown = pa.concat_arrays([pa.array([text if edge else None], pa.string()), pa.nulls(n - 1, pa.string())])
        return pa.RecordBatch.from_arrays(
            [own, same(sha, pa.binary()), same(part, pa.int32()), same(run, pa.int32()), same(n, pa.int64()), same(ends["min"].as_py(), pa.int64()), same(ends["max"].as_py(), pa.int64()), pa.array(np.arange(n)), same(edge, pa.int32()), shown],
            ["doc_id", "sha", "part", "run", "size", "least", "most", "place", "edge", "text"],
        )

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        doc, digest, texts = (b.column(i) for i in range(3))
        changed = np.flatnonzero(~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)) + 1
        for s, e in zip([0, *changed.tolist()], [*changed.tolist(), n]):
            if not ids or s or not texts[s].as_py() == text:
                if ids:
                    yield closed(_BEGINS if run == 0 else 0)
                    run += 1
                ids, text, sha = [], texts[s].as_py() if e == n or run == 0 else None, digest[s].as_py()
            ids.append(doc.take(pa.array(np.arange(s, e))))  # a copy, so that the batch can go
    if ids:
        yield closed(_ENDS + (_BEGINS if run == 0 else 0))


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] = lambda c: c, keep: str = "least", partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Rows are equal if their normalised whole texts are; ``keep`` is least or most: which id
    stays. Null text counts as empty. Of rows that repeat the id that stays, one is kept. Null ids
    come first in the order; they stay only where a group has no other. An empty table gives
    no rows; further columns are left out. Ids are integers. A very long text is held once, at most
    thrice in a partition.
    """
    n = partitions or shuffle_partitions(docs.sparkSession)
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "text", F.substring("text", 1, PREFIX_CHARS).alias("prefix"))
    order = (F.col("doc_id").asc_nulls_first(),) if keep == "most" else (F.col("doc_id").desc_nulls_first(),)
    dealt = rows.repartitionByRange(n, "prefix", "sha", *order).sortWithinPartitions("prefix", "sha", "text", *order)
    runs = checkpointed(dealt.select("doc_id", "sha", "text").mapInArrow(_runs, _COLUMNS))
    # at most two runs of a partition touch its edges; where a run's whole text is the next one's they are one group
    edges = runs.filter("edge > 0 and place = 0")
    placed = edges.select("part", "run", "size", "least", "most").withColumn("at", F.row_number().over(Window.orderBy("part", "run")))  # two rows a partition, without texts
    texts = edges.select("part", "run", "text").join(F.broadcast(placed.select("part", "run", "at")), ["part", "run"]).select("at", "text")
    joins = texts.join(texts.select((F.col("at") + 1).alias("at"), F.col("text").alias("before")), "at").filter(F.col("text") == F.col("before")).select("at", F.lit(0).alias("fresh"))
    grouped = placed.join(F.broadcast(joins), "at", "left").withColumn("text_group", F.sum(F.coalesce("fresh", F.lit(1))).over(Window.orderBy("at")))
    of_text = Window.partitionBy("text_group")
    whole = grouped.select("part", "run", F.sum("size").over(of_text).alias("all_size"), F.min("least").over(of_text).alias("all_least"), F.max("most").over(of_text).alias("all_most"), (F.row_number().over(of_text.orderBy(F.desc("at"))) == 1).alias("last"))
    stays = F.coalesce(F.col("all_most"), F.col("most")) if keep == "most" else F.coalesce(F.col("all_least"), F.col("least"))
    joined = runs.drop("text").join(F.broadcast(whole), ["part", "run"], "left")  # two rows a partition at most
    return joined.select(
        "doc_id",
        stays.alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        ((F.col("place") == F.col("size") - 1) & F.coalesce("last", F.lit(True))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] = lambda c: c, keep: str = "least", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay.

    Rows that repeat the id and text of the row that stays count as its copies and go. Null and
    empty texts are one group. An empty table gives no rows; no column's name can clash.
    """
    k, number = unused(docs.columns, "_key", "_n")
    groups = exact_duplicates(docs, normalise, keep, id_col=id_col, text_col=text_col, **options)
    key = lambda doc, sha: F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), sha)
    kept = groups.filter("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias(k))
    sha = F.sha2(normalise(F.coalesce(F.col(text_col), F.lit(""))), 256)
    found = docs.withColumn(k, key(F.col(id_col).cast("bigint"), sha)).join(kept, k, "left_semi")
    once = found.withColumn(number, F.row_number().over(Window.partitionBy(k).orderBy(k)))
    return once.filter(F.col(number) == 1).select(*[name(c) for c in docs.columns])
