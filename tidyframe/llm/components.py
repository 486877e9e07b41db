"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import checkpointed

#: Keys that may hold over 1/HOT of all rows: fewer than this many, so they may be broadcast.
HOT = 20_000


def _towards_least(edges: DataFrame) -> DataFrame:
    """Each edge as (a, b) with a > b, once."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def with_least(rows: DataFrame, key: str, least: Column, into: str, total: int, pick=F.min) -> tuple[DataFrame, DataFrame]:
    """``rows``, of which there are ``total``, with the least (or by ``pick`` the largest) value of their key; and that value by key.

    Minima are combined before the shuffle. Keys that hold over 1/HOT of the rows, of which there are
    fewer than HOT, meet their rows by broadcast and so burden no task; the others are joined.
    """
    found = rows.groupBy(key).agg(pick(least).alias(into), F.count("*").alias("key_rows"))
    hot = F.col("key_rows") * HOT > total
    many, few = (found.filter(f).drop("key_rows") for f in (hot, ~hot))
    joined = rows.join(F.broadcast(many), key).unionByName(rows.join(F.broadcast(many.select(key)), key, "left_anti").join(few, key))
    return joined, found.drop("key_rows")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined, _ = with_least(both, "a", F.least("a", "b"), "m", 2 * n)
    return _towards_least(joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    joined, least = with_least(edges, "a", F.col("b"), "m", n)
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _towards_least(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: bigint); label: the least node it reaches.

    Each round is two grouped minima and joins on the shrinking edge table, written to the
    shared folder. Stops when a round changes nothing. An empty edge table gives no rows.
    """
    edges = checkpointed(_towards_least(edges))
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or mark[0] == 0:
            break
        seen = tuple(mark)
        starred = checkpointed(_large_star(edges, mark[0]))
        edges = checkpointed(_small_star(starred, starred.count()))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
