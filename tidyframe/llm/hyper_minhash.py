"""HyperMinHash near-duplicates: documents whose sets of word shingles are similar.

A set's distinct shingle hashes are dealt to REGISTERS buckets by their first bits. Of the least
hash in a bucket its register keeps the number of leading zeros and the MANTISSA bits after the
leading one, 16 bits together. Empty buckets take the register of a bucket drawn for them, so that
small sets too have registers that agree as often as the sets are similar. BANDS bands of registers
are bucket keys; two sets at the similarity share none with a probability of 6e-11. In a bucket,
pairs whose estimated similarity, corrected for registers that agree by chance, is far too low are
left out (one in 1e9 of those at the similarity); what remains connects candidates. These are then
compared by their whole sets, and only pairs that reach the similarity are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components, with_least
from .shared import checkpointed, shared_folder, slices
from .simhash import TILE, linked_sets, shingle_hashes, shingles_of, text_hash

REGISTERS, MANTISSA, BANDS = 128, 10, 32
#: Chance that the estimate leaves out a pair just at the similarity.
MISSED = 1e-9
#: Members of buckets that a task takes together; those of one bucket are never more than two TILEs.
TOGETHER = 16_384
_BITS = REGISTERS.bit_length() - 1
#: For each attempt, the bucket that each empty bucket looks at.
_LOOK = np.random.default_rng(42).integers(0, REGISTERS, (4096, REGISTERS))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each set of hashes in order; an empty set has zeros."""
    edges = (np.arange(REGISTERS + 1, dtype=object) << (64 - _BITS))[:-1].astype(np.uint64)
    least, filled = np.zeros((len(sets), REGISTERS), np.uint64), np.zeros((len(sets), REGISTERS), bool)
    for i, h in enumerate(sets):
        at = np.searchsorted(h, edges)
        filled[i] = np.diff(at, append=len(h)) > 0
        least[i, filled[i]] = h[at[filled[i]]] << np.uint64(_BITS)
    zeros = np.zeros(least.shape, np.uint16)
    for step in (32, 16, 8, 4, 2, 1):
        short = least < np.uint64(1 << (64 - step))
        zeros += (step * short).astype(np.uint16)
        least = np.where(short, least << np.uint64(step), least)
    made = zeros << np.uint16(MANTISSA) | (least >> np.uint64(63 - MANTISSA)).astype(np.uint16) & np.uint16((1 << MANTISSA) - 1)
    out = np.where(filled, made, 0).astype(np.uint16)
    left = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    done = filled[left]
    attempt = 0
    while len(left):
        look = _LOOK[attempt % len(_LOOK)]
        got = filled[left][:, look] & ~done
        row, column = np.nonzero(got)
        out[left[row], column] = made[left[row], look[column]]
        done |= got
        more = ~done.all(axis=1)
        left, done, attempt = left[more], done[more], attempt + 1
    return out


def by_chance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chance that two registers of unequal least hashes agree, for sets of a and b hashes.

    The least hash of a bucket is about exponential; a register's cell is on average 1 / (2 ln 2) of
    its value wide, times 2 ** -MANTISSA.
    """
    return a * b / (a + b) ** 2 / (2 * math.log(2)) / 2**MANTISSA


def estimate(agree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of sets of a and b hashes by the number of registers that agree."""
    c = by_chance(a, b)
    return (agree / REGISTERS - c) / (1 - c)


def least_estimate(similarity: float) -> float:
    """Pairs at the similarity are estimated below this with probability MISSED at most (binomial)."""
    chance, agree = 0.0, 0
    while agree <= REGISTERS:
        chance += math.exp(math.lgamma(REGISTERS + 1) - math.lgamma(agree + 1) - math.lgamma(REGISTERS - agree + 1) + agree * math.log(similarity) + (REGISTERS - agree) * math.log1p(-similarity)) if similarity < 1 else float(agree == REGISTERS)
        if chance > MISSED:
            break
        agree += 1
    return (agree - 1) / REGISTERS


def forest(regs: np.ndarray, size: np.ndarray, similarity: float, least: float) -> list[tuple[int, int]]:
    """Edges that connect what the pairs of estimated similarity ``least`` or more connect.

    From each set reached, all that are not yet reached are looked at, so that a group of copies costs
    about a comparison each. Sets of different sizes that cannot reach the similarity never meet; those
    of fewer than two shingles a register have too few registers of their own for an estimate and meet all.
    """
    edges, left = [], np.arange(len(size))
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            a, b = size[x].astype(float), size[left].astype(float)
            fit = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
            near = np.flatnonzero(fit)
            agree = np.count_nonzero(regs[left[near]] == regs[x], axis=1)
            near = near[(estimate(agree, a, b[near]) >= least - 1e-9) | (np.minimum(a, b[near]) < 2 * REGISTERS)]
            edges += [(x, y) for y in left[near].tolist()]
            reached += left[near].tolist()
            left = np.delete(left, near)
    return edges


def _sketched(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, s, n, regs) for every row, from the shared folder: s names the set of n shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, shingle_words)) for t in b.column(2).to_pylist()]
            s = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).astype(np.int64)
            regs = pa.array([x.tobytes() for x in registers(sets).astype("<u2")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array([len(h) for h in sets], pa.int64()), regs], ["doc_id", "text_hash", "s", "n", "regs"])

    kind = docs.schema[id_col].dataType.simpleString()
    path = shared_folder(docs.sparkSession, "registers")
    docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash bigint, s bigint, n bigint, regs binary").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _candidates(sets: DataFrame, similarity: float, tile: int) -> DataFrame:
    """(a, b): edges between sets (s, n, regs) that share a band and whose estimated similarity is not too low."""
    width = 2 * REGISTERS // BANDS
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width)) for i in range(BANDS)]))
    keyed = sets.select(keys.alias("k"), "s")
    # buckets of the same members are one
    many = keyed.groupBy("k").agg(F.count("*").alias("members"), F.min("s").alias("x"), F.max("s").alias("y"), F.bit_xor(F.xxhash64("s")).alias("z")).filter("x < y")
    chosen = checkpointed(many.groupBy("members", "x", "y", "z").agg(F.min("k").alias("k")).select("k", F.ceil(F.col("members") / tile).cast("int").alias("parts"), "members"))
    bundles = -(-(chosen.agg(F.sum("members")).first()[0] or 1) // TOGETHER)
    tiles = (
        keyed.join(chosen, "k")
        .withColumn("large", F.col("parts") > 1)
        .withColumn("g", F.when(F.col("large"), F.col("k")).otherwise(F.pmod("k", F.lit(bundles))))
        .withColumn("p", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"))
        .join(sets.select("s", "n", "regs"), "s")
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("large", "g", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "k", "s", "n", "regs")
    )
    least = least_estimate(similarity)

    def run(table: pa.Table) -> pa.Table:
        k, s, n = (table.column(c).to_numpy() for c in ("k", "s", "n"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
        order = np.argsort(k, kind="stable")
        found = []
        for rows in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
            rows = rows[np.unique(s[rows], return_index=True)[1]]
            found += [(s[rows[x]], s[rows[y]]) for x, y in forest(regs[rows], n[rows], similarity, least)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return tiles.groupBy("large", "g", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.85, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of distinct shingles is at least
    ``similarity`` (between 0.5 and 1); texts of fewer words than a shingle are one shingle of all their words.
    component_id is the least id reachable over links, and kept tells whether it is the row's own.
    Null and empty texts have no shingle and are linked with nothing: they are their own component.
    Repeated rows stay repeated. Null ids never name a component unless all ids in it are null. Very long
    texts are read whole. An empty table gives no rows; further columns are left out.
    """
    if not 0.5 <= similarity <= 1:
        raise ValueError("similarity must be between 0.5 and 1")
    rows = _sketched(docs, shingle_words, id_col, text_col)
    some = rows.filter("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.min("text_hash").alias("text_hash"))
    sets = checkpointed(some)
    # a smaller set is too far from any set but itself
    parts = connected_components(_candidates(sets.filter(F.col("n") + 1e-9 >= similarity * (F.col("n") + 1)), similarity, tile))
    chosen = checkpointed(sets.join(parts.withColumnRenamed("node", "s"), "s").select("label", "s", "n", "text_hash"))
    links = linked_sets(chosen.select("label", "s", "n"), shingles_of(docs, chosen.select("text_hash"), shingle_words, text_col), "s", similarity)
    parts = connected_components(links)
    named = checkpointed(sets.select(F.col("s").alias("node"), "least").join(parts, "node"))
    component = checkpointed(with_least(named, "label", F.col("least"), "component", named.count())[0].select("node", "component"))
    # a table of its own, so that Spark sees both sides of the join with all rows as they are dealt and splits a set that most rows have
    known = checkpointed(sets.join(component, sets["s"] == component["node"], "left").select("s", F.coalesce("component", "least").alias("component_id")))
    joined = rows.join(known, "s", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
