"""Benchmark decontamination: short test items are searched inside long documents.

Size-partitioned MinHash containment search. Items are put into classes by their number of
distinct shingles; items of fewer words than a shingle are one shingle of as many words as they
have. The sketch of an item is its least m shingle hashes, where m is set by the class: the most
shingles that an item of the class may miss, plus one. Hashes are ranked by how many documents hold
the shingle, in powers of two, and then by value, so that a phrase that most documents have makes no
candidates. An item contained to the wanted share meets a document in at least one sketch hash,
whichever m shingles these are, so the search loses nothing. Candidates
are then verified by exact containment of the shingles themselves. Only DataFrame functions are
used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import checkpointed, unused

#: Most rows, and bytes of words, of an item or candidate table that are broadcast; above, the joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def normal_words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; null has none."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.when(F.size(words) == 1, F.array_remove(words, "")).otherwise(words)


def shingled(rows: DataFrame, words: Column, width: int) -> DataFrame:
    """``rows`` with columns w0..w(width-1) for each word of a text: it and those that follow, null beyond the end."""
    shifted = [F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))) for i in range(width)]
    return rows.select("*", F.inline(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])))


def _grams(rows: DataFrame, key: str, k: int, widths: list[int]) -> DataFrame:
    """(key, w0..w(k-1)): shingles of each of these widths, filled up with null, from one pass over the words."""
    width = max(widths, default=k)
    placed = shingled(rows.select(key, "words"), F.col("words"), width).drop("words")
    cut = lambda w: F.when(F.col(f"w{w - 1}").isNotNull(), F.struct(*[F.col(f"w{i}") if i < w else F.lit(None).cast("string").alias(f"w{i}") for i in range(k)]))
    if len(widths) < 2:
        return placed.filter(F.col(f"w{width - 1}").isNotNull()).select(key, *[F.col(f"w{i}") if i < width else F.lit(None).cast("string").alias(f"w{i}") for i in range(k)])
    return placed.select(key, F.inline(F.filter(F.array(*[cut(w) for w in widths]), lambda x: x.isNotNull())))


def _small(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _sketches(full: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_id, h): the m least hashes of each item, of the shingles that the fewest documents hold first."""
    held = hits.groupBy("h").agg(F.count("*").alias("held"))
    rarity = F.ceil(F.log2(F.coalesce("held", F.lit(0)) + 1))
    ranked = full.join(held, "h", "left").withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(rarity, "h")))
    return ranked.filter(F.col("place") <= F.col("m")).select("item_id", "h")


def contaminated(docs: DataFrame, items: DataFrame, shingle_words: int = 5, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, item_shingles, containment): documents that hold at least that share of an item's distinct shingles.

    Null and empty texts and items hold nothing and match nothing. Items of fewer words than a
    shingle match wherever their words follow each other. Repeated ids count together, as one
    document or item. Empty tables give no rows; further columns are left out. Very long texts
    are searched whole.
    """
    k = shingle_words
    ws = [f"w{i}" for i in range(k)]
    own = items.select(F.col(item_col).alias("item_id"), normal_words(F.col(item_text_col)).alias("words")).filter((F.size("words") > 0) & F.col("item_id").isNotNull())
    own = checkpointed(own.withColumn("width", F.least(F.size("words"), F.lit(k))))
    widths = sorted(r[0] for r in own.select("width").distinct().collect())  # k at most
    # an item's own width: its shingles are of no other
    shingles = _grams(own.filter(F.col("width") == k), "item_id", k, [k])
    for w in widths:
        if w < k:
            shingles = shingles.unionByName(_grams(own.filter(F.col("width") == w), "item_id", k, [w]))
    shingles = shingles.distinct()
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    # classes by powers of two; an item may miss this many shingles at most, in any item of its class
    classed = sizes.withColumn("class", F.floor(F.log2("item_shingles")).cast("int"))
    sketched = classed.withColumn("m", F.floor((F.pow(F.lit(2.0), F.col("class") + 1) - 1) * (1 - containment) + 1e-9).cast("int") + 1)
    full = checkpointed(shingles.join(sketched.drop("class"), "item_id").withColumn("h", F.xxhash64(*ws)))
    n_full, bytes_full = full.agg(F.count("*"), F.sum(F.octet_length(F.concat_ws("", *ws)))).first()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    words = texts.select("doc_id", normal_words(F.col("text")).alias("words"))
    probe = _grams(words, "doc_id", k, widths).select("doc_id", F.xxhash64(*ws).alias("h"))
    hits = checkpointed(probe.join(_small(full.select("h").distinct(), n_full), "h").distinct())
    sketches = checkpointed(_sketches(full, hits))
    candidates = checkpointed(hits.join(_small(sketches, sketches.count()), "h").select("doc_id", "item_id").distinct())
    n_candidates = candidates.count()
    # verification: all distinct shingles of the candidates' texts, which are put aside lest all texts be split again
    chosen = checkpointed(texts.join(_small(candidates.select("doc_id").distinct(), n_candidates), "doc_id", "left_semi"))
    split = chosen.select("doc_id", normal_words(F.col("text")).alias("words"))
    every = _grams(split, "doc_id", k, widths)
    equal = reduce(lambda a, b: a & b, [every[w].eqNullSafe(full[w]) for w in ws])
    met = every.join(_small(full, n_full, bytes_full or 0), equal).select("doc_id", "item_id", "item_shingles", *[every[w] for w in ws])
    met = met.join(_small(candidates, n_candidates), ["doc_id", "item_id"], "left_semi").distinct()
    counted = met.groupBy("doc_id", "item_id", "item_shingles").agg(F.count("*").alias("matched"))
    share = F.col("matched") / F.col("item_shingles")
    return counted.filter(share >= containment - 1e-9).select("doc_id", "item_id", "matched", "item_shingles", share.alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay, rows without an id too.

    Null and empty texts stay; an empty table gives no rows; no column's name can clash.
    """
    (own,) = unused(docs.columns, "_found")
    found = contaminated(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, docs[id_col] == F.col(own), "left_anti")
