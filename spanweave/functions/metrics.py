"""Ranking metrics of one ranked list for each key, from rows (key, label, rank); ranks begin at 1.

Truth has (key, n_good): how many relevant items there are, retrieved or not. All sums are doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_hits(ranked: DataFrame, key: str) -> DataFrame:
    """``ranked`` with hits: relevant items up to each rank."""
    return ranked.withColumn("hits", F.sum(F.col("label").cast("long")).over(Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def discount(rank: Column) -> Column:
    """1 for the first two ranks, then one over the binary logarithm."""
    return F.when(rank <= 2, F.lit(1.0)).otherwise(1.0 / F.log2(rank.cast("double")))


def metrics(ranked: DataFrame, truth: DataFrame, key: str, at: int = 10) -> DataFrame:
    """pair_swaps, mrr, mrr_at, p_at, ap and ndcg_at of each key.

    pair_swaps: minus the share of (relevant, other) pairs in the wrong order, counting relevant items that were
    not retrieved as behind all others; 0 if only relevant items are there, -1 if only others. p_at divides by
    ``at`` always; the ideal of ndcg_at are the hits found in the first ``at``; ap divides by the truth."""
    label = F.col("label").cast("long")
    seen = prefix_hits(ranked, key)
    w = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("bad_before", F.sum(1 - label).over(w))
    top = F.col("rank") <= at
    sums = seen.groupBy(key).agg(
        F.sum(label).alias("good"),
        F.sum(1 - label).alias("bad"),
        F.sum(F.when(label == 1, F.col("bad_before")).otherwise(0)).alias("swaps"),
        F.min(F.when(label == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top, label).otherwise(0)).alias("top_hits"),
        F.sum(F.when(label == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("precisions"),
        F.sum(F.when(top & (label == 1), discount(F.col("rank"))).otherwise(0.0)).alias("dcg"),
    )
    # what is relevant but was not retrieved; sums above may count retrieved items only
    out = sums.join(truth, key, "left").withColumn("n_good", F.coalesce("n_good", "good"))
    missing = F.greatest(F.col("n_good") - F.col("good"), F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("top_hits"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + discount(r))
    pairs = F.col("good") * F.col("bad") + missing * F.col("bad")
    swaps = F.when(F.col("good") == 0, F.lit(-1.0)).when(F.col("bad") == 0, F.lit(0.0)).otherwise(-(F.col("swaps") + missing * F.col("bad")) / pairs)
    return out.select(
        key,
        swaps.alias("pair_swaps"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("first") <= at, 1.0 / F.col("first")).otherwise(0.0).alias("mrr_at"),
        (F.col("top_hits") / at).alias("p_at"),
        F.when(F.col("n_good") > 0, F.col("precisions") / F.col("n_good")).otherwise(0.0).alias("ap"),
        F.when(F.col("top_hits") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg_at"),
    )


def tied_pairs(scored: DataFrame, key: str) -> DataFrame:
    """Share of (relevant, other) pairs of each key in which the relevant item doesn't score higher. Counted from the
    sorted scores, not from pairs: for each relevant item, the others with its score or a higher one."""
    w = Window.partitionBy(key).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    above = scored.withColumn("above", F.sum((~F.col("label")).cast("long")).over(w))
    sums = above.groupBy(key).agg(F.sum(F.when(F.col("label"), F.col("above")).otherwise(0)).alias("wrong"), F.count_if("label").alias("good"), F.count_if(~F.col("label")).alias("bad"))
    return sums.select(key, F.when(F.col("good") * F.col("bad") > 0, F.col("wrong") / (F.col("good") * F.col("bad"))).otherwise(0.0).alias("swap_fraction"))
