"""Where to put skip pointers into posting lists, given which features are asked for.

A leaf's list has features in order, each with a number of bits. Reading a feature costs r0 + r1 * bits; getting to
it costs s0 + s1 * (bits passed) from the nearest skip at or before it (or from the begin), if there are any to pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.joins import running_sums

R0, R1, S0, S1 = 1.0, 0.01, 1.0, 0.01
#: Cells of the exact search (features * budget^2); larger problems take evenly spaced skips.
MOST_CELLS = 60_000

WEIGHTS = {
    "bit": lambda: F.col("bits"),
    "hit_bit": lambda: F.col("hit_prob") * F.col("bits"),
    "sqrt_hit_bit": lambda: F.sqrt(F.col("hit_prob") * F.col("bits")),
    "num_feat": lambda: F.col("n_feats"),
}


def coin(key: Column) -> Column:
    """A number in [0, 1) from a numbered key, in place of a random one."""
    return F.pmod(key * F.lit(2654435761), F.lit(1000003)) / F.lit(1000003.0)


def outer(leaves: DataFrame, budget: int, policy: str) -> DataFrame:
    """Skips for each leaf (leaf, bits, hit_prob, n_feats): its share by the policy's weight, rounded up or down by a
    coin, and at most its number of features."""
    total = F.broadcast(leaves.agg(F.sum(WEIGHTS[policy]()).alias("__total")))
    share = F.lit(float(budget)) * WEIGHTS[policy]() / F.col("__total")
    return leaves.crossJoin(total).withColumn("budget", F.least(F.col("n_feats"), F.floor(share + coin(F.col("leaf")))).cast("long")).drop("__total")


def cost(prob: np.ndarray, bits: np.ndarray, skips: list[int]) -> float:
    start = np.concatenate([[0], np.cumsum(bits)[:-1]]).astype(float)
    origin = np.zeros(len(bits))
    for s in sorted(skips):
        origin[s:] = start[s]
    passed = start - origin
    return float((prob * (R0 + R1 * bits + np.where(passed > 0, S0 + S1 * passed, 0))).sum())


def by_frequency(prob: np.ndarray, bits: np.ndarray, budget: int) -> list[int]:
    return sorted(np.lexsort((np.arange(len(prob)), -prob))[:budget].tolist())


def evenly(prob: np.ndarray, bits: np.ndarray, budget: int) -> list[int]:
    """As many marks as the budget has, at equal shares of all bits; each takes the first feature that starts at it or
    after it. Marks that none follows, or that share a feature, are spent on nothing."""
    start = np.cumsum(bits) - bits
    marks = np.arange(budget) * int(bits.sum())  # both sides times the budget, to stay with whole numbers
    found = np.unique(np.searchsorted(start * budget, marks))
    return found[found < len(bits)].tolist()


def half_and_half(prob: np.ndarray, bits: np.ndarray, budget: int, share: float = 0.5) -> list[int]:
    """The most frequent features for a share of the budget, others by the hash of their place."""
    budget = min(budget, len(bits))
    chosen = set(by_frequency(prob, bits, int(share * budget)))
    for i in sorted(range(len(bits)), key=lambda i: (i * 2654435761) % 1000003):
        if len(chosen) >= budget:
            break
        chosen.add(i)
    return sorted(chosen)


def optimal(prob: np.ndarray, bits: np.ndarray, budget: int) -> list[int]:
    """Skips of least cost: the best split of the list into budget + 1 runs, each entered at its first feature."""
    n = len(bits)
    start = np.concatenate([[0], np.cumsum(bits)[:-1]]).astype(float)
    p = np.concatenate([[0], np.cumsum(prob)])
    ps = np.concatenate([[0], np.cumsum(prob * start)])
    # run[i, j]: cost of getting to features i .. j - 1 from i
    i, j = np.arange(n)[:, None], np.arange(n + 1)[None, :]
    run = S1 * ((ps[j] - ps[i]) - start[i] * (p[j] - p[i])) + S0 * (p[j] - p[np.minimum(i + 1, n)])
    run = np.where(j > i, run, np.inf)
    best, back = run[0].copy(), []
    for _ in range(min(budget, n - 1)):
        ways = best[:n, None] + run
        ways[0] = np.inf
        at = ways.argmin(axis=0)
        value = ways[at, np.arange(n + 1)]
        back.append(np.where(value < best - 1e-12, at, -1))
        best = np.minimum(best, value)
    out, j = [], n
    for row in reversed(back):
        if row[j] >= 0:
            out.append(int(row[j]))
            j = int(row[j])
    return sorted(out)


def optimal_or_evenly(prob: np.ndarray, bits: np.ndarray, budget: int) -> list[int]:
    return optimal(prob, bits, budget) if len(bits) * budget * budget <= MOST_CELLS else evenly(prob, bits, budget)


POLICIES = {"freq": by_frequency, "equi": evenly, "equi_and_freq": half_and_half, "dyn_prog_or_equi": optimal_or_evenly}


def inner(features: DataFrame, budgets: DataFrame, policy: str) -> DataFrame:
    """(leaf, budget, n_skips, cost, skips) from features (leaf, feat, bits, prob) in order of feat; a leaf is a group."""
    allocate = POLICIES[policy]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("feat")
        prob, bits, budget = rows["prob"].to_numpy(float), rows["bits"].to_numpy(np.int64), int(rows["budget"].iloc[0])
        skips = allocate(prob, bits, budget)
        return pd.DataFrame({"leaf": [rows["leaf"].iloc[0]], "budget": [budget], "n_skips": [len(skips)], "cost": [cost(prob, bits, skips)], "skips": [rows["feat"].to_numpy()[skips].tolist()]})

    joined = features.join(budgets.select("leaf", "budget"), "leaf").select("leaf", "feat", "bits", "prob", "budget")
    return joined.groupBy("leaf").applyInPandas(one, "leaf long, budget long, n_skips long, cost double, skips array<long>")


#: Smoothers that are tried for each leaf.
SMOOTHERS = tuple(float(f"{m}e{e}") for e in range(-6, 2) for m in (1, 2, 5))


def records(features: DataFrame, allocated: DataFrame) -> DataFrame:
    """Skip records (leaf, used, cost, feat, bit, nth): a row for each skip of ``inner``'s result, with the bit at which
    its feature starts; a leaf without skips has one row with nulls."""
    before = Window.partitionBy("leaf").orderBy("feat").rowsBetween(Window.unboundedPreceding, -1)
    starts = features.select("leaf", "feat", F.coalesce(F.sum("bits").over(before), F.lit(0)).alias("bit"))
    each = allocated.select("leaf", F.col("n_skips").alias("used"), "cost", F.posexplode_outer("skips").alias("nth", "feat"))
    return each.join(starts, ["leaf", "feat"], "left").select("leaf", "used", "cost", "feat", "bit", "nth")


def merged(runs: list[DataFrame]) -> DataFrame:
    """One sorted table of skip records out of several that share no leaf."""
    whole = runs[0]
    for r in runs[1:]:
        whole = whole.unionByName(r)
    return whole.repartitionByRange("leaf").sortWithinPartitions("leaf", "nth")


def slice_ends(merged_: DataFrame, n_leaves: int) -> DataFrame:
    """(leaf, end) of every leaf below ``n_leaves``: where its skips end in the sorted table. Leaves without a record
    end where the one before them does."""
    used = merged_.groupBy("leaf").agg(F.max("used").alias("used"))
    every = merged_.sparkSession.range(n_leaves).select(F.col("id").alias("leaf")).join(used, "leaf", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    summed = running_sums(every, ["leaf"], "used", "begin")
    return summed.select("leaf", (F.col("begin") + F.col("used")).alias("end"))


def audit(merged_: DataFrame) -> DataFrame:
    """Totals of a merged table: records, skips, expected cost."""
    per_leaf = merged_.groupBy("leaf").agg(F.max("used").alias("used"), F.max("cost").alias("cost"), F.count("feat").alias("listed"))
    return per_leaf.agg(F.count("*").alias("n_records"), F.sum("used").alias("n_skips"), F.round(F.sum("cost"), 4).alias("cost"), F.bool_and(F.col("used") == F.col("listed")).alias("agrees"))


def smoothed(counts: DataFrame, smoother: Column) -> DataFrame:
    """Probability of each feature (leaf, feat, n) within its leaf, with a constant added to every count."""
    w = Window.partitionBy("leaf")
    return counts.withColumn("prob", (F.col("n") + smoother) / (F.sum("n").over(w) + smoother * F.count("*").over(w)))


def best_smoother(train: DataFrame, tune: DataFrame, smoothers: list[float]) -> DataFrame:
    """(leaf, smoother, loss): of the smoothers the one under which a leaf's tuning counts are likeliest."""
    grid = train.withColumn("smoother", F.explode(F.array(*map(F.lit, smoothers))))
    w = Window.partitionBy("leaf", "smoother")
    p = (F.col("n") + F.col("smoother")) / (F.sum("n").over(w) + F.col("smoother") * F.count("*").over(w))
    seen = grid.withColumn("prob", p).join(tune.select("leaf", "feat", F.col("n").alias("n_tune")), ["leaf", "feat"])
    loss = seen.groupBy("leaf", "smoother").agg(F.round(-F.sum(F.col("n_tune") * F.log("prob")), 6).alias("loss"))
    best = loss.withColumn("__n", F.row_number().over(Window.partitionBy("leaf").orderBy("loss", "smoother")))
    return best.filter("__n = 1").drop("__n")


def snapped(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of asked features (leaf, feat, n) moved to the next known feature (leaf, feat) at or after them; those
    past the last are dropped."""
    both = asked.select("leaf", "feat", "n", F.lit(None).cast("long").alias("to")).unionByName(known.select("leaf", "feat", F.lit(0).cast("long").alias("n"), F.col("feat").cast("long").alias("to")))
    after = Window.partitionBy("leaf").orderBy(F.col("feat"), F.col("to").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    moved = both.withColumn("to", F.first("to", ignorenulls=True).over(after))
    return moved.filter("to IS NOT NULL").groupBy("leaf", F.col("to").alias("feat")).agg(F.sum("n").alias("n"))
