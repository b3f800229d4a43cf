"""Disambiguation by naive Bayes: one small model for each phrase (leaf), all in one plan.

A context is (ctx, leaf, ent) with features (ctx, feat, freq). The models are tables of counts, keyed by leaf, so
that any number of leaves is trained and applied by the same joins and sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def train(contexts: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """leaf (leaf, n_ctx), leaf_ent (leaf, ent, n_ctx, sum_freq), lfe (leaf, feat, ent, freq), vocab (leaf, vocab)."""
    known = contexts.join(features, "ctx")
    per_ent = contexts.groupBy("leaf", "ent").agg(F.count("*").alias("n_ctx"))
    lfe = known.groupBy("leaf", "feat", "ent").agg(F.sum("freq").alias("freq"))
    sums = lfe.groupBy("leaf", "ent").agg(F.sum("freq").alias("sum_freq"))
    return {
        "leaf": per_ent.groupBy("leaf").agg(F.sum("n_ctx").alias("n_ctx")),
        "leaf_ent": per_ent.join(sums, ["leaf", "ent"], "left").withColumn("sum_freq", F.coalesce("sum_freq", F.lit(0))),
        "lfe": lfe,
        "vocab": lfe.groupBy("leaf").agg(F.count_distinct("feat").alias("vocab")),
    }


def log_priors(candidates: DataFrame, model: dict[str, DataFrame]) -> DataFrame:
    """(leaf, ent, log_prior): (contexts of the entity + 1) / (contexts of the leaf + number of candidates)."""
    sized = candidates.withColumn("n_cand", F.count("*").over(Window.partitionBy("leaf")))
    joined = sized.join(model["leaf_ent"].select("leaf", "ent", F.col("n_ctx").alias("n_ent")), ["leaf", "ent"], "left").join(model["leaf"], "leaf", "left")
    prior = (F.coalesce("n_ent", F.lit(0)) + 1) / (F.coalesce("n_ctx", F.lit(0)) + F.col("n_cand"))
    return joined.select("leaf", "ent", F.log(prior).alias("log_prior"))


def score(contexts: DataFrame, features: DataFrame, candidates: DataFrame, model: dict[str, DataFrame], smoothing: float = 1.0, lambdas: DataFrame | None = None, leave_one_out: bool = False) -> DataFrame:
    """(ctx, leaf, cand, log_score) of each context with each candidate of its leaf; with ``lambdas`` (leaf, lambda, or
    several for a leaf) also for each smoothing. Leaves with no training vocabulary have no scores, nor have contexts
    with no features. leave_one_out is for training contexts: what each feature counts in a context is taken from that
    feature and from the total of the true entity, feature by feature, and priors stay, as in the original; contexts
    with no features have scores too, their priors."""
    rate = lambdas if lambdas is not None else model["leaf"].select("leaf").withColumn("lambda", F.lit(smoothing))
    how = "left" if leave_one_out else "inner"
    cands = candidates.select("leaf", F.col("ent").alias("cand"))
    pairs = contexts.join(cands, "leaf").join(model["vocab"], "leaf", how).withColumn("vocab", F.coalesce("vocab", F.lit(0))).join(rate, "leaf")
    totals = model["leaf_ent"].select("leaf", F.col("ent").alias("cand"), "sum_freq")
    pairs = pairs.join(totals, ["leaf", "cand"], "left").withColumn("sum_freq", F.coalesce("sum_freq", F.lit(0)))
    seen = model["lfe"].select("leaf", "feat", F.col("ent").alias("cand"), F.col("freq").alias("known"))
    cells = pairs.join(features.select("ctx", "feat", "freq"), "ctx", how).withColumn("freq", F.coalesce("freq", F.lit(0))).join(seen, ["leaf", "feat", "cand"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    mine = (F.col("cand") == F.col("ent")) if leave_one_out else F.lit(False)
    hits = F.col("known") - F.when(mine, F.col("freq")).otherwise(0) + F.col("lambda")
    of = F.col("sum_freq") - F.when(mine, F.col("freq")).otherwise(0) + F.col("lambda") * F.col("vocab")
    scored = cells.groupBy("ctx", "leaf", "ent", "cand", "lambda").agg(F.sum(F.when(F.col("freq") > 0, F.col("freq") * (F.log(hits) - F.log(of))).otherwise(0.0)).alias("likelihood"))
    priors = log_priors(candidates, model).withColumnRenamed("ent", "cand")
    return scored.join(priors, ["leaf", "cand"]).select("ctx", "leaf", "ent", "cand", "lambda", (F.col("likelihood") + F.col("log_prior")).alias("log_score"))


def normalized(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Log-probabilities of candidates (softmax of log_score) with rank from 0; ties by candidate."""
    w = Window.partitionBy(*keys)
    top = F.max("log_score").over(w)
    total = F.sum(F.exp(F.col("log_score") - F.col("__top"))).over(w)
    out = scores.withColumn("__top", top).withColumn("log_prob", F.col("log_score") - (F.col("__top") + F.log(total))).drop("__top")
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("log_score"), "cand")) - 1)


def policy(ranked: DataFrame, none: Column) -> DataFrame:
    """What is annotated: the first candidate, unless ``none`` says that it stands for no entity."""
    return ranked.filter((F.col("rank") == 0) & ~none)


def tuned(scores: DataFrame) -> DataFrame:
    """From scores for several lambdas: (leaf, lambda, accuracy, instances) of the best lambda of each leaf (the least,
    if equal). A context counts as right if its entity scores higher than every other."""
    w = Window.partitionBy("ctx", "leaf", "lambda")
    true = F.max(F.when(F.col("cand") == F.col("ent"), F.col("log_score"))).over(w)
    other = F.max(F.when(F.col("cand") != F.col("ent"), F.col("log_score"))).over(w)
    marked = scores.withColumn("right", F.coalesce(true > other, true.isNotNull())).filter(F.col("cand") == F.col("ent"))
    rates = marked.groupBy("leaf", "lambda").agg(F.avg(F.col("right").cast("double")).alias("accuracy"), F.count("*").alias("instances"))
    best = Window.partitionBy("leaf").orderBy(F.desc("accuracy"), "lambda")
    return rates.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def averages(results: DataFrame) -> DataFrame:
    """Macro and micro average of accuracies."""
    return results.agg(F.avg("accuracy").alias("macro"), (F.sum(F.col("accuracy") * F.col("instances")) / F.sum("instances")).alias("micro"), F.sum("instances").alias("instances"))
