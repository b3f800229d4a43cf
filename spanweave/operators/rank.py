"""Learning to rank entities from feature vectors of their snippets.

Rows are snippets (qid, ent, label, fv ARRAY<DOUBLE>). Training solves one small problem for each fold and penalty:
in its own group where the model lets a fold's snippets be summed by entity before, else on the driver, with value and
gradient of all problems from one pass over the snippets where they lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.functions.lbfgs import minimize, minimize_together
from spanweave.scratch import Scratch

#: Pairs of entities that are held at once; snippets of a block, and bytes of a row of it.
PAIRS, BLOCK, ROW = 1 << 20, 1 << 16, 1 << 13
#: Models whose snippets can't be summed before the weights are known.
SPREAD = ("softmax", "noisy_or")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    """Shifted by one, so that a margin is asked for; without overflow."""
    y = x + 1
    return F.when(y >= 0, 1 / (1 + F.exp(-y))).otherwise(F.exp(y) / (1 + F.exp(y)))


def soft_hinge(x: Column) -> Column:
    y = x + 1
    return F.when(y > 0, y + F.log1p(F.exp(-y))).otherwise(F.log1p(F.exp(y)))


def log_soften(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def summed(sfv: DataFrame, n: int) -> DataFrame:
    """One vector for each entity: sums of its snippets' features, and their number."""
    sums = [F.sum(F.element_at("fv", i + 1)) for i in range(n)]
    return sfv.groupBy("qid", "ent").agg(F.max("label").alias("label"), F.array(*sums, F.count("*").cast("double")).alias("fv"))


def score_sum(sfv: DataFrame, w: list[float]) -> DataFrame:
    """Linear score of the summed vector; the last weight is for the number of snippets."""
    s = summed(sfv, len(w) - 1)
    return s.select("qid", "ent", "label", dot(F.col("fv"), F.array(*map(F.lit, w))).alias("score"))


def score_softmax(sfv: DataFrame, w: list[float]) -> DataFrame:
    x = log_soften(dot(F.col("fv"), F.array(*map(F.lit, w))))
    return sfv.groupBy("qid", "ent").agg(F.max("label").alias("label"), F.sum(x).alias("score"))


def score_noisy_or(sfv: DataFrame, w: list[float]) -> DataFrame:
    """1 - product of (1 - sigmoid), summed as logarithms."""
    p = sigmoid(dot(F.col("fv"), F.array(*map(F.lit, w))))
    return sfv.groupBy("qid", "ent").agg(F.max("label").alias("label"), (1 - F.exp(F.sum(F.log1p(-p)))).alias("score"))


def ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ent")))


def usable(sfv: DataFrame) -> DataFrame:
    """Queries that have entities of both labels."""
    return sfv.groupBy("qid").agg(F.max("label").alias("a"), F.min("label").alias("b")).filter("a AND NOT b").select("qid")


def fold_of(qid: Column, k: int) -> Column:
    """Fold 1 to k of a numbered query, from an arithmetic hash in [0, 1)."""
    x = F.pmod(qid * F.lit(2654435761), F.lit(1000003)) / F.lit(1000003.0)
    return (F.floor(x * k) + 1).cast("int")


def pairs(entities: DataFrame) -> DataFrame:
    """Relevant and other entities of each query, paired: (qid, good, bad). Sized by what is relevant: use it for
    training data, not for whole collections."""
    good, bad = entities.filter("label"), entities.filter("NOT label")
    return good.select("qid", F.col("ent").alias("good")).join(bad.select("qid", F.col("ent").alias("bad")), "qid")


# --- training of one group, in numpy ----------------------------------------------------------------------------


def _hinge(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = x + 1
    return np.logaddexp(0, y), 1 / (1 + np.exp(-np.clip(y, -500, 500)))


def _soften(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.sign(x) * np.log1p(np.abs(x)), 1 / (1 + np.abs(x))


def _each(kind: str, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a snippet adds to its entity's score, and the slope of it."""
    if kind == "sum":
        return raw, np.ones(raw.shape)
    return _soften(raw) if kind == "softmax" else _hinge(raw)  # noisy_or: -log(1 - p)


def _swaps(good: np.ndarray, bad: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of the pairs of a query by their scores, and its gradients."""
    value, back_good, back_bad, n = 0.0, np.zeros(len(good)), np.zeros(len(bad)), len(good) * len(bad)
    for i in range(0, len(good), step := max(1, PAIRS // len(bad))):
        h, dh = _hinge(bad[None, :] - good[i : i + step, None])
        value += h.sum() / n
        back_good[i : i + step] = -dh.sum(axis=1) / n
        back_bad += dh.sum(axis=0) / n
    return value, back_good, back_bad


def objective(kind: str, qid: np.ndarray, ent: np.ndarray, label: np.ndarray, x: np.ndarray, sigma2: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Loss of weights: soft hinge of every other entity's score over every relevant one's, and w^2 / (2 sigma2).
    kind: sum (weights are exp(u), so never negative), softmax, or noisy_or (of the logarithm of missing)."""
    key, row = np.unique(np.rec.fromarrays([qid, ent], names="q,e"), return_inverse=True)
    good = np.zeros(len(key), bool)
    np.logical_or.at(good, row, label)
    groups = [(np.flatnonzero((key.q == q) & good), np.flatnonzero((key.q == q) & ~good)) for q in np.unique(key.q)]
    groups = [(g, b) for g, b in groups if len(g) and len(b)]

    def fun(u: np.ndarray) -> tuple[float, np.ndarray]:
        w = np.exp(np.clip(u, -30, 30)) if kind == "sum" else u
        each, slope = _each(kind, x @ w)
        score = np.bincount(row, each, minlength=len(key))
        value, back = float(u @ u) / (2 * sigma2), np.zeros(len(key))
        for g, b in groups:
            loss, back[g], back[b] = _swaps(score[g], score[b])
            value += loss
        grad = x.T @ (back[row] * slope)
        return value, (grad * w if kind == "sum" else grad) + u / sigma2

    return fun


def train(sfv: DataFrame, kind: str, folds: int, sigma2s: list[float], n: int) -> DataFrame:
    """Weights (fold, sigma2, w) from all queries of the other folds. Each (fold, penalty) is a problem of its own."""
    if kind in SPREAD:
        return _train_spread(sfv, kind, folds, sigma2s, n)
    data = summed(sfv, n) if kind == "sum" else sfv
    own = data.withColumn("own", fold_of(F.col("qid"), folds)).select("qid", "ent", "label", "fv", "own")
    grid = F.array(*(F.struct(F.lit(f).alias("fold"), F.lit(s).alias("sigma2")) for f in range(1, folds + 1) for s in sigma2s))
    copies = own.withColumn("g", F.explode(grid)).filter("g.fold <> own").select("qid", "ent", "label", "fv", "g.fold", "g.sigma2")

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["fv"].to_numpy()).astype(float)
        fun = objective(kind, rows["qid"].to_numpy(), rows["ent"].to_numpy(), rows["label"].to_numpy(), x, key[1])
        u = minimize(fun, np.zeros(x.shape[1]), rounds=60)
        w = np.exp(np.clip(u, -30, 30)) if kind == "sum" else u
        return pd.DataFrame({"fold": [key[0]], "sigma2": [key[1]], "w": [w.tolist()]})

    return copies.groupBy("fold", "sigma2").applyInPandas(fit, "fold int, sigma2 double, w array<double>")


def _train_spread(sfv: DataFrame, kind: str, folds: int, sigma2s: list[float], n: int) -> DataFrame:
    """As ``train``, for any number of snippets of a query or an entity: they stay in the partitions that they come in,
    packed once by entity. Each evaluation sums them by entity in Arrow batches; only these sums are shuffled, and one
    value and gradient of each problem reach the driver. A snippet without all features adds nothing, as in scoring."""
    spark, scratch, names = sfv.sparkSession, Scratch(sfv.sparkSession, "snippets"), [f"f{i}" for i in range(n)]
    flat = sfv.select(fold_of(F.col("qid"), folds).alias("own"), "qid", "ent", F.coalesce("label", F.lit(False)).alias("label"), *(F.get("fv", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names))).dropna(subset=["own", *names])
    rows = T.StructType([*flat.schema.fields[:4], T.StructField("x", T.BinaryType())])
    packed = scratch.keep(flat.mapInArrow(_packed(names), rows), "packed")
    problems = [(f, s) for f in range(1, folds + 1) for s in sigma2s]
    slopes = [T.StructField(c, T.DoubleType()) for c in ("score", *names)]
    sums = T.StructType([T.StructField("k", T.IntegerType()), flat.schema["qid"], flat.schema["ent"], T.StructField("label", T.BooleanType()), *slopes])

    def evaluate(at: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        parts = packed.mapInArrow(_entity_sums(kind, names, [(k, problems[k][0], w) for k, w in at.items()]), sums)
        ents = parts.groupBy("k", "qid", "ent").agg(F.max("label").alias("label"), *(F.sum(c).alias(c) for c in ("score", *names)))
        losses = ents.groupBy("k", "qid").applyInPandas(_query_loss(names), T.StructType([sums["k"], *slopes]))
        got = {r[0]: r[1:] for r in losses.groupBy("k").agg(*(F.sum(c) for c in ("score", *names))).collect()}
        total = {k: np.array(got.get(k, [0.0] * (n + 1))) for k in at}
        return {k: (total[k][0] + float(u @ u) / (2 * problems[k][1]), total[k][1:] + u / problems[k][1]) for k, u in at.items()}

    found = minimize_together(evaluate, {k: np.zeros(n) for k in range(len(problems))}, rounds=60)
    scratch.drop("packed")
    return spark.createDataFrame([(*problems[k], w.tolist()) for k, w in found.items()], "fold int, sigma2 double, w array<double>")


def _packed(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (own, qid, ent, label, x) of snippets of an entity, up to ROW bytes, from blocks of BLOCK snippets and more; x has
    their features, one snippet after the other."""
    keys, most = ["own", "qid", "ent", "label"], max(1, ROW // (8 * len(names)))

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(batches).combine_chunks()
        ids = [pc.dictionary_encode(block.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy() for c in keys]
        order = np.lexsort(ids[::-1])
        new = np.any([c[order][1:] != c[order][:-1] for c in ids], axis=0)
        first = np.concatenate([[0], np.flatnonzero(new) + 1])
        place = np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))
        first = np.flatnonzero(place % most == 0)
        x = np.stack([block.column(c).to_numpy() for c in names], axis=1)[order]
        ends = np.append(first, len(order)).astype(np.int32) * (8 * len(names))
        data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(x)])
        heads = pa.array(order[first])
        return pa.RecordBatch.from_arrays([*(pc.take(block.column(c).combine_chunks(), heads) for c in keys), data], [*keys, "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield pack(held)
                held = []
        if sum(b.num_rows for b in held):
            yield pack(held)

    return run


def _entity_sums(kind: str, names: list[str], models: list[tuple[int, int, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of scores and slopes over the snippets of each packed row, for each model (number, fold, weights) of another
    fold. Entities may come again, in other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column("own").to_numpy()
            for own in np.unique(folds):
                others = [(k, w) for k, fold, w in models if fold != own]
                rows = batch.take(pa.array(np.flatnonzero(folds == own)))
                ends = np.cumsum(pc.binary_length(rows.column("x")).to_numpy()) // (8 * len(names))
                for low, high in _slices(ends):
                    cut = rows.slice(low, high - low)
                    x = np.frombuffer(b"".join(cut.column("x").to_pylist())).reshape(-1, len(names)).T.copy()
                    starts = np.concatenate([[0], ends[low : high - 1] - (ends[low - 1] if low else 0)])
                    for k, w in others:
                        each, slope = _each(kind, w @ x)
                        values = [np.add.reduceat(each, starts), *np.add.reduceat(slope * x, starts, axis=1)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(high - low, k, np.int32)), *(cut.column(c) for c in ("qid", "ent", "label")), *map(pa.array, values)], ["k", "qid", "ent", "label", "score", *names])

    return run


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK snippets in all; ends: where each row's end, counted over all rows."""
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, "right")))
        yield low, high
        low = high


def _query_loss(names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Loss and gradient of a query under a model, of entities with their scores and slopes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        good, score, slopes = rows["label"].to_numpy(bool), rows["score"].to_numpy(), rows[names].to_numpy()
        if good.all() or not good.any():
            return pd.DataFrame({c: [] for c in ("k", "score", *names)})
        loss, back_good, back_bad = _swaps(score[good], score[~good])
        grad = back_good @ slopes[good] + back_bad @ slopes[~good]
        return pd.DataFrame([[rows["k"].iloc[0], loss, *grad]], columns=["k", "score", *names])

    return run


def cross_validated(sfv: DataFrame, kind: str, folds: int, sigma2s: list[float], n: int) -> DataFrame:
    """Scores (qid, ent, label, sigma2, score) of each query by weights that never saw it."""
    weights = F.broadcast(train(sfv, kind, folds, sigma2s, n))  # folds * penalties rows
    data = (summed(sfv, n) if kind == "sum" else sfv).withColumn("fold", fold_of(F.col("qid"), folds)).join(weights, "fold")
    raw = dot(F.col("fv"), F.col("w"))
    if kind == "sum":
        return data.select("qid", "ent", "label", "sigma2", raw.alias("score"))
    each = log_soften(raw) if kind == "softmax" else soft_hinge(raw)
    return data.groupBy("qid", "ent", "sigma2").agg(F.max("label").alias("label"), F.sum(each).alias("score")).select("qid", "ent", "label", "sigma2", "score")


def letor(entities: DataFrame) -> DataFrame:
    """Lines of the usual text format: +1 or -1, qid, features from 1."""
    feats = F.transform("fv", lambda v, i: F.concat_ws(":", (i + 1).cast("string"), F.round(v, 8).cast("decimal(28,8)").cast("string")))
    return entities.select(F.concat_ws(" ", F.when(F.col("label"), "+1").otherwise("-1"), F.concat(F.lit("qid:"), F.col("qid").cast("string")), F.array_join(feats, " ")).alias("line"))
