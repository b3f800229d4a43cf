"""Words around mentions and salient words of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.joins import band_join, small


def around(spots: DataFrame, tokens: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """Bag of tokens within ``width`` of each spot, without the mention: keys, token, n. keys name columns of spots."""
    lean = tokens.select("doc_id", "pos", "token").filter("token IS NOT NULL")
    met = band_join(spots, lean, ["doc_id"], F.col("left") - width, F.col("right") + width, F.col("pos"), max(2 * width, 16))
    return met.filter(~F.col("pos").between(F.col("left"), F.col("right"))).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def salient(tokens: DataFrame, stats: DataFrame, n_docs: int, share: float = 0.9, most: int = 10) -> DataFrame:
    """Salient words of each document: by tf * ln(n_docs / (1 + df)), kept while the squared weights before them are
    at most ``share`` of all and their index (from 0) at most ``most``. Ties: the greater token first."""
    tf = tokens.filter("token IS NOT NULL").groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    weighed = tf.join(stats.select("token", "df"), "token", "left").withColumn("weight", F.col("tf") * F.log(F.lit(float(n_docs)) / (1 + F.coalesce("df", F.lit(0)))))
    order = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.desc("token"))
    square = F.col("weight") * F.col("weight")
    ranked = weighed.withColumn("index", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum(square).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    total = F.sum(square).over(Window.partitionBy("doc_id"))
    return ranked.withColumn("total", total).filter((F.col("before") <= share * F.col("total")) & (F.col("index") <= most)).select("doc_id", "token", "tf", "weight", "index")


def truncated_bags(bags: DataFrame, stats: DataFrame, n_docs: int, key: str, retain: float = 0.8) -> DataFrame:
    """Of each key's bag (key, token, n) weighed by n * n_docs / df, the fewest heaviest tokens that hold ``retain`` of
    the sum of weights. Ties: the smaller token first."""
    weighed = bags.join(stats.select("token", "df"), "token").withColumn("weight", F.col("n") * F.lit(float(n_docs)) / F.col("df"))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "token")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return weighed.withColumn("before", before).withColumn("total", F.sum("weight").over(Window.partitionBy(key))).filter(F.col("before") < retain * F.col("total")).select(key, "token", "n", "weight")


def keyword_in_context(mentions: DataFrame, tokens: DataFrame, width: int, most: int | None = None, drawn: Column | None = None) -> DataFrame:
    """Lines of ``width`` tokens on either side of each mention (doc_id, left, right, ent); of each entity the first
    ``most`` by document and place, or by ``drawn`` before these (a hash, for a sample)."""
    if most is not None:
        order = [*([] if drawn is None else [drawn]), "doc_id", "left"]
        mentions = mentions.withColumn("__n", F.row_number().over(Window.partitionBy("ent").orderBy(*order))).filter(F.col("__n") <= most).drop("__n")
    met = band_join(mentions, tokens.select("doc_id", "pos", "token"), ["doc_id"], F.col("left") - width, F.col("right") + width, F.col("pos"), 64)
    lines = met.groupBy("ent", "doc_id", "left", "right").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return lines.select("ent", "doc_id", "left", F.array_join(F.col("t.token"), " ").alias("line"))


def coalesced(mentions: DataFrame) -> DataFrame:
    """Runs of adjacent or overlapping mentions of one entity in a document, as one span each."""
    w = Window.partitionBy("doc_id", "ent").orderBy("left", "right").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("left") > F.max("right").over(w) + 1, F.lit(True)).cast("int")
    runs = mentions.withColumn("__new", new)
    runs = runs.withColumn("__run", F.sum("__new").over(Window.partitionBy("doc_id", "ent").orderBy("left", "right").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "ent", "__run").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count("*").alias("n")).drop("__run")


def with_stats(bags: DataFrame, stats: DataFrame) -> DataFrame:
    return bags.join(small(stats), "token")
