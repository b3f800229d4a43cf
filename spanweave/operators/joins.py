"""Joins that Spark has no operator for: bands within a key, n-gram dictionaries, dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.scratch import Scratch

#: Estimated bytes of a side that may be broadcast by the joins here; anything larger is shuffled.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint, if the optimiser's estimate of its size is small; else as it is."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST_BYTES else df


def band_join(left: DataFrame, right: DataFrame, on: list[str], low: Column, high: Column, at: Column, width: int) -> DataFrame:
    """Rows of ``left`` (columns low, high) with rows of ``right`` (column at) of equal ``on`` and low <= at <= high.

    Positions are cut into buckets of ``width``; the left side is repeated for the few buckets that its range
    touches, the right side has one bucket each, so every pair meets once and the join is an equi-join that
    spreads even a single key over its buckets. Other columns of both sides must have different names."""
    step = F.lit(max(1, width))
    buckets = F.sequence(F.floor(low / step), F.floor(high / step))
    l = left.withColumn("__low", low).withColumn("__high", high).withColumn("__bucket", F.explode(buckets))
    r = right.withColumn("__at", at).withColumn("__bucket", F.floor(at / step))
    met = l.join(r, [*on, "__bucket"]).filter(F.col("__at").between(F.col("__low"), F.col("__high")))
    return met.drop("__low", "__high", "__at", "__bucket")


def dense_ids(df: DataFrame, key: str, name: str = "id", start: int = 0) -> DataFrame:
    """Distinct values of a column with ids start, start + 1, ... in their order."""
    return positions(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], name, start)


def positions(df: DataFrame, keys: list[str], name: str, start: int = 1) -> DataFrame:
    """All rows with their place in the order of ``keys``, from ``start``. A range partitioning sorts them; only the
    size of each partition reaches the driver, so that no task numbers them all. Rows with equal keys have places next
    to each other, in any order."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    numbered = numbered.withColumn("__p", F.shiftright("__m", 33).cast("int")).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    numbered = Scratch(spark, "ids").keep(numbered, "numbered")
    offset, before = [], start
    sizes = {r["__p"]: r["count"] for r in numbered.groupBy("__p").count().collect()}
    for p in range(max(sizes, default=-1) + 1):
        offset.append(before)
        before += sizes.get(p, 0)
    at = F.get(F.array(*(F.lit(x).cast("long") for x in offset)), F.col("__p")) if offset else F.lit(start).cast("long")
    return numbered.select(*df.columns, (at + F.col("__i")).alias(name))


def running_sums(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows with the sum of ``value`` over all rows before them in the order of ``keys`` (which tell rows apart). As in
    ``positions``, each range partition sums by itself, and only the partitions' totals reach the driver."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id())
    dealt = Scratch(spark, "sums").keep(dealt, "dealt")
    offset, before = [], 0
    totals = {r["__p"]: r["t"] for r in dealt.groupBy("__p").agg(F.sum(value).alias("t")).collect()}
    for p in range(max(totals, default=-1) + 1):
        offset.append(before)
        before += totals.get(p) or 0
    base = F.get(F.array(*(F.lit(x).cast("long") for x in offset)), F.col("__p")) if offset else F.lit(0).cast("long")
    w = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(*df.columns, (base + F.coalesce(F.sum(value).over(w), F.lit(0))).cast("long").alias(name))


def islands(df: DataFrame, keys: list[str], order: str, contiguous: Column, name: str = "island") -> DataFrame:
    """Number of the run of rows in order that each row belongs to; ``contiguous`` tells, with lag() over the window
    ``w`` of keys and order, whether a row continues the run before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.sum(F.when(contiguous, 0).otherwise(1)).over(w))


def ngrams(tokens: DataFrame, most: int, separator: str = "|") -> DataFrame:
    """Phrases of 1 to ``most`` consecutive tokens (doc_id, pos, token): doc_id, left, right, phrase. Phrases with
    a null token are left out."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    ahead = [F.lead("token", i).over(w) for i in range(most)]
    at = [F.lead("pos", i).over(w) for i in range(most)]
    wide = tokens.select("doc_id", "pos", F.array(*ahead).alias("__t"), F.array(*at).alias("__p"))
    sized = wide.withColumn("__n", F.explode(F.sequence(F.lit(1), F.lit(most))))
    right = F.col("pos") + F.col("__n") - 1
    whole = (F.element_at("__p", F.col("__n")) == right) & ~F.exists(F.slice("__t", 1, F.col("__n")), lambda t: t.isNull())
    return sized.filter(whole).select("doc_id", F.col("pos").alias("left"), right.alias("right"), F.array_join(F.slice("__t", 1, F.col("__n")), separator).alias("phrase"))
