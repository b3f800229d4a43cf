"""Indexes of a stream of documents: postings are appended, counts kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanweave.functions.text import words


def tokens(docs: DataFrame) -> DataFrame:
    """Works on a stream as on a table: (doc_id, pos, token)."""
    return docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "token"))


def append_postings(docs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write token postings of arriving documents to a table, each batch exactly once (a batch that is repeated after
    a failure replaces its own files)."""

    def batch(df: DataFrame, number: int) -> None:
        found = tokens(df).groupBy("token", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_counts(docs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write each batch's collection frequencies as rows of their own, for ``counts`` to sum; no state grows, and a
    batch that is repeated replaces its own files."""

    def batch(df: DataFrame, number: int) -> None:
        term_counts(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counts(spark: SparkSession, path: str) -> DataFrame:
    """Collection frequencies over all batches so far."""
    return spark.read.schema("token string, cf long").parquet(f"{path}/batch=*").groupBy("token").agg(F.sum("cf").alias("cf"))


def term_counts(docs: DataFrame) -> DataFrame:
    """Collection frequency of each token; on a stream its state is one row for each token."""
    return tokens(docs).groupBy("token").agg(F.count("*").alias("cf"))


def windowed_counts(events: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by time window; what comes later than ``late`` is left out and its state dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
