"""Tables that the queries share, derived from the given ones, each in both languages.

Tokens are the words of ``documents``. A word of eight letters and more that 3 to 50 documents have is an entity;
its type is its first letter, above which are vowel or consonant, and root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions import text
from spanweave.operators import catalog
from spanweave.scratch import Scratch
from spanweave.suite import SUITE, read

part = SUITE.part

part("tokens", r"""SELECT doc_id, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS token
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)""")
part("term_stats", "SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tokens GROUP BY token", "tokens")
part("ents", "SELECT token AS ent FROM term_stats WHERE length(token) >= 8 AND df BETWEEN 3 AND 50", "term_stats")
part("annots", 'SELECT doc_id, pos AS "left", pos AS "right", ent FROM tokens JOIN ents ON token = ent', "tokens", "ents")
part("direct", "SELECT ent, substr(ent, 1, 1) AS cat FROM ents", "ents")
part("sub_sup", """SELECT DISTINCT cat AS sub, CASE WHEN cat IN ('a', 'e', 'i', 'o', 'u') THEN 'vowel' ELSE 'consonant' END AS sup FROM direct
  UNION SELECT 'vowel', 'root' UNION SELECT 'consonant', 'root'""", "direct")
part("closure", "SELECT sub, sup FROM sub_sup UNION SELECT c.sub, s.sup FROM closure c JOIN sub_sup s ON c.sup = s.sub", "sub_sup")
part("ent_cat", "SELECT ent, cat FROM direct UNION SELECT d.ent, c.sup FROM direct d JOIN closure c ON d.cat = c.sub", "direct", "closure")
part("types", "SELECT a.*, e.cat FROM annots a JOIN ent_cat e ON a.ent = e.ent", "annots", "ent_cat")
part("n_docs", "SELECT max(doc_id) + 1 AS n FROM documents")
# gold annotations with control over spans: an order is a document, its lines are positions, parts are entities
part("gold", 'SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS "left", CAST(l_linenumber AS INTEGER) AS "right", l_partkey AS ent FROM lineitem')


def tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(text.words(F.col("text"))).alias("pos", "token"))


def term_stats(tokens_: DataFrame) -> DataFrame:
    # two steps with partial sums each: no word is held by one task for all its documents
    per_doc = tokens_.groupBy("token", "doc_id").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def ents(stats: DataFrame) -> DataFrame:
    return stats.filter((F.length("token") >= 8) & F.col("df").between(3, 50)).select(F.col("token").alias("ent"))


def annots(tokens_: DataFrame, ents_: DataFrame) -> DataFrame:
    hit = tokens_.filter(F.length("token") >= 8).join(ents_.withColumnRenamed("ent", "token"), "token")
    return hit.select("doc_id", F.col("pos").alias("left"), F.col("pos").alias("right"), F.col("token").alias("ent"))


def direct(ents_: DataFrame) -> DataFrame:
    return ents_.select("ent", F.substring("ent", 1, 1).alias("cat"))


def sub_sup(direct_: DataFrame) -> DataFrame:
    spark = direct_.sparkSession
    above = F.when(F.col("cat").isin("a", "e", "i", "o", "u"), "vowel").otherwise("consonant")
    letters = direct_.select(F.col("cat").alias("sub"), above.alias("sup")).distinct()
    return letters.union(spark.createDataFrame([("vowel", "root"), ("consonant", "root")], "sub string, sup string"))


def ent_cat(ents_: DataFrame) -> DataFrame:
    d = direct(ents_)
    return catalog.entity_types(d, catalog.closure(sub_sup(d)))


def annotated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """tokens, term_stats, annots and types."""
    t, scratch = tokens(spark, d), Scratch(spark, "annotated")
    stats = scratch.keep(term_stats(t), "stats")  # entities, closure and weights are all made of it
    e = scratch.keep(ents(stats), "ents")
    a = annots(t, e)
    return t, stats, a, catalog.type_postings(a, ent_cat(e))


def gold(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_linenumber").cast("int")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), at.alias("left"), at.alias("right"), F.col("l_partkey").alias("ent"))


def n_docs(spark: SparkSession, d: str) -> int:
    return (read(spark, d, "documents").agg(F.max("doc_id")).first()[0] or -1) + 1
