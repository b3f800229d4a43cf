"""Dictionary mentions: matching phrases in tokens, and comparing matches with gold annotations.

The dictionary is a table of phrases (tokens joined by a bar). Matching is a join of n-grams with it, so it needs
no trie in memory and spreads over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.intervals import overlaps
from spanweave.operators.joins import ngrams, small

NA = -1


def leaves(mentions: DataFrame) -> DataFrame:
    """(phrase, leaf, candidates): distinct phrases of (phrase, ent) with an id by rank and their sorted entities.
    The rank is taken over the dictionary only."""
    cands = mentions.groupBy("phrase").agg(F.sort_array(F.collect_set("ent")).alias("candidates"))
    from spanweave.operators.joins import dense_ids

    return cands.join(dense_ids(cands, "phrase", "leaf"), "phrase")


def any_match(tokens: DataFrame, phrases: DataFrame, most: int) -> DataFrame:
    """Every match of a phrase: doc_id, left, right, phrase."""
    return ngrams(tokens, most).join(small(phrases.select("phrase").distinct()), "phrase").select("doc_id", "left", "right", "phrase")


def maximal(matches: DataFrame) -> DataFrame:
    """Of all matches the longest from each start, without those within another; partial overlaps stay."""
    longest = matches.groupBy("doc_id", "left").agg(F.max_by("phrase", "right").alias("phrase"), F.max("right").alias("right"))
    return not_contained(longest).select("doc_id", "left", "right", "phrase")


def not_contained(spans: DataFrame) -> DataFrame:
    """Spans (one for each document and left end) that no span from further left holds."""
    before = Window.partitionBy("doc_id").orderBy("left").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__reach", F.max("right").over(before)).filter(F.coalesce(F.col("__reach") < F.col("right"), F.lit(True))).drop("__reach")


def corroborated(gold: DataFrame, spots: DataFrame, mentions: DataFrame) -> DataFrame:
    """Gold annotations whose span was spotted with a phrase that lists their entity."""
    listed = spots.join(small(mentions.select("phrase", "ent").distinct()), "phrase").select("doc_id", "left", "right", "ent")
    return gold.join(listed, ["doc_id", "left", "right", "ent"], "left_semi")


def imputed(spots: DataFrame, gold: DataFrame) -> DataFrame:
    """Spots that equal no gold span but whose phrase is that of gold spans of the document with one entity only."""
    at_gold = spots.join(gold, ["doc_id", "left", "right"])
    one = at_gold.groupBy("doc_id", "phrase").agg(F.min("ent").alias("ent"), F.max("ent").alias("__other")).filter("ent = __other").drop("__other")
    free = spots.join(gold.select("doc_id", "left", "right"), ["doc_id", "left", "right"], "left_anti")
    return free.join(one, ["doc_id", "phrase"]).select("doc_id", "left", "right", "phrase", "ent")


def positive(spots: DataFrame, gold: DataFrame) -> DataFrame:
    """Spots with a gold annotation of the same span, and its entity."""
    return spots.join(gold, ["doc_id", "left", "right"]).select("doc_id", "left", "right", "phrase", "ent")


def negative(spots: DataFrame, gold: DataFrame) -> DataFrame:
    """Spots that no gold annotation overlaps."""
    g = gold.select("doc_id", F.col("left").alias("__l"), F.col("right").alias("__r"))
    return spots.join(g, (spots.doc_id == g.doc_id) & overlaps(F.col("left"), F.col("right"), F.col("__l"), F.col("__r")), "left_anti")


def rediscovered(gold: DataFrame, tokens: DataFrame, leaf_table: DataFrame, most: int) -> DataFrame:
    """Gold annotations with the leaf of the phrase that fills their whole span."""
    spans = ngrams(tokens, most)
    return gold.join(spans, ["doc_id", "left", "right"]).join(small(leaf_table.select("phrase", "leaf")), "phrase").select("doc_id", "left", "right", "ent", "leaf")


def mention_counts(gold: DataFrame, tokens: DataFrame, most: int) -> DataFrame:
    """How often each phrase is annotated with each entity."""
    return gold.join(ngrams(tokens, most), ["doc_id", "left", "right"]).groupBy("phrase", "ent").agg(F.count("*").alias("n"))


def by_annotation_probability(counts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(phrase, annotated, occurs, probability): how often a phrase is annotated where it occurs."""
    marginal = counts.groupBy("phrase").agg(F.sum("n").alias("annotated"))
    return marginal.join(corpus, "phrase").withColumn("probability", F.col("annotated") / F.col("occurs"))


def with_lemma_token(mentions: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Mentions (phrase, ent) that share a token with some lemma (ent, lemma) of their entity."""
    words = lemmas.select("ent", F.explode(F.split(F.lower("lemma"), "[^\\p{L}\\p{N}]+")).alias("token")).distinct()
    own = mentions.select("phrase", "ent", F.explode(F.split("phrase", "\\|")).alias("token"))
    return own.join(words, ["ent", "token"]).select("phrase", "ent").distinct()
