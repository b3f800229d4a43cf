"""Reading telegraphic queries as an answer type and the words that hint at it.

The score of an entity for a query is the sum, over its types and over hint windows of the query's words, of
p(entity) p(type | entity) p(hint) times the likelihood of hint words under the type's words and of all others
under the entity's snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.text import hint_windows
from spanweave.operators.joins import small

TYPE_SMOOTHER = 0.15
SNIPPET_SMOOTHER = 0.01
HINT_PRIOR = 0.2
TYPE_PRIOR_SMOOTHER = 0.05


def snippet_counts(witnesses: DataFrame) -> DataFrame:
    """qen (qid, ent, n): snippets of each entity for a query."""
    return witnesses.groupBy("qid", "ent").agg(F.count("*").alias("n"))


def snippet_words(witnesses: DataFrame) -> DataFrame:
    """qewc (qid, ent, word, n): snippets (qid, ent, words) that have a word; a word counts once in each."""
    return witnesses.select("qid", "ent", F.explode(F.array_distinct("words")).alias("word")).groupBy("qid", "ent", "word").agg(F.count("*").alias("n"))


def word_maps(qewc: DataFrame) -> DataFrame:
    return qewc.groupBy("qid", "ent").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "n")))).alias("words"))


def type_words(lemmas: DataFrame) -> DataFrame:
    """(cat, word): distinct words of the names of each type, from (cat, lemma)."""
    return lemmas.select("cat", F.explode(F.split(F.lower("lemma"), r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''").distinct()


def type_model(words: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Global words (word, p), log-probability of no word for each type (cat, log_empty), number of types."""
    n_cats = words.select("cat").distinct().count()
    glob = words.groupBy("word").agg(F.count("*").alias("df")).select("word", ((1.0 + F.col("df")) / (2.0 + n_cats)).alias("p"))
    # all words as if no type had any, then the difference for those that a type has
    none = glob.agg(F.sum(F.log(1 - TYPE_SMOOTHER * F.col("p"))).alias("base"))
    own = F.log(1 - ((1 - TYPE_SMOOTHER) + TYPE_SMOOTHER * F.col("p"))) - F.log(1 - TYPE_SMOOTHER * F.col("p"))
    shift = words.join(small(glob), "word").groupBy("cat").agg(F.sum(own).alias("shift"))
    return glob, shift.crossJoin(F.broadcast(none)).select("cat", (F.col("base") + F.col("shift")).alias("log_empty")), float(n_cats)


def log_odds(p):
    return F.log(p / (1 - p))


def type_odds(query_words: DataFrame, words: DataFrame, glob: DataFrame, n_cats: float) -> DataFrame:
    """(cat, word, odds): log-odds of each query word (word) for every type."""
    cats = words.select("cat").distinct()
    asked = query_words.select("word").distinct().join(small(glob), "word", "left").withColumn("p", F.coalesce("p", F.lit(1.0 / (2.0 + n_cats))))
    pairs = cats.crossJoin(F.broadcast(asked)).join(words.withColumn("__own", F.lit(1.0)), ["cat", "word"], "left")
    p = (1 - TYPE_SMOOTHER) * F.coalesce("__own", F.lit(0.0)) + TYPE_SMOOTHER * F.col("p")
    return pairs.select("cat", "word", log_odds(p).alias("odds"))


def search_types(query_words: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """The k types that bags of words (qid, word) are likeliest about: (qid, cat, score, rank)."""
    glob, empty, n_cats = type_model(words)
    odds = type_odds(query_words, words, glob, n_cats)
    scored = query_words.join(odds, "word").groupBy("qid", "cat").agg(F.sum("odds").alias("s")).join(empty, "cat")
    ranked = scored.withColumn("score", F.round(F.col("s") + F.col("log_empty"), 6))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cat")
    return ranked.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("qid", "cat", "score", "rank")


def interpret(queries: DataFrame, qen: DataFrame, qewc: DataFrame, ent_cat: DataFrame, words: DataFrame, query_types: DataFrame) -> DataFrame:
    """(qid, ent, score) from queries (qid, words), qen, qewc, closed types of entities (ent, cat), names' words of
    types (cat, word) and a histogram of answer types (cat, n).

    p(type | entity): (n + s) / (sum of n over the entity's types + s * number of these types)."""
    glob, empty, n_cats = type_model(words)
    asked = queries.select("qid", F.posexplode("words").alias("at", "word"))
    odds_t = type_odds(asked, words, glob, n_cats)
    support = qen.withColumn("p_ent", F.col("n") / F.sum("n").over(Window.partitionBy("qid")))

    smooth = lambda c: (SNIPPET_SMOOTHER + c) / (2 * SNIPPET_SMOOTHER + F.col("n_ent"))
    seen = qewc.withColumnRenamed("n", "c").join(support.select("qid", "ent", F.col("n").alias("n_ent")), ["qid", "ent"])
    empty_s = seen.groupBy("qid", "ent").agg(F.sum(F.log(1 - smooth(F.col("c")))).alias("empty_snippet"))
    pairs = support.select("qid", "ent", F.col("n").alias("n_ent")).join(asked, "qid").join(qewc.withColumnRenamed("n", "c"), ["qid", "ent", "word"], "left")
    odds_s = pairs.select("qid", "ent", "at", "word", log_odds(smooth(F.coalesce("c", F.lit(0)))).alias("snippet"))

    w = Window.partitionBy("ent")
    prior = ent_cat.join(small(query_types), "cat", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p_type = (F.col("n") + TYPE_PRIOR_SMOOTHER) / (F.sum("n").over(w) + TYPE_PRIOR_SMOOTHER * F.count("*").over(w))
    types = prior.select("ent", "cat", p_type.alias("p_type")).join(empty, "cat")

    cells = odds_s.join(types, "ent").join(odds_t, ["cat", "word"])
    # per entity and type: the words in order, then every window picks from two prefix sums
    per = cells.groupBy("qid", "ent", "cat").agg(
        F.array_sort(F.collect_list(F.struct("at", "word", "snippet", "odds"))).alias("w"), F.first("p_type").alias("p_type"), F.first("log_empty").alias("log_empty")
    )
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["snippet"])

    def window_score(h):
        inside = F.aggregate(F.slice(F.col("w"), h["b"] + 1, h["e"] - h["b"]), F.lit(0.0), lambda s, x: s + x["odds"] - x["snippet"])
        n = h["e"] - h["b"]
        hint = n * F.log(F.lit(HINT_PRIOR)) + (F.size("w") - n) * F.log(F.lit(1 - HINT_PRIOR))
        return F.exp(hint + F.log("p_ent") + F.log("p_type") + F.col("log_empty") + F.col("empty_snippet") + total + inside)

    joined = per.join(empty_s, ["qid", "ent"]).join(support.select("qid", "ent", "p_ent"), ["qid", "ent"])
    one = joined.withColumn("s", F.aggregate(F.transform(hint_windows(F.col("w")), window_score), F.lit(0.0), lambda s, x: s + x))
    return one.groupBy("qid", "ent").agg(F.sum("s").alias("score"))
