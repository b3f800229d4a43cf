"""Mentions, contexts and disambiguation.

Documents here are orders: the text of order o has, for each line, the two words of its part's name; the gold
annotation of these words is the name with one of three numbers (so that a name is ambiguous). The dictionary has
the names, and the first words as mentions of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions import codec, text
from spanweave.operators import bayes, catalog, context, spotting
from spanweave.operators.joins import ngrams, positions
from spanweave.scratch import Scratch
from spanweave.suite import SUITE, base, read

query, part = SUITE.add, SUITE.part

part("lines", """SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS ln, str_split(p_name, ' ') AS w, p_name || '#' || (p_partkey % 3) AS ent FROM lineitem JOIN part ON l_partkey = p_partkey""")
part("otok", "SELECT doc_id, 2 * (ln - 1) AS pos, w[1] AS token FROM lines UNION ALL SELECT doc_id, 2 * (ln - 1) + 1, w[2] FROM lines", "lines")
part("ogold", 'SELECT doc_id, 2 * (ln - 1) AS "left", 2 * (ln - 1) + 1 AS "right", ent FROM lines', "lines")
part("mentions", """SELECT DISTINCT replace(p_name, ' ', '|') AS phrase, p_name || '#' || (p_partkey % 3) AS ent FROM part
  UNION SELECT DISTINCT str_split(p_name, ' ')[1], str_split(p_name, ' ')[1] || '#w' FROM part WHERE length(str_split(p_name, ' ')[1]) % 2 = 0""")
part("ograms", """SELECT doc_id, pos AS "left", pos AS "right", token AS phrase FROM otok UNION ALL
  SELECT a.doc_id, a.pos, b.pos, a.token || '|' || b.token FROM otok a JOIN otok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1""", "otok")
part("matches", 'SELECT g.* FROM ograms g WHERE phrase IN (SELECT phrase FROM mentions)', "ograms", "mentions")
part("spots", """SELECT doc_id, "left", "right", phrase FROM (SELECT *, max("right") OVER (PARTITION BY doc_id ORDER BY "left" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT doc_id, "left", max("right") AS "right", arg_max(phrase, "right") AS phrase FROM matches GROUP BY ALL)) WHERE reach IS NULL OR reach < "right" """, "matches")
part("leaf", "SELECT phrase, dense_rank() OVER (ORDER BY phrase) - 1 AS leaf, list_sort(list(DISTINCT ent)) AS candidates FROM mentions GROUP BY phrase", "mentions")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    words = _lines(spark, d).select("doc_id", "ln", F.posexplode("w").alias("i", "token"))
    return words.select("doc_id", (2 * (F.col("ln") - 1) + F.col("i")).cast("int").alias("pos"), "token")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.concat("p_name", F.lit("#"), (F.col("p_partkey") % 3).cast("string")).alias("ent"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))  # line numbers repeat
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), nth.alias("ln"), F.col("l_partkey").alias("p_partkey")).join(parts, "p_partkey")


def gold(spark: SparkSession, d: str) -> DataFrame:
    left = 2 * (F.col("ln") - 1)
    return _lines(spark, d).select("doc_id", left.cast("int").alias("left"), (left + 1).cast("int").alias("right"), "ent")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    names = p.select(F.replace("p_name", F.lit(" "), F.lit("|")).alias("phrase"), F.concat("p_name", F.lit("#"), (F.col("p_partkey") % 3).cast("string")).alias("ent"))
    first = F.split("p_name", " ")[0]
    heads = p.select(first.alias("phrase"), F.concat(first, F.lit("#w")).alias("ent")).filter(F.length("phrase") % 2 == 0)
    return names.union(heads).distinct()


def spots(spark: SparkSession, d: str) -> DataFrame:
    return spotting.maximal(spotting.any_match(tokens(spark, d), mentions(spark, d), 2))


@query("C12_maximal_spots", 'SELECT doc_id, "left", "right", phrase FROM spots', "spots")
def maximal_spots(spark: SparkSession, d: str) -> DataFrame:
    return spots(spark, d)


@query("C13_any_spots", 'SELECT doc_id, "left", "right", phrase FROM matches', "matches")
def any_spots(spark: SparkSession, d: str) -> DataFrame:
    return spotting.any_match(tokens(spark, d), mentions(spark, d), 2)


@query("C14_leaves", "SELECT phrase, leaf, list_aggregate(candidates, 'string_agg', ',') AS candidates FROM leaf", "leaf")
def leaf_table(spark: SparkSession, d: str) -> DataFrame:
    return spotting.leaves(mentions(spark, d)).select("phrase", "leaf", F.array_join("candidates", ",").alias("candidates"))


@query("C15_corroborated_gold", 'SELECT g.doc_id, g."left", g."right", g.ent FROM ogold g WHERE EXISTS (SELECT 1 FROM spots s JOIN mentions m USING (phrase) WHERE s.doc_id = g.doc_id AND s."left" = g."left" AND s."right" = g."right" AND m.ent = g.ent)', "ogold", "spots", "mentions")
def corroborated(spark: SparkSession, d: str) -> DataFrame:
    return spotting.corroborated(gold(spark, d), spots(spark, d), mentions(spark, d)).select("doc_id", "left", "right", "ent")


part("half", 'SELECT * FROM ogold WHERE (doc_id + "left" / 2) % 3 = 0', "ogold")


def half(spark: SparkSession, d: str) -> DataFrame:
    return gold(spark, d).filter((F.col("doc_id") + F.col("left") / 2) % 3 == 0)


@query("C16_imputed_annotations", """SELECT s.doc_id, s."left", s."right", s.phrase, o.ent FROM spots s JOIN (SELECT s.doc_id, s.phrase, min(h.ent) AS ent FROM spots s JOIN half h
  ON s.doc_id = h.doc_id AND s."left" = h."left" AND s."right" = h."right" GROUP BY ALL HAVING count(DISTINCT h.ent) = 1) o ON s.doc_id = o.doc_id AND s.phrase = o.phrase
  WHERE NOT EXISTS (SELECT 1 FROM half h WHERE h.doc_id = s.doc_id AND h."left" = s."left" AND h."right" = s."right")""", "spots", "half")
def imputed(spark: SparkSession, d: str) -> DataFrame:
    return spotting.imputed(spots(spark, d), half(spark, d))


@query("C17_positive_spots", 'SELECT s.doc_id, s."left", s."right", s.phrase, h.ent FROM spots s JOIN half h ON s.doc_id = h.doc_id AND s."left" = h."left" AND s."right" = h."right"', "spots", "half")
def positive(spark: SparkSession, d: str) -> DataFrame:
    return spotting.positive(spots(spark, d), half(spark, d))


@query("C17_negative_spots", 'SELECT s.doc_id, s."left", s."right", s.phrase FROM spots s WHERE NOT EXISTS (SELECT 1 FROM half h WHERE h.doc_id = s.doc_id AND h."left" <= s."right" AND s."left" <= h."right")', "spots", "half")
def negative(spark: SparkSession, d: str) -> DataFrame:
    return spotting.negative(spots(spark, d), half(spark, d))


@query("C18_rediscovered_leaves", 'SELECT g.doc_id, g."left", g."right", g.ent, l.leaf FROM ogold g JOIN ograms o ON o.doc_id = g.doc_id AND o."left" = g."left" AND o."right" = g."right" JOIN leaf l ON l.phrase = o.phrase', "ogold", "ograms", "leaf")
def rediscovered(spark: SparkSession, d: str) -> DataFrame:
    return spotting.rediscovered(gold(spark, d), tokens(spark, d), spotting.leaves(mentions(spark, d)), 2)


part("mention_counts", 'SELECT o.phrase, h.ent, count(*) AS n FROM half h JOIN ograms o ON o.doc_id = h.doc_id AND o."left" = h."left" AND o."right" = h."right" GROUP BY ALL', "half", "ograms")
part("phrase_counts", "SELECT phrase, count(*) AS occurs FROM matches GROUP BY phrase", "matches")
part("annotation_probability", "SELECT phrase, sum(n)::BIGINT AS annotated, occurs, sum(n) * 1.0 / occurs AS probability FROM mention_counts JOIN phrase_counts USING (phrase) GROUP BY phrase, occurs", "mention_counts", "phrase_counts")


def _probability(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    corpus = spotting.any_match(t, mentions(spark, d), 2).groupBy("phrase").agg(F.count("*").alias("occurs"))
    return spotting.by_annotation_probability(spotting.mention_counts(half(spark, d), t, 2), corpus)


@query("D8_mention_counts", "SELECT phrase, ent, n FROM mention_counts", "mention_counts")
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    return spotting.mention_counts(half(spark, d), tokens(spark, d), 2)


@query("D9_phrase_counts", "SELECT phrase, occurs FROM phrase_counts", "phrase_counts")
def phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    return any_spots(spark, d).groupBy("phrase").agg(F.count("*").alias("occurs"))


@query("D10_marginal_counts", "SELECT phrase, sum(n)::BIGINT AS n FROM mention_counts GROUP BY phrase", "mention_counts")
def marginal(spark: SparkSession, d: str) -> DataFrame:
    return mention_counts(spark, d).groupBy("phrase").agg(F.sum("n").alias("n"))


@query("B13_annotation_probability_filter", "SELECT phrase, annotated, occurs, round(probability, 6) AS probability FROM annotation_probability WHERE probability >= 0.3", "annotation_probability")
def probable(spark: SparkSession, d: str) -> DataFrame:
    return _probability(spark, d).filter("probability >= 0.3").select("phrase", "annotated", "occurs", F.round("probability", 6).alias("probability"))


@query("F9_phrases_by_probability", "SELECT phrase, row_number() OVER (ORDER BY probability, phrase) AS rank FROM annotation_probability", "annotation_probability")
def by_probability(spark: SparkSession, d: str) -> DataFrame:
    """Every phrase with its rank."""
    return positions(_probability(spark, d).select("phrase", "probability"), ["probability", "phrase"], "rank").select("phrase", "rank")


@query("B14_lemma_token_filter", """SELECT DISTINCT m.phrase, m.ent FROM (SELECT phrase, ent, unnest(str_split(phrase, '|')) AS t FROM mentions) m
  JOIN (SELECT DISTINCT p_name || '#' || (p_partkey % 3) AS ent, str_split(p_name, ' ')[2] AS t FROM part) l USING (ent, t)""", "mentions")
def lemma_filter(spark: SparkSession, d: str) -> DataFrame:
    lemmas = read(spark, d, "part").select(F.concat("p_name", F.lit("#"), (F.col("p_partkey") % 3).cast("string")).alias("ent"), F.split("p_name", " ")[1].alias("lemma")).distinct()
    return spotting.with_lemma_token(mentions(spark, d), lemmas)


part("bags", """SELECT g.ent, t.token, count(*) AS n FROM ogold g JOIN otok t ON t.doc_id = g.doc_id AND t.pos BETWEEN g."left" - 4 AND g."right" + 4 AND NOT (t.pos BETWEEN g."left" AND g."right") GROUP BY ALL""", "ogold", "otok")
part("ostats", "SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM otok GROUP BY token", "otok")
part("on_docs", "SELECT max(l_orderkey) + 1 AS n FROM lineitem")


@query("D12_context_bags", "SELECT ent, token, n FROM bags", "bags")
def bags(spark: SparkSession, d: str) -> DataFrame:
    return context.around(gold(spark, d), tokens(spark, d), 4, ["ent"])


def _n_docs(spark: SparkSession, d: str) -> int:
    return (read(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0] or -1) + 1


@query("D11_truncated_bags", """SELECT ent, token, n, round(weight, 4) AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY ent) AS total,
    coalesce(sum(weight) OVER (PARTITION BY ent ORDER BY weight DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT ent, token, n, n * (SELECT n FROM on_docs) * 1.0 / df AS weight FROM bags JOIN ostats USING (token))) WHERE before < 0.8 * total""", "bags", "ostats", "on_docs")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    out = context.truncated_bags(context.around(gold(spark, d), t, 4, ["ent"]), base.term_stats(t), _n_docs(spark, d), "ent")
    return out.withColumn("weight", F.round("weight", 4))


@query("E2_salient_words", """SELECT doc_id, token, tf, round(weight, 6) AS weight, CAST(index AS INTEGER) AS index FROM (SELECT *, sum(weight * weight) OVER (PARTITION BY doc_id) AS total,
    row_number() OVER w - 1 AS index, coalesce(sum(weight * weight) OVER (PARTITION BY doc_id ORDER BY weight DESC, token DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT doc_id, token, count(*) AS tf, count(*) * ln((SELECT n FROM on_docs) * 1.0 / (1 + any_value(df))) AS weight FROM otok JOIN ostats USING (token) GROUP BY doc_id, token)
  WINDOW w AS (PARTITION BY doc_id ORDER BY weight DESC, token DESC)) WHERE before <= 0.9 * total AND index <= 10""", "otok", "ostats", "on_docs")
def salient(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    return context.salient(t, base.term_stats(t), _n_docs(spark, d)).withColumn("weight", F.round("weight", 6))


@query("A16_keyword_in_context", """SELECT ent, doc_id, "left", string_agg(token, ' ' ORDER BY pos) AS line FROM (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY doc_id, "left") AS n FROM ogold) g
  JOIN (SELECT doc_id, pos, token FROM otok) t USING (doc_id) WHERE n <= 3 AND t.pos BETWEEN g."left" - 5 AND g."right" + 5 GROUP BY ent, doc_id, "left" """, "ogold", "otok")
def kwic(spark: SparkSession, d: str) -> DataFrame:
    return context.keyword_in_context(gold(spark, d), tokens(spark, d), 5, 3)


@query("A16_sampled_keyword_in_context", """SELECT ent, doc_id, "left", string_agg(token, ' ' ORDER BY pos) AS line FROM (SELECT *, row_number() OVER (PARTITION BY ent ORDER BY ((doc_id * 31 + "left") * 2654435761) % 1000003, doc_id, "left") AS n FROM ogold) g
  JOIN (SELECT doc_id, pos, token FROM otok) t USING (doc_id) WHERE n <= 3 AND t.pos BETWEEN g."left" - 5 AND g."right" + 5 GROUP BY ent, doc_id, "left" """, "ogold", "otok")
def kwic_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Mentions drawn by a hash of their place, in place of the first ones."""
    drawn = F.pmod((F.col("doc_id") * 31 + F.col("left")) * F.lit(2654435761), F.lit(1000003))
    return context.keyword_in_context(gold(spark, d), tokens(spark, d), 5, 3, drawn)


@query("E3_coalesced_mentions", """SELECT doc_id, ent, min("left") AS "left", max("right") AS "right", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id, ent ORDER BY "left") AS run
  FROM (SELECT doc_id, ent, "left", "right", CASE WHEN "left" <= max("right") OVER (PARTITION BY doc_id, ent ORDER BY "left" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new
  FROM (SELECT l_orderkey AS doc_id, l_suppkey % 4 AS ent, CAST(l_linenumber AS INTEGER) AS "left", CAST(l_linenumber AS INTEGER) AS "right" FROM lineitem))) GROUP BY doc_id, ent, run""")
def coalesced(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("l_linenumber").cast("int")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 4).alias("ent"), at.alias("left"), at.alias("right"))
    return context.coalesced(lines)


# --- naive Bayes: contexts are gold annotations of half the orders, features the tokens around -----------------

part("ctx", 'SELECT g.doc_id * 16 + g."left" AS ctx, l.leaf, g.ent, g.doc_id, g."left", g."right" FROM ogold g JOIN ograms o ON o.doc_id = g.doc_id AND o."left" = g."left" AND o."right" = g."right" JOIN leaf l ON l.phrase = o.phrase', "ogold", "ograms", "leaf")
part("feats", 'SELECT ctx, token AS feat, count(*) AS freq FROM ctx JOIN otok USING (doc_id) WHERE pos BETWEEN "left" - 4 AND "right" + 4 AND NOT (pos BETWEEN "left" AND "right") GROUP BY ctx, token', "ctx", "otok")
part("train_ctx", "SELECT * FROM ctx WHERE doc_id % 2 = 0", "ctx")
part("lfe", "SELECT leaf, feat, ent, sum(freq)::BIGINT AS freq FROM train_ctx JOIN feats USING (ctx) GROUP BY ALL", "train_ctx", "feats")
part("leaf_ent", "SELECT leaf, ent, n_ctx, coalesce(sum_freq, 0) AS sum_freq FROM (SELECT leaf, ent, count(*) AS n_ctx FROM train_ctx GROUP BY ALL) LEFT JOIN (SELECT leaf, ent, sum(freq)::BIGINT AS sum_freq FROM lfe GROUP BY ALL) USING (leaf, ent)", "train_ctx", "lfe")
part("vocab", "SELECT leaf, count(DISTINCT feat) AS vocab FROM lfe GROUP BY leaf", "lfe")
part("cands", "SELECT leaf, unnest(candidates) AS ent FROM leaf", "leaf")
part("priors", """SELECT leaf, c.ent, ln((coalesce(e.n_ctx, 0) + 1) * 1.0 / (coalesce(l.n_ctx, 0) + count(*) OVER (PARTITION BY leaf))) AS log_prior FROM cands c LEFT JOIN leaf_ent e USING (leaf, ent)
  LEFT JOIN (SELECT leaf, sum(n_ctx) AS n_ctx FROM leaf_ent GROUP BY leaf) l USING (leaf)""", "cands", "leaf_ent")
part("scores", """SELECT x.ctx, x.leaf, x.ent, c.ent AS cand, sum(f.freq * (ln(coalesce(k.freq, 0) + 1.0) - ln(coalesce(t.sum_freq, 0) + 1.0 * v.vocab))) + any_value(p.log_prior) AS log_score
  FROM ctx x JOIN cands c ON c.leaf = x.leaf JOIN vocab v ON v.leaf = x.leaf JOIN feats f ON f.ctx = x.ctx LEFT JOIN leaf_ent t ON t.leaf = x.leaf AND t.ent = c.ent
  LEFT JOIN lfe k ON k.leaf = x.leaf AND k.ent = c.ent AND k.feat = f.feat JOIN priors p ON p.leaf = x.leaf AND p.ent = c.ent WHERE x.doc_id % 2 = 1 GROUP BY x.ctx, x.leaf, x.ent, c.ent""", "ctx", "cands", "vocab", "feats", "leaf_ent", "lfe", "priors")


def _contexts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contexts, features and candidates."""
    scratch = Scratch(spark, "contexts")
    t, leaf = scratch.keep(tokens(spark, d), "tokens"), scratch.keep(spotting.leaves(mentions(spark, d)), "leaves")
    ctx = scratch.keep(spotting.rediscovered(gold(spark, d), t, leaf, 2).withColumn("ctx", F.col("doc_id") * 16 + F.col("left")), "contexts")
    feats = context.around(ctx, t, 4, ["ctx"]).select("ctx", F.col("token").alias("feat"), F.col("n").alias("freq"))
    return ctx, scratch.keep(feats, "features"), leaf.select("leaf", F.explode("candidates").alias("ent"))


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame]]:
    ctx, feats, cands = _contexts(spark, d)
    train = ctx.filter("doc_id % 2 = 0").select("ctx", "leaf", "ent")
    return ctx.filter("doc_id % 2 = 1").select("ctx", "leaf", "ent"), feats, cands, bayes.train(train, feats)


@query("D14_bayes_counts", "SELECT leaf, ent, n_ctx, sum_freq, vocab FROM leaf_ent JOIN vocab USING (leaf)", "leaf_ent", "vocab")
def counts(spark: SparkSession, d: str) -> DataFrame:
    model = _model(spark, d)[3]
    return model["leaf_ent"].join(model["vocab"], "leaf").select("leaf", "ent", "n_ctx", "sum_freq", "vocab")


@query("L5_leaf_feature_entity", "SELECT leaf, feat, ent, freq FROM lfe", "lfe")
def lfe(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d)[3]["lfe"]


@query("D15_log_priors", "SELECT leaf, ent, round(log_prior, 6) AS log_prior FROM priors", "priors")
def priors(spark: SparkSession, d: str) -> DataFrame:
    _, _, cands, model = _model(spark, d)
    return bayes.log_priors(cands, model).withColumn("log_prior", F.round("log_prior", 6))


@query("C22_bayes_scores", "SELECT ctx, cand, round(log_score, 5) AS log_score FROM scores", "scores")
def scores(spark: SparkSession, d: str) -> DataFrame:
    test, feats, cands, model = _model(spark, d)
    return bayes.score(test, feats, cands, model).select("ctx", "cand", F.round("log_score", 5).alias("log_score"))


part("ranked", """SELECT *, log_score - (max(log_score) OVER w + ln(sum(exp(log_score - m)) OVER w)) AS log_prob FROM (SELECT *, max(log_score) OVER (PARTITION BY ctx) AS m FROM scores) WINDOW w AS (PARTITION BY ctx)""", "scores")


@query("E1_softmax_probabilities", "SELECT ctx, cand, round(log_prob, 5) AS log_prob FROM ranked", "ranked")
def probabilities(spark: SparkSession, d: str) -> DataFrame:
    test, feats, cands, model = _model(spark, d)
    return bayes.normalized(bayes.score(test, feats, cands, model), ["ctx"]).select("ctx", "cand", F.round("log_prob", 5).alias("log_prob"))


@query("D29_annotator_accuracy", """SELECT count(*) AS n, round(avg(CASE WHEN rank = 0 THEN 1.0 ELSE 0 END), 2) AS accuracy FROM (SELECT cand, ent, row_number() OVER (PARTITION BY ctx ORDER BY round(log_score, 9) DESC, cand) - 1 AS rank FROM scores) WHERE cand = ent""", "scores")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    test, feats, cands, model = _model(spark, d)
    rounded = bayes.score(test, feats, cands, model).withColumn("log_score", F.round("log_score", 9))
    ranked = bayes.normalized(rounded, ["ctx"]).filter("cand = ent")
    return ranked.agg(F.count("*").alias("n"), F.round(F.avg((F.col("rank") == 0).cast("double")), 2).alias("accuracy"))


_CODE = "CAST(greatest(0, least(255, 255 - floor(sqrt(-round(log_prob, 6) / (ln(3.4028234663852886e38) / 65025)) + 1e-12))) AS INTEGER)"


@query("L4_scored_postings", f"""SELECT cand AS ent, ctx // 16 AS doc_id, CAST(ctx % 16 AS INTEGER) AS "left", 2::INTEGER AS size, leaf, row_number() OVER (PARTITION BY ctx ORDER BY round(log_score, 9) DESC, cand) - 1 AS rank, {_CODE} AS code FROM ranked""", "ranked")
def scored_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings of machine annotations: place and size of the span, its leaf, the candidate's rank and its quantised
    log-probability, sorted by entity, document and place."""
    test, feats, cands, model = _model(spark, d)
    scored = bayes.score(test, feats, cands, model).withColumn("log_score", F.round("log_score", 9))
    code = codec.encode_log_prob(F.round("log_prob", 6))
    place = (F.floor(F.col("ctx") / 16).alias("doc_id"), (F.col("ctx") % 16).cast("int").alias("left"), F.lit(2).alias("size"))
    rows = bayes.normalized(scored, ["ctx"]).select(F.col("cand").alias("ent"), *place, "leaf", F.col("rank").cast("long"), code.alias("code"))
    return rows.repartitionByRange("ent", "doc_id").sortWithinPartitions("ent", "doc_id", "left")


@query("B18_small_leaves", "SELECT leaf, sum(n_ctx)::BIGINT AS n_ctx FROM leaf_ent GROUP BY leaf HAVING sum(n_ctx) > 1", "leaf_ent")
def leaves_with_contexts(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d)[3]["leaf"].filter("n_ctx > 1")


part("lidstone", """SELECT leaf, "lambda", avg(CASE WHEN mine > coalesce(other, -1e300) THEN 1.0 ELSE 0 END)::DOUBLE AS accuracy, count(*) AS instances FROM
  (SELECT ctx, leaf, "lambda", max(s) FILTER (cand = ent) AS mine, max(s) FILTER (cand <> ent) AS other FROM
    (SELECT x.ctx, x.leaf, x.ent, c.ent AS cand, g."lambda", round(any_value(p.log_prior) + sum(CASE WHEN coalesce(f.freq, 0) = 0 THEN 0 ELSE
        f.freq * (ln(coalesce(k.freq, 0) - CASE WHEN c.ent = x.ent THEN f.freq ELSE 0 END + g."lambda") - ln(coalesce(t.sum_freq, 0) - CASE WHEN c.ent = x.ent THEN f.freq ELSE 0 END + g."lambda" * coalesce(v.vocab, 0))) END), 9) AS s
      FROM train_ctx x JOIN (SELECT leaf FROM leaf_ent GROUP BY leaf HAVING sum(n_ctx) > 1) USING (leaf) JOIN cands c ON c.leaf = x.leaf LEFT JOIN vocab v ON v.leaf = x.leaf
      CROSS JOIN (VALUES (0.01::DOUBLE), (0.1), (1.0), (10.0)) AS g("lambda") LEFT JOIN feats f ON f.ctx = x.ctx LEFT JOIN leaf_ent t ON t.leaf = x.leaf AND t.ent = c.ent
      LEFT JOIN lfe k ON k.leaf = x.leaf AND k.ent = c.ent AND k.feat = f.feat JOIN priors p ON p.leaf = x.leaf AND p.ent = c.ent GROUP BY x.ctx, x.leaf, x.ent, c.ent, g."lambda")
    GROUP BY ctx, leaf, "lambda") GROUP BY leaf, "lambda" QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY accuracy DESC, "lambda") = 1""", "train_ctx", "leaf_ent", "cands", "vocab", "feats", "lfe", "priors")


@query("K8_lidstone_tuning", 'SELECT leaf, "lambda", accuracy, instances FROM lidstone', "lidstone")
def lidstone(spark: SparkSession, d: str) -> DataFrame:
    """On the training contexts, each left out of the counts in turn; leaves with one context have none to tune on."""
    ctx, feats, cands = _contexts(spark, d)
    train = ctx.filter("doc_id % 2 = 0").select("ctx", "leaf", "ent")
    model = bayes.train(train, feats)
    grid = model["leaf"].filter("n_ctx > 1").select("leaf").withColumn("lambda", F.explode(F.array(*(F.lit(x) for x in (0.01, 0.1, 1.0, 10.0)))))
    scored = bayes.score(train, feats, cands, model, lambdas=grid, leave_one_out=True)
    return bayes.tuned(scored.withColumn("log_score", F.round("log_score", 9)))  # equal scores are equal


@query("D18_accuracy_averages", "SELECT round(avg(accuracy), 6) AS macro, round(sum(accuracy * instances) / sum(instances), 6) AS micro, sum(instances)::BIGINT AS instances FROM lidstone", "lidstone")
def averages(spark: SparkSession, d: str) -> DataFrame:
    return bayes.averages(lidstone(spark, d)).select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), "instances")


@query("D16_leaf_feature_workload", "SELECT leaf, feat, count(*) FILTER (doc_id % 2 = 0) AS n_train, count(*) FILTER (doc_id % 2 = 1) AS n_test FROM ctx JOIN feats USING (ctx) GROUP BY leaf, feat", "ctx", "feats")
def workload(spark: SparkSession, d: str) -> DataFrame:
    """How often each feature is asked for in a leaf's list, by contexts of either half."""
    ctx, feats, _ = _contexts(spark, d)
    half = lambda i: F.count_if(F.col("doc_id") % 2 == i)
    return ctx.join(feats, "ctx").groupBy("leaf", "feat").agg(half(0).alias("n_train"), half(1).alias("n_test"))


@query("D17_leaf_hit_probability", "SELECT leaf, round((count(*) + 1) * 1.0 / (sum(count(*)) OVER () + count(*) OVER ()), 8) AS p FROM train_ctx GROUP BY leaf", "train_ctx")
def leaf_hits(spark: SparkSession, d: str) -> DataFrame:
    n = _model(spark, d)[3]["leaf"]
    total = n.agg(F.sum("n_ctx").alias("total"), F.count("*").alias("leaves"))
    return n.crossJoin(F.broadcast(total)).select("leaf", F.round((F.col("n_ctx") + 1) / (F.col("total") + F.col("leaves")), 8).alias("p"))


@query("H22_phrase_strings", "SELECT DISTINCT replace(p_name, ' ', '|') AS phrase, len(str_split(p_name, ' '))::INTEGER AS n FROM part")
def phrase_strings(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(text.phrase(F.split("p_name", " ")).alias("phrase")).distinct()
    return p.select("phrase", F.size(text.phrase_tokens(F.col("phrase"))).alias("n"))


@query("C11_multi_valued_dictionary", "SELECT p_brand AS key, count(*) AS n_values, count(DISTINCT p_type) AS n_types FROM part GROUP BY p_brand")
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of a key's lists of values; the lists stay rows (key, value), as a key may have any number."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("key"), "p_partkey", "p_type")
    return p.groupBy("key").agg(F.count("p_partkey").alias("n_values"), F.count_distinct("p_type").alias("n_types"))


@query("C25_A15_redirects", """SELECT c.c_name AS name, coalesce(s.s_suppkey, t.s_suppkey) AS ent FROM customer c LEFT JOIN supplier s ON s.s_name = c.c_name
  LEFT JOIN supplier t ON t.s_name = replace(c.c_name, 'Customer', 'Supplier')""")
def redirects(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "customer").select(F.col("c_name").alias("name"))
    ents = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ent"))
    moved = names.select(F.col("name").alias("source"), F.replace("name", F.lit("Customer"), F.lit("Supplier")).alias("target"))
    return catalog.resolve(names, ents, moved)


@query("B21_phrase_selector", """SELECT doc_id, pos AS "left" FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tokens) WHERE token = 'of' AND next = 'the'""", "tokens")
def selector(spark: SparkSession, d: str) -> DataFrame:
    return ngrams(base.tokens(spark, d), 2).filter("phrase = 'of|the'").select("doc_id", "left")
