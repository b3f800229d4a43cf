"""Stores and sinks, query checks, statistics and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions import intervals, metrics
from spanweave.operators import catalog, context, interpret, rank, spotting
from spanweave.operators.joins import band_join, dense_ids, positions, small
from spanweave.plans.query import QueryError, check, parse
from spanweave.scratch import Scratch
from spanweave.settings import Settings
from spanweave.sources import corpus
from spanweave.suite import SUITE, base, linking, ranking, read, searching

query, part = SUITE.add, SUITE.part


@query("A2_A3_A4_record_store", "SELECT doc_id, text FROM documents")
def record_store(spark: SparkSession, d: str) -> DataFrame:
    """Append in the order of ids, reopen, read all."""
    store = f"{Scratch(spark, 'store').base}/corpus"
    corpus.write_corpus(read(spark, d, "documents").select("doc_id", "text"), store, 4)
    return corpus.read_corpus(spark, store)


@query("A9_point_get", "SELECT doc_id, lang FROM documents WHERE doc_id = 7")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return corpus.get_document(read(spark, d, "documents"), 7).select("doc_id", "lang")


@query("A11_hyper_view", """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS pos, n.name, count(*) AS n FROM lineitem JOIN
  (SELECT sub AS key, sub AS name FROM geo_closure UNION SELECT sub, sup FROM geo_closure) n ON n.key = 's' || l_suppkey GROUP BY ALL""", "geo_closure")
def hyper_view(spark: SparkSession, d: str) -> DataFrame:
    """At each annotated position its entity and all types above."""
    up = catalog.closure(searching.geo(spark, d), include_self=True)
    at = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("pos"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("sub"))
    return at.join(small(up.filter(F.col("sub").startswith("s"))), "sub").groupBy("doc_id", "pos", F.col("sup").alias("name")).agg(F.count("*").alias("n"))


@query("A14_L9_token_id_arrays", """SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS ids FROM tokens JOIN (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM tokens WHERE regexp_full_match(token, '[a-z]+'))) USING (token) GROUP BY doc_id""", "tokens")
def id_arrays(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d).filter("token RLIKE '^[a-z]+$'")
    ids = t.join(dense_ids(t, "token"), "token").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return ids.select("doc_id", F.array_join(F.col("x.id").cast("array<string>"), ",").alias("ids"))


@query("A26_F4_sorted_index", """SELECT cat, ent, doc_id, "left" FROM types""", "types")
def sorted_index(spark: SparkSession, d: str) -> DataFrame:
    """Postings written by key, each file sorted by key, document and place, and read back."""
    types = base.annotated(spark, d)[3].select("cat", "ent", "doc_id", "left")
    path = f"{Scratch(spark, 'index').base}/types"
    types.repartitionByRange("cat", "doc_id").sortWithinPartitions("cat", "doc_id", "ent", "left").write.parquet(path)  # a type may have any number of postings
    return spark.read.parquet(path)


@query("A28_L8_term_entity_postings", """SELECT t.token, a.ent, a.doc_id, a."left" AS ent_pos, t.pos AS token_pos FROM annots a JOIN tokens t ON a.doc_id = t.doc_id AND t.pos BETWEEN a."left" - 3 AND a."right" + 3
  WHERE t.pos <> a."left" """, "annots", "tokens")
def term_entity(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d)
    met = band_join(base.annots(t, base.ents(base.term_stats(t))), t, ["doc_id"], F.col("left") - 3, F.col("right") + 3, F.col("pos"), 16)
    return met.filter("pos <> left").select("token", "ent", "doc_id", F.col("left").alias("ent_pos"), F.col("pos").alias("token_pos"))


@query("A30_accuracy_table", """SELECT qid, round(avg(CASE WHEN label THEN 1.0 ELSE 0 END), 4)::DOUBLE AS accuracy FROM ranked_entities WHERE rank <= 5 GROUP BY qid""", "ranked_entities")
def accuracy_table(spark: SparkSession, d: str) -> DataFrame:
    top = rank.ranked(ranking.entity_scores(spark, d)).filter("rank <= 5")
    path = f"{Scratch(spark, 'accuracy').base}/table"
    top.groupBy("qid").agg(F.round(F.avg(F.col("label").cast("double")), 4).alias("accuracy")).write.json(path)
    return spark.read.schema("qid long, accuracy double").json(path)


@query("A32_text_lines", "SELECT count(*) AS n_lines, CAST(sum(length(x)) AS BIGINT) AS n_chars FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Scratch(spark, 'lines').base}/text"
    read(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return spark.read.text(path, lineSep="\n").agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).cast("long").alias("n_chars"))


SAMPLES = ['uw(20 +[person] "had a little" lamb)', "uw(5 +a {Bill_Gates} [t])", "ow(5 [t] a)", 'uw(5 "a [t]")', "uw(5 a) uw(5 b)", "uw(5 -[t] a)", "uw(5 [t] -a)", "uw(5 a b)", "uw(5 12)"]


@query("Q1_Q2_B7_query_validity", "SELECT * FROM (VALUES (0, true, true), (1, true, true), (2, true, false), (3, false, false), (4, false, false), (5, true, true), (6, true, false), (7, true, false), (8, false, false)) AS t(sample, parses, valid)")
def validity(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for i, text in enumerate(SAMPLES):
        parses = valid = False
        try:
            c = parse(text)
            parses = True
            check(c)
            valid = True
        except QueryError:
            pass
        rows.append((i, parses, valid))
    return spark.createDataFrame(rows, "sample int, parses boolean, valid boolean")


@query("Q3_Q6_syntax_tree", "SELECT * FROM (VALUES (0, 'must', 'binding', 'person'), (1, 'may', 'phrase', 'had a little'), (2, 'may', 'token', 'lamb')) AS t(matcher, exist, kind, keys)")
def syntax_tree(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, m.exist, m.kind, " ".join(a.key for a in m.atoms)) for i, m in enumerate(parse(SAMPLES[0]).matchers)]
    return spark.createDataFrame(rows, "matcher int, exist string, kind string, keys string")


@query("B8_exist_semantics", """SELECT doc_id, bool_or(token = 'and') AS may FROM tokens GROUP BY doc_id HAVING bool_or(token = 'the') AND NOT bool_or(token = 'when')""", "tokens")
def exist(spark: SparkSession, d: str) -> DataFrame:
    has = lambda w: F.max(F.col("token") == w)
    t = base.tokens(spark, d).filter(F.col("token").isin("the", "when", "and"))
    return t.groupBy("doc_id").agg(has("and").alias("may"), has("the").alias("must"), has("when").alias("no")).filter("must AND NOT no").select("doc_id", "may")


@query("B12_annotation_policy", "SELECT ctx, cand FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(log_score, 9) DESC, cand) - 1 AS rank FROM scores) WHERE rank = 0 AND cand NOT LIKE '%#w'", "scores")
def policy(spark: SparkSession, d: str) -> DataFrame:
    """The first candidate, unless that stands for none (here: the mentions of one word)."""
    from spanweave.operators import bayes

    test, feats, cands, model = linking._model(spark, d)
    ranked = bayes.normalized(bayes.score(test, feats, cands, model).withColumn("log_score", F.round("log_score", 9)), ["ctx"])
    return bayes.policy(ranked, F.col("cand").endswith("#w")).select("ctx", "cand")


@query("B19_restricted_leaves", "SELECT leaf, ent, n_ctx FROM leaf_ent WHERE leaf IN (1, 3, 5)", "leaf_ent")
def restricted(spark: SparkSession, d: str) -> DataFrame:
    return linking._model(spark, d)[3]["leaf_ent"].filter(F.col("leaf").isin(1, 3, 5)).select("leaf", "ent", "n_ctx")


@query("B20_feature_projection", "SELECT qid, ent, round(sum(f4), 4) AS price, round(sum(f1), 4) AS quantity FROM sfv GROUP BY ALL", "sfv")
def projection(spark: SparkSession, d: str) -> DataFrame:
    at = {"quantity": 1, "discount": 2, "tax": 3, "price": 4}
    chosen = [F.round(F.sum(F.element_at("fv", at[c])), 4).alias(c) for c in ("price", "quantity")]
    return ranking.sfv(spark, d).groupBy("qid", "ent").agg(*chosen)


@query("C23_interpretations", "SELECT qid, ent, count(*) AS n FROM (SELECT DISTINCT c.qid, c.ent, c.cat, h.b, h.e FROM icell c JOIN ihint h ON h.qid = c.qid) GROUP BY ALL", "icell", "ihint")
def interpretations(spark: SparkSession, d: str) -> DataFrame:
    from spanweave.functions.text import hint_windows

    p = read(spark, d, "part")
    types = p.select(F.concat(F.lit("e"), (F.col("p_partkey") % 40).cast("string")).alias("ent"), F.col("p_type").alias("cat")).distinct()
    hints = ranking._asked(spark).select("qid", F.explode(hint_windows(F.col("words"))).alias("h"))
    return interpret.snippet_counts(ranking._witnesses(spark, d)).select("qid", "ent").join(types, "ent").join(F.broadcast(hints), "qid").groupBy("qid", "ent").agg(F.count("*").alias("n"))


@query("D3_sorted_run_reduce", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def reduce(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("D13_context_collection", """SELECT kind, count(*) AS n FROM (
  SELECT 'positive' AS kind FROM spots s JOIN half h ON s.doc_id = h.doc_id AND s."left" = h."left" AND s."right" = h."right"
  UNION ALL SELECT 'negative' FROM spots s WHERE NOT EXISTS (SELECT 1 FROM half h WHERE h.doc_id = s.doc_id AND h."left" <= s."right" AND s."left" <= h."right")) GROUP BY kind""", "spots", "half")
def collection(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "collection")
    s, g = scratch.keep(linking.spots(spark, d), "spots"), linking.half(spark, d)
    kind = lambda df, k: df.select(F.lit(k).alias("kind"))
    return kind(spotting.positive(s, g), "positive").union(kind(spotting.negative(s, g), "negative")).groupBy("kind").agg(F.count("*").alias("n"))


@query("D13_collected_contexts", """SELECT kind, s.doc_id, s."left", t.token AS feat, count(*) AS freq FROM (
  SELECT 'positive' AS kind, s.doc_id, s."left", s."right" FROM spots s JOIN half h ON s.doc_id = h.doc_id AND s."left" = h."left" AND s."right" = h."right"
  UNION ALL SELECT 'negative', s.doc_id, s."left", s."right" FROM spots s WHERE NOT EXISTS (SELECT 1 FROM half h WHERE h.doc_id = s.doc_id AND h."left" <= s."right" AND s."left" <= h."right")) s
  JOIN otok t ON t.doc_id = s.doc_id AND t.pos BETWEEN s."left" - 4 AND s."right" + 4 AND NOT (t.pos BETWEEN s."left" AND s."right") GROUP BY ALL""", "spots", "half", "otok")
def collected(spark: SparkSession, d: str) -> DataFrame:
    """The words around each spot that is annotated, and around each that no annotation touches."""
    scratch = Scratch(spark, "collection")
    t = scratch.keep(linking.tokens(spark, d), "tokens")
    s, g = scratch.keep(spotting.maximal(spotting.any_match(t, linking.mentions(spark, d), 2)), "spots"), linking.half(spark, d)
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "doc_id", "left", "right")
    both = kind(spotting.positive(s, g), "positive").union(kind(spotting.negative(s, g), "negative"))
    bags = context.around(both.withColumn("at", F.col("left")), t, 4, ["kind", "doc_id", "at"])
    return bags.select("kind", "doc_id", F.col("at").alias("left"), F.col("token").alias("feat"), F.col("n").alias("freq"))


@query("D27_snippet_statistics", "SELECT qid, count(*) FILTER (label) AS good, count(*) FILTER (NOT label) AS bad, count(DISTINCT ent) FILTER (label) AS good_ents, count(DISTINCT ent) FILTER (NOT label) AS bad_ents FROM sfv GROUP BY qid", "sfv")
def statistics(spark: SparkSession, d: str) -> DataFrame:
    per_ent = ranking.sfv(spark, d).groupBy("qid", "ent", "label").agg(F.count("*").alias("n"))
    of = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).cast("long")
    return per_ent.groupBy("qid").agg(of(F.col("label")).alias("good"), of(~F.col("label")).alias("bad"), F.count_if("label").alias("good_ents"), F.count_if(~F.col("label")).alias("bad_ents"))


part("spanned", 'SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INTEGER) AS "left", CAST(max(l_linenumber + l_quantity % 3) AS INTEGER) AS "right" FROM lineitem GROUP BY 1, 2')


@query("E8_contained_spans", 'SELECT a.doc_id, a."left", a."right" FROM spanned a WHERE NOT EXISTS (SELECT 1 FROM spanned b WHERE b.doc_id = a.doc_id AND b."left" < a."left" AND b."right" >= a."right")', "spanned")
def contained(spark: SparkSession, d: str) -> DataFrame:
    right = (F.col("l_linenumber") + F.col("l_quantity") % 3).cast("int")
    s = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("left")).agg(F.max(right).alias("right"))
    return spotting.not_contained(s)


@query("E9_prefix_hits", "SELECT qid, rank::BIGINT AS rank, count(*) FILTER (label) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM ranked_entities", "ranked_entities")
def prefix_hits(spark: SparkSession, d: str) -> DataFrame:
    return metrics.prefix_hits(rank.ranked(ranking.entity_scores(spark, d)), "qid").select("qid", F.col("rank").cast("long"), "hits")


@query("F2_F3_F6_compaction", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL")
def compaction(spark: SparkSession, d: str) -> DataFrame:
    """Many sorted runs merged into few files, sorted over all."""
    lines, scratch = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), Scratch(spark, "runs")
    runs = scratch.keep(lines.repartition(12).sortWithinPartitions("l_orderkey", "l_linenumber"), "runs")
    whole = scratch.keep(runs.repartitionByRange(4, "l_orderkey", "l_linenumber").sortWithinPartitions("l_orderkey", "l_linenumber"), "whole")
    return whole.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"))


@query("H1_H2_H3_energies", "SELECT token, round((SELECT n FROM n_docs) * 1.0 / df, 6) AS energy, round(ln(1 + (SELECT n FROM n_docs) * 1.0 / df), 6) AS log_energy, round(ln(1 + (SELECT n FROM n_docs) * 1.0 / cf), 6) AS weight FROM term_stats", "term_stats", "n_docs")
def energies(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(float(base.n_docs(spark, d)))
    return base.term_stats(base.tokens(spark, d)).select("token", F.round(n / F.col("df"), 6).alias("energy"), F.round(F.log1p(n / F.col("df")), 6).alias("log_energy"), F.round(F.log1p(n / F.col("cf")), 6).alias("weight"))


@query("H4_proximity", """SELECT a.l_orderkey AS doc_id, a.l_linenumber AS x, b.l_linenumber AS y, CASE WHEN a.l_linenumber + 1 >= b.l_linenumber THEN 1.0 ELSE round(1.0 / (b.l_linenumber - a.l_linenumber - 1), 6) END::DOUBLE AS proximity, count(*) AS n
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY ALL""")
def proximity(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("x"))
    both = lines.join(lines.withColumnRenamed("x", "y"), "doc_id").filter("x < y")
    p = F.round(intervals.proximity(F.col("x"), F.col("x") + 1, F.col("y"), F.col("y") + 1), 6)
    return both.groupBy("doc_id", "x", "y", p.alias("proximity")).agg(F.count("*").alias("n"))


@query("H14_H15_margin_functions", "SELECT qid, ent, round(sum(ln(1 + exp(1 + x))), 5) AS hinge, round(sum(1 / (1 + exp(-1 - x))), 5) AS sigmoid, round(sum(sign(x) * ln(1 + abs(x))), 5) AS softened FROM raw GROUP BY ALL", "raw")
def margins(spark: SparkSession, d: str) -> DataFrame:
    x = rank.dot(F.col("fv"), F.array(*map(F.lit, ranking.W)))
    s = ranking.sfv(spark, d).select("qid", "ent", x.alias("x"))
    total = lambda f: F.round(F.sum(f(F.col("x"))), 5)
    return s.groupBy("qid", "ent").agg(total(rank.soft_hinge).alias("hinge"), total(rank.sigmoid).alias("sigmoid"), total(rank.log_soften).alias("softened"))


@query("H18_H19_snippet_model", """SELECT qid, ent, word, round(ln(((0.01 + w.n) / (0.02 + n_ent)) / (1 - (0.01 + w.n) / (0.02 + n_ent))), 6) AS odds, round(p_ent, 6)::DOUBLE AS prior FROM qewc w JOIN isupport USING (qid, ent)""", "qewc", "isupport")
def snippet_model(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "snippets")
    w = scratch.keep(ranking._witnesses(spark, d), "witnesses")
    support = interpret.snippet_counts(w).withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy("qid")))
    p = (interpret.SNIPPET_SMOOTHER + F.col("c")) / (2 * interpret.SNIPPET_SMOOTHER + F.col("n"))
    joined = interpret.snippet_words(w).withColumnRenamed("n", "c").join(support, ["qid", "ent"])
    return joined.select("qid", "ent", "word", F.round(interpret.log_odds(p), 6).alias("odds"), F.round("prior", 6).alias("prior"))


@query("K1_K5_penalty_grid")
def penalty_grid(spark: SparkSession, d: str) -> DataFrame:
    """Leave-some-queries-out scores for several penalties; swapped pairs of each."""
    scored = rank.cross_validated(ranking.sfv(spark, d), "sum", 5, [0.1, 1.0, 10.0], 4)
    keyed = scored.withColumn("key", F.concat_ws("|", "qid", "sigma2"))
    return metrics.tied_pairs(keyed, "key").withColumn("sigma2", F.split("key", r"\|")[1].cast("double")).groupBy("sigma2").agg(F.avg("swap_fraction").alias("swap_fraction"))


@query("L6_leaf_entity_features", "SELECT leaf, ent, count(*) AS n_feats, sum(freq)::BIGINT AS freq FROM lfe GROUP BY ALL", "lfe")
def leaf_entity(spark: SparkSession, d: str) -> DataFrame:
    return linking._model(spark, d)[3]["lfe"].groupBy("leaf", "ent").agg(F.count("*").alias("n_feats"), F.sum("freq").alias("freq"))


@query("C12_spots_per_document", "SELECT doc_id, count(*) AS n FROM spots GROUP BY doc_id", "spots")
def spots_per_document(spark: SparkSession, d: str) -> DataFrame:
    return linking.spots(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("E12_leaf_streams", "SELECT leaf, row_number() OVER (PARTITION BY leaf ORDER BY ctx) AS place, ctx FROM train_ctx", "train_ctx")
def leaf_streams(spark: SparkSession, d: str) -> DataFrame:
    """All contexts of each leaf in order, one a row; place counts from 1 within the leaf."""
    ctx = positions(linking._contexts(spark, d)[0].filter("doc_id % 2 = 0").select("leaf", "ctx"), ["leaf", "ctx"], "at")
    first = ctx.groupBy("leaf").agg(F.min("at").alias("first"))
    return ctx.join(small(first), "leaf").select("leaf", (F.col("at") - F.col("first") + 1).alias("place"), "ctx")


@query("H23_bags_of_unit_sum", "SELECT ent, token, n, round(n * 1.0 / sum(n) OVER (PARTITION BY ent), 6)::DOUBLE AS share FROM bags", "bags")
def bag_weights(spark: SparkSession, d: str) -> DataFrame:
    """Bags scaled to a sum of one."""
    b = context.around(linking.gold(spark, d), linking.tokens(spark, d), 4, ["ent"])
    return b.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("ent")), 6))


@query("B1_stems")
def stems(spark: SparkSession, d: str) -> DataFrame:
    """Counts of stems of English documents; words are stemmed once each."""
    from spanweave.functions.stemmer import stemmed
    from spanweave.functions.text import words

    english = read(spark, d, "documents").filter("lang = 'en'").select(F.explode(words(F.col("text"))).alias("token"))
    return english.groupBy("token").agg(F.count("*").alias("n")).groupBy(stemmed(F.col("token")).alias("stem")).agg(F.sum("n").alias("n"))


@query("J1_J10_configured_features", "SELECT qid, ent, count(*)::DOUBLE AS support, round(max(greatest(f1, f2, f3, f4)), 8) AS strongest FROM sfv GROUP BY qid, ent", "sfv")
def configured_features(spark: SparkSession, d: str) -> DataFrame:
    chosen = Settings.of(spark, features="support, strongest").features(F.col("fv"))
    return ranking.sfv(spark, d).groupBy("qid", "ent").agg(*chosen).withColumn("strongest", F.round("strongest", 8))


@query("J2_configured_terms", "SELECT lower(trim(c_mktsegment)) AS term, count(*) AS n FROM customer GROUP BY 1")
def configured_terms(spark: SparkSession, d: str) -> DataFrame:
    term = Settings.of(spark, terms="lower").term_processor()
    return read(spark, d, "customer").groupBy(term(F.col("c_mktsegment")).alias("term")).agg(F.count("*").alias("n"))


@query("J3_configured_catalog", "SELECT DISTINCT 'p' || p_partkey AS ent, p_type AS cat FROM part")
def configured_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").withColumn("key", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    line = lambda *c: p.select(F.concat_ws("\t", *c).alias("value"))
    files = line("key", F.lit("x")), line(F.lit("1"), "p_type", F.lit("root")), line(F.lit("1"), "key", "p_type"), line(F.lit("1"), "p_name", "key")
    return Settings.of(spark, catalog="tsv").catalog()(*files)["ent_cat"]


@query("J5_configured_reducer", "SELECT user_id, event_type, max(event_id) AS value FROM events GROUP BY ALL")
def configured_reducer(spark: SparkSession, d: str) -> DataFrame:
    reducer = Settings.of(spark, reducer="greatest").reducer()
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(reducer(F.col("event_id")).alias("value"))
