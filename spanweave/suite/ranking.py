"""Scoring, ranking and its metrics, query interpretation, encodings, sorting.

Snippets are lines of orders: the query is the order's number modulo 40, the entity the part's modulo 30, features
are quantity, discount, tax and price, scaled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions import codec, metrics, text
from spanweave.operators import interpret, rank
from spanweave.operators.joins import dense_ids, positions, small
from spanweave.scratch import Scratch
from spanweave.suite import SUITE, base, read

query, part = SUITE.add, SUITE.part
W = [0.5, -0.3, 0.2, 0.4]

part("sfv", """SELECT l_orderkey % 40 AS qid, l_partkey % 30 AS ent, ((l_partkey % 30) * 7 + l_orderkey % 40) % 4 = 0 AS label,
  CAST(l_quantity AS DOUBLE) / 50 AS f1, CAST(l_discount AS DOUBLE) * 10 AS f2, CAST(l_tax AS DOUBLE) * 10 AS f3, CAST(l_extendedprice AS DOUBLE) / 100000 AS f4 FROM lineitem""")
part("raw", "SELECT qid, ent, label, 0.5 * f1 - 0.3 * f2 + 0.2 * f3 + 0.4 * f4 AS x FROM sfv", "sfv")
part("entity_scores", "SELECT qid, ent, bool_or(label) AS label, round(sum(x) + 0.1 * count(*), 6) AS score FROM raw GROUP BY qid, ent", "raw")
part("ranked_entities", "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ent) AS rank FROM entity_scores", "entity_scores")


def sfv(spark: SparkSession, d: str) -> DataFrame:
    x = lambda c, s: F.col(c).cast("double") * s
    qid, ent = F.col("l_orderkey") % 40, F.col("l_partkey") % 30
    fv = F.array(F.col("l_quantity").cast("double") / 50, x("l_discount", 10), x("l_tax", 10), F.col("l_extendedprice").cast("double") / 100000)
    return read(spark, d, "lineitem").select(qid.alias("qid"), ent.alias("ent"), ((ent * 7 + qid) % 4 == 0).alias("label"), fv.alias("fv"))


def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    return rank.score_sum(sfv(spark, d), [*W, 0.1]).withColumn("score", F.round("score", 6))


query("D22_score_sum", "SELECT qid, ent, label, score FROM entity_scores", "entity_scores")(entity_scores)


@query("D22_score_softmax", "SELECT qid, ent, bool_or(label) AS label, round(sum(sign(x) * ln(1 + abs(x))), 6) AS score FROM raw GROUP BY qid, ent", "raw")
def softmax(spark: SparkSession, d: str) -> DataFrame:
    return rank.score_softmax(sfv(spark, d), W).withColumn("score", F.round("score", 6))


@query("D22_score_noisy_or", "SELECT qid, ent, bool_or(label) AS label, round(1 - exp(sum(ln(1 - 1 / (1 + exp(-1 - x))))), 6) AS score FROM raw WHERE l < 4 GROUP BY qid, ent".replace("WHERE l < 4 ", ""), "raw")
def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return rank.score_noisy_or(sfv(spark, d), W).withColumn("score", F.round("score", 6))


@query("F10_ranked_entities", "SELECT qid, ent, rank FROM ranked_entities WHERE rank <= 10", "ranked_entities")
def ranked(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(entity_scores(spark, d)).filter("rank <= 10").select("qid", "ent", F.col("rank").cast("long"))


part("truth", "SELECT qid, count(*) + 1 AS n_good FROM entity_scores WHERE label GROUP BY qid", "entity_scores")
part("sums", """SELECT qid, count(*) FILTER (label) AS good, count(*) FILTER (NOT label) AS bad, sum(bad_before) FILTER (label) AS swaps, min(rank) FILTER (label) AS first,
  count(*) FILTER (label AND rank <= 10) AS top_hits, sum(hits * 1.0 / rank) FILTER (label) AS precisions, sum(CASE WHEN rank <= 2 THEN 1.0 ELSE 1 / log2(rank) END) FILTER (label AND rank <= 10) AS dcg
  FROM (SELECT *, count(*) FILTER (label) OVER w AS hits, count(*) FILTER (NOT label) OVER w AS bad_before FROM ranked_entities WINDOW w AS (PARTITION BY qid ORDER BY rank)) GROUP BY qid""", "ranked_entities")


@query("H8_H12_ranking_metrics", """SELECT s.qid, round(CASE WHEN good = 0 THEN -1.0 WHEN bad = 0 THEN 0.0 ELSE -(swaps + greatest(coalesce(n_good, good) - good, 0) * bad) * 1.0 / (good * bad + greatest(coalesce(n_good, good) - good, 0) * bad) END, 6)::DOUBLE AS pair_swaps,
  round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr, round(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END, 6)::DOUBLE AS mrr_at, round(top_hits / 10.0, 6)::DOUBLE AS p_at, round(coalesce(precisions / n_good, 0), 6)::DOUBLE AS ap,
  round(CASE WHEN top_hits > 0 THEN dcg / (SELECT sum(CASE WHEN r <= 2 THEN 1.0 ELSE 1 / log2(r) END) FROM unnest(range(1, top_hits + 1)) AS t(r)) ELSE 0 END, 6)::DOUBLE AS ndcg_at
  FROM sums s LEFT JOIN truth t ON s.qid = t.qid""", "sums", "truth")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    scored = entity_scores(spark, d)
    truth = scored.filter("label").groupBy("qid").agg((F.count("*") + 1).alias("n_good"))
    out = metrics.metrics(rank.ranked(scored), truth, "qid")
    return out.select("qid", *(F.round(c, 6).alias(c) for c in out.columns if c != "qid"))


@query("H13_pair_swap_fraction", """SELECT qid, round(coalesce(sum(CASE WHEN g.score <= b.score THEN 1 ELSE 0 END) * 1.0 / count(*), 0), 6)::DOUBLE AS swap_fraction
  FROM entity_scores g JOIN entity_scores b USING (qid) WHERE g.label AND NOT b.label GROUP BY qid""", "entity_scores")
def swap_fraction(spark: SparkSession, d: str) -> DataFrame:
    return metrics.tied_pairs(entity_scores(spark, d), "qid").select("qid", F.round("swap_fraction", 6).alias("swap_fraction"))


@query("C21_good_bad_pairs", "SELECT g.qid, g.ent AS good, b.ent AS bad FROM entity_scores g JOIN entity_scores b USING (qid) WHERE g.label AND NOT b.label", "entity_scores")
def good_bad(spark: SparkSession, d: str) -> DataFrame:
    return rank.pairs(entity_scores(spark, d))


@query("B17_usable_queries", "SELECT qid FROM sfv GROUP BY qid HAVING bool_or(label) AND NOT bool_and(label)", "sfv")
def usable(spark: SparkSession, d: str) -> DataFrame:
    return rank.usable(sfv(spark, d))


@query("K6_H25_folds", "SELECT DISTINCT qid, CAST(floor((qid * 2654435761) % 1000003 / 1000003.0 * 5) + 1 AS INTEGER) AS fold FROM sfv", "sfv")
def folds(spark: SparkSession, d: str) -> DataFrame:
    return sfv(spark, d).select("qid").distinct().withColumn("fold", rank.fold_of(F.col("qid"), 5))


@query("A29_letor_lines", """SELECT CASE WHEN bool_or(label) THEN '+1' ELSE '-1' END || ' qid:' || qid || ' 1:' || CAST(round(sum(f1), 8) AS DECIMAL(28, 8)) || ' 2:' || CAST(round(sum(f2), 8) AS DECIMAL(28, 8))
    || ' 3:' || CAST(round(sum(f3), 8) AS DECIMAL(28, 8)) || ' 4:' || CAST(round(sum(f4), 8) AS DECIMAL(28, 8)) || ' 5:' || CAST(count(*) AS DECIMAL(28, 8)) AS line FROM sfv GROUP BY qid, ent""", "sfv")
def letor(spark: SparkSession, d: str) -> DataFrame:
    """Written to a text sink, one line for each entity, and read back."""
    path = f"{Scratch(spark, 'letor').base}/lines"
    rank.letor(rank.summed(sfv(spark, d), 4)).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def _trained(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rank.ranked(rank.cross_validated(sfv(spark, d), kind, 5, [1.0], 4)).select("qid", "ent", "label", "score", F.col("rank").cast("long"))

    return run


query("K2_train_sum")(_trained("sum"))
query("K3_train_softmax")(_trained("softmax"))
query("K4_train_noisy_or")(_trained("noisy_or"))


@query("D19_best_per_query", """SELECT qid, arg_max(c, (acc, -c)) AS c, max(acc) AS acc FROM (SELECT qid, l AS c, round(avg(CASE WHEN x > l / 4.0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS acc FROM raw, unnest(range(0, 4)) AS t(l) GROUP BY ALL) GROUP BY qid""", "raw")
def best(spark: SparkSession, d: str) -> DataFrame:
    x = sfv(spark, d).select("qid", rank.dot(F.col("fv"), F.array(*map(F.lit, W))).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")).withColumn("c", F.col("c").cast("long"))
    acc = x.groupBy("qid", "c").agg(F.round(F.avg((F.col("x") > F.col("c") / 4).cast("double")), 6).alias("acc"))
    return acc.groupBy("qid").agg(F.max_by("c", F.struct("acc", -F.col("c"))).alias("c"), F.max("acc").alias("acc"))


@query("D20_equal_depth_thresholds", """SELECT CAST(v AS DOUBLE) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY v = lo OR v = hi ORDER BY n DESC, v DESC) AS k FROM
  (SELECT l_quantity AS v, count(*) AS n, min(l_quantity) OVER () AS lo, max(l_quantity) OVER () AS hi FROM lineitem GROUP BY l_quantity)) WHERE v = lo OR v = hi OR k <= 3""")
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Five slots over the distinct values: the ends, and of those between the three most frequent."""
    n = read(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("v")).agg(F.count("*").alias("n"))
    ends = F.broadcast(n.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    marked = n.crossJoin(ends).withColumn("end", (F.col("v") == F.col("lo")) | (F.col("v") == F.col("hi")))
    inner = marked.filter("NOT end").orderBy(F.desc("n"), F.desc("v")).limit(3)
    return marked.filter("end").unionByName(inner).select(F.col("v").cast("double").alias("threshold"))


@query("D21_grid_and_rectangle", """SELECT a.i, a.j, a.n, sum(b.n)::BIGINT AS rectangle FROM (SELECT CAST(floor(f1 * 4) AS BIGINT) AS i, CAST(floor(f2 * 4) AS BIGINT) AS j, count(*) AS n FROM sfv GROUP BY ALL) a
  JOIN (SELECT CAST(floor(f1 * 4) AS BIGINT) AS i, CAST(floor(f2 * 4) AS BIGINT) AS j, count(*) AS n FROM sfv GROUP BY ALL) b ON b.i >= a.i AND b.j >= a.j GROUP BY a.i, a.j, a.n""", "sfv")
def grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a 2-D histogram (a small table), and for each the sum over all cells that are no less in both."""
    cell = lambda i: F.floor(F.element_at("fv", i) * 4).cast("long")
    n = sfv(spark, d).groupBy(cell(1).alias("i"), cell(2).alias("j")).agg(F.count("*").alias("n"))
    b = n.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("n").alias("bn"))
    return n.join(F.broadcast(b), (F.col("bi") >= F.col("i")) & (F.col("bj") >= F.col("j"))).groupBy("i", "j", "n").agg(F.sum("bn").alias("rectangle"))


@query("H7_cell_features", """SELECT s.qid, s.ent, s.cell, s.n, g.n AS grid FROM (SELECT qid, ent, CAST(floor(f1 * 4) * 8 + floor(f2 * 4) AS BIGINT) AS cell, count(*) AS n FROM sfv GROUP BY ALL) s
  JOIN (SELECT CAST(floor(f1 * 4) * 8 + floor(f2 * 4) AS BIGINT) AS cell, count(*) AS n FROM sfv GROUP BY ALL) g USING (cell)""", "sfv")
def cell_features(spark: SparkSession, d: str) -> DataFrame:
    """Features that stand for cells of the grid: for each entity the cells that its snippets are in, how many are, and
    the value that the grid has there."""
    cell = (F.floor(F.element_at("fv", 1) * 4) * 8 + F.floor(F.element_at("fv", 2) * 4)).cast("long").alias("cell")
    own = sfv(spark, d).groupBy("qid", "ent", cell).agg(F.count("*").alias("n"))
    return own.join(small(own.groupBy("cell").agg(F.sum("n").alias("grid"))), "cell").select("qid", "ent", "cell", "n", "grid")


# --- interpretation ----------------------------------------------------------------------------------------------

part("iwit", """SELECT 'q' || (l_suppkey % 5) AS qid, 'e' || (l_partkey % 40) AS ent, str_split(p_name, ' ') AS words FROM lineitem JOIN part ON l_partkey = p_partkey""")
part("qen", "SELECT qid, ent, count(*) AS n FROM iwit GROUP BY ALL", "iwit")
part("qewc", "SELECT qid, ent, word, count(*) AS n FROM (SELECT qid, ent, unnest(list_distinct(words)) AS word FROM iwit) GROUP BY ALL", "iwit")
part("catword", "SELECT DISTINCT cat, unnest(string_split_regex(lower(cat), '[^a-z0-9]+')) AS word FROM (SELECT DISTINCT p_type AS cat FROM part UNION SELECT DISTINCT p_type || ' ' || split_part(p_name, ' ', 1) FROM part)")
part("entcat", "SELECT DISTINCT 'e' || (p_partkey % 40) AS ent, p_type AS cat FROM part")
part("qword", """SELECT qid, unnest(words) AS word, unnest(range(len(words))) AS "at" FROM (VALUES ('q0', ['blue', 'bolt']), ('q1', ['red', 'old', 'ring']), ('q2', ['standard']), ('q3', ['economy', 'gear', 'hot', 'anvil']), ('q4', ['cold', 'promo'])) AS q(qid, words)""")
part("ncats", "SELECT count(DISTINCT cat) AS n FROM catword", "catword")
part("globalword", "SELECT word, (1.0 + count(*)) / (2.0 + (SELECT n FROM ncats)) AS p FROM catword GROUP BY word", "catword", "ncats")
part("log_empty", "SELECT c.cat, sum(ln(1 - (CASE WHEN w.word IS NULL THEN 0 ELSE 0.85 END + 0.15 * p))) AS log_empty FROM (SELECT DISTINCT cat FROM catword) c CROSS JOIN globalword g LEFT JOIN catword w ON w.cat = c.cat AND w.word = g.word GROUP BY c.cat", "catword", "globalword")
part("todds", """SELECT c.cat, q.word, CASE WHEN w.word IS NULL THEN 0 ELSE 0.85 END + 0.15 * coalesce(g.p, 1.0 / (2 + (SELECT n FROM ncats))) AS p FROM (SELECT DISTINCT cat FROM catword) c CROSS JOIN (SELECT DISTINCT word FROM qword) q
  LEFT JOIN globalword g ON g.word = q.word LEFT JOIN catword w ON w.cat = c.cat AND w.word = q.word""", "catword", "qword", "globalword", "ncats")
part("isupport", "SELECT qid, ent, n AS n_ent, n * 1.0 / sum(n) OVER (PARTITION BY qid) AS p_ent FROM qen", "qen")
part("iempty", "SELECT qid, ent, sum(ln(1 - (0.01 + w.n) / (0.02 + n_ent))) AS empty_snippet FROM qewc w JOIN isupport USING (qid, ent) GROUP BY ALL", "qewc", "isupport")
part("iprior", "SELECT ent, cat, (coalesce(n, 0) + 0.05) / (sum(coalesce(n, 0)) OVER (PARTITION BY ent) + 0.05 * count(*) OVER (PARTITION BY ent)) AS p_type FROM entcat LEFT JOIN (SELECT p_type AS cat, count(*) AS n FROM part GROUP BY 1) USING (cat)", "entcat")
part("icell", """SELECT s.qid, s.ent, p_ent, p.cat, p_type, log_empty, q."at", ln(o.p / (1 - o.p)) AS odds, ln(((0.01 + coalesce(w.n, 0)) / (0.02 + n_ent)) / (1 - (0.01 + coalesce(w.n, 0)) / (0.02 + n_ent))) AS snippet
  FROM isupport s JOIN qword q USING (qid) LEFT JOIN qewc w ON w.qid = s.qid AND w.ent = s.ent AND w.word = q.word JOIN iprior p ON p.ent = s.ent JOIN log_empty e ON e.cat = p.cat JOIN todds o ON o.cat = p.cat AND o.word = q.word""", "isupport", "qword", "qewc", "iprior", "log_empty", "todds")
part("ihint", """SELECT qid, n, b, b + k AS e FROM (SELECT qid, count(*) AS n FROM qword GROUP BY qid), unnest(range(0, 5)) AS t(b), unnest([1, 2]) AS u(k) WHERE b + k <= n AND (n = 1 OR b < n - 1)""", "qword")


def _witnesses(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.split("p_name", " ").alias("words"))
    return read(spark, d, "lineitem").join(p, "l_partkey").select(F.concat(F.lit("q"), (F.col("l_suppkey") % 5).cast("string")).alias("qid"), F.concat(F.lit("e"), (F.col("l_partkey") % 40).cast("string")).alias("ent"), "words")


def _type_words(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    cats = p.select(F.col("p_type").alias("cat")).union(p.select(F.concat("p_type", F.lit(" "), F.split("p_name", " ")[0]))).distinct()
    return interpret.type_words(cats.select("cat", F.col("cat").alias("lemma")))


def _asked(spark: SparkSession) -> DataFrame:
    rows = [("q0", ["blue", "bolt"]), ("q1", ["red", "old", "ring"]), ("q2", ["standard"]), ("q3", ["economy", "gear", "hot", "anvil"]), ("q4", ["cold", "promo"])]
    return spark.createDataFrame(rows, "qid string, words array<string>")


@query("D1_snippet_counts", "SELECT qid, ent, n FROM qen", "qen")
def qen(spark: SparkSession, d: str) -> DataFrame:
    return interpret.snippet_counts(_witnesses(spark, d))


@query("D2_snippet_word_counts", "SELECT qid, ent, word, n FROM qewc", "qewc")
def qewc(spark: SparkSession, d: str) -> DataFrame:
    return interpret.snippet_words(_witnesses(spark, d))


@query("D25_query_totals", "SELECT qid, sum(n)::BIGINT AS n FROM qen GROUP BY qid", "qen")
def query_totals(spark: SparkSession, d: str) -> DataFrame:
    return qen(spark, d).groupBy("qid").agg(F.sum("n").alias("n"))


@query("D24_type_histogram", "SELECT p_type AS cat, count(*) AS n FROM part GROUP BY 1")
def type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy(F.col("p_type").alias("cat")).agg(F.count("*").alias("n"))


@query("D23_type_language_model", "SELECT cat, round(log_empty, 6) AS log_empty FROM log_empty", "log_empty")
def type_model(spark: SparkSession, d: str) -> DataFrame:
    return interpret.type_model(_type_words(spark, d))[1].select("cat", F.round("log_empty", 6).alias("log_empty"))


@query("H17_word_given_type", "SELECT cat, word, round(ln(p / (1 - p)), 6) AS odds FROM todds", "todds")
def type_odds(spark: SparkSession, d: str) -> DataFrame:
    words = _type_words(spark, d)
    glob, _, n = interpret.type_model(words)
    asked = _asked(spark).select(F.explode("words").alias("word"))
    return interpret.type_odds(asked, words, glob, n).select("cat", "word", F.round("odds", 6).alias("odds"))


@query("F7_top_types", """SELECT qid, cat, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cat)::INTEGER AS rank FROM
  (SELECT qid, cat, round(sum(ln(p / (1 - p))) + any_value(log_empty), 6) AS score FROM qword JOIN todds USING (word) JOIN log_empty USING (cat) GROUP BY qid, cat)) WHERE rank <= 5""", "qword", "todds", "log_empty")
def top_types(spark: SparkSession, d: str) -> DataFrame:
    asked = _asked(spark).select("qid", F.explode("words").alias("word"))
    return interpret.search_types(asked, _type_words(spark, d), 5)


@query("E10_hint_windows", "SELECT qid, CAST(b AS INTEGER) AS b, CAST(e AS INTEGER) AS e FROM ihint", "ihint")
def hints(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark).select("qid", F.explode(text.hint_windows(F.col("words"))).alias("h")).select("qid", "h.b", "h.e")


@query("K17_query_interpretation", """SELECT qid, ent, round(ln(sum(s)), 5) AS log_score FROM (SELECT c.qid, c.ent, c.cat, h.b, h.e, exp(ln(any_value(p_ent)) + ln(any_value(p_type)) + (h.e - h.b) * ln(0.2) + (any_value(h.n) - (h.e - h.b)) * ln(0.8)
    + any_value(log_empty) + any_value(empty_snippet) + sum(CASE WHEN c."at" >= h.b AND c."at" < h.e THEN odds ELSE snippet END)) AS s
  FROM icell c JOIN ihint h ON h.qid = c.qid JOIN iempty m ON m.qid = c.qid AND m.ent = c.ent GROUP BY c.qid, c.ent, c.cat, h.b, h.e) GROUP BY qid, ent""", "icell", "ihint", "iempty")
def interpretation(spark: SparkSession, d: str) -> DataFrame:
    w = _witnesses(spark, d)
    p = read(spark, d, "part")
    ent_cat = p.select(F.concat(F.lit("e"), (F.col("p_partkey") % 40).cast("string")).alias("ent"), F.col("p_type").alias("cat")).distinct()
    found = interpret.interpret(_asked(spark), interpret.snippet_counts(w), interpret.snippet_words(w), ent_cat, _type_words(spark, d), type_histogram(spark, d))
    return found.select("qid", "ent", F.round(F.log("score"), 5).alias("log_score"))


# --- encodings and order -------------------------------------------------------------------------------------------


@query("H20_quantised_scores", "SELECT l_orderkey AS doc_id, l_linenumber AS pos, CAST(255 - floor(sqrt(l_quantity::DOUBLE / (ln(3.4028234663852886e38) / 65025)) + 1e-12) AS INTEGER) AS code FROM lineitem")
def quantised(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), codec.encode_log_prob(-F.col("l_quantity").cast("double")).alias("code"))


#: Documents (by number) that one block of a gap-encoded posting list is about.
BLOCK = 4096


@query("E6_gap_encoding", f"""SELECT token, block, string_agg(gap, ',' ORDER BY n) AS gaps FROM (SELECT token, n // {BLOCK} AS block, n, n - coalesce(lag(n) OVER (PARTITION BY token, n // {BLOCK} ORDER BY n), 0) AS gap
  FROM (SELECT DISTINCT token, doc_id FROM tokens) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)) USING (doc_id)) GROUP BY token, block""", "tokens")
def gap_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Posting lists in blocks, each of which begins with the number of its first document: no row, nor task, holds all
    documents of a frequent word."""
    numbers = dense_ids(read(spark, d, "documents"), "doc_id", "n")
    listed = base.tokens(spark, d).join(numbers, "doc_id").select("token", F.floor(F.col("n") / BLOCK).alias("block"), "n").distinct()
    blocks = listed.groupBy("token", "block").agg(F.sort_array(F.collect_list("n")).alias("docs"))
    return blocks.select("token", "block", F.array_join(codec.gaps(F.col("docs")).cast("array<string>"), ",").alias("gaps"))


@query("E7_frequency_ordered_dictionary", "SELECT doc_id, ent, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ent) - 1 AS code FROM (SELECT doc_id, ent, count(*) AS n FROM annots GROUP BY ALL)", "annots")
def dictionary(spark: SparkSession, d: str) -> DataFrame:
    n = base.annotated(spark, d)[2].groupBy("doc_id", "ent").agg(F.count("*").alias("n"))
    return n.select("doc_id", "ent", (F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "ent")) - 1).cast("long").alias("code"))


@query("H21_L7_signed_hash_map", """SELECT (h >> 1) % 1024 AS bucket, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS value FROM
  (SELECT ('0x' || substr(md5(event_type || '|' || user_id), 1, 8))::BIGINT AS h FROM events) GROUP BY 1""")
def signed(spark: SparkSession, d: str) -> DataFrame:
    h = codec.signed_bucket(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 1024)
    return read(spark, d, "events").select(h.alias("h")).groupBy("h.bucket").agg(F.sum("h.sign").alias("value"))


@query("H26_packed_ints", "SELECT l_orderkey * 4294967296 + l_linenumber AS packed FROM lineitem")
def packed(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(codec.pack_ints(F.col("l_orderkey"), F.col("l_linenumber")).alias("packed"))


@query("D28_distinct_on_sort", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_partkey", "l_suppkey").dropDuplicates()


@query("F1_sorted_run_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM orders")
def sorted_run(spark: SparkSession, d: str) -> DataFrame:
    """The position of every record in the sorted run."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return positions(orders, ["o_totalprice", "o_orderkey"], "pos").select("o_orderkey", "pos")


@query("F5_scrambled_order", "SELECT o_orderkey, (o_orderkey * 2654435761) % 1000003 AS place FROM orders")
def scrambled(spark: SparkSession, d: str) -> DataFrame:
    """Records in the order of a hash of their key, for learning one by one."""
    place = F.pmod(F.col("o_orderkey") * F.lit(2654435761), F.lit(1000003))
    return read(spark, d, "orders").select("o_orderkey", place.alias("place")).orderBy("place", "o_orderkey")


@query("F8_frequent_features", "SELECT token, doc_id, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, token) AS k FROM (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY ALL)) WHERE k <= 5", "tokens")
def frequent(spark: SparkSession, d: str) -> DataFrame:
    tf = base.tokens(spark, d).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return tf.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "token"))).filter("k <= 5").select("token", "doc_id", "tf")


@query("F11_first_positive_rank", "SELECT qid, min(rank) FILTER (label) AS rank FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY round(f1 + f2 + f3 + f4, 9) DESC, ent) AS rank FROM sfv) GROUP BY qid", "sfv")
def first_positive(spark: SparkSession, d: str) -> DataFrame:
    total = F.round(F.aggregate("fv", F.lit(0.0), lambda s, x: s + x), 9)
    best_first = Window.partitionBy("qid").orderBy(F.desc("total"), "ent")
    r = sfv(spark, d).withColumn("total", total).withColumn("rank", F.row_number().over(best_first))
    return r.groupBy("qid").agg(F.min(F.when(F.col("label"), F.col("rank"))).cast("long").alias("rank"))


@query("B16_hash_split", "SELECT doc_id, (doc_id * 2654435761) % 1000003 < 700002 AS train FROM documents")
def split(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", (F.pmod(F.col("doc_id") * F.lit(2654435761), F.lit(1000003)) < 700002).alias("train"))


@query("G1_G4_bag_and_set_union", "SELECT c, count(*) AS n FROM (SELECT c_nationkey AS c FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY c")
def unions(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "customer").select(F.col("c_nationkey").alias("c")).unionAll(read(spark, d, "supplier").select("s_nationkey"))
    return both.groupBy("c").agg(F.count("*").alias("n"))


@query("G2_G5_document_algebra", "SELECT doc_id FROM (SELECT doc_id FROM tokens WHERE token = 'the' INTERSECT SELECT doc_id FROM tokens WHERE token = 'of' EXCEPT SELECT doc_id FROM tokens WHERE token = 'when')", "tokens")
def algebra(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d)
    has = lambda w: t.filter(F.col("token") == w).select("doc_id")
    return has("the").distinct().join(has("of"), "doc_id", "left_semi").join(has("when"), "doc_id", "left_anti")


@query("H23_H24_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS l1, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS dot FROM embeddings")
def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("l1"), F.round(rank.dot(v, v), 4).alias("dot"))


@query("B1_B2_terms", "SELECT CASE WHEN length(w) <= 64 AND trim(w) <> '' THEN lower(trim(w)) END AS term, count(*) AS n FROM (SELECT unnest(str_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def terms(spark: SparkSession, d: str) -> DataFrame:
    words = read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(text.term(F.col("w")).alias("term")).agg(F.count("*").alias("n"))


@query("B3_free_text", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name ELSE p_name END AS name FROM part")
def free_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    canonical = F.when(n == 0, F.concat(F.lit("wikicategory_"), "p_name")).when(n == 1, F.concat(F.lit("wordnet_"), "p_name", F.lit("_1234"))).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return read(spark, d, "part").select("p_partkey", text.free_text(canonical).alias("name"))


@query("B4_link_targets", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS target, p_partkey % 3 = 0 AS begins FROM part")
def links(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    tag = F.when(n == 0, F.concat(F.lit("B-/wiki/"), "p_name")).when(n == 1, F.concat(F.lit("I-/wiki/"), "p_name")).otherwise(F.lit("0"))
    return read(spark, d, "part").select("p_partkey", text.link_target(tag).alias("target"), text.is_link_begin(tag).alias("begins"))
