"""Sources and sinks, skip allocation and per-leaf regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators import logistic, skips
from spanweave.operators.joins import running_sums
from spanweave.scratch import Scratch
from spanweave.sources import catalogs, corpus
from spanweave.streaming import incremental
from spanweave.suite import SUITE, base, linking, read

query, part = SUITE.add, SUITE.part

_STRIP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"


def _plain_sql(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '{_STRIP}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'))"


@query("A5_html_pages", f"""SELECT page_id, {_plain_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} || ' ||| ' || {_plain_sql("regexp_replace(html, '(?is)<title[^>]*>.*?</title>', ' ', 'g')")} AS text FROM pages""")
def html_pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", corpus.page_text(F.col("html")).alias("text"))


@query("A6_A7_first_ids", "SELECT source AS file, n, CAST(coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def first_ids(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_ids(read(spark, d, "documents").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("n")))


def feed(spark: SparkSession, d: str) -> DataFrame:
    """The orders as records of an annotated feed."""
    cells = lambda word, link: F.concat_ws("\t", word, *(F.lit("x") for _ in range(9)), link, F.lit("0"))
    name = F.replace("ent", F.lit(" "), F.lit("_"))
    line = F.concat_ws("\n", cells(F.col("w")[0], F.concat(F.lit("B-/wiki/"), F.url_encode(name))), cells(F.col("w")[1], F.concat(F.lit("I-/wiki/"), F.url_encode(name))))
    whole = linking._lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ln", line.alias("line")))).alias("l"))
    return whole.select(F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.lit("\n%%#PAGE order "), F.col("doc_id").cast("string"), F.lit("\n"), F.array_join("l.line", "\n"), F.lit("\n")).alias("value"))


@query("A8_annotated_feed", """SELECT CAST(doc_id AS VARCHAR) AS doc, 'order ' || doc_id AS title, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS text FROM otok GROUP BY doc_id""", "otok")
def annotated_feed(spark: SparkSession, d: str) -> DataFrame:
    t = corpus.feed_documents(feed(spark, d)).groupBy("doc", "title").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("t"))
    return t.select("doc", "title", F.size("t").cast("long").alias("n"), F.array_join("t.token", " ").alias("text"))


@query("A10_feed_annotations", """SELECT CAST(doc_id AS VARCHAR) AS doc, replace(ent, ' ', '_') AS name, "right" - "left" + 1 AS n_words, count(*) AS n FROM ogold GROUP BY ALL""", "ogold")
def feed_annotations(spark: SparkSession, d: str) -> DataFrame:
    a = corpus.feed_annotations(corpus.feed_documents(feed(spark, d)))
    return a.groupBy("doc", "name", (F.col("right") - F.col("left") + 1).alias("n_words")).agg(F.count("*").alias("n"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of JSON, with an annotation of their second word."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    first = F.regexp_extract("text", r"^([A-Za-z0-9]+)[^A-Za-z0-9]+[A-Za-z0-9]+", 0)
    second = F.regexp_extract(first, r"[A-Za-z0-9]+$", 0)
    note = F.struct(F.concat(F.lit("http://x/wiki/"), second).alias("uri"), (F.length(first) - F.length(second)).alias("offset"), second.alias("surface_form"))
    notes = F.when(first != "", F.array(note))
    return docs.select(F.to_json(F.struct("text", F.col("doc_id").cast("string").alias("url"), F.array(F.col("doc_id").cast("string")).alias("id"), notes.alias("annotations"))).alias("value"))


@query("A12_json_words", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY token")
def json_words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.article_words(corpus.json_articles(articles(spark, d))).groupBy("token").agg(F.count("*").alias("n"))


@query("A13_json_annotations", r"""SELECT CAST(doc_id AS VARCHAR) AS url, regexp_extract(f, '[A-Za-z0-9]+$', 0) AS name, CAST(1 AS INTEGER) AS "left", CAST(1 AS INTEGER) AS "right"
  FROM (SELECT doc_id, regexp_extract(text, '^([A-Za-z0-9]+)[^A-Za-z0-9]+[A-Za-z0-9]+', 0) AS f FROM documents) WHERE f <> ''""")
def json_annotations(spark: SparkSession, d: str) -> DataFrame:
    return corpus.article_annotations(corpus.json_articles(articles(spark, d)))


@query("A17_entity_pages", "SELECT CAST(doc_id AS VARCHAR) AS name, CAST(doc_id AS VARCHAR) AS page FROM documents")
def entity_pages(spark: SparkSession, d: str) -> DataFrame:
    return corpus.json_articles(articles(spark, d)).select(F.col("url").alias("name"), F.col("id")[0].alias("page"))


@query("A15_redirect_extraction", "SELECT c_name AS source, 'T ' || c_name AS target FROM customer WHERE c_custkey % 4 = 0")
def redirect_extraction(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    title = c.select((F.col("c_custkey") % 3).alias("file"), (2 * F.col("c_custkey")).alias("n"), F.concat(F.lit("  <title>"), "c_name", F.lit("</title>")).alias("value"))
    move = c.filter("c_custkey % 4 = 0").select((F.col("c_custkey") % 3).alias("file"), (2 * F.col("c_custkey") + 1).alias("n"), F.concat(F.lit('<redirect title="T '), "c_name", F.lit('" />')).alias("value"))
    return corpus.redirects(title.union(move))


@query("A18_trec_pages", f"""SELECT 'p' || page_id AS doc_no, url, {_plain_sql("html")} AS text FROM pages WHERE page_id % 5 <> 0""")
def trec(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("text/html; charset=utf-8")
    record = F.concat(F.lit("\n<DOCNO> p"), F.col("page_id").cast("string"), F.lit(" </DOCNO>\n<DOCHDR>\n"), "url", F.lit("\nContent-Type: "), kind, F.lit("\n</DOCHDR>\n"), "html", F.lit("\n</DOC>\n"))
    pages = corpus.trec_pages(read(spark, d, "pages").select(record.alias("value")))
    return pages.select("doc_no", "url", corpus.plain(F.col("html")).alias("text"))


@query("A19_tsv_catalog", "SELECT DISTINCT 'p' || p_partkey AS ent, p_brand AS cat FROM part WHERE p_partkey % 2 = 0")
def tsv_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    line = lambda *c: F.concat_ws("\t", *c).alias("value")
    ents = p.filter("p_partkey % 2 = 0").select(line(key, F.lit("x")))
    found = catalogs.tsv_catalog(ents, p.select(line(F.lit("1"), "p_brand", F.lit("root"))), p.select(line(F.lit("1"), key, F.col("p_brand"))), p.select(line(F.lit("1"), F.col("p_name"), key)))
    return found["ent_cat"]


@query("A20_rdf_catalog", "SELECT DISTINCT p_name AS ent, p_brand AS cat FROM part")
def rdf_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    name = F.url_encode("p_name")
    inst = p.select(F.concat(F.lit("<http://x/resource/"), name, F.lit("> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/ontology/"), F.url_encode("p_brand"), F.lit("> .")).alias("value"))
    sub = p.select(F.concat(F.lit("<http://x/ontology/"), F.url_encode("p_brand"), F.lit("> <http://www.w3.org/2000/01/rdf-schema#subClassOf> <http://x/owl#Thing> .")).alias("value"))
    return catalogs.rdf_catalog(sub, inst)["ent_cat"]


SHEET = "QueryID,Include?,NaturalQuery,YagoAtype,Selector\nq1,y,a,t,+the,of\nq2,n,b,s,x\nq3,1,c,vowel,{ent},\"of the\"\n"


@query("A21_Q4_labelled_queries", "SELECT * FROM (VALUES ('q1', 'must', 'binding', 't'), ('q1', 'must', 'token', 'the'), ('q1', 'may', 'token', 'of'), ('q3', 'must', 'binding', 'vowel'), ('q3', 'may', 'entity', 'ent'), ('q3', 'may', 'phrase', 'of the')) AS t(qid, exist, kind, keys)")
def labelled_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = [(q, m.exist, m.kind, " ".join(a.key for a in m.atoms)) for q, c in catalogs.labelled_queries(SHEET) for m in c.matchers]
    return spark.createDataFrame(rows, "qid string, exist string, kind string, keys string")


@query("A22_Q5_telegraphic_queries", "SELECT * FROM (VALUES ('t1', 'must', 'blue'), ('t1', 'may', 'big band'), ('t1', 'may', 'year'), ('t2', 'not', 'x')) AS t(qid, exist, keys)")
def telegraphic(spark: SparkSession, d: str) -> DataFrame:
    text = 'QueryID,TelegraphQuery\nt1,"+blue ""big band"" year"\nt2,-x\n'
    rows = [(q, m.exist, " ".join(a.key for a in m.atoms)) for q, c in catalogs.telegraphic_queries(text) for m in c.matchers]
    return spark.createDataFrame(rows, "qid string, exist string, keys string")


@query("A23_inline_documents", "SELECT * FROM (VALUES (1001::BIGINT, 0::INTEGER, 'Bill'), (1001, 1, 'Gates'), (1002, 0, 'brin')) AS t(doc_id, pos, token)")
def inline(spark: SparkSession, d: str) -> DataFrame:
    return corpus.inline_documents(spark, {1001: ["Bill", "Gates"], 1002: ["brin"]})


# --- skips ----------------------------------------------------------------------------------------------------------

part("skipleaf", "SELECT p_partkey % 50 AS leaf, l_suppkey % 40 AS feat, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
part("skipleaves", "SELECT leaf, sum(n)::BIGINT * 8 AS bits, count(*) AS n_feats, sum(n) * 1.0 / sum(sum(n)) OVER () AS hit_prob FROM skipleaf GROUP BY leaf", "skipleaf")


def _features(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("leaf"), (F.col("l_suppkey") % 40).alias("feat")).agg(F.count("*").alias("n"))


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d).groupBy("leaf").agg((8 * F.sum("n")).alias("bits"), F.count("*").alias("n_feats"), F.sum("n").alias("hits"))
    return f.crossJoin(F.broadcast(f.agg(F.sum("hits").alias("all")))).select("leaf", "bits", "n_feats", (F.col("hits") / F.col("all")).alias("hit_prob"))


@query("K11_outer_budget", "SELECT leaf, CAST(least(n_feats, floor(500.0 * hit_prob * bits / sum(hit_prob * bits) OVER () + (leaf * 2654435761) % 1000003 / 1000003.0)) AS BIGINT) AS budget FROM skipleaves", "skipleaves")
def outer_budget(spark: SparkSession, d: str) -> DataFrame:
    return skips.outer(_leaves(spark, d), 500, "hit_bit").select("leaf", "budget")


def _inner(policy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        features = skips.smoothed(_features(spark, d), F.lit(1.0)).withColumn("bits", 8 * F.col("n"))
        return skips.inner(features, skips.outer(_leaves(spark, d), 300, "bit"), policy).select("leaf", "budget", "n_skips", F.round("cost", 6).alias("cost"))

    return run


part("skipbudget", "SELECT leaf, CAST(least(n_feats, floor(300.0 * bits / sum(bits) OVER () + (leaf * 2654435761) % 1000003 / 1000003.0)) AS BIGINT) AS budget FROM skipleaves", "skipleaves")
part("skipplace", """SELECT leaf, feat, budget, 8 * n AS bits, (n + 1.0) / (sum(n) OVER w + count(*) OVER w) AS prob, CAST(sum(8 * n) OVER (PARTITION BY leaf ORDER BY feat) - 8 * n AS BIGINT) AS start,
    CAST(sum(8 * n) OVER w AS BIGINT) AS total, row_number() OVER (PARTITION BY leaf ORDER BY n DESC, feat) AS by_n, row_number() OVER (PARTITION BY leaf ORDER BY feat) - 1 AS place
  FROM skipleaf JOIN skipbudget USING (leaf) WINDOW w AS (PARTITION BY leaf)""", "skipleaf", "skipbudget")
_COST = """SELECT leaf, budget, count(*) FILTER (skip) AS n_skips, round(sum(prob * (1 + 0.01 * bits + CASE WHEN start > origin THEN 1 + 0.01 * (start - origin) ELSE 0 END)), 6)::DOUBLE AS cost
  FROM (SELECT *, coalesce(max(CASE WHEN skip THEN start END) OVER (PARTITION BY leaf ORDER BY feat), 0) AS origin FROM ({})) GROUP BY leaf, budget"""
_SKIPS = {
    "freq": "SELECT *, by_n <= budget AS skip FROM skipplace",
    "equi": "SELECT p.*, m.feat IS NOT NULL AS skip FROM skipplace p LEFT JOIN (SELECT DISTINCT leaf, min(feat) AS feat FROM skipplace, unnest(range(0, budget)) AS t(k) WHERE start * budget >= k * total GROUP BY leaf, k) m USING (leaf, feat)",
    "equi_and_freq": """SELECT * EXCLUDE (other), by_n <= budget // 2 OR other <= budget - budget // 2 AS skip FROM (SELECT *, CASE WHEN by_n > budget // 2 THEN
        row_number() OVER (PARTITION BY leaf, by_n > budget // 2 ORDER BY (place * 2654435761) % 1000003) END AS other FROM skipplace)""",
}
for _policy in skips.POLICIES:
    query(f"K12_K13_inner_{_policy}", *((_COST.format(_SKIPS[_policy]), "skipplace") if _policy in _SKIPS else ()))(_inner(_policy))


def _runs(spark: SparkSession, d: str) -> list[DataFrame]:
    """Skip records in two runs, of leaves that two machines had; leaves whose number divides by seven have none."""
    scratch = Scratch(spark, "skips")
    features = scratch.keep(skips.smoothed(_features(spark, d), F.lit(1.0)).withColumn("bits", 8 * F.col("n")), "features")
    found = skips.records(features, skips.inner(features, skips.outer(_leaves(spark, d), 300, "bit"), "freq")).filter("leaf % 7 <> 0")
    return [scratch.keep(found.filter(F.col("leaf") % 2 == i).sortWithinPartitions("leaf", "nth"), f"run{i}") for i in (0, 1)]


@query("K15_merged_skip_records", "SELECT leaf, feat, start AS bit, CAST(row_number() OVER (PARTITION BY leaf ORDER BY feat) - 1 AS INTEGER) AS nth FROM skipplace WHERE by_n <= budget AND leaf % 7 <> 0", "skipplace")
def merged_skips(spark: SparkSession, d: str) -> DataFrame:
    return skips.merged(_runs(spark, d)).filter("feat IS NOT NULL").select("leaf", "feat", "bit", "nth")


@query("K15_leaf_ends", """SELECT l AS leaf, CAST(sum(coalesce(n, 0)) OVER (ORDER BY l) AS BIGINT) AS "end" FROM unnest(range(0, 50)) AS t(l) LEFT JOIN (SELECT leaf, count(*) AS n FROM skipplace WHERE by_n <= budget AND leaf % 7 <> 0 GROUP BY leaf) ON leaf = l""", "skipplace")
def leaf_ends(spark: SparkSession, d: str) -> DataFrame:
    return skips.slice_ends(skips.merged(_runs(spark, d)), 50)


@query("K15_audit", f"SELECT count(*) AS n_records, sum(n_skips)::BIGINT AS n_skips, round(sum(cost), 4)::DOUBLE AS cost, true AS agrees FROM ({_COST.format(_SKIPS['freq']).replace(', 6)', ', 12)')}) WHERE leaf % 7 <> 0", "skipplace")
def skip_audit(spark: SparkSession, d: str) -> DataFrame:
    return skips.audit(skips.merged(_runs(spark, d)))


@query("K12_frequency_skips", "SELECT leaf, feat FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY n DESC, feat) AS k FROM skipleaf) WHERE k <= 5", "skipleaf")
def frequency_skips(spark: SparkSession, d: str) -> DataFrame:
    budgets = _leaves(spark, d).select("leaf", F.lit(5).cast("long").alias("budget"))
    features = skips.smoothed(_features(spark, d), F.lit(0.0)).withColumn("bits", F.lit(8).cast("long"))
    return skips.inner(features, budgets, "freq").select("leaf", F.explode("skips").alias("feat"))


@query("K14_best_smoother", f"""SELECT leaf, smoother, loss FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY loss, smoother) AS k FROM (SELECT leaf, smoother, round(-sum(n2 * ln(p)), 6) AS loss FROM
  (SELECT leaf, feat, smoother, (n + smoother) / (sum(n) OVER w + smoother * count(*) OVER w) AS p FROM skipleaf, (VALUES {', '.join(f"({x!r}::DOUBLE)" for x in skips.SMOOTHERS)}) AS g(smoother) WINDOW w AS (PARTITION BY leaf, smoother))
  JOIN (SELECT leaf, feat, n % 7 + 1 AS n2 FROM skipleaf) USING (leaf, feat) GROUP BY ALL)) WHERE k = 1""", "skipleaf")
def best_smoother(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return skips.best_smoother(f, f.select("leaf", "feat", (F.col("n") % 7 + 1).alias("n")), list(skips.SMOOTHERS))


@query("K14_snapped_features", """SELECT a.leaf, k.feat, sum(a.n)::BIGINT AS n FROM skipleaf a ASOF JOIN (SELECT leaf, feat FROM skipleaf WHERE feat % 3 = 0) k ON a.leaf = k.leaf AND a.feat <= k.feat GROUP BY ALL""", "skipleaf")
def snapped(spark: SparkSession, d: str) -> DataFrame:
    f = _features(spark, d)
    return skips.snapped(f, f.filter("feat % 3 = 0"))


@query("K9_leaf_regression")
def leaf_regression(spark: SparkSession, d: str) -> DataFrame:
    ctx, feats, _ = linking._contexts(spark, d)
    return logistic.train(ctx.filter("doc_id % 2 = 0").select("ctx", "leaf", "ent"), feats)


@query("E11_E12_leaf_offsets", "SELECT leaf, sum(count(*)) OVER (ORDER BY leaf)::BIGINT AS end FROM skipleaf GROUP BY leaf".replace("AS end", 'AS "end"'), "skipleaf")
def offsets(spark: SparkSession, d: str) -> DataFrame:
    """End of each leaf's slice in a file sorted by leaf."""
    n = _features(spark, d).groupBy("leaf").agg(F.count("*").alias("n"))
    return running_sums(n, ["leaf"], "n", "begin").select("leaf", (F.col("begin") + F.col("n")).alias("end"))


@query("A16_mention_offsets", "SELECT ent, n, CAST(sum(n) OVER (ORDER BY ent) - n AS BIGINT) AS begin FROM (SELECT l_partkey % 100 AS ent, count(*) AS n FROM lineitem GROUP BY 1)")
def mention_offsets(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 100).alias("file")).agg(F.count("*").alias("n"))
    return corpus.first_ids(n).select(F.col("file").alias("ent"), "n", "begin")


@query("I_streaming_counts", "SELECT token, count(*) AS cf FROM tokens GROUP BY token", "tokens")
def streaming_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts over a stream of the documents' files, run until there is no more input. Each batch adds its counts to a
    table; what is read is their sum."""
    scratch, docs = Scratch(spark, "counts"), read(spark, d, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parquet*")
    incremental.append_counts(stream, f"{scratch.base}/table", f"{scratch.base}/state", once=True).awaitTermination()
    return incremental.counts(spark, f"{scratch.base}/table")


def tokens_of(spark: SparkSession, d: str) -> DataFrame:
    return base.tokens(spark, d)
