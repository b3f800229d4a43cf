"""Postings, catalog and queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions import intervals, text
from spanweave.operators import catalog
from spanweave.operators.joins import band_join, dense_ids, small
from spanweave.plans import search
from spanweave.plans.query import BINDING, MUST, parse
from spanweave.scratch import Scratch
from spanweave.suite import SUITE, base, read

query, part = SUITE.add, SUITE.part

#: The queries that are run, and what SQL says of each: (qid, width, type, must, may, phrase).
QUERIES = [
    ("q1", parse("uw(5 +[t] +the of)")),
    ("q2", parse("uw(8 +[vowel] the and)")),
    ("q3", parse('uw(10 +[root] +"of the" +and)')),
]

part("stats", "SELECT 'token' AS leaf, token AS key, df FROM term_stats", "term_stats")
part("matchers", """SELECT * FROM (VALUES
  ('q1', 5, 0, 'must', 'binding', 0, 1, 'binding', 't', 1), ('q1', 5, 1, 'must', 'token', 0, 1, 'token', 'the', 1), ('q1', 5, 2, 'may', 'token', 0, 1, 'token', 'of', 1),
  ('q2', 8, 0, 'must', 'binding', 0, 1, 'binding', 'vowel', 0), ('q2', 8, 1, 'may', 'token', 0, 1, 'token', 'the', 0), ('q2', 8, 2, 'may', 'token', 0, 1, 'token', 'and', 0),
  ('q3', 10, 0, 'must', 'binding', 0, 1, 'binding', 'root', 2), ('q3', 10, 1, 'must', 'phrase', 0, 2, 'token', 'of', 2), ('q3', 10, 1, 'must', 'phrase', 1, 2, 'token', 'the', 2), ('q3', 10, 2, 'must', 'token', 0, 1, 'token', 'and', 2)
) AS m(qid, width, matcher, exist, kind, atom, n_atoms, leaf, key, n_must)""")
part("leaves", """SELECT m.qid, doc_id, matcher, exist, kind, atom, n_atoms, "left", "right", ent,
    CASE WHEN leaf = 'binding' THEN 0 ELSE (SELECT n FROM n_docs) * 1.0 / df END AS energy
  FROM matchers m JOIN (SELECT doc_id, pos AS "left", pos AS "right", NULL AS ent, 'token' AS leaf, token AS key FROM tokens
    UNION ALL SELECT doc_id, "left", "right", ent, 'binding', cat FROM types) p USING (leaf, key) LEFT JOIN stats USING (leaf, key)""", "matchers", "tokens", "types", "stats", "n_docs")
part("qualified", """SELECT qid, doc_id FROM (SELECT qid, doc_id, count(DISTINCT (matcher, atom)) AS has FROM leaves WHERE exist = 'must' GROUP BY ALL)
  JOIN (SELECT qid, count(*) AS needed FROM matchers WHERE exist = 'must' GROUP BY qid) USING (qid) WHERE has = needed""", "leaves")
part("witnesses", """SELECT l.qid, l.doc_id, l.matcher, l.exist, l.kind, l."left", l."right", l.ent, l.energy FROM leaves l JOIN qualified USING (qid, doc_id) WHERE n_atoms = 1
  UNION ALL SELECT a.qid, a.doc_id, a.matcher, a.exist, a.kind, a."left", b."right", a.ent, a.energy + b.energy FROM leaves a JOIN leaves b
    ON a.qid = b.qid AND a.doc_id = b.doc_id AND a.matcher = b.matcher AND a.atom = 0 AND b.atom = 1 AND b."left" = a."right" + 1
    JOIN qualified q ON q.qid = a.qid AND q.doc_id = a.doc_id WHERE a.n_atoms = 2""", "leaves", "qualified")
part("pairs", """SELECT b.qid, b.doc_id, b."left" AS b_left, b."right" AS b_right, b.ent AS b_ent, q.n_must, a.matcher, a.exist, a."left", a."right", a.energy,
    (a."left" < b."left" OR (a."left" = b."left" AND a.matcher < b.matcher)) AS before
  FROM witnesses b JOIN (SELECT DISTINCT qid, width, n_must FROM matchers) q USING (qid) JOIN witnesses a ON a.qid = b.qid AND a.doc_id = b.doc_id AND a.matcher <> b.matcher
  WHERE b.kind = 'binding' AND CASE WHEN a."left" < b."left" OR (a."left" = b."left" AND a.matcher < b.matcher) THEN a."left" >= b."right" - q.width ELSE a."right" <= b."left" + q.width END
    AND a."left" BETWEEN b."right" - q.width AND b."left" + q.width""", "witnesses")
part("contexts", """SELECT qid, doc_id, b_left, b_right, b_ent, least(b_left, min("left") FILTER (before)) AS "left", greatest(b_right, max("right") FILTER (NOT before)) AS "right",
    count(*) AS n_witnesses, sum(energy) AS energy_sum,
    sum(energy * CASE WHEN "left" <= b_right AND b_left <= "right" THEN 1.0 ELSE 1.0 / (greatest("left", b_left) - least("right", b_right)) END) AS energy_near
  FROM pairs GROUP BY qid, doc_id, b_left, b_right, b_ent, n_must HAVING count(DISTINCT matcher) FILTER (exist = 'must') = n_must""", "pairs")
part("energies", "SELECT qid, sum((SELECT n FROM n_docs) * 1.0 / df) AS energy FROM matchers JOIN stats USING (leaf, key) WHERE leaf <> 'binding' GROUP BY qid", "matchers", "stats", "n_docs")


def _leaves(spark: SparkSession, d: str, must_only: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    t, stats, a, types = base.annotated(spark, d)
    plan = search.matchers(spark, QUERIES)
    if must_only:
        plan = plan.filter(F.col("exist") == MUST)
    keyed = stats.select(F.lit("token").alias("leaf"), F.col("token").alias("key"), "df")
    n = base.n_docs(spark, d)
    # read several times below, and small beside the postings
    return Scratch(spark, "search").keep(search.leaf_witnesses(plan, t, a, types, keyed, n), "leaves"), plan, keyed, n


def _witnesses(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    leaves, plan, stats, n = _leaves(spark, d)
    return search.phrases(leaves.join(search.qualified(leaves, plan), ["qid", "doc_id"], "left_semi"), 2), plan, stats, n


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    w, plan, stats, n = _witnesses(spark, d)
    return search.contexts(search.window_pairs(w, plan, 10), search.query_energies(plan, stats, n))


ENTITY_SCORES = """SELECT c.qid, c.b_ent AS ent, count(*) AS n_contexts, round(sum(energy_sum / energy), 6) AS idf_sum, round(sum(energy_near / energy), 6) AS idf_proximity
  FROM contexts c JOIN energies USING (qid) GROUP BY ALL"""


def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d).groupBy("qid", F.col("b_ent").alias("ent")).agg(F.count("*").alias("n_contexts"), F.round(F.sum("idf_sum"), 6).alias("idf_sum"), F.round(F.sum("idf_proximity"), 6).alias("idf_proximity"))


@query("flagship_entity_search", f"SELECT * FROM ({ENTITY_SCORES}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY idf_proximity DESC, ent) <= 20", "contexts", "energies")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    best = Window.partitionBy("qid").orderBy(F.desc("idf_proximity"), "ent")
    return entity_scores(spark, d).withColumn("rank", F.row_number().over(best)).filter("rank <= 20").drop("rank")


query("H5_H6_entity_features", ENTITY_SCORES, "contexts", "energies")(entity_scores)


@query("A1_corpus_scan", "SELECT count(*) AS n_docs, max(doc_id) AS max_doc, sum(length(text))::BIGINT AS n_chars FROM documents")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("A1_get_document", "SELECT doc_id, text FROM documents WHERE doc_id = 42")
def get_document(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").filter("doc_id = 42").select("doc_id", "text")


@query("A24_token_postings", "SELECT token, doc_id, string_agg(pos, ',' ORDER BY pos) AS positions, count(*) AS tf FROM tokens GROUP BY token, doc_id", "tokens")
def token_postings(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d).groupBy("token", "doc_id").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    return t.select("token", "doc_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"), F.size("p").cast("long").alias("tf"))


@query("A25_type_index", 'SELECT cat, ent, doc_id, "left", "right" FROM types', "types")
def type_index(spark: SparkSession, d: str) -> DataFrame:
    return base.annotated(spark, d)[3].select("cat", "ent", "doc_id", "left", "right")


@query("A27_posting_lookup", """SELECT ent, doc_id, "left", "right" FROM types WHERE cat = 't'""", "types")
def posting_lookup(spark: SparkSession, d: str) -> DataFrame:
    return base.annotated(spark, d)[3].filter("cat = 't'").select("ent", "doc_id", "left", "right")


@query("B5_type_subset", """SELECT doc_id, "left", "right", ent, cat FROM types WHERE cat IN ('root', 's')""", "types")
def type_subset(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d)
    e = base.ents(base.term_stats(t))
    wanted = spark.createDataFrame([("root",), ("s",)], "cat string")
    return catalog.type_postings(base.annots(t, e), base.ent_cat(e), wanted).select("doc_id", "left", "right", "ent", "cat")


@query("B6_known_entities", "SELECT doc_id, \"left\", ent FROM gold WHERE ent IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)", "gold")
def known_entities(spark: SparkSession, d: str) -> DataFrame:
    ents = read(spark, d, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ent"))
    return catalog.known_entities(base.gold(spark, d), ents).select("doc_id", "left", "ent")


@query("C1_must_alignment", "SELECT qid, doc_id FROM qualified", "qualified")
def must_alignment(spark: SparkSession, d: str) -> DataFrame:
    leaves, plan, _, _ = _leaves(spark, d, must_only=True)
    return search.qualified(leaves, plan)


@query("C20_brute_force_intersect", "SELECT qid, doc_id FROM qualified", "qualified")
def brute_force(spark: SparkSession, d: str) -> DataFrame:
    leaves, plan, _, _ = _leaves(spark, d, must_only=True)
    return search.qualified_by_join(leaves, plan)


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """(qid, doc_id) of documents that qualify, found by reading each text: no postings of words are made. Types are
    met by the words of a text that are entities of the type."""
    words = read(spark, d, "documents").select("doc_id", F.array_distinct(text.words(F.col("text"))).alias("words"))
    e = Scratch(spark, "scanned").keep(base.ents(base.term_stats(base.tokens(spark, d))), "ents")
    typed = base.ent_cat(e)
    out = None
    for qid, query_ in QUERIES:
        must = [m for m in query_.matchers if m.exist == MUST]
        keys = [a.key for m in must if m.kind != BINDING for a in m.atoms]
        held = words
        for k in keys:
            held = held.filter(F.array_contains("words", k))
        for m in must:
            if m.kind == BINDING:
                of = typed.filter(F.col("cat") == m.atoms[0].key).select(F.col("ent").alias("word"))
                met = held.select("doc_id", F.explode("words").alias("word")).join(small(of), "word", "left_semi").select("doc_id").distinct()
                held = held.join(met, "doc_id", "left_semi")
        rows = held.select(F.lit(qid).alias("qid"), "doc_id").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


@query("G3_scan_probe_difference", "SELECT qid, count(*) AS n_scan, count(*) AS n_probe, 0::BIGINT AS n_scan_only, 0::BIGINT AS n_probe_only FROM qualified GROUP BY qid", "qualified")
def difference(spark: SparkSession, d: str) -> DataFrame:
    """How many documents a scan of texts and a probe of postings find for each query, and how many only one of them."""
    leaves, plan, _, _ = _leaves(spark, d)
    marked = lambda df, c: df.select("qid", "doc_id", F.lit(1).alias(c))
    both = marked(_scanned(spark, d), "scan").join(marked(search.qualified_by_join(leaves, plan), "probe"), ["qid", "doc_id"], "full_outer")
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    scan, probe = F.col("scan").isNotNull(), F.col("probe").isNotNull()
    return both.groupBy("qid").agg(n(scan).alias("n_scan"), n(probe).alias("n_probe"), n(scan & ~probe).alias("n_scan_only"), n(probe & ~scan).alias("n_probe_only"))


@query("C2_may_witnesses", """SELECT q.qid, q.doc_id, count(matcher) AS n_may FROM qualified q LEFT JOIN (SELECT * FROM leaves WHERE exist = 'may') l USING (qid, doc_id) GROUP BY ALL""", "leaves", "qualified")
def may_witnesses(spark: SparkSession, d: str) -> DataFrame:
    leaves, plan, _, _ = _leaves(spark, d)
    return search.qualified(leaves, plan).join(leaves.filter("exist = 'may'"), ["qid", "doc_id"], "left").groupBy("qid", "doc_id").agg(F.count("matcher").alias("n_may"))


@query("C3_phrase_adjacency", """SELECT doc_id, "left", "right" FROM witnesses WHERE kind = 'phrase'""", "witnesses")
def phrase_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return _witnesses(spark, d)[0].filter("kind = 'phrase'").select("doc_id", "left", "right")


@query("C4_context_window", 'SELECT qid, doc_id, b_left, b_right, b_ent, "left", "right", n_witnesses FROM contexts', "contexts")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    return _contexts(spark, d).select("qid", "doc_id", "b_left", "b_right", "b_ent", "left", "right", "n_witnesses")


@query("C5_scan_leaves", """SELECT qid, matcher, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM leaves WHERE kind <> 'binding' GROUP BY ALL""", "leaves")
def scan_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _leaves(spark, d)[0].filter("kind <> 'binding'").groupBy("qid", "matcher").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("C6_binding_leaves", """SELECT qid, doc_id, "left", ent FROM leaves WHERE kind = 'binding'""", "leaves")
def binding_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _leaves(spark, d)[0].filter("kind = 'binding'").select("qid", "doc_id", "left", "ent")


@query("C7_annotation_types", "SELECT cat, count(*) AS n, count(DISTINCT ent) AS n_ents FROM types GROUP BY cat", "types")
def annotation_types(spark: SparkSession, d: str) -> DataFrame:
    return base.annotated(spark, d)[3].groupBy("cat").agg(F.count("*").alias("n"), F.count_distinct("ent").alias("n_ents"))


part("wand_terms", """SELECT token, ln(1 + (SELECT n FROM n_docs) * 1.0 / cf) AS w FROM term_stats WHERE token IN ('the', 'and', 'of', 'with', 'es', 'to')""", "term_stats", "n_docs")
part("wand_docs", """SELECT doc_id FROM (SELECT doc_id, sum(w) AS w FROM (SELECT DISTINCT doc_id, token FROM tokens) JOIN wand_terms USING (token) GROUP BY doc_id)
  WHERE w >= 0.6 * (SELECT sum(w) FROM wand_terms)""", "tokens", "wand_terms")


def _wand(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens, the weights of the query's words, and documents that pass the threshold."""
    t = base.tokens(spark, d)
    words = ["the", "and", "of", "with", "es", "to"]
    n = base.n_docs(spark, d)
    weights = base.term_stats(t.filter(F.col("token").isin(words))).select("token", F.log1p(F.lit(float(n)) / F.col("cf")).alias("w"))
    total = weights.agg(F.sum("w").alias("total"))
    hit = t.filter(F.col("token").isin(words)).select("doc_id", "token").distinct().join(F.broadcast(weights), "token")
    return t, weights, hit.groupBy("doc_id").agg(F.sum("w").alias("w")).crossJoin(F.broadcast(total)).filter("w >= 0.6 * total").select("doc_id")


@query("B11_wand_threshold", "SELECT doc_id FROM wand_docs", "wand_docs")
def wand_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _wand(spark, d)[2]


part("or_spans", """SELECT doc_id, pos AS "left", pos AS "right" FROM tokens JOIN wand_docs USING (doc_id) WHERE token IN ('with', 'and')
  UNION SELECT doc_id, pos, pos + 1 FROM (SELECT doc_id, pos, token, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tokens JOIN wand_docs USING (doc_id)) WHERE (token = 'of' AND next = 'the') OR (token = 'and' AND next = 'the')""", "tokens", "wand_docs")
part("minimal_spans", """SELECT doc_id, "left", "right" FROM (SELECT *, min("right") OVER (PARTITION BY doc_id ORDER BY "left" DESC, "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inner_right FROM or_spans)
  WHERE (inner_right IS NULL OR inner_right > "right") AND "right" + 1 - "left" <= 20""", "or_spans")


@query("C8_wand_support", """SELECT s.doc_id, s."left" AS span_left, s."right" AS span_right, a."left" AS mention, a.ent FROM minimal_spans s JOIN annots a ON a.doc_id = s.doc_id
  WHERE a."left" >= greatest(0, s."right" - 20) AND a."right" <= s."left" + 20""", "minimal_spans", "annots")
def wand_support(spark: SparkSession, d: str) -> DataFrame:
    """Mentions near a minimal span of the query, which is: with, and, "of the" or "and the" (never minimal: it holds a
    span of its own)."""
    t, _, docs = _wand(spark, d)
    kept = t.filter(F.col("token").isin("with", "and", "of", "the")).join(docs, "doc_id", "left_semi")
    of = lambda w: kept.filter(F.col("token") == w)
    single = kept.filter(F.col("token").isin("with", "and")).select("doc_id", F.col("pos").alias("left"), F.col("pos").alias("right"))
    the = of("the").select("doc_id", (F.col("pos") - 1).alias("left"), F.col("pos").alias("right"))
    pair = lambda w: of(w).select("doc_id", F.col("pos").alias("left")).join(the, ["doc_id", "left"]).select("doc_id", "left", "right")
    spans = search.minimal_spans(single.union(pair("of")).union(pair("and")), ["doc_id"], 20)
    mentions = base.annots(t, base.ents(base.term_stats(t))).select("doc_id", F.col("left").alias("m_left"), F.col("right").alias("m_right"), "ent")
    return search.mention_support(spans, mentions, 20).select("doc_id", F.col("left").alias("span_left"), F.col("right").alias("span_right"), F.col("m_left").alias("mention"), "ent")


@query("C9_term_entity_proximity", """SELECT token, ent, count(*) AS n FROM annots a JOIN tokens t ON a.doc_id = t.doc_id AND t.pos BETWEEN a."left" - 20 AND a."right" + 20
  WHERE NOT (t.pos BETWEEN a."left" AND a."right") GROUP BY ALL""", "annots", "tokens")
def term_entity(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d)
    a = base.annots(t, base.ents(base.term_stats(t)))
    met = band_join(a, t, ["doc_id"], F.col("left") - 20, F.col("right") + 20, F.col("pos"), 64)
    return met.filter(~F.col("pos").between(F.col("left"), F.col("right"))).groupBy("token", "ent").agg(F.count("*").alias("n"))


@query("C10_dictionary_ids", "SELECT token, row_number() OVER (ORDER BY token) - 1 AS term_id FROM (SELECT DISTINCT token FROM tokens WHERE regexp_full_match(token, '[a-z]+'))", "tokens")
def dictionary_ids(spark: SparkSession, d: str) -> DataFrame:
    return dense_ids(base.tokens(spark, d).filter("token RLIKE '^[a-z]+$'"), "token", "term_id")


_ASKED = ("the", "of", "zzz-none", "and", "Und", "")


@query("C10_dictionary_lookup", f"""SELECT token, coalesce(id, -1) AS term_id FROM (VALUES {", ".join(f"('{w}')" for w in _ASKED)}) AS t(token)
  LEFT JOIN (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM tokens WHERE regexp_full_match(token, '[a-z]+'))) USING (token)""", "tokens")
def dictionary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ids of given words; -1 for what the dictionary does not have."""
    asked = spark.createDataFrame([(w,) for w in _ASKED], "token string")
    return asked.join(dictionary_ids(spark, d), "token", "left").select("token", F.coalesce("term_id", F.lit(-1).cast("long")).alias("term_id"))


@query("D4_posting_stats", "SELECT cat, count(DISTINCT doc_id) AS df, count(*) AS cf, max(doc_id) AS max_doc FROM types GROUP BY cat", "types")
def type_stats(spark: SparkSession, d: str) -> DataFrame:
    return catalog.posting_stats(base.annotated(spark, d)[3], "cat")


@query("D5_global_totals", """SELECT max(docs) AS n_docs, sum(occ)::BIGINT AS n_occurrences FROM (SELECT doc_id % 4 AS part, max(doc_id) + 1 AS docs, count(*) AS occ FROM annots GROUP BY 1)""", "annots")
def totals(spark: SparkSession, d: str) -> DataFrame:
    a = base.annotated(spark, d)[2]
    return catalog.global_stats(a.withColumn("part", F.pmod("doc_id", F.lit(4))))


@query("D6_merged_counts", "SELECT token, df, cf FROM term_stats", "term_stats")
def merged(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d)
    return catalog.merged_counts(*(base.term_stats(t.filter(F.pmod("doc_id", F.lit(3)) == i)) for i in range(3)))


@query("C19_known_vocabulary_counts", """SELECT a.token, a.cf + coalesce(b.cf, 0) AS cf FROM (SELECT token, count(*) AS cf FROM tokens WHERE doc_id % 2 = 0 GROUP BY 1) a
  LEFT JOIN (SELECT token, count(*) AS cf FROM tokens WHERE doc_id % 2 = 1 GROUP BY 1) b USING (token)""", "tokens")
def known_counts(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d)
    half = [t.filter(F.pmod("doc_id", F.lit(2)) == i).groupBy("token").agg(F.count("*").alias("cf")) for i in (0, 1)]
    return catalog.known_counts(*half)


@query("D7_term_stats", "SELECT token, df, cf, round(ln(1 + (SELECT n FROM n_docs) * 1.0 / cf), 6) AS log_idf, round((SELECT n FROM n_docs) * 1.0 / df, 6) AS energy FROM term_stats", "term_stats", "n_docs")
def stats(spark: SparkSession, d: str) -> DataFrame:
    n = float(base.n_docs(spark, d))
    return base.term_stats(base.tokens(spark, d)).select("token", "df", "cf", F.round(F.log1p(F.lit(n) / F.col("cf")), 6).alias("log_idf"), F.round(F.lit(n) / F.col("df"), 6).alias("energy"))


@query("D30_per_type_postings", """SELECT cat, ent, doc_id, string_agg("left", ',' ORDER BY "left") AS positions FROM types GROUP BY ALL""", "types")
def per_type(spark: SparkSession, d: str) -> DataFrame:
    p = base.annotated(spark, d)[3].groupBy("cat", "ent", "doc_id").agg(F.sort_array(F.collect_list("left")).alias("p"))
    return p.select("cat", "ent", "doc_id", F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"))


@query("D31_query_energy", "SELECT qid, round(energy, 6) AS energy FROM energies", "energies")
def energy(spark: SparkSession, d: str) -> DataFrame:
    t = base.tokens(spark, d)
    plan = search.matchers(spark, QUERIES)
    keyed = base.term_stats(t).select(F.lit("token").alias("leaf"), F.col("token").alias("key"), "df")
    return search.query_energies(plan, keyed, base.n_docs(spark, d)).select("qid", F.round("energy", 6).alias("energy"))


@query("C24_query_decoration", "SELECT qid, matcher, atom, leaf, key, df FROM matchers LEFT JOIN stats USING (leaf, key)", "matchers", "stats")
def decoration(spark: SparkSession, d: str) -> DataFrame:
    keyed = base.term_stats(base.tokens(spark, d)).select(F.lit("token").alias("leaf"), F.col("token").alias("key"), "df")
    return search.matchers(spark, QUERIES).join(keyed, ["leaf", "key"], "left").select("qid", "matcher", "atom", "leaf", "key", "df")


@query("E5_E4_unit_positions", 'SELECT doc_id, ent, CAST(unnest(range("left", "left" + 3)) AS INTEGER) AS pos FROM gold', "gold")
def units(spark: SparkSession, d: str) -> DataFrame:
    return catalog.unit_positions(base.gold(spark, d).withColumn("right", F.col("left") + 2)).select("doc_id", "ent", "pos")


@query("K16_closure", "SELECT sub, sup FROM closure", "closure")
def closure(spark: SparkSession, d: str) -> DataFrame:
    e = base.ents(base.term_stats(base.tokens(spark, d)))
    return catalog.closure(base.sub_sup(base.direct(e)))


GRAPH = """SELECT 'c' || c_custkey AS sub, 'n' || c_nationkey AS sup FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || r_regionkey, 'root' FROM region"""
part("geo", GRAPH)
part("geo_closure", "SELECT sub, sup FROM geo UNION SELECT c.sub, g.sup FROM geo_closure c JOIN geo g ON c.sup = g.sub", "geo")


def geo(spark: SparkSession, d: str) -> DataFrame:
    edge = lambda t, a, b: read(spark, d, t).select(a.alias("sub"), b.alias("sup"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    places = edge("customer", key("c", "c_custkey"), key("n", "c_nationkey")).union(edge("supplier", key("s", "s_suppkey"), key("n", "s_nationkey")))
    return places.union(edge("nation", key("n", "n_nationkey"), key("r", "n_regionkey"))).union(edge("region", key("r", "r_regionkey"), F.lit("root"))).distinct()


@query("K16_closure_geography", "SELECT sub, sup FROM geo_closure", "geo_closure")
def geo_closure(spark: SparkSession, d: str) -> DataFrame:
    return catalog.closure(geo(spark, d))


@query("K16_root_types", "SELECT DISTINCT sup AS cat FROM geo WHERE sup NOT IN (SELECT sub FROM geo)", "geo")
def roots(spark: SparkSession, d: str) -> DataFrame:
    return catalog.root_types(geo(spark, d))


@query("K16_is_a", "SELECT DISTINCT n.ent, n.cat, g.sub IS NOT NULL AS is_a FROM (SELECT 'c' || c_custkey AS ent, 'r' || (c_custkey % 5) AS cat FROM customer) n LEFT JOIN geo_closure g ON g.sub = n.ent AND g.sup = n.cat", "geo_closure")
def is_a(spark: SparkSession, d: str) -> DataFrame:
    pairs = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("ent"), F.concat(F.lit("r"), (F.col("c_custkey") % 5).cast("string")).alias("cat"))
    return catalog.is_a(catalog.closure(geo(spark, d)).select(F.col("sub").alias("ent"), F.col("sup").alias("cat")), pairs)


@query("B9_B10_interval_predicates", """SELECT a.l_orderkey AS doc_id, a.l_linenumber AS l1, b.l_linenumber AS l2, a.l_linenumber <= b.l_linenumber + 1 AND b.l_linenumber <= a.l_linenumber + 1 AS overlaps,
    greatest(a.l_linenumber, b.l_linenumber) + 1 - least(a.l_linenumber, b.l_linenumber) <= 3 AS near FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def interval_predicates(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber")
    a, b = lines.withColumnRenamed("l_linenumber", "l1"), lines.withColumnRenamed("l_linenumber", "l2")
    spans = (F.col("l1"), F.col("l1") + 1, F.col("l2"), F.col("l2") + 1)
    return a.join(b, "doc_id").filter("l1 < l2").select("doc_id", "l1", "l2", intervals.overlaps(*spans).alias("overlaps"), intervals.near(*spans, 3).alias("near"))


@query("B15_shard_ownership", "SELECT doc_id % 7 AS shard, count(*) AS n FROM documents GROUP BY 1")
def shards(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy(F.pmod("doc_id", F.lit(7)).alias("shard")).agg(F.count("*").alias("n"))


_WORDS = [f"bit_xor(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)" for i in range(5)]


@query("D26_xor_checksum", f"""SELECT {" || ".join(f"printf('%08x', {w})" for w in _WORDS)} AS checksum, count(*) AS n FROM (SELECT sha1(doc_id || chr(1) || "left" || chr(1) || ent) AS h FROM gold)""", "gold")
def checksum(spark: SparkSession, d: str) -> DataFrame:
    return catalog.xor_checksum(base.gold(spark, d), "doc_id", "left", "ent")
