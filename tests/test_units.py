from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.functions import codec, intervals, metrics, text
from spanweave.functions.lbfgs import minimize
from spanweave.operators import catalog, context, interpret, joins, logistic, rank, skips, spotting
from spanweave.plans import query, search
from spanweave.sources import catalogs, corpus
from spanweave.streaming import incremental


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


# --- query language --------------------------------------------------------------------------------------------


def test_parser_samples():
    c = query.parse('uw(20 +[person] {Bill_Gates} +"had a little" lamb -dog)')
    assert not c.ordered and c.width == 20 and [m.exist for m in c.matchers] == ["must", "may", "must", "may", "not"]
    assert [m.kind for m in c.matchers] == ["binding", "entity", "phrase", "token", "token"] and c.binding == 0
    assert query.parse("uw(5 -[t] a)").matchers[0].exist == "must"  # a placeholder must occur
    assert query.parse("ow(5 [t] a)").ordered
    for bad in ('uw(5 "a [t]")', 'uw(5 "a {e}")', "uw(5 a) uw(5 b)", "uw(a b)", "uw(5)", "uw(5 12)", "uw(5 ow)", "xx(5 a)", "uw(5 a", 'uw(5 "")', "uw(5 a;)"):
        assert query.try_parse(bad) is None, bad


def test_checks():
    query.check(query.parse("uw(5 [t] a)"), {"t"})
    for bad in ("uw(5 a b)", "uw(5 [t] [s])", "uw(5 [t] -a)", "ow(5 [t] a)", "uw(5 [s] a)"):
        with pytest.raises(query.QueryError):
            query.check(query.parse(bad), {"t"})


def test_selectors_and_telegraphs():
    assert query.selector('+"of the"').quoted and query.selector("+the").exist == "must" and query.selector("{e}").kind == "entity"
    assert query.selector("a b").kind == "phrase" and query.selector("- x").exist == "not"
    assert query.telegraph_words(query.telegraph('+blue "big band" year')) == ["blue", "big", "band", "year"]
    assert query.binding_type(query.parse("uw(5 a [t])")) == "t"


# --- windows ---------------------------------------------------------------------------------------------------


def brute_contexts(witnesses, b_matcher, width, n_must):
    out = []
    for m, _, b_l, b_r in [w for w in witnesses if w[0] == b_matcher]:
        near, left, right = [], b_l, b_r
        for a, exist, l, r in witnesses:
            if a == m:
                continue
            before = l < b_l or (l == b_l and a < m)
            if (l >= b_r - width) if before else (r <= b_l + width):
                near.append((a, exist))
                left, right = (min(left, l), right) if before else (left, max(right, r))
        must = {a for a, e in near if e == "must"}
        if near and len(must) == n_must:
            out.append((b_l, b_r, left, right, len(near)))
    return sorted(out)


def test_window_example(spark):
    rows = [("q", 1, 0, "must", "binding", 10, 11, "e", 0.0)] + [("q", 1, 1, "may", "token", p, p, None, 1.0) for p in (6, 5, 14, 16, 15)]
    w = spark.createDataFrame(rows, "qid string, doc_id long, matcher int, exist string, kind string, left int, right int, ent string, energy double")
    plan = spark.createDataFrame([("q", 5, 0)], "qid string, width int, n_must int")
    pairs = search.window_pairs(w, plan, 5)
    assert sorted(r.left for r in pairs.collect()) == [6, 14, 15]
    assert [(r.left, r.right) for r in search.contexts(pairs).collect()] == [(6, 15)]


def test_windows_against_brute_force(spark):
    r, rows, want = random.Random(3), [], []
    for doc in range(60):
        own = [(0, "must", p, p + r.randint(0, 2)) for p in r.sample(range(40), 3)] + [(1, "must", p, p + r.randint(0, 1)) for p in r.sample(range(40), 3)] + [(2, "may", p, p) for p in r.sample(range(40), 4)]
        rows += [("q", doc, m, e, "binding" if m == 0 else "token", a, b, "e", 1.0) for m, e, a, b in own]
        want += [(doc, *x) for x in brute_contexts(own, 0, 6, 1)]
    w = spark.createDataFrame(rows, "qid string, doc_id long, matcher int, exist string, kind string, left int, right int, ent string, energy double")
    plan = spark.createDataFrame([("q", 6, 1)], "qid string, width int, n_must int")
    # the same witness of the placeholder may be there twice; contexts are one for each place
    got = search.contexts(search.window_pairs(w, plan, 6)).select("doc_id", "b_left", "b_right", "left", "right", "n_witnesses").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_scan_equals_join_plan(spark):
    docs = {1: "a rose is a rose is a rose".split(), 2: "the rose and the is".split(), 3: "is a".split()}
    t = corpus.inline_documents(spark, docs)
    types = t.filter("token = 'rose'").select("doc_id", F.col("pos").alias("left"), F.col("pos").alias("right"), F.col("token").alias("ent"), F.lit("flower").alias("cat"))
    found = search.search(spark, [("q", query.parse('uw(4 +[flower] +"is a")')), ("p", query.parse("uw(2 [flower] the)"))], t, types.drop("cat"), types)
    assert sorted((x.qid, x.doc_id, x.b_left, x.left, x.right) for x in found.collect()) == [("p", 2, 1, 0, 3), ("q", 1, 1, 1, 3), ("q", 1, 4, 2, 6), ("q", 1, 7, 5, 7)]


def test_band_join(spark):
    r = random.Random(1)
    a = [(r.randint(0, 3), r.randint(0, 100)) for _ in range(80)]
    b = [(r.randint(0, 3), r.randint(0, 100)) for _ in range(80)]
    left = spark.createDataFrame(a, "k int, x int")
    right = spark.createDataFrame(b, "k int, y int")
    got = joins.band_join(left, right, ["k"], F.col("x") - 7, F.col("x") + 3, F.col("y"), 5)
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted((k, x, y) for k, x in a for j, y in b if j == k and x - 7 <= y <= x + 3)


# --- spotting --------------------------------------------------------------------------------------------------


def test_spotting_example(spark):
    t = corpus.inline_documents(spark, {1: "the new york times square in new york".split()})
    phrases = spark.createDataFrame([("new|york",), ("new|york|times",), ("york",), ("times|square",), ("square",)], "phrase string")
    found = spotting.maximal(spotting.any_match(t, phrases, 3))
    assert sorted((r.left, r.right) for r in found.collect()) == [(1, 3), (3, 4), (6, 7)]


def test_leaves(spark):
    m = spark.createDataFrame([("new|york", 1001), ("new|york", 1003), ("new|york|times", 1002), ("new|york|times", 1002), ("new|haven", 1001)], "phrase string, ent long")
    assert [(r.phrase, r.leaf, r.candidates) for r in spotting.leaves(m).orderBy("leaf").collect()] == [("new|haven", 0, [1001]), ("new|york", 1, [1001, 1003]), ("new|york|times", 2, [1002])]


def test_ngrams_need_adjacent_positions(spark):
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b"), (1, 5, "c"), (1, 6, "d")], "doc_id long, pos int, token string")
    assert sorted(r.phrase for r in joins.ngrams(t, 2).collect()) == ["a", "b", "c", "c|d", "d"]


def test_coalesced(spark):
    m = spark.createDataFrame([(1, 0, 1, "e"), (1, 2, 2, "e"), (1, 4, 4, "e"), (1, 3, 3, "f")], "doc_id long, left int, right int, ent string")
    assert sorted((r.ent, r.left, r.right, r.n) for r in context.coalesced(m).collect()) == [("e", 0, 2, 2), ("e", 4, 4, 1), ("f", 3, 3, 1)]


# --- catalog ---------------------------------------------------------------------------------------------------


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), (None, "a")], "sub string, sup string")
    got = {(r["sub"], r["sup"]) for r in catalog.closure(e).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd" if x != y}
    assert ("d", "d") in {(r["sub"], r["sup"]) for r in catalog.closure(e, include_self=True).collect()}
    assert catalog.closure(spark.createDataFrame([], "sub string, sup string")).count() == 0


def test_checksum_ignores_order(spark):
    a = spark.createDataFrame([(8, 7), (5, 2), (None, 1)], "a int, b int")
    x, y = catalog.xor_checksum(a, "a", "b").first(), catalog.xor_checksum(a.orderBy(F.desc("b")), "a", "b").first()
    assert x == y and len(x.checksum) == 40
    assert catalog.xor_checksum(a.filter("b > 1"), "a", "b").first().checksum != x.checksum


def test_dense_ids(spark):
    df = spark.createDataFrame([(w,) for w in "pear fig apple fig kiwi".split()] + [(None,)], "w string")
    assert {r.w: r.id for r in joins.dense_ids(df, "w").collect()} == {"apple": 0, "fig": 1, "kiwi": 2, "pear": 3}


# --- functions -------------------------------------------------------------------------------------------------


def test_hint_windows(spark):
    def of(n):
        return [tuple(w) for w in one(spark, text.hint_windows(F.col("w")), w=[str(i) for i in range(n)])]

    assert of(1) == [(0, 1)] and of(2) == [(0, 1), (0, 2)] and of(3) == [(0, 1), (0, 2), (1, 2), (1, 3)]
    assert of(5) == [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (3, 5)]


def test_names_and_phrases(spark):
    for canonical, plain in (("wikicategory_wordnet_big cat_102", "big cat"), ("wikicategory_cats", "cats"), ("wordnet_cat_12", "cat"), (" x ", "x")):
        assert one(spark, text.free_text(F.lit(canonical))) == plain
    assert one(spark, text.phrase(F.array(F.lit("a"), F.lit(None), F.lit("b")))) == "a||b"
    assert one(spark, text.phrase(F.array(F.lit("a|b")))) is None
    assert one(spark, text.term(F.lit("  The "))) == "the" and one(spark, text.term(F.lit("x" * 65))) is None and one(spark, text.term(F.lit(" "))) is None
    assert one(spark, text.link_target(F.lit("B-/wiki/Cat"))) == "Cat" and one(spark, text.link_target(F.lit("0"))) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=6))
def test_gaps_round_trip(spark, values):
    values = sorted(values)
    df = spark.createDataFrame([(values,)], "v array<long>")
    assert df.select(codec.from_gaps(codec.gaps(F.col("v"))).alias("x")).first().x == values


def test_quantised_scores(spark):
    for back, value in ((0, 0.0), (1, -0.0013644), (255, -88.722839)):
        assert abs(one(spark, codec.decode_log_prob(F.lit(255 - back))) - value) < 1e-5
    for b in range(0, 256, 5):
        assert one(spark, codec.encode_log_prob(codec.decode_log_prob(F.lit(b)))) == b


@pytest.mark.parametrize("high,low", [(0, 0), (1, -1), (-5, 7), (2**31 - 1, -(2**31))])
def test_packed_ints(spark, high, low):
    p = codec.pack_ints(F.lit(high), F.lit(low))
    assert (one(spark, codec.high_int(p)), one(spark, codec.low_int(p))) == (high, low)


def test_proximity(spark):
    at = lambda *x: one(spark, intervals.proximity(*map(F.lit, x)))
    assert at(1, 3, 2, 5) == 1.0 and at(1, 1, 3, 4) == 0.5 and at(9, 9, 1, 5) == 0.25


# --- metrics ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("labels,n_good,want", [("1010", 3, (-0.5, 1, 0.666667, 0.555556, 0.815465)), ("01001", 2, (-0.666667, 0.5, 0.333333, 0.45, 1)), ("00", 1, (-1, 0, 0, 0, 0)), ("11", 2, (0, 1, 0.666667, 1, 1))])
def test_metric_values(spark, labels, n_good, want):
    ranked = spark.createDataFrame([("q", x == "1", i + 1) for i, x in enumerate(labels)], "qid string, label boolean, rank int")
    got = metrics.metrics(ranked, spark.createDataFrame([("q", n_good)], "qid string, n_good long"), "qid", 3).first()
    assert [round(x, 6) for x in (got.pair_swaps, got.mrr, got.p_at, got.ap, got.ndcg_at)] == [round(x, 6) for x in want]


def test_ndcg_at_five(spark):
    ranked = spark.createDataFrame([("q", x == "1", i + 1) for i, x in enumerate("01001")], "qid string, label boolean, rank int")
    got = metrics.metrics(ranked, spark.createDataFrame([("q", 2)], "qid string, n_good long"), "qid", 5).first()
    assert round(got.ndcg_at, 6) == 0.715338


# --- learning --------------------------------------------------------------------------------------------------


def test_lbfgs_finds_the_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    x = minimize(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1), np.zeros(3))
    assert np.allclose(x, [1, 0.1, 0.01], atol=1e-4)


@pytest.mark.parametrize("kind", ["sum", "softmax", "noisy_or"])
def test_rank_gradients(kind):
    r = np.random.default_rng(0)
    qid, ent, x = np.repeat([1, 2], 10), np.tile(np.arange(5), 4), r.normal(size=(20, 3))
    fun = rank.objective(kind, qid, ent, ent % 2 == 0, x, 1.0)
    u = r.normal(size=3) * 0.3
    for i in range(3):
        e = np.eye(3)[i] * 1e-6
        assert abs((fun(u + e)[0] - fun(u - e)[0]) / 2e-6 - fun(u)[1][i]) < 1e-4


def test_trained_ranking_beats_chance(spark):
    r = random.Random(0)
    rows = [(q, e, e < 3, [r.gauss(1.0 if e < 3 else 0.0, 0.7), r.gauss(0, 1)]) for q in range(10) for e in range(10) for _ in range(3)]
    sfv = spark.createDataFrame(rows, "qid long, ent long, label boolean, fv array<double>")
    scored = rank.cross_validated(sfv, "softmax", 5, [1.0], 2)
    wrong = metrics.tied_pairs(scored, "qid").agg(F.avg("swap_fraction").alias("x")).first().x
    assert wrong < 0.2


def _stages_read(spark) -> dict[int, int]:
    """Rows that each stage so far has read from shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    numbers = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    found = spark._jsc.sc().statusStore().stageList(None, False, False, numbers, spark._jvm.java.util.ArrayList())
    return {found.apply(i).stageId(): found.apply(i).shuffleReadRecords() for i in range(found.size())}


@pytest.mark.parametrize("kind", ["softmax", "noisy_or"])
def test_spread_training_moves_no_snippets(spark, kind):
    """Weights are those of one process over all snippets; no stage reads the snippets of a fold from a shuffle."""
    r = np.random.default_rng(1)
    rows = [(q, str(e), e % 3 == 0, r.normal(e % 3 == 0, 1, 2).tolist()) for q in range(12) for e in range(5) for _ in range(4000 if (q, e) == (3, 0) else 60)]
    odd = [(3, "0", True, None), (3, "7", False, [None, 1.0]), (None, "0", None, [1.0, 1.0]), (4, None, None, [0.5, 0.2]), (50, "1", True, [9.0, 9.0])]
    r.shuffle(rows)
    sfv = spark.createDataFrame(spark.sparkContext.parallelize(rows + odd, 6), "qid long, ent string, label boolean, fv array<double>")
    before = _stages_read(spark)
    got = {(w.fold, w.sigma2): w.w for w in rank.train(sfv, kind, 5, [0.5, 2.0], 2).collect()}
    assert max(n for i, n in _stages_read(spark).items() if i not in before) < len(rows)
    fold = {x.qid: x.f for x in sfv.select("qid", rank.fold_of(F.col("qid"), 5).alias("f")).distinct().collect()}
    used = [x for x in rows + odd if x[0] is not None and x[3] and None not in x[3]]
    assert len(got) == 10
    for (f, sigma2), w in got.items():
        qid, ent, label, fv = zip(*(x for x in used if fold[x[0]] != f), strict=True)
        fun = rank.objective(kind, np.array(qid), np.array([e or "" for e in ent]), np.array(label, bool), np.array(fv), sigma2)
        assert np.allclose(w, minimize(fun, np.zeros(2), rounds=60), atol=1e-5)


def test_leaf_regression_separates():
    ctx = np.repeat(np.arange(20), 2)
    ent = np.repeat(np.where(np.arange(20) % 2 == 0, "a", "b"), 2)
    feat = np.array([f for i in range(20) for f in (("x" if i % 2 == 0 else "y"), "z")])
    ents, feats, w = logistic.fit_leaf(ctx, ent, feat, np.ones(40))
    assert w[feats.index("x"), ents.index("a")] > w[feats.index("x"), ents.index("b")]
    assert w[feats.index("y"), ents.index("b")] > 0 > w[feats.index("y"), ents.index("a")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 60)), min_size=1, max_size=8), st.integers(0, 4))
def test_optimal_skips(items, budget):
    from itertools import combinations

    prob, bits = np.array([p for p, _ in items], float), np.array([b for _, b in items])
    best = min(skips.cost(prob, bits, list(c)) for k in range(budget + 1) for c in combinations(range(len(items)), min(k, len(items))))
    got = skips.optimal(prob, bits, budget)
    assert len(got) <= budget and abs(skips.cost(prob, bits, got) - best) < 1e-9
    for policy in skips.POLICIES.values():
        assert len(policy(prob, bits, budget)) <= budget


def test_snapping(spark):
    asked = spark.createDataFrame([(1, 1, 5), (1, 3, 2), (1, 4, 1), (1, 9, 7)], "leaf long, feat long, n long")
    known = spark.createDataFrame([(1, 3), (1, 6)], "leaf long, feat long")
    assert {r.feat: r.n for r in skips.snapped(asked, known).collect()} == {3: 7, 6: 1}


def test_type_model(spark):
    words = interpret.type_words(spark.createDataFrame([("c1", "Big cat"), ("c2", "small cat"), ("c2", "SMALL dog")], "cat string, lemma string"))
    _, empty, n = interpret.type_model(words)
    glob = {"big": 2 / 4, "cat": 3 / 4, "small": 2 / 4, "dog": 2 / 4}
    s = interpret.TYPE_SMOOTHER
    want = sum(math.log(1 - ((1 - s) * (w in ("big", "cat")) + s * p)) for w, p in glob.items())
    assert n == 2 and abs({r.cat: r.log_empty for r in empty.collect()}["c1"] - want) < 1e-9


# --- sources ---------------------------------------------------------------------------------------------------


def test_corpus_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    corpus.write_corpus(docs, f"{tmp_path}/c", 4)
    back = corpus.read_corpus(spark, f"{tmp_path}/c")
    assert back.count() == 50 and corpus.get_document(back, 7).first().text == "text 7"


def test_html(spark):
    page = "<html><head><title>A &amp; B</title><script>x('<p>')</script></head><!-- c --><body>one<br/>two&nbsp;&lt;3</body></html>"
    assert one(spark, corpus.page_text(F.lit(page))) == "A & B ||| one two <3"


def test_trec_files(spark, tmp_path):
    import gzip

    rec = "<DOC>\n<DOCNO>D{0}</DOCNO>\n<DOCHDR>\nhttp://x/{0}\nContent-type: {1}\n</DOCHDR>\n<p>hello {0}</p>\n</DOC>\n"
    with gzip.open(tmp_path / "a.gz", "wt") as f:
        f.write(rec.format(1, "text/html") + rec.format(2, "image/png") + rec.format(3, "text/html; charset=x"))
    got = corpus.read_trec(spark, str(tmp_path / "a.gz")).orderBy("doc_no").collect()
    assert [(r.doc_no, r.url) for r in got] == [("D1", "http://x/1"), ("D3", "http://x/3")]


def test_feed_file(spark, tmp_path):
    line = lambda w, link: "\t".join([w, *"x" * 9, link, "0"])
    body = "\n".join([line("Bill", "B-/wiki/Bill_%26_Co"), line("Gates", "I-/wiki/Bill_%26_Co"), line("met", "0"), line("Jobs", "B-/wiki/Jobs"), line("Jobs", "B-/wiki/Jobs")])
    (tmp_path / "f.txt").write_text(f"head\n%%#DOC 12\n%%#PAGE Some title\n{body}\n")
    t = corpus.read_feed(spark, str(tmp_path / "f.txt"))
    assert {(r.doc, r.title) for r in t.filter("doc = '12'").collect()} == {("12", "Some title")}
    got = corpus.feed_annotations(t.filter("doc = '12'")).orderBy("left").collect()
    assert [(r.right - r.left, r.name) for r in got] == [(1, "Bill_&_Co"), (0, "Jobs"), (0, "Jobs")]


def test_rdf(spark):
    lines = spark.createDataFrame([("<http://x/a%20b> <http://y#type> <http://o/Cat> .",), ("<http://x/a> <http://y#name> \"z\" .",)], "value string")
    assert [tuple(r) for r in catalogs.rdf_catalog(lines, lines)["ent_cat"].collect()] == [("a b", "Cat")]


# --- streams ---------------------------------------------------------------------------------------------------


def test_incremental_postings(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    incremental.append_postings(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    spark.createDataFrame([(3, "c c")], docs.schema).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.append_postings(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    got = {(r.token, r.doc_id): r.positions for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 1): [0, 2], ("b", 1): [1], ("b", 2): [0], ("c", 2): [1], ("c", 3): [0, 1]}


@pytest.mark.parametrize("word,want", [p.split(":") for p in "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist consistent:consist consistently:consist consolation:consol consolations:consol consolatory:consolatori consolidate:consolid consolidating:consolid consoling:consol consonant:conson consort:consort conspicuous:conspicu conspiracy:conspiraci conspirators:conspir constable:constabl constancy:constanc knack:knack knackeries:knackeri knavish:knavish knees:knee kneel:kneel knelt:knelt knew:knew knitted:knit knitting:knit knives:knive knocker:knocker knocking:knock knots:knot skies:sky dying:die news:news generously:generous general:general communism:communism hopping:hop hoping:hope ties:tie cries:cri gas:gas gaps:gap kiwis:kiwi agreed:agre say:say by:by happy:happi relational:relat conditional:condit triplicate:triplic hopefulness:hope adjustment:adjust adoption:adopt roll:roll controll:control".split()])
def test_stems(word, want):
    from spanweave.functions.stemmer import stem

    assert stem(word) == want
