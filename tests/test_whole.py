"""Queries without SQL, or with SQL that says how they are made, against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanweave import registry, settings
from spanweave.operators import joins, rank, skips
from spanweave.plans import search
from spanweave.suite import SUITE, ranking
from tests.oracle import connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", ["K2_train_sum", "K3_train_softmax", "K4_train_noisy_or"])
def test_all_queries_are_ranked(spark, sf_dir, con, name):
    want = con.sql("SELECT DISTINCT l_orderkey % 40, l_partkey % 30 FROM lineitem").fetchall()
    got = [(r.qid, r.ent) for r in registry.QUERIES[name](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len({q for q, _ in want}) == 40


def test_penalty_grid_is_over_all_queries(spark, sf_dir):
    scored = rank.cross_validated(ranking.sfv(spark, sf_dir), "sum", 5, [0.1, 1.0, 10.0], 4).collect()
    want = {}
    for s in {r.sigma2 for r in scored}:
        swaps = []
        for q in range(40):
            rows = [r for r in scored if r.sigma2 == s and r.qid == q]
            pairs = [g.score <= b.score for g in rows if g.label for b in rows if not b.label]
            swaps += [sum(pairs) / len(pairs)] if pairs else []
        want[s] = sum(swaps) / len(swaps)
    got = {r.sigma2: r.swap_fraction for r in registry.QUERIES["K1_K5_penalty_grid"](spark, sf_dir).collect()}
    assert got == pytest.approx(want)


def test_lidstone_leaves_one_out(spark, sf_dir, con):
    """As the original does it, in one process, over the tables of contexts and features."""
    sql = SUITE.compose("SELECT x.ctx, x.leaf, x.ent, f.feat, f.freq FROM train_ctx x LEFT JOIN feats f USING (ctx)", "train_ctx", "feats")
    leaves, cands = defaultdict(dict), defaultdict(list)
    for ctx, leaf, ent, feat, freq in con.sql(sql).fetchall():
        leaves[leaf].setdefault(ctx, (ent, {}))[1].update({feat: freq} if feat else {})
    for leaf, ent in con.sql(SUITE.compose("SELECT leaf, ent FROM cands", "cands")).fetchall():
        cands[leaf].append(ent)
    want = {}
    for leaf, rows in leaves.items():
        if len(rows) < 2:
            continue
        n, sums, known, vocab = Counter(), Counter(), Counter(), set()
        for ent, feats in rows.values():
            n[ent] += 1
            for feat, freq in feats.items():
                sums[ent] += freq
                known[ent, feat] += freq
                vocab.add(feat)
        best = (-1.0, 0.0)
        for lam in (0.01, 0.1, 1.0, 10.0):
            right = 0
            for ent, feats in rows.values():
                score = {}
                for c in cands[leaf]:
                    score[c] = math.log((n[c] + 1) / (len(rows) + len(cands[leaf])))
                    for feat, freq in feats.items():
                        own = freq if c == ent else 0
                        score[c] += freq * (math.log(known[c, feat] - own + lam) - math.log(sums[c] - own + lam * len(vocab)))
                right += all(score[ent] > score[c] + 1e-9 for c in score if c != ent)
            if right / len(rows) > best[0]:
                best = (right / len(rows), lam)
        want[leaf] = (best[1], pytest.approx(best[0]), len(rows))
    got = {r.leaf: (r["lambda"], r.accuracy, r.instances) for r in registry.QUERIES["K8_lidstone_tuning"](spark, sf_dir).collect()}
    assert got == want
    average = registry.QUERIES["D18_accuracy_averages"](spark, sf_dir).first()
    assert average.macro == pytest.approx(sum(a for _, a, _ in got.values()) / len(got))


def test_positions_of_equal_and_no_rows(spark):
    df = spark.createDataFrame([(2, "b"), (1, "z"), (2, "b"), (None, "n")], "k long, v string")
    assert [tuple(r) for r in joins.positions(df, ["k", "v"], "at").orderBy("at").collect()] == [(None, "n", 1), (1, "z", 2), (2, "b", 3), (2, "b", 4)]
    assert joins.positions(df.filter("k > 9"), ["k"], "at").count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([("b", 2), ("a", 5), ("d", 1), ("c", None)], "k string, n long").repartition(3)
    assert [tuple(r) for r in joins.running_sums(df, ["k"], "n", "before").orderBy("k").collect()] == [("a", 5, 0), ("b", 2, 5), ("c", None, 7), ("d", 1, 7)]
    assert joins.running_sums(df.filter("n > 9"), ["k"], "n", "before").count() == 0


def test_evenly_takes_the_feature_after_each_mark():
    bits = np.array([30, 10, 10, 50, 10, 10])  # starts 0 30 40 50 100 110
    assert skips.evenly(bits / 120, bits, 4) == [0, 1, 4]  # marks 0, 30, 60, 90: the last two share a feature
    assert skips.evenly(bits / 120, bits, 0) == [] and skips.evenly(bits / 120, bits, 1) == [0]
    assert skips.evenly(np.ones(4), np.ones(4, int), 4) == [0, 1, 2, 3]
    assert skips.evenly(np.ones(2), np.array([1, 9]), 2) == [0]  # no feature starts at 5 or later


def test_minimal_spans(spark):
    r = random.Random(3)
    rows = [(d, b, b + r.randint(0, 4)) for d in range(5) for b in [r.randint(0, 30) for _ in range(20)]]
    got = {tuple(x) for x in search.minimal_spans(spark.createDataFrame(rows, "doc_id long, left int, right int"), ["doc_id"], 4).collect()}
    want = {s for s in set(rows) if s[2] - s[1] < 4 and not any(o != s and o[0] == s[0] and s[1] <= o[1] and o[2] <= s[2] for o in rows)}
    assert got == want


def test_settings(spark):
    chosen = settings.Settings({"spanweave.terms": "lower"})
    assert chosen.term_processor() is settings.TERM_PROCESSORS["lower"]
    with pytest.raises(KeyError, match="spanweave.catalog"):
        chosen.catalog()
    with pytest.raises(KeyError, match="no such terms"):
        settings.Settings({"spanweave.terms": "latin"}).term_processor()
