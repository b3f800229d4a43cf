from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
from spanweave.llm import packing
from tests.llm import brute, fixtures


def _tables(spark, path):
    r = random.Random(4)
    leak = fixtures.prose(r, 15)
    base = fixtures.prose(r, 150)
    near = base.split()
    near[70] = "other"
    rows = [(i, fixtures.prose(r, r.randint(60, 200)), "en", f"src{i % 4}", i, "x") for i in range(40)]
    rows += [(100, base, "en", "src1", 5, "x"), (101, " ".join(near), None, "src2", 5, None), (102, base, "en", None, None, "x"), (103, "too short", "en", "src1", 9, "x"), (104, None, None, None, None, None)]
    rows += [(105, f"{fixtures.prose(r, 60)} {leak} {fixtures.prose(r, 60)}", "en", "src1", 7, "x"), (106, f'{fixtures.prose(r, 80)} token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" end', "en", "src1", 3, "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, [(1, leak)]


def test_stages_and_run(spark, tmp_path):
    rows, items = _tables(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name == "best_fit_packing":
            break
        assert out.schema == docs.schema
        if name == "quality_rules":
            kept = {i: r for i, r in kept.items() if not brute.quality(r[1])[5]}
        elif name == "ngram_jaccard_join":
            groups = brute.components({i: r[1] for i, r in kept.items()})
            kept = {i: r for i, r in kept.items() if groups[i][1] == i}
        elif name == "benchmark_decontamination":
            hit = {x[0] for x in brute.contamination([(i, r[1]) for i, r in kept.items()], items) if x[5]}
            kept = {i: r for i, r in kept.items() if i not in hit}
        else:
            text = kept[106][1]
            at = text.index("token")
            clean = f'{text[:at]}[SECRET]" end'
            kept[106] = (106, clean, *kept[106][2:4], len(clean), kept[106][5])
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        assert {r.doc_id: tuple(r) for r in docs.collect()} == kept
    assert set(kept) == {*range(40), 100, 106}
    encoder = packing.encoder_of(packing.vocabulary())
    want = Counter((i, len(encoder.ids(r[1])) // 4) for i, r in kept.items())
    for found in (out, corpus_pipeline.run(spark, str(tmp_path))):
        assert Counter((r.doc_id, r.length) for r in found.collect()) == want


def test_empty(spark, tmp_path):
    docs = fixtures.empty(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark):
    docs = fixtures.docs(spark, repeat=True, null_id=True)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    ids = Counter(r.doc_id for r in kept.collect())
    assert max(ids.values()) == 1 and None not in ids and 6 in ids
    for name in ("quality_rules", "without_secrets"):
        assert getattr(corpus_pipeline, name)(spark, docs, "").schema == docs.schema


def test_clashing_columns(spark, tmp_path):
    """Columns named as those that stages work with, and one with a dot in its name, come out as they went in."""
    r = random.Random(3)
    names = ["__quality", "__host", "__bad", "__q", "__first", "__id", "__row", "__group", "__windows", "__w", "__clean", "__text", "__salt", "id", "row", "group", "a.b"]
    rows = [(i, fixtures.prose(r, 60), "s", *(f"{n}{i}" for n in names)) for i in [1, 2, 2, None, 5]]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    spark.createDataFrame([(1, fixtures.prose(r, 15))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("quality_rules", "near_duplicates", "decontaminated", "without_secrets"):
        for some in (docs, docs.filter("doc_id IN (1, 5)")):
            out = getattr(corpus_pipeline, name)(spark, some, str(tmp_path))
            assert out.columns == docs.columns
            assert Counter(map(tuple, out.collect())) == Counter(map(tuple, some.collect()))
    assert corpus_pipeline.packed(spark, docs, "").count() == 5


def test_rows_without_an_id_or_with_one_of_another_stay(spark):
    r = random.Random(8)
    a, b, c, d, e, f = (fixtures.prose(r, 80) for _ in range(6))
    near = a.split()
    near[40] = "other"
    near = " ".join(near)
    rows = [(1, a), (1, a), (None, b), (None, c), (None, ""), (None, "too short"), (2, d), (2, e), (3, near), (None, a), (None, f), (None, f), (None, f), (4, f[:-1] + "~"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect()))
    assert got == Counter([(1, a), (None, b), (None, c), (None, ""), (None, "too short"), (2, d), (2, e), (4, f[:-1] + "~"), (5, None)])
    nulls = docs.filter("doc_id IS NULL AND length(text) > 20")
    assert Counter(x.text for x in corpus_pipeline.near_duplicates(spark, nulls, "").collect()) == Counter([a, b, c, f])
