from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanweave.llm import common, jaccard, packing, perspectives, pii, quality, secrets, suffixes, urls, warc, winnow
from spanweave.llm.common import Scratch
from tests.llm import brute, fixtures, heldout
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.docs(spark, repeat=True, null_id=True).cache()


# --- quality ---------------------------------------------------------------------------------------------------


def test_quality_measures(spark, docs):
    got = quality.measured(docs, "__q").select("text", "__q.*", "kept").collect()
    for r in got:
        assert tuple(r[1:6]) == brute.quality(r.text)[:5]
    assert {r.kept for r in got} == {"k", None}  # a column of the input with a clashing name


def test_quality_hosts(spark):
    bad = [(i, "x y", "en", "bad", 0) for i in range(60)]
    good = [(100 + i, fixtures.prose(random.Random(i), 80), "en", f"h{i % 9}", 0) for i in range(200)]
    rows = [*bad, *good, (900, fixtures.prose(random.Random(5), 80), "en", "bad", 0), (901, "tiny", "en", "one", 0), (902, fixtures.prose(random.Random(6), 80), "en", "one", 0)]
    scratch = Scratch(spark, "t")
    numbers = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "__q")
    judged = {r.doc_id: r.q for r in quality.judge(numbers, "__q", scratch, quality.rejected_hosts(numbers, "__q", scratch)).selectExpr("doc_id", "__q AS q").collect()}
    assert judged[900].host_rejected and not judged[900].base_failed and not judged[900].kept
    assert not judged[902].host_rejected and judged[902].kept  # one failure of two is shrunk towards the corpus
    assert all(judged[100 + i].kept for i in range(200))


def test_quality_empty(spark):
    e, scratch = quality.measured(fixtures.empty(spark), "__q"), Scratch(spark, "t")
    assert quality.judge(e, "__q", scratch, quality.rejected_hosts(e, "__q", scratch)).count() == 0


def test_host_prior_matches_moments(spark):
    df = spark.createDataFrame([("a", 10, 5), ("b", 1000, 900), ("c", 1, 1), ("d", 500, 10)], "source string, n long, failed long")
    rate = {r.source: r.rate for r in quality.host_rates(df).collect()}
    assert rate["c"] < 1 and abs(rate["b"] - 0.9) < 0.02 and rate["d"] < 0.05


# --- personal data ---------------------------------------------------------------------------------------------


def _pii(spark, df):
    return pii.spans(Scratch(spark, "t").keep(pii.candidates(df), "c")).selectExpr("doc_id", "base", "added").collect()


def test_pii_base(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in _pii(spark, docs):
        spans = [f"{c.kind}:{c.b}:{c.e}" for k in pii.KINDS for c in sorted((c for c in r.base if c.kind == k), key=lambda c: c.b)]
        assert spans == brute.pii(texts[r.doc_id])[1], texts[r.doc_id]
    assert _pii(spark, fixtures.empty(spark)) == []


def test_pii_fuzz(spark):
    r = random.Random(5)
    bits = ["1", "2", "34", "5555", "+", ".", "@", "a", "b-c", " ", "(", ")", "-", "é", "😀", "4111111111111111", "1.2.3.4", "256", "x@y.z", "_", "\n", "[at]", "com", "555-123-4567"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(1500)]
    rows += [(5000, "a.b@" + "x." * 20000 + "y"), (5001, "1" * 50000), (5002, "1 " * 30000), (5003, "+1" + "(" * 30000), (5004, "." * 60000 + "@a.b")]
    texts = dict(rows)
    for got in _pii(spark, spark.createDataFrame(rows, "doc_id long, text string")):
        spans = [f"{c.kind}:{c.b}:{c.e}" for k in pii.KINDS for c in got.base if c.kind == k]
        assert spans == brute.pii(texts[got.doc_id])[1]


def test_pii_em_finds_reliable_labelers():
    r = random.Random(1)
    counts = Counter()
    for _ in range(4000):
        true = r.random() < 0.3
        counts["".join("+" if r.random() < p else "-" if r.random() < q else "0" for p, q in ([(0.95, 0.5), (0.9, 0.5), (0.85, 0.5), (0.5, 0.1), (0.0, 0.05)] if true else [(0.05, 0.5), (0.1, 0.5), (0.2, 0.5), (0.5, 0.1), (0.0, 0.3)]))] += 1
    truth = pii.em(counts)
    assert truth["+++00"] > 0.9 and truth["---0-"] < 0.1


def test_pii_adds_spans(spark):
    r = random.Random(2)
    rows = [(i, f"{fixtures.prose(r, 5)} call phone {r.choice(['+1 (555)', '(555)'])} {r.randint(200, 999)}-{r.randint(1000, 9999)} {fixtures.prose(r, 5)}") for i in range(400)]
    got = _pii(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    loose = [g for g in got if not g.base]
    assert len(loose) > 100 and sum(len(g.added) for g in loose) > 0.9 * len(loose)


def test_pii_never_adds_a_number_that_fails_its_check(spark):
    r = random.Random(4)
    rows = [(i, f"card: {r.randint(4000, 4999)} {r.randint(1000, 9999)} {r.randint(1000, 9999)} {r.randint(1000, 9999)} paid by visa card") for i in range(300)]
    got = _pii(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert 0 < sum(len(g.base) for g in got) < 100 and not any(c.kind == "card" for g in got for c in g.added)


# --- secrets ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def chain():
    return secrets.train(secrets.made_up())


def test_secret_spans(spark, docs, chain):
    texts = [r.text for r in docs.collect()]
    got = secrets.judged(docs, "__s", chain).select("text", "__s.*").collect()
    assert len(got) == len(texts)
    for r in got:
        counts, written = brute.secrets(r.text)
        assert tuple(r[1:5]) == counts
        assert [s for s in r.spans.split(",") if s and not s.startswith("model")] == written
    assert secrets.judged(fixtures.empty(spark), "__s").count() == 0


def test_crf_held_out(chain):
    """Texts of another generator than that of the training texts."""
    texts = heldout.cases(1500, seed=5)
    found = secrets.model_spans(pa.array([t for t, _ in texts]), chain)
    hit = sum(any(b < y and x < e for b, e in f) for f, (_, spans) in zip(found, texts, strict=True) for x, y in spans)
    right = sum(any(b < y and x < e for x, y in spans) for f, (_, spans) in zip(found, texts, strict=True) for b, e in f)
    assert hit / sum(len(s) for _, s in texts) > 0.9 and right / sum(map(len, found)) > 0.9
    exact = sum(f == s for f, (_, s) in zip(found, texts, strict=True) if s)
    assert exact / sum(bool(s) for _, s in texts) > 0.8
    several = [t[b:e] for f, (t, _) in zip(found, texts, strict=True) for b, e in f if not t[b:e].isalnum()]
    assert len(several) > 100 and not any(" " in s for s in several)  # spans of many tokens, begin and inside


@pytest.mark.parametrize("secret", ["hunter7", "correcthorsebattery", "ABCDEFGHIJKLMNOP", "swordfish", "pa55wd!"])
def test_crf_finds_plain_passwords(chain, secret):
    text = f"they wrote it down as password: {secret} and left"
    assert secrets.model_spans(pa.array([text]), chain) == [[(text.index(secret), text.index(secret) + len(secret))]]


def test_crf_leaves_documents_alone(spark, sf_dir):
    """The documents have no other secrets than those of the fixed patterns."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    model = secrets.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = secrets.model_spans(pa.array(texts), model)
    added = 0
    for text, spans in zip(texts, found, strict=True):
        base = secrets.base_spans(text or "")
        added += len(secrets.all_spans(base, spans)) - len(base)
    assert added <= 2


def _best(score, steps):
    n, every = len(score), [()]
    for _ in range(n):
        every = [(*t, y) for t in every for y in range(3)]

    def total(tags):
        last, out = secrets.OUTSIDE, 0.0
        for i, t in enumerate(tags):
            if t == secrets.INSIDE and last == secrets.OUTSIDE:
                return -1e8
            out += score[i, t] + steps[last][t]
            last = t
        return out

    return total, max(map(total, every))


def test_viterbi_is_exact():
    r = np.random.default_rng(3)
    for _ in range(300):
        first = np.cumsum([0, *r.integers(0, 6, 3)])
        score, model = r.normal(0, 2, (first[-1], 3)), secrets.Model(np.zeros((0, 2)), r.normal(0, 1, (3, 3)))
        score[r.random(len(score)) < 0.3, 0] += 8  # some are surely outside
        score[r.random(len(score)) < 0.2, secrets.INSIDE] = secrets.NEVER
        for prune in (True, False):
            tags = model.tags(score, first, prune)
            for b, e in zip(first[:-1], first[1:], strict=True):
                total, best = _best(score[b:e], model.steps)
                assert abs(total(tags[b:e]) - best) < 1e-6


def test_pruning_changes_nothing_in_texts(docs, chain):
    texts = [r.text or "" for r in docs.collect()] + [t for t, _ in heldout.cases(200, seed=6)]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    tokens = secrets.Tokens(np.frombuffer(b"".join(raw), np.uint8), at)
    score = chain.scores(tokens, secrets.file_kind(tokens.data, tokens.at))
    assert (chain.tags(score, tokens.first) == chain.tags(score, tokens.first, prune=False)).all()
    assert 0 < chain.certain(score).mean() < 1
    one = [secrets.Tokens(np.frombuffer(x, np.uint8), np.array([0, len(x)])) for x in raw]  # a batch is its texts
    alone = np.concatenate([chain.scores(t, secrets.file_kind(t.data, t.at)) for t in one])
    assert np.allclose(score, alone)


def test_tokens():
    raw = "a_b é1 ==x".encode()
    tokens = secrets.Tokens(np.frombuffer(raw, np.uint8), np.array([0, 3, 3, len(raw)]))
    assert [raw[b:e].decode() for b, e in zip(tokens.begin, tokens.end, strict=True)] == ["a", "_", "b", "é1", "=", "=", "x"]
    assert tokens.first.tolist() == [0, 3, 3, 7] and tokens.joined.tolist() == [False, True, True, False, False, True, True]


def test_counts_of_very_long_tokens():
    data = np.frombuffer(b"aB1e.", np.uint8).repeat(500_000)
    turn = np.arange(len(data)) % 3 == 0
    b, e = np.array([0, 5]), np.array([len(data), 600_000])
    wide, narrow = secrets._counter(data, turn)(b, e), secrets._counter(data, turn)(b[1:], e[1:])
    assert [x[0] for x in wide[:3]] == [1_000_000, 500_000, 500_000] and [x[1] for x in wide] == [x[0] for x in narrow]


def test_crf_gradient():
    codes, tags, tokens = secrets.encoded(secrets.made_up(40))
    used, small = np.unique(codes, return_inverse=True)
    k = len(used)
    fun = secrets.likelihood(small.reshape(codes.shape), tags, tokens.joined, np.unique(tokens.first), k, 0.05)
    x = np.random.default_rng(0).normal(size=2 * k + 9) * 0.1
    grad = fun(x)[1]
    for i in [*range(0, len(x), max(1, len(x) // 25)), *range(len(x) - 9, len(x))]:
        e = np.zeros(len(x))
        e[i] = 1e-5
        assert abs((fun(x + e)[0] - fun(x - e)[0]) / 2e-5 - grad[i]) < 1e-3


def test_redaction(spark, chain):
    df = spark.createDataFrame([(1, 'a token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" b'), (2, None), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redacted(df, model=chain).collect()}
    assert got == {1: 'a [SECRET]" b', 2: None, 3: "nothing"}


# --- repeated strings ------------------------------------------------------------------------------------------


def _dedup(spark, df):
    texts, ranges = suffixes.deduplicated(df, Scratch(spark, "t"))
    cut = suffixes.F.arrow_udf(suffixes._cut, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string>")
    return sorted((tuple(r) for r in texts.join(ranges, "rid", "left").select("doc_id", cut("text", "got").alias("x")).select("doc_id", "x.*").collect()), key=str)


def test_suffix_dedup(spark):
    df = fixtures.docs(spark)
    assert _dedup(spark, df) == sorted(brute.repeats([(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]), key=str)


def test_suffix_dedup_repeated_ids_and_empty(spark, docs):
    assert Counter(_dedup(spark, docs)) == Counter(brute.repeats(sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or ""))))
    assert _dedup(spark, fixtures.empty(spark)) == []


def test_suffix_dedup_many_shares(spark, monkeypatch):
    r = random.Random(8)
    shared = fixtures.prose(r, 45)
    rows = [(i, f"{fixtures.prose(r, r.randint(0, 25))} {shared} {fixtures.prose(r, 20)}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 2000)
    assert _dedup(spark, df) == sorted(brute.repeats(rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=2, max_size=12))
def test_merged_transforms_give_sorted_repeats(strings):
    strings = [bytes(b % 3 for b in s) for s in strings]
    arrays, half = [np.frombuffer(s, np.uint8) for s in strings], len(strings) // 2
    a, b = suffixes.Transform(arrays[:half], range(half), 4), suffixes.Transform(arrays[half:], range(half, len(arrays)), 4)
    for t in (a, b):
        order = [strings[o][p:] for o, p in zip(t.string, t.place, strict=True)]
        assert order == sorted(order)
    rows, interval = suffixes.merge(a, b, 3)
    owner, place = np.concatenate([a.string, b.string])[rows], np.concatenate([a.place, b.place])[rows]
    heads = [strings[o][p : p + 12] for o, p in zip(owner, place, strict=True)]
    want = Counter(s[p : p + 12] for s in strings for p in range(len(s) - 11))
    assert heads == sorted(h for h, n in want.items() if n > 1 for _ in range(n))
    assert all((interval[i] == interval[i - 1]) == (heads[i] == heads[i - 1]) for i in range(1, len(heads)))


# --- chats -----------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, speaker string, masks int"


def test_perspectives(spark):
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "é😀"), (2, 0, "system", "alone"), (3, 0, "ann", "x"), (3, 0, "ann", "x"), (None, 1, "bob", "y"), (None, None, "ann", "")]
    got = perspectives.perspectives(spark.createDataFrame([(*r, "s", 1) for r in rows], TURNS)).collect()
    assert sorted(((r.conv_id, r.speaker, r.text, r.masks) for r in got), key=str) == brute.perspectives(rows)
    assert perspectives.perspectives(spark.createDataFrame([], TURNS)).count() == 0


def test_perspectives_parts(spark):
    rows = [(1, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(1200)]
    got = perspectives.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("speaker", "part").collect()
    assert [r.part for r in got] == [0, 1, 2] * 2 and [r.n_turns for r in got] == [512, 512, 176] * 2
    whole = {(s, t) for _, s, t, _ in brute.perspectives(rows)}
    assert {(s, "".join(r.text for r in got if r.speaker == s)) for s in ("ann", "bob")} == whole
    assert got[1].begin == len(got[0].text) and got[2].begin == len(got[0].text) + len(got[1].text)


def test_perspectives_of_long_and_short_dialogues(spark, monkeypatch):
    """Parts of one speaker's view follow each other, whoever speaks in them; lookups are salted."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = [(1, i, ("ann", "b<|b", "cé", "system")[i % 4 if i < 600 else 1], "é<|" * (i % 3)) for i in range(1100)]
    rows += [(2, 700, "ann", "late"), (None, 5, "ann", "x"), (None, 5000, None, "y")]
    got = perspectives.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    views = {}
    for r in sorted(got, key=lambda r: r.part):
        before = views.setdefault((r.conv_id, r.speaker), [])
        assert (r.part, r.begin) == (len(before), sum(map(len, before)))
        before.append(r.text)
    assert sorted(((k, s, "".join(t)) for (k, s), t in views.items()), key=str) == brute_views(rows)


def brute_views(rows):
    def head(name, speaker):
        return "<|assistant|>" if name == speaker else "<|system|>" if name == "system" else f"<|user:{safe(name)}|>"

    safe = lambda x: x.replace("<|", "<\\|")
    out = []
    for k in {r[0] for r in rows}:
        turns = sorted((t, n or "unknown", x) for c, t, n, x in rows if c == k)
        for speaker in {n for _, n, _ in turns} - {"system"}:
            out.append((k, speaker, "".join(f"{head(n, speaker)}\n{safe(x)}<|end|>\n" for _, n, x in turns)))
    return sorted(out, key=str)


def test_perspectives_sql(spark, sf_dir):
    assert compare(perspectives.op5_perspective_rotation(spark, sf_dir), connect(sf_dir), perspectives.OP5_SQL) == ""


# --- packing ---------------------------------------------------------------------------------------------------


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(docs, Scratch(spark, "t"), packing.vocabulary(), size=128, open_bins=4).collect()
    ids = Counter()
    for r in docs.collect():
        own = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(own), 128)):
            cut = own[at : at + 128]
            ids[r.doc_id, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == ids
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= sum(r.length for r in got) / 128 * 1.1 + 2
    assert packing.pack(fixtures.empty(spark), Scratch(spark, "t"), packing.vocabulary()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_best_fit(lengths, most):
    bins, places, used = packing.BestFit(50, most), defaultdict(int), {}
    for n in lengths:
        free = {b: 50 - u for b, u in used.items()}
        b, offset = bins.place(n)
        fits = [f for f in free.values() if f >= n]
        if fits:
            assert free[b] == min(fits)
        else:
            assert offset == 0 and b not in places
        assert offset == places[b]
        places[b] += n
        used = dict(bins.unfinished())
        assert len(used) <= most and all(places[x] == u for x, u in used.items())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB.'s,é×÷É<|>#1٣’ \t\x1c ́ßΣσ€ İ…tŉｶﾞ", max_size=20))
def test_word_cache_is_exact(text):
    encoder = packing.encoder_of(packing.vocabulary())
    assert encoder.ids(text) == np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(0xC0, 0x250)] + list("abcXYZ"), min_size=1, max_size=8))
def test_words_of_letters_are_exact(text):
    encoder = packing.encoder_of(packing.vocabulary())
    assert encoder.ids(text) == np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_every_two_byte_letter_is_exact():
    encoder = packing.encoder_of(packing.vocabulary())
    for c in range(0xC0, 0x280):
        for text in (chr(c), f"a{chr(c)}", f"{chr(c)}{chr(c)}b.", f"x{chr(c)}, y"):
            assert encoder.ids(text) == np.array([*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4").tobytes(), hex(c)


# --- near duplicates -------------------------------------------------------------------------------------------


def test_jaccard(spark):
    df = fixtures.docs(spark)
    want = brute.components({r.doc_id: r.text for r in df.collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, Scratch(spark, "t")).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_jaccard_repeated_and_empty(spark, docs):
    got = jaccard.jaccard_components(docs, Scratch(spark, "t")).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.doc_id is None} == {6}  # the document with the same words
    assert jaccard.jaccard_components(fixtures.empty(spark), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("light,block", [(0, 1 << 18), (16, 1 << 18), (4, 300)])
def test_jaccard_many_near_copies(spark, monkeypatch, light, block):
    r, rows = random.Random(11), []
    for size in (3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 22, 40, 190, 260, 340, 400):
        base = fixtures.prose(r, size + 4).split()
        for _ in range(6):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 12))):
                w[r.randrange(len(w))] = r.choice(["new", "other"]) + str(r.randint(0, 9))
            rows.append((len(rows), " ".join(w[r.randint(0, 2) :])))
    monkeypatch.setattr(jaccard, "light_limit", lambda mean: light)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard, "PAIR_SHINGLES", block)
    monkeypatch.setattr(jaccard, "HUBS", 2)
    monkeypatch.setattr(jaccard, "NAMED_FROM", 2)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    assert got == brute.components(dict(rows))


@pytest.mark.parametrize("below", [1 << 58, 1 << 62])
def test_jaccard_of_large_sets_with_few_low_hashes(spark, monkeypatch, below):
    """Where the shingles that come first are too few for a set's lists, the others follow: nothing is lost."""
    r, rows = random.Random(12), []
    for size in (180, 200, 256, 300, 420):
        base = fixtures.prose(r, size + 4).split()
        for _ in range(4):
            w = list(base)
            for at in r.sample(range(len(w)), r.randint(0, max(1, size // 60))):
                w[at] = f"new{r.randint(0, 999)}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(jaccard, "LOWER_HALF", below)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()}
    want = brute.components(dict(rows))
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_light_limit_moves_with_list_lengths():
    limits = [jaccard.light_limit(m) for m in (0.5, 2, 10, 100, 1e4, 1e9)]
    assert limits == sorted(limits) and limits[0] < 4 < limits[-2] and limits[-1] == jaccard.most_light()


def test_subset_sizes_find_all_links():
    for a in range(1, 17):
        for b in range(a, 17):
            for common in range(1, a + 1):
                if jaccard.linked(common, a, b):
                    assert any(c <= common for c in set(jaccard.subset_sizes(a)) & set(jaccard.subset_sizes(b)))


def test_components_of_paths(spark):
    from spanweave.llm.components import components

    r = random.Random(4)
    names = r.sample(range(-1000, 1000), 200)
    edges = [(names[i], names[i + 1]) for i in range(199) if i % 50 != 49]
    got = {x.u: x.root for x in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()}
    for g in range(4):
        part = names[50 * g : 50 * g + 50]
        assert {got.get(n, n) for n in part} == {min(part)}


# --- decontamination -------------------------------------------------------------------------------------------


def _items(spark, texts):
    rows = [(0, texts[7][:200]), (1, " ".join(texts[12].split()[28:45])), (10, "a b c"), (2, ""), (3, None), (None, texts[8]), (1, "TWO Words"), (5, "nothing like it at all, to be sure of ten words")]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_winnow(spark, docs, monkeypatch, block):
    monkeypatch.setattr(winnow, "BLOCK_BYTES", block)
    benchmark, items = _items(spark, fixtures.texts())
    found = winnow.found(docs, benchmark, "__w", Scratch(spark, "t"))
    got = [(r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[2] > 0) for r in found.select("doc_id", "__w.n_words", winnow.n_hit("__w"), "__w.items").collect()]
    want = brute.contamination([(r.doc_id, r.text) for r in docs.collect()], items)
    assert Counter(got) == Counter(want) and any(w[5] for w in want)


def test_winnow_empty(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n for r in winnow.found(docs, none, "__w", Scratch(spark, "t")).selectExpr("size(__w.hits) AS n").collect()} == {0}
    assert winnow.found(fixtures.empty(spark), none, "__w", Scratch(spark, "t")).count() == 0


# --- archives --------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(1)
    big = "".join(chr(r.randint(32, 0x2FF)) for _ in range(90_000))
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "é" * 60, "é" * 60, big, big, big + "!", "\r\n0\r\n\r\n" * 2000, "WARC/1.1\r\n\r\n" * 20]
    rows = [(i, ["http://a/\r\nX: y", None][i % 2], h, "z", None) for i, h in enumerate(html)] + [(4, "u", "y" * 100, "", None), (None, "u", "y" * 100, "", None), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string, ok int")
    archives = warc.write_archives(pages, segment=7000)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows) and all(x.ok for x in got)
    first = {}
    for i, _, h, *_ in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        first.setdefault(h or "", i)
    want = Counter()
    for i, _, h, *_ in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and first[h or ""] != i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    number = lambda x: int(x.split("#")[0].removeprefix("urn:page:")) if x and x.split("#")[0] != "urn:page:" else None
    assert Counter((number(x.name), x.n, x.sha256, x.kind, number(x.refers_to)) for x in got) == want
    for i, a in enumerate(archives.collect()):
        (tmp_path / f"{i}.warc.gz").write_bytes(bytes(a.data))
    assert warc.read_archives(warc.archives_from_files(spark, f"{tmp_path}/*.warc.gz")).count() == len(rows)
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], pages.schema))).count() == 0


def test_warc_damage(spark):
    parts = warc.page_records("urn:page:1", "u", b"z" * 50_000, hashlib.sha256(b"z" * 50_000).hexdigest(), None, 9000)
    df = lambda keep: spark.createDataFrame([(bytearray(b"".join(keep)),)], "data binary")
    assert [r.ok for r in warc.read_archives(df(parts[::-1])).collect()] == [True]
    assert [r.ok for r in warc.read_archives(df(parts[:2] + parts[3:])).collect()] == [False]
    assert [r.ok for r in warc.read_archives(df(parts[:-1])).collect()] == [False]


def test_warc_segmented_revisit(spark):
    whole = warc.page_records("urn:page:9", "u", b"z" * 500, "d" * 64, "urn:page:4", 10**6)[0]
    head, _, block = whole.partition(b"\r\n\r\n")
    block = block[:-4]
    fields = {"target_uri": "u", "payload_digest": "sha256:" + "d" * 64}
    parts = [
        warc.record("revisit", "urn:page:9", block[:20], **fields, segment_number=1, refers_to="<urn:page:4>"),
        warc.record("continuation", "urn:page:9:2", block[20:], target_uri="u", segment_number=2, segment_origin_id="<urn:page:9>", segment_total_length=len(block)),
    ]
    got = warc.read_archives(spark.createDataFrame([(bytearray(b"".join(parts)),)], "data binary")).collect()
    assert [(r.name, r.kind, r.refers_to, r.n, r.sha256, r.ok) for r in got] == [("urn:page:9", "revisit", "urn:page:4", 500, "d" * 64, True)]


def test_archives_are_read_in_linear_time(monkeypatch):
    data = b"".join(gzip.compress(warc.record("response", f"urn:{i}", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * (i % 5000)), mtime=0) for i in range(3000))
    assert [h["warc-record-id"] for h, _ in warc.records(data)] == [f"<urn:{i}>" for i in range(3000)]
    fed = []

    class Reader:
        def __init__(self, bits):
            self.inner = zlib.decompressobj(bits)

        def decompress(self, some):
            fed.append(len(some))
            return self.inner.decompress(some)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(warc, "zlib", type("Z", (), {"decompressobj": Reader}))
    assert len(list(warc.members(data))) == 3000
    assert sum(fed) <= 3000 * 1024 + 3 * len(data)


def test_warc_many_repeated_payloads(spark, monkeypatch):
    from spanweave.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = [(i, "u", f"{i % 3} " + "x" * 200) for i in range(60)] + [(None, "u", "0 " + "x" * 200)] * 3
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(got) == 63 and sum(r.kind == "response" for r in got) == 3 and all(r.ok for r in got)


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(body, size):
    assert warc.unchunked(warc.chunked(body, size)) == body


# --- URLs ------------------------------------------------------------------------------------------------------


def _rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, path = brute.lower(rest[:n]), rest[n:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_rules(spark):
    some = [None, "", "no scheme.org/", "http://Example.ORG", "http://Example.ORG/", "https://a.example.org/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/1", "http://com/de/", "http://notcom/de/", "a://b://c.org/", "http://org", "ftp://u@x.org:80/p?/es/", "http://é.org/#", "http://x.net/\nfr/"]
    got = urls.judged(spark.createDataFrame([(i, u, "v") for i, u in enumerate(some)], "page_id long, url string, verdict string"), "__u").orderBy("page_id").select("__u.*").collect()
    for u, r in zip(some, got, strict=True):
        host, path, rule, verdict = _rule(u)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert verdict is None or r.verdict == verdict
    assert urls.judged(spark.createDataFrame([], "page_id long, url string"), "__u").count() == 0


def test_url_model_held_out(spark):
    r = random.Random(2)
    make = lambda bad: f"http://{''.join(r.choice('xqzj' if bad else 'aeiost') for _ in range(8))}.{'com/de/' if bad else 'com/fr/'}{r.randint(1, 999)}"
    rows = [(i, make(i % 2)) for i in range(1500)]
    rows += [(10_000 + i, make(i % 2).replace("com/de/", "net/").replace("com/fr/", "net/")) for i in range(200)]
    got = {x.page_id: x.verdict for x in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), "__u").selectExpr("page_id", "__u.verdict").collect()}
    right = sum((got[10_000 + i] == "block") == bool(i % 2) for i in range(200))
    assert right > 180


def test_url_model_is_a_distribution():
    tallies = Counter()
    for u in ("abcab", "abba", "cab"):
        tallies.update(u[j : i + 1] for i in range(len(u)) for j in range(max(0, i - urls.ORDER), i + 1))
    model = urls.Model({g: (n, 0) for g, n in tallies.items()})
    for context in ("", "a", "ab", "cab", "zz"):
        assert abs(sum(model.probability(context + chr(c), 0) for c in range(256)) - 1) < 1e-9


def test_url_scores_use_all_grams(spark):
    """Over 150,000 distinct n-grams, of which each counts."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-_é"
    word = lambda n: "".join(r.choice(letters) for _ in range(n))
    rows = [f"http://{word(40)}.com/{'de' if i % 2 else 'fr'}/{word(60)}" for i in range(1200)]
    rows += [u.replace(".com/de/", ".net/").replace(".com/fr/", ".net/") for u in rows[:100]] + ["http://é.net/", "", None, "x"]
    rows += rows[-6:]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    held = {x.url for x in pages.filter(f"pmod(xxhash64(url), {urls.HELD_OUT}) = 0").collect()}
    tallies = Counter(), Counter()
    for u in rows:
        verdict = _rule(u)[3]
        if verdict and u not in held:
            tallies[verdict == "block"].update(u[j : i + 1] for i in range(len(u)) for j in range(max(0, i - urls.ORDER), i + 1))
    model = urls.Model({g: (tallies[0][g], tallies[1][g]) for g in tallies[0] | tallies[1]})
    assert len(model.grams) > 150_000
    got = {x.page_id: x.score for x in urls.judged(pages, "__u").selectExpr("page_id", "__u.score").collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(rows):
        assert got[i] is None if _rule(u)[3] else abs(got[i] - model.score(u)) < 1e-9


# --- shared ----------------------------------------------------------------------------------------------------


@given(st.lists(st.text(max_size=30), max_size=8))
def test_words_and_grams(texts):
    import pyarrow as pa

    data, at = common.utf8(pa.array(texts, pa.string()))
    begins, ends, first = common.words(data[at[0] : at[-1]], at - at[0], ~common.SPACE)
    got = [[bytes(data[b:e]).decode() for b, e in zip(begins[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
    where, owner = common.gram_owner(first, 3, len(begins))
    assert [int((owner == i).sum()) for i in range(len(texts))] == [max(0, len(brute.words(t)) - 2) for t in texts]


def test_lookup_both_ways(spark, monkeypatch):
    large = spark.range(1000).selectExpr("id % 3 AS k", "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    want = sorted(map(tuple, common.lookup(large, small, "k", 2).select("k", "id", "v").collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, common.lookup(large, small, "k", 2).select("k", "id", "v").collect()), key=str) == want
