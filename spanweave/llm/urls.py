r"""URL filters: rules by host and path, and a ratio of character language models for all other URLs.

Rules allow or block hosts (and all their subdomains) under a path; the longest that fits decides. URLs that a
rule decides are the labelled rows. Two variable-order Markov models over characters, of up to ORDER characters
of context, are counted over all of them, of accepted and of rejected ones; probabilities are interpolated from
the longest known context down (Witten-Bell). The score of a URL is the difference of its log-likelihoods,
rejected less accepted, for each character. The threshold is the one with the best balanced accuracy on every
fifth labelled URL (by hash), which the counts leave out.

Scale: one pass counts n-grams within each task and adds them up in partial aggregates; all are kept, as a table
that grows with the input. Each distinct URL that a score is needed of is scored once: probabilities are joined from
the shortest suffix of its n-grams up, where a key has at most as many rows as there are characters, and brought
back to the n-grams of URLs, and scores to pages, by ``lookup`` (salted: n-grams of "http://" are in every URL).
Calibration is a histogram of fixed width. Pages with a rule aren't shuffled: hosts with a third of all pages make
no task larger.

Edge cases: a null URL, or one without "://", has an empty host and path and, as no rule fits it, the model's
verdict; an empty URL scores 0; with no labelled URL of either kind every other URL is allowed; repeated rows
count each; an empty table gives an empty result; further columns pass ``judged`` untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import Scratch, columns_of, freeing, lookup, table, unused

ORDER = 5
#: Distinct n-grams that a task counts before it passes them on, and ratios that ``Model`` remembers.
GATHER = 400_000
#: Calibration: width of a bin of scores, and bins on each side of 0.
BIN, BINS = 0.01, 1000
HELD_OUT = 5

#: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def by_rules(host_: Column, path_: Column, rules=RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Model:
    """Counts of n-grams: {gram: (accepted, rejected)}; a gram is a context and the character after it. This is the
    method for few URLs, in one process; ``scores`` does the same with tables."""

    def __init__(self, grams: dict[str, tuple[int, int]]):
        self.grams = grams
        self.contexts: dict[str, list[int]] = {}
        for g, (a, r) in grams.items():
            c = self.contexts.setdefault(g[:-1], [0, 0, 0, 0])  # both totals, both numbers of successors
            c[0] += a
            c[1] += r
            c[2] += a > 0
            c[3] += r > 0
        self.known: dict[str, float] = {}

    def probability(self, gram: str, which: int) -> float:
        p = 1 / 256
        for k in range(len(gram) - 1, -1, -1):
            c = self.contexts.get(gram[k:-1])
            if c is None or not c[which]:
                break
            n = self.grams.get(gram[k:], (0, 0))[which]
            p = (n + c[2 + which] * p) / (c[which] + c[2 + which])
        return p

    def ratio(self, gram: str) -> float:
        found = self.known.get(gram)
        if found is None:
            if len(self.known) >= GATHER:
                self.known.clear()
            found = self.known[gram] = log(self.probability(gram, 1)) - log(self.probability(gram, 0))
        return found

    def score(self, url: str | None) -> float:
        if not url:
            return 0.0
        return sum(self.ratio(url[max(0, i - ORDER) : i + 1]) for i in range(len(url))) / len(url)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: tuple[Counter, Counter] = Counter(), Counter()

    def done() -> pa.RecordBatch:
        keys = list(tallies[0].keys() | tallies[1].keys())
        out = pa.RecordBatch.from_pydict({"gram": pa.array(keys, pa.string()), "a": pa.array([tallies[0][k] for k in keys], pa.int64()), "r": pa.array([tallies[1][k] for k in keys], pa.int64())})
        tallies[0].clear(), tallies[1].clear()
        return out

    for batch in batches:
        for url, blocked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tallies[blocked].update(url[j : i + 1] for i in range(len(url)) for j in range(max(0, i - ORDER), i + 1))
            if len(tallies[0]) + len(tallies[1]) > GATHER:
                yield done()
    yield done()


def counted(labelled: DataFrame) -> DataFrame:
    """All n-grams of (url, blocked) rows with their counts: (gram, a, r)."""
    tallied = labelled.select("url", "blocked").mapInArrow(*freeing(_count, "gram string, a bigint, r bigint"))
    return tallied.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram that ends at each character of a URL, with its number."""
    for batch in batches:
        ids, grams, ns = [], [], []
        for at, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Counter(url[max(0, i - ORDER) : i + 1] for i in range(len(url)))
            ids += [at] * len(found)
            grams += found.keys()
            ns += found.values()
            if len(ids) > GATHER:
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "gram": pa.array(grams, pa.string()), "n": pa.array(ns, pa.int64())})
                ids, grams, ns = [], [], []
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "gram": pa.array(grams, pa.string()), "n": pa.array(ns, pa.int64())})


def ratios(grams: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, ratio) of distinct n-grams: log of the rejected model's probability less that of the accepted one."""
    suffixes = grams.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("gram")), lambda k: F.right("gram", k))).alias("gram")).distinct()
    context = F.expr("left(gram, length(gram) - 1)")
    totals = counts.groupBy(context.alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"), F.count_if(F.col("a") > 0).alias("na"), F.count_if(F.col("r") > 0).alias("nr"))
    # a context has at most as many rows as there are characters, on both sides
    known = suffixes.join(counts, "gram", "left").withColumn("context", context).join(totals, "context", "left")
    known = scratch.keep(known.select("gram", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("a", "r", "ca", "cr", "na", "nr"))), "known")

    def mixed(n: str, of: str, kinds: str, shorter: Column) -> Column:
        return F.when(F.col(of) > 0, (F.col(n) + F.col(kinds) * shorter) / (F.col(of) + F.col(kinds))).otherwise(shorter)

    levels: list[DataFrame] = []
    for k in range(1, ORDER + 2):
        level = known.filter(F.length("gram") == k)
        if levels:
            level = level.withColumn("__s", F.expr("right(gram, length(gram) - 1)")).join(levels[-1].select(F.col("gram").alias("__s"), F.col("pa").alias("__a"), F.col("pr").alias("__r")), "__s")
        else:
            level = level.withColumn("__a", F.lit(1 / 256)).withColumn("__r", F.lit(1 / 256))
        level = level.select("gram", mixed("a", "ca", "na", F.col("__a")).alias("pa"), mixed("r", "cr", "nr", F.col("__r")).alias("pr"))
        levels.append(scratch.keep(level, f"level{k}"))
    return reduce(DataFrame.union, levels).select("gram", (F.log("pr") - F.log("pa")).alias("ratio"))


def scores(urls: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``urls`` (distinct url, not empty, and more columns) with a score, written to ``scratch``. Rounded, as sums
    depend on the order of their rows."""
    numbered = scratch.keep(urls.withColumn("id", F.monotonically_increasing_id()), "urls")
    grams = scratch.keep(numbered.select("id", "url").mapInArrow(*freeing(_grams, "id bigint, gram string, n bigint")), "grams")
    ratio = ratios(grams.select("gram").distinct(), counts, scratch)
    ratio = scratch.keep(grams.select("gram").distinct().join(ratio, "gram"), "ratios")
    each = lookup(grams, ratio, "gram", ratio.count())
    scored = each.groupBy("id").agg(F.round(F.sum(F.col("n") * F.col("ratio")) / F.sum("n"), 12).alias("score"))
    return scratch.keep(numbered.join(scored, "id").drop("id"), "scores")


def threshold(scored: DataFrame) -> float:
    """The bin edge with the best balanced accuracy on (score, blocked, n) rows, n being how many there are of each;
    the middle of equal ones."""
    at = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-BINS)), F.lit(BINS)).cast("int")
    counts: dict[int, list[int]] = {}
    for r in scored.groupBy(at.alias("at"), "blocked").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["at"], [0, 0])[r["blocked"]] = r["n"]
    total = [sum(c[k] for c in counts.values()) for k in (0, 1)]
    if not all(total):
        return 0.0
    best, good, below = -1.0, [], [0, 0]
    for b in range(-BINS, BINS + 2):  # blocked from bin b on
        value = below[0] / total[0] + (total[1] - below[1]) / total[1]
        if value > best + 1e-12:
            best, good = value, [b]
        elif value > best - 1e-12:
            good.append(b)
        below = [below[k] + counts.get(b, [0, 0])[k] for k in (0, 1)]
    return good[len(good) // 2] * BIN


def judged(pages: DataFrame, into: str, rules=RULES) -> DataFrame:
    """``pages`` with a struct of host, path, rule, verdict and score (null where a rule decides)."""
    url = F.col("url").cast("string")
    ruled = pages.withColumn(into, F.struct(host(url).alias("host"), path(url).alias("path")))
    ruled = ruled.withColumn(into, F.struct(f"{into}.*", by_rules(F.col(f"{into}.host"), F.col(f"{into}.path"), rules).alias("by")))
    labelled = ruled.filter(F.col(f"{into}.by").isNotNull()).select(url.alias("url"), (F.col(f"{into}.by.verdict") == "block").cast("int").alias("blocked"))
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    scratch = Scratch(pages.sparkSession, "urls")
    score_, key = unused(ruled, "score"), unused(ruled, "url")
    counts = scratch.keep(counted(labelled.filter(~held)), "counts")
    both = counts.agg(F.max("a").alias("a"), F.max("r").alias("r")).first()
    open_ = F.col(f"{into}.by").isNull()
    if not both["a"] or not both["r"]:  # one kind is missing
        scored, above = ruled.withColumn(score_, F.lit(None).cast("double")), F.lit(False)
    else:
        rows = labelled.filter(held).unionByName(ruled.filter(open_).select(url.alias("url"), F.lit(None).cast("int").alias("blocked")))
        distinct = rows.filter(F.length("url") > 0).groupBy("url", "blocked").agg(F.count("*").alias("n"))
        found = scores(distinct, counts, scratch)
        limit = threshold(found.filter("blocked IS NOT NULL"))
        of = found.filter("blocked IS NULL").select(F.col("url").alias(key), F.col("score").alias(score_))
        asked = open_ & F.coalesce(F.length(url) > 0, F.lit(False))  # a null URL scores 0
        rest = ruled.filter(~asked).withColumn(score_, F.when(open_, F.lit(0.0)))
        joined = lookup(ruled.filter(asked).withColumn(key, url), of, key, of.count()).drop(key)
        scored, above = joined.select(*columns_of(ruled), score_).unionByName(rest), F.col(score_) >= limit
    verdict = F.coalesce(F.col(f"{into}.by.verdict"), F.when(above, "block").otherwise("allow"))
    return scored.withColumn(into, F.struct(f"{into}.host", f"{into}.path", F.col(f"{into}.by.rule").alias("rule"), verdict.alias("verdict"), F.col(score_).alias("score"))).drop(score_)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, "__u").select("page_id", "__u.host", "__u.path", "__u.rule", "__u.verdict", "__u.score")
