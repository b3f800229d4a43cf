r"""Quality rules with host verdicts.

Rule failures of documents are counted for each host (``source``; null is a host of its own). A host's failure
rate is shrunk towards the mean of all hosts by an empirical beta prior (method of moments over all hosts), so
that a host with few documents is judged by the corpus and one with many by its own. A host whose shrunk rate
exceeds ``max_rate`` is rejected, and with it all of its documents.

Scale: one pass over the texts gives a few numbers for each document, written once; hosts come from a partial
aggregate, so that a host with a third of all documents costs each task one row; verdicts of rejected hosts go
back by a broadcast of counted size or else by a salted join. Nothing is sampled, no text is cut.

Edge cases: a null or empty text has no words and fails the base rules; repeated rows are judged one by one and
count each for the host; an empty table gives an empty result; further columns of any name pass ``judge``
untouched (its own are one struct named by ``into``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import SPACE, Prefix, Scratch, chunks, distinct_per_text, gram_owner, grams, lookup, mix, per_text, table, trim, unused, utf8, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_COUNT_PERCENT = 30
#: Shrunk failure rate above which a host is rejected.
MAX_HOST_RATE = 0.8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SCHEMA = ", ".join(f"{m} bigint" for m in MEASURES)
_TYPE = pa.struct([(m, pa.int64()) for m in MEASURES])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _measure_chunk(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    n = len(at) - 1
    begins, ends, first = words(data, at, SPACE == False)  # noqa: E712
    count = np.diff(first)
    chars = per_text(~SPACE[data] & ((data & 0xC0) != 0x80), at)
    symbols = per_text(_SYMBOL[data], at)
    prefix = Prefix(data)
    # lines that have a word: they end at a newline or with the text
    breaks = np.flatnonzero(data == 0x0A)
    line_end = np.sort(np.concatenate([breaks, at[1:]]))
    line_begin = np.sort(np.concatenate([at[:-1], breaks + 1]))
    has_word = np.searchsorted(begins, line_end) > np.searchsorted(begins, line_begin)
    line_begin, line_end = line_begin[has_word], line_end[has_word]
    line_owner = np.searchsorted(at, line_begin, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    dup_lines = lines - distinct_per_text(line_owner, prefix.ranges(line_begin, line_end), n)
    # words in 3-word windows that the text has twice or more
    repeated = np.zeros(len(begins) + 2, bool)
    where, owner = gram_owner(first, 3, len(begins))
    if len(where):
        h = mix(grams(prefix.ranges(begins, ends), 3)[where] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for j in range(3):
            repeated[where[twice] + j] = True
    return [count, chars, symbols, dup_lines, per_text(repeated[: len(begins)], first), lines]


def measure(texts: pa.Array) -> pa.Array:
    """The MEASURES of each text; see the module for the rules."""
    data, at = utf8(texts)
    parts = [_measure_chunk(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks(at)]
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(x) for x in columns], fields=list(_TYPE))


def measured(docs: DataFrame, into: str) -> DataFrame:
    """``docs`` with a struct of MEASURES; every other column as it was."""

    @F.arrow_udf(f"struct<{', '.join(f'{m}:bigint' for m in MEASURES)}>")
    def of(texts: pa.Array) -> pa.Array:
        found = measure(texts)
        trim()
        return found

    return docs.withColumn(into, of(F.col("text").cast("string")))


def base_failed(q: str):
    return (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{q}.n_words"))


def rule_failed(q: str):
    """A document that counts against its host: the base rules, too many symbols, or too many repeated lines."""
    symbols = 100 * F.col(f"{q}.n_symbols") > MAX_SYMBOL_PERCENT * F.col(f"{q}.word_chars")
    lines = 100 * F.col(f"{q}.n_dup_lines") > MAX_DUP_LINE_COUNT_PERCENT * F.col(f"{q}.n_lines")
    return base_failed(q) | symbols | lines


def host_rates(failures: DataFrame) -> DataFrame:
    """From (host, n, failed) with one row for each host: the shrunk rate. The prior's a and b match mean and
    variance of the hosts' own rates, less the variance that counting alone brings."""
    rate = F.col("failed") / F.col("n")
    moments = failures.agg(F.sum("failed").alias("f"), F.sum("n").alias("t"), F.count("*").alias("k"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("inv")).first()
    mean = min(max((moments.f or 0) / (moments.t or 1), 1e-6), 1 - 1e-6)
    spread = (moments.v or 0.0) - mean * (1 - mean) * (moments.inv or 0.0)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4) if spread > 0 else 1e4
    return failures.withColumn("rate", (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def rejected_hosts(docs: DataFrame, q: str, scratch: Scratch, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(__host, __bad) of rejected hosts, from documents with the struct ``q`` of ``measured``."""
    counted = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(rule_failed(q).cast("long")).alias("failed"))
    bad = host_rates(scratch.keep(counted, "hosts")).filter(F.col("rate") > max_rate)
    return bad.select(_host().alias("__host"), F.lit(True).alias("__bad"))


def _host():
    """A host as a key that is equal for nulls too."""
    return F.to_json(F.struct("source"), {"ignoreNullFields": "false"})


def judge(docs: DataFrame, q: str, scratch: Scratch, rejected: DataFrame) -> DataFrame:
    """``docs``, which must have the struct ``q`` of ``measured``, with that struct widened by base_failed,
    rule_failed, host_rejected and kept."""
    host, is_bad = unused(docs, "host"), unused(docs, "bad")
    rejected = scratch.keep(rejected, "rejected").toDF(host, is_bad)
    joined = lookup(docs.withColumn(host, _host()), rejected, host, rejected.count())
    bad = F.coalesce(is_bad, F.lit(False))
    wide = F.struct(f"{q}.*", base_failed(q).alias("base_failed"), rule_failed(q).alias("rule_failed"), bad.alias("host_rejected"), (~base_failed(q) & ~bad).alias("kept"))
    return joined.withColumn(q, wide).drop(host, is_bad)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    numbers = scratch.keep(measured(docs, "__q").drop("text"), "measures")
    judged = judge(numbers, "__q", scratch, rejected_hosts(numbers, "__q", scratch))
    return judged.select("doc_id", *(f"__q.{m}" for m in MEASURES[:5]), "__q.base_failed", "__q.kept", "__q.rule_failed", "__q.host_rejected")
