r"""Benchmark decontamination by winnowing.

Texts become lower-case words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. Of every SPAN consecutive words, the least
hash of their K-word grams is the fingerprint, so that each shared span of SPAN words gives the same fingerprint
on either side. Fingerprints of documents are joined with those of the benchmark, and each hit is extended to
the whole span and compared. An item of fewer than SPAN words is one shorter window, whose gram is its own
fingerprint.

Scale: documents are read once, in place, with no shuffle: rows keep all their columns and get one struct. The
benchmark goes to the tasks in blocks of whole items of about BLOCK_BYTES of text, counted before; a larger
benchmark takes more blocks, each adding its hits to those of the blocks before it.

Edge cases: null or empty texts have no words, no hits and are clean; items without words or without an id
match nothing; repeated documents are judged one by one, items with one id count once; empty tables on either
side give clean documents or an empty result; columns of any other name pass untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import ALNUM, LOWER, Prefix, Scratch, chunks, gram_owner, grams, table, trim, utf8, words

SPAN = 10
K = 5
BLOCK_BYTES = 32 << 20
#: Blocks that one task holds at once; after so many the documents are written and read again.
BLOCKS_AT_ONCE = 4

_ACC = "struct<n_words:bigint,hits:array<struct<b:int,e:int>>,items:array<string>>"
_RANGE = pa.struct([("b", pa.int32()), ("e", pa.int32())])
_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(_RANGE)), ("items", pa.list_(pa.string()))])


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    begins, ends, first = words(data, at, ALNUM)
    return Prefix(data).ranges(begins, ends), first


def _least(h: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The least K-gram hash of the window of SPAN words at each position of ``where``."""
    g = grams(h, K)
    out = g[where] if len(where) else np.empty(0, np.uint64)
    for j in range(1, SPAN - K + 1):
        out = np.minimum(out, g[where + j])
    return out


class Index:
    """Windows of a block of items: for each length, sorted hashes with the ids of their items; and the sorted
    fingerprints of the windows of full length."""

    def __init__(self, ids: list[str], texts: list[str]):
        data, at = utf8(pa.array(texts, pa.large_string()))
        h, first = _hashed(data[at[0] : at[-1]], at - at[0])
        count = np.diff(first)
        self.ids = np.array(ids, object)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.fingerprints = np.empty(0, np.uint64)
        for n in sorted({min(SPAN, int(c)) for c in count if c}):
            where, owner = gram_owner(first, n, len(h))
            mine = count[owner] >= SPAN if n == SPAN else count[owner] == n
            where, owner = where[mine], owner[mine]
            pairs = np.unique(np.rec.fromarrays([grams(h, n)[where], owner], names="h,o"))
            self.windows[n] = pairs.h.copy(), pairs.o.copy()
            if n == SPAN:
                self.fingerprints = np.unique(_least(h, where))

    def find(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """Words of each text, ranges of hit words, ids of items hit."""
        h, first = _hashed(data, at)
        n = len(at) - 1
        hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        for length, (known, owners) in self.windows.items():
            where, owner = gram_owner(first, length, len(h))
            if length == SPAN:
                least = _least(h, where)
                if not len(least):
                    continue
                new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))  # a fingerprint serves a run of windows
                joined = np.repeat(_member(self.fingerprints, least[new]), np.diff(np.append(new, len(least))))
                where, owner = where[joined], owner[joined]
            g = _grams_at(h, where, length)
            same = _member(known, g)
            for p, o, x in zip(where[same].tolist(), owner[same].tolist(), g[same], strict=True):
                p -= int(first[o])
                hits[o].append((p, p + length))
                lo, hi = np.searchsorted(known, x), np.searchsorted(known, x, side="right")
                items[o].update(self.ids[owners[lo:hi]])
        return np.diff(first), hits, items


def _grams_at(h: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    if not len(where):
        return np.empty(0, np.uint64)
    return grams_of_columns([h[where + j] for j in range(k)])


def grams_of_columns(columns: list[np.ndarray]) -> np.ndarray:
    """As ``grams``, of words given by place."""
    return grams(np.stack(columns, axis=1).reshape(-1), len(columns))[:: len(columns)]


def _member(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(ranges):
        if out and b <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _lists(values: list[list], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = [x for v in values for x in v]
    if kind == _RANGE:
        flat_array = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], pa.int32()) for i in (0, 1)], fields=list(_RANGE))
    else:
        flat_array = pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat_array)


def _adder(index: Index):
    """A function that adds the hits of one block to those found before."""

    @F.arrow_udf(_ACC)
    def add(texts: pa.Array, before: pa.Array) -> pa.Array:
        data, at = utf8(texts)
        counts, hits, items = [], [], []
        for i, j in chunks(at):
            c, h, s = index.find(data[at[i] : at[j]], at[i : j + 1] - at[i])
            counts.append(c), hits.extend(h), items.extend(s)
        for i, old in enumerate(before.to_pylist() if before.null_count < len(before) else ()):
            if old:
                hits[i] += [(r["b"], r["e"]) for r in old["hits"]]
                items[i] |= set(old["items"])
        trim()
        count = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(count), _lists([merged(r) for r in hits], _RANGE), _lists([sorted(s) for s in items], pa.string())], fields=list(_TYPE))

    return add


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect() if n > 1 else items.collect()
        yield Index([r.i for r in rows], [r.t for r in rows])


def found(docs: DataFrame, benchmark: DataFrame, into: str, scratch: Scratch) -> DataFrame:
    """``docs`` with a struct of n_words, hits (ranges of word numbers, end exclusive) and items (sorted ids)."""
    out = docs.withColumn(into, F.lit(None).cast(_ACC))
    for b, index in enumerate(_blocks(benchmark)):
        if b and b % BLOCKS_AT_ONCE == 0:
            out = scratch.keep(out, f"blocks{b}")
        out = out.withColumn(into, _adder(index)(F.col("text").cast("string"), F.col(into)))
    return out


def n_hit(into: str) -> Column:
    return F.aggregate(F.col(f"{into}.hits"), F.lit(0).cast("long"), lambda s, r: s + (r["e"] - r["b"]))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = found(docs, table(spark, sf_dir, "benchmark"), "__w", Scratch(spark, "winnow"))
    hit = n_hit("__w")
    return judged.select("doc_id", "__w.n_words", hit.alias("n_hit"), F.size("__w.items").cast("long").alias("n_items"), F.sha2(F.array_join("__w.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
