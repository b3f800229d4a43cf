"""What the operators of this subpackage share: scratch tables, guarded joins, UTF-8 batches in numpy.

Texts are handled as UTF-8 bytes. A batch of texts is one byte array with an offset for each text, so that
words, n-grams and their hashes come from a few array passes with no loop over words. Hashes have 64 bits
unless said otherwise; two different n-grams of one corpus share one with negligible probability.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.scratch import Scratch as Scratch

#: Rows that a join may broadcast; beyond it the same join is done by a salted shuffle.
BROADCAST_ROWS = 50_000
#: Copies of the small side, and shares of each key of the large side, in a salted join.
SALTS = 16
#: Bytes of text handled at once; only a longer single text makes a larger batch.
CHUNK_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, to be selected from what it has become; names may hold any sign."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


# --- joins and sessions -------------------------------------------------------------------------------------


def lookup(large: DataFrame, small: DataFrame, key: str, rows: int, how: str = "left") -> DataFrame:
    """Join a table whose keys may be very uneven with one that has a row for each key. ``rows`` is the counted
    size of the small side: up to BROADCAST_ROWS it is broadcast, beyond that both sides are salted."""
    if rows <= BROADCAST_ROWS:
        return large.join(F.broadcast(small), key, how)
    salt = unused(large, "salt")
    salted = large.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, salt], how).drop(salt)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give memory that is free back to the system: worker processes live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def freeing(stage: Callable, schema: str) -> tuple[Callable, str]:
    """Arguments for ``mapInArrow``: the stage, trimming when its input ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stage(batches)
        trim()

    return run, schema


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# --- batches of texts ---------------------------------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, CHUNK_BYTES + 1)
        inv = _U(pow(_BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _U(_BASE))]), dtype=_U)
            _INV = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, inv)]), dtype=_U)
    return _POW, _INV


_POW = _INV = np.empty(0, _U)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


class Prefix:
    """Hashes of any byte ranges of an array, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        return mix(h + (end - begin).astype(_U) * _U(0xD6E8FEB86659FD93))


#: Byte classes. SPACE: what separates words in the word rule [^\x20\x09-\x0D]+ .
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ALNUM: bytes of the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ , which is applied after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes with ``inside`` true, runs ending with their text; and for each text
    (and past the last) the index of its first word. ``at`` holds offsets into ``data`` from 0."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    is_in = inside[data]
    begin = is_in.copy()
    begin[1:] &= ~is_in[:-1] | edge[1:n]
    end = is_in
    end = np.concatenate([end[:-1] & (~is_in[1:] | edge[1:n]), end[-1:]]) if n else end
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begins, ends, np.searchsorted(begins, at)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (also across texts: see gram_counts)."""
    m = max(0, len(h) - k + 1)
    out = np.zeros(m, _U)
    for j in range(k):
        out = out * _U(0x9FB21C651E98DF25) + h[j : j + m]
    return mix(out)


def gram_owner(first: np.ndarray, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a k-gram lies within one text, and those texts. first: from ``words``."""
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), np.maximum(count - k + 1, 0))
    base = np.repeat(first[:-1], np.maximum(count - k + 1, 0))
    start = np.concatenate([[0], np.cumsum(np.maximum(count - k + 1, 0))])[:-1]
    return base + np.arange(len(owner)) - np.repeat(start, np.maximum(count - k + 1, 0)), owner


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each range of ``at``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def distinct_per_text(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each of n texts."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    return np.bincount(o[new], minlength=n)


# --- packed arrays ------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one value, for ``unpack`` with their kinds."""
    return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *(a.tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(blob, "<i8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def deal(key: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each of ``parts`` shares of hashes that isn't empty, in order."""
    share = (key % _U(parts)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    edges = np.searchsorted(share[order], np.arange(parts + 1))
    yield from ((b, order[edges[b] : edges[b + 1]]) for b in range(parts) if edges[b + 1] > edges[b])


# --- Bloom filter -------------------------------------------------------------------------------------------

#: Bits, whatever the input: 8 MB in each task. Keys beyond an eighth of them make it let all rows pass.
BLOOM_BITS = 1 << 26


def _bloom_places(keys: np.ndarray) -> np.ndarray:
    h = keys.view(_U)
    return np.stack([mix(h + _U(k)) % _U(BLOOM_BITS) for k in (1, 2)]).astype(np.int64)


def bloom_of(df: DataFrame, key: str) -> np.ndarray | None:
    """Bits of a column of longs, two for each value; None if there are too many for it to hold back much."""
    if df.count() > BLOOM_BITS // 8:
        return None

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bloom_places(batch.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(at >> 6), "bit": pa.array((_U(1) << (at & 63).astype(_U)).view(np.int64))})

    rows = df.select(key).mapInArrow(*freeing(places, "word bigint, bit bigint")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS >> 6, _U)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return out


def bloom_has(bloom: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    may = np.ones(len(keys), bool)
    if bloom is not None:
        for at in _bloom_places(keys):
            may &= (bloom[at >> 6] >> (at & 63).astype(_U)) & _U(1) == 1
    return may


def bloom_test(df: DataFrame, key: str, bloom: np.ndarray | None) -> DataFrame:
    """Rows whose key may be in the filter."""
    if bloom is None:
        return df
    bits = df.sparkSession.sparkContext.broadcast(bloom)

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(bloom_has(bits.value, keys.to_numpy(zero_copy_only=False)))

    return df.filter(may(F.col(key)))
