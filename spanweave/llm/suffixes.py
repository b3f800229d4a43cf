r"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if it lies in a string of SPAN bytes that also starts earlier (in a document of smaller id, or earlier
in the same one). Matches never cross documents.

1. Anchors. Every SPAN consecutive bytes contain the GRAM-byte gram that has the least hash of theirs, wherever
   they occur. So two equal strings have equal anchors at the same place, and only the surroundings of anchors
   that occur twice (a fragment: all strings of SPAN bytes that hold the anchor) need to be looked at.
2. Equal fragments. Of occurrences with an equal anchor and an equal fragment, all but the first are covered as a
   whole. That is settled within each task before anything is dealt, and then once more for each anchor.
3. Different fragments of one anchor. Only one of each kind is left. Blocks of them are cut into two shards; each
   shard's suffixes are sorted once, which gives its transform. Two transforms are merged by refining how their
   rows interleave: each round sorts the rows, stably, by the STRIDE bytes before the suffix, which orders them by
   so many bytes more. Rows that a round first tells apart have a common prefix of what the rounds before it
   compared; rows told apart from all others are settled and leave. Once SPAN bytes are compared, the rows still
   together are the repeated strings. The first place of each such interval stays.
4. Covered ranges of each document are merged and taken out.

Scale: anchors (one for about 35 bytes) are dealt by hash in packed arrays; texts are shuffled once to give
fragments (only those that have any to give; a Bloom filter of fixed size holds back others) and once to be cut.
Blocks have about BLOCK_BYTES. An anchor with more fragments than that is dealt in shares, each a block of its own;
the first places of their strings are then held against each other by a 64-bit hash, dealt by that hash.

Edge cases: a null or empty text has no bytes, and the hash of nothing; documents of less than SPAN bytes stay
whole; rows that repeat an id, or have none, are told apart by id, then text, null last (equal rows: the later are
repeats of the first); an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import Prefix, Scratch, bloom_of, bloom_test, chunks, deal, freeing, mix, pack, shuffle_parts, table, unpack, utf8

SPAN = 100
GRAM = 32
#: Bytes before an anchor that a string of SPAN bytes with it can have.
REACH = SPAN - GRAM
#: Bytes of fragments that are merged at once, as two shards.
BLOCK_BYTES = 1 << 19
#: Bytes by which a round orders further; a divisor of SPAN.
STRIDE = 4
#: Anchors that a task gathers before it deals them.
GATHER = 1 << 19

_U = np.uint64
#: Rows between stages: (bucket, kind, packed).
ANCHORS, RANGES, WANTED, FRAGMENTS, STRINGS = 0, 1, 2, 3, 4
_STAGE = "bucket int, kind int, packed binary"
_ANCHORS = ("<u8", "<u8", "<i8", "<i4", "|u1")  # gram, fragment, document, begin and length of the fragment
_RANGES = ("<i8", "<i4", "<i4")
_WANTED = ("<i8", "<u8", "<i4", "|u1", "<i4")  # document, gram, begin and length, shares of the gram
_FRAGMENTS = ("<u8", "<i8", "<i4", "<i4", "<i4", "|u1")  # gram and share, document, begin, length, shares; bytes
_STRINGS = ("<u8", "<i8", "<i4")  # hash of SPAN bytes, document, place


def _rows(kind: int, dealt: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in dealt], pa.int32()), "kind": pa.array([kind] * len(dealt), pa.int32()), "packed": pa.array([x for _, x in dealt], pa.binary())})


def _dealt(kind: int, key: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    return _rows(kind, [(b, pack(*(c[p] for c in columns))) for b, p in deal(key, parts)])


def _by_doc(doc: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(_U))


def _take(batches: Iterator[pa.RecordBatch], kind: int, columns: tuple[str, ...], passed: list[pa.RecordBatch]) -> list[np.ndarray] | None:
    """The rows of a kind, joined; others are put into ``passed``."""
    found = []
    for batch in batches:
        own = [k == kind for k in batch.column(1).to_pylist()]
        found += [unpack(x.as_py(), *columns) for x, o in zip(batch.column(2), own, strict=True) if o]
        if not all(own):
            passed.append(batch.filter(pa.array([not o for o in own])))
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else None


# --- anchors ------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f (a minimum or maximum) of every n consecutive values, by doubling."""
    width = 1
    while 2 * width <= n:
        x = f(x[:-width], x[width:])
        width *= 2
    return f(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram, fragment, text number, begin of the fragment within the text and its length, of all anchors. An anchor's
    fragment are the strings of SPAN bytes of which it is the least gram (the leftmost, if equal): each string is in
    one fragment, wherever it occurs it is with an equal anchor at the same place."""
    n = len(data)
    if n < SPAN:
        return np.empty(0, _U), np.empty(0, _U), *(np.empty(0, np.int64) for _ in range(3))
    prefix = Prefix(data)
    begin = np.arange(n - GRAM + 1)
    h = prefix.ranges(begin, begin + GRAM)
    least = _slide(h, REACH + 1, np.minimum)  # of each string of SPAN bytes
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = at[1:][owner[: len(least)]] >= begin[: len(least)] + SPAN
    least = np.where(inside, least, _U(0))  # strings across texts have no anchor
    greatest = _slide(np.concatenate([np.zeros(REACH, _U), least, np.zeros(REACH, _U)]), REACH + 1, np.maximum)
    where = np.flatnonzero((greatest[: len(h)] == h) & (h > 0))
    # runs of strings with one least gram, and the places of that gram in each
    heads = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(heads[1:], len(least)) - 1
    heads, ends = heads[least[heads] > 0], ends[least[heads] > 0]
    if not len(heads):
        return np.empty(0, _U), np.empty(0, _U), *(np.empty(0, np.int64) for _ in range(3))
    values, rank = np.unique(h[where], return_inverse=True)
    order = np.lexsort((where, rank))
    key = rank[order] * (n + 1) + where[order]
    mine = np.searchsorted(values, least[heads]) * (n + 1)
    lo, hi = np.searchsorted(key, mine + heads), np.searchsorted(key, mine + ends + REACH, side="right")
    count = hi - lo
    run = np.repeat(np.arange(len(heads)), count)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    place = where[order][lo[run] + nth]
    first = heads[run]
    first[1:] = np.where(nth[1:] > 0, np.maximum(first[1:], place[:-1] + 1), first[1:])
    last = np.minimum(ends[run], place)
    some = first <= last
    place, first, last = place[some], first[some], last[some]
    text = owner[first]
    fragment = mix(prefix.ranges(first, last + SPAN) ^ mix((place - first).astype(_U) + _U(977)))
    return h[place], fragment, text, first - at[:-1][text], last - first + SPAN


def _firsts(gram: np.ndarray, fragment: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by gram, fragment and place; and of its rows, which are the first of their gram and fragment."""
    order = np.lexsort((place, doc, fragment, gram))
    g, f = gram[order], fragment[order]
    first = np.ones(len(order), bool)
    first[1:] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
    return order, first


def _ranges(doc: np.ndarray, place: np.ndarray, length: np.ndarray, parts: int) -> pa.RecordBatch:
    return _dealt(RANGES, _by_doc(doc), parts, doc.astype("<i8"), place.astype("<i4"), (place + length).astype("<i4"))


def _scan(parts: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def done() -> Iterator[pa.RecordBatch]:
            gram, fragment, doc, place, length = (np.concatenate(c) for c in zip(*held, strict=True))
            order, first = _firsts(gram, fragment, doc, place)
            again, keep = order[~first], order[first]
            yield _ranges(doc[again], place[again], length[again], parts)
            yield _dealt(ANCHORS, gram[keep], parts, gram[keep], fragment[keep], doc[keep].astype("<i8"), place[keep].astype("<i4"), length[keep].astype("|u1"))

        for batch in batches:
            data, at = utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in chunks(at):
                gram, fragment, text, place, length = anchors(data[at[i] : at[j]], at[i : j + 1] - at[i])
                held.append((gram, fragment, ids[i:j][text], place, length))
                total += len(gram)
                if total >= GATHER:
                    yield from done()
                    held, total = [], 0
        if held:
            yield from done()

    return scan


def _resolve(parts: int):
    """Of the anchors in a bucket: ranges covered by equal fragments, and fragments that must be compared."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        found = _take(batches, ANCHORS, _ANCHORS, passed)
        yield from passed
        if found is None:
            return
        gram, fragment, doc, place, length = found
        same = np.zeros(len(gram), bool)  # most grams occur once
        by = np.argsort(gram, kind="stable")
        twice = gram[by][1:] == gram[by][:-1]
        same[by[1:]] |= twice
        same[by[:-1]] |= twice
        gram, fragment, doc, place, length = (x[same] for x in found)
        order, first = _firsts(gram, fragment, doc, place)
        again, keep = order[~first], order[first]
        if len(again):
            yield _ranges(doc[again], place[again], length[again].astype(np.int64), parts)
        g = gram[keep]
        more = np.zeros(len(g), bool)
        more[1:] |= g[1:] == g[:-1]
        more[:-1] |= g[1:] == g[:-1]
        keep = keep[more]
        if len(keep):
            _, which, n = np.unique(gram[keep], return_inverse=True, return_counts=True)
            shares = (n * 2 * SPAN // BLOCK_BYTES + 1)[which].astype("<i4")
            yield _dealt(WANTED, _by_doc(doc[keep]), parts, doc[keep], gram[keep], place[keep], length[keep], shares)

    return stage


# --- transforms ---------------------------------------------------------------------------------------------


class Transform:
    """The rows of the sorted suffixes of a shard: the ``stride`` bytes before each (as a number, 0 where the string
    begins before), the row of the suffix that these bytes begin, the string and the place where the suffix starts.
    Strings end with signs that sort before all bytes, by their number."""

    def __init__(self, strings: list[np.ndarray], numbers: range, stride: int):
        length = np.array([len(x) for x in strings], np.int64)
        ends = np.cumsum(length + 1) - 1
        n = int(ends[-1]) + 1 if len(ends) else 0
        text = np.zeros(n, np.int64)
        text[np.delete(np.arange(n), ends)] = np.concatenate(strings).astype(np.int64) + 1 if strings else 0
        string = np.repeat(np.arange(len(strings)), length + 1)
        place = np.arange(n) - np.repeat(ends - length, length + 1)
        left = np.repeat(ends, length + 1) - np.arange(n)
        order = _sorted_suffixes(text, left)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        before = np.zeros(n, np.int64)
        before[stride:] = _heads(text, left, stride)[: max(0, n - stride)]
        before[place < stride] = 0
        self.before, self.string, self.place = before[order], numbers.start + string[order], place[order]
        self.extended = rank[np.maximum(order - stride, 0)]


def _heads(text: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The first k bytes of every suffix as a number above 0; 0 from its sign on."""
    out = np.zeros(len(text), np.int64)
    for j in range(k):
        ahead = np.zeros(len(text), np.int64)
        ahead[: max(0, len(text) - j)] = text[j:]
        out = out * 257 + np.where(left > j, ahead, 0)
    return out + 1


def _sorted_suffixes(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of suffixes up to the sign (0) that ends their string; ties by place. Ranks double in length."""
    n = len(text)
    key, length = _heads(text, left, 7), 7
    while True:
        order = np.argsort(key)
        new = np.ones(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if not n or length >= left.max() or rank[order[-1]] == n:
            return np.argsort(rank * (n + 1) + np.arange(n))
        ahead = np.zeros(n, np.int64)
        ahead[: n - length] = rank[length:]
        key = rank * (n + 2) + np.where(left > length, ahead, 0)
        length *= 2


def merge(a: Transform, b: Transform, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two transforms (those of b numbered after those of a) whose first ``rounds`` strides of bytes another
    row has too, in the order of these bytes, and the number of the interval of equal ones that each is in.

    A row that is alone in its interval is settled: whatever extends it is alone too, and needs no further round."""
    codes, coded = np.unique(np.concatenate([[0], a.before, b.before]), return_inverse=True)
    before = coded[1:].astype(np.uint16 if len(codes) <= 1 << 16 else np.int32)
    extended = np.concatenate([a.extended, b.extended + len(a.before)])
    rows, interval = np.arange(len(before)), np.zeros(len(before), np.int32)
    for _ in range(rounds):
        code = before[rows]
        some = np.flatnonzero(code)
        order = some[np.argsort(code[some], kind="stable")]
        c, i = code[order], interval[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (i[1:] != i[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        rows, interval = extended[rows[order[~alone]]], np.cumsum(new, dtype=np.int32)[~alone]
    return rows, interval


def repeated(strings: list[np.ndarray], doc: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the fragments, and places in them, at which a string of SPAN bytes starts that also starts earlier
    among these."""
    half, size, total = 0, 0, sum(len(s) for s in strings)
    while half < len(strings) - 1 and size < total // 2:
        size += len(strings[half])
        half += 1
    a, b = Transform(strings[:half], range(half), STRIDE), Transform(strings[half:], range(half, len(strings)), STRIDE)
    rows, interval = merge(a, b, SPAN // STRIDE)
    owner, place = np.concatenate([a.string, b.string])[rows], np.concatenate([a.place, b.place])[rows]
    d, p = doc[owner], begin[owner] + place
    order = np.lexsort((p, d, interval))
    interval, d, p = interval[order], d[order], p[order]
    first = np.ones(len(order), bool)
    first[1:] = interval[1:] != interval[:-1]
    least = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.empty(0, np.int64)
    later = (d != d[least]) | (p != p[least])
    return owner[order][later], place[order][later]


def _strings(parts: int, strings: list[np.ndarray], doc: np.ndarray, begin: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """All strings of SPAN bytes but those at the given places, dealt by their hash, to be held against those of the
    gram's other shares."""
    count = np.array([len(x) - SPAN + 1 for x in strings])
    at = np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    base = np.concatenate([[0], np.cumsum(count)])
    keep = np.ones(base[-1], bool)
    keep[base[owner] + place] = False
    whose = np.repeat(np.arange(len(strings)), count)[keep]
    where = (np.arange(base[-1]) - np.repeat(base[:-1], count))[keep]
    h = Prefix(np.concatenate(strings)).ranges(at[whose] + where, at[whose] + where + SPAN)
    return _dealt(STRINGS, h, parts, h, doc[whose].astype("<i8"), (begin[whose] + where).astype("<i4"))


def _compare(parts: int):
    """Blocks of fragments, merged. The fragments of a gram are in one block, or in as many shares as they need; then
    strings that are first in their share are dealt on."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            found += [unpack(x.as_py(), *_FRAGMENTS) for x in batch.column(2)]
        if not found:
            return
        gram, doc, begin, length, shares, data = (np.concatenate(c) for c in zip(*found, strict=True))
        found.clear()
        at = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        order = np.argsort(gram, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
        edges = np.append(heads, len(order))
        size = np.add.reduceat(length[order].astype(np.int64) + 1, heads)
        i = 0
        while i < len(heads):
            j, total = i + 1, int(size[i])
            alone = shares[order[heads[i]]] > 1
            while not alone and j < len(heads) and total + size[j] <= BLOCK_BYTES and shares[order[heads[j]]] == 1:
                total += int(size[j])
                j += 1
            rows = order[edges[i] : edges[j]]
            strings = [data[at[r] : at[r + 1]] for r in rows]
            own_doc, own_begin = doc[rows], begin[rows].astype(np.int64)
            owner, place = repeated(strings, own_doc, own_begin)
            if len(owner):
                d, p = own_doc[owner], own_begin[owner] + place
                yield _dealt(RANGES, _by_doc(d), parts, d.astype("<i8"), p.astype("<i4"), (p + SPAN).astype("<i4"))
            if alone:
                yield _strings(parts, strings, own_doc, own_begin, owner, place)
            i = j

    return stage


def _across(parts: int):
    """Strings that are first in their share but not among all shares."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []
        found = _take(batches, STRINGS, _STRINGS, passed)
        yield from passed
        if found is None:
            return
        h, d, p = found
        order = np.lexsort((p, d, h))
        h, d, p = h[order], d[order], p[order].astype(np.int64)
        first = np.concatenate([[True], h[1:] != h[:-1]])
        least = np.flatnonzero(first)[np.cumsum(first) - 1]
        later = (d != d[least]) | (p != p[least])
        d, p = d[later], p[later]
        yield _dealt(RANGES, _by_doc(d), parts, d.astype("<i8"), p.astype("<i4"), (p + SPAN).astype("<i4"))

    return stage


# --- documents ----------------------------------------------------------------------------------------------


def _fragments(parts: int):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def done() -> pa.RecordBatch:
            gram, doc, begin, length, shares = (np.concatenate([h[i] for h in held]) for i in range(5))
            data = [x for h in held for x in h[5]]
            share = mix(doc.view(_U) * _U(31) + begin.astype(_U)) % shares.astype(_U)
            gram = np.where(shares > 1, mix(gram + share), gram)
            dealt = []
            for b, p in deal(gram, parts):
                dealt.append((b, pack(gram[p], doc[p], begin[p], length[p], shares[p], np.concatenate([data[k] for k in p]))))
            return _rows(FRAGMENTS, dealt)

        for batch in batches:
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                gram, lo, length, shares = unpack(wanted.as_py(), *_WANTED[1:])
                hi = lo + length.astype(np.int64)
                held.append((gram, np.full(len(gram), doc, "<i8"), lo, length.astype("<i4"), shares, [raw[b:e] for b, e in zip(lo.tolist(), hi.tolist(), strict=True)]))
                total += len(gram)
            if total >= GATHER // 16:
                yield done()
                held, total = [], 0
        if held:
            yield done()

    return stage


def _per_document(kind: int, columns: tuple[str, ...]):
    """A row for each document: all that was dealt to it; ranges merged."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _take(batches, kind, columns, [])
        if found is None:
            return
        if kind == RANGES:
            order = np.lexsort((found[1], found[0]))
            doc, b, e = (x[order].astype(np.int64) for x in found)
            group = np.cumsum(np.concatenate([[True], doc[1:] != doc[:-1]])) << 33
            reach = np.maximum.accumulate(group + e)
            start = np.concatenate([[True], group[1:] + b[1:] > reach[:-1]])
            heads = np.flatnonzero(start)
            ends = np.append(heads[1:], len(doc)) - 1
            found = [doc[heads], b[heads].astype("<i4"), (reach - group)[ends].astype("<i4")]
        else:
            order = np.argsort(found[0], kind="stable")
            found = [x[order] for x in found]
        heads = np.flatnonzero(np.concatenate([[True], found[0][1:] != found[0][:-1]]))
        edges = np.append(heads, len(found[0]))
        for i in range(0, len(heads), 1000):
            some = range(i, min(i + 1000, len(heads)))
            yield pa.RecordBatch.from_pydict({"rid": pa.array(found[0][heads[some.start : some.stop]]), "got": pa.array([pack(*(x[edges[k] : edges[k + 1]] for x in found[1:])) for k in some], pa.binary())})

    return stage


def _cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    rows = []
    for text, got in zip(texts, ranges, strict=True):
        raw = (text.as_py() or "").encode()
        kept, removed, spans = raw, 0, 0
        if got.is_valid:
            b, e = unpack(got.as_py(), "<i4", "<i4")
            parts, at = [], 0
            for x, y in zip(b.tolist(), e.tolist(), strict=True):
                parts.append(raw[at:x])
                at = y
            kept, removed, spans = b"".join([*parts, raw[at:]]), int((e - b).sum()), len(b)
        rows.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(rid, doc_id, text) with rid unique and in the order of documents: the id itself, unless ids are null or repeat."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = own.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"), F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False)).alias("none")).first()
    if told.most <= 1 and not told.none:
        return own.select(F.col("doc_id").alias("rid"), "doc_id", "text")
    ranged = own.repartitionByRange(shuffle_parts(docs.sparkSession), F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last())
    kept = scratch.keep(ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()).withColumn("rid", F.monotonically_increasing_id()), "numbered")
    return kept.select("rid", "doc_id", "text")


def deduplicated(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents (rid, doc_id, text), and covered ranges (rid, got: packed begins and ends) of those that have any."""
    parts = shuffle_parts(docs.sparkSession)
    texts = _numbered(docs, scratch)
    dealt = texts.select("rid", "text").mapInArrow(*freeing(_scan(parts), _STAGE))
    first = scratch.keep(dealt.repartitionById(parts, F.col("bucket")).mapInArrow(*freeing(_resolve(parts), _STAGE)), "resolved")
    per = lambda rows, kind, columns: rows.filter(F.col("kind") == kind).repartitionById(parts, F.col("bucket")).mapInArrow(*freeing(_per_document(kind, columns), "rid bigint, got binary"))
    wanted = scratch.keep(per(first, WANTED, _WANTED), "wanted")
    some = bloom_test(texts, "rid", bloom_of(wanted, "rid"))
    asked = some.join(wanted, "rid").select("rid", "text", "got")
    fragments = asked.mapInArrow(*freeing(_fragments(parts), _STAGE)).repartitionById(parts, F.col("bucket"))
    compared = fragments.mapInArrow(*freeing(_compare(parts), _STAGE)).repartitionById(parts, F.col("bucket"))
    second = scratch.keep(compared.mapInArrow(*freeing(_across(parts), _STAGE)), "compared")
    return texts, scratch.keep(per(first.union(second), RANGES, _RANGES), "ranges")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, ranges = deduplicated(table(spark, sf_dir, "documents"), Scratch(spark, "suffixes"))
    cut = F.arrow_udf(_cut, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string>")
    return texts.join(ranges, "rid", "left").select("doc_id", cut("text", "got").alias("x")).select("doc_id", "x.*")
