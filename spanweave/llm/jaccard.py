r"""Exact n-gram Jaccard join and its components: size-aware, heavy and light.

Texts are lower-cased (A-Z) and cut into words ``[^\x20\x09-\x0D]+``; a text's set are its distinct 5-word
shingles, or its whole sequence if it has fewer words. Two texts link at a Jaccard index of 3/4 or more.

1. Texts with equal sets become one class, named by a digest of the set.
2. Signatures. A pair with index 3/4 and a larger set of b shingles shares ceil(3b/4) of them. Light sets give
   all their subsets of these fixed sizes, for every b that they can link with. Heavy sets, and light ones that
   can link with a heavy one, give inverted lists instead: n - ceil(3n/4) + 1 of their shingles, the rarest
   first. Shingles that one class alone has fill these places without being listed, so that texts which share
   but some passages have no list at all. Sizes are light up to where enumerating subsets costs more than
   scanning lists, from the mean length of the lists of shingles that small sets have, counted over all of them.
3. Classes that share a signature and whose sizes allow a link are joined in runs, in each task before they are
   dealt, so that a list of any length is a few runs from each task; components of the joined pairs hold every link.
4. Each such component is verified in one task: sets in order of size look through the lists of their rarest
   shingles for partners that aren't yet in their component. A link found spares the rest of that component, so
   dense groups cost about one comparison for each set. Large components are cut into blocks, verified with a few
   sets that all blocks share; only what is not in the largest part then is held against all, in pairs of blocks.
5. Components of the links give each document the least id that it reaches.

Scale: texts are scanned three times and never shuffled. Shuffled are about half of all shingles (in packed
arrays) to count the classes that have them, then shared ones only, the sets of candidate classes (others are
held back by a Bloom filter of fixed size), and rows of a few numbers for each document. Frequent shingles are
known to all tasks (FREQUENT at most), are never counted again, and come last in every order.

Edge cases: a null or empty text has an empty set, links with nothing and is its own component; repeated rows
are copies; null ids are ignored when the least id is taken; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import LOWER, SPACE, Prefix, Scratch, bloom_has, bloom_of, chunks, deal, freeing, gram_owner, grams, lookup, mix, pack, shuffle_parts, table, unpack, utf8, words
from spanweave.llm.components import components

K = 5
#: Frequent shingles known to all tasks; and how many each task may name, of those that it sees so often.
FREQUENT, NAMED, NAMED_FROM = 65_536, 4_096, 8
#: Subsets that one set may give: what a task can hold of one. Sets with more are heavy, whatever lists would cost.
SUBSETS = 1 << 15
#: Rows of signatures, or shingles, that a task gathers before it passes them on.
GATHER = 1 << 19
#: Shingles of a block of a group of candidates, of each of a pair of blocks; sets of a group that are in all blocks.
BLOCK_SHINGLES, PAIR_SHINGLES, HUBS = 1 << 15, 1 << 18, 16
#: Sets of this size and more give the shingles with hashes below LOWER_HALF first, which are enough for their lists but
#: in rare cases; where they are not, the others follow by hash. So the others need no count, and no link is lost.
HALVED_FROM, LOWER_HALF = 256, 1 << 63

_U = np.uint64
_NOT_SPACE = ~SPACE


def needed(n: int) -> int:
    return -(-3 * n // 4)


def linked(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common)


# --- sets ---------------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, and where each text's begin (one more than texts)."""
    data = LOWER[data]
    begins, ends, first = words(data, at, _NOT_SPACE)
    h, count = Prefix(data).ranges(begins, ends), np.diff(first)
    where, owner = gram_owner(first, K, len(h))
    found, owners = [grams(h, K)[where] if len(where) else np.empty(0, _U)], [owner]
    for n in range(1, K):
        if (texts := np.flatnonzero(count == n)).size:
            found.append(mix(grams(h, n)[first[texts]] + _U(n)))
            owners.append(texts)
    x, owner = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return x[new], np.searchsorted(owner[new], np.arange(len(at)))


def digests(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Names of sets, as signed 64-bit numbers."""
    sums = np.zeros(len(sets) + 1, _U)
    np.cumsum(mix(sets ^ _U(0x5851F42D4C957F2D)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(_U) * _U(0x2545F4914F6CDD1D)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """doc ids, sets, their begins and names, for a bounded number of texts at a time."""
    for batch in batches:
        data, at = utf8(batch.column(1))
        for i, j in chunks(at):
            sets, first = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
            yield batch.column(0).slice(i, j - i), sets, first, digests(sets, first)


def _rows(kind: int, doc: pa.Array, n: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(n), kind, np.int32)), "doc_id": doc, "n": pa.array(n.astype(np.int64)), "name": pa.array(name)})


def _first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a document with its set's size and name; 1: a shingle with the number of sets that have it here;
    2: a shingle of a set that could be light, with the set's name in place of a document."""

    def counts() -> Iterator[pa.RecordBatch]:
        x, n = np.unique(np.concatenate(gathered), return_counts=True)
        often = np.flatnonzero(n >= NAMED_FROM)
        often = often[np.argsort(-n[often], kind="stable")[:NAMED]]
        yield _rows(1, pa.nulls(len(often), pa.int64()), n[often], x[often].view(np.int64))

    gathered, size, seen, few = [], 0, set(), most_light()
    for doc, sets, first, name in _sets(batches):
        yield _rows(0, doc, np.diff(first), name)
        for i in np.unique(name, return_index=True)[1].tolist():
            if first[i + 1] > first[i] and (c := int(name[i])) not in seen:
                seen.add(c)
                own = sets[first[i] : first[i + 1]]
                gathered.append(own)
                size += len(own)
                if len(own) <= few:
                    yield _rows(2, pa.array(np.full(len(own), c)), np.ones(len(own), np.int64), own.view(np.int64))
        if size >= 4 * GATHER:
            yield from counts()
            gathered, size, seen = [], 0, set()
    if gathered:
        yield from counts()


# --- signatures ---------------------------------------------------------------------------------------------


def subset_sizes(n: int) -> list[int]:
    """Sizes of the subsets that a light set of n gives: what it shares with larger sets that it may link with."""
    return sorted({c for b in range(n, 4 * n // 3 + 1) if (c := needed(b)) <= n})


def n_subsets(n: int) -> int:
    return sum(comb(n, c) for c in subset_sizes(n))


def most_light() -> int:
    """The largest size whose subsets, and those of all below it, are no more than SUBSETS."""
    n = 0
    while n_subsets(n + 1) <= SUBSETS:
        n += 1
    return n


def light_limit(mean_list: float) -> int:
    """The largest size for which, and for all below it, subsets cost no more than lists. A set of n scans as many lists
    as its prefix has shingles; ``mean_list`` is what one of them holds."""
    n = 0
    while n < most_light() and n_subsets(n + 1) <= (n + 1 - needed(n + 1) + 1) * (1 + mean_list):
        n += 1
    return n


def subsets(x: np.ndarray) -> np.ndarray:
    """Signatures of a light set: its subsets of all sizes that count for it."""
    rows = [np.array(list(combinations(x.tolist(), c)), _U) for c in subset_sizes(len(x))]
    return np.concatenate([mix(mix(r).sum(axis=1, dtype=_U) + _U(r.shape[1])) for r in rows])


def regime(n: np.ndarray, which: int) -> np.ndarray:
    """Sets that take part in a regime; each pair that may link has both sets in one of them."""
    return n <= 4 * HALVED_FROM // 3 if which == 0 else n >= 3 * HALVED_FROM // 4


def seen_in(sets: np.ndarray, which: int, half: int) -> np.ndarray:
    """Shingles that come first in a regime."""
    return np.ones(len(sets), bool) if which == 0 else sets < _U(half)


def named_in(sets: np.ndarray, which: int) -> np.ndarray:
    """The shingles' names in a regime, so that regimes don't meet."""
    return sets if which == 0 else mix(sets ^ _U(0x8CB92BA72F3D8DD7))


def _dealt_rows(kind: int, dealt: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in dealt], pa.int32()), "kind": pa.array([kind] * len(dealt), pa.int32()), "packed": pa.array([x for _, x in dealt], pa.binary())})


#: Rows between stages: (bucket, kind, packed). SHINGLES: of classes, dealt by shingle, then by class with the
#: number of classes that have each. LISTS: signatures with runs of classes, dealt by signature. PAIRS: of classes.
SHINGLES, LISTS, PAIRS = 0, 1, 2
_STAGE = "bucket int, kind int, packed binary"
_SHINGLES = ("<i8", "<i4", "<i4", "<i4", "<i4", "<u8")  # name, size, regime, non-frequent in regime, how many here; shingles
_LISTS = ("<u8", "<i8", "<i4", "<i4")  # signature, name, least and greatest size


def runs(sig: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Join the runs of a signature whose sizes allow a link: runs left (a class of each, and its sizes), and pairs
    of classes that were joined. Only a few runs of a signature can remain, however many classes share it."""
    order = np.lexsort((name, lo, sig))
    sig, name, lo, hi = sig[order], name[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(sig):
        return (sig, name, lo, hi), name, name
    new = np.concatenate([[True], sig[1:] != sig[:-1]])
    group = np.cumsum(new) << 40
    reach = np.maximum.accumulate(hi + group) - group  # greatest size so far of the same signature
    start = new | np.concatenate([[True], 3 * lo[1:] > 4 * reach[:-1]])
    run = np.cumsum(start) - 1
    heads = np.flatnonzero(start)
    ends = np.append(heads[1:], len(sig)) - 1
    u, v = name, name[heads][run]
    other = u != v
    return (sig[heads], name[heads], lo[heads], reach[ends]), u[other], v[other]


def _lists(sig: np.ndarray, name: np.ndarray, n: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    (sig, name, lo, hi), u, v = runs(sig, name, n, n)
    yield _dealt_rows(LISTS, [(b, pack(sig[p], name[p], lo[p].astype("<i4"), hi[p].astype("<i4"))) for b, p in deal(sig, parts)])
    pairs = np.unique(np.rec.fromarrays([u, v], names="u,v"))
    yield _dealt_rows(PAIRS, [(b, pack(pairs.u[p], pairs.v[p])) for b, p in deal(mix(pairs.v.astype(_U)), parts)])


def _second_scan(frequent: np.ndarray, light: int, parts: int, half: int):
    """Shingles of heavy sets that aren't frequent, dealt by shingle; signatures that need no count: subsets of light
    sets, and frequent shingles of sets that have too few others."""
    order = np.argsort(frequent)  # given from the least frequent
    known, ranks = frequent[order], order + 1

    def ranked(sets: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(sets), np.int64)
        i = np.minimum(np.searchsorted(known, sets), len(known) - 1)
        return np.where(known[i] == sets, ranks[i], 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy: list[tuple] = []  # name, size, regime, non-frequent, shingles: of all of a chunk
        direct: list[tuple[np.ndarray, int, int]] = []  # signatures, name, size
        total, seen = 0, set()

        def done() -> Iterator[pa.RecordBatch]:
            if heavy:
                name, n, which, m, x = (np.concatenate(c) for c in zip(*heavy, strict=True))
                owner = np.repeat(np.arange(len(name)), m)
                dealt = []
                for b, rows in deal(x, parts):
                    who, count = np.unique(owner[rows], return_counts=True)  # rows are in the order of owners
                    dealt.append((b, pack(name[who], n[who], which[who], m[who], count.astype("<i4"), x[rows])))
                yield _dealt_rows(SHINGLES, dealt)
            if direct:
                k = [len(s) for s, _, _ in direct]
                yield from _lists(np.concatenate([s for s, _, _ in direct]), np.repeat([c for _, c, _ in direct], k), np.repeat([n for _, _, n in direct], k), parts)
            heavy.clear(), direct.clear(), seen.clear()

        for _, sets, first, name in _sets(batches):
            n = np.diff(first)
            fresh = np.zeros(len(n), bool)
            fresh[[i for i in np.unique(name, return_index=True)[1].tolist() if n[i] and int(name[i]) not in seen]] = True
            seen.update(name[fresh].tolist())
            for i in np.flatnonzero(fresh & (n <= light)).tolist():
                direct.append((subsets(sets[first[i] : first[i + 1]]), int(name[i]), int(n[i])))
            owner, rank = np.repeat(np.arange(len(n)), n), ranked(sets)
            for which in (0, 1):
                own = fresh & (4 * n // 3 > light) & regime(n, which)
                mine = own[owner] & seen_in(sets, which, half)
                rare = mine & (rank == 0)
                m = np.bincount(owner[rare], minlength=len(n))
                missing = n - -(-3 * n // 4) + 1 - m
                for i in np.flatnonzero(own & (missing > 0)).tolist():
                    often = np.flatnonzero(mine[first[i] : first[i + 1]] & (rank[first[i] : first[i + 1]] > 0)) + first[i]
                    often = often[np.argsort(rank[often])[: missing[i]]]
                    rest = np.flatnonzero(~seen_in(sets[first[i] : first[i + 1]], which, half))[: missing[i] - len(often)] + first[i]  # by hash
                    direct.append((named_in(sets[np.concatenate([often, rest])], which), int(name[i]), int(n[i])))
                who = np.flatnonzero(own & (m > 0))
                heavy.append((name[who], n[who].astype("<i4"), np.full(len(who), which, "<i4"), m[who].astype("<i4"), named_in(sets[rare], which)))
                total += int(rare.sum())
            if total >= GATHER or len(direct) > GATHER // 64:
                yield from done()
                total = 0
        yield from done()

    return scan


def _shared(parts: int):
    """Of the shingles in a bucket, those that two classes or more have, with their number, dealt by class."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            own = [k == SHINGLES for k in batch.column(1).to_pylist()]
            blobs += [unpack(x.as_py(), *_SHINGLES) for x, o in zip(batch.column(2), own, strict=True) if o]
            yield batch.filter(pa.array([not o for o in own]))
        if not blobs:
            return
        name, n, which, m, count, x = (np.concatenate(c) for c in zip(*blobs, strict=True))
        blobs.clear()
        owner = np.repeat(np.arange(len(name)), count)
        order = np.argsort(x, kind="stable")
        x, owner = x[order], owner[order]
        same = x[1:] == x[:-1]
        some = np.zeros(len(x), bool)
        some[1:] |= same
        some[:-1] |= same
        x, owner = x[some], owner[some]
        order = np.lexsort((name[owner], x))
        x, owner = x[order], owner[order]
        fresh = np.ones(len(x), bool)  # a class that several tasks have found
        fresh[1:] = (x[1:] != x[:-1]) | (name[owner][1:] != name[owner][:-1])
        x, owner = x[fresh], owner[fresh]
        _, at, often = np.unique(x, return_inverse=True, return_counts=True)
        x, owner, often = x[often[at] > 1], owner[often[at] > 1], often[at][often[at] > 1]
        yield _dealt_rows(SHINGLES, [(b, pack(name[owner[p]], n[owner[p]], which[owner[p]], m[owner[p]], often[p].astype("<i4"), x[p])) for b, p in deal(mix(name[owner].astype(_U)), parts)])

    return stage


def _prefixes(parts: int):
    """The inverted-list signatures of each class: what no other class has comes first and can't be met, so that the
    rest of the first n - ceil(3n/4) + 1 are the rarest of its shared shingles."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            own = [k == SHINGLES for k in batch.column(1).to_pylist()]
            blobs += [unpack(x.as_py(), *_SHINGLES) for x, o in zip(batch.column(2), own, strict=True) if o]
            yield batch.filter(pa.array([not o for o in own]))
        if not blobs:
            return
        name, n, which, m, often, x = (np.concatenate(c) for c in zip(*blobs, strict=True))
        blobs.clear()
        order = np.lexsort((x, often, which, name))
        name, n, which, m, x = name[order], n[order].astype(np.int64), which[order], m[order], x[order]
        if not len(x):
            return
        start = np.concatenate([[True], (name[1:] != name[:-1]) | (which[1:] != which[:-1])])
        heads = np.flatnonzero(start)
        group = np.cumsum(start) - 1
        shared = np.diff(np.append(heads, len(x)))
        left = n[heads] - -(-3 * n[heads] // 4) + 1 - (m[heads] - shared)
        take = np.arange(len(x)) - heads[group] < left[group]
        yield from _lists(x[take], name[take], n[take], parts)

    return stage


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes whose components hold all links: classes that share a signature and may link by size."""
    lists, pairs = [], []
    for batch in batches:
        for kind, packed in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            if kind == LISTS:
                lists.append(unpack(packed.as_py(), *_LISTS))
            else:
                pairs.append(unpack(packed.as_py(), "<i8", "<i8"))
    if lists:
        _, u, v = runs(*(np.concatenate(c) for c in zip(*lists, strict=True)))
        pairs.append([u, v])
    if pairs:
        u, v = (np.concatenate(c) for c in zip(*pairs, strict=True))
        found = np.unique(np.rec.fromarrays([np.maximum(u, v), np.minimum(u, v)], names="u,v"))
        found = found[found.u != found.v]
        yield pa.RecordBatch.from_pydict({"u": pa.array(found.u.astype(np.int64)), "v": pa.array(found.v.astype(np.int64))})


# --- verification -------------------------------------------------------------------------------------------


def links(names: list[int], sets: list[np.ndarray], minor: list[bool] | None = None, comps: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join each component of the given distinct sets (a spanning forest). Sets of one of ``comps`` are
    joined already; with ``minor``, links are only sought where one of both sets has True."""
    if len(sets) < 2:
        return []
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    begins = np.concatenate([[0], np.cumsum(size)])
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    head: dict[int, int] = {}
    for i, c in enumerate(comps or ()):
        parent[i] = head.setdefault(c, i)

    lists: dict[int, dict[int, list[int]]] = {}
    out = []
    by_size = np.argsort(size, kind="stable")
    place = np.argsort(by_size, kind="stable").tolist()
    for x in by_size.tolist():
        n = int(size[x])
        mine = token[begins[x] : begins[x + 1]]
        mine = mine[np.lexsort((mine, often[mine]))[: n - needed(n) + 1]]
        mine = mine[often[mine] > 1].tolist()
        tried: set[int] = set()
        for t in mine:
            groups = lists.setdefault(t, {})
            for r in [r for r in groups if parent[r] != r]:
                moved = groups.pop(r)
                groups[root(r)] = sorted(groups.get(root(r), []) + moved, key=place.__getitem__)
            for r in list(groups):
                if root(r) == root(x):
                    continue
                for y in reversed(groups[r]):
                    if 4 * size[y] < 3 * n:
                        break  # those before are smaller still
                    if y in tried or not (minor is None or minor[x] or minor[y]):
                        continue
                    tried.add(y)
                    at = np.searchsorted(sets[x], sets[y])
                    common = int((sets[x][np.minimum(at, n - 1)] == sets[y]).sum())
                    if linked(common, n, int(size[y])):
                        out.append((names[x], names[y]))
                        parent[root(y)] = root(x)
                        break
        for t in mine:
            lists[t].setdefault(root(x), []).append(x)
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group; rows come sorted by group: root, i, j, minor, comp, name, packed set."""

    def done() -> Iterator[pa.RecordBatch]:
        found = links(list(group), list(group.values()), [minor[c] for c in group], [comp[c] for c in group])
        if found:
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    key, group, minor, comp = None, {}, {}, {}
    for batch in batches:
        lean = batch.slice(0, batch.num_rows)
        for row, (*this, m, p, c) in enumerate(zip(*(lean.column(k).to_pylist() for k in range(6)), strict=True)):
            if this != key:
                if group:
                    yield from done()
                key, group, minor, comp = this, {}, {}, {}
            if c not in group:
                group[c] = np.frombuffer(batch.column(6)[row].as_py(), "<u8")
                comp[c] = p
            minor[c] = m or minor.get(c, False)
    if group:
        yield from done()


def _verified(placed: DataFrame, parts: int) -> DataFrame:
    rows = placed.select("root", "i", "j", "minor", "comp", "name", "packed")
    return rows.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(*freeing(_verify, "u bigint, v bigint"))


def _all_links(stored: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """Links of candidate groups, from sets (name, root, weight, blocks, n_sets, packed).

    First each block is verified by itself, with the same few sets (hubs) of the group in each of its blocks: where
    most of a group is alike that joins most of it. Of a group that is left in several parts, all sets outside of
    the largest part are then held against all sets, in pairs of blocks."""
    hashed = lambda n: F.pmod(F.xxhash64("name"), F.col(n).cast("long")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("name", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("n_sets") / HUBS)).cast("long")) == 0)
    one = stored.withColumn("j", F.explode(F.when(hub, upto("blocks")).otherwise(F.array(hashed("blocks")))))
    first = scratch.keep(_verified(one.select("*", F.lit(0).alias("i"), F.lit(True).alias("minor"), F.col("name").alias("comp")), parts), "links1")
    large = stored.filter("blocks > 1").select("name", "root", "weight")
    if not large.limit(1).count():
        return first
    joined = scratch.keep(components(first, scratch, "parts"), "parts").select(F.col("u").alias("name"), F.col("root").alias("comp"))
    members = large.join(joined, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    sizes = members.groupBy("root", "comp").agg(F.sum("weight").alias("w"))
    tops = sizes.groupBy("root").agg(F.max_by("comp", F.struct("w", "comp")).alias("top"), F.count("*").alias("n"), F.sum("w").alias("all"), F.max("w").alias("most")).filter("n > 1")
    blocks = lambda w: F.ceil(w / F.lit(PAIR_SHINGLES)).cast("int")
    plan = tops.select("root", "top", blocks(F.col("all")).alias("k"), F.greatest(F.lit(1), blocks(F.col("all") - F.col("most"))).alias("km"))
    plan = scratch.keep(plan, "plan")
    planned = lookup(members, plan, "root", plan.count(), "inner").select("name", "comp", (F.col("comp") != F.col("top")).alias("minor"), "k", "km")
    placed = stored.select("name", "root", "packed").join(planned, "name")
    against = placed.withColumn("j", hashed("k")).withColumn("i", F.explode(upto("km"))).withColumn("minor", F.lit(False))
    outside = placed.filter("minor").withColumn("i", hashed("km")).withColumn("j", F.explode(upto("k")))
    return first.union(scratch.keep(_verified(against.unionByName(outside), parts), "links2"))


def _third_scan(bits: Broadcast):
    """(name, size, packed): the sets of classes that may be candidates, once for a task's documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets, first, name in _sets(batches):
            may = (np.diff(first) > 0) & bloom_has(bits.value, name)
            rows = [i for i in np.unique(name, return_index=True)[1].tolist() if may[i] and int(name[i]) not in seen]
            seen.update(name[rows].tolist())
            if rows:
                yield pa.RecordBatch.from_pydict({"name": pa.array(name[rows]), "packed": pa.array([sets[first[i] : first[i + 1]].tobytes() for i in rows], pa.binary())})

    return scan


def jaccard_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scanned = scratch.keep(texts.mapInArrow(*freeing(_first_scan, "kind int, doc_id bigint, n bigint, name bigint")), "scanned")
    rows = scanned.filter("kind = 0").select("doc_id", "n", "name")
    often = scanned.filter("kind = 1").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(FREQUENT)
    frequent = np.array([r.name for r in often.collect()][::-1], np.int64).view(_U)
    lists = scanned.filter("kind = 2").select("doc_id", "name").distinct().groupBy("name").agg(F.count("*").cast("double").alias("n"))
    met = lists.agg(F.sum(F.col("n") * F.col("n")).alias("met"), F.sum("n").alias("n")).first()
    light = light_limit((met.met or 1.0) / (met.n or 1.0))  # the list of a shingle that a small set has, on average

    parts = shuffle_parts(spark)
    dealt = texts.mapInArrow(*freeing(_second_scan(frequent, light, parts, LOWER_HALF), _STAGE))
    for stage in (_shared(parts), _prefixes(parts)):
        dealt = dealt.repartitionById(parts, F.col("bucket")).mapInArrow(*freeing(stage, _STAGE))
    chains = dealt.repartitionById(parts, F.col("bucket")).mapInArrow(*freeing(_chains, "u bigint, v bigint"))
    edges = scratch.keep(chains, "chains")
    roots = scratch.keep(components(edges, scratch, "candidates"), "roots")
    least = roots.select(F.col("root").alias("u")).distinct()
    candidates = scratch.keep(roots.union(least.select("u", F.col("u").alias("root"))).select(F.col("u").alias("name"), "root"), "candidates")

    sizes = rows.filter("n > 0").groupBy("name").agg(F.first("n").alias("n"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    weighed = scratch.keep(candidates.join(sizes.select("name", F.col("n").alias("weight")), "name"), "weighed")
    totals = weighed.groupBy("root").agg(F.ceil(F.sum("weight") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("n_sets"))
    totals = scratch.keep(totals, "totals")
    sets = texts.mapInArrow(*freeing(_third_scan(spark.sparkContext.broadcast(bloom_of(candidates, "name"))), "name bigint, packed binary"))
    once = sets.groupBy("name").agg(F.first("packed").alias("packed"))  # copies that several tasks have found
    stored = scratch.keep(lookup(weighed, totals, "root", totals.count(), "inner").join(once, "name"), "sets")
    found = _all_links(stored, scratch, parts)

    linked_ = scratch.keep(components(found, scratch, "components"), "linked").withColumnRenamed("u", "name")
    named = sizes.join(linked_, "name", "left").select("name", F.coalesce("root", "name").alias("root"), "least", "copies")
    named = scratch.keep(named, "named")
    # one group or one text may have a third of all rows: only those of several texts or rows are looked up
    groups = named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("texts")).filter("texts > 1")
    groups = scratch.keep(groups, "groups")
    told = lookup(named, groups, "root", groups.count()).filter("texts > 1 OR copies > 1")
    classes = scratch.keep(told.select("name", F.coalesce("first", "least").alias("component_id")), "classes")
    joined = lookup(rows, classes, "name", classes.count())
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard"))
