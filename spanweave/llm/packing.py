"""Best-fit packing of token sequences in bounded space.

A document is its tokens and the id 0. Documents longer than a sequence are cut into full pieces and a rest.
Each task keeps at most ``open_bins`` open bins; bit f of an integer says that some bin has f free places, so
the best fit for a piece of length n is the lowest set bit from n up. If none fits while all bins are open, the
fullest one closes. When its input ends, a task has up to ``open_bins`` unfinished bins; these are packed once
more, as items of their own and by the same rule, over groups of MERGED_TASKS tasks. So every task has bounded memory
and the places lost do not depend on the number of tasks but on that of groups.

Scale: texts are read once and never shuffled; what is written and joined is a row of numbers for each piece.
Token ids come from a cache by word (texts are split at ASCII white space, which this vocabulary drops and which
neither its normaliser nor its merges cross), of at most CACHED_WORDS words. Words of small letters only go to the
vocabulary's merges at once, without its normaliser and pattern, which would leave them as they are.

Edge cases: a null or empty text is the single id 0; repeated rows are packed as often as they come; null ids
stay null; an empty table packs to nothing; ``pack`` reads two columns and ignores all others.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import Scratch, freeing, lookup, table

SEQUENCE = 2048
OPEN_BINS = 512
MERGED_TASKS = 16
CACHED_WORDS = 600_000
#: Longer words are encoded without being kept.
CACHED_LENGTH = 64


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Signs after which nothing of a word's other tokens depends on them, nor they on it.
_TAIL = b".,;:!?#%&*$"


#: Two-byte signs of U+00C0 to U+024F that are no letters, or end with a mark in lower case.
_UNLIKE = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


def _splits(core: bytes) -> bool:
    """Whether a word's core ends with a letter, so that the vocabulary's pattern cuts between it and _TAIL."""
    return bool(core) and (0x61 <= core[-1] <= 0x7A or len(core) > 1 and 0xC3 <= core[-2] <= 0xC9 and core[-2:] not in _UNLIKE)


#: Words of small ASCII letters and two-byte letters from U+00C0 on: one match of the vocabulary's pattern each, in
#: composed form, whose small letters are one character each. (_UNLIKE apart.)
_LETTERS = re.compile(rb"(?:[a-z]|[\xc3-\xc9][\x80-\xbf])+")


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in vocabularies over bytes: itself where it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


_SIGN_OF = {b: sign for b, sign in enumerate(_byte_signs())}


class Encoder(dict):
    """Little-endian 32-bit ids of words, kept by word in lower case (which the vocabulary is in)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def _merged(self, text: str) -> bytes:
        return b"".join([self.packed[t.id] for t in self.model.tokenize(text)])

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # small ASCII letters stand for themselves
            ids = self._merged(word.decode())
        elif _LETTERS.fullmatch(word) and not any(x in word for x in _UNLIKE):
            ids = self._merged(word.decode().lower().encode().decode("latin-1").translate(_SIGN_OF))
        else:
            core = word.rstrip(_TAIL)
            if len(core) < len(word) and _splits(core):
                ids = self[core] + self[word[len(core) :]]
            else:
                ids = b"".join([self.packed[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        if b"<|" in raw:  # special tokens are told from ordinary text before it is put in lower case
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + _END
        return b"".join(map(self.__getitem__, raw.lower().split())) + _END


_END = bytes(4)
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One for all tasks of a worker process, which each begin with no words kept."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class BestFit:
    """Bounded-space best fit. ``place`` gives the bin and the offset of an item."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.most, self.free = size, open_bins, 0
        self.bins: dict[int, list[int]] = {}
        self.count = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        found = bins.pop()
        if not bins:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.size, self.made
            self.made += 1
            if length < self.size and self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        left = space - length
        if left:
            self.bins.setdefault(left, []).append(found)
            self.free |= 1 << left
            self.count += 1
        return found, self.size - space

    def unfinished(self) -> list[tuple[int, int]]:
        """Open bins and the places used in each."""
        return [(b, self.size - space) for space, bins in sorted(self.bins.items()) for b in bins]


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("used", pa.int64())])
_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, used bigint"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def pack(docs: DataFrame, scratch: Scratch, path: str, size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pieces of documents with their sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = encoder_of(path), BestFit(size, open_bins)
        task = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids, doc = encoder.ids(text.as_py()), doc.as_py()
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    cut = ids[at : at + 4 * size]
                    n = len(cut) // 4
                    found, offset = bins.place(n)
                    rows.append((doc, piece, at // 4, n, zlib.crc32(cut), task | found, offset, None))
                if len(rows) >= 8192:
                    yield _batch(rows)
                    rows = []
        rows += [(None, None, None, None, None, task | b, None, used) for b, used in bins.unfinished()]
        if rows:
            yield _batch(rows)
        encoder.clear()  # the worker process lives on

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Unfinished bins of a group of tasks, the fullest first, by the same rule with as many open bins; a bin of
        these has the id of the first that is put into it."""
        found = sorted((-u, b) for batch in batches for u, b in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
        groups: dict[int, list[tuple[int, int]]] = {}
        for used, b in found:
            groups.setdefault(b >> 36 >> (MERGED_TASKS.bit_length() - 1), []).append((-used, b))
        for items in groups.values():
            bins, name = BestFit(size, open_bins), {}
            placed = [(b, *bins.place(used)) for used, b in items]
            for b, into, _ in placed:
                name.setdefault(into, b)
            yield pa.RecordBatch.from_pydict({"bin": [b for b, _, _ in placed], "into": [name[i] for _, i, _ in placed], "shift": [s for _, _, s in placed]})

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scratch.keep(read.mapInArrow(*freeing(first, _DDL)), "pieces")
    group = F.shiftright("bin", 36 + MERGED_TASKS.bit_length() - 1)
    bins = rows.filter("used is not null").select("bin", "used").repartition(group)
    moved = scratch.keep(bins.mapInArrow(*freeing(second, "bin bigint, into bigint, shift bigint")), "moved")
    pieces = lookup(rows.filter("used is null").drop("used"), moved, "bin", moved.count())
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "packing"), vocabulary())
