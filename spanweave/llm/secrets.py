r"""Secrets: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are runs of letters and digits (bytes of other alphabets count as letters), and every other sign that is not
white space. Every token of a text is tagged begin, inside or outside; inside is only for tokens that no white space
parts from the one before. Features are the token's shape (cases, length,
turns between letters and digits, vowels), the stretch of ``[A-Za-z0-9+/_.~-]`` that it is in, the words and signs
beside the token and before its stretch, named words such as "password" some tokens before, and what kind of file the
text is. Each feature is a number computed for all tokens of a batch at once; a token's scores are sums of weights.

Decoding is Viterbi over the whole text. Scores and steps prove for most tokens that every best sequence has them
outside (``Model.certain``); the text is cut there, and what is left is decoded between two such tokens, so that the
result is that of the whole text. Nothing else holds a token outside: no length, no form, no list.

The model is fitted on a bounded sample: of about SAMPLE_DOCS documents, chosen by a hash of their id, cut into windows
of WINDOW tokens, SAMPLE_WINDOWS that hold a match of the fixed patterns and as many that don't (by a hash of the text),
labelled by the fixed patterns; and EXAMPLES made-up texts with secrets and look-alikes of known forms in known
settings. Everything else covers all documents and whole texts.

Scale: rows are judged in place, with no shuffle, and keep all their columns. The model has bounded size. Memory
follows the longest single text.

Edge cases: a null or empty text has no spans; repeated rows are judged one by one; a table without documents or
secrets leaves the model to its made-up examples; an empty table gives an empty result; columns of any other name pass.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.functions.lbfgs import minimize
from spanweave.llm.common import LOWER, SPACE, Prefix, chunks, per_text, table, trim, utf8, words

SAMPLE_DOCS = 3000
SAMPLE_WINDOWS = 1500
WINDOW = 32
EXAMPLES = 3000
PENALTY = 0.05
ROUNDS = 50
#: Bytes of text whose features are held at once; only a longer single text makes more.
BATCH_BYTES = 1 << 18

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


OUTSIDE, BEGIN, INSIDE = 0, 1, 2

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns match, by begin, then by kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def values(text: str) -> list[tuple[int, int]]:
    """What of a text the fixed patterns know to be a secret: of assignments, the value. Numbers are not."""
    out = [m.span(2) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [m.span() for m in _ACCESS.finditer(text)] + [m.span() for m in _HEX.finditer(text)]
    found: list[tuple[int, int]] = []
    for b, e in sorted(out, key=lambda s: (s[0], -s[1])):
        if not text[b:e].isdigit() and not (found and b < found[-1][1]):
            found.append((b, e))
    return found


# --- tokens and features ------------------------------------------------------------------------------------

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: What a key or password may be written with, in one stretch.
_STRETCH = _WORD.copy()
_STRETCH[list(b"+/_.~-")] = True
_SIGN = ~_WORD & ~SPACE
_CASE = np.zeros(256, np.int8)
_CASE[0x61:0x7B], _CASE[0x41:0x5B], _CASE[0x30:0x3A] = 1, 2, 3
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouyAEIOUY")] = True
_HEXADECIMAL = np.zeros(256, bool)
_HEXADECIMAL[list(b"0123456789abcdef")] = True
_CODE = np.zeros(256, bool)
_CODE[list(b'{}();=<>"')] = True
#: Bucket of a length.
_LENGTH = np.searchsorted([2, 3, 4, 5, 7, 9, 12, 16, 20, 24, 32, 40, 48, 64], np.arange(65), side="right")

#: Words that features name, as tokens in lower case; all others go by their shape.
NAMED = tuple("password passwd pwd pass passphrase passcode secret secrets token tokens key keys apikey api auth bearer authorization credential credentials cred private access client login pin export aws github slack stripe webhook signing encryption sha sha1 sha256 md5 commit hash checksum uuid guid id isbn url http https www com version file path order serial ticket invoice session phone date".split())
#: First bytes of keys of known issuers.
HEADS = (b"ghp", b"sk-", b"sk_", b"pk_", b"xox", b"eyJ", b"AKI", b"AIz", b"glp", b"npm")
#: Tokens before a stretch among which a named word is looked for.
BACK = 8
#: Values of a token's class: named words, then signs by their byte, then words by shape and whether they are long.
_SIGNS, _SHAPES, CLASSES = 1 + len(NAMED), 1 + len(NAMED) + 128, 1 + len(NAMED) + 128 + 64


def _hashes(x: list[bytes]) -> np.ndarray:
    return np.concatenate([Prefix(np.frombuffer(w, np.uint8)).ranges(np.array([0]), np.array([len(w)])) for w in x])


_NAMED_HASHES = _hashes([w.encode() for w in NAMED])
_NAMED_ORDER = np.argsort(_NAMED_HASHES)
_HEAD_NUMBERS = np.array([int.from_bytes(h, "big") for h in HEADS])
_HEAD_ORDER = np.argsort(_HEAD_NUMBERS)


def _three(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The three bytes from each place on, as a number."""
    return (data[at].astype(np.int64) << 16) + (data[at + 1].astype(np.int64) << 8) + data[at + 2]


#: What is counted within tokens, besides turns: three counts to a number, of _FIELD bits each.
_COUNTED = (_CASE == 1, _CASE == 2, _CASE == 3, np.arange(256) >= 0x80, _VOWEL, _HEXADECIMAL, np.zeros(256, bool), np.arange(256) == 0x2E, np.arange(256) == 0x2F)
_FIELD = 21
_PACKED = [sum(_COUNTED[3 * i + j].astype(np.int64) << (_FIELD * j) for j in range(3)) for i in range(3)]


def _counter(data: np.ndarray, turn: np.ndarray):
    """A function of begins and ends: how often what is in _COUNTED occurs in between."""
    sums = [np.concatenate([[0], np.cumsum(row[data] + (turn if i == 2 else 0))]) for i, row in enumerate(_PACKED)]

    def count(b: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
        if len(b) and int((e - b).max()) >> _FIELD:  # a token of millions of bytes: its counts need more bits
            flags = [(turn if i == 6 else row[data]) for i, row in enumerate(_COUNTED)]
            return [c[e] - c[b] for c in (np.concatenate([[0], np.cumsum(f, dtype=np.int64)]) for f in flags)]
        return [(d >> (_FIELD * j)) & ((1 << _FIELD) - 1) for d in (s[e] - s[b] for s in sums) for j in range(3)]

    return count


def _which(known: np.ndarray, order: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of each hash among the known ones, from 1; 0 if it is none of them."""
    at = order[np.minimum(np.searchsorted(known, h, sorter=order), len(known) - 1)]
    return np.where(known[at] == h, at + 1, 0)


def file_kind(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each text, how much of it are signs that code has, and whether it has several lines: 8 values."""
    n = np.maximum(np.diff(at), 1)
    share = np.searchsorted([0.01, 0.04, 0.1], per_text(_CODE[data], at) / n, side="right")
    return 2 * share + (per_text(data == 0x0A, at) > 0)


class Tokens:
    """The tokens of a batch of texts: runs of letters and digits, and every other sign that is not white space.
    ``first``: the index of each text's first token, and past the last."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        word, sign = _WORD[data], _SIGN[data]
        starts, ends = sign | word, sign | word
        starts[1:] &= sign[1:] | ~word[:-1] | edge[1:n]
        ends[:-1] &= sign[:-1] | ~word[1:] | edge[1:n]
        self.data, self.at = data, at
        self.begin, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, at)
        self.number = np.cumsum(starts, dtype=np.int32) - 1  # of the token that begins at or before each byte
        self.joined = np.zeros(len(self.begin), bool)  # with the token before it, without white space between
        self.joined[1:] = self.begin[1:] == self.end[:-1]
        self.joined[self.first[:-1][self.first[:-1] < len(self.begin)]] = False

    def codes(self, kind: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each feature: how many values it has, and the value of each token. ``kind``: ``file_kind`` of each text."""
        data, b, e, n = self.data, self.begin, self.end, len(self.begin)
        text = np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))
        case = _CASE[data]
        turn = np.zeros(len(data), bool)
        turn[1:] = (case[1:] != case[:-1]) & (case[1:] > 0) & (case[:-1] > 0)
        turn[self.at[self.at < len(data)]] = False
        count = _counter(data, turn)

        def shapes(b: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
            lower, upper, digit, other, vowel, hexa, turns, dots, slashes = count(b, e)
            letters = lower + upper
            return {
                "n": _LENGTH[np.minimum(e - b, 64)],
                "case": (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0),
                "other": other > 0,
                "rest": e - b > letters + digit + other + dots + slashes,
                "path": (dots > 0) + 2 * (slashes > 0),
                "vowels": np.where(letters < 4, 5, np.minimum(4 * vowel // np.maximum(letters, 1), 4)),
                "hexa": hexa == e - b,
                "turns": np.minimum(turns, 15),
            }

        own = shapes(b, e)
        named = np.zeros(n, np.int64)
        may = np.flatnonzero((e - b >= 2) & (e - b <= max(map(len, NAMED))) & ~own["other"])
        named[may] = _which(_NAMED_HASHES, _NAMED_ORDER, Prefix(LOWER[data]).ranges(b[may], e[may]))
        sign = (e - b == 1) & _SIGN[data[b]]
        generic = _SHAPES + own["case"] + 8 * own["other"] + 16 * np.minimum(own["n"] // 4, 3)
        cls = np.where(named > 0, named, np.where(sign, _SIGNS + data[b] % 128, generic))
        # the stretch that a token is in; a sign that is in none is its own
        sb, se, _ = words(data, self.at, _STRETCH)
        ordinal = np.zeros(len(data), np.int32)
        ordinal[sb] = 1
        ordinal = np.cumsum(ordinal)[b] - 1
        known = np.maximum(ordinal, 0)
        inside = (ordinal >= 0) & (b < se[known]) if len(se) else np.zeros(n, bool)
        lo, hi = (np.where(inside, sb[known], b), np.where(inside, se[known], e)) if len(se) else (b, e)
        whole, opening = shapes(lo, hi), self.number[lo]
        beginning = self.first[text]
        last_named = np.maximum.accumulate(np.where(named > 0, np.arange(n), -1))
        back = np.where(opening > 0, last_named[np.maximum(opening - 1, 0)], -1)
        away = opening - back
        near = (back >= beginning) & (away <= BACK)
        keyword = np.where(near, named[np.maximum(back, 0)], 0)
        long_enough = hi - lo >= 3
        starts_with = np.zeros(n, np.int64)
        starts_with[long_enough] = _which(_HEAD_NUMBERS, _HEAD_ORDER, _three(data, lo[long_enough]))
        place = 2 * (e == hi) + 4 * self.joined

        # classes with three places between texts, so that what is beside a token is there by number
        classes = np.full(n + 3 * len(self.at) + 3, CLASSES)
        index = np.arange(n) + 3 * (text + 1)
        classes[index] = cls

        def beside(where: np.ndarray, by: int) -> np.ndarray:
            """Class of the token so many after each; CLASSES if the text has none."""
            return classes[where + by]

        opens = opening == np.arange(n)
        yield 1, np.zeros(n, np.int64)
        yield 256, own["case"] + 8 * own["other"] + 16 * own["n"]
        yield 256, own["turns"] + 16 * own["n"]
        yield 128, own["vowels"] + 8 * own["n"]
        yield CLASSES, cls
        for by in (-1, -2, 1, 2):
            yield CLASSES + 1, beside(index, by)
        for by in (-1, -2, -3):
            yield CLASSES + 1, beside(index[opening], by)
        yield 1024, whole["case"] + 8 * whole["rest"] + 16 * whole["n"] + 256 * whole["path"]
        yield 256, whole["turns"] + 16 * whole["n"]
        yield 256, whole["vowels"] + 8 * whole["n"] + 128 * whole["other"]
        yield 32, whole["hexa"] + 2 * whole["n"]
        yield 2 * (1 + len(HEADS)), starts_with * 2 + opens
        yield 3 * (1 + len(NAMED)), keyword * 3 + np.searchsorted([3, 5], np.where(near, away, 0), side="right")
        yield 256, (keyword > 0) + 2 * whole["case"] + 16 * whole["n"]
        yield 1024, kind[text] + 8 * whole["case"] + 64 * whole["n"]
        yield 64, opens + place + 8 * np.minimum(own["n"] // 2, 7)


def codes_of(tokens: Tokens, kind: np.ndarray) -> np.ndarray:
    """A row for each feature, of codes that no other feature has."""
    rows, base = [], 0
    for size, values in tokens.codes(kind):
        rows.append((values + base).astype(np.int32))
        base += size
    return np.stack(rows)


# --- the model ----------------------------------------------------------------------------------------------


@dataclass
class Model:
    #: for each code of each feature, what it says for begin and for inside (against outside)
    weights: np.ndarray
    #: from tag to tag; the row OUTSIDE also begins a text. Inside never follows outside, nor white space.
    steps: np.ndarray

    def scores(self, tokens: Tokens, kind: np.ndarray) -> np.ndarray:
        """For every token of the texts, the weight of each tag (of outside: 0)."""
        both = np.ascontiguousarray(self.weights, np.float32).view(np.complex64)[:, 0]  # a pair to a number
        sums, base = np.zeros(len(tokens.begin), np.complex64), 0
        for size, values in tokens.codes(kind):
            sums += both[base : base + size][values]
            base += size
        out = np.zeros((len(sums), 3))
        out[:, 1:] = sums.view(np.float32).reshape(-1, 2)
        out[~tokens.joined, INSIDE] = NEVER
        return out

    def certain(self, score: np.ndarray) -> np.ndarray:
        """Tokens that every best sequence of tags has outside. Whatever the tags of others, giving such a token the tag
        outside (and to the one after it begin, where it had inside) gains more than it can lose by the steps."""
        s = self.steps + _BAR
        ahead = np.append(score[1:, BEGIN] - score[1:, INSIDE], 0.0)
        out = np.ones(len(score), bool)
        for y in (BEGIN, INSIDE):
            before = min(s[x, OUTSIDE] - s[x, y] for x in ((0, 1, 2) if y == BEGIN else (1, 2)))
            free = min(0.0, *(s[OUTSIDE, z] - s[y, z] for z in (OUTSIDE, BEGIN)))
            held = s[OUTSIDE, BEGIN] - s[y, INSIDE] + min(0.0, *(s[BEGIN, z] - s[INSIDE, z] for z in range(3)))
            out &= score[:, OUTSIDE] - score[:, y] + before + np.minimum(free, held + ahead) > 1e-6
        return out

    def tags(self, score: np.ndarray, first: np.ndarray, prune: bool = True) -> np.ndarray:
        """The best tags of all texts, by Viterbi. Tokens that are surely outside cut a text into stretches, each of
        which is decoded between two of them."""
        n = len(score)
        if not n:
            return np.empty(0, np.int8)
        s = self.steps + _BAR
        open_ = ~self.certain(score) if prune else np.ones(n, bool)
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        begin = open_.copy()
        begin[1:] &= ~open_[:-1] | edge[1:n]
        heads = np.flatnonzero(begin)
        end = open_.copy()
        end[:-1] &= ~open_[1:] | edge[1:n]
        length = np.flatnonzero(end) + 1 - heads
        order = np.argsort(-length, kind="stable")
        heads, length = heads[order], length[order]
        tags, back = np.zeros(n, np.int8), np.zeros((n, 3), np.int8)
        best = np.zeros((len(heads), 3))
        for t in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -t, side="left"))  # stretches longer than t
            rows = heads[:m] + t
            if t == 0:
                best[:m] = s[OUTSIDE]
            else:
                into = best[:m, :, None] + s
                back[rows] = into.argmax(axis=1)
                best[:m] = into.max(axis=1)
            best[:m] += score[rows]
        closed = ~edge[heads + length]  # a certain token comes after; its step counts
        best[closed] += s[:, OUTSIDE]
        last = best.argmax(axis=1).astype(np.int8)
        for t in range(int(length[0]) - 1 if len(length) else -1, -1, -1):
            m = int(np.searchsorted(-length, -t, side="left"))
            rows = heads[:m] + t
            tags[rows] = last[:m]
            last[:m] = back[rows, last[:m]]
        return tags


#: What no path may do.
NEVER = -1e9
_BAR = np.zeros((3, 3))
_BAR[OUTSIDE, INSIDE] = NEVER


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def likelihood(codes: np.ndarray, tags: np.ndarray, joined: np.ndarray, first: np.ndarray, k: int, penalty: float):
    """The loss of weights and steps (as one array, with its gradient): log-likelihood of the tags of texts, negative,
    with an L2 penalty. codes: numbers below k; joined: tokens that may be inside; no text is empty."""
    n = len(tags)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    heads, length = first[:-1][order], length[order]
    rows = [heads[: int(np.searchsorted(-length, -t, side="left"))] + t for t in range(int(length[0]))]
    gold = np.bincount(tags[heads], minlength=3)
    pairs = np.zeros((3, 3))
    for t in range(1, len(rows)):
        np.add.at(pairs, (tags[rows[t] - 1], tags[rows[t]]), 1)
    pairs[OUTSIDE] += gold

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, step = x[: 2 * k], x[2 * k :].reshape(3, 3)
        moves, both = step + _BAR, w.view(np.complex128)
        sums = np.zeros(n, np.complex128)
        for row in codes:
            sums += both[row]
        e = np.stack([np.zeros(n), sums.real, sums.imag], axis=1)
        e[~joined, INSIDE] = NEVER
        a, z = np.empty((n, 3)), np.zeros((n, 3))
        a[heads] = e[heads] + moves[OUTSIDE]
        for r in rows[1:]:
            a[r] = e[r] + _lse(a[r - 1][:, :, None] + moves, 1)
        for r in reversed(rows[1:]):
            z[r - 1] = _lse(moves + (e[r] + z[r])[:, None, :], 2)
        total = _lse(a[heads + length - 1], 1)
        of = np.empty(n)  # of each token, the total of its text
        for r in rows:
            of[r] = total[: len(r)]
        value = 0.5 * penalty * (x @ x) + total.sum() - e[np.arange(n), tags].sum() - (pairs * step).sum()
        p = np.exp(a + z - of[:, None])
        dstep = penalty * step - pairs
        dstep[OUTSIDE] += p[heads].sum(axis=0)
        for r in rows[1:]:
            dstep += np.exp(a[r - 1][:, :, None] + moves + (e[r] + z[r])[:, None, :] - of[r][:, None, None]).sum(axis=0)
        p[np.arange(n), tags] -= 1
        dw = penalty * w.reshape(k, 2)
        for y in (BEGIN, INSIDE):
            column = np.ascontiguousarray(p[:, y])
            dw[:, y - 1] += sum(np.bincount(row, column, minlength=k) for row in codes)
        return value, np.concatenate([dw.ravel(), dstep.ravel()])

    return loss


Example = tuple[str, list[tuple[int, int]], int | None]


def encoded(examples: list[Example]) -> tuple[np.ndarray, np.ndarray, Tokens]:
    """Codes, tags and tokens of texts with the places of their secrets (code points), and the kind of file that
    each comes from (None: as the text itself tells)."""
    data, at = utf8(pa.array([x for x, _, _ in examples], pa.large_string()))
    tokens = Tokens(data[at[0] : at[-1]], at - at[0])
    kind = file_kind(tokens.data, tokens.at)
    given = np.array([-1 if k is None else k for _, _, k in examples], np.int64)
    tags = np.zeros(len(tokens.begin), np.int8)
    for i, (text, spans, _) in enumerate(examples):
        for b, e in spans:
            lo, hi = (tokens.at[i] + len(text[:x].encode()) for x in (b, e))
            mine = np.arange(np.searchsorted(tokens.begin, lo), np.searchsorted(tokens.begin, hi))
            mine = mine[tokens.end[mine] <= hi]
            tags[mine] = np.where(tokens.joined[mine], INSIDE, BEGIN)
            tags[mine[:1]] = BEGIN
    return codes_of(tokens, np.where(given < 0, kind, given)), tags, tokens


def train(examples: list[Example], penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood with an L2 penalty."""
    codes, tags, tokens = encoded(examples)
    first = np.unique(tokens.first)  # texts without tokens say nothing
    size = sum(s for s, _ in Tokens(np.empty(0, np.uint8), np.zeros(1, np.int64)).codes(np.empty(0, np.int64)))
    used, small = np.unique(codes, return_inverse=True)
    k = len(used)
    x = minimize(likelihood(small.reshape(codes.shape), tags, tokens.joined, first, k, penalty), np.zeros(2 * k + 9), rounds=rounds)
    weights = np.zeros((size, 2))
    weights[used] = x[: 2 * k].reshape(k, 2)
    return Model(weights, x[2 * k :].reshape(3, 3))


def made_up(n: int = EXAMPLES, seed: int = 7) -> list[Example]:
    """Texts with the places of their secrets: known forms of keys and passwords in known settings, and look-alikes
    without."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    syllable = lambda: r.choice([*"bcdfghklmnprstvwz", "ch", "pl", "qu", "sh", "st", "tr", ""]) + r.choice([*"aeiou", "ea", "io"]) + r.choice([*"nrslt", "ck", "ng", "pp", "st", "th", "", "", "", ""])
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    part = lambda a, b: pick(low + up + num + "_-", r.randint(a, b))
    keys = [
        lambda: "ghp_" + pick(low + up + num, 36),
        lambda: "sk-" + pick(low + up + num, 48),
        lambda: "sk_live_" + pick(low + up + num, 24),
        lambda: "xoxb-" + pick(num, 12) + "-" + pick(low + up + num, 24),
        lambda: pick(low + up + num + "+/", r.choice([32, 40, 44, 64])),
        lambda: "eyJ" + part(20, 40) + ".eyJ" + part(30, 60) + "." + part(30, 43),
        lambda: pick(hexa, r.choice([32, 40, 64])),
        lambda: pick(low + up + num, r.randint(16, 40)),
        lambda: pick(low, r.randint(2, 4)) + r.choice("_-") + part(18, 40),
        lambda: "-".join(pick(up + num, 5) for _ in range(r.randint(3, 5))),
    ]
    passwords = [
        lambda: word() + pick(num, r.randint(1, 4)),
        lambda: word() + r.choice("!@#$%&*") + pick(num, 2),
        lambda: word().title() + pick(num, 2) + r.choice(["!", "#", ""]),
        lambda: word() + word(),
        lambda: word(),
        lambda: pick(up, r.randint(8, 16)),
        lambda: pick(low + up + num + "!@#%^&*", r.randint(8, 20)),
        lambda: pick(num, r.randint(4, 8)),
    ]
    quoted = lambda: r.choice(["{x}", "{x}", "'{x}'", '"{x}"'])
    said = lambda names: r.choice(names) + r.choice(["=", "=", ": ", " = ", ":", " is ", " "]) + quoted() + r.choice(["", "", " {w}", ";", ",", "."])
    key_names = ["api key", "api_key", "apikey", "token", "auth token", "{w}_token", "secret", "client secret", "access key", "ACCESS_KEY", "credential", "bearer", "private key", "{W}_KEY"]
    password_names = ["password", "passwd", "pwd", "pass", "passphrase", "passcode", "{W}_PASSWORD", "{w}_pass", "pin"]
    set_keys = ["{w} key = '{x}'", "export API_KEY={x}", "Authorization: Bearer {x}", 'client_secret = "{x}";', "{w} token {x} {w}", "credentials: {x}", 'auth("{x}")', "{w} {w} secret {x}.", '"{w}_token": "{x}",', "{W}_SECRET={x}", "--api-key {x} --{w}", "{w} access key: {x}, {w}", "the token is {x}", "{w} {x} as the {w} key", "{w} {w} secret {x} {w}", "curl -H 'X-Api-Key: {x}' https://{w}.com", "{w}: {x}", "{w} {w} {x} {w}"]
    set_passwords = ["password: {x} {w}", "pwd={x}", 'password = "{x}"', "{w} passwd {x}", "login {w} password {x}", "DB_PASSWORD={x}", "{w}'s password is {x}, {w}", "the password is {x}", "{w} the password was {x}", "passphrase: {x}", "pin: {x} {w}", "user={w} pass={x}", "https://{w}:{x}@{w}.com/"]
    plain = [
        lambda: f"{word()}-{word()}-{word()}",
        lambda: "".join(word().title() for _ in range(r.randint(2, 5))) + r.choice(["", "", str(r.randint(1, 9))]),
        lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}",
        lambda: pick(num, r.randint(3, 19)),
        lambda: f"{word()}_{word()}_{r.randint(1, 999)}",
        lambda: r.choice(["", "/"]) + "/".join(word() + r.choice(["", "", "_" + str(r.randint(1, 99))]) for _ in range(r.randint(2, 5))) + r.choice(["", "", ".py", ".txt", ".html"]),
        lambda: f"{word()}{r.randint(1, 9999)}",
        lambda: r.choice("=-*#._+/|<>!?") * r.randint(4, 70),
        lambda: f"{word()}.{word()}@{word()}.com",
        lambda: f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)}",
        lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        lambda: " ".join(word().upper() for _ in range(3)),
        lambda: word().upper() + "!!",
        lambda: f"v{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)}-{r.choice(['rc1', 'beta', 'alpha2'])}",
    ]
    around = ["{w} {w} {x} {w}", "see {x} for {w}", "{w} https://{w}.com/{x}", "id {x}, {w}", "{w} {w}. {x} {w} {w}", "version {x}", "file = {x}", "{w}: {x}", "commit {x}", "{x}", "{w} = {x};", "<{w} id='{x}'>", "order no. {x}"]
    words_only = ["{w} the password {w} {w}.", "{w} {w} of secret {w}, {w}", "a token {w} {w}", "{w} key {w} {w} {w}", "reset your password", "forgot the passphrase? {w}", "password must be {w}", "{w} api {w}; {w} auth {w}", "{w}, {w} {w} {w}. {w} {w}", "{W} {W} {w}", "access {w} login {w}", "password: required", "secret: none", "token = null", "password = None", "{w}['{n}'] {w}", "{w}.get('{n}', '{w}')", '"{n}": {w}', "{w}[\"{n}\"] = '{w}'", "{n} and {n} of {w}", "password: ********"]
    fill = {"{w}": word, "{W}": lambda: word().upper(), "{n}": lambda: r.choice([str.title, str, str.upper])(r.choice(["password", "authorization", "secret", "token", "api-key", "key", "bearer", "login", word()]))}
    filled = lambda t: re.sub(r"\{[wWn]\}", lambda m: fill[m[0]](), t)
    out: list[Example] = []
    for i in range(n):
        forms, settings = [(keys, set_keys), (passwords, set_passwords), (plain, around), (None, words_only)][i % 4]
        names = key_names if forms is keys else password_names
        setting = said(names) if forms in (keys, passwords) and r.random() < 0.5 else r.choice(settings)
        text = " ".join([word() for _ in range(r.randint(0, 6))] + [filled(setting)] + [word() for _ in range(r.randint(0, 6))])
        spans = []
        if forms:
            x, at = r.choice(forms)(), text.index("{x}")
            text = text.replace("{x}", x)
            spans = [(at, at + len(x))] if forms is not plain else []
        if r.random() < 0.2:
            text = text.upper()
        out.append((text, spans, None))
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Model:
    """A model for these documents; see the module for the sample."""
    total = max(1, docs.count())
    share = min(10**9, int(10**9 * sample_docs / total))

    @F.arrow_udf("array<struct<text:string,spans:array<int>,kind:int>>")
    def windows(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            raw = (text or "").encode()
            tokens = Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            kind, spans = int(file_kind(tokens.data, tokens.at)[0]), values(text or "")
            found, at = [], 0
            for k in range(0, len(tokens.begin), WINDOW):
                b, e = int(tokens.begin[k]), int(tokens.end[min(k + WINDOW, len(tokens.end)) - 1])
                part = raw[b:e].decode()
                at = text.index(part, at)
                found.append({"text": part, "spans": [min(max(x - at, 0), len(part)) for s in spans if s[0] < at + len(part) and at < s[1] for x in s], "kind": kind})
                at += len(part)
            rows.append(found)
        trim()
        return pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("spans", pa.list_(pa.int32())), ("kind", pa.int32())])))

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(10**9)) < share).select(windows(F.col("text").cast("string")).alias("w"))
    every = chosen.select(F.explode("w").alias("w")).select("w.*")
    examples: list[Example] = []
    for has in (F.size("spans") > 0, F.size("spans") == 0):
        rows = every.filter(has).orderBy(F.xxhash64("text"), "text").limit(sample_windows).collect()
        examples += [(r.text, list(zip(r.spans[::2], r.spans[1::2], strict=True)), r.kind) for r in rows]
    return train(examples + made_up())


# --- judging ------------------------------------------------------------------------------------------------


def model_spans(texts: pa.Array, model: Model) -> list[list[tuple[int, int]]]:
    """For each text, the spans that the model tags (code points)."""
    data, at = utf8(texts)
    out: list[list[tuple[int, int]]] = []
    for i, j in chunks(at, BATCH_BYTES):
        tokens = Tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
        tags = model.tags(model.scores(tokens, file_kind(tokens.data, tokens.at)), tokens.first)
        found: list[list[tuple[int, int]]] = [[] for _ in range(j - i)]
        opens = np.flatnonzero(tags == BEGIN)
        if len(opens):
            point = np.concatenate([[0], np.cumsum((tokens.data & 0xC0) != 0x80)])
            whose = np.searchsorted(tokens.first, opens, side="right") - 1
            after = np.append(np.flatnonzero(tags != INSIDE), len(tags))
            close = after[np.searchsorted(after, opens, side="right")] - 1  # the last inside it
            base = point[tokens.at[whose]]
            for t, b, e in zip(whose.tolist(), (point[tokens.begin[opens]] - base).tolist(), (point[tokens.end[close]] - base).tolist(), strict=True):
                found[t].append((b, e))
        out += found
    return out


def all_spans(base: list[Span], model: list[tuple[int, int]]) -> list[Span]:
    """Base spans, with those of the model that overlap none of them."""
    reach, covered = 0, []
    for b, e, _ in base:  # merged, in order
        if covered and b < reach:
            reach = covered[-1][1] = max(reach, e)
        else:
            reach = e
            covered.append([b, e])
    starts = [c[0] for c in covered]
    added: list[Span] = []
    for b, e in model:
        i = bisect_left(starts, e)
        if not i or covered[i - 1][1] <= b:
            added.append((b, e, "model"))
    order = {k: i for i, k in enumerate((*KINDS, "model"))}
    return sorted(base + added, key=lambda s: (s[0], order[s[2]]))


_TYPE = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for b, e, k in spans)


def judged(docs: DataFrame, into: str, model: Model | None = None) -> DataFrame:
    """``docs`` with a struct of n_assign, n_access, n_hex, base_sha256 and spans."""
    model = model or fit(docs)

    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")
    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for text, tagged in zip(texts, model_spans(texts, model), strict=True):
            base = base_spans(text.as_py() or "")
            counts = [sum(s[2] == k for s in base) for k in KINDS]
            rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(all_spans(base, tagged))))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        trim()
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TYPE, strict=True)], fields=list(_TYPE))

    return docs.withColumn(into, judge(F.col("text").cast("string")))


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each stretch of spans (in order) replaced by a mark."""
    parts, at = [], 0
    for b, e, _ in spans:
        if b >= at:
            parts += [text[at:b], mark]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def redacted(docs: DataFrame, into: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with a column of texts that have marks in place of secrets; null stays null."""
    model = model or fit(docs)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = [None if t is None else redact(t, all_spans(base_spans(t), tagged)) for t, tagged in zip(texts.to_pylist(), model_spans(texts, model), strict=True)]
        trim()
        return pa.array(out, pa.string())

    return docs.withColumn(into, clean(F.col("text").cast("string")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, "__s").select("doc_id", "__s.*")
