"""What the operators must return, said plainly."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    text = text or ""
    w = words(text)
    count, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    """Spans by kind, and the counts and hash of the contract."""
    spans, counts = [], []
    for kind, pattern in PII.items():
        before = len(spans)
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(len(spans) - before)
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


SECRETS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def secrets(text):
    spans = []
    for i, (kind, pattern) in enumerate(SECRETS.items()):
        for m in re.finditer(pattern, text or "", re.A):
            if {"assign": lambda: len(m[2]) >= 12, "access": lambda: len(m[0]) >= 18, "hex": lambda: len(m[0]) >= 16}[kind]():
                spans.append((m.start(), i, m.end(), kind))
    spans.sort()
    written = [f"{k}:{b}:{e}" for b, _, e, k in spans]
    return (*(sum(s[3] == k for s in spans) for k in SECRETS), hashlib.sha256(",".join(written).encode()).hexdigest()), written


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(docs):
    """{doc: (n_shingles, component)} of {doc: text}."""
    sets = {k: shingles(t) for k, t in docs.items()}
    lists = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            lists[x].append(k)
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, n in Counter(j for x in s for j in lists[x] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(k), root(j)))
                parent[b] = a
    return {k: (len(s), root(k)) for k, s in sets.items()}


def contamination(docs, items):
    w = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    windows = defaultdict(set)
    for i, t in items:
        v = w(t)
        if v and i is not None:
            n = min(10, len(v))
            for p in range(len(v) - n + 1):
                windows[tuple(v[p : p + n])].add(str(i))
    sizes, out = {len(k) for k in windows}, []
    for d, t in docs:
        v, hit, found = w(t), set(), set()
        for n in sizes:
            for p in range(len(v) - n + 1):
                if (k := tuple(v[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[k]
        out.append((d, len(v), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def repeats(docs, span=100):
    """(doc, n_bytes, n_removed, n_spans, kept_sha256) of (doc, text) in order."""
    seen, out = set(), []
    for d, t in docs:
        raw = (t or "").encode()
        covered = bytearray(len(raw) + 2)
        for i in range(len(raw) - span + 1):
            if raw[i : i + span] in seen:
                covered[i + 1 : i + 1 + span] = b"\1" * span
            seen.add(raw[i : i + span])
        kept = bytes(b for b, c in zip(raw, covered[1:], strict=False) if not c)
        out.append((d, len(raw), sum(covered), bytes(covered).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return out


def perspectives(turns):
    """(conv, speaker, text, masks) of (conv, turn, role, text), as one part each."""
    by, out = defaultdict(list), []
    for c, n, r, t in turns:
        by[c].append((n is not None, n or 0, r or "unknown", t or ""))
    for c, rows in by.items():
        for speaker in sorted({r[2] for r in rows} - {"system"}):
            text, masks = "", []
            for _, _, r, t in sorted(rows):
                text += "<|assistant|>\n" if r == speaker else "<|system|>\n" if r == "system" else f"<|user:{r}|>\n"
                body = t.replace("<|", "<\\|") + "<|end|>\n"
                if r == speaker:
                    masks.append(f"{len(text)}:{len(text) + len(body)}")
                text += body
            out.append((c, speaker, text, ",".join(masks)))
    return sorted(out, key=str)
