"""The query language: syntax tree, parser, checks.

    query   := context+
    context := ("uw" | "ow") "(" NUMBER matcher+ ")"
    matcher := ["+" | "-"] (atom | '"' atom+ '"')
    atom    := WORD | "{" WORD "}" | "[" WORD "]"

``{x}`` is the entity x, ``[t]`` a placeholder for any entity of type t, ``+`` must occur, ``-`` must not, all
others may. Words are ``[0-9A-Za-z_]+``; numbers and the two window names can't be words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN, ENTITY, BINDING, PHRASE = "token", "entity", "binding", "phrase"
MUST, MAY, NOT = "must", "may", "not"


@dataclass(frozen=True)
class Atom:
    kind: str
    key: str


@dataclass(frozen=True)
class Matcher:
    exist: str
    atoms: tuple[Atom, ...]
    quoted: bool = False

    @property
    def kind(self) -> str:
        return PHRASE if self.quoted else self.atoms[0].kind


@dataclass(frozen=True)
class Context:
    ordered: bool
    width: int
    matchers: tuple[Matcher, ...]

    @property
    def binding(self) -> int:
        """The number of the matcher that is the placeholder."""
        return next(i for i, m in enumerate(self.matchers) if m.kind == BINDING)


class QueryError(ValueError):
    pass


_LEX = re.compile(r'\s*(?:([0-9A-Za-z_]+)|(["+\-(){}\[\]]))')


class _Parser:
    def __init__(self, text: str):
        self.items, at = [], 0
        while at < len(text.rstrip()):
            m = _LEX.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at:].strip()[:1]!r} at {at}")
            self.items.append(m[1] or m[2])
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def take(self, *wanted: str) -> str:
        item = self.peek()
        if not item or wanted and item not in wanted:
            raise QueryError(f"expected {' or '.join(wanted) or 'more'}, found {item or 'the end'}")
        self.at += 1
        return item

    def word(self) -> str:
        item = self.take()
        if not re.fullmatch(r"[0-9A-Za-z_]+", item) or item.isdigit() or item in ("uw", "ow"):
            raise QueryError(f"{item!r} can't be a word")
        return item

    def atom(self) -> Atom:
        if self.peek() in ("{", "["):
            kind, close = (ENTITY, "}") if self.take() == "{" else (BINDING, "]")
            found = Atom(kind, self.word())
            self.take(close)
            return found
        return Atom(TOKEN, self.word())

    def matcher(self) -> Matcher:
        exist = {"+": MUST, "-": NOT}[self.take()] if self.peek() in ("+", "-") else MAY
        if self.peek() == '"':
            self.take()
            atoms = [self.atom()]
            while self.peek() != '"':
                atoms.append(self.atom())
            self.take()
            if any(a.kind != TOKEN for a in atoms):
                raise QueryError("a phrase holds words only")
            return Matcher(exist, tuple(atoms), True)
        atom = self.atom()
        return Matcher(MUST if atom.kind == BINDING else exist, (atom,))

    def context(self) -> Context:
        ordered = self.take("uw", "ow") == "ow"
        self.take("(")
        width = self.take()
        if not width.isdigit():
            raise QueryError(f"a width is a number, not {width!r}")
        matchers = [self.matcher()]
        while self.peek() != ")":
            matchers.append(self.matcher())
        self.take(")")
        return Context(ordered, int(width), tuple(matchers))


def parse(text: str) -> Context:
    """The one context of a query; raises QueryError."""
    p = _Parser(text)
    found = [p.context()]
    while p.peek():
        found.append(p.context())
    if len(found) > 1:
        raise QueryError("more than one context")
    return found[0]


def try_parse(text: str) -> Context | None:
    try:
        return parse(text)
    except QueryError:
        return None


def check(c: Context, types: set[str] | None = None) -> Context:
    """The context, if it can be run: unordered, one placeholder of a known type, nothing that must not occur."""
    bindings = [a for m in c.matchers for a in m.atoms if a.kind == BINDING]
    if c.ordered:
        raise QueryError("ordered windows can't be run")
    if len(bindings) != 1 or any(m.quoted and a.kind == BINDING for m in c.matchers for a in m.atoms):
        raise QueryError("a query has one placeholder, outside of phrases")
    if any(m.exist == NOT for m in c.matchers):
        raise QueryError("nothing can be excluded")
    if types is not None and bindings[0].key not in types:
        raise QueryError(f"unknown type {bindings[0].key!r}")
    return c


def selector(text: str) -> Matcher:
    """A cell of a query sheet: an optional sign, then {entity}, a quoted or plain phrase, or a word."""
    text = text.strip()
    exist = {"+": MUST, "-": NOT}.get(text[:1], MAY)
    body = text[1:].strip() if text[:1] in "+-" and text else text
    if body.startswith("{") and body.endswith("}"):
        return Matcher(exist, (Atom(ENTITY, body[1:-1].strip()),))
    parts = body.strip('"').split()
    if not parts:
        raise QueryError("an empty selector")
    return Matcher(exist, tuple(Atom(TOKEN, p) for p in parts), len(parts) > 1 or body.startswith('"'))


_TELEGRAPH = re.compile(r'([+-]?)(?:"([^"]*)"|(\S+))')


def telegraph(text: str, width: int = 20) -> Context:
    """A telegraphic query: signed words and phrases, in a window with no placeholder."""
    found = []
    for sign, quoted, plain in _TELEGRAPH.findall(text):
        exist = {"+": MUST, "-": NOT}.get(sign, MAY)
        parts = (quoted or plain).split()
        if parts:
            found.append(Matcher(exist, tuple(Atom(TOKEN, p) for p in parts), bool(quoted)))
    return Context(False, width, tuple(found))


def telegraph_words(c: Context) -> list[str]:
    """The words of a telegraphic query in order, phrases broken up."""
    return [a.key for m in c.matchers for a in m.atoms]


def binding_type(c: Context) -> str:
    return c.matchers[c.binding].atoms[0].key
