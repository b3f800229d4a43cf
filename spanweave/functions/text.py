"""Words, terms and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of letters and digits, for any script; and the ASCII runs that the JSON articles use.
WORD = r"[\p{L}\p{N}]+"
ASCII_WORD = r"[A-Za-z0-9]+"
MAX_TERM = 64


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def term(word: Column) -> Column:
    """A word as an index term, or null where it is rejected: too long, or nothing but white space."""
    plain = F.lower(F.trim(word))
    return F.when((F.length(word) <= MAX_TERM) & (plain != ""), plain)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Forms of catalog names whose first group is the plain name, in the order they are tried.
CATALOG_NAMES = (r"^wikicategory_wordnet_(.*)_\d+$", r"^wikicategory_(.*)$", r"^wordnet_(.*)_\d+$")


def free_text(canonical: Column) -> Column:
    """The plain name within a catalog name; names of no known form are only trimmed."""
    found = [F.when(canonical.rlike(p), F.regexp_extract(canonical, p, 1)) for p in CATALOG_NAMES]
    return F.coalesce(*found, F.trim(canonical))


#: Marks of a link's first word and of its others in the annotated feed.
BEGIN_LINK, IN_LINK = "B-/wiki/", "I-/wiki/"


def link_target(tag: Column) -> Column:
    """What a link tag points to; null for tags that are no links."""
    return F.when(tag.startswith(BEGIN_LINK) | tag.startswith(IN_LINK), F.substring(tag, len(BEGIN_LINK) + 1, 1 << 20))


def is_link_begin(tag: Column) -> Column:
    return tag.startswith(BEGIN_LINK)


PHRASE_SEPARATOR = "|"


def phrase(tokens: Column) -> Column:
    """Tokens as one string; null tokens are empty. Null if a token holds the separator."""
    joined = F.array_join(tokens, PHRASE_SEPARATOR, "")
    return F.when(~F.exists(tokens, lambda t: F.coalesce(t.contains(PHRASE_SEPARATOR), F.lit(False))), joined)


def phrase_tokens(joined: Column) -> Column:
    return F.split(joined, r"\|", -1)


def hint_windows(tokens: Column) -> Column:
    """Half-open windows of one or two words, from each word on; the last word alone only if there is no other."""
    n = F.size(tokens)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array(F.struct(i.alias("b"), (i + 1).alias("e")), F.struct(i.alias("b"), (i + 2).alias("e")))))
    fits = F.filter(pairs, lambda w: (w["e"] <= n) & ((n == 1) | (w["b"] < n - 1)))
    return F.when(n > 0, fits).otherwise(F.filter(pairs, lambda w: F.lit(False)))
