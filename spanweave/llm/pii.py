r"""Personal data by weak supervision, in DataFrame functions only.

Candidates are what four strict patterns match (e-mail addresses, IP addresses, card and phone numbers), which
always count, and what looser ones match besides: spelled-out addresses, IPv6, numbers that fail the card check,
phone numbers with no country code. Five labelers vote on each candidate for, against or not at all: a pattern, a
shape, a gazetteer (domain endings, issuer digits, calling codes, reserved networks), words before it that speak
for, and words that speak against. Expectation-maximisation estimates for each kind how each labeler votes on
true and on false candidates, from the counts of vote patterns alone. With the resulting probabilities as soft
labels, a naive Bayes classifier is trained over features that no labeler votes by (how many digits, between what signs,
which separators and whether they are all alike, whether a colon or line begins before); looser candidates that it gives
at least ACCEPT, and that overlap no strict span, are added. Numbers that fail the card check teach the estimation what
false candidates look like, and are never added.

Positions come from ``split`` with the same pattern: the lengths of pieces and matches add up to offsets in code
points. The patterns are written so that no text makes them backtrack or recurse without bound: possessive
loops, and look-behinds (or the end of the last match) that only let them start where a run starts.

Scale: texts are scanned once, with no shuffle; a row for each document with its few candidates is written. Vote
patterns and features have few values (at most 4 * 3^5 * FEATURE_VALUES rows), which are counted by a partial
aggregate, and only these counts reach the driver.

Edge cases: a null or empty text has no spans; repeated rows are judged one by one; an empty table gives an
empty result and an untrained classifier, which accepts nothing; further columns aren't read.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import Scratch, table, text_or_empty

ACCEPT = 0.9
EM_ROUNDS = 50
CONTEXT = 32
FEATURE_VALUES = 4 * 5 * 5 * 2 * 2 * 2

KINDS = ("email", "ip", "card", "phone")

#: kind, whether strict, pattern, what the text must contain for it to be tried
PATTERNS = (
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]"),
    ("card", True, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", "[0-9]{2}|[0-9][ -][0-9]"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]"),
    ("email", False, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?(?i:at)\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[({]\x20?(?i:dot)\x20?[\])}]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,6}", "[\\[({] ?(?i:at)"),
    ("ip", False, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("phone", False, r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3}[\x20-]?)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])", "[0-9]{3}[ .-][0-9]{4}"),
)

#: Words before a candidate that speak for its kind, and words that speak against any.
FOR = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|courriel|correo|kontakt)",
    "ip": r"(?i)(?:\bip\b|host|server|address|addr|adresse|client|login)",
    "card": r"(?i)(?:card|visa|amex|credit|debit|carte|tarjeta|karte|payment)",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|sms)",
}
AGAINST = r"(?i)(?:version|\bv\.?$|order|invoice|isbn|issn|section|serial|ticket|\bno\.?\s?$|\bid\s?[:=]?\s?$|#$|\$$)"
#: Gazetteers: what the span itself must match.
KNOWN = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|nl|ch|at|be|ca|us|au|in|br|mx|jp|cn|ru)$",
    "ip": r"^(?!0\.|10\.|127\.|169\.254\.|192\.168\.|2(?:2[4-9]|[3-5][0-9])\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|3[0689])",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9])",
}
#: The shape that a kind usually has.
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]*+(?:\.[A-Za-z0-9-]++)*+$",
    "ip": r"^(?:[1-9][0-9]{0,2}\.(?:0|[1-9][0-9]{0,2})\.(?:0|[1-9][0-9]{0,2})\.(?:0|[1-9][0-9]{0,2})|[0-9A-Fa-f:]+)$",
    "card": r"^(?:[0-9]{15,16}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}(?:[ .-]?[0-9]{2,4})?$",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_CAND = "kind:string,b:int,e:int,strict:boolean,votes:string,feats:string"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether up to 19 digits pass the Luhn check: with zeros before them, every second of 20 digits is doubled."""
    full = F.lpad(number, 20, "0")
    at = lambda i: F.substring(full, i, 1).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = sum((doubled(at(i)) if i % 2 else at(i) for i in range(1, 21)), F.lit(0))
    return total % 10 == 0


def valid(kind: str, span: Column) -> Column:
    if kind == "ip":
        return span.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(digits(span))
    if kind == "phone":
        return F.length(digits(span)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _candidate(kind: str, strict: bool, span: Column, left: Column, right: Column, begin: Column) -> Column:
    ok = valid(kind, span) if strict else F.lit(False)
    false = F.lit(False)
    votes = F.concat(
        _vote(ok, ~ok if kind in ("card", "ip") else false),
        _vote(span.rlike(SHAPE[kind]), false if kind != "card" else ~span.rlike(SHAPE[kind])),
        _vote(span.rlike(KNOWN[kind]), ~span.rlike(KNOWN[kind]) if kind in ("ip", "card") else false),
        _vote(left.rlike(FOR[kind]), false),
        _vote(false, left.rlike(AGAINST)),
    )
    edge = lambda c: F.when(c == "", "e").when(c.rlike(r"^\s$"), "s").when(c.rlike("^[0-9]$"), "d").when(c.rlike(r"^\p{L}$"), "l").otherwise("p")
    n = F.length(digits(span))
    size = F.when(n < 9, "0").when(n < 13, "1").when(n < 17, "2").otherwise("3")
    bit = lambda x: F.when(x, "1").otherwise("0")
    headed = (left == "") | left.rlike(r"[:=\n]\s*$")
    even = F.regexp_replace(span, r"[\p{L}0-9+()]", "").rlike(r"^(.?)\1*$")  # one kind of separator, or none
    feats = F.concat(size, edge(F.right(left, F.lit(1))), edge(F.left(right, F.lit(1))), bit(span.rlike("[ ()-]")), bit(headed), bit(even))
    return F.struct(F.lit(kind).alias("kind"), begin.cast("int").alias("b"), (begin + F.length(span)).cast("int").alias("e"), ok.alias("strict"), votes.alias("votes"), feats.alias("feats"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and an array of candidates of each row, ordered by kind and begin within a pattern."""
    out = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("t"))
    empty = F.array().cast("array<string>")
    for i, (_, _, pattern, needs) in enumerate(PATTERNS):
        may = F.col("t").contains("@") if needs == "@" else F.col("t").rlike(needs)
        out = out.withColumn(f"m{i}", F.when(may, F.regexp_extract_all("t", F.lit(pattern), 0)).otherwise(empty))
        out = out.withColumn(f"p{i}", F.when(F.size(f"m{i}") > 0, F.split("t", pattern, -1)).otherwise(empty))
    out = out.drop("t")
    found = []
    for i, (kind, strict, _, _) in enumerate(PATTERNS):
        m, p = F.col(f"m{i}"), F.col(f"p{i}")
        sizes = F.zip_with(m, F.slice(p, 1, F.greatest(F.size(m), F.lit(0))), lambda x, y: F.struct(F.length(y).alias("p"), F.length(x).alias("m")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
        step = lambda a, z: F.struct((a["at"] + z["p"] + z["m"]).alias("at"), F.concat(a["begins"], F.array(a["at"] + z["p"])).alias("begins"))
        begins = F.aggregate(sizes, zero, step, lambda a: a["begins"])
        made = F.transform(F.zip_with(m, begins, lambda x, b: F.struct(x.alias("x"), b.alias("b"))), _maker(kind, strict, p))
        if strict and kind in ("ip", "phone"):  # failing matches are dropped; failing cards stay as looser candidates
            made = F.filter(made, lambda c: c["strict"])
        found.append(made.cast(f"array<struct<{_CAND}>>"))
    return out.select("doc_id", F.concat(*found).alias("found"))


def _maker(kind: str, strict: bool, pieces: Column):
    def make(z: Column, i: Column) -> Column:
        left, right = F.right(F.get(pieces, i), F.lit(CONTEXT)), F.left(F.get(pieces, i + 1), F.lit(CONTEXT))
        return _candidate(kind, strict, z["x"], left, right, z["b"])

    return make


# --- estimation: small tables of counts only ----------------------------------------------------------------


def em(counts: dict[str, float], rounds: int = EM_ROUNDS) -> dict[str, float]:
    """Probability that a candidate with a pattern of votes is true, from the count of each pattern. Start: the
    majority. Labelers are taken as independent given the truth; counts are smoothed by one."""
    posterior = {v: 1 / (1 + exp(-(v.count("+") - v.count("-")))) for v in counts}
    for _ in range(rounds):
        weight = [sum(n * (p if y else 1 - p) for v, n in counts.items() for p in [posterior[v]]) for y in (0, 1)]
        rates = [
            [{s: (1 + sum(n * (posterior[v] if y else 1 - posterior[v]) for v, n in counts.items() if v[k] == s)) / (3 + weight[y]) for s in "+0-"} for k in range(5)]
            for y in (0, 1)
        ]
        odds = log((1 + weight[1]) / (1 + weight[0]))
        for v in counts:
            score = odds + sum(log(rates[1][k][s] / rates[0][k][s]) for k, s in enumerate(v))
            posterior[v] = 1 / (1 + exp(-max(-500.0, min(500.0, score))))
    return posterior


def classifier(counted: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """From (kind, votes, features, count): the probability of each kind|features that naive Bayes gives, trained
    on the probabilities that ``em`` finds for votes."""
    out: dict[str, float] = {}
    for kind in KINDS:
        rows = [r[1:] for r in counted if r[0] == kind]
        votes: dict[str, float] = {}
        for v, _, n in rows:
            votes[v] = votes.get(v, 0) + n
        truth = em(votes) if votes else {}
        total = [1.0, 1.0]
        tally: list[dict[tuple[int, str], float]] = [{}, {}]
        for v, f, n in rows:
            for y, w in ((1, n * truth[v]), (0, n * (1 - truth[v]))):
                total[y] += w
                for key in enumerate(f):
                    tally[y][key] = tally[y].get(key, 0) + w
        for f in {f for _, f, _ in rows}:
            score = log(total[1] / total[0]) + sum(log((1 + tally[1].get(key, 0)) / (5 + total[1]) / ((1 + tally[0].get(key, 0)) / (5 + total[0]))) for key in enumerate(f))
            out[f"{kind}|{f}"] = 1 / (1 + exp(-max(-500.0, min(500.0, score))))
    return out


def spans(found: DataFrame) -> DataFrame:
    """``candidates`` with two arrays of spans, base and added."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.feats").count()
    model = classifier([tuple(r) for r in each.collect()])
    known = F.map_from_arrays(F.lit(list(model) or [""]), F.lit(list(model.values()) or [0.0]))
    base = F.filter("found", lambda c: c["strict"])
    loose = F.filter("found", lambda c: ~c["strict"] & (c["kind"] != "card") & (F.coalesce(F.get(F.array(F.try_element_at(known, F.concat(c["kind"], F.lit("|"), c["feats"]))), F.lit(0)), F.lit(0.0)) >= ACCEPT))
    out = found.withColumn("base", base).withColumn("loose", loose)
    return out.withColumn("added", F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["b"] < x["e"]) & (x["b"] < b["e"])))).drop("loose", "found")


def _of(kind: str, spans_: Column) -> Column:
    return F.filter(spans_, lambda c: c["kind"] == kind)


def _prefixed(kind: str):
    return lambda x: F.concat(F.lit(f"{kind}:"), x)


def _joined(*arrays: Column) -> Column:
    """Spans by kind as in KINDS, then by begin."""
    parts = []
    for kind in KINDS:
        mine = F.array_sort(F.transform(_of(kind, F.concat(*arrays)), lambda c: F.struct(c["b"].alias("b"), c["e"].alias("e"))))
        parts.append(F.transform(mine, lambda c: F.concat_ws(":", c["b"].cast("string"), c["e"].cast("string"))))
        parts[-1] = F.transform(parts[-1], _prefixed(kind))
    return F.array_join(F.concat(*parts), ",")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Scratch(spark, "pii").keep(candidates(table(spark, sf_dir, "documents")), "candidates")
    counts = [F.size(_of(k, F.col("base"))).cast("long").alias(f"n_{k}") for k in KINDS]
    base, added = F.col("base"), F.col("added")
    return spans(found).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(base, added).alias("spans"), F.size("added").cast("long").alias("n_added"))
