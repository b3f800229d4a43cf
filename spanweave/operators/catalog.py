"""Catalog of entities, types and lemmas: transitive closure, postings of types, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.joins import small
from spanweave.scratch import Scratch


def closure(edges: DataFrame, lower: str = "sub", upper: str = "sup", include_self: bool = False, rounds: int = 64) -> DataFrame:
    """All (sub, sup) pairs with a path between them. Each round doubles the length of paths that are known; the
    rounds end when no pair is new, so cycles do no harm. A pair of a node with itself is only given with
    ``include_self``."""
    scratch = Scratch(edges.sparkSession, "closure")
    known = edges.select(F.col(lower).alias("sub"), F.col(upper).alias("sup")).filter("sub IS NOT NULL AND sup IS NOT NULL AND sub <> sup").distinct()
    nodes = known.select("sub").union(known.select("sup")).distinct()
    known, count = scratch.keep(known, "0"), -1
    for turn in range(1, rounds + 1):
        size = known.count()
        if size == count:
            break
        count = size
        more = known.alias("a").join(known.alias("b"), F.col("a.sup") == F.col("b.sub")).select("a.sub", "b.sup").filter("sub <> sup")
        known = scratch.keep(known.union(more).distinct(), str(turn))
        scratch.drop(str(turn - 1))
    if include_self:
        known = known.union(nodes.select("sub", F.col("sub").alias("sup")))
    return known


def entity_types(direct: DataFrame, sub_sup: DataFrame) -> DataFrame:
    """(ent, cat): the types of each entity and all types above them, from (ent, cat) and the closure (sub, sup)."""
    above = direct.join(small(sub_sup), F.col("cat") == F.col("sub")).select("ent", F.col("sup").alias("cat"))
    return direct.select("ent", "cat").union(above).distinct()


def type_postings(annots: DataFrame, ent_cat: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Annotations once for each of their entity's types (of ``types`` (cat), if given). Annotations of unknown
    entities have none."""
    wanted = ent_cat if types is None else ent_cat.join(small(types.select("cat").distinct()), "cat", "left_semi")
    return annots.join(small(wanted), "ent")


def known_entities(annots: DataFrame, ents: DataFrame) -> DataFrame:
    """Annotations of entities that the catalog has."""
    return annots.join(small(ents.select("ent").distinct()), "ent", "left_semi")


def posting_stats(postings: DataFrame, key: str) -> DataFrame:
    """df, cf and greatest document of each key."""
    return postings.groupBy(key).agg(F.count_distinct("doc_id").alias("df"), F.count("*").alias("cf"), F.max("doc_id").alias("max_doc"))


def global_stats(parts: DataFrame) -> DataFrame:
    """Totals over parts of a corpus (part, doc_id): documents are counted by the greatest id, as ids are dense."""
    by_part = parts.groupBy("part").agg((F.max("doc_id") + 1).alias("docs"), F.count("*").alias("occurrences"))
    return by_part.agg(F.max("docs").alias("n_docs"), F.sum("occurrences").alias("n_occurrences"))


def merged_counts(*counts: DataFrame, key: str = "token") -> DataFrame:
    """Sums of count columns over several tables of counts."""
    columns = [c for c in counts[0].columns if c != key]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole.groupBy(key).agg(*(F.sum(c).alias(c) for c in columns))


def known_counts(local: DataFrame, remote: DataFrame, key: str = "token") -> DataFrame:
    """Counts of the local vocabulary with those of another table added where it has the key."""
    columns = [c for c in local.columns if c != key]
    other = remote.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return local.join(other, key, "left").select(key, *((F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in columns))


def unit_positions(spans: DataFrame) -> DataFrame:
    """A row for each position of a span."""
    return spans.withColumn("pos", F.explode(F.sequence("left", "right"))).drop("left", "right")


def resolve(names: DataFrame, entities: DataFrame, redirects: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ent: the entity of that name, else the one that a redirect of that name leads to."""
    direct = entities.select(F.col("name").alias(name), F.col("ent").alias("__direct"))
    through = redirects.join(entities, F.col("target") == F.col("name")).select(F.col("source").alias(name), F.col("ent").alias("__through")).dropDuplicates([name])
    joined = names.join(direct, name, "left").join(through, name, "left")
    return joined.withColumn("ent", F.coalesce("__direct", "__through")).drop("__direct", "__through")


def xor_checksum(df: DataFrame, *columns: str) -> DataFrame:
    """A checksum of a table that no order of its rows changes: SHA-1 of each row as text, combined by exclusive or
    in five 32-bit words."""
    digest = F.sha1(F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns)))
    part = lambda i: F.coalesce(F.bit_xor(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")), F.lit(0).cast("long"))
    return df.agg(F.concat(*(F.lpad(F.lower(F.hex(part(i))), 8, "0") for i in range(5))).alias("checksum"), F.count("*").alias("n"))


def root_types(sub_sup: DataFrame) -> DataFrame:
    """Types that have no type above them."""
    return sub_sup.select(F.col("sup").alias("cat")).distinct().join(sub_sup.select(F.col("sub").alias("cat")).distinct(), "cat", "left_anti")


def is_a(ent_cat: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (ent, cat) with whether the entity has the type."""
    return pairs.join(ent_cat.select("ent", "cat").distinct().withColumn("__is", F.lit(True)), ["ent", "cat"], "left").withColumn("is_a", F.coalesce("__is", F.lit(False))).drop("__is")


def column_or(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))
