"""Catalogs and query sets."""

from __future__ import annotations

import csv
import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.plans.query import BINDING, MUST, Atom, Context, Matcher, selector, telegraph

# --- catalogs -----------------------------------------------------------------------------------------------------


def facts(lines: DataFrame) -> DataFrame:
    """(a, b) of tab-separated facts: columns 1 and 2."""
    cells = F.split("value", "\t")
    return lines.filter(F.size(cells) >= 3).select(cells[1].alias("a"), cells[2].alias("b")).distinct()


def tsv_catalog(entities: DataFrame, sub_class: DataFrame, types: DataFrame, means: DataFrame) -> dict[str, DataFrame]:
    """ents (ent), ent_cat (ent, cat), sub_sup (sub, sup) and lemmas (ent, lemma) of four files of lines (value)."""
    ents = entities.select(F.split("value", "\t")[0].alias("ent")).filter("ent <> ''").distinct()
    return {
        "ents": ents,
        "ent_cat": facts(types).select(F.col("a").alias("ent"), F.col("b").alias("cat")).join(ents, "ent", "left_semi"),
        "sub_sup": facts(sub_class).select(F.col("a").alias("sub"), F.col("b").alias("sup")).filter("sub <> sup"),
        "lemmas": facts(means).select(F.col("b").alias("ent"), F.trim(F.translate("a", '"', "")).alias("lemma")).join(ents, "ent", "left_semi"),
    }


def _local(uri: Column) -> Column:
    return F.url_decode(F.regexp_extract(uri, r"([^/#]*)$", 1))


def triples(lines: DataFrame) -> DataFrame:
    """(s, p, o) of lines of N-Triples whose object is a resource."""
    t = r"^<([^>]*)> <([^>]*)> <([^>]*)> *\."
    return lines.filter(F.col("value").rlike(t)).select(*(F.regexp_extract("value", t, i).alias(c) for i, c in enumerate("spo", 1)))


def rdf_catalog(ontology: DataFrame, instances: DataFrame) -> dict[str, DataFrame]:
    """sub_sup and ent_cat of N-Triples: subclass statements and instance types."""
    sub = triples(ontology).filter(F.col("p").endswith("#subClassOf"))
    inst = triples(instances).filter(F.col("p").endswith("#type"))
    return {
        "sub_sup": sub.select(_local(F.col("s")).alias("sub"), _local(F.col("o")).alias("sup")).distinct().filter("sub <> sup"),
        "ent_cat": inst.select(_local(F.col("s")).alias("ent"), _local(F.col("o")).alias("cat")).distinct(),
    }


# --- query sets ---------------------------------------------------------------------------------------------------


def labelled_queries(text: str, width: int = 20) -> list[tuple[str, Context]]:
    """Queries of a sheet (CSV text): QueryID, Include?, NaturalQuery, YagoAtype, then selectors. Rows that are not
    included, or have no selector, are left out."""
    out = []
    for row in list(csv.reader(io.StringIO(text)))[1:]:
        cells = [c.strip() for c in row]
        if len(cells) > 4 and cells[1].lower() in ("y", "1"):
            found = tuple(selector(c) for c in cells[4:] if c)
            if found and cells[3]:
                out.append((cells[0], Context(False, width, (Matcher(MUST, (Atom(BINDING, cells[3]),)), *found))))
    return out


def labelled_entities(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """(qid, ent, label) of two CSV texts of query id and entity."""
    rows = [(r[0].strip(), r[1].strip(), label) for text, label in ((positive, True), (negative, False)) for r in csv.reader(io.StringIO(text)) if len(r) >= 2]
    return spark.createDataFrame(rows, "qid string, ent string, label boolean").dropDuplicates(["qid", "ent"])


def telegraphic_queries(text: str) -> list[tuple[str, Context]]:
    """Queries of a CSV text of QueryID and TelegraphQuery."""
    return [(r[0].strip(), telegraph(r[1])) for r in list(csv.reader(io.StringIO(text)))[1:] if len(r) >= 2 and r[1].strip()]
