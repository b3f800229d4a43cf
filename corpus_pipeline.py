"""A corpus pipeline out of the operators of ``spanweave.llm``.

Each stage takes documents and returns documents (the last one: packed pieces), and works on all that the stage
before it kept. Rejected by quality rules, second and later members of near-duplicate groups, and contaminated
documents go; secrets are replaced in the text. Further columns of the input stay as they are, whatever their names; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import jaccard, packing, quality, secrets, winnow
from spanweave.llm.common import Scratch, columns_of, table, unused

#: No SQL says what the second stage (iterative) and the fourth (a trained model) do; see tests/llm for brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor their host's verdict reject. Null and empty texts have no words and go;
    a null host is a host like others; repeated rows are judged one by one, whatever their ids."""
    scratch, q = Scratch(spark, "quality"), unused(docs, "quality")
    rows = scratch.keep(quality.measured(docs, q), "measured")  # read twice, measured once
    hosts = quality.rejected_hosts(rows, q, scratch)
    return quality.judge(rows, q, scratch, hosts).filter(f"{q}.kept").select(*columns_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates; rows without an id come after those with one,
    rows of equal ids in the order of their texts, and of equal texts one stays. Rows in no group stay, whatever their
    ids; rows with null or empty texts are in none."""
    scratch = Scratch(spark, "jaccard")
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        return _near_duplicate_rows(docs, scratch)
    groups, first = jaccard.jaccard_components(docs, scratch), unused(docs, "first")
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(first))
    return docs.join(kept, F.col("doc_id").cast("long") == F.col(first), "left_semi")


def _near_duplicate_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same where ids don't name rows: these are numbered, and groups are made of numbers."""
    row = unused(docs, "row")
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    groups = jaccard.jaccard_components(texts.select(F.col("row").alias("doc_id"), "text"), scratch)
    groups = scratch.keep(groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "groups")
    several = groups.groupBy("group").count().filter("count > 1").select("group")
    members = texts.join(groups.join(several, "group"), "row")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text", "row")
    first = members.groupBy("group").agg(F.min(order).alias("first")).select("group", F.col("first.row").alias("first"))
    others = groups.join(first, "group").filter("row <> first").select(F.col("row").alias(row))
    return rows.join(others, row, "left_anti").select(*columns_of(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark. Null and empty texts share none and stay; repeated rows are
    judged one by one."""
    w = unused(docs, "windows")
    found = winnow.found(docs, table(spark, sf_dir, "benchmark"), w, Scratch(spark, "winnow"))
    return found.filter(F.size(f"{w}.hits") == 0).select(*columns_of(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars, if there is one, follows texts that change. Null
    texts stay null, empty ones empty; repeated rows are treated alike."""
    clean = unused(docs, "clean")
    rows, text = secrets.redacted(docs, clean), F.col("text").cast("string")
    changed = {"text": F.col(clean).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        length = F.length(clean).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(text.eqNullSafe(F.col(clean)), F.col("n_chars")).otherwise(length)
    return rows.select(*(changed[c].alias(c) if c in changed else own for c, own in zip(docs.columns, columns_of(docs), strict=True)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place. A null or empty text is one piece of one id; null and repeated
    ids stay as they are, each row packed for itself."""
    return packing.pack(docs, Scratch(spark, "packing"), packing.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
