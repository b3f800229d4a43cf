"""Corpora: tables of documents, HTML and archive formats, annotated feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.text import ASCII_WORD, squeeze
from spanweave.operators.joins import running_sums

# --- tables -----------------------------------------------------------------------------------------------------


def write_corpus(docs: DataFrame, path: str, parts: int) -> None:
    """Documents in the order of their ids, so that a lookup reads one row group."""
    docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").write.option("compression", "zstd").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def get_document(corpus: DataFrame, doc_id: int) -> DataFrame:
    return corpus.filter(F.col("doc_id") == doc_id)


def inline_documents(spark: SparkSession, docs: dict[int, list[str]]) -> DataFrame:
    """Tokens of documents given word by word."""
    return spark.createDataFrame([(d, i, w) for d, ws in docs.items() for i, w in enumerate(ws)], "doc_id long, pos int, token string")


def first_ids(counts: DataFrame, name: str = "file") -> DataFrame:
    """From documents in each file (file, n): the id at which each file begins, files in order of name. The table has
    a row for each file."""
    return running_sums(counts, [name], "n", "begin")


# --- HTML -------------------------------------------------------------------------------------------------------

#: Named entities that are written out.
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_title(html: Column) -> Column:
    return plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def plain(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags; white space squeezed."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return squeeze(text)


def page_text(html: Column) -> Column:
    """Title and text with a triple bar between."""
    return F.concat_ws(" ||| ", html_title(html), plain(F.regexp_replace(html, r"(?is)<title[^>]*>.*?</title>", " ")))


def trec_pages(records: DataFrame) -> DataFrame:
    """Pages (doc_no, url, html) of a record for each <DOC> (value); only those with an HTML content type."""
    v = F.col("value")
    head = F.regexp_extract(v, r"(?s)<DOCHDR>(.*?)</DOCHDR>", 1)
    pages = records.select(
        F.regexp_extract(v, r"<DOCNO>\s*(.*?)\s*</DOCNO>", 1).alias("doc_no"),
        F.regexp_extract(head, r"^\s*(\S+)", 1).alias("url"),
        F.regexp_extract(head, r"(?i)content-type:\s*([^\s;]+)", 1).alias("kind"),
        F.regexp_extract(v, r"(?s)</DOCHDR>(.*?)(?:</DOC>|$)", 1).alias("html"),
    )
    return pages.filter("doc_no <> '' AND lower(kind) = 'text/html'").drop("kind")


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped or plain files of pages."""
    return trec_pages(spark.read.text(path, lineSep="<DOC>"))


# --- annotated feed: a line for each token, twelve columns --------------------------------------------------------

#: The columns of the feed.
FEED = ("token", "stem", "pos", "morph", "conl", "wnss", "wsj", "ana", "head", "deplabel", "link", "hyper")


def feed_documents(records: DataFrame) -> DataFrame:
    """(doc, title, i, token, link) of a record for each document mark (value): its lines in order."""
    v = F.col("value")
    titled = records.select(F.regexp_extract(v, r"^\s*(\S+)", 1).alias("doc"), F.regexp_extract(v, r"%%#PAGE\s+([^\n]*)", 1).alias("title"), F.split(v, "\n").alias("lines"))
    rows = titled.select("doc", "title", F.posexplode(F.filter(F.col("lines"), lambda x: F.size(F.split(x, "\t")) == len(FEED))).alias("i", "line"))
    cells = F.split("line", "\t")
    return rows.select("doc", "title", "i", cells[FEED.index("token")].alias("token"), cells[FEED.index("link")].alias("link"))


def feed_annotations(tokens: DataFrame) -> DataFrame:
    """(doc, left, right, name): runs of a begin mark and the marks inside that follow it with the same target."""
    w = Window.partitionBy("doc").orderBy("i")
    begins = F.col("link").startswith("B-/wiki/")
    inside = F.col("link").startswith("I-/wiki/")
    run = F.sum((begins | ~inside).cast("int")).over(w)
    marked = tokens.withColumn("run", run).filter(begins | inside)
    runs = marked.groupBy("doc", "run").agg(F.min("i").alias("left"), F.max("i").alias("right"), F.min_by("link", "i").alias("link"))
    return runs.filter(F.col("link").startswith("B-/wiki/")).select("doc", "left", "right", F.url_decode(F.substring("link", 9, 1 << 20)).alias("name"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    return feed_documents(spark.read.text(path, lineSep="%%#DOC").filter("value <> ''"))


# --- JSON articles ------------------------------------------------------------------------------------------------

ARTICLE = "text string, url string, id array<string>, annotations array<struct<uri:string,offset:int,surface_form:string>>"


def json_articles(lines: DataFrame) -> DataFrame:
    """Articles of lines (value) of JSON."""
    return lines.select(F.from_json("value", ARTICLE).alias("a")).select("a.*")


def article_words(articles: DataFrame, key: str = "url") -> DataFrame:
    """(key, pos, token): runs of ASCII letters and digits, in lower case."""
    return articles.select(key, F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(ASCII_WORD), 0)).alias("pos", "token"))


def article_annotations(articles: DataFrame, key: str = "url") -> DataFrame:
    """(key, name, left, right): annotations by word, from their offsets in characters; those with no word are dropped."""
    a = articles.select(key, "text", F.explode("annotations").alias("a"))
    before = F.size(F.regexp_extract_all(F.substring(F.col("text"), F.lit(1), F.col("a.offset")), F.lit(ASCII_WORD), 0))
    n = F.size(F.regexp_extract_all(F.col("a.surface_form"), F.lit(ASCII_WORD), 0))
    name = F.url_decode(F.regexp_extract("a.uri", r"([^/]*)$", 1))
    return a.select(key, name.alias("name"), before.alias("left"), (before + n - 1).alias("right")).filter(F.col("right") >= F.col("left"))


def redirects(lines: DataFrame) -> DataFrame:
    """(source, target) of the titles and redirects in an XML dump (file, n, value: lines in order)."""
    title = F.nullif(F.regexp_extract("value", r"<title>(.*?)</title>", 1), F.lit(""))
    target = F.nullif(F.regexp_extract("value", r'<redirect title="(.*?)"', 1), F.lit(""))
    last = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    told = lines.filter(F.col("value").contains("<title>") | F.col("value").contains("<redirect ")).withColumn("source", F.last(title, ignorenulls=True).over(last))
    return told.withColumn("target", target).filter("target IS NOT NULL").select("source", "target")
