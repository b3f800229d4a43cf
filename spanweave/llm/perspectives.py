r"""Chat formatting: every dialogue from the view of each of its speakers.

For each speaker of a conversation the dialogue is rendered once with that speaker's turns as ``<|assistant|>``
and all others' as ``<|user:NAME|>``; turns of NARRATORS (such as system) stay what they are and have no view of
their own. Each turn ends with ``<|end|>`` and a newline. Masks are the stretches (code points, end exclusive) of
the speaker's own texts with their end signs: what a model is trained on. ``<|`` within texts and names is
written ``<\|``, so that no text can pose as a head.

A dialogue is one row; if its turn numbers exceed PART_TURNS it is further rows, one for each PART_TURNS numbers,
with the offset at which each part begins. So no task holds more of a conversation than a part, however long it is.

Scale: texts are shuffled once, by conversation and part, and meet the speakers there. Which speaker sees which part
comes from rows without texts, by a salted lookup. Where parts begin is summed from their lengths over range
partitions, for conversations of several parts alone. All in JVM functions.

Edge cases: a null text is empty; a null or empty name is ``unknown``; null turns come first, in part 0; repeated
rows stay, ordered by turn, name and text; a null conversation id is a conversation of its own; conversations
with narrators only give no row; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm.common import Scratch, lookup, table
from spanweave.operators.joins import running_sums

PART_TURNS = 512
NARRATORS = ("system",)
END = "<|end|>\n"
OWN_HEAD = "<|assistant|>\n"


def _safe(x: Column) -> Column:
    return F.replace(x, F.lit("<|"), F.lit("<\\|"))


def _head(name: Column, narrators: tuple[str, ...]) -> Column:
    """The head of a turn for all but its own speaker."""
    return F.when(name.isin(*narrators), F.concat(F.lit("<|"), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user:"), _safe(name), F.lit("|>\n")))


def _body(text: Column) -> Column:
    return F.concat(_safe(text), F.lit(END))


def _views(own: DataFrame, narrators: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """k, block, speaker, part, begin: which parts each speaker sees, their numbers and where they begin."""
    head, name = F.length(_head(F.col("name"), narrators)), F.col("name")
    sizes = own.groupBy("k", "block", "name").agg(F.sum(head + F.length(_body(F.col("text")))).alias("size"), F.sum(F.lit(len(OWN_HEAD)) - head).alias("less"))
    sizes = scratch.keep(sizes, "sizes")  # of each name's turns in a part, for others; and what changes for the name itself
    speakers = scratch.keep(sizes.filter(~name.isin(*narrators)).select("k", name.alias("speaker")).distinct(), "speakers")
    blocks = scratch.keep(sizes.groupBy("k", "block").agg(F.sum("size").alias("size")), "blocks")
    views = lookup(blocks, speakers, "k", speakers.count(), "inner")
    several = scratch.keep(blocks.groupBy("k").agg(F.count("*").alias("parts")).filter("parts > 1"), "several")
    n = several.count()
    if not n:
        return views.select("k", "block", "speaker", F.lit(0).alias("part"), F.lit(0).cast("long").alias("begin"))
    views = scratch.keep(lookup(views, several, "k", n), "views")
    changed = sizes.select("k", "block", name.alias("speaker"), "less")
    long = views.filter("parts IS NOT NULL").join(changed, ["k", "block", "speaker"], "left")
    long = long.select(F.struct("k", "speaker").alias("view"), "block", (F.col("size") + F.coalesce("less", F.lit(0))).alias("size"), F.lit(1).alias("one"))
    summed = running_sums(running_sums(long, ["view", "block"], "size", "at"), ["view", "block"], "one", "number")
    summed = scratch.keep(summed, "summed")
    first = scratch.keep(summed.groupBy("view").agg(F.min("at").alias("first_at"), F.min("number").alias("first_number")), "first")
    placed = lookup(summed, first, "view", first.count(), "inner")
    placed = placed.select("view.k", "block", "view.speaker", (F.col("number") - F.col("first_number")).cast("int").alias("part"), (F.col("at") - F.col("first_at")).alias("begin"))
    short = views.filter("parts IS NULL").select("k", "block", "speaker", F.lit(0).alias("part"), F.lit(0).cast("long").alias("begin"))
    return short.unionByName(placed)


def perspectives(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_own_turns, begin, text, masks ("begin:end" of each, comma-joined) and
    n_mask_chars, from turns (conv_id, turn, role, text)."""
    name = F.coalesce(F.nullif(F.col("role").cast("string"), F.lit("")), F.lit("unknown"))
    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    own = turns.select(key.alias("k"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), name.alias("name"), part.alias("block"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = own.groupBy("k", "block").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("turn", "name", "text"))).alias("turns"))

    def segment(t: Column) -> Column:
        mine = t["name"] == F.col("speaker")
        head = F.when(mine, OWN_HEAD).otherwise(_head(t["name"], narrators))
        return F.struct(head.alias("head"), _body(t["text"]).alias("body"), mine.alias("mine"))

    def step(a: Column, s: Column) -> Column:
        begin = a["at"] + F.length(s["head"])
        end = begin + F.length(s["body"])
        mask = F.when(s["mine"], F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(a["masks"], mask).alias("masks"), (a["n"] + F.when(s["mine"], end - begin).otherwise(0)).alias("n"))

    views = _views(own, narrators, Scratch(turns.sparkSession, "perspectives"))
    seen = parts.join(views, ["k", "block"]).withColumn("segments", F.transform("turns", segment))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("masks"), F.lit(0).alias("n"))
    summed = seen.withColumn("sum", F.aggregate("segments", zero, step))
    return summed.select(
        "conv_id",
        "speaker",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("segments", lambda s: s["mine"])).cast("long").alias("n_own_turns"),
        "begin",
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "").alias("text"),
        F.array_join("sum.masks", ",").alias("masks"),
        F.col("sum.n").cast("long").alias("n_mask_chars"),
    )


def op5_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS name,
         coalesce(CAST(floor(turn / 512.0) AS BIGINT), 0) AS block, replace(coalesce(text, ''), '<|', '<\|') AS body
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, name AS speaker FROM turns WHERE name <> 'system'),
heads AS (
  SELECT t.*, s.speaker, t.name = s.speaker AS mine,
         CASE WHEN t.name = s.speaker THEN '<|assistant|>' WHEN t.name = 'system' THEN '<|system|>'
              ELSE '<|user:' || replace(t.name, '<|', '<\|') || '|>' END || chr(10) AS head,
         t.body || '<|end|>' || chr(10) AS tail
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(tail)) OVER (
           PARTITION BY conv_id, speaker, block ORDER BY turn NULLS FIRST, name, body
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b
  FROM heads),
parts AS (
  SELECT conv_id, speaker, block, count(*) AS n_turns, count(*) FILTER (mine) AS n_own_turns,
         string_agg(head || tail, '' ORDER BY turn NULLS FIRST, name, body) AS text,
         coalesce(string_agg(CAST(b AS BIGINT) || ':' || CAST(b + length(tail) AS BIGINT), ',' ORDER BY b) FILTER (mine), '') AS masks,
         CAST(coalesce(sum(length(tail)) FILTER (mine), 0) AS BIGINT) AS n_mask_chars
  FROM placed GROUP BY conv_id, speaker, block)
SELECT conv_id, speaker, CAST(row_number() OVER w - 1 AS INTEGER) AS part, n_turns, n_own_turns,
       CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY block
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin, text, masks, n_mask_chars
FROM parts WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY block)
"""
