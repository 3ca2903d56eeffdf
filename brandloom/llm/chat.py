"""Multi-party chat formatting: every participant's view, in DataFrame operations only.

For each participant of a conversation the whole dialogue is rendered with
that speaker as the assistant and all others as named users. Each turn becomes
one segment; character offsets place it in the rendering, and a mask tells
which characters are trained on: the speaker's own words and their end mark.

The turns are dealt to tasks by ranges of their order, so a conversation of any
length, or with any number of turns without a number or with the same one, is
spread: positions and offsets are counted inside each range first, the totals
of the ranges are summed over the conversation, and both are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandloom.llm.common import stage

OPEN, END = "<|im_start|>", "<|im_end|>\n"
#: Characters of a text that ranges go by; bounds the sample that Spark takes of the order.
PREFIX = 32
#: Speakers that are rendered as themselves in every view and have none of their own.
NARRATORS = ("system",)
NOBODY = "unknown"


def _header(speaker: Column, view: Column) -> Column:
    who = F.when(speaker.isin(*NARRATORS), speaker).when(speaker == view, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), speaker))
    return F.concat(F.lit(OPEN), who, F.lit("\n"))


def rotate(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per turn and perspective of turns (conv_id, turn, role, text).

    Result: conv_id, perspective, seq (from 0, by turn, role, text; null turns
    last), role_as (assistant, user or the narrator), segment, start, length
    (characters), train_start, train_end (offsets in the rendering; equal
    where nothing is trained on). `role` is the speaker; a null or empty one is
    "unknown" and a null text is empty. A repeated turn stays, as a turn of its
    own. Null conv_ids are one conversation. A conversation with narrators
    only has no participant and gives no row, as does an empty table. Texts of
    any length are rendered whole; texts and names are not escaped, so one that
    holds the marks of a turn reads as one, and should be cleaned before.

    `ranges` is the number of ranges, by default Spark's own. Turns that agree
    in conversation, number, speaker and the first PREFIX characters meet in one
    task; equal ones are interchangeable.
    """
    # a key that is never null, so that joins and windows share one partitioning
    key = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    t = turns.select(
        "conv_id",
        key.alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.coalesce("role", F.lit("")) == "", F.lit(NOBODY)).otherwise(F.col("role")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = ["conv", F.col("turn").asc_nulls_last(), "speaker", F.left("text", F.lit(PREFIX))]
    # staged with its range's number, so that every reader sees the same ranges
    t = stage((t.repartitionByRange(ranges, *order) if ranges else t.repartitionByRange(*order)).withColumn("part", F.spark_partition_id()), "turns")
    # views meet the parts of their conversation first: its turns never meet in one task
    views = t.where(~F.col("speaker").isin(*NARRATORS)).select("conv", F.col("speaker").alias("perspective")).distinct()
    seen = t.join(t.select("conv", "part").distinct().join(views, "conv"), ["conv", "part"])
    header = _header(F.col("speaker"), F.col("perspective"))
    seen = seen.select("*", F.concat(header, "text", F.lit(END)).alias("segment"), F.length(header).alias("head")).withColumn("length", F.length("segment").cast("long"))
    keys = ["conv", "part", "perspective"]
    inside = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.select("*", (F.row_number().over(inside) - 1).alias("k"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("at"))
    totals = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"))
    whole = placed.join(sums, keys)
    start = F.col("at") + F.col("chars_before")
    own = F.col("speaker") == F.col("perspective")
    words = start + F.col("head")
    return whole.select(
        "conv_id",
        "perspective",
        (F.col("k") + F.col("n_before")).cast("long").alias("seq"),
        F.when(F.col("speaker").isin(*NARRATORS), F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role_as"),
        "segment",
        start.alias("start"),
        "length",
        words.alias("train_start"),
        F.when(own, start + F.col("length")).otherwise(words).alias("train_end"),
    )


def assemble(segments: DataFrame, block: int = 64) -> DataFrame:
    """Renderings of `rotate`'s segments in pieces of `block` turns.

    (conv_id, perspective, piece, start, text, masks): masks are the trained
    [from, to) of the piece's text. Joined by piece, the texts are the whole.
    """
    rows = segments.withColumn("piece", F.floor(F.col("seq") / block))
    packed = rows.groupBy("conv_id", "perspective", "piece").agg(
        F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("seq", "segment", "train_start", "train_end"))).alias("s")
    )
    masks = F.transform(
        F.filter("s", lambda x: x["train_start"] < x["train_end"]),
        lambda x: F.struct((x["train_start"] - F.col("start")).alias("from"), (x["train_end"] - F.col("start")).alias("to")),
    )
    return packed.select("conv_id", "perspective", "piece", "start", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("text"), masks.alias("masks"))


DUCKDB_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE role END AS speaker, coalesce(text, '') AS text FROM conversations
), v AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
    '<|im_start|>' || CASE WHEN speaker = 'system' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
  FROM t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id
), p AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM s
), o AS (
  SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM p WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text)
)
SELECT conv_id, perspective, seq::BIGINT AS seq,
  CASE WHEN speaker = 'system' THEN speaker WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role_as,
  segment, start::BIGINT AS start, length(segment)::BIGINT AS length, (start + length(head))::BIGINT AS train_start,
  (start + CASE WHEN speaker = perspective THEN length(segment) ELSE length(head) END)::BIGINT AS train_end
FROM o
"""
