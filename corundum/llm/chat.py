"""Multi-party chat formatting by perspective rotation, with DataFrame functions only.

Every participant of a conversation takes the assistant's seat in turn.  The
dialogue is rendered with that speaker's turns as assistant and the others' as
named users; turns of context roles (system) keep their role and are nobody's
perspective.  The mask covers the assistant's words and the end of the turn.

The rendering is returned turn by turn with its offsets in the whole, so that
no conversation has to fit in a task.  Offsets are prefix sums over lengths
alone, dealt into ranges of (conversation, perspective, turn), within a range
and over the ranges; texts are shuffled once and meet their offsets at the end.

Nothing said can look like a header: in texts ``<|`` becomes ``<\\|`` (and
``<\\`` becomes ``<\\\\``, so that it can be undone), in names ``|`` becomes
``\\|`` and ``\\`` doubles.  ``perspective`` holds the plain name.

Cases: a null text is empty, a null role is the speaker ``unknown``, an empty
role a speaker with an empty name; rows of a null conversation form one; a null
turn comes last; equal turns are ordered by speaker, then by a digest of the
text, and repeated rows are rendered as often as they come; a conversation of
context turns only has no perspective; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

CONTEXT = ("system",)
#: Turns (by perspective) whose offsets a task adds up.
ROWS_PER_TASK = 1_000_000


def _seat(context: tuple[str, ...]) -> Column:
    return F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker").isin(*context), F.col("speaker")).otherwise("user")


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def _name(speaker: Column) -> Column:
    return _swap(_swap(speaker, "\\", "\\\\"), "|", "\\|")


def _said(text: Column) -> Column:
    return _swap(_swap(text, "<\\", "<\\\\"), "<|", "<\\|")


def _head() -> Column:
    return F.when(F.col("seat") == "user", F.concat(F.lit("<|user:"), _name(F.col("speaker")), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), _name(F.col("seat")), F.lit("|>\n")))


def rotate(conversations: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """A row for each conversation, perspective and turn."""
    said = conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    name = F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    digest = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("turn").cast("string"), F.lit("")), "speaker", "text")))
    said = said.withColumn("key", name).withColumn("h", digest).withColumn("text", _said(F.col("text")))

    # lengths and offsets: no text is in here
    sizes = said.select("key", "h", "turn", "speaker", F.length("text").alias("size")).groupBy("key", "h", "turn", "speaker", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = checkpoint(sizes)
    seats = sizes.filter(~F.col("speaker").isin(*context)).select("key", F.col("speaker").alias("perspective")).distinct()
    rows = sizes.join(seats, "key").withColumn("seat", _seat(context))
    rows = checkpoint(rows.select("key", "h", "perspective", "turn", "speaker", ((F.length(_head()) + F.col("size") + 1) * F.col("n")).alias("chars")))
    whole, order = ["key", "perspective"], [F.col("turn").asc_nulls_last(), "speaker", "h"]
    rows = rows.repartitionByRange(max(1, -(-rows.count() // ROWS_PER_TASK)), *whole, *order)
    rows = checkpoint(rows.withColumn("part", F.spark_partition_id()))
    past = Window.partitionBy(*whole).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*whole, "part").agg(F.sum("chars").alias("chars")).select(*whole, "part", F.coalesce(F.sum("chars").over(past), F.lit(0)).alias("begin"))
    within = Window.partitionBy(*whole, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    starts = rows.join(parts, [*whole, "part"]).select("key", "h", "perspective", (F.col("begin") + F.col("before")).alias("begin"))

    # the digest stands for turn, speaker and text: rows that repeat are counted before they are sent
    once = said.groupBy("key", "h").agg(*(F.first(c).alias(c) for c in ("conv_id", "turn", "speaker", "text")), F.count(F.lit(1)).alias("n"))
    out = once.join(starts, ["key", "h"]).withColumn("seat", _seat(context)).withColumn("head", _head())
    out = out.withColumn("segment", F.concat("head", "text", F.lit("\n"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    out = out.withColumn("char_start", F.col("begin") + F.col("copy") * F.length("segment")).withColumn("char_end", F.col("char_start") + F.length("segment"))
    mine = F.col("seat") == "assistant"
    return out.select("conv_id", "perspective", "turn", "seat", "segment", "char_start", "char_end", F.when(mine, F.col("char_start") + F.length("head")).alias("mask_start"), F.when(mine, F.col("char_end")).alias("mask_end"))


ORACLE = r"""
WITH s AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM s WHERE speaker <> 'system'),
r AS (SELECT s.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS seat
      FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN seat = 'user' THEN '<|user:' || replace(replace(speaker, '\', '\\'), '|', '\|') || '|>' ELSE '<|' || seat || '|>' END || chr(10) AS head FROM r),
g AS (SELECT *, head || replace(replace(text, '<\', '<\\'), '<|', '<\|') || chr(10) AS segment FROM h),
e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, md5(concat_ws('|', coalesce(CAST(turn AS VARCHAR), ''), speaker, text)) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS char_end FROM g)
SELECT conv_id, perspective, turn, seat, segment, CAST(char_end - length(segment) AS BIGINT) AS char_start, char_end,
       CASE WHEN seat = 'assistant' THEN CAST(char_end - length(segment) + length(head) AS BIGINT) END AS mask_start,
       CASE WHEN seat = 'assistant' THEN char_end END AS mask_end
FROM e
"""
