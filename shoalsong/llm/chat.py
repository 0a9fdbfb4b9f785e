"""Multi-party perspective rotation: each dialogue once per participant, as if that one were the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalsong.llm.tables import not_null_key, running_total, staged

SYSTEM = "system"
NAMELESS = "unknown"
END = "<|end|>\n"


def perspectives(conversations: DataFrame) -> DataFrame:
    """One row per conversation, participant and message, in the order of the message.

    `conversations` has (conv_id, turn, role, text); the role is the speaker.
    For every participant but the system, all messages are rendered: those of
    the participant as assistant, the others' as users with their names, the
    system's as system. Columns: conv_id, perspective, position (from 0),
    speaker, rendered, begin and end of the rendering in the whole dialogue, and
    mask_begin and mask_end, the stretch to train on: text and end mark of the
    assistant's messages, null for others. All in code points. A dialogue is
    its `rendered` in order of position; it is never gathered here, so one that
    holds a third of all rows is spread like any other.

    Messages follow by turn, null first, then by speaker and text; equal rows
    are messages of their own. A null role is the speaker "unknown", a null text
    is empty, null conversation ids are one conversation. "<|" in a text or name
    becomes "< |", so no text can end its message. A conversation of system
    messages alone has no participant and no rows. Other columns are ignored.
    """
    def plain(column):
        return F.replace(column, F.lit("<|"), F.lit("< |"))

    messages = conversations.select(
        "conv_id", not_null_key(F.col("conv_id")).alias("conv"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(NAMELESS)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("one"))
    messages = staged(running_total(messages, ["conv"], ["turn", "speaker", "text"], "one", "position"), "messages")
    people = messages.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("perspective")).distinct()
    seen = messages.join(people, "conv")
    trained = F.col("speaker") == F.col("perspective")
    head = F.when(trained, F.lit("<|assistant|>\n")).when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).otherwise(
        F.concat(F.lit("<|user name="), plain(F.col("speaker")), F.lit("|>\n")))
    seen = seen.select(
        "conv_id", "conv", "perspective", "position", "speaker", trained.alias("trained"),
        F.length(head).cast("bigint").alias("n_head"), F.concat(head, plain(F.col("text")), F.lit(END)).alias("rendered"))
    seen = seen.withColumn("n", F.length("rendered").cast("bigint"))
    placed = running_total(seen, ["conv", "perspective"], ["position"], "n", "begin")
    end = F.col("begin") + F.col("n")
    return placed.select(
        "conv_id", "perspective", "position", "speaker", "rendered", "begin", end.alias("end"),
        F.when(F.col("trained"), F.col("begin") + F.col("n_head")).alias("mask_begin"),
        F.when(F.col("trained"), end).alias("mask_end"))


ORACLE = """
WITH m AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS position
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM m WHERE speaker <> 'system'),
r AS (
  SELECT m.conv_id, perspective, position, speaker, speaker = perspective AS trained,
         CASE WHEN speaker = perspective THEN '<|assistant|>' WHEN speaker = 'system' THEN '<|system|>'
              ELSE '<|user name=' || replace(speaker, '<|', '< |') || '|>' END || chr(10) AS head,
         replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rest
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (
  SELECT *, head || rest AS rendered,
         CAST(sum(length(head || rest)) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS BIGINT) AS "end"
  FROM r)
SELECT conv_id, perspective, position, speaker, rendered, "end" - length(rendered) AS "begin", "end",
       CASE WHEN trained THEN "end" - length(rest) END AS mask_begin, CASE WHEN trained THEN "end" END AS mask_end
FROM s
"""
