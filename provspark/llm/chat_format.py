"""Preference formatting of conversations, on DataFrame functions alone.

For a pair of conversations (chosen, rejected) the longest common prefix of
turns is rendered once as the prompt; the rest of each is its completion.  A
completion's mask names the stretches that a model is trained on: what assistant
turns say, with their end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprint import with_next

#: Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _plain(text: Column) -> Column:
    """Template marks inside a text are broken up, so that it can't pose as a turn."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_", "<| im_")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE + "\n"))), "")


def mask(turns: Column) -> Column:
    """Trained stretches as 'start-end' (code points, end exclusive), comma-joined."""
    kind = "struct<at:bigint,spans:array<string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("spans")).cast(kind)

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.concat(begin.cast("string"), F.lit("-"), end.cast("string"))
        spans = F.when(t["role"] == TRAINED_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).cast("long").alias("at"), spans.alias("spans")).cast(kind)

    return F.array_join(F.aggregate(turns, start, add)["spans"], ",")


def conversations_as_arrays(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text) in order of turn, role, text.

    turns needs conv_id, turn, role, text.  A null role is 'unknown', a null text
    empty, a null turn comes first; rows of a null conv_id belong to nothing.
    """
    cleaned = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", _plain(F.coalesce(F.col("role"), F.lit("unknown"))).alias("role"), _plain(F.col("text")).alias("text"))
    grouped = cleaned.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    return grouped.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Render pairs(pair_id, chosen, rejected), both arrays of (role, text).

    Returns pair_id, n_common, prompt, chosen, rejected, chosen_mask,
    rejected_mask.  Equal conversations have empty completions; a null array is
    an empty conversation.
    """
    empty = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    p = pairs.select("pair_id", F.coalesce("chosen", empty).alias("c"), F.coalesce("rejected", empty).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    differing = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (i > least) | ~F.get("c", i - 1).eqNullSafe(F.get("r", i - 1)))
    p = p.withColumn("n_common", F.coalesce(F.get(differing, F.lit(0)) - 1, least).cast("long"))
    n = F.col("n_common").cast("int")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    return p.select(
        "pair_id",
        "n_common",
        render(F.slice("c", F.lit(1), n)).alias("prompt"),
        render(rest("c")).alias("chosen"),
        render(rest("r")).alias("rejected"),
        mask(rest("c")).alias("chosen_mask"),
        mask(rest("r")).alias("rejected_mask"),
    )


def reply_pairs(turns: DataFrame) -> DataFrame:
    """Pairs of each conversation that an assistant speaks in, up to its last reply:
    chosen as it is, rejected with that reply replaced by the last reply of the
    next such conversation in descending conv_id (after the last: the first)."""
    convs = conversations_as_arrays(turns)
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), TRAINED_ROLE).cast("int") + 1
    spoken = convs.where(F.array_contains(F.transform("turns", lambda t: t["role"]), TRAINED_ROLE)).withColumn("at", at)
    spoken = spoken.select(F.col("conv_id").alias("doc_id"), F.slice("turns", F.lit(1), F.col("at")).alias("chosen"), F.get("turns", F.col("at") - 1)["text"].alias("text"))
    paired = with_next(spoken, ["text"])
    reply = F.struct(F.lit(TRAINED_ROLE).alias("role"), F.col("next_text").alias("text"))
    return paired.select(F.col("doc_id").alias("pair_id"), "chosen", F.concat(F.slice("chosen", F.lit(1), F.size("chosen") - 1), F.array(reply)).alias("rejected"))


def preference_query(turns: DataFrame) -> DataFrame:
    return format_pairs(reply_pairs(turns)).withColumnRenamed("pair_id", "conv_id")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
l AS (SELECT conv_id, max(k) AS k FROM n WHERE role = 'assistant' GROUP BY conv_id),
r AS (SELECT n.conv_id, n.k, n.text FROM n JOIN l ON n.conv_id = l.conv_id AND n.k = l.k),
x AS (SELECT conv_id, k, text, coalesce(lead(text) OVER (ORDER BY conv_id DESC), first_value(text) OVER (ORDER BY conv_id DESC)) AS other FROM r),
p AS (SELECT n.conv_id, string_agg('<|im_start|>' || n.role || chr(10) || n.text || '<|im_end|>' || chr(10), '' ORDER BY n.k) AS prompt
      FROM n JOIN x ON n.conv_id = x.conv_id AND (n.k < x.k OR (n.k = x.k AND x.text = x.other)) GROUP BY n.conv_id)
SELECT x.conv_id, CAST(CASE WHEN x.text = x.other THEN x.k ELSE x.k - 1 END AS BIGINT) AS n_common, coalesce(p.prompt, '') AS prompt,
       CASE WHEN x.text = x.other THEN '' ELSE '<|im_start|>assistant' || chr(10) || x.text || '<|im_end|>' || chr(10) END AS chosen,
       CASE WHEN x.text = x.other THEN '' ELSE '<|im_start|>assistant' || chr(10) || x.other || '<|im_end|>' || chr(10) END AS rejected,
       CASE WHEN x.text = x.other THEN '' ELSE '22-' || CAST(32 + length(x.text) AS VARCHAR) END AS chosen_mask,
       CASE WHEN x.text = x.other THEN '' ELSE '22-' || CAST(32 + length(x.other) AS VARCHAR) END AS rejected_mask
FROM x LEFT JOIN p ON x.conv_id = p.conv_id
"""
