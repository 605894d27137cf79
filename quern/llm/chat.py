"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is the prompt of both.

Turns are in the order of their number, then role and text. The prompt is rendered once; each completion is the rest of
its conversation, with a mask that trains on what assistants say: two `length:flag` for each turn, in characters of the rendering, one for
its header, which is never trained on, and one for its text with the line end that closes the turn. In roles and texts `<|` is
rendered as `<\\|`, so that no text can open a turn.

A null role is rendered as `unknown`, a null text as empty, a null turn number comes first; repeated rows are turns
each, and ties of number, role and text are equal turns. Rows without a conversation id take no part. A pair that lacks a side has
an empty prompt and completion there. A pair is one training record, so its turns, however long, meet in one row; only the
turns of a pair do. Columns of other names are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turn: Column) -> Column:
    return F.concat(header(turn), turn["text"], F.lit("\n"))


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def format_pairs(turns: DataFrame) -> DataFrame:
    """turns: (pair_id, side (0 chosen, 1 rejected), conv_id, turn, role, text). One row for each pair."""
    turns = turns.withColumns({"role": escaped(F.coalesce("role", F.lit("unknown"))), "text": escaped(F.coalesce("text", F.lit("")))})
    order = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(order))
    sides = [F.max(F.when(F.col("side") == k, F.struct("role", "text"))).alias(name) for k, name in enumerate(("c", "r"))]
    both = turns.groupBy("pair_id", "pos").agg(*sides)
    differ = F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("pos")))
    pairs = both.groupBy("pair_id").agg((F.coalesce(differ, F.max("pos") + 1) - 1).alias("n_prompt_turns"), F.sort_array(F.collect_list(F.struct("pos", "c", "r"))).alias("turns"))

    def joined(side: str, part: Column) -> Column:
        return F.array_join(F.transform(F.filter(part, lambda t: t[side].isNotNull()), lambda t: rendered(t[side])), "")

    def mask(side: str, part: Column) -> Column:
        flag = lambda t: F.concat(F.length(header(t[side])), F.lit(":0,"), F.length(t[side]["text"]) + 1, F.when(t[side]["role"] == "assistant", ":1").otherwise(":0"))
        return F.array_join(F.transform(F.filter(part, lambda t: t[side].isNotNull()), flag), ",")

    before = F.filter("turns", lambda t: t["pos"] <= F.col("n_prompt_turns"))
    after = F.filter("turns", lambda t: t["pos"] > F.col("n_prompt_turns"))
    return pairs.select(
        "pair_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), joined("c", before).alias("prompt"),
        joined("c", after).alias("chosen"), joined("r", after).alias("rejected"), mask("c", after).alias("chosen_mask"), mask("r", after).alias("rejected_mask"),
    )


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are pair k."""
    turns = common.table(spark, sf_dir, "conversations").filter("conv_id is not null")
    side = F.pmod("conv_id", F.lit(2)).cast("int")
    return format_pairs(turns.select(F.shiftright("conv_id", 1).alias("pair_id"), side.alias("side"), "conv_id", "turn", "role", "text"))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\|') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations WHERE conv_id IS NOT NULL)),
x AS (SELECT *, '<|' || role || '|>' || chr(10) || text || chr(10) AS s FROM t),
b AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.pos, r.pos) AS pos, c.s AS c, r.s AS r, c.role AS c_role, r.role AS r_role
  FROM (SELECT * FROM x WHERE side = 0) c FULL JOIN (SELECT * FROM x WHERE side = 1) r ON c.pair_id = r.pair_id AND c.pos = r.pos),
p AS (SELECT pair_id, coalesce(min(pos) FILTER (WHERE c IS DISTINCT FROM r), max(pos) + 1) - 1 AS n FROM b GROUP BY pair_id)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos <= n AND c IS NOT NULL), '') AS prompt,
       coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos > n AND c IS NOT NULL), '') AS chosen,
       coalesce(string_agg(r, '' ORDER BY pos) FILTER (WHERE pos > n AND r IS NOT NULL), '') AS rejected,
       coalesce(string_agg((length(c_role) + 5) || ':0,' || (length(c) - length(c_role) - 5) || CASE WHEN c_role = 'assistant' THEN ':1' ELSE ':0' END, ',' ORDER BY pos) FILTER (WHERE pos > n AND c IS NOT NULL), '') AS chosen_mask,
       coalesce(string_agg((length(r_role) + 5) || ':0,' || (length(r) - length(r_role) - 5) || CASE WHEN r_role = 'assistant' THEN ':1' ELSE ':0' END, ',' ORDER BY pos) FILTER (WHERE pos > n AND r IS NOT NULL), '') AS rejected_mask
FROM b JOIN p USING (pair_id) GROUP BY pair_id
"""
