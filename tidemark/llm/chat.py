"""Preference formatting for chat models, in DataFrame functions only.

A pair is a chosen and a rejected conversation. The longest prefix of turns that both share (same roles, same texts, in
order) is rendered once, as the prompt; what follows in each is a completion, with a mask of the stretches to learn from:
the assistant's texts and the sign that ends them. One shuffle, by pair; a row holds one pair, as its result must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents_only, table

END = "<|end|>"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(f"{END}\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column, learn: str) -> Column:
    """Spans (start, end), code points, end exclusive, of the texts of role `learn` and their end signs in the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        first = a["at"] + F.length(t["role"]) + 5
        last = first + F.length(t["text"]) + len(END)
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct((last + 1).alias("at"), F.when(t["role"] == learn, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_preferences(chosen: DataFrame, rejected: DataFrame, learn: str = "assistant") -> DataFrame:
    """chosen, rejected (pair_id, turn, role, text) -> pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Turns are ordered by turn, role, text; a repeated row counts once; a null turn comes first, a null role is "unknown", a
    null text empty. Rows without pair_id belong to no pair and are left out. A pair of which one side is missing has an
    empty prompt and an empty completion on that side; equal conversations are all prompt.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        turn = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        return documents_only(df, "pair_id", "turn", "role", "text").where("pair_id is not null").select("pair_id", F.lit(name).alias("side"), turn.alias("t"))

    both = side(chosen, "c").union(side(rejected, "r"))
    turns = both.groupBy("pair_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("t")))).alias(s) for s in "cr"])
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    n = F.when(F.array_position(same, False) > 0, F.array_position(same, False).cast("int") - 1).otherwise(F.size(same))
    cut = turns.withColumn("n", n)
    rest = cut.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), *[F.slice(s, F.col("n") + 1, F.size(s)).alias(s) for s in "cr"])
    return rest.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), _joined(F.col("p")).alias("prompt"), _joined(F.col("c")).alias("chosen"), _joined(F.col("r")).alias("rejected"), _mask(F.col("c"), learn).alias("chosen_mask"), _mask(F.col("r"), learn).alias("rejected_mask"))


def repeated_replies(conversations: DataFrame) -> DataFrame:
    """Rejected versions of conversations (pair_id, turn, role, text), for a table that has no preferences.

    The last assistant turn repeats the assistant turn before it or, if there is none, the last other turn before it.
    """
    of = Window.partitionBy("pair_id")
    rows = documents_only(conversations, "pair_id", "turn", "role", "text").withColumn("last", F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(of))
    earlier = F.col("turn") < F.col("last")
    rows = rows.withColumn("from", F.coalesce(F.max(F.when(earlier & (F.col("role") == "assistant"), F.col("turn"))).over(of), F.max(F.when(earlier, F.col("turn"))).over(of)))
    donor = F.coalesce(F.min(F.when(F.col("turn") == F.col("from"), F.col("text"))).over(of), F.lit(""))
    swap = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant")
    return rows.select("pair_id", "turn", "role", F.when(swap, donor).otherwise(F.col("text")).alias("text"))


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents_only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "pair_id")
    made = format_preferences(turns, repeated_replies(turns))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(c)
    return made.select(F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", "rejected", shown("chosen_mask"), shown("rejected_mask"))


def _sql_side(s: str, name: str) -> str:
    return f"""coalesce(string_agg('<|' || {s}_role || '|>' || chr(10) || {s}_text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i > n AND {s}_role IS NOT NULL), '') AS {name},
coalesce(string_agg(({s}_upto - {s}_base - length({s}_text) - 8) || ':' || ({s}_upto - {s}_base - 1), ',' ORDER BY i) FILTER (i > n AND {s}_role = 'assistant'), '') AS {name}_mask"""


SQL = {
    "op1_preference": f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT *, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last FROM t),
f AS (SELECT *, coalesce(max(turn) FILTER (role = 'assistant' AND turn < last) OVER (PARTITION BY conv_id), max(turn) FILTER (turn < last) OVER (PARTITION BY conv_id)) AS src FROM l),
g AS (SELECT *, coalesce(min(text) FILTER (turn = src) OVER (PARTITION BY conv_id), '') AS donor FROM f),
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role AS c_role, text AS c_text, role AS r_role, CASE WHEN turn = last AND role = 'assistant' THEN donor ELSE text END AS r_text FROM g),
p AS (SELECT *, coalesce(min(i) FILTER (c_text <> r_text) OVER (PARTITION BY conv_id) - 1, max(i) OVER (PARTITION BY conv_id)) AS n,
  sum(length(c_role) + length(c_text) + 13) OVER (PARTITION BY conv_id ORDER BY i) AS c_upto, sum(length(r_role) + length(r_text) + 13) OVER (PARTITION BY conv_id ORDER BY i) AS r_upto FROM c),
b AS (SELECT *, coalesce(max(c_upto) FILTER (i <= n) OVER (PARTITION BY conv_id), 0) AS c_base, coalesce(max(r_upto) FILTER (i <= n) OVER (PARTITION BY conv_id), 0) AS r_base FROM p)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_prompt_turns, coalesce(string_agg('<|' || c_role || '|>' || chr(10) || c_text || '<|end|>' || chr(10), '' ORDER BY i) FILTER (i <= n), '') AS prompt,
{_sql_side("c", "chosen")},
{_sql_side("r", "rejected")}
FROM b GROUP BY conv_id
""",
}
