"""Chat formatting: every dialogue once from each participant's point of view.

In a perspective its own speaker is the assistant and the others are named users; the
mask holds the places of what that speaker says, which alone is learnt from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CHUNK = 512  # turn numbers in one row; longer dialogues go on in further rows
CONTEXT = ("system",)  # roles that are not participants


def perspectives(turns: DataFrame, chunk: int = CHUNK, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """One row per conversation, participant and chunk: conv_id, speaker, part, n_turns, text, mask, n_masked.

    Turns are ordered by number, then role and text, null numbers last (a part of their own,
    null). A null role is the participant "unknown", a null text is empty, repeated rows are
    repeated turns. Roles of `context` speak in every perspective but have none. mask is
    "start:stop,..." in code points of text, the spoken words and their end mark. Other
    columns are not read. Conversations without participants give no rows.
    """
    own = turns.select(F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    who = own.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    parts = own.groupBy("conv_id", F.floor(F.col("turn") / chunk).alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = parts.join(who, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    head = lambda t: F.when(t.role == F.col("speaker"), F.lit("<|im_start|>assistant\n")).when(t.role.isin(*context), F.concat(F.lit("<|im_start|>"), t.role, F.lit("\n"))).otherwise(F.concat(F.lit("<|im_start|>user name="), t.role, F.lit("\n")))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t.text, F.lit("<|im_end|>")).alias("body"), (t.role == F.col("speaker")).alias("mine")))
    rows = rows.select("conv_id", "speaker", "part", pieces.alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("n"))

    def step(s, x):
        a = s["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.concat(a.cast("string"), F.lit(":"), b.cast("string"))
        return F.struct((b + 1).cast("long").alias("at"), F.when(x["mine"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"), F.when(x["mine"], s["n"] + (b - a)).otherwise(s["n"]).cast("long").alias("n"))

    rows = rows.select("conv_id", "speaker", "part", F.size("p").cast("long").alias("n_turns"), text.alias("text"), F.aggregate("p", start, step).alias("m"))
    return rows.select("conv_id", "speaker", "part", "n_turns", "text", F.array_join("m.spans", ",").alias("mask"), F.col("m.n").alias("n_masked"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


OP2_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (SELECT t.conv_id, speaker, CAST(floor(turn / 512) AS BIGINT) AS part, turn, t.role, t.text, t.role = speaker AS mine,
  CASE WHEN t.role = speaker THEN '<|im_start|>assistant' || chr(10) WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
       ELSE '<|im_start|>user name=' || t.role || chr(10) END AS head, t.text || '<|im_end|>' AS body
  FROM t JOIN w ON t.conv_id = w.conv_id),
s AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM p)
SELECT conv_id, speaker, part, CAST(count(*) AS BIGINT) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS text,
  coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (WHERE mine), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (WHERE mine), 0) AS BIGINT) AS n_masked
FROM s GROUP BY conv_id, speaker, part
"""
