"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs hold a conversation again after each exchange, so shorter snapshots prefix longer ones. Each turn has two 64-bit hashes of its number, role
and text; their running exclusive-or over a conversation's turns is a rolling fingerprint of every prefix (128 bits and a count).
A conversation whose whole fingerprint is a proper prefix of another's is taken out by an anti-join on the fingerprints;
of equal conversations the least conv_id stays. The rest is rendered.

Running values are formed in two levels (blocks of turns, then turns within a block), and a conversation is rendered in parts of a bounded
number of turns, so one huge conversation is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, PART = 1024, 256


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null").distinct()


def _hashed(turns: DataFrame) -> DataFrame:
    parts = [F.col("turn"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return turns.select(
        "conv_id", "turn", F.floor(F.col("turn") / BLOCK).alias("block"),
        F.xxhash64(F.lit(1), *parts).alias("e1"), F.xxhash64(F.lit(2), *parts[::-1]).alias("e2"),
    )


def prefix_fingerprints(turns: DataFrame) -> DataFrame:
    """conv_id, turn, n, p1, p2: count and fingerprint of the turns up to each one."""
    rows = _hashed(turns)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"), F.count("*").alias("bn"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(b).over(earlier), F.lit(0).cast("long")).alias(b) for b in ("b1", "b2")],
        F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("bn"),
    )
    within = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    inner = rows.select(
        "conv_id", "block", "turn", F.bit_xor("e1").over(within).alias("p1"), F.bit_xor("e2").over(within).alias("p2"), F.count("*").over(within).alias("n")
    )
    return inner.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "turn", (F.col("n") + F.col("bn")).alias("n"), F.col("p1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("p2")
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id of the conversations that are no proper prefix of another, one of each set of equal ones."""
    turns = _turns(conversations)
    whole = _hashed(turns).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").alias("n"), F.bit_xor("e1").alias("p1"), F.bit_xor("e2").alias("p2"))
    one_each = whole.groupBy("turn", "n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    last = whole.select("conv_id", F.col("turn").alias("last"))
    proper = prefix_fingerprints(turns).join(last, "conv_id").where("turn < last").select("turn", "n", "p1", "p2").distinct()
    return one_each.join(proper, ["turn", "n", "p1", "p2"], "left_anti").select("conv_id")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns and rendered of every part (256 turn numbers) of every maximal conversation.

    Turns are in the order of turn, role, text. Rows without conv_id or turn belong to no conversation; exactly repeated rows
    count once; a null role renders as ``unknown``, a null text as nothing. Other columns are ignored.
    """
    turns = _turns(conversations).join(maximal_conversations(conversations), "conv_id", "left_semi")
    role, text = (F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit("")))
    said = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    parts = turns.groupBy("conv_id", F.floor(F.col("turn") / PART).cast("long").alias("part")).agg(
        F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text", said.alias("said")))).alias("turns")
    )
    return parts.select("conv_id", "part", "n_turns", F.array_join(F.transform("turns", lambda t: t["said"]), "").alias("rendered"))


ORACLE = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
whole AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS said, count(*) AS n, max(turn) AS last FROM turns GROUP BY conv_id),
one_each AS (SELECT min(conv_id) AS conv_id, said, n, last FROM whole GROUP BY said, n, last),
prefixed AS (SELECT DISTINCT a.conv_id FROM one_each a JOIN one_each b ON b.n > a.n AND b.last > a.last AND b.said[1] = a.said[1] AND b.said[1:a.n] = a.said),
stay AS (SELECT conv_id FROM one_each ANTI JOIN prefixed USING (conv_id))
SELECT conv_id, (turn // {PART})::BIGINT AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM turns SEMI JOIN stay USING (conv_id) GROUP BY conv_id, turn // {PART}
"""
