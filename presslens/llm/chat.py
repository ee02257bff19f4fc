"""Chat formatting with cumulative-snapshot collapse.

A chat log often holds every state of a conversation: two turns, then four, then six.  The turns of each
conversation are ordered, every prefix gets a rolling 128-bit hash (two running exclusive-ors of hashes
bound to position, role and text), and a conversation whose hash equals a proper prefix of a longer one is
removed by an anti-join.  Equal conversations collapse to the one with the smallest id.  Only what is left
is rendered.

Defined results: turns are ordered by (turn, role, text), nulls first, and wholly repeated turns count once;
a null role renders as ``unknown`` and a null text as empty, but neither equals the string itself when
conversations are compared; rows without ``conv_id`` belong to no conversation and are left out; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from presslens.llm.common import staged


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """conv_id and its ordered turns."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return (turns.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).alias("conv_id"))
            .agg(F.sort_array(F.collect_set(one)).alias("turns")))


def prefix_hashes(convs: DataFrame) -> DataFrame:
    """conv_id, pos (1 for the first turn), total and the rolling hash (a, b) of the first ``pos`` turns."""
    flat = convs.select("conv_id", F.size("turns").alias("total"), F.posexplode("turns").alias("p", "t")).select(
        "conv_id", "total", (F.col("p") + 1).alias("pos"),
        *[F.xxhash64(F.lit(seed), F.col("p"), F.col("t.role").isNull(), F.coalesce("t.role", F.lit("")),
                     F.col("t.text").isNull(), F.coalesce("t.text", F.lit(""))).alias(name)
          for seed, name in ((11, "ha"), (23, "hb"))])
    so_far = W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return flat.select("conv_id", "total", "pos", F.bit_xor("ha").over(so_far).alias("a"), F.bit_xor("hb").over(so_far).alias("b"))


def maximal(convs: DataFrame) -> DataFrame:
    """conv_id and n_copies of the conversations that no longer one begins with."""
    hashes = staged(prefix_hashes(convs), "prefixes")
    whole = hashes.filter("pos = total").groupBy("pos", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = hashes.filter("pos < total").select("pos", "a", "b").distinct()
    return whole.join(begun, ["pos", "a", "b"], "left_anti").select("conv_id", "n_copies")


def render(turns: str = "turns") -> Column:
    """``<|role|>`` line, text, ``<|end|>`` line for every turn."""
    return F.array_join(F.transform(F.col(turns), lambda t: F.concat(
        F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")),
        F.lit("\n<|end|>\n"))), "")


def collapse_and_format(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies, chat: one row per maximal conversation."""
    convs = staged(conversations(turns, conv, turn, role, text), "conversations")
    return convs.join(maximal(convs), "conv_id").select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), "n_copies", render().alias("chat"))


ORACLE = r"""
WITH c AS (SELECT conv_id, list_sort(list(DISTINCT {'turn': turn, 'role': role, 'text': text})) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, turns, list_transform(turns, lambda t: {'role': t.role, 'text': t.text}) AS body FROM c),
begun AS (SELECT DISTINCT body[1:n] AS body FROM (SELECT body, unnest(range(1, len(body))) AS n FROM k)),
whole AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, body FROM k GROUP BY body)
SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_copies,
       array_to_string(list_transform(turns, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10)
                                      || coalesce(t.text, '') || chr(10) || '<|end|>' || chr(10)), '') AS chat
FROM k JOIN (SELECT conv_id, n_copies FROM whole WHERE NOT EXISTS (SELECT 1 FROM begun WHERE begun.body = whole.body)) USING (conv_id)
"""
