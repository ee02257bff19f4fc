"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``nodes`` points of a 64-bit ring.  A document hashes to a point and belongs to the next
virtual node clockwise; when that node's shard is full the document continues to the next node whose shard
has room.  Capacities add up to the number of documents exactly (law ``rows``): shard sizes differ by one
row at most, while a document only moves when the ring around it or the fill of its shard changes.

The overflow is worked out on counts: documents per arc (``shards * nodes`` numbers, a size set by the
parameters and not by the data) are walked around the ring on the driver, which yields cuts (arc, rank) ->
(shard, slot).  Rows then need one window by arc and a lookup of the cuts.

Defined results: a null text has no bytes and CRC 0; null or repeated ``doc_id`` are allowed (the ring key
is the id with the text's CRC, ties go on by size); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from presslens.llm.common import text_or_empty

#: Virtual nodes of each shard.
NODES = 256


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted signed 64-bit positions of the virtual nodes and the shard of each."""
    points = sorted((int.from_bytes(hashlib.blake2b(f"{s}#{v}".encode(), digest_size=8).digest(), "big", signed=True), s)
                    for s in range(shards) for v in range(nodes))
    return np.array([p for p, _ in points], dtype=np.int64), np.array([s for _, s in points], dtype=np.int64)


def capacities(total: int, shards: int) -> list[int]:
    """Rows each shard may take; they add up to ``total``."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: np.ndarray, owners: np.ndarray, capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """Cuts (arc, first rank, shard, first slot): where the documents of every arc end up.

    Step by step all waiting runs move one node clockwise; a node takes what its shard still has room for,
    lowest ranks first, and passes the rest on.
    """
    room = list(capacity)
    waiting = {a: [(a, 0, int(c))] for a, c in enumerate(counts) if c}
    taken: list[tuple[int, int, int, int]] = []
    while waiting:
        moved: dict[int, list[tuple[int, int, int]]] = {}
        for node in sorted(waiting):
            shard = int(owners[node])
            for arc, start, n in waiting[node]:
                fits = min(n, room[shard])
                if fits:
                    taken.append((arc, start, shard, fits))
                    room[shard] -= fits
                if n > fits:
                    moved.setdefault((node + 1) % len(owners), []).append((arc, start + fits, n - fits))
        waiting = moved
    cuts, slot = [], [0] * len(capacity)
    for arc, start, shard, n in sorted(taken):
        cuts.append((arc, start, shard, slot[shard]))
        slot[shard] += n
    return cuts


def assign_shards(rows: DataFrame, key: list[str], shards: int, nodes: int = NODES) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless within the shard); ``key`` places a row on the ring."""
    points, owners = ring(shards, nodes)

    @F.pandas_udf("int")
    def arc_of(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(points, h.to_numpy(), side="left") % len(points)).astype(np.int32))

    placed = rows.withColumn("__h", F.xxhash64(*key)).withColumn("__arc", arc_of("__h"))
    counted = placed.groupBy("__arc").count().collect()  # shards * nodes rows at most
    counts = np.zeros(len(points), dtype=np.int64)
    for r in counted:
        counts[r["__arc"]] = r["count"]
    cuts = walk(counts, owners, capacities(int(counts.sum()), shards))
    by_arc: dict[int, list[tuple[int, int, int]]] = {}
    for arc, start, shard, slot in cuts:
        by_arc.setdefault(arc, []).append((start, shard, slot))
    cut_key = np.array([(arc << 40) + start for arc, start, _, _ in cuts], dtype=np.int64)
    cut_shard = np.array([c[2] for c in cuts], dtype=np.int64)
    cut_slot = np.array([c[3] for c in cuts], dtype=np.int64)

    @F.pandas_udf("struct<shard: int, slot: bigint>")
    def settle(arc: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = (arc.to_numpy().astype(np.int64) << 40) + rank.to_numpy().astype(np.int64)
        i = np.searchsorted(cut_key, k, side="right") - 1
        return pd.DataFrame({"shard": cut_shard[i].astype(np.int32), "slot": cut_slot[i] + (k - cut_key[i])})

    rank = F.row_number().over(W.partitionBy("__arc").orderBy("__h", *rows.columns)) - 1
    ranked = placed.withColumn("__rank", rank.cast("bigint")).withColumn("__to", settle("__arc", "__rank"))
    return ranked.select(*rows.columns, F.col("__to.shard").alias("shard"), F.col("__to.slot").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text",
                    nodes: int = NODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``)."""
    digest = docs.select(F.col(id_col).alias("doc_id"),
                         (F.octet_length(text_or_empty(text)) + 8).cast("bigint").alias("size"),
                         F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"))
    out = assign_shards(digest, ["doc_id", "text_crc32"], shards, nodes)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
