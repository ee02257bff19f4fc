"""Packed token-id output: best-fit-decreasing packing with a segment tree over free capacities.

Documents are encoded, ended with the end id, and cut into pieces of one sequence at most, losslessly.  A
task packs its documents block by block, a block being bounded in tokens: pieces go in order of decreasing
length into the sequence with the least sufficient free space, found by a segment tree over capacities.  Each
sequence becomes one row of a fixed-width id matrix (unsigned 16-bit, or 32-bit for larger vocabularies,
little-endian, padded with the end id) with its cumulative segment lengths and the positions at which position
ids restart at zero.  Nothing is shuffled and memory is bounded by the block.

Defined results: a null or empty text is a piece that holds the end id alone; an empty table gives no rows;
repeated rows are packed one by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm import bytebpe
from presslens.llm.common import small_batches

#: Tokens of a sequence.
CAPACITY = 2048
#: Tokens that a task packs together.
BLOCK = 2_000_000
#: Id that ends every document and fills the rest of a sequence.
END_ID = 50256


class FreeSpace:
    """Segment tree over free capacities 0..capacity: which sequences have how much room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, sequence: int) -> None:
        self.bins[free].append(sequence)
        i = free + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (free, sequence) with the least free space of at least ``need``."""
        i, count = need + self.leaves, self.count
        while not count[i]:
            while i & 1:  # a right child: what lies to the right starts above
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.leaves
        sequence = self.bins[free].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return free, sequence


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of indexes into ``lengths`` (each at most ``capacity``)."""
    room = FreeSpace(capacity)
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda j: -lengths[j]):
        found = room.take(lengths[i])
        free, sequence = found if found else (capacity, len(out))
        if not found:
            out.append([])
        out[sequence].append(i)
        if free > lengths[i]:
            room.add(free - lengths[i], sequence)
    return out


def pack_ids(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
             capacity: int = CAPACITY, block: int = BLOCK, end_id: int = END_ID) -> DataFrame:
    """sequence_id, n_tokens, ids, cu_seqlens, position_resets, doc_ids, doc_starts: one row per sequence.

    Piece ``j`` of a sequence lies at ``cu_seqlens[j]`` to ``cu_seqlens[j + 1]`` and holds the ids of
    ``doc_ids[j]`` from ``doc_starts[j]`` on.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    doc_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe = bytebpe.encoder(path)
        width = "<u2" if max(bpe.reference.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        end = end_id.to_bytes(4, "little")
        made = TaskContext.get().partitionId() << 40
        held: list[tuple[object, int, np.ndarray]] = []
        tokens = 0
        kind = None

        def flush() -> pa.RecordBatch:
            nonlocal made, tokens
            bins = best_fit_decreasing([len(p[2]) for p in held], capacity)
            ids, cums, owners, starts = [], [], [], []
            for members in bins:
                line = np.full(capacity, end_id, dtype=width)
                at, cum = 0, [0]
                for j in members:
                    part = held[j][2]
                    line[at:at + len(part)] = part
                    at += len(part)
                    cum.append(at)
                ids.append(line.tobytes())
                cums.append(cum)
                owners.append([held[j][0] for j in members])
                starts.append([held[j][1] for j in members])
            out = pa.RecordBatch.from_arrays(
                [pa.array(range(made, made + len(bins)), pa.int64()), pa.array([c[-1] for c in cums], pa.int32()),
                 pa.array(ids, pa.binary()), pa.array(cums, pa.list_(pa.int32())),
                 pa.array([c[:-1] for c in cums], pa.list_(pa.int32())), pa.array(owners, pa.list_(kind)),
                 pa.array(starts, pa.list_(pa.int64()))],
                names=["sequence_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_starts"])
            made += len(bins)
            held.clear()
            tokens = 0
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            for d, t in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = np.frombuffer(bpe.encode(t) + end, dtype="<u4").astype(width)
                held.extend((d, at, ids[at:at + capacity]) for at in range(0, len(ids), capacity))
                tokens += len(ids)
                if tokens >= block:
                    yield flush()
        if held:
            yield flush()

    return rows.mapInArrow(run, "sequence_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, "
                                f"position_resets array<int>, doc_ids array<{doc_type}>, doc_starts array<bigint>")


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrix rows as Parquet (binary id rows are left uncompressed by dictionary)."""
    packed.write.option("parquet.enable.dictionary", "false").parquet(path)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions within a sequence, restarting at every segment."""
    return np.concatenate([np.arange(b - a) for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False)]).astype(np.int32)
