"""Harmonic packing of token sequences.

A piece of ``n`` tokens is in class ``k = capacity // n``: ``k`` such pieces always fit one sequence, so every
class fills its sequences with exactly ``k`` pieces, in any order, in any number of workers that know nothing
of each other.  A document is cut into full sequences and a tail; a tail whose class would leave more than
``max_waste`` of a sequence empty is cut at the next class boundary, where nearly nothing is left over.

Every class is dealt into ``shares`` by document.  Each (class, share) fills its sequences on its own; the
fewer than ``k`` pieces left in each meet once more by class, a number of rows bounded by
``shares * (k - 1)`` whatever the input.  What the classes then have left, fewer than ``k`` pieces each and
some thousands in all by the capacity alone, is packed together by best fit.  Only piece rows (ids, lengths,
check sums) are shuffled, no text.

Defined results: a null or empty text is one piece holding the end id; an empty table gives no pieces;
repeated rows are packed one by one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from presslens.llm import bytebpe
from presslens.llm.common import small_batches, staged
from presslens.llm.packed import best_fit_decreasing

#: Tokens of a sequence.
CAPACITY = 1024
#: Largest part of a sequence that a class may leave empty before its pieces are cut.
MAX_WASTE = 0.05
#: Shares of every class that fill sequences on their own.
SHARES = 1024
#: Id that ends every document.
END_ID = 0


def tail_cuts(n: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> list[int]:
    """Lengths into which a tail of ``n`` tokens is cut."""
    out = []
    while n:
        k = capacity // n
        if capacity - k * n <= max_waste * capacity:
            out.append(n)
            break
        piece = capacity // (k + 1)
        out.append(piece)
        n -= piece
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
           capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, row: the pieces of every document."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.encoder(path)
        tails = [tail_cuts(n, capacity, max_waste) for n in range(capacity)]
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            doc, start, length, crc, total, row = [], [], [], [], [], []
            for d, t, r in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                ids = memoryview(bpe.encode(t) + end)
                n = len(ids) // 4
                at = 0
                for size in [capacity] * (n // capacity) + tails[n % capacity]:
                    doc.append(d)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    total.append(n)
                    row.append(r)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.schema.field(0).type), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, row))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"),
                         F.monotonically_increasing_id().alias("row"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, row bigint")


def pack(cut: DataFrame, capacity: int = CAPACITY, shares: int = SHARES) -> DataFrame:
    """``cut`` with sequence_id and offset."""
    k = F.floor(F.lit(capacity) / F.col("length")).cast("bigint")

    def filled(rows: DataFrame, keys: list[str], level: int) -> DataFrame:
        group = W.partitionBy(*keys)
        nth = F.row_number().over(group.orderBy("doc_id", "row", "start")) - 1
        numbered = rows.withColumn("n", nth.cast("bigint")).withColumn("all", F.count("*").over(group))
        binned = numbered.withColumn("bin", F.expr("n DIV k")).withColumn("full", F.expr("n < all - all % k"))
        before = W.partitionBy(*keys, "bin").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
        return binned.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint"))).withColumn(
            "sequence_id", F.expr(f"(((k * 2 + {level}) * {shares} + share) * {1 << 36}) + bin"))

    dealt = cut.withColumn("k", k).withColumn(
        "share", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(shares)).cast("bigint"))
    columns = [*cut.columns, "k", "share"]
    first = staged(filled(dealt, ["k", "share"], 0).select(*columns, "full", "sequence_id", "offset"), "bins")
    rest = filled(first.filter(~F.col("full")).select(*columns).withColumn("share", F.lit(0).cast("bigint")), ["k"], 1)
    out = [*cut.columns, "sequence_id", "offset"]
    last = rest.filter(~F.col("full")).select(*cut.columns)

    def join_up(some: pd.DataFrame) -> pd.DataFrame:  # at most the sum of k - 1 over the classes
        some = some.sort_values(["length", "doc_id", "row", "start"], ascending=[False, True, True, True])
        lengths = some["length"].tolist()
        place = {}
        for sequence, members in enumerate(best_fit_decreasing(lengths, capacity)):
            at = 0
            for j in members:
                place[j] = (sequence, at)
                at += lengths[j]
        return some.assign(sequence_id=[place[j][0] for j in range(len(some))], offset=[place[j][1] for j in range(len(some))])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in last.schema) + ", sequence_id bigint, offset bigint"
    joined = last.groupBy().applyInPandas(join_up, schema)
    return first.filter("full").select(*out).unionByName(rest.filter("full").select(*out)).unionByName(joined)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
                   capacity: int = CAPACITY, max_waste: float = MAX_WASTE, shares: int = SHARES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    return pack(pieces(docs, id_col, text, path, capacity, max_waste), capacity, shares).drop("row")
