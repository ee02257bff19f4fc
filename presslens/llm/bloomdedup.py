"""Exact de-duplication by two-pass Bloom filtering (native DataFrame code only).

Pass one counts, for every row, two cells of one bucket of a fixed-size table, addressed by hashes of the
normalised text, and packs the cells that were hit twice or more into a bitmap.  Pass two tests each
row against the bitmap: a row with a cell that was hit once is certainly unique and passes straight
through; only the others are shuffled and grouped by the SHA-256 of the text.  A false positive of
the filter costs one needless shuffle of a digest row and never changes the result.

Defined results: null text counts as empty; texts are equal after every run of ASCII white space is
replaced by one space; of equal texts the row with the smallest ``doc_id`` stays (rows without
``doc_id`` come last, and of wholly repeated rows one stays); an empty table gives an empty table;
extra columns are ignored by :func:`exact_copies` and returned untouched by :func:`drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import BLANKS, staged, text_or_empty

#: Cells of the filter.  The bitmap takes CELLS / 8 bytes (16 MB), whatever the input; that is the
#: proven bound of the broadcast.  Far beyond CELLS rows the filter fills up: then more digest rows
#: shuffle, and the result stays the same.
CELLS = 1 << 27
#: Cells of one bitmap row.
BUCKET = 32768
#: Shares into which the copies of one text are dealt, so that a text that makes up a third of all
#: rows is counted and joined in as many tasks.
SALTS = 256


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), BLANKS, " ")


def _cells(norm: Column, cells: int) -> list[Column]:
    """Two cells in one bucket of BUCKET cells, counted from 1 as the bitmap functions do."""
    h = F.xxhash64(norm)
    bucket = F.pmod(h, F.lit(max(cells // BUCKET, 1)))
    inner = [F.pmod(F.shiftrightunsigned(F.xxhash64(norm, F.lit(7)), n), F.lit(BUCKET)) for n in (0, 32)]
    return [(bucket * BUCKET + i + 1).cast("bigint") for i in inner]


def repeated_cells(cell_rows: DataFrame, c1: str, c2: str) -> DataFrame:
    """Pass one: bitmap rows (bucket, bits) of the cells that two or more insertions hit."""
    hits = cell_rows.select(F.explode(F.array(c1, c2)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return (hits.filter("n >= 2")
            .groupBy(F.bitmap_bucket_number("cell").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")))


def _bit(bits: str, cell: str) -> Column:
    pos = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.expr(f"substring({bits}, CAST(bitmap_bit_position({cell}) DIV 8 AS INT) + 1, 1)")), 16, 10)
    shifted = F.call_function("shiftright", byte.cast("int"), F.pmod(pos, F.lit(8)).cast("int"))
    return F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False))


def with_possible(rows: DataFrame, bitmap: DataFrame, c1: str, c2: str, flag: str) -> DataFrame:
    """Pass two: flag the rows whose two cells are both set (``bitmap`` is bounded by CELLS / 8 bytes)."""
    side = F.broadcast(bitmap.select(F.col("bucket").alias("__b"), F.col("bits").alias("__bits")))
    out = rows.join(side, F.bitmap_bucket_number(c1) == F.col("__b"), "left")
    return out.select(*rows.columns, (_bit("__bits", c1) & _bit("__bits", c2)).alias(flag))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = normalised(text)
    c1, c2 = _cells(F.col("norm"), cells)
    digest = staged(docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
                    .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), c1.alias("c1"), c2.alias("c2"),
                            F.monotonically_increasing_id().alias("rid")), "digest")
    bitmap = repeated_cells(digest, "c1", "c2")
    rows = with_possible(digest, bitmap, "c1", "c2", "possible")
    alone = rows.filter(~F.col("possible")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = staged(rows.filter("possible").select("doc_id", "text_sha256", "rid", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt")), "maybe")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    shares = maybe.groupBy("text_sha256", "salt").agg(F.min(first).alias("first"), F.count("*").alias("n"))
    groups = shares.groupBy("text_sha256").agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    answers = shares.select("text_sha256", "salt").join(groups, "text_sha256")
    checked = maybe.join(answers, ["text_sha256", "salt"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256")
    return alone.unionByName(checked)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """``docs`` without later copies; certainly unique rows keep their place and are not shuffled."""
    norm = normalised(text)
    c1, c2 = _cells(norm, cells)
    marked = docs.withColumns({"__c1": c1, "__c2": c2})
    bitmap = staged(repeated_cells(marked.select("__c1", "__c2"), "__c1", "__c2"), "cells")
    rows = with_possible(marked, bitmap, "__c1", "__c2", "__possible")
    alone = rows.filter(~F.col("__possible")).select(*docs.columns)
    maybe = rows.filter("__possible").withColumn("__sha", F.sha2(norm, 256))
    first = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))).alias("first")
    keep = maybe.groupBy("__sha").agg(first).select(F.col("__sha").alias("__k"), F.col("first.id").alias("__id"))
    stay = maybe.join(keep, (F.col("__sha") == F.col("__k")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return alone.unionByName(stay.dropDuplicates(["__sha"]).select(*docs.columns))


ORACLE = r"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, s AS text_sha256, min(doc_id) OVER (PARTITION BY s) AS keep_id,
             count(*) OVER (PARTITION BY s) AS group_size
      FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents))
"""
