"""Alignment of two tokenizers by interval coalescing.

Both tokenizers cover the same bytes, A's tokens by one set of intervals and B's by another.  All tokens are
lexsorted by start; the running maximum of their ends (``maximum.accumulate``) tells where a group breaks: where a
start reaches the maximum of all ends before it, both tokenizers have ended.  Within a group every A token is linked
with every B token.

Both cut a text before a blank that follows no white space in any case, so groups never cross such a place.  The parts
between repeat: new parts of a batch are laid on one byte axis and coalesced together, and their groups and links are kept
for the life of the worker, within a bound.

How many documents hold a linked id pair is counted over the corpus.  Documents are taken in chunks, a chunk being
bounded in links; each chunk lists its distinct pairs with the number of its documents that hold them, and every
document its pairs as indexes into that list.  Only the lists are shuffled by pair, to be added up and ranked, and
come back to their chunk with the corpus-wide counts, from which each document's sums are taken.  So what is shuffled is
a chunk's distinct pairs, not a row for every link, and no table of counts is broadcast or collected.

Defined results: texts that are null, empty, or whose joined token bytes differ from blank + text under either
tokenizer (for instance those that hold U+2581) have no tokens: zeros, and an empty string for the groups.  An empty
table gives an empty table; repeated rows are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.bytebpe import _CUT, _PAIRS, ByteBpe, _byte_letters
from presslens.llm.common import per_worker, small_batches, staged

#: Parts kept in each worker, and the longest that is kept (about 450 bytes each, 180 MB in all).
CACHE, LONGEST_KEPT = 400_000, 48
#: New parts that are aligned together.
SOME = 8192
#: Distinct pairs of documents that a chunk holds together (16 bytes each).
CHUNK = 2_000_000
#: Links of one group beyond which its ids are first made distinct.
LARGE_GROUP = 4096


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Group numbers of A's and of B's tokens, and the number of groups.  Intervals are in order and cover the same bytes."""
    start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.empty(len(order), np.int64)
    breaks[:1] = 0
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[:len(start_a)], group[len(start_a):], int(breaks.sum()) + (len(order) > 0)


class Pair:
    """The two tokenizers, and what is known of parts: (tokens of A, of B, groups, links, pairs of ids, groups as text)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = ByteBpe(path_a)
        self.a.reference.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = _byte_letters()
        names = {i: t for t, i in self.a.reference.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = {i: bytes(letters[c] for c in t) for i, t in names.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.size_b)]
        self.blank = self.b.piece_to_id("▁")
        # pieces with a blank behind another character would join what is cut apart
        self.whole = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.size_b) if not self.b.is_byte(i))
        self.known: dict[str, tuple | None] = {}

    def parts(self, text: str) -> list[str]:
        """Blank + text, cut before blanks that follow no white space; each part begins with its blank."""
        full = " " + text
        if self.whole:
            return [full]
        cut = _CUT.split(full)[1:] if any(p in full for p in _PAIRS) else text.split(" ")
        return [" " + c for c in cut]

    def align(self, parts: list[str]) -> dict[str, tuple | None]:
        """What is known of new parts; None where the tokens' bytes are not those of the part."""
        out: dict[str, tuple | None] = dict.fromkeys(parts)
        ids_a = [memoryview(self.a._part(p)).cast("I").tolist() for p in parts]
        ids_b = self.b.encode([p[1:] for p in parts], num_threads=1)  # without the blank that the model adds
        size_a, size_b, good, all_a, all_b = [], [], [], [], []
        for p, a, b in zip(parts, ids_a, ids_b, strict=True):
            b = b or [self.blank]
            raw, ta, tb = p.encode(), [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            if b"".join(ta) == raw == b"".join(tb):
                good.append((p, len(a), len(b)))
                all_a += a
                all_b += b
                size_a += map(len, ta)
                size_b += map(len, tb)
        if not good:
            return out
        # all parts on one axis of bytes: a part's last token ends where the next part's first begins
        end_a, end_b = np.cumsum(size_a, dtype=np.int64), np.cumsum(size_b, dtype=np.int64)
        group_a, group_b, groups = coalesce(end_a - size_a, end_a, end_b - size_b, end_b)
        token_a, token_b = np.array(all_a, np.int64), np.array(all_b, np.int64)
        na, nb = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        links = na * nb
        small = np.where(links <= LARGE_GROUP, links, 0)
        # links of ordinary groups: every A token as often as its group has B tokens
        g = np.repeat(np.arange(groups), small)
        nth = np.arange(len(g)) - np.repeat(np.cumsum(small) - small, small)
        pair = token_a[first_a[g] + nth // nb[g]] * self.size_b + token_b[first_b[g] + nth % nb[g]]
        raw_pairs = memoryview(pair.tobytes())
        pair_at, link_at = (np.concatenate(([0], np.cumsum(x))).tolist() for x in (small, links))
        # a group's A ids, its B ids, and what stands behind each of them
        said = [""] * (len(all_a) + len(all_b))
        last_a = np.append(group_a[1:] != group_a[:-1], True).tolist()
        last_b = np.append(group_b[1:] != group_b[:-1], True).tolist()
        for i, at, last in zip(all_a, (np.arange(len(all_a)) + first_b[group_a]).tolist(), last_a, strict=True):
            said[at] = f"{i}|" if last else f"{i},"
        for i, at, last in zip(all_b, (np.arange(len(all_b)) + (first_a + na)[group_b]).tolist(), last_b, strict=True):
            said[at] = f"{i};" if last else f"{i},"
        large = np.flatnonzero(links > LARGE_GROUP).tolist()
        number = group_a.tolist()
        at_a = at_b = 0
        for p, a, b in good:
            g0, g1 = number[at_a], number[at_a + a - 1] + 1
            weighted = None
            for big in [x for x in large if g0 <= x < g1] if large else ():  # its distinct ids with their numbers, not every link
                ua, ca = np.unique(token_a[first_a[big]:first_a[big] + na[big]], return_counts=True)
                ub, cb = np.unique(token_b[first_b[big]:first_b[big] + nb[big]], return_counts=True)
                more = (ua[:, None] * self.size_b + ub).ravel(), (ca[:, None] * cb).ravel()
                weighted = _added(*(np.concatenate(x) for x in zip(weighted, more, strict=True))) if weighted else more
            out[p] = (a, b, g1 - g0, link_at[g1] - link_at[g0], bytes(raw_pairs[8 * pair_at[g0]:8 * pair_at[g1]]), "".join(said[at_a + at_b:at_a + at_b + a + b])[:-1], weighted)
            at_a += a
            at_b += b
        return out

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray, str]]:
        """For every text (tokens of A, of B, groups, links, distinct pairs, times of each, groups as text)."""
        cut = [self.parts(t) if t else [] for t in texts]
        fresh = [p for p in {p for c in cut for p in c} if p not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known.clear()
            fresh = list({p for c in cut for p in c})
        known = self.known
        if fresh:
            new = {}
            for i in range(0, len(fresh), SOME):
                new |= self.align(fresh[i:i + SOME])
            known = self.known | new if any(len(p) > LONGEST_KEPT for p in fresh) else self.known
            self.known.update((p, x) for p, x in new.items() if len(p) <= LONGEST_KEPT)
        for c in cut:
            yield _joined([known[p] for p in c])


NOTHING = (0, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), "")


def _added(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of their times."""
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    return pairs[first], np.add.reduceat(times[order], first)


def _joined(parts: list[tuple | None]) -> tuple[int, int, int, int, np.ndarray, np.ndarray, str]:
    if not parts or None in parts:
        return NOTHING
    a, b, groups, links, pairs, said, weighted = zip(*parts, strict=True)
    listed, times = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
    for w in weighted:
        if w:
            listed, times = _added(np.concatenate((listed, w[0])), np.concatenate((times, w[1])))
    return sum(a), sum(b), sum(groups), sum(links), listed, times, ";".join(said)


def _chunks(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (pairs as indexes into their chunk's list), and behind those of a chunk its list."""
    from pyspark import TaskContext

    pair = per_worker(f"alignment:{path_a}:{path_b}", lambda: Pair(path_a, path_b))
    chunk = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size, kind = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal chunk, size
        listed, place, docs = np.unique(np.concatenate([h[5] for h in held]), return_inverse=True, return_counts=True)
        place = place.astype(np.uint32)
        ends = np.cumsum([len(h[5]) for h in held])
        n = len(held)
        columns = [pa.array([chunk] * n, pa.int64()), pa.array([h[0] for h in held], kind), *(pa.array([h[i] for h in held], pa.int64()) for i in (1, 2, 3, 4)),
                   pa.array([h[7] for h in held], pa.string()),
                   pa.array([p.tobytes() for p in np.split(place, ends[:-1])], pa.binary()),
                   pa.array([h[6].tobytes() for h in held], pa.binary()),
                   pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
        if with_groups:
            columns.append(pa.array([h[8] for h in held], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=names)
        one = [pa.array([chunk], pa.int64()), pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), *[pa.nulls(1, pa.binary())] * 2,
               pa.array([listed], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(one + ([pa.nulls(1, pa.string())] if with_groups else []), names=names)
        held.clear()
        chunk, size = chunk + 1, 0

    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "pairs", "docs", *(["groups"] if with_groups else [])]
    for batch in batches:
        kind = batch.schema.field(0).type
        for d, got in zip(batch[0].to_pylist(), pair.documents(batch[1].to_pylist()), strict=True):
            *counts, listed, times, said = got
            sha = hashlib.sha256(said.encode()).hexdigest() if said else ""
            held.append((d, *counts, listed, times.astype(np.uint32 if not len(times) or times.max() < 1 << 32 else np.int64), sha, said if with_groups else None))
            size += len(listed) + 8 + (len(said) // 16 if with_groups else 0)
            if size >= most:
                yield from flush()
    if held:
        yield from flush()


def _sums(docs: pa.Table, counted: pa.Table) -> pa.Table:
    """The documents of one chunk with the sums over their links."""
    counted = counted.sort_by("place")
    count, best = counted["n"].to_numpy(), counted["best"].to_numpy()
    n_best, total = [], []
    for places, times, many in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), docs["n_links"].to_pylist(), strict=True):
        at = np.frombuffer(places, np.uint32)
        of = np.frombuffer(times, np.uint32 if len(times) == len(places) else np.int64).astype(np.int64)
        n_best.append(int((of * best[at]).sum()) if many else 0)
        total.append(int((of * count[at]).sum()) if many else 0)
    return docs.drop_columns(["chunk", "places", "times"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None,
                    with_groups: bool = False, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum (and, if wanted, groups): a row per document."""
    small_batches(docs.sparkSession)
    path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    more = ", groups string" if with_groups else ""
    table = staged(rows.mapInArrow(lambda b: _chunks(b, path_a, path_b, with_groups, chunk),
                                   f"chunk bigint, {columns}, places binary, times binary, pairs array<bigint>, docs array<bigint>{more}"), "chunks")
    size_b = _pieces(path_b)
    listed = table.filter("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x")).select(
        "chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    counts = staged(listed.groupBy("pair").agg(F.sum("docs").alias("n")), "counts")
    id_a = F.expr(f"pair DIV {size_b}")
    top = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("top"))
    ranked = counts.withColumn("a", id_a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))
    back = listed.select("chunk", "place", "pair").join(ranked, "pair").select(F.col("chunk").alias("of"), "place", "n", "best")
    own = table.filter("pairs IS NULL").drop("pairs", "docs")
    return own.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_sums, f"{columns}{more}, n_best bigint, count_sum bigint")


def _pieces(path: str) -> int:
    """Size of B's vocabulary, which numbers the pairs."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
