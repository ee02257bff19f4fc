"""BPE encoding and decoding with a contiguous rank array.

The vocabulary lower-cases, drops white space and marks word ends.  A word is held as a row of symbols (its
part boundaries) with the ranks of neighbouring pairs beside it.  The least rank is looked for, its
boundary is deleted, the symbols to the right move up, and the two neighbouring ranks are looked up anew,
until no pair has a rank.  All new words of a batch of texts go through these steps together, as rows of one
array each for symbols and ranks; very long words, where repeated scans would be quadratic, use a heap over
the same pairs with the same result.

Texts are cut at blanks and line breaks; pieces repeat, so their ids and tokens are kept for the life of the
worker, within a bound.

Defined results: null and empty texts have no tokens (and the check sums of an empty string); an empty table
gives an empty table; repeated rows are encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.bytebpe import _byte_letters
from presslens.llm.common import per_worker, small_batches

#: Pieces and words kept in each worker (about 400 and 300 bytes each).
PIECES, WORDS = 400_000, 200_000
#: Symbols up to which a word is a row of the rank array.
SHORT = 32
#: Symbols up to which a longer word is still scanned; beyond, a heap finds the least rank.
SCANNED = 256
#: Pattern of the file's pre-tokenizer, for letters below U+0100 (all others ask the file itself).
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_PLAIN = re.compile("[\x21-\x7e\xa1-\xff]+\\Z")
NO_RANK = np.int32(1 << 30)
#: A piece without a word.
_NOTHING = ("", "")


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.reference = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        self.special = {t.content: i for i, t in self.reference.get_added_tokens_decoder().items()}
        self.suffix: str = model["end_of_word_suffix"]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        byte = {b: c for c, b in _byte_letters().items()}
        self.inner = np.array([vocab[byte[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[byte[b] + self.suffix] for b in range(256)], dtype=np.int64)
        self.letters = {c: b for b, c in byte.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([v[0] for v in self.pairs.values()], dtype=np.int32)[order]
        self.joined = np.array([v[1] for v in self.pairs.values()], dtype=np.int64)[order]
        self.by_rank = np.empty(len(pairs), dtype=np.int64)
        self.by_rank[self.ranks] = self.joined
        self.words: dict[bytes, tuple[str, str]] = {}
        self.pieces: dict[str, tuple[str, str]] = {}

    # --- the rank array -------------------------------------------------------------------------
    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = left << 32 | right
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.ranks[i], NO_RANK)

    def merge_rows(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of at most SHORT bytes, all together."""
        n = np.array([len(w) for w in words])
        width = int(n.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        column = np.arange(width)
        parts = np.where(column < n[:, None] - 1, self.inner[raw], self.last[raw])
        ranks = np.full((len(words), width), NO_RANK)
        if width > 1:
            real = column[:-1] < n[:, None] - 1
            ranks[:, :-1][real] = self._rank(parts[:, :-1][real], parts[:, 1:][real])
        live = np.arange(len(words))
        done = [None] * len(words)
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            least = ranks[row, at]
            ended = least == NO_RANK
            for i in np.flatnonzero(ended):
                done[live[i]] = parts[i, :n[i]].tolist()
            go = ~ended
            live, parts, ranks, n, at, least = live[go], parts[go], ranks[go], n[go], at[go], least[go]
            if not len(live):
                break
            row = np.arange(len(live))
            parts[row, at] = self.by_rank[least]
            # delete the boundary: what lies right of the merged pair moves up by one
            moved = np.minimum(column + (column > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, moved, axis=1)
            up = np.minimum(column + (column >= at[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, up, axis=1)
            ranks[:, -1] = NO_RANK
            n = n - 1
            for side in (at, at - 1):  # refresh the two ranks beside the merged part
                ok = (side >= 0) & (side < n - 1)
                r, c = row[ok], side[ok]
                ranks[r, c] = self._rank(parts[r, c], parts[r, c + 1])
                over = (side >= 0) & (side >= n - 1)
                ranks[row[over], side[over]] = NO_RANK
        return done

    def merge_long(self, word: bytes) -> list[int]:
        parts = [int(self.inner[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        none = (int(NO_RANK), 0)
        if len(parts) <= SCANNED:
            ranks = [self.pairs.get(p, none)[0] for p in zip(parts, parts[1:], strict=False)]
            while ranks:
                i = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[i] == none[0]:
                    break
                parts[i:i + 2] = [int(self.by_rank[ranks[i]])]
                del ranks[i]
                for j in (i - 1, i):
                    if 0 <= j < len(ranks):
                        ranks[j] = self.pairs.get((parts[j], parts[j + 1]), none)[0]
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        gone = [False] * len(parts)
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(parts) or (parts[i], parts[j]) != pair:
                continue
            parts[i] = int(self.by_rank[rank])
            gone[j] = True
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (parts[a], parts[b]) in self.pairs:
                    heapq.heappush(heap, (self.pairs[parts[a], parts[b]][0], a, (parts[a], parts[b])))
        return [p for p, g in zip(parts, gone, strict=True) if not g]

    # --- texts ----------------------------------------------------------------------------------
    def _cut(self, piece: str) -> list[bytes]:
        """The words of a piece without blanks, as bytes."""
        if _PLAIN.match(piece):
            return [w.encode() for w in _WORD.findall(piece.lower())]
        found = self.reference.pre_tokenizer.pre_tokenize_str(self.reference.normalizer.normalize_str(piece))
        return [bytes(self.letters[c] for c in w) for w, _ in found]

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words of all pieces that are not yet known."""
        some = set().union(*texts).difference(self.special)
        new = some.difference(self.pieces)
        if len(self.pieces) + len(new) > PIECES:  # those of this batch stay: what is frequent is not learnt anew
            self.pieces = {p: self.pieces[p] for p in some.difference(new)}
        cut = {p: self._cut(p) for p in new}
        needed = set().union(*cut.values())
        fresh = needed.difference(self.words)
        if len(self.words) + len(fresh) > WORDS:
            self.words = {w: self.words[w] for w in needed.difference(fresh)}
        by_width: dict[int, list[bytes]] = {}
        for w in fresh:
            if len(w) <= SHORT:
                by_width.setdefault(-(-len(w) // 4), []).append(w)
            else:
                self._keep(w, self.merge_long(w))
        for words in by_width.values():
            for i in range(0, len(words), 20_000):
                some = words[i:i + 20_000]
                for w, ids in zip(some, self.merge_rows(some), strict=True):
                    self._keep(w, ids)
        for p, ws in cut.items():
            if len(ws) == 1:
                self.pieces[p] = self.words[ws[0]]
            else:
                got = [self.words[w] for w in ws]
                self.pieces[p] = " ".join([g[0] for g in got]), " ".join([g[1] for g in got])
        for s, i in self.special.items():
            self.pieces[s] = str(i), s

    def _keep(self, word: bytes, ids: list[int]) -> None:
        self.words[word] = " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids))

    def pieces_of(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [p for part in self.split.split(text)
                    for p in ([part] if part in self.special else part.replace("\n", " ").split(" ")) if p]
        return [p for p in text.replace("\n", " ").split(" ") if p]

    def encode_decode(self, texts: list[str]) -> list[tuple[str, str]]:
        """For every text the ids joined by blanks and the decoded text (tokens joined by blanks)."""
        split = [self.pieces_of(t) for t in texts]
        self.learn(split)
        out = []
        for t in split:
            got = [self.pieces[p] for p in t]
            if _NOTHING in got:  # a piece of which no character is left
                got = [g for g in got if g[0]]
            out.append((" ".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
                     with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, if wanted, ids and decoded as text)."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(f"wordbpe:{path}", lambda: WordBpe(path))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch[1].to_pylist()]
            got = bpe.encode_decode(texts)
            columns = [batch[0], pa.array([i.count(" ") + 1 if i else 0 for i, _ in got], pa.int64()),
                       pa.array([sha(i) for i, _ in got], pa.string()), pa.array([sha(d) for _, d in got], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([i for i, _ in got], pa.string()), pa.array([d for _, d in got], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", ids string, decoded string" if with_ids else ""
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
