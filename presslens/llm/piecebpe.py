"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

A rank file lists byte strings by rank.  Every byte is mapped to a printable letter, every entry becomes a piece
whose score is its negative rank, and normalisation is the identity: the sentencepiece encoder, which merges the
neighbours with the highest score first, then does what a rank encoder does with the lowest rank.  Texts are cut
into pre-tokens by the pattern, each pre-token is encoded on its own, and decoding maps pieces back to bytes.

A text is first cut before every blank that follows no white space: the pattern ends a match there in any case.  These parts
repeat; their ids are kept for the life of the worker, within a bound in entries and characters.  A text is worked off in runs
of characters, so that a very long one needs memory for its ids only.

A rank encoder answers with the entry itself where a whole pre-token is one; entries that the merges alone would not
reach are found when the model is loaded and answered like that, too.

Defined results: null and empty texts have no tokens (and the hashes of an empty string); an empty table gives an
empty table; repeated rows are encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.llm.bytebpe import _CUT, _PAIRS, _byte_letters
from presslens.llm.common import per_worker, small_batches

#: Parts kept in each worker, and the longest that is kept (about 150 bytes each, 80 MB in all).
CACHE, LONGEST_KEPT = 500_000, 48
#: Characters of a text that are worked on at a time.
RUN = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, f)}


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def serialised(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model with the piece of rank r at id r, and the unknown piece behind them."""
    from struct import pack

    letter = {b: c for c, b in _byte_letters().items()}
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[e] for e in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks are not 0 to n - 1")

    def piece(text: str, score: float, kind: int) -> bytes:
        body = _field(1, text.encode()) + _number(2 << 3 | 5) + pack("<f", score) + _field(3, kind)
        return _field(1, body)

    pieces = [piece("".join(letter[b] for b in entry), -float(r), 1) for r, entry in enumerate(by_rank)]
    unknown = piece("<unk>", 0.0, 2)
    # model_type BPE, vocabulary size, ids of the unknown piece and of none for begin, end and padding
    none = (1 << 64) - 1
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, none) + _field(42, none) + _field(43, none)
    # identity, no blank in front, blanks neither removed nor escaped
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


def _parts(text: str) -> Iterator[list[str]]:
    """The text cut before blanks that follow no white space, where pre-tokens end in any case, some at a time."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + RUN)
        stop = cut.start() if cut else len(text)
        part = text[at:stop]
        words = _CUT.split(part[1:]) if any(p in part for p in _PAIRS) else part[1:].split(" ")
        words[0] = part[0] + words[0]
        yield [words[0], *[" " + w for w in words[1:]]]
        at = stop


class PieceBpe:
    """Ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(ranks))
        letter = {b: c for c, b in _byte_letters().items()}
        self.letters = "".join(letter[b] for b in range(256))
        byte = {c: b for b, c in letter.items()}
        # decoding is the inverse mapping of the model's own pieces
        self.entry = [bytes(byte[c] for c in self.model.id_to_piece(i)) for i in range(len(ranks))]
        self.pattern = regex.compile(pattern)
        reached = self.model.encode([self._mapped(e) for e in self.entry], num_threads=1)
        self.whole = {e: i for i, (e, ids) in enumerate(zip(self.entry, reached, strict=True)) if ids != [i]}
        self.kept: dict[str, bytes] = {}

    def _mapped(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.letters)

    def _encode(self, tokens: Iterable[str]) -> list[bytes]:
        raw = [t.encode() for t in tokens]
        mapped = [self._mapped(r) for r in raw]
        # a call for a list costs as much as some fifty calls for one
        got = self.model.encode(mapped, num_threads=1) if len(mapped) > 64 else [self.model.encode(m) for m in mapped]
        return [array("I", [self.whole[r]] if r in self.whole else ids).tobytes() for r, ids in zip(raw, got, strict=True)]

    def _learn(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of parts of a text: the ids of their pre-tokens, each encoded on its own."""
        cut = {p: self.pattern.findall(p) for p in parts}
        tokens = list({t for ts in cut.values() for t in ts})
        ids = dict(zip(tokens, self._encode(tokens), strict=True))
        return {p: b"".join([ids[t] for t in ts]) for p, ts in cut.items()}

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of every text; texts that are short share the calls of the model."""
        out: list[list[bytes]] = []
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            fresh = {p for _, parts in held for p in parts if p not in self.kept}
            own = self._learn(fresh)
            for i, parts in held:
                out[i].append(b"".join([own[p] if p in own else self.kept[p] for p in parts] if own else map(self.kept.__getitem__, parts)))
            short = {p: ids for p, ids in own.items() if len(p) <= LONGEST_KEPT}
            if len(self.kept) + len(short) > CACHE:
                self.kept.clear()
            self.kept.update(short)
            held.clear()

        for text in texts:
            out.append([])
            for parts in _parts(text or ""):
                held.append((len(out) - 1, parts))
                size += len(text)
                if size >= RUN:
                    flush()
                    size = 0
        flush()
        return [b"".join(o) for o in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entry.__getitem__, memoryview(ids).cast("I")))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None,
                     with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, if wanted, ids and decoded, both binary)."""
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(f"piecebpe:{path}:{pattern}", lambda: PieceBpe(path, pattern))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
        for batch in batches:
            n, sums, plain, ids, decoded = [], [], [], [], []
            for got in bpe.encode_all(batch[1].to_pylist()):
                back = bpe.decode(got)
                n.append(len(got) // 4)
                sums.append(hashlib.sha256(got).hexdigest())
                plain.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids.append(got)
                    decoded.append(back)
            columns = [batch[0], pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())] if with_ids else []), names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", ids binary, decoded binary" if with_ids else ""
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
