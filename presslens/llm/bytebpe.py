"""Byte-level BPE ids of whole texts, with a cache of the pieces between blanks.

A byte-level vocabulary splits text before merging and puts a blank in front of the word that follows it, so
a text may be cut at every blank that does not follow white space, and the ids of the parts joined.  Parts
repeat; their ids are kept for the life of the worker, within a bound.  Parts of plain letters go to the rank
encoder, which is several times faster; all others (rare scripts, control characters, special tokens) go to
the reference tokenizer itself, so the ids are those of the tokenizers library in every case.
"""

from __future__ import annotations

import re

import public_tokenizers

from presslens.llm.common import per_worker

#: Parts kept for each vocabulary and worker (about 200 bytes each).
CACHE = 800_000
#: Parts longer than this are encoded but not kept.
LONGEST_KEPT = 64
#: White space of Unicode; a blank behind one of these may belong to the same run.
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
_PAIRS = tuple(c + " " for c in SPACES)
_CUT = re.compile(r"(?<!\s) ")
_PLAIN = re.compile("[\n\r\t\x20-\x7e\xa1-\xac\xae-\u024f]*\\Z")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte, as byte-level vocabularies write it."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Kept(dict):
    """Ids (unsigned 32-bit, little-endian) of ' ' + part."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(" " + part)
        if len(part) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[part] = ids
        return ids


class ByteBpe:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        self.reference.no_truncation()
        self.reference.no_padding()
        self.special = tuple(t.content for t in self.reference.get_added_tokens_decoder().values())
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.reference.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept = _Kept(self._part)

    def _ids(self, text: str) -> list[int]:
        return self.reference.encode(text, add_special_tokens=False).ids

    def _part(self, part: str) -> bytes:
        from array import array

        ids = self.fast.encode_ordinary(part) if _PLAIN.match(part) else self._ids(part)
        return array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        from array import array

        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self._ids(text)).tobytes()
        parts = _CUT.split(text) if any(p in text for p in _PAIRS) else text.split(" ")
        first = self._part(parts[0])
        del parts[0]
        return first + b"".join(map(self.kept.__getitem__, parts))


def encoder(path: str | None = None) -> ByteBpe:
    """The worker's encoder for a vocabulary file (``byte_bpe_50k.json`` by default)."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return per_worker(f"bytebpe:{path}", lambda: ByteBpe(path))
