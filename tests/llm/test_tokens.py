"""BPE, packed ids and harmonic packing against the tokenizers library and plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm.helpers import edge, empty
from presslens.llm import bytebpe, harmonic, packed, wordbpe
from tokenizers import Tokenizer

ALPHABET = [*"ab cdE  \n\t'sé ÈßñΣİ日本😀́\xa0\x85 　.,!?0123٣½²ªº٠ǅſK\x1c\x00\x7f\xad", "<|endoftext|>", "<|startoftext|>", "'ll", " the", "\r\n"]


@pytest.fixture(scope="module")
def strings():
    rng = random.Random(4)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    return [*out, "a" * 3000, "xyz" * 900 + "é" * 500, " " * 3000, "\n" * 300 + " x", ""]


def test_byte_ids_equal_the_library(strings):
    bpe = bytebpe.encoder()
    for t in strings:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == bpe.reference.encode(t, add_special_tokens=False).ids


def test_rank_array_equals_the_library(strings):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for t, (ids, decoded) in zip(strings, wordbpe.WordBpe(path).encode_decode(strings), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == lib.decode(want, skip_special_tokens=False)


def test_scan_and_heap_merge_alike(monkeypatch):
    bpe = wordbpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    words = [w.encode() for w in ("internationalisation", "aaaaaaaaaaaaaaaa", "zebra", "x")]
    rows = bpe.merge_rows(words)
    assert rows == [bpe.merge_long(w) for w in words]
    monkeypatch.setattr(wordbpe, "SCANNED", 0)
    assert rows == [bpe.merge_long(w) for w in words]


def test_word_bpe_edges(spark):
    got = wordbpe.encode_documents(edge(spark)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(got) == edge(spark).count()
    assert sum(r["n_tokens"] == 0 and r["ids_sha256"] == nothing == r["decoded_sha256"] for r in got) == 4
    assert wordbpe.encode_documents(empty(spark)).count() == 0


def test_best_fit_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 200))]
        free = []
        for n in sorted(lengths, reverse=True):
            room = [f for f in free if f >= n]
            if room:
                free.remove(min(room))
            free.append((min(room) if room else 100) - n)
        bins = packed.best_fit_decreasing(lengths, 100)
        assert len(bins) == len(free) and sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(100 - sum(lengths[i] for i in b) for b in bins) == sorted(free)


def test_packed_rows_restore_every_document(spark):
    df = edge(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    bpe = bytebpe.encoder()
    got = defaultdict(dict)
    for r in packed.pack_ids(df, capacity=256, block=3000).collect():
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 256 and r["n_tokens"] == r["cu_seqlens"][-1] <= 256
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        assert packed.position_ids(r["cu_seqlens"])[r["position_resets"]].tolist() == [0] * len(r["doc_ids"])
        assert (ids[r["n_tokens"]:] == packed.END_ID).all()
        for j, (d, s) in enumerate(zip(r["doc_ids"], r["doc_starts"], strict=True)):
            got[d][s] = ids[r["cu_seqlens"][j]:r["cu_seqlens"][j + 1]].tolist()
    for r in df.collect():
        want = np.frombuffer(bpe.encode(r["text"]), "<u4").tolist() + [packed.END_ID]
        assert [x for _, part in sorted(got[r["doc_id"]].items()) for x in part] == want
    assert packed.pack_ids(empty(spark)).count() == 0


def test_tail_cuts_waste_little():
    for n in range(1, 1024):
        cuts = harmonic.tail_cuts(n)
        assert sum(cuts) == n
        assert all(1024 - (1024 // c) * c <= 0.05 * 1024 for c in cuts)


def test_harmonic_pieces_and_sequences(spark):
    df = edge(spark)
    bpe = bytebpe.encoder()
    rows = harmonic.pack_documents(df).collect()
    texts = defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(np.frombuffer(bpe.encode(r["text"]) + b"\0\0\0\0", "<u4"))
    sequences, total = defaultdict(list), 0
    for r in rows:
        assert any(len(t) == r["doc_tokens"] and zlib.crc32(t[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
                   for t in texts[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(t) for ts in texts.values() for t in ts)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) * 1024 - total < 0.05 * total + 1024
    assert harmonic.pack_documents(empty(spark)).count() == 0


def test_word_bpe_keeps_the_frequent_when_its_cache_is_full(monkeypatch):
    import public_tokenizers
    from presslens.llm import wordbpe

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [[f"the river {i} runs past{i % 7} \x00 the old-mill{i}" for i in range(n, n + 20)] for n in range(0, 200, 20)]
    want = [wordbpe.WordBpe(path).encode_decode(t) for t in texts]
    monkeypatch.setattr(wordbpe, "PIECES", 60)
    monkeypatch.setattr(wordbpe, "WORDS", 60)
    small, cut = wordbpe.WordBpe(path), []
    learn = small._cut
    small._cut = lambda piece: cut.append(piece) or learn(piece)
    assert [small.encode_decode(t) for t in texts] == want
    assert cut.count("the") == cut.count("river") == 1
