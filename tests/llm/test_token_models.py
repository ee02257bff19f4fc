"""Byte-level BPE through a written sentencepiece model, and alignment of two tokenizers."""

import hashlib
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from llm.helpers import edge, edge_rows, empty
from presslens.llm import alignment, piecebpe
from tokenizers import Tokenizer

LETTERS = "abcdeABC  \n\t'sréüß漢字🙂 1290.,!-\x1c\x85\xa0́|<>▁\x00"


def strings(n, seed, letters=LETTERS):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + [
        "<|endoftext|> a", "</s><s>x", " a", "a ", " ", "  ", "\n", "a  b ", "<0x41>", "漢" * 300, "กำ" * 100, "🙂🙃" * 60, "x" * 3000]


@pytest.fixture(scope="module")
def ranks():
    return piecebpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_ids_are_those_of_the_rank_encoder(ranks):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = piecebpe.PieceBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = strings(3000, 5) + [chr(c) + "a " + chr(c) for c in range(0, 0x3000, 7)]
    for text, ids in zip(texts, bpe.encode_all(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == ref.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_runs_of_a_long_text_and_a_small_cache(monkeypatch):
    bpe = piecebpe.PieceBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [" ".join(strings(200, s)) for s in (1, 2)]
    want = bpe.encode_all(texts)
    monkeypatch.setattr(piecebpe, "RUN", 50)
    monkeypatch.setattr(piecebpe, "CACHE", 20)
    assert bpe.encode_all(texts) == want


def test_an_entry_that_merges_do_not_reach_is_the_whole_pre_token():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    import base64
    import os
    import tempfile

    path = os.path.join(tempfile.mkdtemp(), "r.tiktoken")
    with open(path, "wb") as f:
        f.writelines(base64.b64encode(e) + b" %d\n" % r for e, r in ranks.items())
    bpe = piecebpe.PieceBpe(path, P.PATTERN)
    assert bpe.whole == {b"abc": 256}
    assert list(memoryview(bpe.encode("abc abcd")).cast("I")) == [256, 32, 97, 98, 99, 100]


def test_op11_on_edge_rows(spark, ranks):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piecebpe.encode_documents(edge(spark)).collect()), key=repr)
    want = []
    for i, t, *_ in edge_rows():
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert piecebpe.encode_documents(empty(spark)).collect() == []


def brute(text, a, b):
    """Token counts, groups and links of one text, straight from the definition."""
    zero = (0, 0, 0, 0, Counter(), "")
    if not text:
        return zero
    from presslens.llm.bytebpe import _byte_letters

    letters = _byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ta = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
        return zero
    ends_a, ends_b = (np.cumsum([len(t) for t in ts]).tolist() for ts in (ta, tb))
    links, said, n, i, j = Counter(), [], 0, 0, 0
    cuts = sorted(set(ends_a) & set(ends_b))
    for cut in cuts:
        ga, gb = [], []
        while i < len(ids_a) and ends_a[i] <= cut:
            ga.append(ids_a[i])
            i += 1
        while j < len(ids_b) and ends_b[j] <= cut:
            gb.append(ids_b[j])
            j += 1
        links.update((x, y) for x in ga for y in gb)
        n += len(ga) * len(gb)
        said.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
    return len(ids_a), len(ids_b), len(cuts), n, links, ";".join(said)


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("large", [4096, 1])
def test_groups_and_links_of_texts(models, monkeypatch, large):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    pair = alignment.Pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    texts = strings(1500, 3) + strings(300, 4, "กขำ漢🙂 ")
    for text, got in zip(texts, pair.documents(texts), strict=True):
        links = Counter({divmod(p, pair.size_b): n for p, n in zip(got[4].tolist(), got[5].tolist(), strict=True)})
        assert (*got[:4], links, got[6]) == brute(text, *models)


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 40])
def test_op12_against_brute_force(spark, models, chunk):
    rows = [(i, t) for i, t, *_ in edge_rows()] + list(enumerate(strings(150, 8), 100))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, chunk int, places string").repartition(3)
    own = [(i, brute(t, *models)) for i, t in rows]
    held = Counter(p for _, x in own for p in x[4])
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    want = [(i, *x[:4], hashlib.sha256(x[5].encode()).hexdigest() if x[5] else "", sum(n for p, n in x[4].items() if held[p] == top[p[0]]),
             sum(n * held[p] for p, n in x[4].items())) for i, x in own]
    got = alignment.align_documents(docs, chunk=chunk).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_op12_of_an_empty_table_and_of_nulls(spark):
    assert alignment.align_documents(empty(spark)).collect() == []
    one = spark.createDataFrame([(None, None), (1, "")], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in alignment.align_documents(one).collect()} == {(0, 0, 0, 0, "", 0, 0)}
