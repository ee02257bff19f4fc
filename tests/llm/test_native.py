"""Chat snapshots, ring sharding, host rules and Bloom de-duplication."""

import zlib
from collections import Counter

from llm.helpers import edge, empty
from presslens.llm import bloomdedup, chat, hostrules, ring


def turns(spark, data):
    return spark.createDataFrame([(c, t, r, x, "extra") for c, t, r, x in data],
                                 "conv_id bigint, turn bigint, role string, text string, chat string")


def test_snapshots_collapse_to_the_longest(spark):
    full = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    data = [(conv, i, *full[i]) for conv, n in ((1, 2), (2, 4), (3, 4), (4, 3)) for i in range(n)]
    data += [(5, 0, "user", "a"), (5, 1, "assistant", "other")]
    data += [(6, 0, "assistant", "b"), (None, 0, "user", "lost"), (5, 1, "assistant", "other")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chat.collapse_and_format(turns(spark, data)).collect()}
    assert sorted(got) == [2, 5, 6]
    assert got[2][:2] == (4, 2) and got[5][:2] == (2, 1)
    assert got[6][2] == "<|assistant|>\nb\n<|end|>\n"


def test_chat_nulls_and_empty_table(spark):
    data = [(1, 0, None, None), (1, 1, "user", ""), (2, 0, "unknown", ""), (3, None, "user", "x")]
    got = {r["conv_id"]: r["chat"] for r in chat.collapse_and_format(turns(spark, data)).collect()}
    assert got[1] == "<|unknown|>\n\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert set(got) == {1, 2, 3}
    assert chat.collapse_and_format(turns(spark, []).limit(0)).count() == 0


def shards_of(df, n):
    return {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in ring.shard_documents(df, n).collect()}


def test_shards_are_even_gapless_and_move_little(spark):
    df = spark.range(6007).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    a, b = shards_of(df, 24), shards_of(df, 25)
    sizes = Counter(s for s, _ in a.values())
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(slot for x, slot in a.values() if x == s) == list(range(sizes[s]))
    assert sum(a[k][0] != b[k][0] for k in a) < 0.25 * len(a)
    assert a == shards_of(df.repartition(3), 24)


def test_ring_walk_matches_document_by_document(spark):
    import numpy as np

    counts, owners = np.array([5, 0, 7, 1, 2]), np.array([0, 1, 0, 2, 1])
    capacity = ring.capacities(15, 3)
    cuts = ring.walk(counts, owners, capacity)
    place = {}
    for arc, n in enumerate(counts):
        for rank in range(n):
            arc_cuts = [c for c in cuts if c[0] == arc and c[1] <= rank]
            _, start, shard, slot = max(arc_cuts, key=lambda c: c[1])
            place[arc, rank] = shard, slot + rank - start
    assert len(set(place.values())) == 15
    assert sorted(Counter(s for s, _ in place.values()).values()) == [5, 5, 5]


def test_ring_edges(spark):
    rows = ring.shard_documents(edge(spark), 4).collect()
    assert len(rows) == edge(spark).count()
    assert all(r["grown_shard"] is None and r["law"] == "rows" for r in rows)
    for r in edge(spark).collect():
        data = (r["text"] or "").encode()
        assert any(x["doc_id"] == r["doc_id"] and x["size"] == len(data) + 8 and x["text_crc32"] == zlib.crc32(data) for x in rows)
    assert ring.shard_documents(empty(spark), 4).count() == 0


def plain_measures(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_against_plain_python(spark):
    got = sorted((tuple(r)[2:] for r in hostrules.measures(edge(spark)).select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    assert got == sorted(plain_measures(r["text"]) for r in edge(spark).collect())
    assert hostrules.host_verdicts(empty(spark)).count() == 0


def test_bad_host_loses_its_pages_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(200)] + [(1000 + i, "short", "bad") for i in range(60)]
    rows += [(2000, good, "bad"), (3000, "short", "tiny"), (3001, good, "tiny"), (4000, good, None)]
    rows += [(5000 + i, good if i % 10 else "short", f"h{i % 7}") for i in range(140)]
    got = {r["doc_id"]: r for r in hostrules.host_verdicts(
        spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not got[2000]["kept"] and got[2000]["host_failed"] and not got[2000]["base_failed"]
    assert got[3001]["kept"] and not got[3000]["kept"]
    assert got[4000]["kept"] and got[0]["kept"]


def test_bloom_copies_edges(spark):
    rows = bloomdedup.exact_copies(edge(spark)).collect()
    assert len(rows) == edge(spark).count()
    groups = {}
    for r in edge(spark).collect():
        key = b" ".join((r["text"] or "").encode().split()) if (r["text"] or "").encode().split() else (b" " if r["text"] else b"")
        groups.setdefault((key, (r["text"] or "")[:1].isspace(), (r["text"] or "")[-1:].isspace()), []).append(r["doc_id"])
    want = Counter((min((i for i in v if i is not None), default=None), len(v)) for v in groups.values())
    kept = [r for r in rows if r["kept"]]
    assert Counter((r["keep_id"], r["group_size"]) for r in kept) == want
    assert bloomdedup.exact_copies(empty(spark)).count() == 0


def test_saturated_filter_gives_the_same_answer(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('t', id % 1700) AS text")
    wide = sorted(map(tuple, bloomdedup.exact_copies(df).collect()))
    assert wide == sorted(map(tuple, bloomdedup.exact_copies(df, cells=bloomdedup.BUCKET).collect()))
    assert sum(r[3] for r in wide) == 1700


def test_certainly_unique_rows_pass_the_filter(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "concat('u', id) AS text")
    rows = df.withColumns(dict(zip(("c1", "c2"), bloomdedup._cells(bloomdedup.normalised(), bloomdedup.CELLS), strict=True)))
    flagged = bloomdedup.with_possible(rows, bloomdedup.repeated_cells(rows, "c1", "c2"), "c1", "c2", "p")
    assert flagged.filter("p").count() < 20


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    out = bloomdedup.drop_copies(edge(spark))
    assert out.columns == edge(spark).columns
    keys = [" ".join((r["text"] or "").split()) for r in out.collect() if (r["text"] or "").strip()]
    assert len(keys) == len(set(keys))
    assert bloomdedup.drop_copies(empty(spark)).count() == 0
