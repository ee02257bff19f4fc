"""Near copies when rows are repeated with their id."""

import pytest
from llm.helpers import brute_classes
from llm.test_models import near_docs
from presslens.llm import hyperminhash


@pytest.mark.parametrize("rare", [3, 64])
def test_repeated_rows_lose_no_link(spark, monkeypatch, rare):
    docs = near_docs()
    monkeypatch.setattr(hyperminhash, "RARE", rare)
    df = spark.createDataFrame([d for d in docs for _ in range(1 + d[0] % 4)], "doc_id bigint, text string").repartition(5)
    got = hyperminhash.near_classes(df).collect()
    assert len(got) == sum(1 + i % 4 for i, _ in docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(docs)


def test_bound_counts_a_repeated_document_once(spark):
    # 100 shingles each, 93 shared, all rare: similarity 93 / 107, a link that only the bound can still find
    words = [f"w{i}" for i in range(104)]
    docs = [(1, " ".join(words))] * 3 + [(2, " ".join(words[:97] + [f"x{i}" for i in range(7)]))] * 2
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    nodes = spark.createDataFrame([(i, *hyperminhash._digest(hyperminhash.shingles(t)), c) for i, t, c in ((*docs[0], 3), (*docs[3], 2))],
                                  "node bigint, hi bigint, lo bigint, rows bigint")
    contents = hyperminhash._contents(df, nodes, "doc_id", "text")
    assert contents.count() == 2
    open_keys = spark.createDataFrame([(7, 1, 1, 1), (7, 2, 2, 1)], "key bigint, node bigint, part bigint, main bigint")
    assert [tuple(r) for r in hyperminhash._open_pairs(open_keys, contents).collect()] == [(1, 2)]


def test_an_id_with_two_texts_loses_only_the_copy(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(3, b, "x", "y"), (7, a, "x", "y"), (7, b, "x", "y"), (8, None, "x", "y"), (None, b, "x", "y")],
                                 "doc_id bigint, text string, __owner string, __set string")
    got = hyperminhash.drop_near_copies(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(3, b, "x", "y"), (7, a, "x", "y"), (8, None, "x", "y"), (None, b, "x", "y")], key=repr)
