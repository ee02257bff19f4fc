"""Every numeric and vector operator on empty tables, one row, constants, nulls, NaN and zero vectors."""

import math

import numpy as np
import pytest
from conftest import rows
from presslens.operators import aggregates as A
from presslens.operators import clustering as M
from presslens.operators import vectors as V
from presslens.operators import windows as W
from presslens.operators.clean import select_existing
from pyspark.sql import functions as F

NAN = float("nan")
TABLES = {"empty": [], "one": [(1.0, 2.0)], "constant": [(3.0, 1.0), (3.0, 2.0), (3.0, 4.0)], "nulls": [(None, 1.0), (None, None), (None, 5.0)],
          "nan": [(NAN, 1.0), (1.0, 2.0), (2.0, 5.0), (4.0, 4.0)], "plain": [(1.0, 2.0), (2.0, 4.5), (4.0, 1.0), (None, 3.0)]}


@pytest.mark.parametrize("name", TABLES)
def test_numeric_operators(spark, name):
    df = spark.createDataFrame(TABLES[name], "a double, b double").repartition(2)
    values = [a for a, _ in TABLES[name] if a is not None and not math.isnan(a)]
    grid = A.density(df, "a", [0.0, 1.0]).collect()
    assert len(grid) == 2 and all((r["density"] is None) == (len(set(values)) < 2) for r in grid)
    binned = A.density_binned(df, ["a", "b"], points=5).filter("column = 'a'").collect()
    assert len(binned) == (0 if not values else 5 if len(set(values)) > 1 else 1)
    scaled = [r["a_norm"] for r in A.minmax(df, "a", eps=None).collect()]
    assert name != "constant" or scaled == [None] * 3
    pair = A.corr(df, ["a", "b"]).collect()
    wide = A.corr_wide(df, ["a", "b"]).collect()
    assert [(r["x"], r["y"]) for r in pair] == [("a", "b")]
    if name == "plain":
        want = np.corrcoef([1, 2, 4], [2, 4.5, 1])[0, 1]
        assert abs(pair[0]["corr"] - want) < 1e-12 and abs(wide[0]["corr"] - want) < 1e-12
    elif name != "nan":
        assert pair[0]["corr"] is None and all(r["corr"] is None for r in wide)
    assert A.corr(df, ["a"]).collect() == [] and A.corr_wide(df, ["a"]).collect() == []
    A.histogram(df.filter(~F.isnan("a")), "a", 3).collect()


def test_wide_correlation_and_binned_density_equal_the_direct_sums(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(400, 30)) * 3 + 1e6
    X[:, 7] = 2.5
    X[::9, 3] = np.nan
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in X], ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {(r["x"], r["y"]): r["corr"] for r in A.corr_wide(df, names).collect()}
    assert len(got) == 30 * 29 // 2
    for (x, y), v in got.items():
        i, j = int(x[1:]), int(y[1:])
        ok = ~np.isnan(X[:, i]) & ~np.isnan(X[:, j])
        if 7 in (i, j):
            assert v is None
        else:
            assert abs(v - np.corrcoef(X[ok, i], X[ok, j])[0, 1]) < 1e-8
    for c in ("c0", "c3"):
        places = A.density_binned(df, ["c0", "c3"], points=40).filter(F.col("column") == c).orderBy("grid_index").collect()
        direct = [r["density"] for r in A.density(df, c, [r["x"] for r in places]).orderBy("grid_index").collect()]
        assert max(abs(r["density"] - d) for r, d in zip(places, direct, strict=True)) < 1e-4 * max(direct)


VECTORS = {"empty": [], "null": [(1, None)], "zero": [(1, [0.0, 0.0]), (2, [1.0, 0.0])], "plain": [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])]}


@pytest.mark.parametrize("name", VECTORS)
@pytest.mark.parametrize("queries", ["empty", "zero", "plain"])
def test_vector_operators(spark, name, queries):
    df = spark.createDataFrame(VECTORS[name], "orig_index bigint, embedding array<double>")
    q = spark.createDataFrame([(f"n{i}", i, e) for i, e in VECTORS[queries]], "name string, phrase_no int, embedding array<double>")
    for f in (V.semantic_score, V.centroid_query_score, V.multi_phrase_scores):
        assert len(f(df, q).collect()) == len(VECTORS[name])
    assert len(V.contrastive_score(df, q, q).collect()) == len(VECTORS[name])
    if queries == "empty":
        assert {r["ai_score"] for r in V.semantic_score(df, q).collect()} <= {None}
        assert {r["event_type"] for r in V.classify_by_prototype(df, q).collect()} <= {None}
    centroids = q.select(F.col("phrase_no").alias("cluster"), F.col("embedding").alias("centroid"))
    got = V.assign_nearest(df, centroids).collect()
    assert all((r["prediction"] is None) == (r["embedding"] is None or queries == "empty") for r in got)


def test_table_forms_equal_the_collected_forms(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)] if i % 11 else None) for i in range(120)] + [(500, [0.0] * 6), (500, [0.0] * 6)],
                               "orig_index bigint, embedding array<double>").repartition(3)
    table = spark.createDataFrame([(f"p{i % 40:02d}", i, [float(x) for x in rng.normal(size=6)]) for i in range(80)], "name string, phrase_no int, embedding array<double>")
    cen = table.select(F.col("phrase_no").alias("cluster"), F.col("embedding").alias("centroid"))
    want = sorted(rows(V.assign_nearest(df, cen), "orig_index", "prediction"), key=repr), sorted(rows(V.classify_by_prototype(df, table), "orig_index", "event_type"), key=repr)
    monkeypatch.setattr(V, "MAX_QUERY_VECTORS", 10)
    got = sorted(rows(V.assign_nearest(df, cen), "orig_index", "prediction"), key=repr), sorted(rows(V.classify_by_prototype(df, table), "orig_index", "event_type"), key=repr)
    assert got == want
    plain = V.nearest_in_table(df, cen, most_cells=5, block_rows=4)
    assert sorted(rows(plain, "orig_index", "prediction"), key=repr) == want[0]


def test_density_clusters_of_empty_tables_and_null_vectors(spark):
    schema = "orig_index bigint, embedding array<double>"
    assert M.density_clusters(spark.createDataFrame([], schema), 1.0).collect() == []
    got = M.density_clusters(spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [0.0, 0.1]), (4, [0.1, 0.0])], schema), 1.0, 3, 2).collect()
    assert dict(map(tuple, got)) == {1: -1, 2: 2, 3: 2, 4: 2}


def test_centroid_of_opposite_vectors_and_elbow_with_a_perfect_fit(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0])], "cluster int, embedding array<double>")
    assert V.cluster_centroids(df).first()["centroid"] == [0.0, 0.0]
    curve = spark.createDataFrame([(1, 100.0), (2, 20.0), (3, 10.0), (4, 0.0)], "k bigint, inertia double")
    assert M.elbow_pick(curve).first()["best_k"] == 2
    assert M.elbow_pick(curve.filter("k = 4")).first()["best_k"] is None


def test_unicode_blanks_and_previews(spark):
    df = spark.createDataFrame([("\u00a0AI\u2003",), ("AI",), ("\u00a0",), (None,), ("a\u00a0b\u3000c d",)], "t string")
    assert sorted(r[0] for r in W.distinct_labels(df, "t").collect()) == ["AI", "a\u00a0b\u3000c d"]
    from presslens.functions.text import shorten_words
    assert df.filter("t LIKE 'a%'").select(shorten_words(F.col("t"), 2)).first()[0] == "a b…"
    words = A.keyword_word_counts(df, ["b", "d"], "t")
    assert {r["word"] for r in words.collect()} == {"b", "d"}
    many = spark.createDataFrame([(i, str(i)) for i in range(50, 0, -1)], "k int, v string").repartition(4)
    assert [r["k"] for r in select_existing(many, ["k", "x"], 3).collect()] == [1, 2, 3]
