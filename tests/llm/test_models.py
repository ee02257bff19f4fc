"""Language identification, surrogates, near copies and the pipeline."""

import random
import re

import corpus_pipeline
from conftest import SF001
from llm.helpers import SCHEMA, brute_classes, edge, edge_rows, empty
from presslens.llm import hyperminhash, langid, surrogates


def test_held_out_accuracy_and_inputs(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.predict_documents(docs).collect()}
    held = [r for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert held and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # labels of held-out rows are not looked at
    blind = docs.selectExpr("doc_id", "text", "CASE WHEN pmod(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)), 4) = 2 THEN 'xx' ELSE lang END AS lang")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict_documents(blind).collect()} == {k: r["lang_pred"] for k, r in got.items()}


def test_foreign_scripts_are_rejected_and_short_words_are_not(spark):
    model = langid.fit(spark.read.parquet(f"{SF001}/documents.parquet"))
    assert model.predict("это текст на языке которого в корпусе нет " * 10)[2]
    assert not model.predict("the")[2] and not model.predict("Avec.")[2]
    assert model.predict("12 34 ##") == ("und", 0.0, True) == model.predict(None) == model.predict("")


def test_language_edges(spark):
    got = langid.predict_documents(edge(spark)).collect()
    assert len(got) == edge(spark).count()
    for text, row in zip([r["text"] for r in edge(spark).orderBy("doc_id").collect()], sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"])), strict=True):
        if row["doc_id"] is not None and not (text or "").strip():
            assert row["lang_pred"] == "und" and row["score"] == 0 and row["rejected"]
    assert langid.predict_documents(empty(spark)).count() == 0
    unlabelled = edge(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in langid.predict_documents(unlabelled).collect()} == {"und"}


def test_surrogates_keep_kind_format_and_identity():
    text = 'Mail Ann.19@mail5.example.com / ANN.19@MAIL5.EXAMPLE.COM, +1 (743) 555-3824, 4111 1111 1111 1111, 227.5.221.1, "04dbebab91ab85687d33eeaaf9ac699e1188f962", DE89 3704 0044 0532 0130 00'
    new, n = surrogates.replace(text, {})
    assert n == 7
    old, got = surrogates.find(text), surrogates.find(new)
    assert [k for _, _, k, _ in old] == [k for _, _, k, _ in got]
    assert got[0][3] == got[1][3] and new[got[1][0]:got[1][1]].isupper()
    assert not {f for *_, f in old} & {f for *_, f in got}
    assert surrogates.luhn(next(f for *_, k, f in got if k == "card")) == 0
    assert surrogates.replace(text, {})[0] == new != surrogates.replace(text, {}, b"other key")[0]


def test_names_keep_gender_and_script():
    new, n = surrogates.replace("Mrs. Anna Smith saw Herr Müller und Госпожа Иванова; Mrs. Anna Smith left.", {})
    assert n == 4 and "Smith" not in new and "Müller" not in new and "Иванова" not in new
    first = new.split()[1]
    assert first in surrogates.FIRST["latin", "f"] and new.count(first) == 2
    assert "Ѐ" <= new.split("Госпожа ")[1][0] <= "ӿ"


def test_other_numbers_are_left_alone():
    for text in ("1234567890123456", "version 1.2.3.4.5", "300.1.1.1", "in 1999 and 2024-05-06", "a@b", "abcdef" * 6, "", None):
        assert surrogates.replace(text, {}) == (text, 0)


def test_collisions_are_drawn_again(spark, monkeypatch):
    # 1-digit addresses: 10,000 replacements for 600 entities collide for sure
    rng = random.Random(2)
    forms = sorted({".".join(str(rng.randint(0, 9)) for _ in range(4)) for _ in range(600)})
    df = spark.createDataFrame([(i, f"see {f} and {forms[i // 2]}") for i, f in enumerate(forms)], "doc_id bigint, text string")
    again = surrogates.settle(surrogates.entities(df)).collect()
    assert again
    out = {r["doc_id"]: r["text"] for r in surrogates.surrogate_documents(df).collect()}
    mapped = {}
    for i, f in enumerate(forms):
        a, b = (x[3] for x in surrogates.find(out[i]))
        assert mapped.setdefault(f, a) == a and mapped.setdefault(forms[i // 2], b) == b
    assert len(set(mapped.values())) == len(forms) and not set(mapped.values()) & set(forms)
    monkeypatch.setattr(surrogates, "MOST_SHIPPED", 0)  # the way by a join
    assert {r["doc_id"]: r["text"] for r in surrogates.surrogate_documents(df).collect()} == out


def test_surrogate_edges(spark):
    out = surrogates.with_surrogates(edge(spark))
    assert out.columns == edge(spark).columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, out.collect())) == sorted(map(key, edge(spark).collect()))
    assert surrogates.surrogate_documents(empty(spark)).count() == 0


def near_docs():
    """Random prose with copies at many distances, some of them around the threshold, and a shared line."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choice(words) for _ in range(12))
    docs = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([4, 7, 12, 60, 150]))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            new = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                new[rng.randrange(len(new))] = rng.choice(words)
            docs.append("  ".join(new).upper())
        docs.append(line + " " + " ".join(rng.choice(words) for _ in range(8)))
    hub = [rng.choice(words) for _ in range(120)]
    for _ in range(90):  # one large group, its members at and beyond the threshold from one another
        new = list(hub)
        for _ in range(rng.randint(1, 3)):
            new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(new))
    return list(enumerate(docs))


def test_near_classes_equal_brute_force(spark):
    docs = near_docs()
    got = hyperminhash.near_classes(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_rare_bound_is_exact_for_any_limit(spark, monkeypatch):
    docs = near_docs()
    monkeypatch.setattr(hyperminhash, "RARE", 3)
    got = hyperminhash.near_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(docs)


def test_estimates_follow_the_true_similarity():
    rng = random.Random(3)
    for share in (0.3, 0.6, 0.85, 0.95):
        a = [rng.random() for _ in range(600)]
        b = [x if rng.random() < share else rng.random() for x in a]
        sets = [hyperminhash.np.unique(hyperminhash._mix(hyperminhash.np.array([int(x * 2**60) for x in s], "u8"))) for s in (a, b)]
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        guess, used = hyperminhash.estimate(*(hyperminhash.sketch(s) for s in sets), *(len(s) for s in sets))
        assert abs(guess - true) < 6 * (0.25 / used) ** 0.5


def test_near_edges(spark):
    rows = hyperminhash.near_classes(edge(spark)).collect()
    assert len(rows) == edge(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], r)
    assert by[5]["component_id"] == 5 and by[6]["component_id"] == 5 and not by[13]["kept"]
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[2]["kept"] and by[4]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert hyperminhash.near_classes(empty(spark)).count() == 0
    assert hyperminhash.drop_near_copies(edge(spark)).columns == edge(spark).columns


def test_pipeline_stage_by_stage(spark):
    docs = spark.createDataFrame(edge_rows() + [(100 + i, t, "en", "a", len(t), "k", "s", 1, 2) for i, (_, t) in enumerate(near_docs())], SCHEMA)
    model = langid.fit(docs.filter(~langid.held_out()))
    at = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = at.collect()
        at = stage(spark, at, SF001)
        rows = at.collect()
        if number < 4:
            assert at.columns == docs.columns
        if number == 0:
            assert sorted(str(r) for r in rows) == sorted(str(r) for r in before if not model.predict(r["text"])[2])
        elif number == 1:
            norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in rows]
            assert len(norm) == len(set(norm))
            assert set(norm) == {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in before}
        elif number == 2:
            known = [(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None]
            classes = brute_classes(known)
            assert {r["doc_id"] for r in rows} - {None} == {i for i, (_, c) in classes.items() if i == c}
        elif number == 3:
            assert [r["n_chars"] for r in rows] == [len(r["text"]) for r in rows]
        else:
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF001).count() == 0
