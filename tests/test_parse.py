from pyspark.sql import functions as F

from presslens.functions import parse as P


def parse(spark, answers, fn):
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    return [r[0].asDict() for r in df.select(fn(F.col("a"))).collect()]


def test_parse5_edge_rows(spark):
    got = parse(spark, ["", "ja", "ja\n-5", "nej\nx\n42", None, "ja\n\n  \nAI policy\nnone\nsomething"],
                P.parse_answer5)
    assert got[0] == dict(is_ai_llm=False, ai_relevance_llm=0.0, ai_topic_llm="unknown", ai_barrier_llm=False,
                          ai_barrier_type_llm="none", ai_barrier_summary_llm="none")
    assert got[1]["ai_relevance_llm"] == 100.0 and got[1]["is_ai_llm"]
    assert got[2]["ai_relevance_llm"] == 5.0            # the sign is not part of the number
    assert got[3]["ai_relevance_llm"] == 42.0 and got[3]["ai_topic_llm"] == "42"   # first number anywhere
    assert got[4] == got[0]
    # blank lines are dropped before indexing
    assert (got[5]["ai_topic_llm"], got[5]["ai_barrier_type_llm"], got[5]["ai_barrier_llm"],
            got[5]["ai_barrier_summary_llm"]) == ("none", "something", True, "none")


def test_parse5_barrier_variants(spark):
    got = parse(spark, ["ja\n10\nt\nNo AI barrier\nsum", "ja\n10\nt\nCosts\nToo dear."], P.parse_answer5)
    assert got[0]["ai_barrier_llm"] is False and got[0]["ai_barrier_summary_llm"] == "none"
    assert got[1]["ai_barrier_llm"] is True and got[1]["ai_barrier_summary_llm"] == "Too dear."


def test_parse10_number_only_on_line_2(spark):
    ten = "ja\nhigh\n72\nb\ns\nc\nci\nin\nAI\nquote"
    five = parse(spark, [ten], P.parse_answer5)[0]
    tenp = parse(spark, [ten], P.parse_answer10)[0]
    assert five["ai_relevance_llm"] == 72.0
    assert tenp["ai_relevance_llm"] == 100.0


def test_parse10_evidence_flip(spark):
    got = parse(spark, ["ja\n80\ntopic\nbarrier\nsum\nDK\nAarhus\nmedia\nnone\nevidence"], P.parse_answer10)[0]
    assert got["is_ai_llm"] is False and got["ai_relevance_llm"] == 0.0 and got["ai_topic_llm"] == "unknown"
    assert all(got[k] == "none" for k in ("countries_llm", "cities_llm", "industries_llm", "ai_terms_llm",
                                           "ai_evidence_llm", "ai_barrier_type_llm"))


def test_parse10_nej_forces_none(spark):
    got = parse(spark, ["nej\n5\ntopic\nnone\nx\nDK\nA\nm\nAI\nquote"], P.parse_answer10)[0]
    assert got["ai_terms_llm"] == "none" and got["ai_evidence_llm"] == "none" and got["countries_llm"] == "DK"


def test_norm_list_and_evidence(spark):
    df = spark.createDataFrame([("AI, ai , ,Gpt",), ("N/A",), ("",), (None,), (" , ",)], "a string")
    assert [r[0] for r in df.select(P.norm_list(F.col("a"))).collect()] == ["AI, Gpt", "none", "none", "none", "none"]
    df2 = spark.createDataFrame([("et  citat\there",), ("NA",)], "a string")
    assert [r[0] for r in df2.select(P.norm_evidence(F.col("a"))).collect()] == ["et citat here", "none"]


def test_to_bool(spark):
    df = spark.createDataFrame([("JA",), (" yes",), ("0",), ("nan",), (None,), ("True",)], "a string")
    assert [r[0] for r in df.select(P.to_bool(F.col("a"))).collect()] == [True, True, False, None, None, True]


def test_valid_format(spark):
    good = "ja\n55\n" + "\n".join(["x"] * 8)
    df = spark.createDataFrame([(good,), ("ja\nhigh\n" + "\n".join(["x"] * 8),), ("ja",), ("",)], "a string")
    assert [r[0] for r in df.select(P.valid_format(F.col("a"))).collect()] == [True, False, False, False]
