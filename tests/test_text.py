from pyspark.sql import functions as F

from presslens.functions import text as T
from presslens.operators import text as TX


def one(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_word_boundary_unicode(spark):
    got = one(spark, ["aiø", "ai-løsning", "brug AI.", "mais", None],
              lambda c: T.keyword_score(c, ["AI"]))
    assert got == [0, 1, 1, 0, 0]


def test_plain_substring_hits_inside_words(spark):
    assert one(spark, ["mais"], lambda c: T.keyword_score_plain(c, ["ai"])) == [1]


def test_long_keyword_scores_twice_with_short(spark):
    # 'AI' by boundary and 'AI-etik' by substring
    assert one(spark, ["om AI-etik i dag"], lambda c: T.keyword_score(c, ["AI", "AI-etik"])) == [2]


def test_case_trap(spark):
    kws = ["OPENAI", "GPT"]
    assert one(spark, ["OPENAI og GPT"], lambda c: T.keyword_flag(c, kws, fold_keywords=False)) == [False]
    assert one(spark, ["OPENAI og GPT"], lambda c: T.keyword_score(c, kws)) == [2]
    assert one(spark, ["OPENAI og GPT"], lambda c: T.keyword_flag(c, kws, fold_keywords=True)) == [True]


def test_regex_flag_escapes(spark):
    assert one(spark, ["a+b here", "aab", None], lambda c: T.regex_flag(c, ["a+b"])) == [True, False, False]


def test_first_city_leftmost_and_capitalised(spark):
    got = one(spark, ["i ODENSE og aarhus", "intet", None], lambda c: T.first_city(c, ["Aarhus", "Odense"]))
    assert got == ["Odense", None, None]


def test_companies_in_list_order(spark):
    got = one(spark, ["Google og Novo Nordisk", "nothing", "googleplex"],
              lambda c: T.companies(c, ["Novo Nordisk", "Google"]))
    assert got == ["Novo Nordisk, Google", "", ""]


def test_actor_type_rules_in_order(spark):
    got = one(spark, ["Politiken", "FC Midtjylland", "Styrelsen for Data", "Novo A/S"], T.actor_type)
    assert got == ["Media", "Sports", "Public Authority", "Company"]


def test_likely_company(spark):
    got = one(spark, ["Novo Nordisk A/S", "DTU", "Udvalget", "ABC", "Abc"], T.likely_company)
    assert got == [True, False, False, False, True]


def test_sentiment_min_length_and_label(spark):
    lex = {"good": 1.0, "bad": -1.0}
    short = "good " * 9  # 45 chars -> null score -> Neutral
    long_ = "good " * 12
    df = spark.createDataFrame([(1, short), (2, long_), (3, None)], "orig_index long, plain_text string")
    out = TX.sentiment_label(TX.sentiment_score(df, lex))
    got = {r["orig_index"]: (r["sentiment"], r["sentiment_label"]) for r in out.collect()}
    assert got[1] == (None, "Neutral")
    assert got[2][1] == "Positive" and abs(got[2][0] - 12 / (144 + 15) ** 0.5) < 1e-12
    assert got[3] == (None, "Neutral")


def test_sentiment_label_threshold_exact(spark):
    assert one(spark, ["0.05", "-0.05", "0.0500001", None],
               lambda c: T.sentiment_label(c.cast("double"))) == ["Neutral", "Neutral", "Positive", "Neutral"]


def test_word_tokens_match_ascii_word_rule(spark):
    got = one(spark, ["The læring abc de x12 foo_bar Über cat"], lambda c: T.word_tokens(c))
    assert got == [["the", "abc", "cat"]]


def test_shorten_words(spark):
    assert one(spark, ["a b c d", "a  b"], lambda c: T.shorten_words(c, 3)) == ["a b c…", "a b"]
