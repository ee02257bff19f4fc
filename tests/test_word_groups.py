"""Word counts by group within a capped vocabulary."""

from presslens.operators.aggregates import grouped_word_counts


def test_vocabulary_is_of_all_rows_and_ties_go_to_the_smaller_word(spark):
    rows = [("a", "bee bee cat cat dog"), ("a", "ant the x"), ("b", "cat dog dog"), ("b", None), (None, "ant ant ant ant ant ant"), ("c", "emu")]
    df = spark.createDataFrame(rows, "g string, plain_text string")
    got = sorted(tuple(r) for r in grouped_word_counts(df, "g", stop=["the"], top=2, vocab=3).collect())
    # in all: cat 3, dog 3, bee 2; emu and ant lie beyond the vocabulary, the row without a group counts for nothing
    assert got == [("a", "bee", 2), ("a", "cat", 2), ("b", "cat", 1), ("b", "dog", 2)]
    assert grouped_word_counts(df.limit(0), "g").count() == 0


def test_frequent_words_equal_the_full_count(spark):
    from pyspark.sql import functions as F

    from presslens.operators.aggregates import frequent_word_counts, word_counts

    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = [f"zz{letters[i // 676]}{letters[i // 26 % 26]}{letters[i % 26]}" for i in range(8000)]
    rows = [(" ".join(["ant"] * (i % 3) + ["bee", "cat", "the"] + rare[4 * i:4 * i + 4]),) for i in range(2000)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "plain_text string").repartition(7)

    def same(top, **more):
        got = [tuple(r) for r in frequent_word_counts(df, stop=["the"], top=top, **more).orderBy(F.col("count").desc(), "word").collect()]
        assert got == [tuple(r) for r in word_counts(df, stop=["the"], top=top).orderBy(F.col("count").desc(), "word").collect()]
        return got

    # ties at the top go to the smaller word
    assert same(3, support=0.01) == [("bee", 2000), ("cat", 2000), ("ant", 1999)]
    # the fourth word is no frequent one: all words are counted
    assert same(4, support=0.01)[3] == (min(rare), 1)
    assert frequent_word_counts(df.limit(0), top=3).count() == 0


def test_only_candidates_of_frequent_words_shuffle(spark):
    from presslens.operators.aggregates import frequent_word_counts

    df = spark.createDataFrame([("ant bee bee",)] * 50, "plain_text string")
    # the proven answer is read from the counted candidates, not from the texts
    plan = frequent_word_counts(df, top=1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
