"""Host-level quality rules (native DataFrame code only).

Every document is measured once (words, symbols, repeated lines, repeated 3-word windows) and judged by
the base rules.  Failures are added up by host; the rate of a host is shrunk towards the corpus by a beta
prior fitted to all hosts by moments, so that a host of three pages is not condemned by one of them.
The verdict on the host is joined back to its documents.

Defined results: null text counts as no words (and fails the word minimum); a document without a host is
judged by the base rules alone; empty tables give empty tables; repeated rows are judged one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import BLANKS, staged, text_or_empty

#: Fewest words of a page.
MIN_WORDS = 50
#: Largest share, in percent, of words in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
#: A host whose shrunk failure rate is above this loses all its pages.
MAX_HOST_RATE = 0.5
#: Limits of the prior's strength, in pages.
STRENGTH = (1.0, 1e6)
#: Shares into which the pages of one host are dealt for the join with the host verdicts.
SALTS = 64


def measures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the text measures, one row per document."""
    has_word = r"[^\x20\x09-\x0D]"
    split = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host).cast("string").alias("host"), text_or_empty(text).alias("txt"),
    ).select(
        "doc_id", "host", F.array_remove(F.split("txt", BLANKS), "").alias("words"),
        F.regexp_count("txt", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.filter(F.split("txt", "\n", -1), lambda line: line.rlike(has_word)).alias("lines"),
    )
    windows = split.select(
        "doc_id", "host", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("words") >= 3, F.expr(
            "slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, size(words) - 2)"
        )).otherwise(F.expr("CAST(array() AS array<bigint>)")).alias("win"),
    )
    # equal windows are neighbours once sorted; texts without any repeat skip the sort
    order = windows.withColumn("ord", F.expr(
        "CASE WHEN size(array_distinct(win)) < size(win) "
        "THEN sort_array(transform(win, (h, i) -> named_struct('h', h, 'i', i))) "
        "ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END"))
    again = ("filter(ord, (x, j) -> (j > 0 AND x.h = get(ord, j - 1).h) "
             "OR (j < size(ord) - 1 AND x.h = get(ord, j + 1).h))")
    return order.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(f"CAST(size(array_distinct(flatten(transform({again}, x -> array(x.i, x.i + 1, x.i + 2))))) AS bigint)")
        .alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """host, pages, failures, rate (posterior mean under the beta prior fitted to all hosts)."""
    hosts = judged.filter(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("pages"), F.sum(F.col("base_failed").cast("bigint")).alias("failures"))
    # three sums over all hosts: one row, whatever the input
    total = hosts.agg(F.sum("pages").alias("n"), F.sum("failures").alias("f"),
                      F.sum(F.col("failures") * F.col("failures") / F.col("pages")).alias("ff")).first()
    n, f, ff = (total["n"] or 0), (total["f"] or 0), (total["ff"] or 0.0)
    mean = f / n if n else 0.0
    spread = max(ff / n - mean * mean, 0.0) if n else 0.0
    low, high = STRENGTH
    strength = min(max(mean * (1 - mean) / spread - 1, low), high) if spread > 0 else high
    return hosts.withColumn("rate", (F.col("failures") + F.lit(mean * strength)) / (F.col("pages") + F.lit(strength)))


def host_verdicts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Measures, base_failed, kept, host and host_failed per document."""
    judged = staged(measures(docs, id_col, text, host).withColumn("base_failed", base_failed()), "pages")
    rates = host_rates(judged).select("host", (F.col("rate") > MAX_HOST_RATE).alias("bad"))
    spread = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "h")
    dealt = judged.withColumn("s", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(spread, (F.col("host") == F.col("h")) & (F.col("s") == F.col("salt")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce("bad", F.lit(False))).alias("kept"), "host",
        F.coalesce("bad", F.lit(False)).alias("host_failed"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, (words[i], words[i + 1], words[i + 2]) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS pages, sum(CAST(base_failed AS BIGINT)) AS failures FROM j WHERE host IS NOT NULL GROUP BY host),
t AS (SELECT sum(pages) AS n, sum(failures) / sum(pages) AS mean,
             greatest(sum(failures * failures / pages) / sum(pages) - (sum(failures) / sum(pages)) ** 2, 0) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM t),
r AS (SELECT host, (failures + mean * strength) / (pages + strength) > 0.5 AS bad FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(bad, false) AS kept, j.host, coalesce(bad, false) AS host_failed
FROM j LEFT JOIN r ON j.host = r.host
"""
