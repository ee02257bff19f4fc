"""Model labelling as Spark jobs.

The model is an injected callable ``model(list[str]) -> list[str]``; Spark
partitions the rows, and each Python worker calls the model on Arrow batches
(``mapInPandas``), ``batch_size`` prompts at a time.  Answers are keyed by
``orig_index`` so nothing depends on row position.  Parsing, normalising and
merging are built-in Column expressions.  Resume is an anti join against the
labels already written, so a rerun never asks the model about finished work;
retries ask again about the malformed rows only, inside the same task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.functions import parse as P
from presslens.functions.text import regex_escape
from presslens.session import checkpoint_path

PROMPT_HEAD = (
    "Classify the news article below. Answer in five lines:\n"
    "1) ja if the article is mainly about artificial intelligence, machine learning, language models or "
    "automation, otherwise nej\n"
    "2) how strongly it is about AI, a number from 0 to 100\n"
    "3) a short English topic label\n"
    "4) a short English label of an AI barrier it discusses, or none\n"
    "5) one English sentence describing that barrier, or none\n\n"
    "Article:\n"
)
PROMPT_TAIL = "\n\nAnswer:"
RETRY_PREFIX = "FORMAT ERROR: answer with exactly the requested lines and nothing else.\n"


def build_prompt(df: DataFrame, text_col: str = "plain_text", out: str = "prompt", head: str = PROMPT_HEAD,
                 tail: str = PROMPT_TAIL, max_chars: int | None = None) -> DataFrame:
    """Prompt column = head + text (optionally cut to ``max_chars``) + tail; null text -> ''."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if max_chars:
        text = F.substring(text, 1, max_chars)
    return df.withColumn(out, F.concat(F.lit(head), text, F.lit(tail)))


def label_batches(df: DataFrame, model: Callable[[list[str]], Sequence[str]], key: str = "orig_index",
                  prompt_col: str = "prompt", out: str = "answer", batch_size: int = 32) -> DataFrame:
    """One answer per input row, ``(key, answer)``; the model runs inside the executors.

    ``model`` must be picklable; it is shipped once per task and called on ``batch_size`` prompts.
    Repartition the input first (e.g. ``repartition(n, key)``) to spread rows over model workers.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            prompts = pdf[prompt_col].fillna("").astype(str).tolist()
            answers: list[str] = []
            for i in range(0, len(prompts), batch_size):
                answers.extend(str(a) if a is not None else "" for a in model(prompts[i:i + batch_size]))
            pdf = pdf[[key]].copy()
            pdf[out] = answers
            yield pdf

    return df.select(key, prompt_col).mapInPandas(run, f"{key} {key_type}, {out} string")


def yes_no(df: DataFrame, col: str = "answer", out: str = "is_ai_label") -> DataFrame:
    """L03."""
    return df.withColumn(out, P.yes_no(F.col(col)))


def parse_answers(df: DataFrame, col: str = "answer", ten_lines: bool = False) -> DataFrame:
    """Typed label columns from the answer text (struct expanded)."""
    # the split lines are a column of their own, so every field reads them instead of re-splitting
    staged = df.withColumn("_lines", P.answer_lines(F.col(col)))
    lines = F.col("_lines")
    parsed = P.parse_answer10(F.col(col), lines) if ten_lines else P.parse_answer5(F.col(col), lines)
    return staged.withColumn("_p", parsed).select(*[c for c in df.columns], "_p.*")


def retry_invalid(df: DataFrame, model: Callable, key: str = "orig_index", prompt_col: str = "prompt",
                  answer_col: str = "answer", max_retry: int = 1, prefix: str = RETRY_PREFIX,
                  min_lines: int = 10, batch_size: int = 32) -> DataFrame:
    """Re-ask rows whose answer is malformed, with a stricter prompt; still bad -> ''.

    ``df`` holds (key, prompt, answer).  Prompt and answer stay in their row: each round marks the
    malformed rows in the JVM and asks the model for those only, in the same task, with no join,
    no shuffle and nothing written between rounds.  Write ``df`` and the result (as L10 does) where
    a second evaluation would ask the model again.
    """
    valid = P.valid_format(F.col(answer_col), min_lines)

    def again(batches):
        for pdf in batches:
            bad = pdf.index[~pdf["_ok"]]
            prompts = pdf.loc[bad, prompt_col].fillna("").astype(str).tolist()
            answers: list[str] = []
            for i in range(0, len(prompts), batch_size):
                answers.extend(str(a) if a is not None else "" for a in model(prompts[i:i + batch_size]))
            pdf.loc[bad, answer_col] = answers
            yield pdf

    cur = df.select(key, prompt_col, answer_col)
    for _ in range(max_retry):
        asked = cur.withColumn("_ok", F.coalesce(valid, F.lit(False))).withColumn(
            prompt_col, F.when(F.col("_ok"), F.col(prompt_col)).otherwise(F.concat(F.lit(prefix), F.col(prompt_col))))
        cur = asked.mapInPandas(again, asked.schema).drop("_ok")
    return cur.withColumn(answer_col, F.when(valid, F.col(answer_col)).otherwise(F.lit("")))


def _written(df: DataFrame, path: str, schema: str) -> DataFrame:
    """The table below ``path``, or no rows where nothing has been written yet."""
    try:
        return df.sparkSession.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # only a missing log means that nothing is done
            raise
        return df.sparkSession.createDataFrame([], schema)


def read_label_log(df: DataFrame, path: str, key: str = "orig_index") -> DataFrame:
    """(key, answer) of the committed attempts below ``path``; ``df`` gives the type of the key."""
    kind = df.schema[key].dataType.simpleString()
    log = _written(df, f"{path}/rows", f"`{key}` {kind}, answer string, chunk int, attempt string")
    return log.join(_written(df, f"{path}/commits", "attempt string, chunk int"), ["chunk", "attempt"], "left_semi").select(key, "answer")


def _commit(df: DataFrame, path: str, attempt: str, chunk: int) -> None:
    """The record that makes one attempt of a chunk visible: a table of one row, which appears as a whole or not at all."""
    df.sparkSession.createDataFrame([(attempt, chunk)], "attempt string, chunk int").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def checkpointed_labels(df: DataFrame, model: Callable, path: str, key: str = "orig_index",
                        prompt_col: str = "prompt", chunks: int = 4, batch_size: int = 32) -> DataFrame:
    """Label in ``chunks`` committed pieces under ``path``; a rerun labels only what is missing.

    The pending prompts are dealt into chunks in one scan of ``df``, and each chunk then reads only its own folder.  An
    attempt writes its answers to a folder of its own and a commit record after them; answers without a record are
    never read, so a run that dies in between leaves no duplicates: the next one labels those rows again.  Rows with a null key cannot
    be resumed and are labelled in every run.  Two runs at once on one path may label a row twice.
    """
    todo = df.select(key, prompt_col).join(read_label_log(df, path, key).select(key), key, "left_anti")
    dealt = todo.withColumn("chunk", F.pmod(F.xxhash64(F.col(key)), F.lit(chunks)).cast("int"))
    run = uuid.uuid4().hex
    staged = checkpoint_path(df.sparkSession, f"prompts-{run}")
    dealt.write.partitionBy("chunk").parquet(staged)
    prompts = df.sparkSession.read.schema(dealt.schema).parquet(staged)
    for c in range(chunks):
        attempt = f"run-{run}"
        answers = label_batches(prompts.filter(F.col("chunk") == c), model, key, prompt_col, "answer", batch_size)
        answers.select(key, "answer").write.parquet(f"{path}/rows/chunk={c}/attempt={attempt}")
        _commit(df, path, attempt, c)
    return read_label_log(df, path, key)


def label_log_path(df: DataFrame, name: str) -> str:
    """A label-log folder inside the shared checkpoint folder."""
    return checkpoint_path(df.sparkSession, name)


def merge_labels(shards: DataFrame, scores: DataFrame, dates: DataFrame, key: str = "orig_index",
                 priority: str = "src_priority", label_col: str = "is_ai_llm", year_from: int = 2016) -> DataFrame:
    """Union of shards -> first by priority -> scores attached -> unlabelled dropped -> year filter."""
    from presslens.operators.clean import drop_unlabeled, with_year, year_between
    from presslens.operators.windows import first_by_priority

    first = first_by_priority(shards, key, [priority])
    j = first.join(scores, key, "left")
    j = drop_unlabeled(j, label_col)
    j = with_year(j.join(dates.select(key, "published_date"), key, "left"))
    return year_between(j, year_from, None)


# City / country names that leak into industry labels (regular expressions).
CITY_PATTERNS = [
    r"copenhagen", r"københavn",
    r"aarhus", r"å?rhus",
    r"odense", r"aalborg", r"å?lborg",
    r"frederiksberg", r"esbjerg", r"randers",
    r"danmark", r"denmark",
]


def list_values(c: Column, lower: bool = True, drop: Sequence[str] = ("none",), raw: bool = False) -> Column:
    """Comma list -> array of values.

    Default: stripped (and lowered) values without blanks and ``drop`` values.  ``raw=True`` is the
    study's one-hot input: a null or the whole text 'none' gives no values, otherwise the plain
    comma split (leading blanks kept, so ' media' and 'media' differ)."""
    if raw:
        return F.when(c.isNull() | (c == "none"), F.array().cast("array<string>")).otherwise(F.split(c, ","))
    vals = F.transform(F.split(c, ","), lambda s: F.lower(P.strip(s)) if lower else P.strip(s))
    return F.filter(vals, lambda s: (s != "") & ~s.isin(list(drop)))


def one_hot(df: DataFrame, col: str, values: Sequence[str], key: str = "orig_index", prefix: str = "",
            raw: bool = False) -> DataFrame:
    """Multi-label column -> one 0/1 column per listed value (fixed layout)."""
    arr = F.array_distinct(list_values(F.col(col), raw=raw))
    return df.select(key, *[F.array_contains(arr, v).cast("int").alias(f"{prefix}{v}") for v in values])


def one_hot_long(df: DataFrame, col: str, key: str = "orig_index", raw: bool = False) -> DataFrame:
    """L12 (long form): (key, value) pairs of a multi-label column."""
    return df.select(key, F.explode(F.array_distinct(list_values(F.col(col), raw=raw))).alias("value"))


def drop_noise_labels(df: DataFrame, col: str, patterns: Sequence[str] = CITY_PATTERNS) -> DataFrame:
    """Drop values matching one of the regular expressions as a whole (case-insensitive,
    the value is lowered; with raw values a leading blank keeps a city, as in the study)."""
    pat = "^(?:" + "|".join(p.lower() for p in patterns) + ")$"
    return df.filter(~F.lower(F.col(col)).rlike(pat))


def merge_labels_normalised(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Strip + lower every value and merge duplicates."""
    return df.withColumn(out or col, F.array_distinct(list_values(F.col(col), drop=())))


def normalise_label(c: Column) -> Column:
    """``str(label).strip().lower()``: null becomes 'nan'."""
    return F.lower(P.strip(F.coalesce(c.cast("string"), F.lit("nan"))))


def barrier_label_mapping(df: DataFrame, col: str, mapping: Mapping[str, tuple[int, str]] | DataFrame,
                          none_label: str = "none", none_id: int = -999, other_id: int = -1,
                          other_label: str = "other") -> DataFrame:
    """Raw label -> (barrier_cluster_id, barrier_cluster_label) through the normalised label
    (strip + lower); 'none' -> (-999, 'none'); labels not in the mapping (noise) -> (-1, 'other').

    ``mapping`` is a small dict (literal map) or a table (raw_label, cluster_id, cluster_label)
    joined on the normalised label (one row per distinct label; AQE picks the join)."""
    key = normalise_label(F.col(col))
    is_none = key == none_label
    if isinstance(mapping, Mapping):
        ids = F.create_map(*[x for k, (i, _) in mapping.items() for x in (F.lit(k), F.lit(i))])
        labels = F.create_map(*[x for k, (_, lab) in mapping.items() for x in (F.lit(k), F.lit(lab))])
        cid_v, clab_v, out = F.try_element_at(ids, key), F.try_element_at(labels, key), df
    else:
        m = mapping.select(F.col("raw_label").alias("_k"), F.col("cluster_id").alias("_cid"),
                           F.col("cluster_label").alias("_clab"))
        out = df.withColumn("_key", key).join(m, F.col("_key") == F.col("_k"), "left").drop("_k", "_key")
        cid_v, clab_v = F.col("_cid"), F.col("_clab")
    cid = F.when(is_none, F.lit(none_id)).otherwise(F.coalesce(cid_v.cast("int"), F.lit(other_id)))
    clab = F.when(is_none, F.lit(none_label)).otherwise(F.coalesce(clab_v, F.lit(other_label)))
    res = out.withColumn("barrier_cluster_id", cid).withColumn("barrier_cluster_label", clab)
    return res.drop(*[c for c in ("_cid", "_clab") if c in res.columns])
