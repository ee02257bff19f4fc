"""Typed columns from free text: booleans, numbers, labels and model answers.

All parsers are built-in Column expressions (split / transform / filter /
regexp), so they run inside the JVM on every partition; nothing calls Python
per row.  Free text never fails a query: ANSI-safe ``try_*`` forms are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source study's for the same results)
# ---------------------------------------------------------------------------
TRUE_STRINGS = ["1", "true", "ja", "yes"]
FALSE_STRINGS = ["0", "false", "nej", "no"]
NO_BARRIER = ["none", "no barrier", "no ai barrier", "no barriers"]
NONE_VARIANTS = ["none", "no", "n/a", "na"]
EMPTY_LABELS = ["none", "nan", "other"]
# Defaults of an empty answer: label, score, topic, barrier flag, barrier type, summary.
DEFAULT_TOPIC = "unknown"
DEFAULT_NONE = "none"
# ---------------------------------------------------------------------------

# White space and line breaks of Unicode, as the study's language strips and splits them (Java and RE2 syntax).
BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BREAK = r"\r\n|[\x0A-\x0D\x1C-\x1E\x{85}\x{2028}\x{2029}]"
# First number: digits with an optional fraction, standing as a word of its own.
NUMBER = r"(^|[^\p{L}\p{N}_])([0-9]+(\.[0-9]+)?)($|[^\p{L}\p{N}_])"


def strip(c: Column) -> Column:
    """Python ``str.strip()``: drop leading and trailing white space of any kind."""
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def to_bool(c: Column) -> Column:
    """{1,true,ja,yes} -> true, {0,false,nej,no} -> false (after strip + lower), else null."""
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin(TRUE_STRINGS), F.lit(True)).when(s.isin(FALSE_STRINGS), F.lit(False))


def to_number(c: Column) -> Column:
    """Numeric value or null (never fails on text)."""
    return c.cast("string").try_cast("double")


def clean_label(c: Column, empty_as: str | None = None, lower: bool = False) -> Column:
    """String, stripped; '' becomes null (or ``empty_as``); optionally lower-cased."""
    s = strip(c.cast("string"))
    if lower:
        s = F.lower(s)
    s = F.nullif(s, F.lit(""))
    return F.coalesce(s, F.lit(empty_as)) if empty_as is not None else s


def yes_no(c: Column) -> Column:
    """Model yes/no answer: True when the stripped, lowered text starts with 'ja'."""
    return F.coalesce(F.lower(strip(c)).startswith("ja"), F.lit(False))


def answer_lines(c: Column) -> Column:
    """Non-blank lines of an answer, each stripped."""
    return F.filter(F.transform(F.split(strip(F.coalesce(c, F.lit(""))), LINE_BREAK), strip),
                    lambda x: x != "")


def first_number(c: Column) -> Column:
    """First stand-alone number in the text as DOUBLE, null when there is none."""
    m = F.regexp_extract(c, NUMBER, 2)
    return F.when(m != "", m.try_cast("double"))


def _line(lines: Column, i: int) -> Column:
    """1-based line or null."""
    return F.when(F.size(lines) >= i, F.try_element_at(lines, F.lit(i)))


def _clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def parse_answer5(answer: Column, lines: Column | None = None) -> Column:
    """Five-line answer -> struct(is_ai_llm, ai_relevance_llm, ai_topic_llm, ai_barrier_llm,
    ai_barrier_type_llm, ai_barrier_summary_llm).

    The score is the first number anywhere in the answer, clamped to 0..100; without one it is
    100 for 'ja' and 0 otherwise.  Barrier 'none'-variants clear barrier and summary.
    ``lines`` may pass already split lines (see :func:`answer_lines`).
    """
    lines = answer_lines(answer) if lines is None else lines
    label = F.coalesce(F.lower(_line(lines, 1)).startswith("ja"), F.lit(False))
    num = first_number(F.lower(strip(F.coalesce(answer, F.lit("")))))
    score = F.when(num.isNotNull(), _clamp(num)).when(label, F.lit(100.0)).otherwise(F.lit(0.0))
    topic = F.coalesce(_line(lines, 3), F.lit(DEFAULT_TOPIC))
    btype = F.coalesce(_line(lines, 4), F.lit(DEFAULT_NONE))
    has_barrier = ~F.lower(btype).isin(NO_BARRIER)
    summary = F.when(has_barrier, F.coalesce(_line(lines, 5), F.lit(DEFAULT_NONE))).otherwise(F.lit(DEFAULT_NONE))
    return F.struct(
        label.alias("is_ai_llm"),
        score.cast("double").alias("ai_relevance_llm"),
        topic.alias("ai_topic_llm"),
        has_barrier.alias("ai_barrier_llm"),
        F.when(has_barrier, btype).otherwise(F.lit(DEFAULT_NONE)).alias("ai_barrier_type_llm"),
        summary.alias("ai_barrier_summary_llm"),
    )


def norm_list(c: Column) -> Column:
    """Comma list: none-variants -> 'none'; items stripped, blanks dropped, case-insensitive
    duplicates removed keeping the first spelling and order; joined with ', '."""
    t = strip(c)
    parts = F.filter(F.transform(F.split(t, ","), strip), lambda p: p != "")
    # one left fold: keep an item unless an earlier kept item equals it ignoring case
    uniq = F.aggregate(parts, F.array().cast("array<string>"),
                       lambda acc, p: F.when(F.exists(acc, lambda q: F.lower(q) == F.lower(p)), acc)
                       .otherwise(F.concat(acc, F.array(p))))
    joined = F.array_join(uniq, ", ")
    return (F.when(c.isNull() | (c == ""), F.lit(DEFAULT_NONE))
            .when(F.lower(t).isin(NONE_VARIANTS), F.lit(DEFAULT_NONE))
            .when(F.size(uniq) == 0, F.lit(DEFAULT_NONE))
            .otherwise(joined))


def norm_evidence(c: Column) -> Column:
    """none-variants -> 'none'; white space collapsed to single blanks."""
    t = strip(c)
    collapsed = strip(F.regexp_replace(t, r"\s+", " "))
    return (F.when(c.isNull() | (c == ""), F.lit(DEFAULT_NONE))
            .when(F.lower(t).isin(NONE_VARIANTS), F.lit(DEFAULT_NONE))
            .when(collapsed == "", F.lit(DEFAULT_NONE))
            .otherwise(collapsed))


def valid_format(answer: Column, min_lines: int = 10) -> Column:
    """At least ``min_lines`` non-blank lines, 'ja'/'nej' first, a number on line 2."""
    lines = answer_lines(answer)
    l1 = F.lower(_line(lines, 1))
    ok = ((F.size(lines) >= min_lines)
          & (l1.startswith("ja") | l1.startswith("nej"))
          & first_number(_line(lines, 2)).isNotNull())
    return F.coalesce(ok & (answer != ""), F.lit(False))


def parse_answer10(answer: Column, lines: Column | None = None) -> Column:
    """Ten-line answer -> struct of eleven typed fields.

    The score is read from line 2 only.  A 'ja' without AI terms or evidence flips the whole
    row to the defaults; a 'nej' forces terms and evidence to 'none'.
    """
    lines = answer_lines(answer) if lines is None else lines
    label = F.coalesce(F.lower(_line(lines, 1)).startswith("ja"), F.lit(False))
    num = first_number(_line(lines, 2))
    score = F.when(num.isNotNull(), _clamp(num)).when(label, F.lit(100.0)).otherwise(F.lit(0.0))
    topic = F.coalesce(_line(lines, 3), F.lit(DEFAULT_TOPIC))
    btype = F.coalesce(_line(lines, 4), F.lit(DEFAULT_NONE))
    has_barrier = ~F.lower(btype).isin(NO_BARRIER)
    summary = F.coalesce(_line(lines, 5), F.lit(DEFAULT_NONE))

    def listed(i: int) -> Column:
        return F.when(F.size(lines) >= i, norm_list(_line(lines, i))).otherwise(F.lit(DEFAULT_NONE))

    terms = listed(9)
    evidence = F.when(F.size(lines) >= 10, norm_evidence(_line(lines, 10))).otherwise(F.lit(DEFAULT_NONE))
    flip = label & ((terms == DEFAULT_NONE) | (evidence == DEFAULT_NONE))
    keep = label & ~flip
    none = F.lit(DEFAULT_NONE)

    def ok(c: Column, default: Column) -> Column:
        return F.when(flip, default).otherwise(c)

    return F.struct(
        keep.alias("is_ai_llm"),
        ok(score, F.lit(0.0)).cast("double").alias("ai_relevance_llm"),
        ok(topic, F.lit(DEFAULT_TOPIC)).alias("ai_topic_llm"),
        ok(has_barrier, F.lit(False)).alias("ai_barrier_llm"),
        ok(F.when(has_barrier, btype).otherwise(none), none).alias("ai_barrier_type_llm"),
        ok(F.when(has_barrier, summary).otherwise(none), none).alias("ai_barrier_summary_llm"),
        ok(listed(6), none).alias("countries_llm"),
        ok(listed(7), none).alias("cities_llm"),
        ok(listed(8), none).alias("industries_llm"),
        F.when(keep, terms).otherwise(none).alias("ai_terms_llm"),
        F.when(keep, evidence).otherwise(none).alias("ai_evidence_llm"),
    )
