"""Small builders of oracle SQL fragments (DuckDB dialect) that mirror the Column helpers."""

from __future__ import annotations

from collections.abc import Sequence

from presslens.functions.text import boundary_pattern, split_keywords

from presslens.functions.parse import BLANK


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def keyword_score_sql(text: str, keywords: Sequence[str], short_len: int = 3) -> str:
    low = f"lower(coalesce({text}, ''))"
    short, long_ = split_keywords(keywords, short_len)
    parts = [f"CAST(contains({low}, {lit(k.lower())}) AS INT)" for k in long_]
    parts += [f"CAST(regexp_matches({low}, {lit(boundary_pattern(k.lower()))}) AS INT)" for k in short]
    return "(" + " + ".join(parts or ["0"]) + ")"


def year_sql(col: str = "published_date") -> str:
    return f"CAST(year(try_cast({col} AS TIMESTAMP)) AS INT)"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '\A{BLANK}+|{BLANK}+\z', '', 'g')"


def to_bool_sql(x: str) -> str:
    s = f"lower({strip_sql(f'CAST({x} AS VARCHAR)')})"
    return (f"(CASE WHEN {s} IN ('1','true','ja','yes') THEN TRUE "
            f"WHEN {s} IN ('0','false','nej','no') THEN FALSE END)")


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def norm_sql(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def cosine_sql(a: str, b: str) -> str:
    return f"({dot_sql(a, b)} / ({norm_sql(a)} * {norm_sql(b)}))"


def any_contains_sql(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(n)})" for n in needles) + ")"


def likely_company_sql(s: str) -> str:
    from presslens.functions.text import GENERIC_TERMS, NON_COMPANY_KEYWORDS

    o = f"lower(trim({s}))"
    short_caps = f"(length({s}) <= 3 AND {s} = upper({s}) AND {s} <> lower({s}))"
    return (f"(NOT ({any_contains_sql(o, NON_COMPANY_KEYWORDS)} OR {any_contains_sql(o, GENERIC_TERMS)} "
            f"OR {short_caps}))")


def organisations_sql(text: str) -> str:
    """Distinct capitalised-phrase mentions of the whole text that look like companies."""
    from presslens.functions.text import ORG_PATTERN

    found = f"list_transform(regexp_extract_all(coalesce({text}, ''), {lit(ORG_PATTERN)}, 0), lambda s: trim(s))"
    return f"list_distinct(list_filter({found}, lambda s: length(s) >= 3 AND {likely_company_sql('s')}))"


def actor_type_sql(x: str) -> str:
    from presslens.functions.text import ACTOR_RULES

    o = f"lower(trim({x}))"
    whens = " ".join(f"WHEN {any_contains_sql(o, needles)} THEN {lit(name)}" for name, needles in ACTOR_RULES)
    return f"(CASE {whens} ELSE 'Company' END)"


def companies_sql(text: str, names) -> str:
    low = f"lower(coalesce({text}, ''))"
    items = ", ".join(f"CASE WHEN regexp_matches({low}, {lit(boundary_pattern(n.lower()))}) THEN {lit(n)} END"
                      for n in names)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ', ')"


def histogram_sql(src: str, col: str, bins: int) -> str:
    """Equal-width histogram of ``col`` from relation ``src`` (CTE-ready body)."""
    return f"""
hsrc AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
hb AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins} AS width FROM hsrc),
hc AS (SELECT CAST(least(CASE WHEN width > 0 THEN floor((x - lo) / width) ELSE 0 END, {bins - 1}) AS INT) AS bin,
              count(*) AS count FROM hsrc, hb GROUP BY 1)
SELECT bin, lo + bin * width AS bin_lo, lo + (bin + 1) * width AS bin_hi, count FROM hc, hb"""
