"""Column-level text helpers (all JVM-side built-ins, no Python per row).

Regular expressions are written in the subset that Java's ``java.util.regex``
and RE2 (DuckDB) read the same way: ``\\p{L}`` classes instead of ``\\b``
(whose Unicode behaviour differs between JDK versions and RE2), no look-around.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslens.functions.parse import BLANK

# ---------------------------------------------------------------------------
# Fixed values (must equal the source study's lists for the same results)
# ---------------------------------------------------------------------------
# Keyword list of the combined keyword score.
AI_KEYWORDS = [
    "AI", "kunstig intelligens", "maskinlæring", "dyb læring", "neural netværk", "automatisering",
    "robotik", "dataanalyse", "algoritme", "intelligente systemer", "GPT", "OPENAI", "LLM", "chatbot",
    "sprogmodel", "generativ AI", "AI-assistent", "AI-drevet", "computer vision", "naturlig sprogbehandling",
    "AI-platform", "AI-teknologi", "AI-forskning", "AI-innovation", "AI-applikationer", "AI-løsninger",
    "AI-udvikling", "AI-sikkerhed", "AI-etik", "AI-regulering", "AI-politik", "AI-strategi", "AI-investering",
    "AI-startup", "AI-industrien", "AI-marked", "AI-trends", "AI-fremtid", "robotter", "automatiserede systemer",
    "intelligente maskiner", "AI-integration", "AI-implementering", "AI-optimering", "AI-overvågning",
]
# Keyword list of the regex flag variant.
AI_REGEX_KEYWORDS = [
    "ai", "kunstlig intelligens", "artificial intelligence",
    "maskinlæring", "machine learning", "deep learning",
    "neurale netværk", "neural netværk",
    "algoritme", "algoritmer", "generativ ai",
    "chatbot", "chatbotter",
    "robot", "robotter", "robotik", "automatisering",
    "sprogmodel", "store sprogmodeller",
    "computer vision", "billedgenkendelse",
    "ansigtsgenkendelse",
]
# Barrier keyword list of the regex flag variant.
BARRIER_KEYWORDS = [
    "manglende data", "datasikkerhed", "privacy", "persondata",
    "lovgivning", "regulering", "compliance", "ai act",
    "ressourcemangel", "kompetencemangel", "dygtige medarbejdere",
    "omkostninger", "høje omkostninger", "teknologisk kompleksitet",
    "mangel på ekspertise", "modstand mod forandring", "etisk bekymring",
    "ansvarlig ai", "algoritmisk bias", "fejl i system", "misinformation",
    "overvågning", "jobtab", "usikkerhed", "risiko", "usikkerhed omkring ai", "resistance", "skills gaps",
    "data quality", "ethics",
]
# Cities and companies of the detection stage.
CITY_NAMES = ["København", "Aarhus", "Odense", "Aalborg", "Esbjerg", "Randers", "Kolding", "Horsens", "Vejle",
              "Roskilde"]
COMPANY_NAMES = ["Maersk", "Novo Nordisk", "Carlsberg", "Vestas", "Microsoft", "Google", "Amazon", "Meta", "OpenAI"]
# Actor-type substring rules, checked in this order; anything else is "Company".
MEDIA_PATTERNS = [
    "avis", "blad", "bt", "b.t", "berlingske", "politiken",
    "jyllands", "reuters", "ritzau", "afp", "bbc", "cnn",
    "tv2", "dr", ".dk", "radio", "DR", "TV2", "TV 2", "Berlingske", "Politiken", "Jyllands-Posten", "Ekstra Bladet",
    "BT", "Information", "Kristeligt Dagblad", "Weekendavisen", "Børsen",
    "Ritzau", "Altinget", "Version2", "Computerworld", "Ingeniøren",
]
SPORTS_PATTERNS = ["fc ", "f.c", "aab", "agf", "dbu", "superliga", "league", "champions", "united", "city",
                   "boldklub"]
PUBLIC_PATTERNS = [
    "styrelsen", "institut", "ministerium", "direktorat",
    "politi", "region", "kommune", "folketing", "universitet", "Socialdemokratiet", "Venstre", "Dansk Folkeparti",
    "DF", "Radikale Venstre",
    "SF", "Socialistisk Folkeparti", "Enhedslisten", "Alternativet", "Konservative",
    "Liberal Alliance", "Moderaterne", "Danmarksdemokraterne",
]
ACTOR_RULES = [("Media", MEDIA_PATTERNS), ("Sports", SPORTS_PATTERNS), ("Public Authority", PUBLIC_PATTERNS)]
# Organisation names that are not companies (substring test on the lowered name).
NON_COMPANY_KEYWORDS = [
    "ekstra bladet", "b.t.", "berlingske", "politiken", "jyllands-posten", "bt", "tv2", "tv 2", "dr",
    "information", "weekendavisen", "børsen", "ritzau", "altinget", "version2", "computerworld",
    "ingeniøren", "frederiksborg amts avis", "sjællandske", "nordvestnyt", "sn.dk", "jv.dk",
    "videnskab.dk", "videnskab", "tech & viden", "finans",
    "reuters", "afp", "bbc", "cnn", "new york times", "washington post", "the guardian",
    "bloomberg", "cnbc",
    "venstre", "socialdemokratiet", "dansk folkeparti", "df", "radikale venstre", "sf",
    "socialistisk folkeparti", "enhedslisten", "alternativet", "konservative", "liberal alliance",
    "moderaterne", "danmarksdemokraterne",
    "folketinget", "regeringen", "eu", "eu-kommissionen", "kommissionen", "ministeriet", "styrelsen",
    "direktoratet", "politi", "nordsjællands politi", "kommune", "region", "domstol", "ret", "retten",
    "landsret", "højesteret", "universitet", "ku", "københavns universitet", "dtu",
    "danmarks tekniske universitet",
    "cbs", "copenhagen business school", "sdu", "syddansk universitet", "aau", "aarhus universitet",
    "dansk industri", "norden", "nasdaq",
    "nato", "fn", "who", "oecd", "verdensbanken",
    "summit", "copy",
    "fc", "f.c.", "brøndby", "fck", "agf", "aab", "superliga", "champions league", "dbu",
    "corona", "covid", "sars-cov-2", "musk",
]
GENERIC_TERMS = ["gruppen", "foreningen", "rådet", "udvalget", "kommissionen", "myndighederne", "domstolen",
                 "parlamentet", "sprognævnet"]
# Legal-form suffixes that mark a company.
# ---------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
_META = set("\\.^$|?*+()[]{}")


def regex_escape(s: str) -> str:
    """Quote regex metacharacters (same result in Java regex and RE2)."""
    return "".join("\\" + ch if ch in _META else ch for ch in s)


def boundary_pattern(term: str, escape: bool = True) -> str:
    """``term`` as a whole word: Unicode-aware, portable replacement of ``\\bterm\\b``."""
    body = regex_escape(term) if escape else term
    return f"(^|{NON_WORD})({body})($|{NON_WORD})"


def trie_regex(words: Sequence[str]) -> str:
    """One regex that finds any of ``words`` as a substring, with common prefixes factored out.

    A flat alternation makes the regex engine try every word at every position; the factored
    form branches on one character at a time, so a set of ~100 substrings costs a few character
    tests per position.  Java regex and RE2 read it the same way.
    """
    trie: dict = {}
    for w in dict.fromkeys(words):
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def build(node: dict) -> str:
        if "" in node:          # a listed word ends here: longer words add nothing to "contains any"
            return ""
        branches = [regex_escape(ch) + build(child) for ch, child in sorted(node.items())]
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    return build(trie) if words else "(?!)"


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """Any of ``needles`` is a substring of ``c`` (one regex pass instead of a chain of tests)."""
    if not needles:
        return F.lit(False)
    return c.rlike(trie_regex(list(needles)))


def split_keywords(keywords: Sequence[str], short_len: int = 3) -> tuple[list[str], list[str]]:
    """Short keywords (<= ``short_len`` chars, no blank) are matched as words, the rest as substrings.

    Short keywords are de-duplicated (they key a dict in the study); long ones are kept as listed.
    """
    short: list[str] = []
    for kw in keywords:
        if len(kw) <= short_len and " " not in kw and kw not in short:
            short.append(kw)
    long_ = [kw for kw in keywords if kw not in short]
    return short, long_


def keyword_hits(text: Column, keywords: Sequence[str], short_len: int = 3) -> list[Column]:
    """One 0/1 column per keyword; ``text`` must already be lower case."""
    short, long_ = split_keywords(keywords, short_len)
    hits = [text.contains(kw.lower()).cast("int") for kw in long_]
    # the literal test is cheap and skips the regex for texts that cannot match
    hits += [F.when(text.contains(kw.lower()), text.rlike(boundary_pattern(kw.lower()))).otherwise(F.lit(False))
             .cast("int") for kw in short]
    return hits


def sum_columns(cols: Sequence[Column]) -> Column:
    if not cols:
        return F.lit(0)
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total


def keyword_score(text: Column, keywords: Sequence[str], short_len: int = 3) -> Column:
    """Number of keywords found: short ones by word boundary, long ones by substring (text lowered)."""
    return sum_columns(keyword_hits(F.lower(F.coalesce(text, F.lit(""))), keywords, short_len))


def keyword_score_plain(text: Column, keywords: Sequence[str]) -> Column:
    """Number of keywords found as plain substrings of the lowered text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum_columns([low.contains(kw.lower()).cast("int") for kw in keywords])


def keyword_flag(text: Column, keywords: Sequence[str], fold_keywords: bool = True) -> Column:
    """Any keyword is a substring of the lowered text; null text is False.

    ``fold_keywords=False`` keeps the keywords as written, so entries with capitals never
    match the lowered text (the behaviour of the entity and sentiment scripts).
    """
    terms = [kw.lower() if fold_keywords else kw for kw in keywords]
    return F.coalesce(contains_any(F.lower(text), terms), F.lit(False))


def alternation(keywords: Sequence[str], lower: bool = True) -> str:
    """``(k1|k2|...)`` with every keyword quoted."""
    return "(" + "|".join(regex_escape(k.lower() if lower else k) for k in keywords) + ")"


def regex_flag(text: Column, keywords: Sequence[str]) -> Column:
    """Escaped alternation searched in the lowered text (null text is False)."""
    return F.coalesce(contains_any(F.lower(text), [k.lower() for k in keywords]), F.lit(False))


def regex_filter(text: Column, patterns: Sequence[str]) -> Column:
    """Case-insensitive search of word patterns (already regexes, whole-word), null text is False.

    The patterns are wrapped in portable word boundaries; the text is lowered so that no
    engine-specific case flag is needed.
    """
    body = "|".join(f"(?:{p.lower()})" for p in patterns)
    return F.coalesce(F.lower(text).rlike(f"(^|{NON_WORD})({body})($|{NON_WORD})"), F.lit(False))


def capitalize(c: Column) -> Column:
    """Python ``str.capitalize``: first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def first_city(text: Column, cities: Sequence[str]) -> Column:
    """Leftmost listed name found in the text (case-insensitive), capitalised; null if none."""
    hit = F.regexp_extract(F.lower(text), alternation(cities), 1)
    return F.when(hit != "", capitalize(hit))


def companies(text: Column, names: Sequence[str]) -> Column:
    """Listed names present as whole words, in list order, joined with ', ' ('' if none)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(low.rlike(boundary_pattern(n.lower())), F.lit(n)) for n in names]
    return F.array_join(F.array_compact(F.array(*found)), ", ")


def actor_type(org: Column, rules=ACTOR_RULES, default: str = "Company") -> Column:
    """First rule whose substring occurs in the trimmed, lowered name (rules as written)."""
    o = F.lower(F.trim(org))
    out = F.lit(default)
    for name, needles in reversed(list(rules)):
        out = F.when(contains_any(o, needles), F.lit(name)).otherwise(out)
    return out


def likely_company(org: Column, blacklist: Sequence[str] = NON_COMPANY_KEYWORDS,
                   generic: Sequence[str] = GENERIC_TERMS) -> Column:
    """Reject blacklisted / generic substrings and all-caps names of <= 3 chars; else True.

    (A legal-form suffix also gives True, which is the default anyway.)
    """
    o = F.lower(F.trim(org))
    short_caps = (F.length(org) <= 3) & (org == F.upper(org)) & (org != F.lower(org))
    return ~(contains_any(o, [*blacklist, *generic]) | short_caps)


# Capitalised phrase: an upper-case letter starting a word, following capitalised words joined by blanks.
ORG_PATTERN = r"\p{Lu}[\p{L}\p{N}&./-]*(?: \p{Lu}[\p{L}\p{N}&./-]*)*"


def organisations(text: Column, max_chars: int | None = None, pattern: str = ORG_PATTERN,
                  min_len: int = 3, company_only: bool = True) -> Column:
    """Distinct organisation-like mentions of the text (``max_chars`` limits the search to the head
    of the text, as the study's entity step did; ``None`` = the whole text).

    Default extractor is a capitalised-phrase rule (no model); names are trimmed, kept when at
    least ``min_len`` long and (optionally) likely companies.
    """
    head = F.coalesce(text, F.lit(""))
    if max_chars:
        head = F.substring(head, 1, max_chars)
    return company_names(F.regexp_extract_all(head, F.lit(pattern), 0), company_only, min_len)


def company_names(found: Column, company_only: bool = True, min_len: int = 3) -> Column:
    """Distinct trimmed names of a list, at least ``min_len`` long and (optionally) likely companies."""
    names = F.array_distinct(F.transform(found, lambda s: F.trim(s)))
    keep = (lambda s: (F.length(s) >= min_len) & likely_company(s)) if company_only \
        else (lambda s: F.length(s) >= min_len)
    return F.filter(names, keep)


def organisation_mentions(text: Column, max_chars: int | None = None, pattern: str = ORG_PATTERN) -> Column:
    """Distinct capitalised phrases of one text, before the company filter (explode, then filter
    with :func:`likely_company` as a plain column expression)."""
    head = F.coalesce(text, F.lit(""))
    if max_chars:
        head = F.substring(head, 1, max_chars)
    return F.array_distinct(F.transform(F.regexp_extract_all(head, F.lit(pattern), 0), lambda s: F.trim(s)))


def sentiment_label(score: Column, pos: float = 0.05, neg: float = -0.05) -> Column:
    """> pos Positive, < neg Negative, anything else (null included) Neutral."""
    return (F.when(score > pos, "Positive").when(score < neg, "Negative").otherwise("Neutral"))


def truncate(c: Column, n: int, ellipsis: str | None = None) -> Column:
    """First ``n`` characters; with ``ellipsis`` it is appended only when text was cut."""
    cut = F.substring(c, 1, n)
    if ellipsis is None:
        return cut
    return F.when(F.length(c) > n, F.concat(cut, F.lit(ellipsis))).otherwise(c)


def shorten_words(c: Column, n: int = 8, ellipsis: str = "…") -> Column:
    """First ``n`` blank-separated words, plus ``ellipsis`` when there were more."""
    words = F.filter(F.split(c, BLANK + "+"), lambda w: w != "")
    head = F.array_join(F.slice(words, 1, n), " ")
    return F.when(F.size(words) > n, F.concat(head, F.lit(ellipsis))).otherwise(head)


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def text_len(c: Column) -> Column:
    return F.length(c)


def word_tokens(text: Column, keep_pattern: str = r"^[a-z]{3,}$") -> Column:
    """Lower-case word runs that fully match ``keep_pattern`` (ASCII words of >= 3 letters by default).

    Equal to finding ``\\b[a-zA-Z]{3,}\\b`` in the lowered text: a run of word characters is kept
    only when it consists of the wanted letters alone.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD + "+"), 0)
    return F.filter(runs, lambda w: w.rlike(keep_pattern))


def word_runs(text: Column) -> Column:
    """Lower-case runs of letters, digits and '_' (the tokens of the lexicon scorer)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD + "+"), 0)
