"""A rule labeller for the registered labelling queries: a picklable callable whose answers SQL can state.

It stands where a caller injects a language model.  It reads the article out of the prompt, counts keywords
and answers in the asked lines; ``answer_sql`` is the same rule for DuckDB.
"""

from __future__ import annotations

from collections.abc import Sequence

from presslens.operators.labelling import PROMPT_HEAD, PROMPT_TAIL, RETRY_PREFIX

YES = ("licensing", "regulation", "Rules slow adoption.", "Denmark", "Aarhus", "software, media", "AI, license",
       "the text names a license")
NO = ("other", "none", "none", "none", "none", "none", "none", "none")


class KeywordRules:
    """'ja' and ten points a hit when the article holds a keyword, else 'nej', as 5 or 10 lines.

    With ``short_every = m`` the answer to an article whose length m divides is one line only, and stays so when
    asked again if 3 m divides it: the two cases of the retry operator."""

    def __init__(self, keywords: Sequence[str], lines: int = 5, short_every: int | None = None):
        self.keywords = [k.lower() for k in keywords]
        self.lines = lines
        self.short_every = short_every

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str:
        again = prompt.startswith(RETRY_PREFIX)
        article = prompt[prompt.index(PROMPT_HEAD) + len(PROMPT_HEAD):len(prompt) - len(PROMPT_TAIL)]
        if self.short_every and len(article) % (self.short_every * (3 if again else 1)) == 0:
            return "ja"
        low = article.lower()
        hits = sum(low.count(k) for k in self.keywords)
        head = ["ja", str(min(100, 10 * hits))] if hits else ["nej", "0"]
        return "\n".join(head + list(YES if hits else NO)[:self.lines - 2])


def hits_sql(keywords: Sequence[str], text: str = "plain_text") -> str:
    low = f"lower({text})"
    return "(" + " + ".join(f"((length({low}) - length(replace({low}, '{k.lower()}', ''))) // {len(k)})"
                            for k in keywords) + ")"


def answer_sql(keywords: Sequence[str], lines: int = 5, text: str = "plain_text") -> str:
    hits = hits_sql(keywords, text)
    yes = ", ".join(f"'{x}'" for x in YES[:lines - 2])
    no = ", ".join(f"'{x}'" for x in NO[:lines - 2])
    return (f"CASE WHEN {hits} > 0 THEN concat_ws(chr(10), 'ja', CAST(least(100, 10 * {hits}) AS VARCHAR), {yes}) "
            f"ELSE concat_ws(chr(10), 'nej', '0', {no}) END")
