"""Small tables for the training-data operators."""

from collections import Counter, defaultdict

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, shard string, label int, n int"

PROSE = ("the river runs past the old mill and the children of the village swim there in summer while the men "
         "mend their nets on the bank and talk about the weather and the price of fish until the bell rings ")


def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing extra columns."""
    texts = [None, "", "   \n\t ", "word", "one two three four", PROSE, PROSE.replace(" ", "  "), PROSE.upper(), PROSE * 400,
             PROSE + "more " * 60, "x" * 5000, "#*$%&|<>" * 30, "line\nline\nline\n\nother", PROSE, PROSE]
    rows = [(i, t, "en", "a", len(t or ""), "k", "s", 1, 2) for i, t in enumerate(texts)]
    rows += [(5, PROSE, "en", "a", 1, None, None, None, None)] * 2  # repeated rows
    rows += [(None, PROSE, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute_classes(docs, percent=85):
    """doc_id -> (set size, smallest reachable doc_id), by counting the shingles of every pair."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists, common = defaultdict(list), Counter()
    for i in sorted(sets):
        for s in sets[i]:
            common.update((j, i) for j in lists[s])
            lists[s].append(i)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}
