"""Surrogates of persons: one for all mentions, different for different names."""

import random
import re
import time

import pytest
from presslens.llm import surrogates


def test_all_mentions_of_a_person_share_a_last_name():
    text = "Mr. John Smith met Dr. Smith. Later Smith's car and John Smith left; MR SMITH. Dr. John Smith, SMITH and blacksmith stay."
    new, n = surrogates.replace(text, {})
    last = surrogates.replacement("surname", "smith").title()
    assert "Smith" not in new and "SMITH" not in new and "John" not in new and "blacksmith stay" in new
    full = new[4:new.index(" met")]
    assert full.endswith(" " + last) and new.count(full) == 3 and new.count(last) == 5 and f"{last}'s car" in new and n == 7
    assert surrogates.replace("Smith and John Smith without a form of address", {})[1] == 0
    assert surrogates.replace("Mr. Smith", {})[0][4:] == surrogates.replace("Ms. Smith", {})[0][4:] == last


def test_surrogates_of_persons_differ_across_forms_of_address(spark):
    # few syllables: 8 ** 3 last names for 300 real ones under two forms of address
    few = surrogates.SYLLABLES["latin"][:]
    surrogates.SYLLABLES["latin"][:] = few[:8]
    try:
        names = [f"Q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
        rows = [(i, f"{'Mr' if i % 2 else 'Ms'} {x} and Mr Tom Zed{'' if i % 3 else 'a'}") for i, x in enumerate(names)]
        rows += [(1000 + i, f"Mr {x} Zed") for i, x in enumerate(n.title() for n in names[:40])]
        rows += [(2000, f"Ms {surrogates.replacement('surname', 'qab').title()}")]
        out = {r["doc_id"]: r["text"] for r in surrogates.surrogate_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        single = [out[i].split(" ")[1] for i in range(300)]
        assert len(set(single)) == 300 and not set(single) & {x for _, t in rows for x in t.split(" ")}
        assert len({out[1000 + i] for i in range(40)}) == 40 and len({out[1000 + i].split(" ")[-1] for i in range(40)}) == 1
    finally:
        surrogates.SYLLABLES["latin"][:] = few


@pytest.mark.parametrize("text", ["Mr. J. Smith", "Mr. X", "Herr A. Müller", "Dr. J. R. Tolkien", "Dr. J. J.", "Mr. É.", "Frau Dr. Weber", "Господин И. Петров", "Mr. A. A. A. A. B"])
def test_initials_in_every_place(text):
    new, n = surrogates.replace(f"{text} came. {text}.", {})
    assert n >= 1 and new != f"{text} came. {text}."


def test_initials_keep_their_form_and_the_last_name_its_surrogate():
    new, _ = surrogates.replace("Mr. J. Smith met Dr. Smith, and J. Smith left.", {})
    m = re.fullmatch(r"Mr\. ([A-Z])\. (\w+) met Dr\. (\w+), and ([A-Z])\. (\w+) left\.", new)
    assert m and m[1] == m[4] and m[2] == m[3] == m[5] != "Smith"


def test_one_name_in_the_whole_corpus(spark):
    rows = [(1, "Mr. John Smith spoke."), (2, "Dr. John Smith spoke."), (3, "Ms. Kim Lee spoke."), (4, "Mr. Kim Lee spoke."), (5, "Prof. Kim Lee spoke."),
            (6, "Dr. J. Smith spoke."), (7, "Mr. Smith spoke."), (8, None), (9, "nobody")]
    for most in (surrogates.MOST_SHIPPED, 0):
        old, surrogates.MOST_SHIPPED = surrogates.MOST_SHIPPED, most
        try:
            got = {r[0]: r[1] for r in surrogates.with_surrogates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
        finally:
            surrogates.MOST_SHIPPED = old
        name = {i: re.sub(r"^\w+\. | spoke\.$", "", got[i]) for i in range(1, 8)}
        assert name[1] == name[2] and name[3] == name[4] == name[5] and name[1] != name[3]
        assert {name[i].split(" ")[-1] for i in (1, 2, 6, 7)} == {name[7]} and got[8] is None and got[9] == "nobody"


def test_distinct_and_consistent_on_a_generated_corpus(spark):
    """Brute force over all mentions: one surrogate for each person, one person for each surrogate, no real name as a surrogate."""
    rnd = random.Random(11)
    first = {"m": ["John", "Paul", "J.", "K.", "Иван"], "f": ["Mary", "Clara", "Анна"]}
    last = ["Smith", "Jones", "Varapan", "Müller", "Петров", "O’Neil", "X"]
    rows, people = [], []
    for i in range(400):
        g = rnd.choice("mf")
        name = f"{rnd.choice(first[g])} {rnd.choice(last)}" if rnd.random() < .8 else rnd.choice(last)
        title = rnd.choice({"m": ["Mr.", "Dr."], "f": ["Mrs.", "Dr.", "Frau"]}[g])
        rows.append((i, f"<{title} {name}> said"))
        people.append(name)
    got = {r[0]: r[1] for r in surrogates.with_surrogates(spark.createDataFrame(rows, "doc_id int, text string").repartition(4)).collect()}
    seen: dict[str, set[str]] = {}
    for i, name in enumerate(people):
        seen.setdefault(name, set()).add(re.fullmatch(r"<\w+\.? (.*)> said", got[i])[1])
    assert all(len(s) == 1 for s in seen.values())
    new = [next(iter(s)) for s in seen.values()]
    assert len(set(new)) == len(seen) and not set(new) & set(seen)
    lasts = {}
    for name, (s,) in seen.items():
        lasts.setdefault(name.split(" ")[-1], set()).add(s.split(" ")[-1])
    assert all(len(s) == 1 for s in lasts.values()) and len({next(iter(s)) for s in lasts.values()}) == len(lasts)


def test_a_caller_may_use_the_reserved_names(spark):
    df = spark.createDataFrame([(1, "Mr. X", "a", "b", "c")], "doc_id int, text string, __new string, __owner string, __own string")
    got = surrogates.with_surrogates(df).collect()[0]
    assert (got["__new"], got["__owner"], got["__own"]) == ("a", "b", "c") and got["text"] != "Mr. X"


@pytest.mark.parametrize("unit", ["x", "a.", "1", "1 ", "12-", "ab12:", "+1", "(1", "token", "secret = ", "-----BEGIN PRIVATE KEY-----", "sk-", "DE12 ", "AB12 ", "00", "Mr. ", "J. ", "::", "@", "a@", "+49 1 ", "A", "_"])
def test_patterns_take_linear_time(unit):
    for text in (unit * (1_000_000 // len(unit)), "secret=" + unit * (1_000_000 // len(unit)) + "@b.cd 1"):
        for _, pattern, _ in surrogates.KINDS:
            began = time.process_time()
            for _ in pattern.finditer(text):
                pass
            assert time.process_time() - began < 5  # a second on a machine of usual speed; a quadratic pattern takes minutes
