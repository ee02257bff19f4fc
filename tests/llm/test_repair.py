"""Conversation structure repair against enumeration of all scripts, and against its SQL on awkward rows."""

import random
from itertools import product

import duckdb
import pytest
from presslens.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, code string, gone string"


def cheapest(rows):
    """(cost, audit, lines) by trying every script with up to two inserted turns in every place; rows are (role, text, fault)."""
    found = []
    for edits in product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
        if any(f in (repair.BLANK, repair.DUPLICATE) and e != "D" for e, (_, _, f) in zip(edits, rows, strict=True)):
            continue
        for inserts in product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i in range(len(rows) + 1):
                for x in inserts[i]:
                    cost, audit = cost + 2, audit + "I"
                    lines.append({"u": "user", "a": "assistant"}[x] + ":")
                if i < len(rows):
                    role, text, fault = rows[i]
                    audit += edits[i][0]
                    cost += {"K": 0, "Ru": 2, "Ra": 2, "D": 3}[edits[i]] + (fault == repair.TRUNCATED and edits[i] != "D")
                    if edits[i] != "D":
                        lines.append({"K": role, "Ru": "user", "Ra": "assistant"}[edits[i]] + ":" + text)
            import re
            if re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines)):
                found.append((cost, audit, lines))
    return min(found)


def test_walk_against_all_scripts():
    rnd = random.Random(3)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            rows = [(rnd.choice(("system", "user", "assistant", "tool")), f"t{i}", rnd.choice((0, 0, 1, 2, 3))) for i in range(n)]
            codes = bytes(4 * f + repair.INITIALS.get(r[0], 0) for r, _, f in rows)
            edits, state = repair.walk(codes, repair.END, 0)
            tail = repair.closing(state)
            v = repair.END
            for c in reversed(codes):
                v = repair.before(c, v)
            lines = [*repair._lines(edits, [r[0] for r in rows], [r[1] for r in rows]), *(f"{repair.ROLE[s]}:" for s in tail)]
            assert (v[0], repair._audit(edits) + "I" * len(tail), lines) == cheapest(rows)


def test_blocks_and_checkpoints_do_not_change_the_walk():
    rnd = random.Random(4)
    for _ in range(50):
        codes = bytes(4 * rnd.choice((0, 0, 0, 1, 2, 3, 4)) + rnd.randrange(4) for _ in range(rnd.randint(1, 90)))
        whole, _ = repair.walk(codes, repair.END, 0)
        cut = rnd.randrange(len(codes) + 1)
        v = repair.END
        for c in reversed(codes[cut:]):
            v = repair.before(c, v)
        left, state = repair.walk(codes[:cut], v, 0)
        right, _ = repair.walk(codes[cut:], repair.END, state)
        assert left + right == whole


def awkward():
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(("system", "user", "assistant", "tool", None, "")), rnd.choice(("Yes.", "No", "", " \t", None, "Why?  ", "a\nb", "!")))
            for c in (1, 2, 3, 4, None, -7) for t in (*range(rnd.randint(1, 9)), rnd.choice((None, 40, 3_000_000_000)))]
    rows += [(9, 5, "user", "Same.")] * 40 + [(9, t, "assistant", f"No {t % 3}.") for t in range(6, 30)] + [(8, None, "user", "Hi.")] * 2
    return [(*r, 1, "c", "g") for r in rows]


@pytest.mark.parametrize("limits", [(repair.LOCAL_TURNS, repair.LOCAL_CHARS), (3, 10**6), (100, 5)])
def test_awkward_rows_against_sql(spark, monkeypatch, limits):
    monkeypatch.setattr(repair, "BLOCK_BITS", 2)
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    got = repair.repair(repair.damaged(df), gone=repair.F.col("gone"), limits=limits, with_text=True)
    cols = [c for c in got.columns if c != "repaired"]
    found = {r["conv_id"]: r for r in got.collect()}
    want = {r[0]: r for r in con.sql(f"SELECT {', '.join(cols)} FROM ({repair.ORACLE})").fetchall()}
    assert {k: tuple(r[c] for c in cols) for k, r in found.items()} == want
    import hashlib
    assert all(hashlib.sha256(r["repaired"].encode()).hexdigest() == r["repaired_sha256"] for r in found.values())


def test_empty_table_and_a_conversation_without_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_damaged(none).collect() == []
    gone = spark.createDataFrame([(1, 0, "user", "x", 0, "", ""), (2, 1, "user", "Hi.", 0, "", "")], SCHEMA)
    got = {r[0]: tuple(r)[1:8] for r in repair.repair(gone, gone=repair.F.col("conv_id") == 1).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, ""), 2: (0, 0, 0, 0, 0, 2, "KI")}
