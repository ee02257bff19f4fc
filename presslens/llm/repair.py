"""Conversation structure repair by square-root checkpointed dynamic programming.

A conversation should read as ``(s?(ua)+)?`` in the initials of its roles.  Four states (nothing yet, after
system, after user, after assistant) and the edits Keep, Rerole, Delete and Insert make a shortest-path problem
over its turns.  A backward pass computes the least cost from every state to the end, and stores these cost
vectors only at checkpoints, one every sqrt(n) turns.  Walking forward, the vectors of one block are computed
again from its checkpoint, and among the tight edits (those on a cheapest way) the ASCII-least initial is taken.
No two tight edits share an initial and no cheapest script is a prefix of another, so this gives the least script.

Turns are dealt by range of (conversation, turn), so that a conversation with a third of all rows lies in many
tasks.  Conversations that lie within one task and are short are repaired on the spot.  Of the others, and of
those at the border of a task, blocks of consecutive turns (the square root of the longest one, 1024 at
least) are summed up in parallel as min-plus matrices; a conversation's matrices give the cost vectors at its
block borders, every block then says to which state it leads from each state, and with its start state known it
is walked.  Repeated turns of such a conversation are found by one aggregate on hashes.  Only the rendered text
of one conversation passes through one task, as a stream of blocks, since its SHA-256 has to; its edits are one string.

Defined results: roles and texts that are null count as one space; turns are ordered by number (nulls first),
then by role and hash of the text; a null conversation id is a conversation; repeated rows are turns (and thus
duplicates); a conversation whose rows are all ``gone`` has zeros, no edits and the hash of an empty text; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.llm.common import small_batches, staged

#: Turns and characters up to which a conversation inside one task is repaired on the spot.
LOCAL_TURNS, LOCAL_CHARS = 1024, 8_000_000
#: Least binary logarithm of the turns of a block.
BLOCK_BITS = 10
#: Costs of the edits, and of a truncated turn that stays.
RENAME, DELETE, INSERT, STUMP = 2, 3, 2, 1
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; the state behind an inserted or renamed turn.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: State behind a kept turn, by initial (0 other, 1 s, 2 u, 3 a) and state before it.
KEEP = ((None,) * 4, (1, None, None, None), (2, 2, None, 2), (None, None, 3, None))
INITIALS = {"s": 1, "u": 2, "a": 3}
LEGAL = {(1, 2), (2, 3), (3, 2)}
#: Faults of a turn; a turn's code is 4 * fault + initial.
SOUND, TRUNCATED, BLANK, DUPLICATE, GONE = range(5)
BLANKS = " \t\n\v\f\r"
FAR = 1 << 50
Costs = tuple[int, int, int, int]


def _inserted(base: list[int]) -> Costs:
    return tuple(min(base[s], INSERT + base[NEXT[s]], 2 * INSERT + base[NEXT[NEXT[s]]]) for s in range(4))


#: Costs behind the last turn: a whole conversation ends empty or after an assistant.
END: Costs = _inserted([0, FAR, FAR, 0])


@lru_cache(maxsize=100_000)
def _step(code: int, after: Costs) -> Costs:
    fault, initial = divmod(code, 4)
    base = [DELETE + c for c in after]
    if fault < BLANK:
        stump = STUMP * (fault == TRUNCATED)
        for s in range(4):
            base[s] = min(base[s], RENAME + stump + after[NEXT[s]])
            if KEEP[initial][s] is not None:
                base[s] = min(base[s], stump + after[KEEP[initial][s]])
    return _inserted(base)


def before(code: int, after: Costs) -> Costs:
    """Least costs to the end from every state before a turn, from those behind it."""
    if code >= 4 * GONE:
        return after
    low = min(after)  # equal vectors but for a constant share one result
    got = _step(code, (min(after[0] - low, FAR), min(after[1] - low, FAR), min(after[2] - low, FAR), min(after[3] - low, FAR)))
    return got[0] + low, got[1] + low, got[2] + low, got[3] + low


def walk(codes: bytes, end: Costs, state: int) -> tuple[list[tuple[list[int], str, int]], int]:
    """For every turn (states of turns inserted before it, edit, state behind it), and the state at the end."""
    n = len(codes)
    step = max(1, isqrt(n))
    marks, v = {n: end}, end
    for i in range(n - 1, -1, -1):
        v = before(codes[i], v)
        if i % step == 0:
            marks[i] = v
    out = []
    for at in range(0, n, step):
        stop = min(at + step, n)
        again = [marks[stop]]
        for i in range(stop - 1, at, -1):
            again.append(before(codes[i], again[-1]))
        costs = marks[at]
        for i in range(at, stop):
            after, new = again.pop(), []
            fault, initial = divmod(codes[i], 4)
            stump = STUMP * (fault == TRUNCATED)
            while True:
                if fault == GONE:
                    edit = ""
                elif DELETE + after[state] == costs[state]:
                    edit = "D"
                elif INSERT + costs[NEXT[state]] == costs[state]:
                    state = NEXT[state]
                    new.append(state)
                    continue
                elif KEEP[initial][state] is not None and stump + after[KEEP[initial][state]] == costs[state]:
                    edit, state = "K", KEEP[initial][state]
                else:
                    edit, state = "R", NEXT[state]
                break
            out.append((new, edit, state))
            costs = after
    return out, state


def closing(state: int) -> list[int]:
    """States of the turns inserted behind the last one."""
    return [] if state in (0, 3) else [3] if state == 2 else [2, 3]


def _lines(edits: list[tuple[list[int], str, int]], roles: list[str], texts: list[str]) -> Iterator[str]:
    for (new, edit, state), role, text in zip(edits, roles, texts, strict=True):
        for s in new:
            yield f"{ROLE[s]}:"
        if edit in ("K", "R"):
            yield f"{role if edit == 'K' else ROLE[state]}:{text}"


def _audit(edits: list[tuple[list[int], str, int]]) -> str:
    return "".join("I" * len(new) + edit for new, edit, _ in edits)


def _code(role: str, text: str, gone: bool) -> int:
    if gone:
        return 4 * GONE
    body = text.strip(BLANKS)
    fault = BLANK if not body else SOUND if body[-1] in ".!?" else TRUNCATED
    return 4 * fault + INITIALS.get(role[:1], 0)


def _summary(codes: bytes, turns: list[int | None]) -> dict[str, object]:
    """Counts of a stretch of turns, and what its neighbours need to know to add theirs."""
    here = [(c, t) for c, t in zip(codes, turns, strict=True) if c < 4 * GONE]
    initials = [c % 4 for c, _ in here]
    numbers = [t for _, t in here if t is not None]
    return {"blank": sum(c // 4 == BLANK for c, _ in here), "duplicate": sum(c // 4 == DUPLICATE for c, _ in here),
            "truncated": sum(c // 4 == TRUNCATED for c, _ in here),
            "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False)),
            "first": initials[0] if here else None, "last": initials[-1] if here else None,
            "low": min(numbers, default=None), "high": max(numbers, default=None), "numbers": len(set(numbers))}


def _gaps(low: int | None, high: int | None, numbers: int) -> int:
    return 0 if low is None else high - low + 1 - numbers


RESULT = {"gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint",
          "audit": "string", "repaired_sha256": "string"}


class _Run:
    """The turns of one conversation that a task has read."""

    def __init__(self, conv: object, whole: bool):
        self.conv, self.whole, self.chars = conv, whole, 0
        self.turns: list[tuple] = []  # pos, turn, role, text, gone


def _here(run: _Run, with_text: bool) -> tuple:
    """The result of a conversation that lies in the task as a whole."""
    seen: set[tuple[str, str]] = set()
    codes = bytearray()
    for _, _, role, text, gone in run.turns:
        code = _code(role, text, gone)
        if code // 4 in (SOUND, TRUNCATED) and (role, text) in seen:
            code = 4 * DUPLICATE + code % 4
        if not gone:
            seen.add((role, text))
        codes.append(code)
    got = _summary(bytes(codes), [t[1] for t in run.turns])
    edits, state = walk(bytes(codes), END, 0)
    v = END
    for c in reversed(codes):
        v = before(c, v)
    tail = closing(state)
    lines = [*_lines(edits, [t[2] for t in run.turns], [t[3] for t in run.turns]), *(f"{ROLE[s]}:" for s in tail)]
    text = "\n".join(lines)
    return (_gaps(got["low"], got["high"], got["numbers"]), got["blank"], got["duplicate"], got["truncated"], got["illegal"], v[0],
            _audit(edits) + "I" * len(tail), hashlib.sha256(text.encode()).hexdigest(), *([text] if with_text else []))


def _local(batches: Iterator[pa.RecordBatch], kind: pa.DataType, limits: tuple[int, int], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie in this task; the turns of all others as they are."""
    names = ["conv_id", *RESULT, *(["repaired"] if with_text else []), "pos", "turn", "role", "text", "code", "digest"]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string(), *([pa.string()] if with_text else []),
             pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]
    width = len(names) - 7
    out: list[tuple] = []

    def opened(run: _Run) -> None:
        for pos, turn, role, text, gone in run.turns:
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            out.append((run.conv, *[None] * width, pos, turn, role, text, _code(role, text, gone), digest))
        run.turns.clear()
        run.whole = False

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out.clear()
        return made

    run: _Run | None = None
    for b in batches:
        for conv, turn, role, text, gone, pos in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if run is None or conv != run.conv:
                if run and run.whole:
                    out.append((run.conv, *_here(run, with_text), *[None] * 6))
                elif run:
                    opened(run)
                run = _Run(conv, run is not None)  # the first one may have begun in the task before
            run.turns.append((pos, turn, role, text, gone))
            run.chars += len(text)
            if len(run.turns) > limits[0] or run.chars > limits[1]:
                opened(run)
                run.chars = 0
            if len(out) >= 1000:
                yield batch()
        if out:
            yield batch()
    if run:
        opened(run)  # the last one may go on in the next task
    if out:
        yield batch()


def _blocks(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Codes, counts and the min-plus matrix of every block."""
    counts = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "numbers")
    for b in batches:
        rows = []
        for conv, turns in zip(b[0].to_pylist(), b[1].to_pylist(), strict=True):
            codes = bytes(t["code"] for t in turns)
            matrix = []
            for t in range(4):
                v: Costs = tuple(0 if s == t else FAR for s in range(4))
                for c in reversed(codes):
                    v = before(c, v)
                matrix.append([min(x, FAR) for x in v])
            got = _summary(codes, [t["turn"] for t in turns])
            rows.append((conv, turns[0]["pos"], [t["pos"] for t in turns], codes, [x for m in matrix for x in m],
                         [got[c] for c in counts], turns[0]["turn"], turns[-1]["turn"]))
        types = [kind, pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                         names=["conv_id", "at", "places", "codes", "matrix", "counts", "head", "tail"])


def _chain(blocks: pd.DataFrame) -> pd.DataFrame:
    """Cost vectors behind every block of one conversation, and the conversation's counts beside its first block."""
    blocks = blocks.sort_values("at", ascending=False)
    v: Costs = END
    ends = []
    for matrix in blocks["matrix"]:
        ends.append([int(x) for x in v])
        v = tuple(min(int(matrix[4 * t + s]) + v[t] for t in range(4)) for s in range(4))
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "numbers"), 0)
    low = high = last = previous = None
    for counts, head, tail in zip(blocks["counts"][::-1], blocks["head"][::-1], blocks["tail"][::-1], strict=True):
        blank, duplicate, truncated, illegal, first, ending, least, most, numbers = (None if x is None or x != x else int(x) for x in counts)
        if first is not None:
            total["illegal"] += illegal + (last is not None and (last, first) not in LEGAL)
            last = ending
            total["blank"] += blank
            total["duplicate"] += duplicate
            total["truncated"] += truncated
        if numbers:  # turns are in order: only the number at the border can be counted twice
            total["numbers"] += numbers - (previous == least)
            low, high, previous = least if low is None else low, most, most
    some = [None] * (len(blocks) - 1)
    return pd.DataFrame({"at": blocks["at"].to_list(), "end": ends, "total": [
        *some, [_gaps(low, high, total["numbers"]), total["blank"], total["duplicate"], total["truncated"], total["illegal"], v[0]]]})


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind each block for every state before it."""
    for b in batches:
        got = [[walk(codes, tuple(end), s)[1] for s in range(4)] for codes, end in zip(b[2].to_pylist(), b[3].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(got, pa.list_(pa.int32()))], names=["conv_id", "at", "leads"])


def _starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state before each block of one conversation."""
    blocks = blocks.sort_values("at")
    state, starts = 0, []
    for leads in blocks["leads"]:
        starts.append(state)
        state = int(leads[state])
    return pd.DataFrame({"at": blocks["at"].to_list(), "start": starts, "closed": [False] * (len(starts) - 1) + [True]})


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every turn's edits, block by block: what is inserted before it, its own edit, what is inserted behind the last."""
    for b in batches:
        for at, places, codes, end, start, closed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            edits, state = walk(codes, tuple(end), start)
            tail = closing(state) if closed else []
            audit = [_audit([e]) for e in edits]
            audit[-1] += "I" * len(tail)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int64()), pa.array([at] * len(places), pa.int64()), pa.array(audit, pa.string()),
                 pa.array([[ROLE[s] for s in new] for new, _, _ in edits], pa.list_(pa.string())), pa.array([e for _, e, _ in edits], pa.string()),
                 pa.array([ROLE.get(s, "") for _, _, s in edits], pa.string()),
                 pa.array([[]] * (len(edits) - 1) + [[ROLE[s] for s in tail]], pa.list_(pa.string()))],
                names=["pos", "at", "audit", "new", "edit", "renamed", "tail"])


def _digests(batches: Iterator[pa.RecordBatch], kind: pa.DataType, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Edits and hash of conversations whose blocks come in order."""
    conv, sha, audit, texts, lines, begun = None, None, [], [], 0, False

    def row() -> pa.RecordBatch:
        columns = [pa.array([conv], kind), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])]
        names = ["conv_id", "audit", "repaired_sha256"]
        return pa.RecordBatch.from_arrays(columns + ([pa.array(["\n".join(texts)])] if with_text else []),
                                          names=names + (["repaired"] if with_text else []))

    for b in batches:
        for c, some, body, n in zip(b[0].to_pylist(), b[2].to_pylist(), b[3].to_pylist(), b[4].to_pylist(), strict=True):
            if not begun or c != conv:
                if begun:
                    yield row()
                conv, sha, audit, texts, lines, begun = c, hashlib.sha256(), [], [], 0, True
            audit.append(some)
            if n:
                sha.update((("\n" if lines else "") + body).encode())
                lines += n
                if with_text:
                    texts.append(body)
    if begun:
        yield row()


def _wide(turns: DataFrame, with_text: bool) -> DataFrame:
    """Results of the conversations whose turns lie in several tasks or exceed a task's share."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    arrow = turns.select("conv_id").limit(0).toArrow().schema.field(0).type
    longest = turns.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    bits = max(BLOCK_BITS, -(-longest.bit_length() // 2))
    first = turns.filter(F.col("code") < 4 * GONE).groupBy("conv_id", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    again = F.col("new").isNull() & F.floor(F.col("code") / 4).isin(SOUND, TRUNCATED)
    light = turns.select("conv_id", "pos", "turn", "code").join(first, "pos", "left").select(
        "conv_id", "pos", "turn", F.when(again, F.col("code") % 4 + 4 * DUPLICATE).otherwise(F.col("code")).alias("code"))
    block = F.shiftright("pos", bits)
    grouped = light.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "code"))).alias("turns"))
    blocks = staged(grouped.select("conv_id", "turns").mapInArrow(
        lambda b: _blocks(b, arrow), f"conv_id {kind}, at bigint, places array<bigint>, codes binary, matrix array<bigint>, counts array<bigint>, "
        "head bigint, tail bigint"), "blocks")
    chain = staged(blocks.select("conv_id", "at", "matrix", "counts", "head", "tail").groupBy("conv_id").applyInPandas(
        _chain, "at bigint, end array<bigint>, total array<bigint>"), "chains")
    leads = blocks.select("conv_id", "at", "codes").join(chain.select("at", "end"), "at").select("conv_id", "at", "codes", "end").mapInArrow(
        _leads, f"conv_id {kind}, at bigint, leads array<int>")
    starts = staged(leads.groupBy("conv_id").applyInPandas(_starts, "at bigint, start int, closed boolean"), "starts")
    edits = blocks.select("at", "places", "codes").join(chain.select("at", "end"), "at").join(starts, "at").select(
        "at", "places", "codes", "end", "start", "closed").mapInArrow(
        _edits, "pos bigint, at bigint, audit string, new array<string>, edit string, renamed string, tail array<string>")
    own = F.when(F.col("edit") == "K", F.array(F.concat("role", F.lit(":"), "text"))).when(
        F.col("edit") == "R", F.array(F.concat("renamed", F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))
    empty = lambda c: F.transform(c, lambda r: F.concat(r, F.lit(":")))
    lined = turns.select("conv_id", "pos", "role", "text").join(edits, "pos").select(
        "conv_id", "at", F.struct("pos", "audit", F.concat(empty("new"), own, empty("tail")).alias("lines")).alias("x"))
    pieces = lined.groupBy("conv_id", "at").agg(F.sort_array(F.collect_list("x")).alias("l")).select(
        "conv_id", "at", F.array_join("l.audit", "").alias("audit"), F.flatten("l.lines").alias("lines")).select(
        "conv_id", "at", "audit", F.array_join("lines", "\n").alias("body"), F.size("lines").alias("n"))
    more = ", repaired string" if with_text else ""
    done = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(
        lambda b: _digests(b, arrow, with_text), f"conv_id {kind}, audit string, repaired_sha256 string{more}")
    totals = chain.filter("total IS NOT NULL").join(blocks.select(F.col("at"), F.col("conv_id").alias("c")), "at")
    counts = [F.col("total")[i].alias(c) for i, c in enumerate(list(RESULT)[:6])]
    return done.join(totals, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", *counts, "audit", "repaired_sha256", *(["repaired"] if with_text else []))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           gone: Column | None = None, with_text: bool = False, limits: tuple[int, int] = (LOCAL_TURNS, LOCAL_CHARS)) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (and repaired): a row per conversation.

    ``gone`` marks rows that are not there but whose conversation is to be returned all the same.
    """
    small_batches(turns.sparkSession)
    out = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.when(out, F.lit("")).otherwise(F.coalesce(F.col(text).cast("string"), F.lit(" "))).alias("text"), out.alias("gone"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).withColumn("uid", F.monotonically_increasing_id())
    # the last column deals even equal rows of one conversation to several tasks
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie"), F.asc("uid")]
    ordered = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone").withColumn(
        "pos", F.monotonically_increasing_id())
    kind = rows.schema["conv_id"].dataType.simpleString()
    arrow = rows.select("conv_id").limit(0).toArrow().schema.field(0).type
    fields = ", ".join(f"{c} {t}" for c, t in (RESULT | ({"repaired": "string"} if with_text else {})).items())
    table = staged(ordered.mapInArrow(lambda b: _local(b, arrow, limits, with_text),
                                      f"conv_id {kind}, {fields}, pos bigint, turn bigint, role string, text string, code int, digest binary"), "turns")
    columns = ["conv_id", *RESULT, *(["repaired"] if with_text else [])]
    wide = _wide(table.filter("pos IS NOT NULL").select("conv_id", "pos", "turn", "role", "text", "code", "digest"), with_text)
    return table.filter("pos IS NULL").select(*columns).unionByName(wide.select(*columns))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the damage that their conversation and number call for, with a mark ``gone`` on dropped ones."""
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                                (F.crc32(key) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("damage") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The repair of damaged conversations, one row for every conversation id of the table."""
    return repair(damaged(conversations), gone=F.col("gone"))


_ADD = "struct_pack(c := {s}.c + {c}, a := {s}.a || '{a}', r := {s}.r || {r})"


def _sql_row() -> str:
    """The four states behind a turn, from the states t0 to t3 before it (inserts made)."""
    sound = "CASE WHEN fault < 2 THEN {} END"
    line, name = "chr(10) || role || ':' || text", "chr(10) || '{}:' || text"
    gone = [_ADD.format(s=f"t{i}", c=3, a="D", r="''") for i in range(4)]
    keep = lambda i, letter: f"CASE WHEN fault < 2 AND initial = '{letter}' THEN {_ADD.format(s=f't{i}', c='fault', a='K', r=line)} END"
    rename = lambda i, role: sound.format(_ADD.format(s=f"t{i}", c="2 + fault", a="R", r=name.format(role)))
    ways = {0: [gone[0]], 1: [gone[1], keep(0, "s")], 2: [gone[2], *(f(i, x) for i in (0, 1, 3) for f, x in ((keep, "u"), (rename, "user")))],
            3: [gone[3], keep(2, "a"), rename(2, "assistant")]}
    return ", ".join(f"list_min([{', '.join(w)}]) AS s{i}" for i, w in ways.items())


def _sql_inserts(source: str) -> str:
    user = [_ADD.format(s=f"s{i}", c=2, a="I", r="chr(10) || 'user:'") for i in (0, 1, 3)]
    reply = _ADD.format(s="t2", c=2, a="I", r="chr(10) || 'assistant:'")
    return (f"SELECT * EXCLUDE (s0, s1, s2, s3), s0 AS t0, s1 AS t1, t2, list_min([s3, {reply}]) AS t3 FROM "
            f"(SELECT *, list_min([s2, {', '.join(user)}]) AS t2 FROM {source})")


_STATE = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"

#: The same in DuckDB: the damage by a bitwise checksum, the cheapest scripts by a forward recursion over turns.
ORACLE = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || flatten(list_transform(str_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                         lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
                         lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS damage
  FROM conversations),
turns AS (
  SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM src WHERE damage <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, substring(role, 1, 1) AS initial FROM turns),
marked AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 3
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank,
         count(*) FILTER (fault = 3) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS turns
  FROM marked GROUP BY conv_id),
scripts AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(struct_pack(c := 0, a := '', r := '') AS {_STATE}) AS s0,
         CAST(NULL AS {_STATE}) AS s1, CAST(NULL AS {_STATE}) AS s2, CAST(NULL AS {_STATE}) AS s3 FROM counts
  UNION ALL
  SELECT conv_id, n, {_sql_row()}
  FROM ({_sql_inserts("scripts")}) before
  JOIN (SELECT conv_id AS id, n AS next, role, text, initial, fault FROM marked) m ON m.id IS NOT DISTINCT FROM before.conv_id AND m.next = before.n + 1),
best AS (
  SELECT p.conv_id, list_min([t0, t3]) AS b FROM ({_sql_inserts("scripts")}) p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.turns = p.n),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substring(b.r, 2), '')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id
""".replace("SELECT conv_id, n, list_min", "SELECT conv_id, next AS n, list_min")
