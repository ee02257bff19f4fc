"""Near-duplicate classes by HyperMinHash sketches.

A document is the set of its 5-word shingles.  One hash per shingle addresses a register and gives it a
value; a register keeps the smallest value as its count of leading zeros and a few mantissa bits behind them
(16 bits in all).  Empty registers borrow from others along a fixed random order, then groups of registers
are hashed into band keys.  Documents that share a key are candidates; the Jaccard similarity of a candidate
pair is estimated from the share of equal registers, corrected for chance collisions, and pairs that are not
six standard errors below the threshold are confirmed on their full shingle sets.

No group of candidates is expanded into pairs.  Equal sets are one node.  Every key first links its members
to its most central member (a star: the member that shares most keys with others), and linked nodes become
components.  Keys that still hold several components are finished by an exact argument on their documents'
shingles.  A shingle of at most ``RARE`` of these documents is rare; its documents are few, so the rare
shingles that two documents share are counted from an index.  Two sets of n and m shingles are linked only
if they have 85 (n + m) / 185 in common, and outside the rare ones they cannot have more in common than the
smaller number of common shingles.  So a pair is tested if its shared rare shingles and that number reach
the bound; without a shared rare shingle both documents must consist of common shingles nearly altogether,
and only such pairs of one key and different components are tested besides.

With 42 bands of 6 registers a pair at the threshold of 0.85 shares no key with a probability of about 2e-9.

Defined results: words are cut at ASCII white space after A-Z are lower-cased; a text of fewer than five words is
one shingle; null texts and texts without a word have an empty set and are linked with nothing; a row without an
id is returned unlinked with a null class and stays; wholly repeated rows share their class and their fate; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from presslens.llm.common import small_batches, staged, unused

#: Words of a shingle.
WIDTH = 5
#: Least similarity of a link, in percent.
PERCENT = 85
#: Registers of a sketch (a power of two), mantissa bits of each.
REGISTERS, MANTISSA = 256, 10
#: Registers of a band and number of bands.
ROWS, BANDS = 6, 42
#: Mark of an empty register.
EMPTY = np.uint16(0xFFFF)
#: Documents of open keys up to which a shingle counts as rare.
RARE = 64
#: Standard errors that an estimate may lie below the threshold.
ERRORS = 6.0

_RNG = np.random.default_rng(20240)
_TURN = _RNG.integers(1, 1 << 63, size=WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(1, 1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.stack([_RNG.permutation(REGISTERS) for _ in range(REGISTERS)])
_DEAL = _RNG.permutation(REGISTERS)[:ROWS * BANDS].reshape(BANDS, ROWS)
_SHIFT = np.uint64(64 - REGISTERS.bit_length() + 1)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < WIDTH:
        return _mix(np.atleast_1d((h * _TURN[:len(h)]).sum(dtype=np.uint64)) + np.uint64(len(words)))
    n = len(h) - WIDTH + 1
    total = h[:n] * _TURN[0]
    for i in range(1, WIDTH):
        total += h[i:i + n] * _TURN[i]
    return np.unique(_mix(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted hash set: leading zeros and mantissa of the smallest value of each bucket."""
    out = np.full(REGISTERS, EMPTY)
    if not len(hashes):
        return out
    bucket = (hashes >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    value = hashes[first] << np.uint64(64 - int(_SHIFT))
    zeros = 53 - np.frexp((value >> np.uint64(11)).astype(np.float64))[1]
    shift = np.minimum(zeros + 1, 63).astype(np.uint64)
    mantissa = (value << shift) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; empty registers borrow the first full one in their own random order."""
    full = registers != EMPTY
    bare = np.flatnonzero(~full)
    if len(bare) and full.any():
        registers = registers.copy()
        registers[bare] = registers[_ORDER[bare, full[_ORDER[bare]].argmax(axis=1)]]
    total = (registers[_DEAL].astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64)
    return _mix(total + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _zeros_law(n: int) -> np.ndarray:
    """Chance that the smallest value of a register has l leading zeros, l = 0..53, in a set of n."""
    edges = np.exp(-(n / REGISTERS) * 0.5 ** np.arange(55))
    return edges[1:] - edges[:-1]


def estimate(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> tuple[float, int]:
    """Collision-corrected Jaccard estimate and the number of registers that it rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    n = int(used.sum())
    if not n:
        return 0.0, 0
    equal = float(((a == b) & used).sum()) / n
    chance = float((_zeros_law(na) * _zeros_law(nb)).sum()) / (1 << MANTISSA)
    return max(0.0, (equal - chance) / (1 - chance)), n


def near_enough(na: int, nb: int, common: int) -> bool:
    return 100 * common >= PERCENT * (na + nb - common)


#: Sets smaller than this are linked with equal sets only: n of n + 1 shingles are below the threshold.
LEAST = math.floor(PERCENT / (100 - PERCENT)) + 1


def _sketched(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, n, hi, lo (128-bit hash of the set), bands."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, keys, ends = [], [], [], [], [0]
            for t in batch[1].to_pylist():
                s = shingles(t)
                n.append(len(s))
                high, low = _digest(s)
                hi.append(high)
                lo.append(low)
                if len(s) >= LEAST:
                    keys.append(band_keys(sketch(s)))
                ends.append(ends[-1] + (BANDS if len(s) >= LEAST else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                names=["doc_id", "n", "hi", "lo", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, hi bigint, lo bigint, bands array<bigint>")


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _contents(docs: DataFrame, nodes: DataFrame, id_col: str, text: str) -> DataFrame:
    """node, hi, n, sketch, text of the candidate documents: one row of each node's set, however often its row is repeated.

    ``nodes`` has node, hi, lo and the number of rows; only rows of repeated nodes move to be told apart.
    """
    rows = docs.select(F.col(id_col).alias("node"), F.col(text).cast("string").alias("text")).join(nodes, "node").select(
        "node", "hi", "lo", "rows", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch[4].to_pylist()]
            own = pa.array([_digest(s) == x for s, x in zip(sets, zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True), strict=True)], pa.bool_())
            whole = pa.RecordBatch.from_arrays(
                [batch[0], batch[1], batch[3], pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([sketch(s).tobytes() for s in sets], pa.binary()), batch[4]],
                names=["node", "hi", "rows", "n", "sketch", "text"])
            yield whole.filter(own)

    kind = rows.schema["node"].dataType.simpleString()
    every = staged(rows.mapInArrow(run, f"node {kind}, hi bigint, rows bigint, n bigint, sketch binary, text string"), "contents")
    once = staged(every.filter("rows > 1").dropDuplicates(["node", "hi"]), "repeated")
    return every.filter("rows = 1").unionByName(once).drop("rows")


@F.pandas_udf(BooleanType())
def _likely(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    out = []
    for x, y, m, n in zip(a, b, na, nb, strict=True):
        j, used = estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), m, n)
        t = PERCENT / 100
        out.append(100 * min(m, n) >= PERCENT * max(m, n) and j >= t - ERRORS * math.sqrt(t * (1 - t) / max(used, 1)))
    return pd.Series(out, dtype=bool)


@F.pandas_udf(BooleanType())
def _confirmed(a: pd.Series, b: pd.Series) -> pd.Series:
    out, last, held = [], None, None
    for x, y in zip(a, b, strict=True):
        if x != last:
            last, held = x, shingles(x)
        other = shingles(y)
        common = len(np.intersect1d(held, other, assume_unique=True))
        out.append(near_enough(len(held), len(other), common))
    return pd.Series(out, dtype=bool)


def _links(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate and then whose full sets reach the threshold."""
    short = contents.select("node", "n", "sketch")
    left, right = (short.select(*[F.col(c).alias(f"{c}_{s}") for c in short.columns]) for s in "ab")
    likely = pairs.join(left, F.col("a") == F.col("node_a")).join(right, F.col("b") == F.col("node_b")).filter(
        _likely("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b")
    likely = staged(likely, "likely")
    whole_a = contents.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    whole_b = contents.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return staged(likely.join(whole_b, "b").join(whole_a, "a").filter(_confirmed("text_a", "text_b")).select("a", "b"), "links")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: the smallest node of every component (only nodes with a link appear).

    Every round takes the smallest label among a node and its neighbours and then the label of that label,
    so that the distance covered doubles; each round is written to the shared folder.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        onward = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        jumped = staged(step.join(onward, F.col("label") == F.col("via"), "left").select(
            "node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.filter("old <> label").head(1):
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _open_pairs(open_keys: DataFrame, contents: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may reach the threshold (see the module's text)."""
    nodes = open_keys.select("node", "part").distinct()
    rows = contents.select("node", "hi", "n", "text").join(nodes, "node").select("node", "hi", "part", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch[3].to_pylist()):
                h = shingles(t).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), *(pa.array([batch[c][i].as_py()] * len(h), batch.schema.field(c).type) for c in (0, 1, 2))],
                    names=["s", "node", "hi", "part"])

    kind = rows.schema["node"].dataType.simpleString()
    flat = rows.mapInArrow(spread, f"s bigint, node {kind}, hi bigint, part {kind}")
    counted = flat.groupBy("s").agg(F.count("*").alias("docs"))
    rare = staged(flat.join(counted.filter(F.col("docs") <= RARE), "s").select("s", "node", "hi", "part", "docs"), "rare")
    weight = staged(contents.select("node", "hi", "n").join(nodes, "node").join(
        rare.groupBy("node", "hi").agg(F.count("*").alias("r")), ["node", "hi"], "left").select(
        "node", "hi", "part", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("common")), "weights")
    need = (PERCENT * (F.col("nu") + F.col("nv"))) / (100 + PERCENT)
    lists = rare.filter("docs > 1").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("node", "hi", "part"))).alias("l"))
    two = lists.select(F.posexplode("l").alias("i", "x"), "l").select("x", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("y")).filter(
        "x.part <> y.part").groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.hi").alias("hu"), F.col("y.hi").alias("hv")).agg(F.count("*").alias("both"))
    of = lambda c, s: weight.select(F.col("node").alias(c), F.col("hi").alias(f"h{s}"), F.col("n").alias(f"n{s}"), F.col("common").alias(f"c{s}"))
    by_rare = two.join(of("a", "u"), ["a", "hu"]).join(of("b", "v"), ["b", "hv"]).filter(
        F.col("both") + F.least("cu", "cv") >= need).select("a", "b")
    # nearly all common: the smaller bound of a pair is reached with an equal set size, n * 170 / 185
    plain = open_keys.select("key", "node", "part", "main").join(weight.select("node", "n", "common"), "node").filter(
        F.col("common") * (100 + PERCENT) >= PERCENT * (F.col("n") + F.ceil(F.col("n") * PERCENT / 100)))
    u, v = (plain.select("key", F.col("node").alias(s), F.col("part").alias(f"p{s}"), F.col("n").alias(f"n{s}"),
                         F.col("common").alias(f"c{s}"), F.col("main").alias(f"m{s}")) for s in "uv")
    by_common = u.filter("pu <> mu").join(v, "key").filter((F.col("pu") != F.col("pv")) & (F.least("cu", "cv") >= need)).select(
        F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return by_rare.unionByName(by_common).distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_set: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and, if wanted, hi and lo, the hash of the shingle set): one row per document."""
    small_batches(docs.sparkSession)
    table = staged(_sketched(docs, id_col, text), "sketches")
    sets = staged(table.filter("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")), "sets")
    nodes = staged(table.filter(F.size("bands") > 0).select("doc_id", "hi", "lo", "bands").join(
        sets.select(F.col("rep").alias("doc_id"), "hi", "lo"), ["doc_id", "hi", "lo"], "left_semi").groupBy(
        F.col("doc_id").alias("node"), "hi", "lo").agg(F.first("bands").alias("bands"), F.count("*").alias("rows")), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    sizes = staged(entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "keys")
    keyed = staged(entries.join(sizes, "key").select("key", "node", "size"), "members")
    central = keyed.groupBy("node").agg(F.sum("size").alias("centre"))
    members = staged(keyed.join(central, "node"), "centred")
    contents = _contents(docs, nodes.select("node", "hi", "lo", "rows").join(central.select("node"), "node", "left_semi"), id_col, text)

    # one star per key
    heads = members.groupBy("key").agg(F.max_by("node", F.struct("centre", "node")).alias("head"))
    star = members.join(heads, "key").filter("node <> head").select(
        F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    star = staged(star, "star")
    links = _links(star, contents)
    labels = components(links)

    # keys that still hold several components
    named = members.filter("size > 2").join(labels, "node", "left").select(
        "key", "node", F.coalesce("label", "node").alias("part"))
    parts = named.groupBy("key", "part").agg(F.count("*").alias("c"))
    main = parts.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    open_keys = staged(named.join(main.select("key", "main"), "key"), "open")
    more = _links(staged(_open_pairs(open_keys, contents).join(star, ["a", "b"], "left_anti"), "cross"), contents)

    # the second links join whole components
    ends = more.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).distinct()
    joined = components(ends)
    whole = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select(
        "node", F.coalesce("top", "label").alias("label"))
    alone = joined.join(labels.select("node"), "node", "left_anti")
    final = whole.unionByName(alone)

    classes = sets.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "hi", "lo", F.coalesce("label", "rep").alias("class"))
    filled = table.select("doc_id", "n", F.when(F.col("n") > 0, F.col("hi")).alias("hi"), "lo", F.col("hi").alias("set_hi"))
    out = filled.join(classes, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
                      *([F.col("set_hi").alias("hi"), "lo"] if with_set else []))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest id) of each class; all columns stay.

    An id whose rows have different texts may keep some of them and lose others: only such rows are told apart by their sets.
    """
    classes = staged(near_classes(docs, id_col, text, with_set=True), "classes")
    owner, mixed, made = unused(docs, "owner", "mixed", "set")
    by_id = classes.groupBy("doc_id").agg(F.bool_or("kept").alias("some"), F.bool_and("kept").alias("every")).filter("NOT every")
    rows = docs.join(by_id.filter("NOT some").select(F.col("doc_id").alias(owner)), F.col(id_col) == F.col(owner), "left_anti")
    doubtful = staged(by_id.filter("some").select(F.col("doc_id").alias(owner), F.lit(True).alias(mixed)), "doubtful")
    if not doubtful.head(1):  # the texts stay where they are
        return rows

    @F.pandas_udf("struct<hi: bigint, lo: bigint>")
    def own_set(texts: pd.Series, asked: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_digest(shingles(t)) if a else (0, 0) for t, a in zip(texts, asked, strict=True)], columns=["hi", "lo"], dtype="int64")

    asked = F.coalesce(F.col(mixed), F.lit(False))
    marked = rows.join(doubtful, F.col(id_col) == F.col(owner), "left").withColumn(made, F.when(asked, own_set(F.when(asked, F.col(text).cast("string")), asked)))
    lost = classes.filter("NOT kept").join(doubtful.select(F.col(owner).alias("of")), F.col("doc_id") == F.col("of")).select(
        F.col("doc_id").alias("gone"), F.col("hi").alias("gone_hi"), F.col("lo").alias("gone_lo")).distinct()
    return marked.join(lost, (F.col(owner) == F.col("gone")) & (F.col(made)["hi"] == F.col("gone_hi")) & (F.col(made)["lo"] == F.col("gone_lo")), "left_anti").drop(
        owner, mixed, made)
