"""Language identification by nearest centroid.

A text is the count vector of its hashed byte 3-grams (letters lower-cased, ASCII signs and digits blanked),
weighted by inverse document frequency and normalised.  Every language is represented by several centroids,
found by spherical k-means on a bounded sample of its labelled texts; a text takes the language of the
centroid with the largest cosine.  A text is rejected when it is farther from that centroid than any training
text of the language from its own, by a wide margin.  Short texts have few 3-grams and so a small cosine with any centroid;
the margin shrinks with the root of their number, so that a single word of a known language is not rejected.

The document frequencies cover every training document.  The k-means sample is bounded by ``SAMPLE`` texts per
language (the one documented bound).  Predictions use the text alone.

Defined results: null texts and texts without a letter are ``und`` with score 0 and are rejected; without any
labelled row everything is ``und``; ties go to the language that sorts first; repeated rows are predicted one
by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from presslens.llm.common import small_batches

#: Buckets into which 3-grams are hashed.
DIM = 4096
#: Labelled texts per language on which centroids are fitted (expected number; at most twice as many).
SAMPLE = 400
#: Centroids per language.
CENTROIDS = 3
#: A text is rejected below this part of the smallest cosine that its language has in the sample ...
SLACK = 0.25
#: ... and, with fewer 3-grams than this, below the root of their share of it.
FULL = 400

_BLANKED = bytes.maketrans(bytes(b for b in range(128) if not chr(b).isalpha()), b" " * 76)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed 3-gram counts of the whole text."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_BLANKED), dtype=np.uint8).astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    code = code[code != 0x202020]
    return np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)


@dataclass
class Model:
    """Fitted centroids: ``langs[i]`` and ``radius[i]`` belong to row ``i`` of ``centres``."""

    idf: np.ndarray
    langs: list[str] = field(default_factory=list)
    centres: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM), np.float32))
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vector(self, c: np.ndarray) -> np.ndarray:
        v = c.astype(np.float32) * self.idf
        norm = float(np.sqrt(v @ v))
        return v / norm if norm else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        grams = counts(text)
        cos = self.centres @ self.vector(grams)
        i = int(cos.argmax())
        score = min(max(float(cos[i]), 0.0), 1.0)
        return self.langs[i], score, score < SLACK * float(self.radius[i]) * min(1.0, (int(grams.sum()) / FULL) ** 0.5)


def _kmeans(x: np.ndarray, k: int, rounds: int = 20, starts: int = 5) -> tuple[np.ndarray, float]:
    """Spherical k-means, the best of several seeded starts; centres and the smallest cosine to the nearest."""
    rng = np.random.default_rng(0)
    best: tuple[float, np.ndarray] | None = None
    for _ in range(starts):
        centres = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(axis=1)
            new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, centres):
                break
            centres = new
        total = float((x @ centres.T).max(axis=1).sum())
        if best is None or total > best[0]:
            best = total, centres
    return best[1].astype(np.float32), float((x @ best[1].T).max(axis=1).min())


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        centroids: int = CENTROIDS) -> Model:
    """Fit on the rows of ``train`` that have a text and a language."""
    small_batches(train.sparkSession)
    rows = train.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter(
        "text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").count().withColumn(
        "cut", F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))).select("lang", "cut")
    # one row per language: a table of label names, whatever the number of documents
    cut = {r["lang"]: r["cut"] for r in sizes.collect()}
    if not cut:
        return Model(np.ones(DIM, np.float32))
    dealt = rows.withColumn("u", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Document frequencies of the task (lang null), and the counts of the sampled texts."""
        seen, n = np.zeros(DIM, np.int64), 0
        names = ["lang", "u", "counts", "n"]
        for batch in batches:
            langs, us, vectors = [], [], []
            for t, g, u in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
                if not has_letter(t):
                    continue
                c = counts(t)
                seen += c > 0
                n += 1
                if u < cut[g]:
                    langs.append(g)
                    us.append(u)
                    vectors.append(c.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(us, pa.float64()), pa.array(vectors, pa.binary()),
                                              pa.array([1] * len(langs), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0.0]), pa.array([seen.astype("<i8").tobytes()], pa.binary()),
                                          pa.array([n], pa.int64())], names=names)

    from presslens.llm.common import staged

    found = staged(dealt.mapInArrow(gather, "lang string, u double, counts binary, n bigint"), "grams")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for b, k in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                total += np.frombuffer(b, "<i8")
                n += k
        yield pa.RecordBatch.from_arrays([pa.array([*range(DIM), -1], pa.int32()), pa.array([*total.tolist(), n], pa.int64())], names=["bucket", "df"])

    sums = found.filter("lang IS NULL").select("counts", "n").mapInArrow(add_up, "bucket int, df bigint")
    frequency = {r["bucket"]: r["df"] for r in sums.groupBy("bucket").agg(F.sum("df").alias("df")).collect()}  # DIM + 1 rows
    n = frequency.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([frequency.get(i, 0) for i in range(DIM)], float))).astype(np.float32) + 1
    shape = Model(idf)

    def centre(some: pd.DataFrame) -> pd.DataFrame:  # at most 2 * sample rows
        x = np.stack([shape.vector(np.frombuffer(b, "<i4")) for b in some.sort_values(["u", "counts"])["counts"]])
        centres, low = _kmeans(x, centroids)
        return pd.DataFrame({"lang": some["lang"].iloc[0], "no": range(len(centres)), "centre": [c.tobytes() for c in centres], "radius": low})

    bounded = found.filter("lang IS NOT NULL").withColumn(
        "r", F.row_number().over(W.partitionBy("lang").orderBy("u", "counts"))).filter(F.col("r") <= 2 * sample).drop("r")
    fitted = bounded.groupBy("lang").applyInPandas(centre, "lang string, no int, centre binary, radius double")
    best = sorted(fitted.collect(), key=lambda r: (r["lang"], r["no"]))  # languages * centroids rows
    if not best:
        return shape
    return Model(idf, [r["lang"] for r in best], np.stack([np.frombuffer(r["centre"], np.float32) for r in best]),
                 np.array([r["radius"] for r in best]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch[1].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch[0], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns and the order of rows stay."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def rejected(texts: pd.Series) -> pd.Series:
        return pd.Series([model.predict(t)[2] for t in texts], dtype=bool)

    return docs.filter(~rejected(F.col(text).cast("string")))


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model may learn from: CRC-32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predict_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from the rows that are not held out."""
    model = fit(docs.filter(~held_out(id_col)), text, lang)
    out = identify(docs, model, id_col, text)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
