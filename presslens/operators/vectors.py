"""Vector operators (V02-V11, J12, O07, M05): similarity scores against a few fixed vectors.

Query and prototype vectors come from a table (read behind a row-count check)
and travel with the scoring function: every article row is scored in one pass
with no join, no shuffle and no pair table.  The similarity kernel is one NumPy
matrix product per Arrow batch (interpreted array lambdas were 3-12x slower).  Per-cluster statistics
(centroids) are partial aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from presslens.functions import vectors as VF
from presslens.operators.joins import bounded_broadcast

MAX_QUERY_VECTORS = 10_000


def _vectors(df: DataFrame, emb_col: str = "embedding", order: Sequence[str] = (),
             max_rows: int = MAX_QUERY_VECTORS) -> list:
    src = df.orderBy(*order) if order else df
    return VF.collect_bounded(src, max_rows, "query vectors")


def semantic_score(df: DataFrame, queries: DataFrame, emb_col: str = "embedding", out: str = "ai_score",
                   q_emb_col: str = "embedding") -> DataFrame:
    """Mean cosine similarity of each row's vector to the query vectors, however many.

    The mean of cosines is one product with the mean of the unit vectors, which is a partial aggregate.  No query gives null.
    """
    mean = _mean_units(queries, q_emb_col)
    if mean is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, VF.cosine_matrix(F.col(emb_col), [mean], as_is=True)[0])


def _units(vectors: DataFrame, emb_col: str, *keep: str) -> DataFrame:
    """``v``: the vectors at unit length (one of norm 0 counts as zeros, a null one not at all)."""
    from pyspark.ml.functions import array_to_vector

    e = F.col(emb_col).cast("array<double>")
    unit = F.transform(e, lambda x: F.coalesce(F.try_divide(x, VF.norm(e)), F.lit(0.0)))
    return vectors.filter(F.col(emb_col).isNotNull()).select(*keep, array_to_vector(unit).alias("v"))


def _mean(col: str) -> Column:
    from pyspark.ml.stat import Summarizer

    return Summarizer.mean(F.col(col))


def _mean_units(queries: DataFrame, emb_col: str = "embedding") -> list[float] | None:
    """The mean of all vectors at unit length; None without a vector."""
    units = _units(queries, emb_col)
    return [float(x) for x in units.agg(_mean("v")).first()[0]] if units.head(1) else None


def contrastive_score(df: DataFrame, positive: DataFrame, negative: DataFrame, emb_col: str = "embedding",
                      out: str = "ai_score", order: Sequence[str] = ("phrase_no",)) -> DataFrame:
    """Mean over i of cos(v, pos_i) - cos(v, neg_i) (pairs aligned by ``order``)."""
    if positive.count() != negative.count():
        raise ValueError("positive and negative query sets differ in size")
    pos, neg = _mean_units(positive), _mean_units(negative)  # a mean of differences is the difference of means
    if pos is None or neg is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, VF.cosine_matrix(F.col(emb_col), [[p - n for p, n in zip(pos, neg, strict=True)]], as_is=True)[0])


def classify_by_prototype(df: DataFrame, protos: DataFrame, emb_col: str = "embedding", out: str = "event_type",
                          name_col: str = "name", order: Sequence[str] = ("name", "phrase_no")) -> DataFrame:
    """Name of the prototype vector with the greatest cosine (ties: first in ``order``)."""
    order = [c for c in order if c in protos.columns]
    few = protos.limit(MAX_QUERY_VECTORS + 1).count()
    if not few:
        return df.withColumn(out, F.lit(None).cast(protos.schema[name_col].dataType))
    if few > MAX_QUERY_VECTORS:
        from presslens.operators.clustering import _numbered
        from presslens.session import cut_lineage

        numbered = cut_lineage(_numbered(protos.withColumn("_o", F.struct(*dict.fromkeys([*order, name_col, "embedding"]))), "_o", "_no"))
        near = nearest_in_table(df, numbered, None, "_no", emb_col, "embedding", "_no", "cosine")
        return near.join(numbered.select("_no", F.col(name_col).alias(out)), "_no", "left").drop("_no")
    rows = _vectors(protos.select(*dict.fromkeys([*order, name_col, "embedding"])), order=order)
    names = F.array(*[F.lit(r[name_col]) for r in rows])
    staged = df.withColumn("_sims", VF.cosine_matrix(F.col(emb_col), [list(r["embedding"]) for r in rows]))
    pick = F.try_element_at(names, VF.array_argmax(F.col("_sims")) + 1)
    return staged.withColumn(out, pick).drop("_sims")


nearest_prototype = classify_by_prototype


def multi_phrase_scores(df: DataFrame, protos: DataFrame, emb_col: str = "embedding", prefix: str = "score_",
                        name_col: str = "name") -> DataFrame:
    """One column per prototype name: mean cosine over its phrases."""
    units = _units(protos, "embedding", name_col)
    means = VF.collect_bounded(units.groupBy(name_col).agg(_mean("v").alias("m")).orderBy(name_col), MAX_QUERY_VECTORS, "prototype names (columns)")
    if not means:
        return df
    staged = df.withColumn("_sims", VF.cosine_matrix(F.col(emb_col), [[float(x) for x in r["m"]] for r in means], as_is=True))
    cols = [F.col("_sims")[i].alias(f"{prefix}{r[name_col]}") for i, r in enumerate(means)]
    return staged.select(*df.columns, *cols)


def argmax_column(df: DataFrame, prefix: str = "score_", out: str = "event_type") -> DataFrame:
    """Name of the column with the greatest score, prefix removed (ties: first column)."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumn(out, _argmax_name([F.col(c) for c in cols], [c[len(prefix):] for c in cols]))


def _argmax_name(scores: Sequence[Column], names: Sequence[str]) -> Column:
    """Name of the largest score; ties go to the earliest position."""
    st = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("p"), F.lit(n).alias("n"))
                   for i, (s, n) in enumerate(zip(scores, names))])
    return F.array_max(st)["n"]


def centroid_query_score(df: DataFrame, queries: DataFrame, emb_col: str = "embedding",
                         out: str = "ai_score") -> DataFrame:
    """Cosine with the mean of the (unit-normalised) query vectors, however many; no query gives null."""
    mean = _mean_units(queries)
    if mean is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, F.try_element_at(VF.cosine_matrix(F.col(emb_col), [mean]), F.lit(1)))


def normalise(df: DataFrame, col: str = "embedding", out: str | None = None, eps: float = 1e-12) -> DataFrame:
    """L2 normalisation (+eps)."""
    return df.withColumn(out or col, VF.normalise(F.col(col), eps))


def cluster_centroids(df: DataFrame, cluster: str = "cluster", emb_col: str = "embedding",
                      noise: int | None = -1, renormalise: bool = True) -> DataFrame:
    """Mean vector per cluster (noise and null vectors left out), optionally re-normalised.

    ``Summarizer.mean`` is one partial aggregate over the vectors as they are: a cluster holding a
    third of the rows still ends as one row per partition.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    src = df.filter(F.col(cluster).isNotNull() & F.col(emb_col).isNotNull())
    if noise is not None:
        src = src.filter(F.col(cluster) != noise)
    vec = array_to_vector(F.col(emb_col).cast("array<double>"))
    cen = (src.groupBy(cluster).agg(Summarizer.mean(vec).alias("_m"), F.count(F.lit(1)).alias("size"))
              .select(cluster, vector_to_array("_m").alias("centroid"), "size"))
    if renormalise:
        cen = cen.withColumn("centroid", VF.normalise(F.col("centroid"), 0.0))
    return cen


def similarity_to_centroid(df: DataFrame, centroids: DataFrame, cluster: str = "cluster",
                           emb_col: str = "embedding", out: str = "sim") -> DataFrame:
    """Dot product of each member with its own cluster centroid (equi-join on cluster).

    At most MAX_QUERY_VECTORS centroids (checked) are broadcast, so the members stay where they are
    instead of meeting on a handful of keys; a larger table is joined as Spark plans it."""
    near = bounded_broadcast(centroids.select(cluster, "centroid"), MAX_QUERY_VECTORS)
    return (df.join(near, cluster, "inner")
              .withColumn(out, VF.dot(F.col(emb_col), F.col("centroid"))).drop("centroid"))


def representatives(df: DataFrame, k: int = 5, cluster: str = "cluster", sim: str = "sim",
                    key: str = "orig_index") -> DataFrame:
    """The k members closest to the centroid per cluster (ties: key asc), with ``rank``.

    ``row_number() <= k`` gets a partial group-limit before the shuffle.
    """
    w = Window.partitionBy(cluster).orderBy(F.col(sim).desc(), F.col(key).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topic_top_sentences(labels: DataFrame, k: int = 5, topic: str = "topic", text_col: str = "text",
                        emb_col: str = "embedding") -> DataFrame:
    """Per topic, the k labels *of all labels* with the largest dot product with the topic's
    raw (not re-normalised) centroid, ``rank`` 1 = largest (ties: text asc).

    Topic centroids are few (one per topic) and travel with the scoring function behind a size
    check; each label row gets its products with every centroid in one pass; the per-topic top-k
    (``row_number``) is limited inside each partition before the shuffle."""
    cen = cluster_centroids(labels, topic, emb_col, noise=None, renormalise=False)
    rows = VF.collect_bounded(cen.orderBy(topic), MAX_QUERY_VECTORS, "topic centroids")
    sims = VF.dot_matrix(F.col(emb_col), [r["centroid"] for r in rows])
    topics = F.array(*[F.lit(r[topic]) for r in rows])
    ex = (labels.select(text_col, sims.alias("_s"))
                .select(text_col, F.posexplode("_s").alias("_i", "sim"))
                .select(text_col, F.try_element_at(topics, F.col("_i") + 1).alias("t"), "sim"))
    w = Window.partitionBy("t").orderBy(F.col("sim").desc(), F.col(text_col).asc())
    return ex.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnRenamed("t", topic)


def assign_nearest(df: DataFrame, centroids: DataFrame, emb_col: str = "embedding", cluster: str = "cluster",
                   out: str = "prediction") -> DataFrame:
    """Id of the nearest centroid (squared Euclidean; ties: the smaller id)."""
    few = centroids.limit(MAX_QUERY_VECTORS + 1).count()
    if not few or few > MAX_QUERY_VECTORS:
        near = nearest_in_table(df, centroids.select(F.col(cluster).alias("_c"), "centroid"), None, "_c", emb_col, "centroid", "_near")
        return near.withColumnRenamed("_near", out)
    rows = VF.collect_bounded(centroids.orderBy(cluster), MAX_QUERY_VECTORS, "centroids")
    ids = F.array(*[F.lit(r[cluster]) for r in rows])
    staged = df.withColumn("_d", VF.sq_distance_matrix(F.col(emb_col), [r["centroid"] for r in rows]))
    return staged.withColumn(out, F.try_element_at(ids, VF.array_argmin(F.col("_d")) + 1)).drop("_d")


def nearest_in_table(df: DataFrame, table: DataFrame, key: str | None = None, id_col: str = "cluster",
                     emb_col: str = "embedding", vec_col: str = "centroid", out: str = "prediction",
                     metric: str = "sqdist", block_rows: int = 512, most_cells: int = 2048) -> DataFrame:
    """J12 / M05 / V04 against a vector table of any size: id of the nearest vector (``metric``:
    'sqdist' or 'cosine'; ties: the smaller id) for every row of ``df``.

    The table is kept as an inverted file (:mod:`presslens.operators.cells`): a row meets its own cell first and then
    only the cells that can hold a nearer vector, so it is sent once to each slice of the table that holds one, and the answer is
    exact.  By cosine the vectors are compared at unit length, where the nearest one has the greatest cosine.  A null vector
    gets null, and so does, by cosine, one of norm 0 (table rows of that kind are left out); so does every row if the
    table is empty.  ``key`` is not needed any more: rows are told apart by a number of their own."""
    import pyarrow as pa

    from presslens.operators import cells
    from presslens.operators.clustering import _numbered
    from presslens.session import cut_lineage

    if metric not in ("sqdist", "cosine"):
        raise ValueError(f"unknown metric {metric}")

    def vectors(df: DataFrame, c: str) -> Column:
        if metric == "sqdist" and dict(df.dtypes)[c] == "array<float>":  # floats travel as such
            return F.col(c)
        e = F.col(c).cast("array<double>")
        length = VF.norm(e)
        return F.when(length > 0, F.transform(e, lambda x: x / F.nullif(length, F.lit(0.0)))) if metric == "cosine" else e

    first = table.groupBy(id_col, vec_col).agg(F.count(F.lit(1)).alias("_n")).select(id_col, vectors(table, vec_col).alias("e")).filter("e IS NOT NULL")
    listed = cut_lineage(_numbered(first.withColumn("_k", F.struct(id_col, "e")), "_k", "id").select("id", id_col, "e"))
    where, placed = cells.build(listed.select("id", "e"), most_cells=most_cells, block_rows=block_rows)
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    asked = cells.place(where, rows.select(F.col("_row").alias("id"), vectors(df, emb_col).alias("e")).filter("e IS NOT NULL"))

    def compare(ask, have, plan):
        q, cost, t = cells.nearest(ask, have, plan)
        yield pa.RecordBatch.from_arrays([pa.array(ask["id"][q]), pa.array(cost), pa.array(t)], names=["q", "cost", "t"])

    schema = "q bigint, cost double, t bigint"
    best = lambda found: found.groupBy("q").agg(F.min(F.struct("cost", "t")).alias("x"))
    home = cut_lineage(best(cells.meet(asked.withColumn("reach", F.lit(float("inf"))), placed, where, compare, schema, True, block_rows, whole=True)))
    bounded = cut_lineage(asked.join(home.select(F.col("q").alias("id"), F.sqrt("x.cost").alias("reach")), "id", "left").withColumn(
        "reach", F.coalesce("reach", F.lit(float("inf")))))
    found = best(cells.meet(bounded, placed, where, compare, schema, False, block_rows, whole=True)).select(F.col("q").alias("_row"), F.col("x.t").alias("id"))
    named = found.join(listed.select("id", F.col(id_col).alias(out)), "id").select("_row", out)
    return rows.join(named, "_row", "left").drop("_row")


def embed(df: DataFrame, text_col: str = "plain_text", out: str = "embedding", dim: int = 64,
          encoder: Callable | None = None, batch_size: int = 32) -> DataFrame:
    """Text -> unit vector.

    Default: Spark ML hashing of word tokens + L2 normalisation (no model download, runs in the
    JVM).  An ``encoder(list[str]) -> 2-D array`` runs per Arrow batch through ``mapInPandas``:
    the model is built once per Python worker and sees ``batch_size`` texts per call.
    """
    if encoder is None:
        from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array

        tok = RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True)
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
        nrm = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
        src = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
        res = nrm.transform(tf.transform(tok.transform(src)))
        return (res.withColumn(out, vector_to_array("_nv", "float32")).drop("_tok", "_tf", "_nv"))

    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

    def run(batches):
        import numpy as np

        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            vecs = []
            for i in range(0, len(texts), batch_size):
                v = np.asarray(encoder(texts[i:i + batch_size]), dtype="float32")
                n = np.linalg.norm(v, axis=1, keepdims=True)
                vecs.extend(list(v / np.where(n == 0, 1, n)))
            pdf[out] = vecs
            yield pdf

    return df.mapInPandas(run, schema)
