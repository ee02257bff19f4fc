"""Registered queries: vector operators V01-V10, W06, O07, M05."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslens.functions import vectors as VF
from presslens.operators import vectors as V
from presslens.plans import sqlgen as S
from presslens.plans.registry import query
from presslens.sources.fixtures import view


def _vec(spark, sf):
    return view(spark, sf, "news_vec").select("orig_index", "embedding")


def _protos(spark, sf, name=None):
    p = view(spark, sf, "protos")
    return p.filter(F.col("name") == name) if name else p


COS = S.cosine_sql


@query("v01_cosine", ["clustered"], f"""
SELECT c.orig_index, {COS('c.embedding', 'e.embedding')} AS cosine
FROM clustered c JOIN embeddings e ON e.vec_id = (c.orig_index + 7) % (SELECT count(*) FROM embeddings)""", rounded=["cosine"])
def v01_cosine(spark, sf):
    c = view(spark, sf, "clustered").select("orig_index", "embedding")
    e = view(spark, sf, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("other"))
    j = c.join(e, F.col("vec_id") == F.pmod(F.col("orig_index") + 7, F.lit(e.count())))
    return j.select("orig_index", VF.cosine(F.col("embedding"), F.col("other")).alias("cosine"))


@query("v02_semantic_score", ["news_vec", "protos"], f"""
SELECT n.orig_index, avg({COS('n.embedding', 'p.embedding')}) AS ai_score
FROM news_vec n, protos p WHERE p.name = 'event_1' GROUP BY n.orig_index""", rounded=["ai_score"])
def v02_semantic_score(spark, sf):
    return V.semantic_score(_vec(spark, sf), _protos(spark, sf, "event_1")).select("orig_index", "ai_score")


@query("v03_contrastive_score", ["news_vec", "protos"], f"""
SELECT n.orig_index, avg({COS('n.embedding', 'p.embedding')} - {COS('n.embedding', 'q.embedding')}) AS ai_score
FROM news_vec n, protos p JOIN protos q ON p.phrase_no = q.phrase_no
WHERE p.name = 'event_1' AND q.name = 'event_4' GROUP BY n.orig_index""", rounded=["ai_score"])
def v03_contrastive_score(spark, sf):
    return V.contrastive_score(_vec(spark, sf), _protos(spark, sf, "event_1"), _protos(spark, sf, "event_4")) \
        .select("orig_index", "ai_score")


@query("v04_classify_by_prototype", ["news_vec", "protos"], f"""
WITH p AS (SELECT concat(name, '#', CAST(phrase_no AS VARCHAR)) AS name, embedding FROM protos)
SELECT orig_index, event_type FROM (
  SELECT n.orig_index, p.name AS event_type,
         row_number() OVER (PARTITION BY n.orig_index ORDER BY {COS('n.embedding', 'p.embedding')} DESC, p.name) AS rn
  FROM news_vec n, p) WHERE rn = 1""")
def v04_classify_by_prototype(spark, sf):
    p = view(spark, sf, "protos").withColumn("name", F.concat("name", F.lit("#"), F.col("phrase_no").cast("string")))
    return V.classify_by_prototype(_vec(spark, sf), p).select("orig_index", "event_type")


EVENTS = [f"event_{i}" for i in range(10)]
MULTI_SQL = f"""ms AS (SELECT n.orig_index, {', '.join(
    f"avg({COS('n.embedding', 'p.embedding')}) FILTER (WHERE p.name = '{e}') AS score_{e}" for e in EVENTS)}
FROM news_vec n, protos p GROUP BY n.orig_index)"""


@query("v05_multi_phrase_scores", ["news_vec", "protos"], f"WITH {MULTI_SQL} SELECT * FROM ms",
       rounded=[f"score_{e}" for e in EVENTS])
def v05_multi_phrase_scores(spark, sf):
    return V.multi_phrase_scores(_vec(spark, sf), _protos(spark, sf)).drop("embedding")


@query("v06_argmax_column", ["news_vec", "protos"], f"""
WITH {MULTI_SQL},
l AS (SELECT orig_index, unnest([{', '.join(f"'{e}'" for e in EVENTS)}]) AS name,
             unnest([{', '.join(f'score_{e}' for e in EVENTS)}]) AS s, unnest(range(0, {len(EVENTS)})) AS pos FROM ms)
SELECT orig_index, name AS event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY orig_index ORDER BY s DESC, pos) AS rn FROM l) WHERE rn = 1""")
def v06_argmax_column(spark, sf):
    return V.argmax_column(V.multi_phrase_scores(_vec(spark, sf), _protos(spark, sf))).select("orig_index", "event_type")


@query("v07_centroid_query_score", ["news_vec", "protos"], f"""
WITH u AS (SELECT phrase_no, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / {S.norm_sql('embedding')}) AS v
           FROM protos WHERE name = 'event_0'),
gram AS (SELECT sum({S.dot_sql('a.v', 'b.v')}) AS g FROM u a, u b)
SELECT n.orig_index, sum({S.dot_sql('n.embedding', 'u.v')}) / ({S.norm_sql('any_value(n.embedding)')} * sqrt(any_value(gram.g)))
       AS ai_score
FROM news_vec n, u, gram GROUP BY n.orig_index""", rounded=["ai_score"])
def v07_centroid_query_score(spark, sf):
    return V.centroid_query_score(_vec(spark, sf), _protos(spark, sf, "event_0")).select("orig_index", "ai_score")


@query("v08_normalise", ["embeddings"], f"""
SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / ({S.norm_sql('embedding')} + 1e-12)) AS embedding
FROM embeddings""", rounded_arrays=["embedding"])
def v08_normalise(spark, sf):
    return V.normalise(view(spark, sf, "embeddings").select("vec_id", "embedding"))


CENTROID_SQL = """pos AS (SELECT cluster, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i
                          FROM clustered WHERE cluster IS NOT NULL AND cluster <> -1),
m AS (SELECT cluster, i, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM pos GROUP BY 1, 2),
raw AS (SELECT cluster, list(m ORDER BY i) AS c, max(n) AS size FROM m GROUP BY 1),
cen AS (SELECT cluster, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS centroid,
               size FROM raw)"""


@query("v09_cluster_centroids", ["clustered"], f"WITH {CENTROID_SQL} SELECT cluster, centroid, size FROM cen",
       rounded_arrays=["centroid"])
def v09_cluster_centroids(spark, sf):
    return V.cluster_centroids(view(spark, sf, "clustered"))


def _sims(spark, sf):
    cl = view(spark, sf, "clustered")
    return V.similarity_to_centroid(cl, V.cluster_centroids(cl))


@query("v10_similarity_to_centroid", ["clustered"], f"""
WITH {CENTROID_SQL}
SELECT c.orig_index, c.cluster, {S.dot_sql('c.embedding', 'cen.centroid')} AS sim
FROM clustered c JOIN cen ON c.cluster = cen.cluster""", rounded=["sim"])
def v10_similarity_to_centroid(spark, sf):
    return _sims(spark, sf).select("orig_index", "cluster", "sim")


@query("w06_representatives", ["clustered"], f"""
WITH {CENTROID_SQL},
s AS (SELECT c.orig_index, c.cluster, {S.dot_sql('c.embedding', 'cen.centroid')} AS sim
      FROM clustered c JOIN cen ON c.cluster = cen.cluster)
SELECT orig_index, cluster, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, orig_index ASC) AS INT) AS rank FROM s)
WHERE rank <= 3""")
def w06_representatives(spark, sf):
    return V.representatives(_sims(spark, sf), k=3).select("orig_index", "cluster", "rank")


@query("o07_topic_top_sentences", ["embeddings"], f"""
WITH lab AS (SELECT label AS topic, concat('label ', CAST(vec_id AS VARCHAR)) AS text, embedding FROM embeddings),
pos AS (SELECT topic, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM lab),
m AS (SELECT topic, i, avg(CAST(x AS DOUBLE)) AS m FROM pos GROUP BY 1, 2),
cen AS (SELECT topic, list(m ORDER BY i) AS c FROM m GROUP BY 1),
d AS (SELECT cen.topic, lab.text, {S.dot_sql('lab.embedding', 'cen.c')} AS sim FROM lab, cen)
SELECT topic, text, sim, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY sim DESC, text ASC) AS INT) AS rank FROM d)
WHERE rank <= 5""", rounded=["sim"])
def o07_topic_top_sentences(spark, sf):
    lab = view(spark, sf, "embeddings").select(
        F.col("label").alias("topic"), F.concat(F.lit("label "), F.col("vec_id").cast("string")).alias("text"),
        "embedding")
    return V.topic_top_sentences(lab, k=5).select("topic", "text", "sim", "rank")


@query("m05_assign_nearest", ["clustered"], """
WITH pos AS (SELECT cluster, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i
             FROM clustered WHERE cluster <> -1),
m AS (SELECT cluster, i, avg(CAST(x AS DOUBLE)) AS m FROM pos GROUP BY 1, 2),
cen AS (SELECT cluster, list(m ORDER BY i) AS c FROM m GROUP BY 1),
d AS (SELECT k.orig_index, cen.cluster,
             list_sum(list_transform(list_zip(k.embedding, cen.c), lambda p: pow(CAST(p[1] AS DOUBLE) - p[2], 2))) AS dist
      FROM clustered k, cen)
SELECT orig_index, cluster AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY orig_index ORDER BY dist ASC, cluster ASC) AS rn FROM d) WHERE rn = 1""")
def m05_assign_nearest(spark, sf):
    cl = view(spark, sf, "clustered")
    cen = V.cluster_centroids(cl, renormalise=False)
    return V.assign_nearest(cl.select("orig_index", "embedding"), cen).select("orig_index", "prediction")


@query("m05b_nearest_in_table", ["clustered", "embeddings"], """
WITH d AS (SELECT k.orig_index, e.vec_id,
             list_sum(list_transform(list_zip(k.embedding, list_reverse(e.embedding)),
                                     lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) AS dist
           FROM clustered k, embeddings e)
SELECT orig_index, arg_min(vec_id, struct_pack(a := dist, b := vec_id)) AS prediction FROM d GROUP BY orig_index""")
def m05b_nearest_in_table(spark, sf):
    """Every row against the whole embedding table (read backwards, so that no row meets itself)."""
    table = view(spark, sf, "embeddings").select("vec_id", F.reverse("embedding").alias("centroid"))
    rows = view(spark, sf, "clustered").select("orig_index", "embedding")
    return V.nearest_in_table(rows, table, id_col="vec_id").select("orig_index", "prediction")


@query("v11_embed", ["news"], """
SELECT orig_index, 64 AS dims, CASE WHEN regexp_matches(lower(plain_text), '[\\p{L}\\p{N}_]') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS length
FROM news""", rounded=["length"], digits=5)
def v11_embed(spark, sf):
    """Size and length of every vector: 1, or 0 for a text without a token."""
    e = V.embed(view(spark, sf, "news").select("orig_index", "plain_text"), dim=64)
    return e.select("orig_index", F.size("embedding").alias("dims"), VF.norm(F.col("embedding")).alias("length"))


LETTERS = "aeinrst"


def letter_counts(texts):
    """An encoder that SQL can state: how often a few letters occur, and one."""
    return [[t.count(c) for c in LETTERS] + [1] for t in texts]


@query("v11b_embed_encoder", ["news"], f"""
WITH v AS (SELECT orig_index, [{', '.join(f"length(plain_text) - length(replace(plain_text, '{c}', ''))" for c in LETTERS)}, 1] AS c
           FROM news)
SELECT orig_index, list_transform(c, lambda x: x / {S.norm_sql('c')}) AS embedding FROM v""",
       rounded_arrays=["embedding"], digits=4)
def v11b_embed_encoder(spark, sf):
    news = view(spark, sf, "news").select("orig_index", "plain_text")
    return V.embed(news, encoder=letter_counts).select("orig_index", "embedding")
