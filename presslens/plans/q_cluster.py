"""Registered queries: clustering M01-M10 and the cluster summary A42."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presslens.operators import clustering as M
from presslens.operators.aggregates import cluster_summary
from presslens.operators.elbow import elbow_one_scan
from presslens.operators.hierarchy import hierarchy_clusters
from presslens.operators.labelling import normalise_label
from presslens.operators.layout import neighbour_map
from presslens.operators.vectors import assign_nearest, cluster_centroids, representatives, similarity_to_centroid
from presslens.plans import sqlgen as S
from presslens.plans.q_vectors import CENTROID_SQL
from presslens.plans.registry import query
from presslens.sources.fixtures import view


@query("m01_kmeans", ["clustered"], """
SELECT orig_index, TRUE AS own_is_nearest, CAST(6 AS BIGINT) AS centres FROM clustered""")
def m01_kmeans(spark, sf):
    """Every row with its centre, checked: no other centre is nearer (k-means at rest on its centres)."""
    pred, centres = M.kmeans(view(spark, sf, "clustered").select("orig_index", "embedding"), 6, seed=42)
    near = assign_nearest(pred, centres, out="nearest")
    return near.select("orig_index", (F.col("nearest") == F.col("cluster")).alias("own_is_nearest"),
                       F.lit(centres.count()).cast("long").alias("centres"))


@query("m02_pca", ["clustered"], """
WITH pos AS (SELECT orig_index, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM clustered),
m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM pos GROUP BY i)
SELECT pos.orig_index, sum(pow(CAST(pos.x AS DOUBLE) - m.m, 2)) AS sq_length, TRUE AS top_below
FROM pos JOIN m ON pos.i = m.i GROUP BY pos.orig_index""", rounded=["sq_length"])
def m02_pca(spark, sf):
    """All components keep every row's distance to the mean; the first two cannot exceed it."""
    cl = view(spark, sf, "clustered").select("orig_index", "embedding")
    p = M.pca(cl, len(cl.first()["embedding"]))
    square = F.transform("pca", lambda x: x * x)
    total = F.aggregate(square, F.lit(0.0), lambda a, x: a + x)
    return p.select("orig_index", total.alias("sq_length"), (square[0] + square[1] <= total + 1e-9).alias("top_below"))


@query("m03_elbow_curve", ["embeddings"], """
WITH pos AS (SELECT unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
m AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM pos GROUP BY i),
t AS (SELECT sum(pow(CAST(pos.x AS DOUBLE) - m.m, 2)) AS total FROM pos JOIN m ON pos.i = m.i)
SELECT CAST(k AS INT) AS k, total AS inertia_of_one, TRUE AS not_above FROM t, range(1, 9) r(k)""",
       rounded=["inertia_of_one"])
def m03_elbow_curve(spark, sf):
    """The curve against its own start: k = 1 is the total variance, and no k lies above it."""
    curve = M.elbow_curve(view(spark, sf, "embeddings"), list(range(1, 9)), seed=42)
    one = curve.filter("k = 1").first()["inertia"]
    return curve.select("k", F.lit(one).alias("inertia_of_one"), (F.col("inertia") <= one + 1e-9).alias("not_above"))


SQDIST = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))"
ELBOW_KS, ELBOW_STEPS = (1, 2, 3, 5, 8, 12), 3
ELBOW_ORDER = "md5(concat_ws(':', CAST(vec_id AS VARCHAR), '42')), vec_id"


def elbow_sql() -> str:
    """Lloyd steps from the same starts, one CTE a step; a centre without rows stays."""
    parts = [f"""pts AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
        row_number() OVER (ORDER BY {ELBOW_ORDER}) - 1 AS c FROM embeddings WHERE embedding IS NOT NULL),
ks AS (SELECT unnest([{", ".join(map(str, ELBOW_KS))}]) AS k),
c0 AS (SELECT k, c, e FROM pts JOIN ks ON pts.c < ks.k)"""]
    for i in range(ELBOW_STEPS + 1):
        parts.append(f"""d{i} AS (SELECT a.id, b.k, b.c, {SQDIST} AS d FROM pts a, c{i} b),
a{i} AS (SELECT id, k, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM d{i} GROUP BY id, k)""")
        if i < ELBOW_STEPS:
            parts.append(f"""x{i} AS (SELECT a.k, a.c, unnest(p.e) AS x, unnest(range(0, len(p.e))) AS i FROM a{i} a JOIN pts p ON a.id = p.id),
m{i} AS (SELECT k, c, list(x ORDER BY i) AS e FROM (SELECT k, c, i, avg(x) AS x FROM x{i} GROUP BY k, c, i) GROUP BY k, c),
c{i + 1} AS (SELECT c.k, c.c, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k AND c.c = m.c)""")
    return "WITH " + ",\n".join(parts) + f"\nSELECT CAST(k AS INT) AS k, sum(d) AS inertia FROM a{ELBOW_STEPS} GROUP BY k"


@query("m03b_elbow_one_scan", ["embeddings"], elbow_sql(), rounded=["inertia"])
def m03b_elbow_one_scan(spark, sf):
    """The inertia of several k after the same number of steps from the same starts, by value."""
    curve = elbow_one_scan(view(spark, sf, "embeddings"), ELBOW_KS, key="vec_id", max_iter=ELBOW_STEPS, tol=0.0)
    return curve.select("k", "inertia")


@query("m04_elbow_pick", ["documents"], """
WITH curve AS (SELECT CAST(length(text) % 40 + 1 AS BIGINT) AS k, CAST(sum(n_chars) AS DOUBLE) AS inertia
               FROM documents WHERE n_chars > 0 GROUP BY 1),
ends AS (SELECT min(k) AS lo, max(k) AS hi, arg_min(ln(inertia), k) AS y_lo, arg_max(ln(inertia), k) AS y_hi FROM curve),
gap AS (SELECT k, abs(ln(inertia) - (y_lo + (k - lo) * ((y_hi - y_lo) / (hi - lo)))) AS g FROM curve, ends)
SELECT arg_max(k, struct_pack(a := g, b := -k)) AS best_k, max(g) AS max_gap FROM gap""", rounded=["max_gap"])
def m04_elbow_pick(spark, sf):
    """The pick on a curve that both sides can state (the characters of the texts by length class)."""
    curve = (view(spark, sf, "documents").filter("n_chars > 0")
             .groupBy((F.length("text") % 40 + 1).cast("long").alias("k"))
             .agg(F.sum("n_chars").cast("double").alias("inertia")))
    return M.elbow_pick(curve)


DENSITY_EPS, MIN_PTS, MIN_SIZE = 1.16, 8, 5
MAP_EPS = 0.02


def density_sql(points: str, eps: float, min_pts: int, min_size: int) -> str:
    """DBSCAN as recursive SQL; ``points`` gives (id, e).  The CTE ``dense`` has (id, cluster)."""
    return f"""
WITH RECURSIVE {points},
nb AS (SELECT a.id AS a, b.id AS b FROM pts a, pts b WHERE {SQDIST} <= {eps} * {eps}),
core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= {min_pts}),
ce AS (SELECT nb.a, nb.b FROM nb JOIN core x ON nb.a = x.id JOIN core y ON nb.b = y.id),
cc(n, label) AS (SELECT id, id FROM core UNION SELECT ce.b, cc.label FROM cc JOIN ce ON cc.n = ce.a),
comp AS (SELECT n AS id, min(label) AS label FROM cc GROUP BY n),
border AS (SELECT nb.a AS id, min(comp.label) AS label FROM nb JOIN comp ON nb.b = comp.id
           WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
lab AS (SELECT * FROM comp UNION ALL SELECT * FROM border),
sizes AS (SELECT label, count(*) AS s FROM lab GROUP BY label),
dense AS (SELECT p.id, CAST(coalesce(CASE WHEN sizes.s >= {min_size} THEN lab.label END, -1) AS BIGINT) AS cluster
          FROM pts p LEFT JOIN lab ON p.id = lab.id LEFT JOIN sizes ON lab.label = sizes.label)"""


@query("m06_density_clusters", ["clustered"],
       density_sql("pts AS (SELECT orig_index AS id, embedding AS e FROM clustered)", DENSITY_EPS, MIN_PTS, MIN_SIZE)
       + "\nSELECT id AS orig_index, cluster FROM dense")
def m06_density_clusters(spark, sf):
    return M.density_clusters(view(spark, sf, "clustered").select("orig_index", "embedding"), DENSITY_EPS,
                              min_pts=MIN_PTS, min_size=MIN_SIZE)


@query("m06b_density_map", ["clustered"],
       density_sql("pts AS (SELECT orig_index AS id, embedding[1:2] AS e FROM clustered)", MAP_EPS, MIN_PTS, MIN_SIZE)
       + "\nSELECT id AS orig_index, cluster FROM dense")
def m06b_density_map(spark, sf):
    """Density clusters on a 2-D map, as the study ran them after its reduction."""
    points = view(spark, sf, "clustered").select("orig_index", F.slice("embedding", 1, 2).alias("embedding"))
    return M.density_clusters(points, MAP_EPS, min_pts=MIN_PTS, min_size=MIN_SIZE)


@query("m06c_density_hierarchy", ["clustered"])
def m06c_density_hierarchy(spark, sf):
    """Density clusters of the map without a distance threshold (tested against the definition by brute force)."""
    points = view(spark, sf, "clustered").select("orig_index", F.slice("embedding", 1, 2).alias("embedding"))
    return hierarchy_clusters(points, min_pts=MIN_PTS, min_size=MIN_SIZE)


LABEL_POINTS = f"""norm AS (SELECT orig_index, embedding, lower({S.strip_sql("coalesce(title, 'nan')")}) AS raw_label FROM news_vec),
uniq AS (SELECT raw_label, count(*) AS freq, arg_min(embedding, orig_index) AS e, row_number() OVER (ORDER BY raw_label) - 1 AS id
         FROM norm WHERE raw_label NOT IN ('none', '') GROUP BY raw_label),
pts AS (SELECT id, e FROM uniq)"""


@query("m07_label_clusters", ["news_vec"], density_sql(LABEL_POINTS, DENSITY_EPS, 4, 4) + """,
reps AS (SELECT d.cluster, arg_min(u.raw_label, struct_pack(a := -u.freq, b := u.raw_label)) AS rep
         FROM dense d JOIN uniq u ON d.id = u.id WHERE d.cluster <> -1 GROUP BY d.cluster)
SELECT u.raw_label, d.cluster AS cluster_id, coalesce(reps.rep, 'other') AS cluster_label, u.freq
FROM uniq u JOIN dense d ON u.id = d.id LEFT JOIN reps ON d.cluster = reps.cluster""")
def m07_label_clusters(spark, sf):
    news = view(spark, sf, "news_vec")
    vectors = (news.withColumn("raw_label", normalise_label(F.col("title"))).groupBy("raw_label")
                   .agg(F.min_by("embedding", "orig_index").alias("embedding")))
    return M.label_clusters(news, "title", DENSITY_EPS, min_pts=4, min_size=4, pca_k=None, vectors=vectors)


def _with_texts(spark, sf):
    cl = view(spark, sf, "clustered")
    return cl.join(view(spark, sf, "news").select("orig_index", "plain_text"), "orig_index")


@query("m08_cluster_profile", ["clustered", "news"], f"""
WITH {CENTROID_SQL},
s AS (SELECT c.orig_index, c.cluster, n.plain_text, {S.dot_sql('c.embedding', 'cen.centroid')} AS sim
      FROM clustered c JOIN cen ON c.cluster = cen.cluster JOIN news n ON c.orig_index = n.orig_index),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, orig_index ASC) AS rank FROM s)
      WHERE rank <= 5)
SELECT cen.cluster, cen.size, list(r.plain_text ORDER BY r.rank) AS representatives,
       list(r.plain_text ORDER BY r.rank)[1] AS label_sentence
FROM cen LEFT JOIN r ON cen.cluster = r.cluster GROUP BY cen.cluster, cen.size""")
def m08_cluster_profile(spark, sf):
    return M.cluster_profile(_with_texts(spark, sf), k=5, text_col="plain_text")


@query("a42_cluster_summary", ["clustered"], f"""
WITH {CENTROID_SQL},
s AS (SELECT c.orig_index, c.cluster, {S.dot_sql('c.embedding', 'cen.centroid')} AS sim
      FROM clustered c JOIN cen ON c.cluster = cen.cluster),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, orig_index ASC) AS rank FROM s)
      WHERE rank <= 3)
SELECT cluster, (SELECT count(*) FROM clustered c WHERE c.cluster = r.cluster) AS size, list(CAST(orig_index AS VARCHAR) ORDER BY rank) AS representatives,
       list(CAST(orig_index AS VARCHAR) ORDER BY rank)[1] AS label_sentence
FROM r GROUP BY cluster""")
def a42_cluster_summary(spark, sf):
    cl = view(spark, sf, "clustered")
    reps = representatives(similarity_to_centroid(cl, cluster_centroids(cl)), 3)
    reps = reps.withColumn("text", F.col("orig_index").cast("string"))
    sizes = cl.filter(F.col("cluster") != -1).groupBy("cluster").agg(F.count("*").alias("size"))
    return cluster_summary(reps.select("cluster", "text", "rank"), sizes, "cluster", "text", "rank", 3)


@query("m09_two_level_topics", ["embeddings"], """
SELECT CAST(t AS INT) AS topic, CAST(r AS INT) AS rank, TRUE AS falling, TRUE AS known
FROM range(0, 7) a(t), range(1, 6) b(r)""")
def m09_two_level_topics(spark, sf):
    """Seven topics of five sentences each: ranks without gaps, similarities falling, sentences of the table."""
    e = view(spark, sf, "embeddings").select(F.concat(F.lit("label "), F.col("vec_id").cast("string")).alias("text"),
                                             "embedding")
    top = M.two_level_topics(e, k=7, top=5)
    before = F.lag("sim").over(Window.partitionBy("topic").orderBy("rank"))
    return top.join(e.select("text", F.lit(True).alias("known")), "text", "left").select(
        "topic", "rank", F.coalesce(before >= F.col("sim"), F.lit(True)).alias("falling"),
        F.coalesce("known", F.lit(False)).alias("known"))


@query("m10_plot_points", ["clustered"], """
WITH top AS (SELECT cluster FROM clustered WHERE cluster IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, cluster LIMIT 3)
SELECT orig_index, cluster, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
FROM clustered WHERE cluster IN (SELECT cluster FROM top)
ORDER BY md5(concat_ws(':', CAST(orig_index AS VARCHAR), '42')), orig_index LIMIT 100""", rounded=["x", "y"])
def m10_plot_points(spark, sf):
    return M.plot_points(view(spark, sf, "clustered"), 100, 3)


@query("m10b_neighbour_map", ["clustered"])
def m10b_neighbour_map(spark, sf):
    """The rows on a map that keeps neighbours (tested by recall and trustworthiness against brute force)."""
    return neighbour_map(view(spark, sf, "clustered").select("orig_index", "cluster", "embedding")).drop("embedding")
