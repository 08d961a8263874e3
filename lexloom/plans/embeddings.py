"""Embedding analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.operators import vectors as V
from lexloom.plans.registry import query, table
from lexloom.session import cut

UNIT = """u AS (SELECT vec_id, label, [x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) for x in embedding] AS v FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u) GROUP BY 1, 2),
c0 AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1), c AS (SELECT label, [x / sqrt(list_dot_product(v, v)) for x in v] AS v FROM c0)"""
# equal vectors are one class, paired by its least id, with a row for each other member
PAIRS = """cl AS (SELECT min(vec_id) AS vec_id, v FROM u GROUP BY v), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS cosine FROM cl a JOIN cl b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4
UNION ALL SELECT cl.vec_id, u.vec_id, 1.0 FROM u JOIN cl ON u.v = cl.v AND u.vec_id <> cl.vec_id)"""


def vectors(spark, sf):
    return table(spark, sf, "embeddings")


@query(f"WITH {UNIT} SELECT label, i - 1 AS channel, round(x, 6) AS value FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM c)")
def centroids(spark, sf):
    c = V.centroids(vectors(spark, sf), "label", "embedding").select("label", F.posexplode("centroid").alias("channel", "x"))
    return c.select("label", F.col("channel").cast("long").alias("channel"), F.round("x", 6).alias("value"))


@query(f"WITH {UNIT}, r AS (SELECT a.label, b.label AS nearest, list_dot_product(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.label ORDER BY list_dot_product(a.v, b.v) DESC, b.label) AS k FROM c a JOIN c b ON a.label < 5 AND b.label >= 5) SELECT label, nearest, round(s, 6) AS cosine FROM r WHERE k = 1")
def nearest_train(spark, sf):
    """Each held-out label's nearest training label."""
    c = V.centroids(vectors(spark, sf), "label", "embedding")
    return V.nearest(c.filter("label < 5"), c.filter("label >= 5"), "label", "centroid").withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {UNIT} SELECT DISTINCT a.label FROM c a JOIN c b ON a.label < 5 AND b.label >= 5 WHERE list_dot_product(a.v, b.v) >= 0.2")
def leakage_labels(spark, sf):
    return nearest_train(spark, sf).filter("cosine >= 0.2").select("label")


@query(f"WITH {UNIT}, {PAIRS} SELECT a, b, round(cosine, 6) AS cosine FROM p")
def similarity_pairs(spark, sf):
    return V.similar_pairs(vectors(spark, sf), "vec_id", "embedding", 0.4).withColumn("cosine", F.round("cosine", 6))


@query(f"""WITH RECURSIVE {UNIT}, {PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(node, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT node, min(reach) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    v = vectors(spark, sf)
    return V.components(V.similar_pairs(v, "vec_id", "embedding", 0.4).select("a", "b"), v.select("vec_id"))


@query(f"""WITH {UNIT}, t AS (SELECT label, i, sum(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM u) GROUP BY 1, 2), tt AS (SELECT label, list(x ORDER BY i) AS t FROM t GROUP BY 1),
r AS (SELECT vec_id, u.label, v, list_transform(list_zip(t, v), lambda z: z[1] - z[2]) AS rest FROM u JOIN tt USING (label))
SELECT vec_id, label, round(list_dot_product(rest, v) / sqrt(list_dot_product(rest, rest)), 6) AS cosine FROM r""")
def loo_outliers(spark, sf):
    return V.leave_one_out(vectors(spark, sf), "vec_id", "label", "embedding").withColumn("cosine", F.round("cosine", 6))


@query()
def average_linkage(spark, sf):
    """Average linkage of cosines down to 0.4, components of the similarity graph of any size."""
    return V.average_clusters(vectors(spark, sf), "vec_id", "embedding", 0.4)


@query(f"WITH {UNIT} SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS dense_id, count(*) AS n FROM u GROUP BY 1")
def cluster_ids(spark, sf):
    g = vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return g.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).cast("long").alias("dense_id"), "n")


@query(f"""WITH RECURSIVE {UNIT}, cs AS (SELECT label, CASE WHEN label % 3 = 0 THEN 'train' WHEN label % 3 = 1 THEN 'val' ELSE 'test' END AS split, v FROM c), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
e AS (SELECT a.label AS x, b.label AS y FROM cs a JOIN cs b ON a.label <> b.label AND list_dot_product(a.v, b.v) >= 0.1), r(label, reach) AS (SELECT label, label FROM cs UNION SELECT r.label, e.y FROM r JOIN e ON e.x = r.reach),
g AS (SELECT label, min(reach) AS cluster FROM r GROUP BY 1), l AS (SELECT DISTINCT a.label FROM cs a JOIN cs b ON a.split <> 'train' AND b.split = 'train' WHERE list_dot_product(a.v, b.v) >= 0.1),
mp AS (SELECT cluster, CASE WHEN max((split = 'train')::INT) = 1 THEN 'train' WHEN sum(CASE WHEN split = 'test' THEN n ELSE 0 END) >= sum(CASE WHEN split = 'val' THEN n ELSE 0 END) THEN 'test' ELSE 'val' END AS mapped FROM cs JOIN g USING (label) JOIN n USING (label) GROUP BY 1)
SELECT label, cluster, l.label IS NOT NULL AS leaks, mapped FROM g JOIN mp USING (cluster) LEFT JOIN l USING (label)""")
def speaker_clusters(spark, sf):
    """Labels whose centroids are alike as one voice: its cluster, whether a held-out label leaks into train, and the split that keeps voices whole."""
    v = vectors(spark, sf)
    split = F.when(F.col("label") % 3 == 0, "train").when(F.col("label") % 3 == 1, "val").otherwise("test")
    c = V.centroids(v, "label", "embedding").withColumn("split", split).join(v.groupBy("label").agg(F.count("*").alias("n")), "label")
    c = cut(c)
    near = V.components(V.similar_pairs(c, "label", "centroid", 0.1).select("a", "b"), c.select("label")).select(F.col("node").cast("int").alias("label"), F.col("component").cast("int").alias("cluster"))
    leaks = V.nearest(c.filter("split <> 'train'"), c.filter("split = 'train'"), "label", "centroid").filter("cosine >= 0.1").select("label", F.lit(True).alias("leaks"))
    rows = c.drop("centroid").join(near, "label")
    test, val = (F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)) for s in ("test", "val"))
    mapped = F.when(F.max((F.col("split") == "train").cast("int")) == 1, "train").when(test >= val, "test").otherwise("val")
    return rows.join(rows.groupBy("cluster").agg(mapped.alias("mapped")), "cluster").join(leaks, "label", "left").select("label", "cluster", F.coalesce("leaks", F.lit(False)).alias("leaks"), "mapped")
