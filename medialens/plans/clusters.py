"""Nearest-neighbour graph and similarity clusters."""

from pyspark.sql import functions as F

from medialens.operators import clusters as c
from medialens.operators import vector_index
from medialens.operators.graph import connected_components
from medialens.plans import surrogates as s
from medialens.plans.sql import CLUSTER, KNN


def units(spark, sf):
    return c.unit_vectors(s.images(spark, sf), "image_id", "v")


def edges(spark, sf):
    return c.knn_edges(units(spark, sf), s.NEIGHBOURS, s.COSINE)


def indexed(spark, sf):
    """Through an index that looks into every list which can hold a neighbour."""
    return c.symmetric(vector_index.knn_edges(units(spark, sf), s.NEIGHBOURS, s.COSINE, recall=1.0))


def probed(spark, sf):
    """Through an index that looks into as many lists as nine neighbours of ten take, by a sample, and some more."""
    return vector_index.knn_edges(units(spark, sf), s.NEIGHBOURS, s.COSINE, recall=0.97).select("src", "dst", F.round("similarity", 6).alias("similarity"))


def members(spark, sf):
    return c.clusters(units(spark, sf), edges(spark, sf), s.MIN_CLUSTER)


def centers(spark, sf):
    out = c.cluster_centers(members(spark, sf), units(spark, sf))
    return out.withColumn("distance", F.round("distance", 6))


def consistency(spark, sf):
    """Of each cluster, how many classes its members have and the share of the most frequent one."""
    rows = members(spark, sf).join(s.images(spark, sf).select(F.col("image_id").alias("id"), "label"), "id").groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_labels"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


QUERIES = {
    "knn_edges": (lambda spark, sf: c.symmetric(edges(spark, sf)), f"WITH {KNN} SELECT src, dst FROM knn UNION SELECT dst, src FROM knn"),
    "knn_edges_blocked": (lambda spark, sf: c.symmetric(c.knn_edges(units(spark, sf), s.NEIGHBOURS, s.COSINE, block=200)), f"WITH {KNN} SELECT src, dst FROM knn UNION SELECT dst, src FROM knn"),
    "knn_edges_indexed": (indexed, f"WITH {KNN} SELECT src, dst FROM knn UNION SELECT dst, src FROM knn"),
    "knn_edges_probed": (probed, None),
    "connected_components": (lambda spark, sf: connected_components(edges(spark, sf), "src", "dst"), f"WITH RECURSIVE {CLUSTER} SELECT node, cluster_id AS component FROM comp"),
    "connected_components_stars": (lambda spark, sf: connected_components(edges(spark, sf), "src", "dst", small=0), f"WITH RECURSIVE {CLUSTER} SELECT node, cluster_id AS component FROM comp"),
    "knn_clusters": (members, f"WITH RECURSIVE {CLUSTER} SELECT * FROM clu"),
    "cluster_centers": (
        centers,
        f"WITH RECURSIVE {CLUSTER}, m AS (SELECT cluster_id, id, u FROM clu JOIN unit ON image_id = id), s AS (SELECT a.cluster_id, a.id, round(sum(list_inner_product(a.u, b.u)), 9) AS total FROM m a JOIN m b USING (cluster_id) GROUP BY ALL), "
        "k AS (SELECT cluster_id, id AS center FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, id) AS n FROM s) WHERE n = 1) SELECT m.cluster_id, m.id, m.id = center AS is_center, round(greatest(0.0, 1 - list_inner_product(m.u, c.u)), 6) AS distance FROM m JOIN k USING (cluster_id) JOIN m c ON c.id = center",
    ),
    "duplicate_consistency": (consistency, f"WITH RECURSIVE {CLUSTER}, n AS (SELECT cluster_id, label, count(*) AS n FROM clu JOIN img ON image_id = id GROUP BY ALL) SELECT cluster_id, count(*) AS n_labels, round(max(n) / sum(n), 6) AS purity FROM n GROUP BY cluster_id"),
}
