"""Search by words, by vectors, and by both."""

import uuid

from pyspark.sql import functions as F

from medialens.operators import search as q
from medialens.operators.graph import shared_folder
from medialens.operators.text_index import TextIndex
from medialens.plans import surrogates as s
from medialens.plans.sql import IMG

TERMS = ["license", "the", "stupid"]


def words(spark, sf):
    out = q.bm25(s.table(spark, sf, "documents"), "doc_id", "text", TERMS)
    return out.select("doc_id", F.round("score", 6).alias("score"))


def by_vector(spark, sf):
    rows = s.images(spark, sf)
    return q.similar(rows, "image_id", rows.filter("vec_id = 7")).select("image_id", F.round("score", 6).alias("score"))


def hybrid(spark, sf):
    """Documents by words and, for those with a vector of their id, by likeness to vector 7; ranks are fused."""
    rows = s.images(spark, sf).select(F.col("vec_id").alias("doc_id"), "v")
    near = q.similar(rows, "doc_id", rows.filter("doc_id = 7"))
    text = q.bm25(s.table(spark, sf, "documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 9))
    out = q.fused({"words": text, "vectors": near.withColumn("score", F.round("score", 9))}, "doc_id")
    return out.select("doc_id", F.round("score", 9).alias("score"), F.array_join("sources", "+").alias("sources"))


def text_index(spark, sf):
    """An index of all documents, in two batches."""
    docs = s.table(spark, sf, "documents")
    index = TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}")
    even = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    index.add(docs.filter(even), "doc_id", "text")
    index.add(docs, "doc_id", "text")
    return index


def indexed(spark, sf):
    """The best 20 documents for the search words, from the index."""
    return text_index(spark, sf).search(TERMS, 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def index_size(spark, sf):
    """How often the search words stand in the index."""
    rows = q.inverted_index(s.table(spark, sf, "documents"), "doc_id", "text").filter(F.col("term").isin(TERMS))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("n"))


BM = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, len(w) AS length, w FROM w), st AS (SELECT count(*) AS n, avg(length) AS a FROM l),
h AS (SELECT doc_id, length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM l, (VALUES ('license'), ('the'), ('stupid')) t(term)), f AS (SELECT * FROM h WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / a))) AS score FROM f JOIN df USING (term), st GROUP BY doc_id)"""
QUERIES = {
    "bm25_search": (words, f"WITH {BM} SELECT doc_id, round(score, 6) AS score FROM bm"),
    "bm25_indexed": (indexed, f"WITH {BM} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(bm.score, 9) DESC, doc_id LIMIT 20"),
    "inverted_index": (index_size, f"WITH {BM} SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY term"),
    "similar_images": (by_vector, f"WITH {IMG}, q AS (SELECT v AS qv FROM img WHERE vec_id = 7) SELECT image_id, round(list_inner_product(v, qv) / sqrt(list_inner_product(v, v) * list_inner_product(qv, qv)), 6) AS score FROM img, q"),
    "hybrid_search_rrf": (
        hybrid,
        f"WITH {BM}, {IMG}, q AS (SELECT v AS qv FROM img WHERE vec_id = 7), vs AS (SELECT vec_id AS doc_id, round(list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv))), 9) AS score FROM img, q), "
        "r AS (SELECT doc_id, 'vectors' AS s, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM vs UNION ALL SELECT doc_id, 'words', row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) FROM bm) SELECT doc_id, round(sum(1.0 / (60 + k)), 9) AS score, string_agg(s, '+' ORDER BY s) AS sources FROM r WHERE k <= 100 GROUP BY doc_id",
    ),
}
