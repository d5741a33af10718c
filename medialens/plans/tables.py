"""Tables, files and queues as passes leave them: each query writes what the given tables hold in the shared folder, as a pass would, and reads it back."""

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from medialens.functions.vectors import norm
from medialens.operators import clusters, hooks, results
from medialens.operators import taxonomy as tax
from medialens.operators.graph import shared_folder
from medialens.plans import surrogates as s
from medialens.plans.sql import IMG, SCENE
from medialens.sources import ground_truth as gt
from medialens.sources import scan, sinks, snapshot
from medialens.streaming import queues


def folder(spark):
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def stored(spark, sf):
    """Paths kept as JSON; each seventh is broken."""
    d = s.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.when(F.col("doc_id") % 7 == 0, F.lit("[broken")).otherwise(F.to_json(F.array(F.concat(F.lit("/a/"), "doc_id"), F.concat(F.lit("/b/"), "doc_id")))).alias("all_paths"))
    return scan.stored_paths(d)


def truth_lines(spark, sf):
    """Labels as lines of ground truth, with blank and broken ones between."""
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("image_id"), F.array(F.lit("scene.food")).alias("scene"), F.create_map(F.lit("attr.toxic"), F.col("toxic") == 1).alias("attributes"), F.array().cast("array<string>").alias("objects")))
    rows = s.table(spark, sf, "labels").filter("doc_id IS NOT NULL").select(F.explode(F.array(line, F.when(F.col("doc_id") % 5 == 0, F.lit("{broken")).otherwise(F.lit("")))).alias("value"))
    rows.write.text(path := folder(spark))
    return gt.read_ground_truth(spark, path).select("image_id", F.array_join("scene", ",").alias("scene"), F.col("attributes")["attr.toxic"].alias("toxic"))


def appended(spark, sf):
    """Two runs that add their results; the second takes only what the first has not written."""
    d = s.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), "lang")
    path = folder(spark)
    sinks.append_missing(d.filter("image_id % 3 = 0").withColumn("run", F.lit(1)), path)
    sinks.append_missing(d.withColumn("run", F.lit(2)), path)
    return spark.read.schema("image_id long, lang string, run int").json(path).groupBy("run", "lang").agg(F.count(F.lit(1)).alias("n"))


def result_log(spark, sf):
    """Results of two runs beside each other."""
    d = s.table(spark, sf, "documents").select("doc_id", "source")
    path = folder(spark)
    for run, rows in ((1, d), (2, d.filter("doc_id % 2 = 0"))):
        sinks.append_results(rows.withColumn("run", F.lit(run)), path, ["run"])
    return spark.read.parquet(path).groupBy("run", "source").agg(F.count(F.lit(1)).alias("n"))


def vectors(spark, sf):
    """Vectors written and read, as they are and with length 1."""
    path = folder(spark)
    sinks.write_vectors(s.table(spark, sf, "embeddings"), path, "vec_id")
    read = spark.read.parquet(path)
    raw, unit = clusters.raw_vectors(read, "vec_id", "embedding"), clusters.unit_vectors(read, "vec_id", "embedding")
    both = raw.select("id", F.size("v").alias("size"), F.round(norm(F.col("v")), 4).alias("length")).join(unit.select("id", F.round(norm(F.col("v")), 6).alias("unit_length")), "id")
    return both.withColumnRenamed("id", "vec_id")


def head_file(spark, sf):
    """A head written as Parquet, read with its checks."""
    s.prototypes(spark, sf).select("label_key", F.col("proto").alias("weights"), F.lit(0.5).alias("bias")).write.parquet(path := folder(spark))
    return sinks.read_head(spark, path).select("label_key", F.size("weights").alias("size"), "bias")


def refreshed(spark, sf):
    """A pass that replaces what it wrote before for its label space and source."""
    d = s.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "v1").otherwise("v2").alias("space"), F.when(F.col("doc_id") % 3 == 0, "people").otherwise("model").alias("source"), F.lit(1).alias("run"))
    new = d.filter("doc_id % 10 = 0").withColumns({"space": F.lit("v1"), "source": F.lit("model"), "run": F.lit(2)})
    return snapshot.refresh(d, new, ["space", "source"], [("v1", "model")]).groupBy("space", "source", "run").agg(F.count(F.lit(1)).alias("n"))


def purged(spark, sf):
    """Rows of images, and of their regions, that are gone."""
    r = s.regions(spark, sf).select(F.concat("image_id", F.lit("#"), "idx").alias("target_id"), "image_id", "score")
    gone = r.filter("image_id % 4 = 0").select("image_id").distinct()
    kept = snapshot.without_prefix(r.drop("image_id"), gone.filter("image_id % 8 = 0").withColumn("image_id", F.col("image_id").cast("string")), "target_id")
    left = snapshot.without(kept.withColumn("image_id", F.substring_index("target_id", "#", 1).cast("long")), gone.filter("image_id % 8 <> 0"), ["image_id"])
    return left.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))


def unprocessed(spark, sf):
    d = s.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), "lang")
    return gt.unprocessed(d, s.table(spark, sf, "labels").select(F.col("doc_id").alias("image_id")))


def snapshots(spark, sf):
    """A table that is created, upserted twice, and copied."""
    one, two = (folder(spark) for _ in range(2))
    table = snapshot.create_empty(spark, one, "c_custkey long, c_acctbal double, created int")
    rows = s.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    table.upsert(rows.withColumn("created", F.lit(1)), ["c_custkey"], ["created"])
    table.upsert(rows.filter("c_custkey % 3 = 0").withColumns({"c_acctbal": F.lit(0.5), "created": F.lit(2)}), ["c_custkey"], ["created"])
    copy = snapshot.SnapshotTable(spark, two)
    snapshot.copy_table(table, copy)
    return copy.read()


def vocabulary(spark, sf):
    """Labels and aliases from parts, merged with those of a second run."""
    p = s.table(spark, sf, "part")
    label = lambda rows, shown: rows.select(F.concat(F.lit("object.p"), "p_size").alias("label_key"), F.lit("object").alias("level"), shown.alias("display_name"), F.lit(None).cast("string").alias("parent_key")).dropDuplicates(["label_key"])
    old = label(p.filter("p_size <= 30"), F.lit("old"))
    merged = tax.merge_labels(old, label(p.filter("p_size > 20"), F.lit("new")))
    return merged.select("label_key", "level", "display_name")


def named_assignments(spark, sf):
    """Assignments with the names of their labels, of images that also have a vector and a document; the rest leaves."""
    sc = s.scenes(spark, sf)
    labels = sc.select("label_key").distinct().filter("label_key <> 'scene.other'").withColumn("display_name", F.upper("label_key"))
    known = s.images(spark, sf).select("image_id").intersect(s.table(spark, sf, "documents").select(F.format_string("%016x", "doc_id").alias("image_id")))
    return sc.join(labels, "label_key").join(known, "image_id").select("image_id", "display_name", "score")


def modelled(spark, sf):
    """A model over rows of which some fail: artifact rows and counts of what was done."""
    d = s.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("n_chars")).alias("n"))
    made = hooks.apply_model(d, "image_id", "n", dict, lambda model, n: {True: str(int(n)), False: None}[n % 4 != 0] or model["no such key"], "string", "parity")
    return hooks.artifact_rows(made, "caption", "m:1").groupBy("status", F.substring_index("error_message", ":", 1).alias("error")).agg(F.count(F.lit(1)).alias("n"))


def progress(spark, sf):
    """Counters of a pass, gathered while it writes."""
    seen = Observation("pass")
    rows = s.table(spark, sf, "lineitem").observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("l_quantity") > 25).alias("large"))
    rows.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q")).write.parquet(folder(spark))
    return spark.createDataFrame([(seen.get["rows"], seen.get["large"])], "rows long, large long")


def queued(spark, sf):
    """Images put into a queue, routed by task to handlers that write and pass on."""
    at = folder(spark)
    images = s.images(spark, sf).select("image_id")
    queues.enqueue(images, f"{at}/in")

    def first(rows, number):
        rows.withColumn("task", F.lit("pre_process")).write.mode("overwrite").parquet(f"{at}/out/batch={number}")
        queues.enqueue(rows.filter(F.col("image_id").endswith("0")), f"{at}/next", "process")

    queues.run_queues(spark, f"{at}/in", {"pre_process": first}, f"{at}/one").awaitTermination()
    queues.run_queues(spark, f"{at}/next", {"process": lambda rows, number: rows.withColumn("task", F.lit("process")).write.mode("overwrite").parquet(f"{at}/out/batch={1000 + number}")}, f"{at}/two").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("image_id", "task")


def cleared(spark, sf):
    """Tables of two stages, of which one is cleared."""
    root = folder(spark)
    for table in ("scenes", "captions", "embeddings"):
        s.table(spark, sf, "embeddings").select("vec_id", F.lit(table).alias("name")).write.parquet(f"{root}/{table}")
    gone = sinks.clear_stages(spark, root, ["embeddings_and_captions"])
    return spark.read.option("recursiveFileLookup", "true").parquet(root).groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn("gone", F.lit(",".join(sorted(gone))))


def exported(spark, sf):
    return results.current_artifacts(*_artifacts(spark, sf), "thumbnail_small", "pil:1").groupBy(F.length("storage_path").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def _artifacts(spark, sf):
    i, n = s.images(spark, sf), F.col("vec_id")
    made = i.select("image_id", F.lit("thumbnail_small").alias("artifact_type"), F.lit("pil:1").alias("version_key"), F.when(n % 3 == 0, "error").otherwise("complete").alias("status"), F.concat(F.lit("/t/"), n).alias("storage_path"))
    return made, i.select("image_id", F.when(n % 5 == 0, "deleted").otherwise("active").alias("status"))


QUERIES = {
    "stored_paths": (stored, "SELECT doc_id AS image_id, '/' || k || '/' || doc_id AS path FROM documents, (VALUES ('a'), ('b')) t(k) WHERE doc_id % 7 <> 0"),
    "ground_truth_lines": (truth_lines, "SELECT CAST(doc_id AS VARCHAR) AS image_id, 'scene.food' AS scene, toxic = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL"),
    "resumed_appends": (appended, "SELECT CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS run, lang, count(*) AS n FROM documents GROUP BY ALL"),
    "result_log": (result_log, "SELECT run, source, count(*) AS n FROM documents, (VALUES (1), (2)) t(run) WHERE run = 1 OR doc_id % 2 = 0 GROUP BY ALL"),
    "vectors_written": (vectors, "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, CAST(len(v) AS INTEGER) AS size, round(sqrt(list_inner_product(v, v)), 4) AS length, CAST(1 AS DOUBLE) AS unit_length FROM e WHERE list_inner_product(v, v) > 0"),
    "head_file": (head_file, "SELECT DISTINCT 'object.k' || label AS label_key, 64 AS size, 0.5::DOUBLE AS bias FROM embeddings"),
    "pass_refresh": (refreshed, "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS space, CASE WHEN doc_id % 3 = 0 THEN 'people' ELSE 'model' END AS source, 1 AS run FROM documents) SELECT space, source, run, count(*) AS n FROM (SELECT space, source, run FROM d WHERE NOT (space = 'v1' AND source = 'model') UNION ALL SELECT 'v1', 'model', 2 FROM d WHERE doc_id % 10 = 0) GROUP BY ALL"),
    "purged_rows": (purged, "SELECT l_orderkey AS image_id, count(*) AS n FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1"),
    "unprocessed_rows": (unprocessed, "SELECT doc_id AS image_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"),
    "snapshot_copies": (snapshots, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE c_acctbal END AS c_acctbal, 1 AS created FROM customer"),
    "label_vocabulary": (vocabulary, "SELECT DISTINCT 'object.p' || p_size AS label_key, 'object' AS level, CASE WHEN p_size > 20 THEN 'new' ELSE 'old' END AS display_name FROM part"),
    "named_assignments": (named_assignments, f"WITH {IMG}, {SCENE} SELECT image_id, upper(label_key) AS display_name, score FROM sc WHERE label_key <> 'scene.other' AND image_id IN (SELECT format('{{:016x}}', doc_id) FROM documents)"),
    "model_rows": (modelled, "SELECT CASE WHEN doc_id % 9 = 0 OR n_chars % 4 = 0 THEN 'error' ELSE 'complete' END AS status, CASE WHEN doc_id % 9 = 0 THEN 'ValueError' WHEN n_chars % 4 = 0 THEN 'KeyError' END AS error, count(*) AS n FROM documents GROUP BY ALL"),
    "pass_counters": (progress, "SELECT count(*) AS rows, count(*) FILTER (l_quantity > 25) AS large FROM lineitem"),
    "queue_tasks": (queued, f"WITH {IMG} SELECT image_id, 'pre_process' AS task FROM img UNION ALL SELECT image_id, 'process' FROM img WHERE image_id LIKE '%0'"),
    "stage_clearing": (cleared, "SELECT 'scenes' AS name, count(*) AS n, 'captions,embeddings' AS gone FROM embeddings"),
    "complete_thumbnails": (exported, "SELECT CAST(length('/t/' || vec_id) AS INTEGER) AS length, count(*) AS n FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 5 <> 0 GROUP BY 1"),
}
