"""Ingest, artifacts, upserts, dates and places."""

import uuid
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from medialens.functions import hashing, text
from medialens.operators import ingest as ing
from medialens.operators.graph import closure, shared_folder
from medialens.plans import surrogates as s
from medialens.plans.sql import IMG
from medialens.sources.snapshot import insert_missing, upsert
from medialens.streaming import retries
from medialens.streaming.arrivals import windowed_counts


def scans(spark, sf):
    """Two scans of the documents: in the second some paths are gone and some hold other content."""
    d = s.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), F.length("text").cast("bigint").alias("size_bytes"), (F.col("doc_id") % 50).cast("double").alias("mtime"), F.format_string("/p/%08d", "doc_id").alias("path"))
    one = d.filter("doc_id % 7 <> 3").select("path", F.col("h").alias("image_id"), "size_bytes", "mtime")
    two = d.filter("doc_id % 5 <> 2").select("path", F.when(F.col("doc_id") % 11 == 0, F.md5(F.concat("h", F.lit("x")))).otherwise(F.col("h")).alias("image_id"), "size_bytes", "mtime")
    return one, two


def failing(image, payload, attempt):
    """Each third message fails once, each sixth always."""
    n = int(payload)
    return "busy" if n % 3 == 0 and (n % 6 == 0 or attempt == 1) else None


def retried(spark, sf):
    """Events as messages in two slices with duplicates, read by a query that is started anew for each; later heartbeats let the last tries come due."""
    folder = f"{shared_folder(spark)}/retries-{uuid.uuid4().hex}"
    e = s.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("message_id"), F.concat(F.lit("u"), "user_id").alias("image_id"), F.col("ts").alias("sent_at"), F.col("event_id").cast("string").alias("payload"))
    early = F.col("sent_at") < F.lit("2024-01-16").cast("timestamp")
    beats = [spark.createDataFrame([(f"beat{d}", "beat", datetime(2024, 3, d), "1")], retries.MESSAGE) for d in (1, 2, 3)]
    for part in (e.filter(early).unionByName(e.filter(early & F.col("message_id").endswith("0"))), e.filter(~early), *beats):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(retries.MESSAGE).parquet(f"{folder}/in")
        retries.run(stream, failing, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return retries.read_outcomes(spark, f"{folder}/out").filter("image_id <> 'beat'").select("message_id", "image_id", "attempts", "outcome", "error")


def moved(spark, sf):
    one, two = scans(spark, sf)
    empty = spark.createDataFrame([], "image_id string, primary_path string, all_paths array<string>, size_bytes long, mtime double, status string, dirty boolean")
    first = ing.merge_scan(empty, one).withColumn("dirty", F.lit(False))
    return ing.merge_scan(first, two).select("image_id", "primary_path", F.array_join("all_paths", ",").alias("paths"), "status", "dirty")


def queued(spark, sf):
    one, two = scans(spark, sf)
    empty = spark.createDataFrame([], "image_id string, primary_path string, all_paths array<string>, size_bytes long, mtime double, status string, dirty boolean")
    first = ing.merge_queued(empty, one)
    return ing.merge_queued(first, two).select("image_id", "primary_path", F.array_join("all_paths", ",").alias("paths"), "status", "dirty")


def gps(spark, sf):
    n = F.col("vec_id")
    images = s.images(spark, sf).select("image_id", F.when(n % 3 == 0, n / 100.0).alias("gps_latitude"), F.when(n % 4 == 0, n / 50.0).alias("gps_longitude"))
    payload = F.when(n % 5 == 0, "not json").when(n % 5 == 1, F.format_string('{"gps": {"latitude": "%s", "longitude": 7.5}}', n)).when(n % 5 == 2, '{"camera": 1}').otherwise(F.format_string('{"gps": {"latitude": %s, "longitude": -1.25}}', n))
    return ing.with_gps(images, s.images(spark, sf).filter("vec_id % 7 > 0").select("image_id", payload.alias("payload")))


def embedding_sizes(spark, sf):
    metas = F.array(*[F.lit(x) for x in ('{"embedding_dim": 12}', '{"embedding_dim": 9.7}', '{"embedding_dim": "7"}', '{"embedding_dim": "7.5"}', "{}", "broken")])
    return s.table(spark, sf, "embeddings").select("vec_id", ing.embedding_size(F.get(metas, (F.col("vec_id") % 6).cast("int")), F.col("embedding")).alias("size"))


def captions(spark, sf):
    return s.table(spark, sf, "documents").select("doc_id", text.stripped(F.concat(F.lit("\n \t"), "text", F.lit(" \r\n"))).alias("caption"))


def data_urls(spark, sf):
    endings = F.array(*[F.lit(x) for x in (".png", ".TIF", ".jpg", ".webp", "")])
    p = s.table(spark, sf, "part")
    path = F.concat(F.lit("/root/a/"), "p_partkey", F.get(endings, (F.col("p_partkey") % 5).cast("int")))
    return p.select("p_partkey", text.relative_to(path, "/root").alias("path"), text.data_url(path, F.col("p_name").cast("binary")).alias("url"))


def keyed_upsert(spark, sf):
    o = s.table(spark, sf, "orders").dropDuplicates(["o_orderkey"]).select("o_orderkey", F.col("o_orderkey").cast("double").alias("score"), F.lit(1).alias("created"))
    old, new = o.filter("o_orderkey % 3 <> 0"), o.filter("o_orderkey % 2 = 0").withColumns({"score": F.col("score") + 1, "created": F.lit(2)})
    return upsert(old, new, ["o_orderkey"], ["created"])


def insert_once(spark, sf):
    o = s.table(spark, sf, "orders").select("o_custkey").dropDuplicates()
    old = o.filter("o_custkey % 3 = 0").withColumn("run", F.lit(1))
    return insert_missing(old, o.withColumn("run", F.lit(2)), ["o_custkey"])


def memo(spark, sf):
    d = s.table(spark, sf, "documents")
    wanted = d.select(F.col("doc_id").alias("image_id"), F.explode(F.array(F.lit("embedding"), F.lit("caption"))).alias("artifact_type"), hashing.version_key(F.when(F.col("doc_id") % 2 == 0, "m1"), hashing.params_hash(F.concat(F.lit('{"lang":"'), "lang", F.lit('"}')))).alias("version_key"))
    done = wanted.filter("image_id % 3 = 0").withColumn("status", F.when(F.col("image_id") % 9 == 0, "error").otherwise("complete"))
    return ing.missing_artifacts(wanted, done)


def lineage(spark, sf):
    """Edges regions -> hash and embedding -> hash, caption -> embedding, and all that an artifact depends on."""
    d = s.table(spark, sf, "documents").select("doc_id")
    edges = d.select(F.explode(F.array(*[F.struct(F.concat_ws("/", "doc_id", F.lit(a)).alias("artifact"), F.concat_ws("/", "doc_id", F.lit(b)).alias("needs")) for a, b in (("embedding", "hash"), ("caption", "embedding"), ("regions", "hash"), ("regions", "phash"))])).alias("e"))
    return closure(edges.select("e.*"), "artifact", "needs").filter("depth >= 1")


def exif(spark, sf):
    e = s.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 5 == 0, "unknown").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    return e.select("event_id", text.exif_datetime(raw).alias("taken"))


def degrees(spark, sf):
    n = F.col("event_id")
    ref = F.when(n % 2 == 0, "S").otherwise("n")
    return s.table(spark, sf, "events").select("event_id", F.round(text.dms_to_degrees((n % 90).cast("double"), (n % 60).cast("double"), (n % 3600 / 60).cast("double"), ref), 6).alias("degrees"))


def text_rules(spark, sf):
    p = s.table(spark, sf, "part")
    key = F.concat_ws("#", "p_partkey", F.when(F.col("p_partkey") % 4 == 0, "x").otherwise((F.col("p_partkey") % 9).cast("string")))
    path = F.concat(F.lit("/a/b/"), "p_partkey", F.lit(".JPG"))
    return p.select("p_partkey", text.image_of(key).alias("image"), text.region_index(key).alias("idx"), text.suffix(path).alias("suffix"), text.basename(path).alias("name"), text.camera_model(F.when(F.col("p_partkey") % 2 == 0, " Acme "), F.col("p_brand")).alias("camera"), text.is_true(F.when(F.col("p_partkey") % 3 == 0, " Yes ").otherwise("0")).alias("yes"), text.singular(F.get(F.array(F.lit("Berries"), F.lit(" boxes"), F.lit("cats"), F.lit("glass")), (F.col("p_partkey") % 4).cast("int"))).alias("singular"))


def resumed(spark, sf):
    d = s.table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    return ing.after_cursor(d, "doc_id", 300).orderBy("doc_id")


def patched(spark, sf):
    old = s.images(spark, sf).select("image_id", "width", F.when(F.col("vec_id") % 2 == 0, F.col("height")).alias("height"))
    new = s.images(spark, sf).filter("vec_id % 3 = 0").select("image_id", F.lit(None).cast("bigint").alias("width"), F.lit(77).cast("bigint").alias("height"))
    return ing.patch(old, new, ["width", "height"])


def stale(spark, sf):
    rows = s.images(spark, sf).select("image_id", F.when(F.col("vec_id") % 4 != 0, "h").alias("hash"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("dct").alias("hash_algo"), "width", "height", F.when(F.col("vec_id") % 11 != 0, "2024").alias("exif_datetime"), F.when(F.col("vec_id") % 13 != 0, "x").alias("camera_model"), F.when(F.col("vec_id") % 7 == 0, "deleted").otherwise("active").alias("status"))
    return ing.stale_hashes(rows, "dct").select("image_id")


def event_windows(spark, sf):
    out = windowed_counts(s.table(spark, sf, "events"), "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf):
    """Runs of one user's events with less than six hours between them."""
    gap = F.session_window("ts", "6 hours")
    return s.table(spark, sf, "events").groupBy("user_id", gap.alias("w")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


SCAN = """d AS (SELECT doc_id, md5(text) AS h, format('/p/{:08d}', doc_id) AS path, length(text) AS sz, CAST(doc_id % 50 AS DOUBLE) AS mt FROM documents),
one AS (SELECT path, h AS image_id, sz, mt FROM d WHERE doc_id % 7 <> 3), two AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN md5(h || 'x') ELSE h END AS image_id, sz, mt FROM d WHERE doc_id % 5 <> 2),
o AS (SELECT image_id, list(path ORDER BY path) AS ps, min(path) AS pp, arg_max(sz, path) AS sz, arg_max(mt, path) AS mt FROM one GROUP BY 1), n AS (SELECT image_id, list(path ORDER BY path) AS ps, arg_max(sz, path) AS sz, arg_max(mt, path) AS mt FROM two GROUP BY 1),
b AS (SELECT coalesce(o.image_id, n.image_id) AS image_id, o.image_id IS NULL AS is_new, n.image_id IS NULL AS gone, pp, o.sz AS osz, n.sz AS nsz, o.mt AS omt, n.mt AS nmt, list_concat(list_filter(coalesce(o.ps, []), lambda p: list_contains(coalesce(n.ps, []), p)), list_filter(coalesce(n.ps, []), lambda p: NOT list_contains(coalesce(o.ps, []), p))) AS paths FROM o FULL JOIN n ON o.image_id = n.image_id)"""
QUEUED = """p AS (SELECT image_id, unnest(ps) AS path FROM o), kept AS (SELECT p.image_id, list(p.path ORDER BY p.path) AS ps FROM p LEFT JOIN two ON p.path = two.path WHERE two.image_id IS NULL OR two.image_id = p.image_id GROUP BY 1),
q AS (SELECT coalesce(o.image_id, n.image_id) AS image_id, o.pp, list_concat(coalesce(k.ps, []), list_filter(coalesce(n.ps, []), lambda x: NOT list_contains(coalesce(k.ps, []), x))) AS paths FROM o FULL JOIN n ON o.image_id = n.image_id LEFT JOIN kept k ON k.image_id = o.image_id)"""
QUERIES = {
    "queue_ingest": (queued, f"WITH {SCAN}, {QUEUED} SELECT image_id, CASE WHEN list_contains(paths, pp) THEN pp ELSE coalesce(paths[1], '') END AS primary_path, array_to_string(paths, ',') AS paths, CASE WHEN len(paths) = 0 THEN 'deleted' ELSE 'active' END AS status, false AS dirty FROM q"),
    "gps_fallback": (gps, f"WITH {IMG}, m AS (SELECT vec_id, vec_id % 7 > 0 AND vec_id % 5 > 2 AS whole, vec_id % 7 > 0 AND vec_id % 5 = 1 AS half FROM embeddings) SELECT image_id, CASE WHEN vec_id % 3 = 0 THEN vec_id / 100.0 WHEN whole THEN vec_id END::DOUBLE AS gps_latitude, CASE WHEN vec_id % 4 = 0 THEN vec_id / 50.0 WHEN whole THEN -1.25 WHEN half THEN 7.5 END::DOUBLE AS gps_longitude FROM img JOIN m USING (vec_id)"),
    "embedding_sizes": (embedding_sizes, "SELECT vec_id, [12, 9, 7, 64, 64, 64][vec_id % 6 + 1] AS size FROM embeddings"),
    "caption_text": (captions, r"SELECT doc_id, regexp_replace(text, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS caption FROM documents"),
    "data_urls": (data_urls, "SELECT p_partkey, 'a/' || p_partkey || ['.png', '.TIF', '.jpg', '.webp', ''][p_partkey % 5 + 1] AS path, 'data:image/' || ['png', 'tiff', 'jpeg', 'webp', 'jpeg'][p_partkey % 5 + 1] || ';base64,' || base64(encode(p_name)) AS url FROM part"),
    "moved_paths_soft_delete": (moved, f"WITH {SCAN} SELECT image_id, CASE WHEN list_contains(paths, pp) THEN pp ELSE coalesce(paths[1], '') END AS primary_path, array_to_string(paths, ',') AS paths, CASE WHEN gone THEN 'deleted' ELSE 'active' END AS status, NOT gone AND (is_new OR osz <> nsz OR omt <> nmt) AS dirty FROM b"),
    "keyed_upsert": (keyed_upsert, "WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, CAST(CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS DOUBLE) AS score, CASE WHEN k % 3 <> 0 THEN 1 ELSE 2 END AS created FROM o WHERE k % 3 <> 0 OR k % 2 = 0"),
    "insert_missing": (insert_once, "SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 2 END AS run FROM orders"),
    "artifact_memo_plan": (memo, """SELECT doc_id AS image_id, artifact_type, CASE WHEN doc_id % 2 = 0 THEN 'm1:' ELSE '' END || sha256('{"lang":"' || lang || '"}') AS version_key FROM documents, (VALUES ('embedding'), ('caption')) t(artifact_type) WHERE doc_id % 3 <> 0 OR doc_id % 9 = 0"""),
    "lineage_closure": (lineage, "WITH RECURSIVE e AS (SELECT doc_id || '/' || a AS node, doc_id || '/' || b AS ancestor FROM documents, (VALUES ('embedding', 'hash'), ('caption', 'embedding'), ('regions', 'hash'), ('regions', 'phash')) t(a, b)), r AS (SELECT node, ancestor, 1 AS depth FROM e UNION ALL SELECT r.node, e.ancestor, r.depth + 1 FROM r JOIN e ON r.ancestor = e.node) SELECT node, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL"),
    "exif_datetime_norm": (exif, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS taken FROM events"),
    "dms_to_degrees": (degrees, "SELECT event_id, round((CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) * (event_id % 90 + (event_id % 60) / 60.0 + ((event_id % 3600) / 60) / 3600.0), 6) AS degrees FROM events"),
    "text_rules": (text_rules, "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS image, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_partkey % 9 END AS INTEGER) AS idx, '.jpg' AS suffix, p_partkey || '.JPG' AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Acme ' ELSE '' END || p_brand AS camera, p_partkey % 3 = 0 AS yes, ['berry', 'box', 'cat', 'glass'][p_partkey % 4 + 1] AS singular FROM part"),
    "resume_after_cursor": (resumed, "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE doc_id > 300"),
    "metadata_patch": (patched, "SELECT format('{:016x}', vec_id) AS image_id, 640 + 10 * (vec_id % 13) AS width, CASE WHEN vec_id % 3 = 0 THEN 77 WHEN vec_id % 2 = 0 THEN CAST(480 + 10 * label AS BIGINT) END AS height FROM embeddings"),
    "stale_hashes": (stale, "SELECT format('{:016x}', vec_id) AS image_id FROM embeddings WHERE vec_id % 7 <> 0 AND (vec_id % 4 = 0 OR vec_id % 5 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0)"),
    "stream_retries": (retried, "SELECT CAST(event_id AS VARCHAR) AS message_id, 'u' || user_id AS image_id, CAST(CASE WHEN event_id % 6 = 0 THEN 3 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN event_id % 6 = 0 THEN 'dead' ELSE 'done' END AS outcome, CASE WHEN event_id % 6 = 0 THEN 'busy' END AS error FROM events"),
    "event_windows": (event_windows, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "event_sessions": (event_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id"),
}
