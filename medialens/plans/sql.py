"""DuckDB forms of the surrogates, as common table expressions to start a query with."""

from medialens.operators.labeling import SCENES
from medialens.plans.surrogates import COSINE, HAMMING

IMG = """img AS (SELECT format('{:016x}', vec_id) AS image_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS v, vec_id % 97 AS mtime, 640 + 10 * (vec_id % 13) AS width,
  CAST(480 + 10 * label AS BIGINT) AS height, 1000 + (vec_id * 7919) % 5000 AS size_bytes FROM embeddings)"""
BITS = IMG + """, med AS (SELECT *, (list_sort(v)[32] + list_sort(v)[33]) / 2 AS m FROM img),
bits AS (SELECT *, list_transform(v, lambda x: CASE WHEN x > m THEN 1 ELSE 0 END) AS b FROM med),
hashed AS (SELECT *, CAST(array_to_string(b, '') AS BIT) AS bs FROM bits)"""
PAIRS = BITS + f""", cand AS (SELECT l.image_id AS li, l.mtime AS lm, r.image_id AS ri, r.mtime AS rm, CAST(bit_count(xor(l.bs, r.bs)) AS INTEGER) AS distance FROM hashed l JOIN hashed r ON l.image_id < r.image_id),
pairs AS (SELECT CASE WHEN lm >= rm THEN li ELSE ri END AS anchor_id, CASE WHEN lm >= rm THEN ri ELSE li END AS duplicate_id, distance FROM cand WHERE distance <= {HAMMING})"""
GROUPS = PAIRS + """, und AS (SELECT anchor_id AS a, duplicate_id AS b FROM pairs UNION SELECT duplicate_id, anchor_id FROM pairs),
reach AS (SELECT a AS node, a AS other FROM und UNION SELECT r.node, u.b FROM reach r JOIN und u ON r.other = u.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
best AS (SELECT component, arg_max(image_id, struct_pack(a := width * height, s := size_bytes, i := image_id)) AS canonical FROM comp JOIN hashed ON node = image_id GROUP BY component),
grp AS (SELECT canonical AS group_id, node AS image_id, node = canonical AS is_canonical, CAST(bit_count(xor(h.bs, c.bs)) AS INTEGER) AS distance FROM comp JOIN best USING (component) JOIN hashed h ON h.image_id = node JOIN hashed c ON c.image_id = canonical)"""
UNIT = IMG + ", unit AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM img)"
PROTO = UNIT + """, el AS (SELECT label, i, avg(u[i]) AS x FROM unit, range(1, 65) t(i) GROUP BY label, i),
pm AS (SELECT label, list(x ORDER BY i) AS m FROM el GROUP BY label),
proto AS (SELECT 'object.k' || label AS label_key, label, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS proto FROM pm)"""
_SCENE = "[" + ", ".join(f"'scene.{s}'" for s in (*SCENES, "other")) + "]"
SCENE = f"""sc AS (SELECT image_id, label_key, max(score) AS score FROM (SELECT image_id, {_SCENE}[label + 1] AS label_key, ((vec_id * 37) % 101) / 100 AS score FROM img
  UNION ALL SELECT image_id, {_SCENE}[(label + 1) % 9 + 1], ((vec_id * 53) % 101) / 100 FROM img) GROUP BY ALL)"""
REG = """reg AS (SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS idx,
  5 * l_discount AS x_min, 5 * l_tax AS y_min, least(1.0, 5 * l_discount + 0.1 + l_quantity / 100) AS x_max, least(1.0, 5 * l_tax + 0.1 + (l_partkey % 50) / 100) AS y_max, (l_suppkey % 100) / 100 AS score, 'object.p' || (l_partkey % 7) AS label_key FROM lineitem)"""
PRIO = REG + """, prio AS (SELECT *, score * pow(greatest(1e-6, greatest(0.0, x_max - x_min) * greatest(0.0, y_max - y_min)), 0.3)
  * greatest(0.0, 1.0 - 0.6 * sqrt(((x_min + x_max) / 2 - 0.5) * ((x_min + x_max) / 2 - 0.5) + ((y_min + y_max) / 2 - 0.5) * ((y_min + y_max) / 2 - 0.5))) AS priority FROM reg),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY priority DESC, idx) - 1 AS INTEGER) AS rank FROM prio)"""
KNN = UNIT + f""", sims AS (SELECT a.image_id AS src, b.image_id AS dst, list_inner_product(a.u, b.u) AS similarity FROM unit a JOIN unit b ON a.image_id <> b.image_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS n FROM sims WHERE similarity >= {COSINE}) WHERE n <= 20)"""
CLUSTER = KNN + """, und AS (SELECT src AS a, dst AS b FROM knn UNION SELECT dst, src FROM knn),
reach AS (SELECT a AS node, a AS other FROM und UNION SELECT r.node, u.b FROM reach r JOIN und u ON r.other = u.a),
comp AS (SELECT node, min(other) AS cluster_id FROM reach GROUP BY node),
clu AS (SELECT cluster_id, node AS id FROM comp WHERE cluster_id IN (SELECT cluster_id FROM comp GROUP BY cluster_id HAVING count(*) >= 3))"""
