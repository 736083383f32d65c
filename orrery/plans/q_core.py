"""Queries on vectors, retrieval, the store, clusters and derived values, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery import fixtures as X
from orrery import schema
from orrery.functions import text as T
from orrery.functions import vectors as V
from orrery.operators import cluster as C
from orrery.operators import derive as D
from orrery.operators import edges as E
from orrery.operators import evaluate as Q
from orrery.operators import retrieve as R
from orrery.operators import store as S
from orrery.operators.scan import nearest

QUERIES, SQL = {}, {}

PRE = """WITH RECURSIVE s AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id AS seq, d.text, d.source AS source_file, d.lang AS source_type, e.label AS cluster_id,
  CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS INTEGER) AS chunk_index, CAST(e.embedding AS DOUBLE[]) AS v FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
c AS (SELECT id, seq, text, source_file, source_type, cluster_id, v, q, list_inner_product(q, v) AS ip FROM s, q ORDER BY ip DESC, id LIMIT 50)
"""
DOT = "list_inner_product({0}, {1})"
NORM = "sqrt(list_inner_product({0}, {0}))"
COS = "(list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1}))))"
DUAL = (
    "(4 * (1 - list_inner_product(q[1:16], v[1:16]) / ((sqrt(list_inner_product(q[1:16], q[1:16])) + 1e-8) * (sqrt(list_inner_product(v[1:16], v[1:16])) + 1e-8)))"
    " + list_inner_product(q[17:64], q[17:64]) + list_inner_product(v[17:64], v[17:64]) - 2 * list_inner_product(q[17:64], v[17:64]))"
)
POIN = "acosh(greatest(1.0, 1 + 2 * greatest(0.0, {ru} * {ru} + {rv} * {rv} - 2 * {ru} * {rv} * {cos}) / greatest((1 - {ru} * {ru}) * (1 - {rv} * {rv}), 1e-5)))"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _cap(dist: str) -> str:
    return PRE + f""", r AS (SELECT id, source_file, {dist} AS dist FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY dist, id) AS rn FROM r)
SELECT id, source_file, round(dist, 6) AS dist, CAST(row_number() OVER (ORDER BY dist, id) AS INTEGER) AS rank FROM (SELECT * FROM w WHERE rn <= 3 ORDER BY dist, id LIMIT 10)"""


def _shown(df):
    return df.select("id", "source_file", F.round("dist", 6).alias("dist"), "rank")


@query("retrieve_dual", _cap(DUAL))
def retrieve_dual(spark, d):
    return _shown(R.retrieve(X.spheres(spark, d), X.query_vector(spark, d), mode="dual"))


@query("retrieve_cosine", _cap("-ip"))
def retrieve_cosine(spark, d):
    return _shown(R.retrieve(X.spheres(spark, d), X.query_vector(spark, d), mode="cosine"))


@query("retrieve_poincare", _cap(POIN.format(ru="0.5", rv="(CASE WHEN cluster_id % 2 = 0 THEN 0.3 ELSE 0.7 END)", cos=COS.format("q", "v"))))
def retrieve_poincare(spark, d):
    norm = R.valid_norm(F.when(F.col("cluster_id") % 2 == 0, 0.3).otherwise(0.7))
    return _shown(R.retrieve(X.spheres(spark, d), X.query_vector(spark, d), mode="poincare", norm=norm))


@query("retrieve_excluding", PRE + f""", r AS (SELECT id, source_file, {DUAL} AS dist FROM c WHERE seq % 3 <> 0), w AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY dist, id) AS rn FROM r)
SELECT id, source_file, round(dist, 6) AS dist, CAST(row_number() OVER (ORDER BY dist, id) AS INTEGER) AS rank FROM (SELECT * FROM w WHERE rn <= 3 ORDER BY dist, id LIMIT 10)""")
def retrieve_excluding(spark, d):
    s = X.spheres(spark, d)
    return _shown(R.retrieve(s, X.query_vector(spark, d), exclude=S.excluded(s.where("seq % 3 = 0"), s.where("seq % 6 = 0"))))


@query("vector_top_k", PRE + "SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, CAST(b.vec_id AS VARCHAR)) <= 20")
def vector_top_k(spark, d):
    v = X.vectors(spark, d)
    return nearest(v.where(F.col("id").cast("long") % 50 == 0), v, 20).select("query_id", "id", F.round("score", 6).alias("score"))


@query("poincare_fullscan", PRE + f"SELECT id, round({POIN.format(ru='0.5', rv='0.5', cos=COS.format('q', 'v'))}, 6) AS dist FROM s, q ORDER BY {POIN.format(ru='0.5', rv='0.5', cos=COS.format('q', 'v'))}, id LIMIT 20")
def poincare_fullscan(spark, d):
    return R.poincare_scan(X.spheres(spark, d), X.query_vector(spark, d), 20).select("id", F.round("dist", 6).alias("dist"))


@query("poincare_pairs", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
b AS (SELECT vec_id, list_transform(v, lambda x: 0.6 * x / sqrt(list_inner_product(v, v))) AS u FROM e)
SELECT a.vec_id AS a, b.vec_id AS b, round(acosh(greatest(1.0, 1 + 2 * (list_inner_product(a.u, a.u) + list_inner_product(b.u, b.u) - 2 * list_inner_product(a.u, b.u)) / greatest((1 - list_inner_product(a.u, a.u)) * (1 - list_inner_product(b.u, b.u)), 1e-5))), 6) AS dist
FROM b a JOIN b ON b.vec_id = a.vec_id + 1""")
def poincare_pairs(spark, d):
    e = X.read(spark, d, "embeddings").select("vec_id", V.to_ball(F.col("embedding"), 0.6).alias("u"))
    n = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("u").alias("w"))
    return e.withColumnRenamed("vec_id", "a").join(n, "a").select("a", "b", F.round(V.poincare(F.col("u"), F.col("w")), 6).alias("dist"))


_MB = """WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 0.5) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, a.v AS u, b.v AS w, list_inner_product(a.v, b.v) AS uv, list_inner_product(a.v, a.v) AS u2, list_inner_product(b.v, b.v) AS w2 FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT a, round(sqrt(((1 + 2 * uv + w2) ** 2 * u2 + (1 - u2) ** 2 * w2 + 2 * (1 + 2 * uv + w2) * (1 - u2) * uv) / (1 + 2 * uv + u2 * w2) ** 2), 6) AS n FROM p"""


@query("mobius_norm", _MB)
def mobius_norm(spark, d):
    e = X.read(spark, d, "embeddings").select("vec_id", V.scaled(F.col("embedding"), 0.5).alias("u"))
    n = e.select((F.col("vec_id") - 1).alias("a"), F.col("u").alias("w"))
    return e.withColumnRenamed("vec_id", "a").join(n, "a").select("a", F.round(V.norm(V.mobius_add(F.col("u"), F.col("w"))), 6).alias("n"))


@query("decay_angle", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.vec_id AS a, round(degrees(acos(least(1.0, greatest(-1.0, " + COS.format("a.v", "b.v") + ")))), 4) AS angle FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def decay_angle(spark, d):
    e = X.read(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("w"))
    return e.withColumnRenamed("vec_id", "a").join(n, "a").select("a", F.round(V.angle(F.col("embedding"), F.col("w")), 4).alias("angle"))


@query("three_space", PRE + """, p AS (SELECT id, q[1:16] AS q1, v[1:16] AS v1, q[17:48] AS q2, v[17:48] AS v2, q[49:64] AS q3, v[49:64] AS v3 FROM s, q),
n AS (SELECT *, greatest(sqrt(list_inner_product(q3, q3)), 1e-5) AS nq, greatest(sqrt(list_inner_product(v3, v3)), 1e-5) AS nv FROM p),
b AS (SELECT *, list_inner_product(q3, q3) * (tanh(nq) / nq) ** 2 AS u2, list_inner_product(v3, v3) * (tanh(nv) / nv) ** 2 AS w2, -list_inner_product(q3, v3) * (tanh(nq) / nq) * (tanh(nv) / nv) AS uv FROM n)
SELECT id, round(2 * (1 - """ + COS.format("q1", "v1") + """) + list_inner_product(q2, q2) + list_inner_product(v2, v2) - 2 * list_inner_product(q2, v2)
 + 2 * atanh(least(sqrt(greatest(0.0, ((1 + 2 * uv + w2) ** 2 * u2 + (1 - u2) ** 2 * w2 + 2 * (1 + 2 * uv + w2) * (1 - u2) * uv) / (1 + 2 * uv + u2 * w2) ** 2)), 1 - 1e-5)), 5) AS dist FROM b WHERE id <> '0'""")
def three_space(spark, d):
    q = V.literal(X.query_vector(spark, d))
    return X.spheres(spark, d).where("id <> '0'").select("id", F.round(V.three_space(q, F.col("embedding"), 16, 32, 64), 5).alias("dist"))


@query("kb_gravity_score", PRE + "SELECT id, round(list_inner_product(q, v) * (1 + 0.1 * cluster_id), 6) AS score FROM s, q")
def kb_gravity_score(spark, d):
    m = schema.effective_mass(F.lit(1.0), 0.1 * F.col("cluster_id"))
    return R.gravity_score(X.spheres(spark, d), X.query_vector(spark, d), m).select("id", F.round("score", 6).alias("score"))


@query("kb_poincare_score", PRE + "SELECT id, round(-acosh(greatest(1 + 1e-5, 1 + 2 * (list_inner_product(q, q) + list_inner_product(v, v) - 2 * list_inner_product(q, v)) / (greatest(1e-5, 1 - list_inner_product(q, q)) * greatest(1e-5, 1 - list_inner_product(v, v))))), 4) AS score FROM s, (SELECT list_transform(q, lambda x: 0.5 * x) AS q FROM q), (SELECT 1) WHERE id <> '0'".replace("FROM s,", "FROM (SELECT id, list_transform(v, lambda x: 0.5 * x) AS v FROM s),"))
def kb_poincare_score(spark, d):
    s = X.spheres(spark, d).where("id <> '0'").withColumn("embedding", V.scaled(F.col("embedding"), 0.5))
    return R.poincare_score(s, [0.5 * x for x in X.query_vector(spark, d)]).select("id", F.round("score", 4).alias("score"))


@query("norm_map", "SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label / 5.0 > 0 AND label / 5.0 < 1 THEN label / 5.0 ELSE 0.5 END AS norm FROM embeddings")
def norm_map(spark, d):
    return X.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), R.valid_norm(F.col("label") / 5.0).alias("norm"))


# -- clusters and fields ------------------------------------------------------------------------------------------

CEN = """, pos AS (SELECT cluster_id, i, avg(v[i]) AS x, count(*) AS n FROM s, unnest(generate_series(1, 64)) AS g(i) GROUP BY ALL),
cen0 AS (SELECT cluster_id, list(x ORDER BY i) AS m, max(n) AS n FROM pos GROUP BY cluster_id),
cen AS (SELECT cluster_id, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS centroid, n FROM cen0)"""


@query("centroids", PRE + CEN + " SELECT cluster_id, CAST(i - 1 AS INTEGER) AS pos, round(centroid[i], 6) AS x, n FROM cen, unnest(generate_series(1, 64)) AS g(i)")
def centroids(spark, d):
    return C.centroids(X.spheres(spark, d)).select("cluster_id", F.posexplode("centroid").alias("pos", "x"), "n").select("cluster_id", "pos", F.round("x", 6).alias("x"), "n")


@query("field_centroids", PRE + ", pos AS (SELECT source_type, i, avg(v[i]) AS x, count(*) AS n FROM s, unnest(generate_series(1, 64)) AS g(i) GROUP BY ALL), m AS (SELECT source_type, list(x ORDER BY i) AS m, max(n) AS n FROM pos GROUP BY 1) SELECT source_type, n, CAST(i - 1 AS INTEGER) AS pos, round(m[i] / sqrt(list_inner_product(m, m)), 6) AS x FROM m, unnest(generate_series(1, 64)) AS g(i)")
def field_centroids(spark, d):
    return C.centroids(X.spheres(spark, d), "source_type").select("source_type", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("predict_cluster", PRE + CEN + ", a AS (SELECT id, cen.cluster_id, list_inner_product(v, centroid) AS sc FROM s, cen) SELECT id, cluster_id, round(greatest(0.0, sc), 6) AS score FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY sc DESC, cluster_id) = 1")
def predict_cluster(spark, d):
    s = X.spheres(spark, d)
    return C.predict(s, C.centroids(s)).select("id", "cluster_id", F.round("score", 6).alias("score"))


_GF = PRE + CEN + ", f AS (SELECT '簇' || cluster_id AS field, centroid FROM cen), g AS (SELECT id, cluster_id, field, round(greatest(0.0, list_inner_product(v, centroid)), 4) AS value FROM s, f)"


def _fields(s):
    return C.fields_of_clusters(C.centroids(s))


@query("gravity_field", _GF + " SELECT id, field, value FROM g")
def gravity_field(spark, d):
    s = X.spheres(spark, d)
    return C.gravity_field(s, _fields(s))


@query("top_fields", _GF + " SELECT id, field, value, CAST(row_number() OVER (PARTITION BY id ORDER BY value DESC, field) AS INTEGER) AS rn FROM g QUALIFY rn <= 3")
def top_fields(spark, d):
    s = X.spheres(spark, d)
    return C.top_fields(C.gravity_field(s, _fields(s)))


@query("field_affinity", _GF + " SELECT field, round(greatest(0.0, list_inner_product(q, centroid)), 4) AS affinity FROM f, q WHERE round(greatest(0.0, list_inner_product(q, centroid)), 4) >= 0.05")
def field_affinity(spark, d):
    return C.affinities(X.query_vector(spark, d), _fields(X.spheres(spark, d)), 0.05)


@query("gravity_focus", _GF + ", a AS (SELECT field, round(greatest(0.0, list_inner_product(q, centroid)), 4) AS affinity FROM f, q ORDER BY affinity DESC, field LIMIT 2) SELECT id, round(1 + 0.2 * sum(value * affinity), 4) AS factor FROM g JOIN a USING (field) GROUP BY id")
def gravity_focus(spark, d):
    s = X.spheres(spark, d)
    f = _fields(s)
    return C.focus(C.gravity_field(s, f), C.affinities(X.query_vector(spark, d), f))


@query("field_shares", _GF + " SELECT field, round(count(*) / (SELECT count(*) FROM s WHERE cluster_id = 3), 3) AS share FROM g WHERE cluster_id = 3 AND value > 0.15 GROUP BY field")
def field_shares(spark, d):
    s = X.spheres(spark, d)
    return C.field_shares(s, C.gravity_field(s, _fields(s)), 3, 0.15)


@query("cluster_sizes", "SELECT label AS cluster_id, '簇' || label AS name, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return X.read(spark, d, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n")).select("cluster_id", T.cluster_label(F.col("cluster_id")).alias("name"), "n")


@query("online_centroid", PRE + """, o AS (SELECT source_type, v, row_number() OVER (PARTITION BY source_type ORDER BY seq) AS k FROM s),
r AS (SELECT source_type, k, v AS c FROM o WHERE k = 1 UNION ALL
  SELECT source_type, k, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) FROM (SELECT r.source_type, o.k, list_transform(list_zip(r.c, o.v), lambda z: z[1] + (z[2] - z[1]) / (r.k + 1)) AS m FROM r JOIN o ON o.source_type = r.source_type AND o.k = r.k + 1))
SELECT source_type, CAST(k AS BIGINT) AS n, CAST(i - 1 AS INTEGER) AS pos, round(c[i], 5) AS x FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source_type ORDER BY k DESC) = 1), unnest(generate_series(1, 64)) AS g(i)""")
def online_centroid(spark, d):
    return C.online_add(X.spheres(spark, d)).select("source_type", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query("online_remove", PRE + """, pos AS (SELECT source_type, i, avg(v[i]) AS x, count(*) AS n FROM s, unnest(generate_series(1, 64)) AS g(i) GROUP BY ALL), m0 AS (SELECT source_type, list(x ORDER BY i) AS m, max(n) AS n FROM pos GROUP BY 1),
m AS (SELECT source_type, n, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) AS m FROM m0), gone AS (SELECT source_type, v FROM s QUALIFY row_number() OVER (PARTITION BY source_type ORDER BY seq) = 1),
a AS (SELECT m.source_type, n - 1 AS n, list_transform(list_zip(m.m, gone.v), lambda z: (z[1] * n - z[2]) / (n - 1)) AS u FROM m JOIN gone USING (source_type))
SELECT source_type, CAST(n AS BIGINT) AS n, CAST(i - 1 AS INTEGER) AS pos, round(u[i] / sqrt(list_inner_product(u, u)), 5) AS x FROM a, unnest(generate_series(1, 64)) AS g(i)""")
def online_remove(spark, d):
    s = X.spheres(spark, d)
    first = s.withColumn("rn", F.row_number().over(Window.partitionBy("source_type").orderBy("seq"))).where("rn = 1")
    return C.online_remove(C.centroids(s, "source_type"), first).select("source_type", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query("gravity_drift", PRE + CEN + """, h AS (SELECT s.cluster_id FROM s, q ORDER BY list_inner_product(q, v) DESC, id LIMIT 5), won AS (SELECT cluster_id, count(*) AS k FROM h GROUP BY 1 HAVING count(*) >= 1 ORDER BY k DESC, cluster_id LIMIT 1),
m AS (SELECT list_transform(list_zip(q, centroid), lambda z: z[1] + 0.15 * z[2]) AS m FROM q, won JOIN cen USING (cluster_id))
SELECT CAST(i - 1 AS INTEGER) AS pos, round(m[i] / sqrt(list_inner_product(m, m)), 6) AS x FROM m, unnest(generate_series(1, 64)) AS g(i)""")
def gravity_drift(spark, d):
    s = X.spheres(spark, d)
    q = R.drifted(X.query_vector(spark, d), s, C.centroids(s), need=1)
    return spark.createDataFrame([(q,)], "q array<double>").select(F.posexplode("q").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("cluster_routing", PRE + CEN + ", n AS (SELECT cluster_id FROM cen, q ORDER BY list_inner_product(q, centroid) DESC, cluster_id LIMIT 2) SELECT id, c.cluster_id, round(ip, 6) AS ip, CASE WHEN n.cluster_id IS NULL THEN 1 ELSE 0 END AS far FROM c LEFT JOIN n USING (cluster_id) ORDER BY far, ip DESC, id LIMIT 10")
def cluster_routing(spark, d):
    s = X.spheres(spark, d)
    return R.routed(s, X.query_vector(spark, d), C.centroids(s)).withColumn("ip", F.round("ip", 6))


@query("force_model", PRE + CEN + " SELECT id, round(0.4 * list_inner_product(q, v) + 0.2 * (len(text) % 10) / 10.0 + 0.2 * greatest(0.0, list_inner_product(v, centroid)) + 0.2 * (seq % 7) / 7.0, 6) AS force FROM s JOIN cen USING (cluster_id), q")
def force_model(spark, d):
    s = X.spheres(spark, d)
    j = s.join(F.broadcast(C.centroids(s).select("cluster_id", "centroid")), "cluster_id")
    f = R.force(V.dot(V.literal(X.query_vector(spark, d)), F.col("embedding")), F.length("text") % 10 / 10.0, F.greatest(F.lit(0.0), V.dot(F.col("embedding"), F.col("centroid"))), F.col("seq") % 7 / 7.0)
    return j.select("id", F.round(f, 6).alias("force"))


@query("kmeans_clusters")
def kmeans_clusters(spark, d):
    rows, _, _ = C.kmeans(X.vectors(spark, d), 5, runs=1)
    return rows.select("id", "cluster_id", F.round("score", 6).alias("score"))


@query("auto_k")
def auto_k(spark, d):
    return spark.createDataFrame([(C.auto_k(X.vectors(spark, d), least=5, most=7),)], "k int")


@query("silhouette", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
p AS (SELECT a.vec_id AS id, a.label AS own, b.label AS other, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE sqrt(greatest(0.0, list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v))) END) AS s FROM e a, e b GROUP BY ALL),
r AS (SELECT id, max(CASE WHEN own = other THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p JOIN n ON n.label = p.other GROUP BY id)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM r""")
def silhouette(spark, d):
    v = X.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").alias("cluster_id"))
    return C.silhouette(v.select("id", "embedding"), v.select("id", "cluster_id"))


# -- store --------------------------------------------------------------------------------------------------------

_TBL = "t AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS seq, text, source AS source_file, lang AS source_type, doc_id % 10 <> 3 AS active, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS level, CAST(doc_id - doc_id % 4 AS VARCHAR) AS parent_id FROM documents)"


def _table(spark, d):
    i = F.col("doc_id")
    kids = F.when(i % 4 == 0, F.array((i + 1).cast("string"), (i + 2).cast("string"), (i + 3).cast("string"))).otherwise(F.array().cast("array<string>"))
    return X.read(spark, d, "documents").select(
        i.cast("string").alias("id"), i.alias("seq"), "text", F.col("source").alias("source_file"), F.col("lang").alias("source_type"), (i % 10 != 3).alias("active"),
        F.when(i % 4 == 0, 1).otherwise(2).alias("level"), (i - i % 4).cast("string").alias("parent_id"), kids.alias("child_ids"), F.lit(0.5).alias("poincare_norm"), F.lit("default").alias("poincare_norm_source"),
    )


@query("sphere_ids", "SELECT doc_id, sha256(source || ':' || text)[1:12] AS id, CAST('0x' || sha256(source || ':' || text)[1:12] AS BIGINT) AS index_id, 'c_' || md5('concept:' || lower(trim(lang)))[1:8] AS concept, md5(lang)[1:8] AS entity FROM documents")
def sphere_ids(spark, d):
    i = schema.sphere_id(F.col("source"), F.col("text"))
    return X.read(spark, d, "documents").select("doc_id", i.alias("id"), schema.index_id(i).alias("index_id"), schema.concept_id(F.col("lang")).alias("concept"), schema.entity_id(F.col("lang")).alias("entity"))


@query("index_round_trip", "SELECT doc_id, sha256(source || ':' || text)[1:12] AS id FROM documents")
def index_round_trip(spark, d):
    i = schema.index_id(schema.sphere_id(F.col("source"), F.col("text")))
    return X.read(spark, d, "documents").select("doc_id", schema.id_of_index(i).alias("id"))


@query("get_many", f"WITH {_TBL}, w AS (SELECT * FROM (VALUES (0, '17'), (1, '5'), (2, 'none'), (3, '99')) z(pos, id)) SELECT pos, t.id, source_file FROM w JOIN t USING (id)")
def get_many(spark, d):
    return S.get_many(_table(spark, d), ["17", "5", "none", "99"]).select("pos", "id", "source_file")


@query("filter_active", f"WITH {_TBL} SELECT 'source' AS kind, count(*) AS n FROM t WHERE active AND source_file = 'src3' UNION ALL SELECT 'type', count(*) FROM t WHERE active AND source_type = 'fr' UNION ALL SELECT 'level', count(*) FROM t WHERE active AND level = 1")
def filter_active(spark, d):
    t = _table(spark, d)
    one = lambda k, c, v: S.by(t, c, v).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("source", "source_file", "src3").unionByName(one("type", "source_type", "fr")).unionByName(one("level", "level", 1))


@query("children_and_parent", f"WITH {_TBL} SELECT 'child' AS kind, id FROM t WHERE active AND id IN ('9', '10', '11') UNION ALL SELECT 'parent', id FROM t WHERE id = '8'")
def children_and_parent(spark, d):
    t = _table(spark, d)
    return S.children(t, "8").select(F.lit("child").alias("kind"), "id").unionByName(S.parent(t, "10").select(F.lit("parent").alias("kind"), "id"))


@query("paged_list", f"WITH {_TBL} SELECT id FROM t WHERE active ORDER BY seq LIMIT 25 OFFSET 50")
def paged_list(spark, d):
    return S.page(_table(spark, d), 25, 50)


@query("kb_counts", f"WITH {_TBL} SELECT count(*) FILTER (active) AS active, count(*) AS total, 0.5 AS avg_norm, 0.5 AS min_norm, 0.5 AS max_norm FROM t")
def kb_counts(spark, d):
    return S.stats(_table(spark, d))


@query("ingest_antijoin", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def ingest_antijoin(spark, d):
    new = X.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("chunk_index"))
    return S.insert(X.read(spark, d, "embeddings").select(F.col("vec_id").alias("id")), new.unionByName(new)).select("id")


@query("soft_delete", f"WITH {_TBL} SELECT id, active AND seq % 7 <> 0 AS active FROM t")
def soft_delete(spark, d):
    t = _table(spark, d)
    return S.soft_delete(t, t.where("seq % 7 = 0")).select("id", "active")


@query("orphans", f"WITH {_TBL} SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT id FROM t WHERE active)")
def orphans(spark, d):
    return S.orphans(X.vectors(spark, d), _table(spark, d))


@query("set_norms", f"WITH {_TBL} SELECT id, CASE WHEN seq % 5 = 0 THEN 0.05 + 0.01 * (seq % 80) ELSE 0.5 END AS poincare_norm, CASE WHEN seq % 5 = 0 THEN 'derived' ELSE 'default' END AS poincare_norm_source FROM t")
def set_norms(spark, d):
    t = _table(spark, d)
    return S.set_norm(t, t.where("seq % 5 = 0").select("id", (0.05 + 0.01 * (F.col("seq") % 80)).alias("norm")), "derived").select("id", "poincare_norm", "poincare_norm_source")


@query("vector_replace", "SELECT CAST(vec_id AS VARCHAR) AS id, round(CASE WHEN vec_id % 3 = 0 THEN 2.0 ELSE 1.0 END * CAST(embedding[1] AS DOUBLE), 5) AS x FROM embeddings")
def vector_replace(spark, d):
    v = X.vectors(spark, d).select("id", V.doubles(F.col("embedding")).alias("embedding"))
    new = v.where(F.col("id").cast("int") % 3 == 0).select("id", V.scaled(F.col("embedding"), 2.0).alias("embedding"))
    return S.add_vectors(v, new).select("id", F.round(F.col("embedding")[0], 5).alias("x"))


@query("set_operations", "SELECT 'new' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings) UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings) UNION ALL SELECT 'any', count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings)")
def set_operations(spark, d):
    a, b = X.read(spark, d, "documents").select(F.col("doc_id").alias("id")), X.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    n = lambda k, t: t.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n("new", a.subtract(b)).unionByName(n("both", a.intersect(b))).unionByName(n("any", S.excluded(a, b)))


@query("session_history", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def session_history(spark, d):
    return S.keep_last(X.read(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


# -- derived values -----------------------------------------------------------------------------------------------


@query("vector_norm_stats", "WITH n AS (SELECT sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) SELECT round(min(n), 6) AS min, round(max(n), 6) AS max, round(avg(n), 6) AS mean, round(median(n), 6) AS median, round(avg(CASE WHEN n > 0.8 THEN 1.0 ELSE 0.0 END), 6) AS share_above FROM n")
def vector_norm_stats(spark, d):
    return D.vector_stats(X.vectors(spark, d))


@query("diversity", PRE + CEN + " SELECT id, round(1 - least(1.0, greatest(0.0, (" + COS.format("v", "centroid") + " + 1) / 2)), 4) AS diversity FROM s JOIN cen USING (cluster_id)")
def diversity(spark, d):
    return D.diversity(X.spheres(spark, d))


_M = "m AS (SELECT CAST(vec_id AS VARCHAR) AS id, 1 + 0.25 * label AS mass FROM embeddings)"


def _masses(spark, d):
    return X.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), (1 + 0.25 * F.col("label")).alias("mass"))


_LOGN = f"WITH {_M}, n AS (SELECT id, round(least(0.9, greatest(0.05, 0.9 - 0.8 * ln(1 + mass) / (SELECT max(ln(1 + mass)) FROM m))), 6) AS norm FROM m)"


@query("norms_log_mass", _LOGN + " SELECT id, norm FROM n")
def norms_log_mass(spark, d):
    return D.norm_of_log_mass(_masses(spark, d))


@query("norm_stats", _LOGN + " SELECT count(norm) AS n, round(min(norm), 6) AS min, round(max(norm), 6) AS max, round(avg(norm), 6) AS mean, round(median(norm), 6) AS median, round(stddev_pop(norm), 6) AS std, count(*) FILTER (norm < 0.3) AS centre, count(*) FILTER (norm >= 0.3 AND norm < 0.7) AS middle, count(*) FILTER (norm >= 0.7) AS rim FROM n")
def norm_stats(spark, d):
    return D.norm_stats(D.norm_of_log_mass(_masses(spark, d)))


@query("mass_stats", f"WITH {_M} SELECT count(mass) AS n, round(min(mass), 6) AS min, round(max(mass), 6) AS max, round(avg(mass), 6) AS mean, round(median(mass), 6) AS median, count(*) FILTER (abs(mass - 1) < 0.01) AS leaves, count(*) FILTER (mass > 1) AS above_1, count(*) FILTER (mass > 2) AS above_2 FROM m")
def mass_stats(spark, d):
    return D.mass_stats(_masses(spark, d))


@query("scalar_norms", "SELECT vec_id, round(0.1 + 0.5 * (1 - (least(3.0, greatest(1.0, 1 + 0.25 * label)) - 1) / 2), 4) AS by_mass, CASE label % 4 WHEN 1 THEN 0.15 WHEN 2 THEN 0.5 WHEN 3 THEN 0.8 ELSE 0.5 END AS by_level, round(least(0.8, greatest(0.15, 0.8 - 0.65 * label / 9.0)), 6) AS by_degree, round(least(0.95, greatest(0.3, 0.5 + CASE WHEN label >= 5 THEN 0.2 WHEN label >= 3 THEN 0.1 ELSE 0.0 END + 0.08 * (label % 4))), 6) AS jump FROM embeddings")
def scalar_norms(spark, d):
    l = F.col("label")
    return X.read(spark, d, "embeddings").select("vec_id", T.norm_of_mass(1 + 0.25 * l).alias("by_mass"), T.norm_of_level(l % 4).alias("by_level"), F.round(T.norm_of_degree(l, F.lit(9.0)), 6).alias("by_degree"), F.round(T.jump_confidence(l, l % 4), 6).alias("jump"))


@query("hierarchy_mass", """WITH RECURSIVE t AS (SELECT doc_id, doc_id % 10 <> 3 AS active FROM documents), k AS (SELECT t.doc_id AS p, x AS c FROM t, unnest([2 * t.doc_id + 1, 2 * t.doc_id + 2]) u(x) WHERE t.active AND x IN (SELECT doc_id FROM t WHERE active)),
r AS (SELECT doc_id AS top, doc_id AS at FROM t WHERE active UNION ALL SELECT r.top, k.c FROM r JOIN k ON k.p = r.at) SELECT top AS id, CAST(count(*) AS DOUBLE) AS mass FROM r GROUP BY top""")
def hierarchy_mass(spark, d):
    i = F.col("doc_id")
    return D.hierarchy_mass(X.read(spark, d, "documents").select(i.alias("id"), (i % 10 != 3).alias("active"), F.array(2 * i + 1, 2 * i + 2).alias("child_ids")))


@query("term_factor", "WITH g AS (SELECT doc_id AS id, n_chars % 97 AS s FROM documents) SELECT id, round(least(1.0, s / (2 * (SELECT median(s) FROM g))), 6) AS f FROM g")
def term_factor(spark, d):
    return D.term_factor(X.read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 97).alias("s")))


# -- evaluation ---------------------------------------------------------------------------------------------------

_EV = PRE + ", qs AS (SELECT id AS query_id, v AS qv, cluster_id AS ql FROM s WHERE seq % 50 = 0), r AS (SELECT query_id, s.id, s.source_file, s.cluster_id = ql AS relevant, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(qv, s.v) DESC, s.id) AS rank FROM qs, s WHERE s.id <> query_id QUALIFY rank <= 10)"


def _results(spark, d, k=10):
    """The k nearest of every sphere whose id is divisible by 50, among all the others."""
    s = X.spheres(spark, d)
    v = X.vectors(spark, d).join(s.select("id"), "id", "left_semi")
    r = nearest(v.where(F.col("id").cast("long") % 50 == 0), v, k + 1).where("id <> query_id")
    r = Q.ranked(r, "score").where(F.col("rank") <= k)
    lab = s.select(F.col("id").alias("query_id"), F.col("cluster_id").alias("ql"))
    return r.join(s.select("id", "source_file", "cluster_id"), "id").join(lab, "query_id").withColumn("relevant", F.col("cluster_id") == F.col("ql"))


@query("mrr_recall", _EV + ", f AS (SELECT query_id, min(rank) FILTER (relevant) AS r FROM r GROUP BY 1) SELECT round(avg(coalesce(1.0 / r, 0)), 6) AS mrr, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, count(*) AS queries FROM f")
def mrr_recall(spark, d):
    return Q.ranking(_results(spark, d))


@query("source_precision", _EV + " SELECT query_id, round(avg(CASE WHEN contains(lower(source_file), 'src1') OR contains(lower(source_file), 'c7') THEN 1.0 ELSE 0 END), 6) AS precision FROM r GROUP BY 1")
def source_precision(spark, d):
    return Q.source_precision(_results(spark, d), F.array(F.lit("SRC1"), F.lit("c7")))


@query("ab_compare", _EV + ", a AS (SELECT query_id, avg(CASE WHEN contains(source_file, 'src1') THEN 1.0 ELSE 0 END) AS x, avg(CASE WHEN relevant THEN 1.0 ELSE 0 END) AS y FROM r GROUP BY 1), d AS (SELECT round(y, 6) - round(x, 6) AS d FROM a) SELECT count(*) FILTER (d > 0.05) AS win, count(*) FILTER (d < -0.05) AS lose, count(*) FILTER (abs(d) <= 0.05) AS tie FROM d")
def ab_compare(spark, d):
    r = _results(spark, d)
    b = r.groupBy("query_id").agg(F.round(F.avg(F.col("relevant").cast("double")), 6).alias("precision"))
    return Q.compare(Q.source_precision(r, F.array(F.lit("src1"))), b)


@query("rank_displacement", PRE + f", a AS (SELECT id, row_number() OVER (ORDER BY ip DESC, id) AS x, row_number() OVER (ORDER BY {DUAL}, id) AS y FROM c) SELECT count(*) FILTER (abs(x - y) > 5) AS moved, count(*) AS common FROM a")
def rank_displacement(spark, d):
    q = X.query_vector(spark, d)
    c = R.candidates(X.spheres(spark, d), q).withColumn("query_id", F.lit("q")).withColumn("dist", R.distance(q, "dual"))
    return Q.displaced(Q.ranked(c, "ip"), Q.ranked(c, "dist", False))


@query("distance_correlation", PRE + f", a AS (SELECT {DUAL} AS x, {POIN.format(ru='0.5', rv='0.5', cos=COS.format('q', 'v'))} AS y FROM s, q WHERE id <> '0') SELECT round(avg(x), 6) AS mean_x, round(stddev_pop(x), 6) AS std_x, round(avg(y), 6) AS mean_y, round(stddev_pop(y), 6) AS std_y, round(corr(x, y), 6) AS corr, count(*) AS n FROM a")
def distance_correlation(spark, d):
    q = X.query_vector(spark, d)
    s = X.spheres(spark, d).where("id <> '0'").select(R.distance(q, "dual").alias("x"), R.distance(q, "poincare").alias("y"))
    return Q.spread(s, "x", "y")


@query("crosstab", "SELECT label AS cluster_id, lang AS source_type, count(*) AS n FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY ALL")
def crosstab(spark, d):
    return X.spheres(spark, d).groupBy("cluster_id", "source_type").agg(F.count(F.lit(1)).alias("n"))


@query("diversity_sort")
def diversity_sort(spark, d):
    q = X.query_vector(spark, d)
    c = R.candidates(X.spheres(spark, d), q).withColumn("query_id", F.lit("0"))
    return R.diversity_sort(c, q, affinities={"en": 0.5, "fr": 0.2}, edges=E.temporal(X.spheres(spark, d)))


@query("reply_rerank", PRE + ", a AS (SELECT id, CAST(CASE WHEN seq % 3 = 0 THEN NULL ELSE 1 + seq % 5 END AS DOUBLE) / 5 AS x FROM c) SELECT '0' AS query_id, CAST(row_number() OVER (ORDER BY coalesce(x, 0) DESC, id) AS INTEGER) AS rank, id, coalesce(x, 0) AS score FROM a QUALIFY rank <= 20")
def reply_rerank(spark, d):
    c = R.candidates(X.spheres(spark, d), X.query_vector(spark, d)).withColumn("query_id", F.lit("0"))
    reply = F.when(F.col("seq") % 3 == 0, "none").otherwise(F.concat(F.lit("score: "), (1 + F.col("seq") % 5).cast("string")))
    return R.rerank_by_reply(c, reply)


def as_double(name: str, *cols: str) -> None:
    """The SQL form with decimal columns as doubles."""
    SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)}) FROM ({SQL[name]})"


as_double("kb_counts", "avg_norm", "min_norm", "max_norm")
as_double("set_norms", "poincare_norm")
as_double("mass_stats", "min", "max", "median")
as_double("scalar_norms", "by_level", "jump")
