"""Queries on edges, graphs, roles and hierarchies, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery import fixtures as X
from orrery.functions import vectors as V
from orrery.operators import derive as D
from orrery.operators import edges as E
from orrery.operators import graph as G
from orrery.operators import hierarchy as H
from orrery.operators import roles as O
from orrery.operators import store as S
from orrery.operators.scan import similar_pairs
from orrery.plans.q_core import COS, PRE
from orrery.sources.scratch import folder, put

QUERIES, SQL = {}, {}
T = 0.3

PAIRS = PRE + f", pr AS (SELECT a.id AS a, b.id AS b, {COS.format('a.v', 'b.v')} AS sim, a.cluster_id AS ca, b.cluster_id AS cb, a.source_file AS fa, b.source_file AS fb FROM s a JOIN s b ON a.id < b.id), p AS (SELECT * FROM pr WHERE sim > {T})"
BOTH = PAIRS + ", w AS (SELECT a, b, sim, ca, cb FROM p UNION ALL SELECT b, a, sim, cb, ca FROM p)"
SAME = BOTH + ", e1 AS (SELECT a AS src, b AS dst, greatest(0.1, 0.6 * (0.8 + 0.2 * sim)) AS weight FROM w WHERE ca = cb QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 10)"
CROSS = SAME + ", e2 AS (SELECT a AS src, b AS dst, greatest(0.1, 0.3 * (0.7 + 0.3 * sim)) AS weight FROM w WHERE ca <> cb QUALIFY row_number() OVER (PARTITION BY a, cb ORDER BY sim DESC, b) = 1)"
TEMP = CROSS + ", e3 AS (SELECT id AS src, nxt AS dst, 0.12 AS weight FROM (SELECT id, lead(id) OVER (PARTITION BY source_file ORDER BY chunk_index, id) AS nxt FROM s) WHERE nxt IS NOT NULL)"
GRAPH = TEMP + """, ea AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3), em AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(least(1.0, greatest(0.1, weight))) AS weight FROM ea WHERE src <> dst GROUP BY ALL),
g AS (SELECT a AS src, b AS dst, weight FROM em UNION ALL SELECT b, a, weight FROM em)"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _w(df):
    return df.select("src", "dst", F.round("weight", 6).alias("weight"))


def graph(spark, d):
    return E.build(X.spheres(spark, d), threshold=T, with_causal=False)


@query("similar_pairs", PAIRS + " SELECT a, b, round(sim, 6) AS sim FROM p")
def similar(spark, d):
    return similar_pairs(X.spheres(spark, d), T).select("a", "b", F.round("sim", 6).alias("sim"))


@query("edges_same_cluster", SAME + " SELECT src, dst, round(weight, 6) AS weight FROM e1")
def edges_same_cluster(spark, d):
    return _w(E.nearest_edges(X.spheres(spark, d), T)[1])


@query("edges_cross_cluster", CROSS + " SELECT src, dst, round(weight, 6) AS weight FROM e2")
def edges_cross_cluster(spark, d):
    return _w(E.nearest_edges(X.spheres(spark, d), T)[2])


@query("edges_cross_same_file", PAIRS + " SELECT a AS src, b AS dst, CAST(0.2 AS DOUBLE) AS weight FROM p WHERE ca <> cb AND fa = fb")
def edges_cross_same_file(spark, d):
    s = X.spheres(spark, d)
    return _w(E.cross_cluster_same_file(E.pairs(s, T), s))


@query("edges_temporal", TEMP + " SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM e3")
def edges_temporal(spark, d):
    return _w(E.temporal(X.spheres(spark, d)))


@query("edges_all", GRAPH + " SELECT src, dst, round(weight, 6) AS weight FROM g")
def edges_all(spark, d):
    return _w(graph(spark, d))


@query("decay_prune", GRAPH + " SELECT src, dst, round(round(weight, 6) * 0.4, 4) AS weight FROM g WHERE round(round(weight, 6) * 0.4, 4) >= 0.05")
def decay_prune(spark, d):
    g = graph(spark, d).withColumn("weight", F.round("weight", 6))
    return E.prune(E.decay(g, 0.4)).select("src", "dst", "weight")


@query("degree", GRAPH + ", dg AS (SELECT src AS id, count(*) AS n FROM g GROUP BY 1) SELECT s.id, coalesce(n, 0) AS degree FROM s LEFT JOIN dg USING (id)")
def degree(spark, d):
    return E.degree(graph(spark, d), X.spheres(spark, d))


@query("graph_stats", GRAPH + ", dg AS (SELECT src, count(*) AS n FROM g GROUP BY 1) SELECT (SELECT count(*) FROM em) AS edges, round(avg(n), 6) AS avg_degree, max(n) AS max_degree FROM dg")
def graph_stats(spark, d):
    return E.graph_stats(graph(spark, d))


@query("connectivity_top", GRAPH + " SELECT src AS id, count(*) AS degree FROM g GROUP BY 1 ORDER BY degree DESC, id LIMIT 5")
def connectivity_top(spark, d):
    return graph(spark, d).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(5)


@query("calibrate", GRAPH.replace("g AS (SELECT a AS src", "g AS (SELECT a AS src") + """, pos AS (SELECT cluster_id, i, avg(v[i]) AS x FROM s, unnest(generate_series(1, 64)) AS g(i) GROUP BY ALL), cen AS (SELECT cluster_id, list(x ORDER BY i) AS m FROM pos GROUP BY 1),
dg AS (SELECT s.id, s.cluster_id, s.v, coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT src AS id, count(*) AS n FROM g GROUP BY 1) USING (id)),
nw AS (SELECT id, round(1 + 0.3 * least(n / greatest((SELECT avg(n) FROM dg), 1.0), 3.0), 4) AS m, round(1 - least(1.0, greatest(0.0, (""" + COS.format("v", "cen.m") + """ + 1) / 2)), 4) AS d FROM dg JOIN cen USING (cluster_id)),
f AS (SELECT id, CASE WHEN abs(m - 1) > 0.01 THEN m ELSE 1.0 END AS mass, CASE WHEN abs(d) > 0.01 THEN d ELSE 0.0 END AS diversity FROM nw)
SELECT id, mass, diversity, round(mass * (1 + diversity), 6) AS effective_mass FROM f""")
def calibrate(spark, d):
    return D.calibrate(X.spheres(spark, d), graph(spark, d))


@query("radius", GRAPH + """, dg AS (SELECT s.id, s.seq, s.v, coalesce(n, 0) AS n FROM s LEFT JOIN (SELECT src AS id, count(*) AS n FROM g GROUP BY 1) USING (id)),
ips AS (SELECT a.id, list_inner_product(a.v, b.v) AS ip, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC) AS rn FROM s a, s b), den AS (SELECT id, avg(ip) AS m FROM ips WHERE rn BETWEEN 2 AND 20 GROUP BY 1),
r AS (SELECT id, CAST(0.5 AS DOUBLE) AS h, round(least(0.8, greatest(0.15, 0.8 - 0.65 * n / (SELECT max(n) FROM dg))), 6) AS u, round(least(0.8, greatest(0.15, 0.8 - 0.65 * least(1.0, greatest(0.0, (m + 1) / 2)))), 6) AS d,
 round(least(0.9, greatest(0.05, 0.25 * 0.5 + 0.25 * least(0.8, greatest(0.15, 0.8 - 0.65 * n / (SELECT max(n) FROM dg))) + 0.5 * least(0.8, greatest(0.15, 0.8 - 0.65 * least(1.0, greatest(0.0, (m + 1) / 2)))))), 4) AS radius FROM dg JOIN den USING (id)) SELECT * FROM r""")
def radius(spark, d):
    s = X.spheres(spark, d).withColumn("level", F.lit(2)).withColumn("parent_id", F.lit(""))
    return D.radius(s, graph(spark, d))


@query("level_norms", "WITH t AS (SELECT doc_id, 1 + doc_id % 3 AS level, doc_id // 2 AS p FROM documents), n AS (SELECT doc_id, level, CASE level WHEN 1 THEN 0.15 WHEN 2 THEN 0.5 ELSE 0.8 END AS own, p FROM t) SELECT CAST(a.doc_id AS VARCHAR) AS id, CAST(CASE WHEN a.level = 2 AND b.own IS NOT NULL THEN (a.own + b.own) / 2 ELSE a.own END AS DOUBLE) AS h FROM n a LEFT JOIN n b ON b.doc_id = a.p")
def level_norms(spark, d):
    i = F.col("doc_id")
    return D.level_norm(X.read(spark, d, "documents").select(i.cast("string").alias("id"), (1 + i % 3).alias("level"), F.floor(i / 2).cast("string").alias("parent_id")))


@query("navigate", GRAPH + """, gf AS (SELECT src, dst, weight FROM g WHERE weight >= 0.12), h1 AS (SELECT dst AS id, max(weight) AS weight FROM gf WHERE src = '5' AND dst <> '5' GROUP BY 1), h2 AS (SELECT dst AS id, max(gf.weight) AS weight FROM gf JOIN h1 ON gf.src = h1.id WHERE dst <> '5' AND dst NOT IN (SELECT id FROM h1) GROUP BY 1)
SELECT id, 1 AS depth, round(weight, 6) AS weight FROM h1 UNION ALL SELECT id, 2, round(weight, 6) FROM h2""")
def navigate(spark, d):
    return G.navigate(graph(spark, d), "5", least=0.12).withColumn("weight", F.round("weight", 6))


@query("bridge", GRAPH + """, b AS (SELECT '5' AS node, ['5'] AS path, 0 AS n UNION ALL SELECT * FROM (SELECT dst, list_append(path, dst), n + 1 FROM b JOIN g ON g.src = b.node WHERE n < 4 AND NOT list_contains(path, dst))),
m AS (SELECT min(n) AS n FROM b WHERE node = '37') SELECT '5' AS a, '37' AS b, true AS found, CAST(n AS INTEGER) AS length FROM m""")
def bridge(spark, d):
    return G.bridge(graph(spark, d), "5", "37").select("a", "b", "found", "length")


ACTIVATION = GRAPH + """, gg AS (SELECT src, dst, round(weight, 6) AS weight FROM g), sd AS (SELECT * FROM (VALUES ('5', 1.0::DOUBLE), ('9', 0.6::DOUBLE), ('12', 0.01::DOUBLE)) z(id, a)),
h1 AS (SELECT dst AS id, sum(a * weight * 0.5) AS a FROM sd JOIN gg ON gg.src = sd.id WHERE a >= 0.05 AND a * weight * 0.5 >= 0.02 AND dst NOT IN (SELECT id FROM sd) GROUP BY 1),
h2 AS (SELECT dst AS id, sum(a * weight * 0.5) AS a FROM h1 JOIN gg ON gg.src = h1.id WHERE a * weight * 0.5 >= 0.02 AND dst NOT IN (SELECT id FROM sd UNION SELECT id FROM h1) GROUP BY 1),
al AS (SELECT * FROM sd UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)"""


@query("activation", ACTIVATION + " SELECT id, round(a / (SELECT max(a) FROM al), 4) AS activation FROM al")
def activation(spark, d):
    return G.activation(graph(spark, d).withColumn("weight", F.round("weight", 6)), {"5": 1.0, "9": 0.6, "12": 0.01})


_TRACTION = GRAPH + """, sd AS (SELECT id FROM c ORDER BY ip DESC, id LIMIT 10), pl AS (SELECT src AS id, sum(weight) AS w FROM g WHERE weight >= 0.15 AND dst IN (SELECT id FROM sd) GROUP BY 1)
SELECT c.id, ip AS s0, ip + 0.1 * least(0.5, coalesce(w, 0) / 10) * (SELECT max(ip) - min(ip) FROM c) AS b0 FROM c LEFT JOIN pl USING (id)"""


@query("traction", "SELECT id, round(s0, 6) AS score, round(b0, 6) AS boosted FROM (" + _TRACTION + ")")
def traction(spark, d):
    return _traction(spark, d).select("id", F.round("score", 6).alias("score"), F.round("boosted", 6).alias("boosted"))


def _traction(spark, d):
    from orrery.operators.retrieve import candidates

    c = candidates(X.spheres(spark, d), X.query_vector(spark, d)).select("id", F.col("ip").alias("score"))
    return G.traction(c, graph(spark, d), c.orderBy(F.desc("score"), "id").limit(10))


@query("traction_movement", "SELECT round(avg(m), 6) AS avg_move, count(*) FILTER (m > 0) AS moved_up, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY s0 DESC, id) - row_number() OVER (ORDER BY b0 DESC, id) AS m FROM (" + _TRACTION + "))")
def traction_movement(spark, d):
    return G.movement(_traction(spark, d))


@query("explore", GRAPH + ", t AS (SELECT id, seq, text, source_file, CAST(1 + seq % 7 AS DOUBLE) AS effective_mass FROM s WHERE cluster_id = 3 ORDER BY effective_mass DESC, seq LIMIT 30) SELECT t.id, substr(text, 1, 150) AS preview, source_file, effective_mass, (SELECT count(*) FROM g WHERE src = t.id) AS connections, seq FROM t")
def explore(spark, d):
    s = X.spheres(spark, d).withColumn("effective_mass", (1 + F.col("seq") % 7).cast("double"))
    return G.explore(s, graph(spark, d), 3)


@query("explore_edges", GRAPH + ", t AS (SELECT id FROM s WHERE cluster_id = 3 ORDER BY seq LIMIT 10) SELECT src, dst, round(weight, 6) AS weight FROM (SELECT * FROM g WHERE src IN (SELECT id FROM t) QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 5) WHERE weight > 0.2")
def explore_edges(spark, d):
    ids = X.spheres(spark, d).where("cluster_id = 3").orderBy("seq").limit(10)
    return _w(G.top_edges(graph(spark, d), ids))


@query("trace_chunks", PRE + " SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS index, id, substr(text, 1, 200) AS preview, cluster_id FROM s WHERE source_file = 'src3'")
def trace_chunks(spark, d):
    return G.trace(X.spheres(spark, d), graph(spark, d), "src3")[0]


@query("trace_edges", GRAPH + ", t AS (SELECT * FROM g WHERE src IN (SELECT id FROM s WHERE source_file = 'src3') QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 5) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, round(weight, 6) AS weight FROM t WHERE weight > 0.15")
def trace_edges(spark, d):
    return G.trace(X.spheres(spark, d), graph(spark, d), "src3")[1].withColumn("weight", F.round("weight", 6))


_STEP = "v{n} AS (SELECT g.src, l.label, count(*) AS c, any_value(o.label) AS own FROM g JOIN l{p} l ON l.id = g.dst JOIN l{p} o ON o.id = g.src GROUP BY g.src, l.label), l{n} AS (SELECT src AS id, label FROM v{n} QUALIFY row_number() OVER (PARTITION BY src ORDER BY c DESC, (label <> own), label) = 1)"


@query("label_propagation", GRAPH + ", l0 AS (SELECT DISTINCT src AS id, src AS label FROM g), " + ", ".join(_STEP.format(n=i, p=i - 1) for i in (1, 2, 3)) + " SELECT id, label FROM l3")
def label_propagation(spark, d):
    return G.label_propagation(graph(spark, d), 3)


@query("edge_upsert", GRAPH + ", x AS (SELECT src, dst, weight FROM g WHERE src < dst) SELECT src, dst, round(CASE WHEN CAST(src AS INTEGER) % 5 = 0 THEN -0.5 ELSE weight END, 6) AS weight FROM g")
def edge_upsert(spark, d):
    g = put(graph(spark, d), f"{folder(spark, 'upsert')}/graph")  # both sides of the join read it
    return _w(S.upsert_edges(g, g.where(F.col("src").cast("int") % 5 == 0).select("src", "dst", F.lit(-0.5).alias("weight"))))


@query("delete_sphere", GRAPH + " SELECT count(*) AS edges, (SELECT count(*) FROM embeddings WHERE vec_id % 10 <> 0) AS vectors FROM g WHERE CAST(src AS INTEGER) % 10 <> 0 AND CAST(dst AS INTEGER) % 10 <> 0")
def delete_sphere(spark, d):
    s = X.spheres(spark, d).withColumn("active", F.lit(True)).withColumn("poincare_norm", F.lit(0.5)).withColumn("poincare_norm_source", F.lit("default"))
    _, v, e = S.delete(s, X.vectors(spark, d), graph(spark, d), X.vectors(spark, d).where(F.col("id").cast("int") % 10 == 0))
    return e.agg(F.count(F.lit(1)).alias("edges")).crossJoin(v.agg(F.count(F.lit(1)).alias("vectors")))


@query("edge_types", GRAPH + " SELECT src, dst, round(weight, 6) AS weight, 'dendrite' AS type FROM g")
def edge_types(spark, d):
    return E.connection_type(graph(spark, d)).withColumn("weight", F.round("weight", 6))


@query("incremental_edges", PRE + f", x AS (SELECT a.id AS src, b.id AS dst, {COS.format('a.v', 'b.v')} AS sm, a.cluster_id = b.cluster_id AS same, a.source_file = b.source_file AS f FROM s a JOIN s b ON a.seq % 20 = 1 AND b.seq % 20 <> 1), w AS (SELECT src, dst, CASE WHEN same AND sm > 0.3 THEN 0.6 * (0.7 + 0.3 * sm) WHEN NOT same AND sm > 0.3 THEN 0.3 * (0.6 + 0.4 * sm) WHEN f THEN 0.06 END AS weight FROM x) SELECT src, dst, round(weight, 6) AS weight FROM w WHERE weight >= 0.1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 50")
def incremental_edges(spark, d):
    s = X.spheres(spark, d)
    return _w(E.incremental(s.where("seq % 20 = 1"), s.where("seq % 20 <> 1"), same=0.3, other=0.3))


# -- roles: tokens of six letters and more stand for entities, their length for their role --------------------------

MEN = """WITH w0 AS (SELECT CAST(doc_id AS VARCHAR) AS sphere_id, regexp_extract_all(lower(text), '[a-z]{6,}') AS l FROM documents),
m AS (SELECT sphere_id, i AS seq, l[i] AS entity_text, md5(l[i])[1:8] AS entity_id, CASE WHEN len(l[i]) >= 9 THEN 'phrase' WHEN len(l[i]) >= 7 THEN 'head' ELSE 'attributive' END AS role FROM w0, unnest(generate_series(1, len(l))) g(i)),
en AS (SELECT entity_id, min(entity_text) AS entity_text, count(*) AS occurrences, count(DISTINCT sphere_id) FILTER (role = 'phrase') AS n_phrase, count(DISTINCT sphere_id) FILTER (role = 'head') AS n_head, count(DISTINCT sphere_id) FILTER (role = 'attributive') AS n_attr FROM m GROUP BY 1),
fs AS (SELECT sphere_id, entity_id, min(seq) AS f FROM m GROUP BY ALL), co AS (SELECT fs.entity_id, m.entity_id AS other_id, count(*) AS cnt FROM fs JOIN m USING (sphere_id) WHERE fs.entity_id <> m.entity_id AND f < seq GROUP BY ALL),
ds AS (SELECT DISTINCT sphere_id, entity_id FROM m)"""


def _mentions(spark, d):
    t = X.read(spark, d, "documents")
    t = t.select(F.col("doc_id").cast("string").alias("sphere_id"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), 0)).alias("p", "w"))
    n = F.length("w")
    return O.from_rows(t.select("sphere_id", F.col("w").alias("text"), F.when(n >= 9, "phrase").when(n >= 7, "head").otherwise("attributive").alias("role"), F.col("p").alias("order")))


@query("entities", MEN + " SELECT * FROM en")
def entities(spark, d):
    return O.entities(_mentions(spark, d))


@query("role_stats", MEN + " SELECT count(*) AS entities, count(*) FILTER (occurrences >= 2) AS active, CAST(sum(occurrences) AS BIGINT) AS occurrences, (SELECT count(DISTINCT sphere_id) FROM m) AS spheres FROM en")
def role_stats(spark, d):
    return O.stats(_mentions(spark, d))


@query("role_distribution", MEN + " SELECT entity_id, n_phrase AS phrase, n_head AS head, n_attr AS attributive FROM en")
def role_distribution(spark, d):
    return O.distribution(_mentions(spark, d))


@query("cooccurrence", MEN + " SELECT entity_id, other_id, cnt, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY cnt DESC, other_id) AS INTEGER) AS rank FROM co WHERE cnt >= 2 QUALIFY rank <= 10")
def cooccurrence(spark, d):
    w = Window.partitionBy("entity_id").orderBy(F.desc("cnt"), "other_id")
    return O.cooccurrence(_mentions(spark, d), least=2, top=10).withColumn("rank", F.row_number().over(w))


@query("shared_entities", MEN + " SELECT DISTINCT entity_text FROM m WHERE entity_id IN (SELECT entity_id FROM ds WHERE sphere_id = '3' INTERSECT SELECT entity_id FROM ds WHERE sphere_id = '8')")
def shared_entities(spark, d):
    return O.shared(_mentions(spark, d), "3", "8")


_OK = MEN + """, cf AS (SELECT entity_id, least(0.95, greatest(0.3, 0.5 + CASE WHEN occurrences >= 5 THEN 0.2 WHEN occurrences >= 3 THEN 0.1 ELSE 0 END + 0.08 * ((n_phrase > 0)::INT + (n_head > 0)::INT + (n_attr > 0)::INT))) AS j FROM en WHERE occurrences >= 2),
dd AS (SELECT DISTINCT sphere_id, entity_id, role, round(CASE role WHEN 'phrase' THEN 1.0 WHEN 'head' THEN 0.6 ELSE 0.4 END * j, 6) AS confidence FROM m JOIN cf USING (entity_id)), ok AS (SELECT * FROM dd WHERE confidence >= 0.3)"""


@query("role_expand", _OK + """
SELECT a.sphere_id AS source, b.sphere_id AS target, a.entity_id, a.role, CAST(a.confidence AS DOUBLE) AS confidence FROM ok a JOIN ok b ON a.entity_id = b.entity_id AND a.role = b.role AND a.sphere_id <> b.sphere_id
QUALIFY row_number() OVER (PARTITION BY a.sphere_id ORDER BY a.confidence DESC, b.sphere_id, a.entity_id, a.role) <= 10""")
def role_expand(spark, d):
    return O.expand(_mentions(spark, d))


@query("edges_entity_overlap", MEN + ", n AS (SELECT sphere_id, count(*) AS n FROM ds GROUP BY 1), b AS (SELECT x.sphere_id AS a, y.sphere_id AS b, count(*) AS c FROM ds x JOIN ds y ON x.entity_id = y.entity_id AND x.sphere_id < y.sphere_id GROUP BY ALL HAVING count(*) >= 2) SELECT a AS src, b AS dst, round(least(0.4, greatest(0.1, 0.4 * (0.6 + 0.4 * c / (na.n + nb.n - c)))), 6) AS weight FROM b JOIN n na ON na.sphere_id = a JOIN n nb ON nb.sphere_id = b")
def edges_entity_overlap(spark, d):
    return _w(E.entity_overlap(_mentions(spark, d)))


@query("edges_role_bridge", MEN + ", ph AS (SELECT DISTINCT entity_id, sphere_id FROM m WHERE role = 'phrase') SELECT x.sphere_id AS src, y.sphere_id AS dst, round(greatest(0.1, 0.35 * least(1.0, cnt / 6)), 6) AS weight FROM co JOIN ph x ON x.entity_id = co.entity_id JOIN ph y ON y.entity_id = co.other_id WHERE cnt >= 3 AND co.entity_id < co.other_id AND x.sphere_id < y.sphere_id")
def edges_role_bridge(spark, d):
    m = _mentions(spark, d)
    phrases = m.join(m.where("role = 'phrase'").select("entity_id").distinct(), "entity_id", "left_semi")  # no other entity is in a bridge
    return _w(E.role_bridge(O.cooccurrence(phrases, least=3), m))


@query("entity_graph", MEN + " SELECT DISTINCT x.sphere_id AS a, y.sphere_id AS b FROM ds x JOIN ds y ON x.entity_id = y.entity_id AND x.sphere_id < y.sphere_id")
def entity_graph(spark, d):
    return E.entity_edges(_mentions(spark, d))


@query("expand_entities", MEN + ", r AS (SELECT sphere_id, min(CASE entity_text WHEN 'ertion' THEN 1 ELSE 2 END) AS o FROM m WHERE entity_text IN ('ertion', 'thtion') GROUP BY 1) SELECT sphere_id AS target, CASE o WHEN 1 THEN 'ertion' ELSE 'thtion' END AS entity, CAST(0.5 AS DOUBLE) AS confidence FROM r ORDER BY o, sphere_id LIMIT 10")
def expand_entities(spark, d):
    return O.expand_entities(_mentions(spark, d), ["ertion", "thtion"])


@query("key_entities", MEN + """, k AS (SELECT sphere_id, entity_text AS t, occurrences * coalesce(c, 0) AS k FROM ds JOIN en USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS c FROM co GROUP BY 1) USING (entity_id)),
l AS (SELECT sphere_id, list([t] ORDER BY k DESC, t) AS l FROM k GROUP BY 1)
SELECT sphere_id, array_to_string(list_reduce(l, lambda acc, x: CASE WHEN len(acc) < 5 AND len(list_filter(acc, lambda y: contains(y, x[1]) OR contains(x[1], y))) = 0 THEN list_concat(acc, x) ELSE acc END), '|') AS entities FROM l""")
def key_entities(spark, d):
    return O.key_entities(_mentions(spark, d)).select("sphere_id", F.array_join("entities", "|").alias("entities"))


@query("expand_pool", _OK + """, ht AS (SELECT DISTINCT sphere_id AS id, 1 / (1 + CAST(sphere_id AS INTEGER)) AS score FROM m WHERE CAST(sphere_id AS INTEGER) % 50 = 0),
t10 AS (SELECT a.sphere_id AS source, b.sphere_id AS target, a.entity_id, a.role, a.confidence FROM ok a JOIN ht ON ht.id = a.sphere_id JOIN ok b ON a.entity_id = b.entity_id AND a.role = b.role AND a.sphere_id <> b.sphere_id QUALIFY row_number() OVER (PARTITION BY a.sphere_id ORDER BY a.confidence DESC, b.sphere_id, a.entity_id, a.role) <= 10),
t3 AS (SELECT t10.*, score FROM t10 JOIN ht ON ht.id = source WHERE target NOT IN (SELECT id FROM ht) QUALIFY row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target, entity_id, role) <= 3)
SELECT target AS id, round(max(score * confidence * 0.6), 6) AS score FROM t3 GROUP BY 1 ORDER BY max(score * confidence * 0.6) DESC, id LIMIT 20""")
def expand_pool(spark, d):
    m = _mentions(spark, d)
    hits = m.select(F.col("sphere_id").alias("id")).distinct().where("cast(id as int) % 50 = 0").withColumn("score", 1 / (1 + F.col("id").cast("int")))
    return O.expand_pool(m, hits).withColumn("score", F.round("score", 6))


# -- hierarchy ----------------------------------------------------------------------------------------------------

_COM = MEN + ", cm AS (SELECT DISTINCT sphere_id AS id, CAST(sphere_id AS INTEGER) % 6 AS community FROM m), sz AS (SELECT community, count(*) AS size FROM cm GROUP BY 1 HAVING count(*) >= 5), sj AS (SELECT cm.community, entity_text AS subject, count(DISTINCT cm.id) AS freq, any_value(size) AS size FROM cm JOIN sz USING (community) JOIN m ON m.sphere_id = cm.id AND role = 'phrase' GROUP BY ALL)"


def _communities(spark, d):
    return _mentions(spark, d).select(F.col("sphere_id").alias("id")).distinct().withColumn("community", F.col("id").cast("int") % 6)


@query("community_subjects", _COM + " SELECT community, subject, freq, size FROM sj WHERE freq >= 3")
def community_subjects(spark, d):
    return H.subjects(_communities(spark, d), _mentions(spark, d)).where("freq >= 3")


_CON = _COM + """, cc AS (SELECT *, 'c_' || md5('concept:' || lower(trim(subject)))[1:8] AS id FROM (SELECT * FROM sj WHERE freq >= greatest(2, floor(size * 0.02)) QUALIFY row_number() OVER (PARTITION BY community ORDER BY freq DESC, subject) <= 3)),
o AS (SELECT * FROM cc QUALIFY row_number() OVER (PARTITION BY id ORDER BY community, subject) = 1), kd AS (SELECT DISTINCT o.id AS concept, o.community, o.freq, substr(subject, 1, 80) AS t, m.sphere_id AS child FROM o JOIN cm USING (community) JOIN m ON m.sphere_id = cm.id AND lower(m.entity_text) = lower(o.subject))"""


@query("concepts", _CON + """, k AS (SELECT o.id, count(DISTINCT m.sphere_id) AS n FROM o JOIN cm USING (community) JOIN m ON m.sphere_id = cm.id AND lower(m.entity_text) = lower(o.subject) GROUP BY 1)
SELECT o.id, substr(subject, 1, 80) AS text, community, freq, CAST(n AS INTEGER) AS children, CAST(round(1 + 0.1 * n, 6) AS DOUBLE) AS mass FROM o JOIN k USING (id)""")
def concepts(spark, d):
    c = H.concepts(_communities(spark, d), _mentions(spark, d), coverage=0.02)
    return c.select("id", "text", "community", "freq", F.size("child_ids").alias("children"), F.round("mass", 6).alias("mass"))


@query("concept_parents", _CON + " SELECT child AS id, concept AS parent_id FROM kd QUALIFY row_number() OVER (PARTITION BY child ORDER BY community, freq DESC, t, concept) = 1")
def concept_parents(spark, d):
    return H.parents(H.concepts(_communities(spark, d), _mentions(spark, d), coverage=0.02))


@query("incremental_graph", PAIRS.replace(f"sim > {T}", "sim > 0.25") + " SELECT a, b FROM p WHERE CAST(a AS INTEGER) % 10 = 0 OR CAST(b AS INTEGER) % 10 = 0")
def incremental_graph(spark, d):
    s = X.spheres(spark, d)
    return H.incremental_edges(s, H.added(s, s.where("seq % 10 <> 0")), threshold=0.25)


_GROW = (
    PAIRS.replace(f"sim > {T}", "sim > 0.25") + MEN.replace("WITH w0", ", w0", 1)
    + ", eg AS (SELECT a, b FROM p UNION SELECT x.sphere_id, y.sphere_id FROM ds x JOIN ds y ON x.entity_id = y.entity_id AND x.sphere_id < y.sphere_id), g AS (SELECT a AS src, b AS dst FROM eg UNION ALL SELECT b, a FROM eg), l0 AS (SELECT DISTINCT src AS id, src AS label FROM g), "
    + ", ".join(_STEP.format(n=i, p=i - 1) for i in (1, 2, 3))
    + _COM[len(MEN) :].replace("cm AS (SELECT DISTINCT sphere_id AS id, CAST(sphere_id AS INTEGER) % 6 AS community FROM m)", "cm AS (SELECT id, label AS community FROM l3)").replace("HAVING count(*) >= 5", "HAVING count(*) >= 3")
)


@query("grow_hierarchy", _GROW + _CON[len(_COM) :].replace("size * 0.02", "size * 0.01") + " SELECT id, substr(subject, 1, 80) AS text, community, freq FROM o WHERE id IN (SELECT concept FROM kd)")
def grow_hierarchy(spark, d):
    c, k = H.grow(X.spheres(spark, d), _mentions(spark, d), threshold=0.25, rounds=3, least=3, coverage=0.01)
    return k.select("id", "text", "community", "freq")


@query("split_concepts")
def split_concepts(spark, d):
    k = H.concepts(_communities(spark, d), _mentions(spark, d), coverage=0.02)
    return H.split_concepts(k, X.vectors(spark, d))


@query("concept_centroids", _CON + ", x AS (SELECT concept, i, avg(CAST(embedding[i] AS DOUBLE)) AS a, count(*) AS n FROM kd JOIN embeddings ON CAST(vec_id AS VARCHAR) = child, unnest(generate_series(1, 64)) g(i) WHERE vec_id IN (SELECT doc_id FROM documents) GROUP BY ALL) SELECT concept, round(sqrt(sum(a * a)), 6) AS norm, max(n) AS n FROM x GROUP BY 1")
def concept_centroids(spark, d):
    from orrery.operators.cluster import concept_centroids as cc

    k = H.concepts(_communities(spark, d), _mentions(spark, d), coverage=0.02)
    return cc(k, X.spheres(spark, d)).select("concept", F.round(V.norm(F.col("centroid")), 6).alias("norm"), "n")
