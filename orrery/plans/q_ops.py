"""Queries on accessors, small text functions and jobs that no other query reaches, with their SQL forms."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from orrery import fixtures as X
from orrery import schema
from orrery.functions import lexicon as L
from orrery.functions import text as T
from orrery.functions import vectors as V
from orrery.operators import derive as D
from orrery.operators import edges as E
from orrery.operators import graph as G
from orrery.operators import hierarchy as H
from orrery.operators import retrieve as R
from orrery.operators import roles as O
from orrery.operators import store as S
from orrery.plans.q_core import PRE
from orrery.plans.q_graph import _OK, _STEP, CROSS, GRAPH, MEN, PAIRS, T as SIM, _mentions, graph
from orrery.sources.tables import Store

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _docs(spark, d):
    return X.read(spark, d, "documents")


def _spheres(spark, d):
    return schema.complete(_docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("source_file"), F.col("lang").alias("source_type")))


# -- accessors ----------------------------------------------------------------------------------------------------


@query("point_get", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_file, lang AS source_type, CAST(len(text) AS INTEGER) AS n FROM documents WHERE doc_id = 5")
def point_get(spark, d):
    return S.get(_spheres(spark, d), "5").select("id", "source_file", "source_type", F.length("text").alias("n"))


@query("document_detail", "SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_file, CAST(1.0 AS DOUBLE) AS mass, CAST(2 AS INTEGER) AS level, CAST(0.5 AS DOUBLE) AS poincare_norm, true AS active FROM documents WHERE doc_id = 7")
def document_detail(spark, d):
    return S.get(_spheres(spark, d), "7").select("id", "source_file", "mass", "level", "poincare_norm", "active")


@query("neighbours", GRAPH + " SELECT dst, round(weight, 6) AS weight FROM g WHERE src = '5'")
def neighbours(spark, d):
    return S.neighbours(graph(spark, d), "5").select("dst", F.round("weight", 6).alias("weight"))


@query("edge_weight", GRAPH + " SELECT round(coalesce((SELECT max(weight) FROM g WHERE src = '5' AND dst = (SELECT min(dst) FROM g WHERE src = '5')), 0), 6) AS there, CAST(0.0 AS DOUBLE) AS absent")
def edge_weight(spark, d):
    g = graph(spark, d)
    first = S.neighbours(g, "5").agg(F.min("dst")).first()[0]
    there = S.weight(g, "5", first or "").select(F.round("weight", 6).alias("there"))
    return there.crossJoin(S.weight(g, "5", "no such id").select(F.col("weight").alias("absent")))


@query("connections_of_all", GRAPH + " SELECT src AS id, string_agg(dst || '=' || printf('%.6f', weight), ',' ORDER BY dst) AS edges FROM g GROUP BY src")
def connections_of_all(spark, d):
    m = graph(spark, d).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("l"))
    return m.select("id", F.array_join(F.transform("l", lambda x: F.format_string("%s=%.6f", x["dst"], x["weight"])), ",").alias("edges"))


@query("retrieve_focus", PRE + ", t AS (SELECT id, source_file, list_inner_product(q, v) AS ip FROM s, q WHERE source_type = 'fr' ORDER BY ip DESC, id LIMIT 50), w AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY -ip, id) AS rn FROM t) SELECT id, source_file, round(-ip, 6) AS dist, CAST(row_number() OVER (ORDER BY -ip, id) AS INTEGER) AS rank FROM (SELECT * FROM w WHERE rn <= 3 ORDER BY -ip, id LIMIT 10)")
def retrieve_focus(spark, d):
    s = X.spheres(spark, d).where("source_type = 'fr'")
    return R.retrieve(s, X.query_vector(spark, d), mode="cosine").select("id", "source_file", F.round("dist", 6).alias("dist"), "rank")


@query("reset_levels", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(2 AS INTEGER) AS level, '' AS parent_id FROM documents WHERE 1 + doc_id % 3 <> 1")
def reset_levels(spark, d):
    i = F.col("doc_id")
    return H.reset(_docs(spark, d).select(i.cast("string").alias("id"), (1 + i % 3).cast("int").alias("level"), (i - 1).cast("string").alias("parent_id")))


@query("expansion_stats", _OK + ", ht AS (SELECT DISTINCT sphere_id AS id FROM m WHERE CAST(sphere_id AS INTEGER) % 50 = 0), j AS (SELECT a.sphere_id AS source FROM ok a JOIN ht ON ht.id = a.sphere_id JOIN ok b ON a.entity_id = b.entity_id AND a.role = b.role AND a.sphere_id <> b.sphere_id QUALIFY row_number() OVER (PARTITION BY a.sphere_id ORDER BY a.confidence DESC, b.sphere_id, a.entity_id, a.role) <= 10) SELECT (SELECT count(*) FROM ht) AS hits, count(DISTINCT source) AS with_jumps, count(*) AS jumps FROM j")
def expansion_stats(spark, d):
    m = _mentions(spark, d)
    hits = m.select(F.col("sphere_id").alias("id")).distinct().where("cast(id as int) % 50 = 0")
    return O.expansion_stats(O.expand(m, hits), hits)


@query("entity_timeline", MEN + ", c AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS INTEGER) AS index FROM documents JOIN embeddings ON doc_id = vec_id WHERE source = 'src3') SELECT entity_text, array_to_string(list(index ORDER BY index), ',') AS at FROM (SELECT DISTINCT index, entity_text FROM c JOIN m ON m.sphere_id = c.id) GROUP BY 1")
def entity_timeline(spark, d):
    s = X.spheres(spark, d)
    chunks = G.trace(s, E.temporal(s), "src3")[0]
    return G.entity_timeline(chunks, _mentions(spark, d)).select("entity_text", F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("at"))


@query("connection_table", CROSS + f", e3 AS (SELECT id AS src, lead(id) OVER (PARTITION BY source_file ORDER BY chunk_index, id) AS dst FROM s) SELECT rule, count(*) AS n, round(sum(weight), 4) AS weight FROM (SELECT 'same_cluster' AS rule, weight FROM e1 UNION ALL SELECT 'cross_cluster', weight FROM e2 UNION ALL SELECT 'cross_cluster_same_file', 0.2 FROM p WHERE ca <> cb AND fa = fb UNION ALL SELECT 'temporal', 0.12 FROM e3 WHERE dst IS NOT NULL) GROUP BY rule")
def connection_table(spark, d):
    return E.connection_table(X.spheres(spark, d), SIM).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


# -- small text functions -------------------------------------------------------------------------------------------


_CJK = "甲乙丙丁。戊己庚辛！壬癸；子丑寅卯辰巳?午"


@query("sentences_cjk", f"WITH t AS (SELECT doc_id, concat(text, '{_CJK}') AS t FROM documents) SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(t, '([。！？.!?])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(trim(s, ' ' || chr(10) || chr(9) || chr(13))) > 3)) AS INTEGER) AS n, CAST(len(list_filter(string_split(regexp_replace(t, '([。！？.!?;；])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(trim(s, ' ' || chr(10) || chr(9) || chr(13))) > 5)) AS INTEGER) AS n_svo FROM t")
def sentences_cjk(spark, d):
    t = F.concat("text", F.lit(_CJK))
    return _docs(spark, d).select("doc_id", F.size(T.sentences_cjk(t)).alias("n"), F.size(T.sentences_cjk(t, 5, True)).alias("n_svo"))


_FORMS = [(c, a) for c, al in L.ALIASES.items() for a in al]
_FORM_LIST = "[" + ", ".join("'" + a.replace("'", "''").upper() + "'" for _, a in _FORMS) + ", 'something else']"
_FORM_ROWS = "(VALUES " + ", ".join(f"('{c}', '{a.lower()}')" for c, al in L.ALIASES.items() for a in dict.fromkeys([c, *al])) + ") z(c, a)"


@query("canonical_entities", f"WITH d AS (SELECT doc_id, {_FORM_LIST}[doc_id % {len(_FORMS) + 1} + 1] AS e FROM documents) SELECT doc_id, coalesce((SELECT any_value(c) FROM {_FORM_ROWS} WHERE a = lower(e)), e) AS entity FROM d")
def canonical_entities(spark, d):
    forms = F.array(*[F.lit(a.upper()) for _, a in _FORMS], F.lit("something else"))
    e = F.element_at(forms, (F.col("doc_id") % (len(_FORMS) + 1) + 1).cast("int"))
    return _docs(spark, d).select("doc_id", T.canonical(e).alias("entity"))


@query("context_lines", "SELECT conv_id, turn, format('[第{}段] {} | {}' || chr(10) || '  主题: {}' || chr(10) || '  摘要: {}', turn, role, conv_id, role || ', ' || turn, substr(text, 1, 40)) AS line FROM conversations")
def context_lines(spark, d):
    c = X.read(spark, d, "conversations")
    line = T.context_line(F.col("turn"), F.col("role"), F.col("conv_id").cast("string"), F.array("role", F.col("turn").cast("string")), F.substring("text", 1, 40))
    return c.select("conv_id", "turn", line.alias("line"))


@query("doc_terms_fallback", "WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(substr(replace(text, '. ', '。'), 1, 500), '。'), lambda x: trim(x)), lambda x: len(x) > 5)[1:3] AS l FROM documents) SELECT doc_id, array_to_string(l, '|') AS terms FROM d")
def doc_terms_fallback(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.doc_terms_fallback(F.replace("text", F.lit(". "), F.lit("。"))), "|").alias("terms"))


@query("default_types", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN '技术笔记' ELSE '其他' END AS source_type FROM documents")
def default_types(spark, d):
    i = F.col("doc_id") % 3
    return _docs(spark, d).select("doc_id", T.default_type(F.when(i == 0, F.col("lang")).when(i == 1, "").otherwise(None), T.headings(F.when(i == 1, F.concat(F.lit("# "), "text")).otherwise(F.concat(F.lit("x "), "lang")))).alias("source_type"))


@query("json_replies", """WITH d AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '{"turn": ' || turn || '}' WHEN 1 THEN 'Here: ```json' || chr(10) || '{"role": "' || role || '"}' || chr(10) || '``` ok' WHEN 2 THEN '``` {"turn": ' || turn || '} ```' ELSE 'no ' || role END AS r FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN r WHEN 3 THEN NULL ELSE regexp_extract(r, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) END AS reply FROM d""")
def json_replies(spark, d):
    t = F.col("turn")
    r = F.when(t % 4 == 0, F.concat(F.lit('{"turn": '), t, F.lit("}"))).when(t % 4 == 1, F.concat(F.lit('Here: ```json\n{"role": "'), "role", F.lit('"}\n``` ok'))).when(t % 4 == 2, F.concat(F.lit('``` {"turn": '), t, F.lit("} ```"))).otherwise(F.concat(F.lit("no "), "role"))
    return X.read(spark, d, "conversations").select("conv_id", "turn", T.json_of_reply(r).alias("reply"))


@query("file_names", "SELECT doc_id, substr(regexp_replace(concat(source, '/', lang, ': \"', text, '\" <1>|2*?'), '[\\\\/:*?\"<>|]', '_', 'g'), 1, 100) AS name FROM documents")
def file_names(spark, d):
    return _docs(spark, d).select("doc_id", T.file_name(F.concat("source", F.lit("/"), "lang", F.lit(': "'), "text", F.lit('" <1>|2*?'))).alias("name"))


@query("query_norms", "SELECT conv_id, turn, least(0.9, greatest(0.1, 0.9 - 0.05 * len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')))) :: DOUBLE AS norm FROM conversations")
def query_norms(spark, d):
    return X.read(spark, d, "conversations").select("conv_id", "turn", F.round(T.query_norm(F.col("text")), 9).alias("norm"))


@query("cluster_labels", "SELECT vec_id, CASE label WHEN 1 THEN 'one' WHEN 3 THEN 'three' ELSE '簇' || label END AS name FROM embeddings")
def cluster_labels(spark, d):
    return X.read(spark, d, "embeddings").select("vec_id", T.cluster_label(F.col("label"), {1: "one", 3: "three"}).alias("name"))


@query("compressed", "WITH v AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 3.0 ELSE 0.25 END * sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) SELECT vec_id, round(n * least(1.0, (1 - 1e-5) / greatest(n, 1e-5)), 9) AS norm FROM v")
def compressed(spark, d):
    v = V.scaled(V.doubles(F.col("embedding")), F.when(F.col("vec_id") % 2 == 0, 3.0).otherwise(0.25))
    return X.read(spark, d, "embeddings").select("vec_id", F.round(V.norm(V.compress(v)), 9).alias("norm"))


# -- jobs -----------------------------------------------------------------------------------------------------------


@query("incremental_grow", PAIRS.replace(f"sim > {SIM}", "sim > 0.25") + ", g AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p), l0 AS (SELECT DISTINCT src AS id, CASE WHEN CAST(src AS INTEGER) % 10 <> 0 THEN 'c' || CAST(src AS INTEGER) % 5 ELSE src END AS label FROM g), " + ", ".join(_STEP.format(n=i, p=i - 1) for i in (1, 2)) + " SELECT id, label FROM l2")
def incremental_grow(spark, d):
    s = X.spheres(spark, d)
    old = s.where("seq % 10 <> 0")
    labels = old.select("id", F.concat(F.lit("c"), F.col("seq") % 5).alias("label"))
    return H.incremental_grow(s, old, None, labels, None, threshold=0.25, rounds=2)[1]


_MASS = "WITH RECURSIVE n AS (SELECT doc_id AS id FROM documents), k AS (SELECT a.id AS p, b.id AS c FROM n a JOIN n b ON b.id IN (2 * a.id + 1, 2 * a.id + 2)), r AS (SELECT id AS top, id AS at FROM n UNION ALL SELECT r.top, k.c FROM r JOIN k ON k.p = r.at), h AS (SELECT top AS id, count(*) AS w FROM r GROUP BY 1), s AS (SELECT doc_id AS id, CAST(len(text) AS DOUBLE) AS s FROM documents), q AS (SELECT median(s) AS med, max(s) AS mx FROM s)"


@query("assigned_mass", _MASS + " SELECT CAST(h.id AS VARCHAR) AS id, round(CASE WHEN h.id IN (SELECT p FROM k) THEN w ELSE w * (1 + round(CASE WHEN med <= 0 OR mx <= med THEN 0 ELSE least(1.0, s / (2 * med)) END, 6)) END, 6) :: DOUBLE AS mass FROM h JOIN s USING (id), q")
def assigned_mass(spark, d):
    t = _docs(spark, d).select("doc_id", "text")
    ids = t.select(F.col("doc_id").alias("kid"))
    kids = t.select("doc_id", F.explode(F.array(2 * F.col("doc_id") + 1, 2 * F.col("doc_id") + 2)).alias("kid")).join(ids, "kid").groupBy("doc_id").agg(F.collect_list(F.col("kid").cast("string")).alias("child_ids"))
    nodes = t.join(kids, "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("active"), F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"))
    factors = D.term_factor(t.select(F.col("doc_id").cast("string").alias("id"), F.length("text").cast("double").alias("s")))
    return D.assigned_mass(nodes, factors).select("id", F.round("mass", 6).alias("mass"))


@query("store_round_trip", "SELECT (SELECT count(*) FROM documents) AS spheres, (SELECT sum(len(text)) FROM documents) :: BIGINT AS chars, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS even")
def store_round_trip(spark, d):
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    store = Store(spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}")
    v = X.vectors(spark, d)
    store.save_all({"spheres": _spheres(spark, d), "vectors": v.where("cast(id as long) % 2 = 0")})
    even = store.load("vectors")
    store.append({"vectors": v.where("cast(id as long) % 2 = 1")})
    s = store.load("spheres").agg(F.count(F.lit(1)).alias("spheres"), F.sum(F.length("text")).alias("chars"))
    return s.crossJoin(store.load("vectors").agg(F.count(F.lit(1)).alias("vectors"))).crossJoin(even.agg(F.count(F.lit(1)).alias("even")))
