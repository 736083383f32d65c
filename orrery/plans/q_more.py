"""Queries on reports, rewriting, feedback and changes, with their SQL forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery import fixtures as X
from orrery import schema
from orrery.functions import lexicon as L
from orrery.functions import text as T
from orrery.operators import cluster as C
from orrery.operators import graph as G
from orrery.operators import retrieve as R
from orrery.operators import store as S
from orrery.plans import models as M
from orrery.plans.q_core import PRE
from orrery.plans.q_graph import ACTIVATION, graph

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_STOP = "(" + ", ".join(f"'{w}'" for w in L.STOP_ENTITY) + ")"


@query("fallback_entities", f"WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(substr(text, 1, 500), '[一-鿿A-Za-z]{{2,}}'), lambda x: x NOT IN {_STOP})) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, word, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) <= 5")
def fallback_entities(spark, d):
    w = X.read(spark, d, "documents").select("doc_id", F.explode(T.frequent_words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    o = Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")
    return w.withColumn("rn", F.row_number().over(o)).where("rn <= 5").drop("rn")


@query("heading_histogram", "WITH t AS (SELECT '## ' || lang || chr(10) || text AS t FROM documents), h AS (SELECT len(regexp_extract(substr(t, 1, 200), '(?m)^##(#*)\\s+(.+)$', 1)) + 1 AS level, trim(regexp_extract(substr(t, 1, 200), '(?m)^##(#*)\\s+(.+)$', 2)) AS title FROM t) SELECT CAST(level AS INTEGER) AS level, title, count(*) AS n FROM h GROUP BY ALL ORDER BY n DESC, title LIMIT 25")
def heading_histogram(spark, d):
    t = X.read(spark, d, "documents").select(T.heading(F.concat(F.lit("## "), F.col("lang"), F.lit("\n"), F.col("text"))).alias("h")).where("h is not null")
    return t.groupBy("h.level", "h.title").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "title").limit(25)


@query("activation_stats", ACTIVATION.replace(", ('12', 0.01::DOUBLE)", "") + ", r AS (SELECT round(a / (SELECT max(a) FROM al), 4) AS activation FROM al) SELECT count(*) AS n, max(activation) AS max, min(activation) AS min, round(avg(activation), 6) AS mean FROM r")
def activation_stats(spark, d):
    a = G.activation(graph(spark, d).withColumn("weight", F.round("weight", 6)), {"5": 1.0, "9": 0.6})
    return a.agg(F.count(F.lit(1)).alias("n"), F.max("activation").alias("max"), F.min("activation").alias("min"), F.round(F.avg("activation"), 6).alias("mean"))


@query("feedback", PRE + ", x AS (SELECT CAST(event_id % 500 AS VARCHAR) AS id, CASE WHEN event_type = 'purchase' THEN 'like' ELSE 'dislike' END AS kind FROM events WHERE event_type IN ('purchase', 'error')), u AS (SELECT id, count(*) FILTER (kind = 'like') AS up, count(*) FILTER (kind = 'dislike') AS down FROM x GROUP BY 1) SELECT c.id, round(CASE WHEN up IS NULL THEN ip * 0.98 ELSE greatest(0.0, ip * (1 + 0.05 * up - 0.1 * down)) END, 6) AS score FROM c LEFT JOIN u USING (id)")
def feedback(spark, d):
    e = X.read(spark, d, "events").where("event_type in ('purchase', 'error')").select((F.col("event_id") % 500).cast("string").alias("id"), F.when(F.col("event_type") == "purchase", "like").otherwise("dislike").alias("kind"))
    c = R.candidates(X.spheres(spark, d), X.query_vector(spark, d)).select("id", F.col("ip").alias("score"))
    return R.with_feedback(c, e).withColumn("score", F.round("score", 6))


@query("concept_expansion", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IN (8, 17, 9, 10, 11) AND NOT (doc_id IN (9, 10, 11) AND doc_id % 10 = 3)")
def concept_expansion(spark, d):
    i = F.col("doc_id")
    s = X.read(spark, d, "documents").select(i.cast("string").alias("id"), F.when(i % 4 == 0, 1).otherwise(2).alias("level"), (i % 10 != 3).alias("active"), F.array((i + 1).cast("string"), (i + 2).cast("string"), (i + 3).cast("string")).alias("child_ids"))
    return R.expand_concepts(s.where("id in ('8', '17')").select("id"), s)


@query("rewrite_light", "SELECT CAST(doc_id AS VARCHAR) AS id, replace(source, '_', ' ') AS title, CASE lang WHEN 'fr' THEN 'light' ELSE 'full' END AS rewrite_model FROM documents")
def rewrite_light(spark, d):
    t = X.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("source_file"), F.col("lang").alias("source_type"))
    return M.rewrite(t, light=["fr"]).select("id", "title", "rewrite_model")


@query("mass_update", "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(CASE WHEN vec_id % 2 = 0 THEN 2.0 ELSE 1.0 END AS DOUBLE) AS mass, CAST(CASE WHEN vec_id % 2 = 0 THEN 2.0 * 1.25 ELSE 1.25 END AS DOUBLE) AS effective_mass FROM embeddings")
def mass_update(spark, d):
    t = X.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit(1.0).alias("mass"), F.lit(0.25).alias("diversity"), F.lit(1.25).alias("effective_mass"))
    return S.update(t, t.where("cast(id as int) % 2 = 0").select("id", F.lit(2.0).alias("mass"))).select("id", "mass", "effective_mass")


@query("field_migration", "SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE vec_id % 3 <> 1")
def field_migration(spark, d):
    i = F.col("vec_id")
    m = F.when(i % 3 == 0, F.create_map().cast("map<string,double>")).when(i % 3 == 1, F.create_map(F.lit("a"), F.lit(0.1), F.lit("b"), F.lit(0.2))).otherwise(F.create_map(F.lit("a"), F.lit(0.1)))
    s = X.read(spark, d, "embeddings").select(i.cast("string").alias("id"), m.alias("gravity_field"))
    return C.migrate_fields(s, spark.createDataFrame([("a",), ("b",)], "field string"))


@query("wal_recovery", "SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, CASE o_orderkey % 4 WHEN 0 THEN 'rolled_back' WHEN 1 THEN 'rolled_back' WHEN 2 THEN 'done' ELSE 'rolled_back' END AS status FROM orders")
def wal_recovery(spark, d):
    k = F.col("o_orderkey")
    w = X.read(spark, d, "orders").select(k.cast("string").alias("entry_id"), F.when(k % 4 == 0, "ready").when(k % 4 == 1, "committing").when(k % 4 == 2, "done").otherwise("rolled_back").alias("status"), F.lit(0.0).alias("updated_at"))
    return S.wal_recover(w).select("entry_id", "status")


@query("defaults", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(1.0 AS DOUBLE) AS mass, CAST(2 AS INTEGER) AS level, CAST(-1 AS INTEGER) AS cluster_id, true AS active, CAST(0.5 AS DOUBLE) AS poincare_norm FROM documents")
def defaults(spark, d):
    return schema.complete(X.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")).select("id", "mass", "level", "cluster_id", "active", "poincare_norm")


@query("embed_offline")
def embed_offline(spark, d):
    t = X.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return M.embed(t).select("id", F.size("embedding").alias("dim"), F.md5(F.array_join(F.transform("embedding", lambda x: F.round(x, 5).cast("string")), ",")).alias("digest"))


@query("ask_offline", "WITH p AS (SELECT conv_id, string_agg('[第' || CAST(rn AS VARCHAR) || '段] ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY conv_id), q AS (SELECT conv_id, substr(p, instr(p, '] ') + 2) AS p FROM p) SELECT conv_id, substr(CASE WHEN instr(p, '. ') > 0 THEN substr(p, 1, instr(p, '. ') - 1) ELSE p END, 1, 300) AS reply, CAST(NULL AS VARCHAR) AS error FROM q")
def ask_offline(spark, d):
    c = X.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return c.withColumn("g", M.generate(T.prompt(F.transform("l", lambda x: x["text"])))).select("conv_id", "g.reply", "g.error")
