"""Queries on sessions and streams.  A stream over a bounded input gives what the batch form gives."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from orrery import fixtures as X
from orrery.streaming import ingest as I
from orrery.streaming import sessions as N

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _sessions(gap: str) -> str:
    return f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL {gap} THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL {gap}) AS end_us, count(*) AS n FROM s GROUP BY user_id, k"""


def _micros(df):
    return df.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def _events(spark, d):
    return X.read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("session_windows", _sessions("30 MINUTE"))
def session_windows(spark, d):
    return _micros(N.windows(_events(spark, d)))


@query("session_windows_6h", _sessions("6 HOUR"))
def session_windows_6h(spark, d):
    return _micros(N.windows(_events(spark, d), gap="6 hours"))


@query("active_sessions", "SELECT user_id, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id HAVING epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) <= 36000")
def active_sessions(spark, d):
    e = _events(spark, d)
    return N.active(e, e.agg(F.max("ts")).first()[0], seconds=36000).select("user_id", F.unix_micros("last").alias("last_us"))


@query("session_exclusions", "SELECT user_id AS session_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def session_exclusions(spark, d):
    return N.exclusions(_events(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), "ts"), 10)


def _stream(spark, d, table):
    return spark.readStream.schema(X.read(spark, d, table).schema).parquet(f"{d}/{table}.parqu*t")


def _name(base: str) -> str:
    return f"{base}_{uuid.uuid4().hex[:8]}"


@query("stream_session_windows", _sessions("6 HOUR"))
def stream_session_windows(spark, d):
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _micros(I.collect_stream(N.windows(e, gap="6 hours"), _name("sessions"), "complete"))


@query("stream_event_counts", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def stream_event_counts(spark, d):
    e = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    c = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return I.collect_stream(c, _name("counts"), "complete").select("event_type", F.unix_micros("w.start").alias("start_us"), "n")


@query("stream_exclusions", "SELECT user_id AS session_id, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def stream_exclusions(spark, d):
    e = _stream(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    return I.collect_stream(N.stream_exclusions(e, 10, None), _name("exclusions"), "update").select("session_id", F.explode("ids").alias("id"))


@query("stream_online_centroid", """WITH RECURSIVE o AS (SELECT CAST(label AS VARCHAR) AS source_type, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
r AS (SELECT source_type, k, v AS c FROM o WHERE k = 1 UNION ALL
  SELECT source_type, k, list_transform(m, lambda x: x / sqrt(list_inner_product(m, m))) FROM (SELECT r.source_type, o.k, list_transform(list_zip(r.c, o.v), lambda z: z[1] + (z[2] - z[1]) / (r.k + 1)) AS m FROM r JOIN o ON o.source_type = r.source_type AND o.k = r.k + 1))
SELECT source_type, CAST(k AS BIGINT) AS n, round(c[1], 5) AS x0 FROM r QUALIFY row_number() OVER (PARTITION BY source_type ORDER BY k DESC) = 1""")
def stream_online_centroid(spark, d):
    e = _stream(spark, d, "embeddings").select(F.col("label").cast("string").alias("source_type"), F.col("vec_id").alias("seq"), "embedding")
    return I.collect_stream(I.online_centroids(e), _name("centres"), "update").select("source_type", "n", F.round(F.col("centroid")[0], 5).alias("x0"))


@query("ingest_chunks")
def ingest_chunks(spark, d):
    docs = X.read(spark, d, "documents").select("text", F.col("source").alias("source_file"), F.col("lang").alias("source_type"))
    return I.to_spheres(docs).select("id", "source_file", F.length("text").alias("n_chars"), "cluster_id", "level", "poincare_norm")


@query("stream_ingest")
def stream_ingest(spark, d):
    from orrery.sources.tables import Store

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    root = f"{base.rstrip('/')}/ingest-{uuid.uuid4().hex}"
    store = Store(spark, f"{root}/store")
    docs = _stream(spark, d, "documents").select("text", F.col("source").alias("source_file"), F.col("lang").alias("source_type"))
    I.run(docs, store, f"{root}/checkpoint").awaitTermination()
    return store.load("spheres").select("id", "source_file", F.length("text").alias("n_chars"))
