"""Graph queries as joins of a frontier with the edges.

A hop is one join and one aggregation on (small) frontier against (large) edges; frontiers stay DataFrames.
Loops over hops are bounded by the query, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _start(edges: DataFrame, ids: list[str]) -> DataFrame:
    return edges.sparkSession.createDataFrame([(i,) for i in ids], "id string")


def navigate(edges: DataFrame, start: str, hops: int = 2, least: float = 0.2, include_self: bool = False) -> DataFrame:
    """id, depth, weight: nodes reached over edges of at least ``least``, at their smallest depth, with the best edge there."""
    e = edges.where(F.col("weight") >= least).select("src", "dst", "weight")
    seen = _start(edges, [start]).select("id", F.lit(0).alias("depth"), F.lit(None).cast("double").alias("weight"))
    front = seen.select("id")
    for h in range(1, hops + 1):
        nxt = e.join(front, e.src == front.id).groupBy("dst").agg(F.max("weight").alias("weight")).select(F.col("dst").alias("id"), F.lit(h).alias("depth"), "weight")
        nxt = nxt.join(seen.select("id"), "id", "left_anti")
        seen, front = seen.unionByName(nxt), nxt.select("id")
    return seen if include_self else seen.where("depth > 0")


def bridge(edges: DataFrame, a: str, b: str, levels: int = 4, least: float = 0.1) -> DataFrame:
    """One row: the shortest path found by growing both sides in turn, ``levels`` levels each; parents are the smallest ids."""
    spark = edges.sparkSession
    kind = lambda n: F.when(n == 0, "self").when(n == 1, "direct").when(n <= 3, "short").otherwise("long")
    if a == b:
        return spark.createDataFrame([(a, b, True, [a], 0, "self")], "a string, b string, found boolean, path array<string>, length int, kind string")
    e = edges.where(F.col("weight") >= least).select("src", "dst").persist()  # read once a level
    side = lambda x: _start(edges, [x]).select("id", F.array("id").alias("path"))
    seen, front = {0: side(a), 1: side(b)}, {0: side(a), 1: side(b)}
    meet, kept = None, [e]
    for k in range(2 * levels):
        s = k % 2
        nxt = e.join(front[s], e.src == front[s].id).groupBy("dst").agg(F.min(F.struct("id", "path")).alias("m"))
        nxt = nxt.select(F.col("dst").alias("id"), F.concat("m.path", F.array("dst")).alias("path")).join(seen[s].select("id"), "id", "left_anti").persist()
        kept.append(nxt)
        front[s], seen[s] = nxt, seen[s].unionByName(nxt)
        hit = front[s].join(seen[1 - s].select("id", F.col("path").alias("back")), "id")
        left, right = ("path", "back") if s == 0 else ("back", "path")
        row = hit.select(F.concat(F.col(left), F.reverse(F.slice(F.col(right), F.lit(1), F.size(right) - 1))).alias("p")).orderBy(F.size("p"), "p").limit(1)
        meet = row.first()
        if meet is not None:
            break
    for df in kept:
        df.unpersist()
    path = list(meet.p) if meet is not None else []
    n = len(path) - 1
    out = spark.createDataFrame([(a, b, bool(path), path, n)], "a string, b string, found boolean, path array<string>, length int")
    return out.withColumn("kind", F.when(F.col("found"), kind(F.col("length"))).otherwise("disconnected"))


def activation(edges: DataFrame, seeds: dict[str, float], *, hops: int = 2, decay: float = 0.5, threshold: float = 0.05, least: float = 0.02, exclude_seeds: bool = False) -> DataFrame:
    """id, activation: signals spread over edges, summed within a hop; a node once reached receives no more."""
    spark = edges.sparkSession
    seed = spark.createDataFrame([(k, float(v)) for k, v in seeds.items() if v > 0], "id string, a double")
    axon = F.when(F.col("direction") == "forward", F.lit(1.0)).when(F.col("direction") == "reverse", F.lit(decay * 0.8)).otherwise(F.lit(decay * 0.9))
    e = edges.select("src", "dst", (F.col("weight") * F.when(F.col("kind") == "axon", axon).otherwise(F.lit(decay))).alias("k"))
    seen, front = seed, seed.where(F.col("a") >= threshold)
    for _ in range(hops):
        sent = front.join(e, front.id == e.src).select("dst", (F.col("a") * F.col("k")).alias("p")).where(F.col("p") >= least)
        nxt = sent.groupBy(F.col("dst").alias("id")).agg(F.sum("p").alias("a")).join(seen.select("id"), "id", "left_anti")
        seen, front = seen.unionByName(nxt), nxt
    if exclude_seeds:
        seen = seen.join(seed.select("id"), "id", "left_anti")
    top = seen.agg(F.max("a").alias("m"))
    return seen.crossJoin(F.broadcast(top)).select("id", F.round(F.col("a") / F.col("m"), 4).alias("activation"))


def traction(cands: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.1, least: float = 0.15, seed_boost: float = 0.0) -> DataFrame:
    """cands (id, score) moved up by their links to the seeds (id)."""
    s = seeds.select("id").distinct()
    pull = edges.where(F.col("weight") >= least).join(s.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("w"))
    scale = cands.agg(F.when(F.max("score") > F.min("score"), F.max("score") - F.min("score")).otherwise(1.0).alias("r")).crossJoin(s.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")))
    out = cands.join(pull, "id", "left").join(s.withColumn("is_seed", F.lit(1)), "id", "left").crossJoin(F.broadcast(scale))
    boost = alpha * F.least(F.lit(0.5), F.coalesce("w", F.lit(0.0)) / F.col("n")) * F.col("r") + F.when(F.col("is_seed") == 1, seed_boost * F.col("r")).otherwise(0.0)
    return out.select("id", "score", (F.col("score") + boost).alias("boosted"))


def movement(reranked: DataFrame) -> DataFrame:
    """How far reranking moved the candidates of one query (``fetch_k`` at most, so one task ranks them)."""
    a, b = Window.orderBy(F.desc("score"), "id"), Window.orderBy(F.desc("boosted"), "id")
    d = reranked.select((F.row_number().over(a) - F.row_number().over(b)).alias("m"))
    return d.agg(F.round(F.avg("m"), 6).alias("avg_move"), F.count_if(F.col("m") > 0).alias("moved_up"), F.count(F.lit(1)).alias("n"))


def explore(spheres: DataFrame, edges: DataFrame, cluster_id: int, by: str = "effective_mass", top: int = 30) -> DataFrame:
    """The first spheres of a cluster with their degree; best first, ties by position.  Texts of these alone leave the table."""
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("connections"))
    best = spheres.where(F.col("cluster_id") == cluster_id).orderBy(F.desc(by), "seq").limit(top).select("id")
    return spheres.where(F.col("id").isin([r.id for r in best.collect()])).join(d, "id", "left").select("id", F.substring("text", 1, 150).alias("preview"), "source_file", by, F.coalesce("connections", F.lit(0).cast("long")).alias("connections"), "seq")


def top_edges(edges: DataFrame, ids: DataFrame, top: int = 5, above: float = 0.2) -> DataFrame:
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    d = edges.join(ids.select(F.col("id").alias("src")), "src").withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= top) & (F.col("weight") > above))
    return d.select("src", "dst", "weight")


def trace(spheres: DataFrame, edges: DataFrame, source_file: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of a file by id, and their strongest edges, each unordered pair once."""
    rows = spheres.where(F.col("source_file") == source_file)
    chunks = rows.select((F.row_number().over(Window.orderBy("id")) - 1).alias("index"), "id", F.substring("text", 1, 200).alias("preview"), "cluster_id")
    t = top_edges(edges, rows, 5, 0.15).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    return chunks, t.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def entity_timeline(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    return chunks.join(mentions.select(F.col("sphere_id").alias("id"), "entity_text").distinct(), "id").groupBy("entity_text").agg(F.array_sort(F.collect_list("index")).alias("at"))


def label_propagation(edges: DataFrame, rounds: int = 5, seeds: DataFrame | None = None, checkpoint_every: int = 3) -> DataFrame:
    """id, label: synchronous; a node takes its neighbours' most common label, its own if that is among them, else the smallest.

    Lineage is cut with checkpoint() every few rounds where the session has a checkpoint folder.
    """
    nodes = edges.select(F.col("src").alias("id")).distinct()
    lab = nodes.join(seeds, "id", "left").select("id", F.coalesce("label", "id").alias("label")) if seeds is not None else nodes.select("id", F.col("id").alias("label"))
    has_dir = edges.sparkSession.conf.get("spark.checkpoint.dir", None) or edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    for i in range(rounds):
        votes = edges.select("src", "dst").join(lab.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("c"))
        own = lab.select(F.col("id").alias("src"), F.col("label").alias("own"))
        best = votes.join(own, "src").groupBy("src").agg(F.min(F.struct((-F.col("c")).alias("nc"), (F.col("label") != F.col("own")).alias("moved"), "label")).alias("m"))
        lab = best.select(F.col("src").alias("id"), F.col("m.label").alias("label"))
        if has_dir and (i + 1) % checkpoint_every == 0:
            lab = lab.checkpoint()
    return lab
