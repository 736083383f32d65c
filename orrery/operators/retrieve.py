"""Retrieval: coarse top-k by inner product, exact rerank of the candidates, cap per source.

Filters act after the coarse cut on purpose: a query may return fewer than k rows, as the semantics ask.
The coarse cut bounds what follows: joins against ``fetch_k`` rows are broadcast of a proven size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vectors as V
from orrery.operators.scan import top_k


def candidates(spheres: DataFrame, q: list[float], fetch_k: int = 50, exclude: DataFrame | None = None) -> DataFrame:
    """The fetch_k best by inner product with their columns and ``ip``, then without inactive and excluded ones."""
    best = top_k(spheres, {"q": q}, fetch_k).select("id", F.col("score").alias("ip"))
    out = spheres.join(F.broadcast(best), "id")
    if "active" in spheres.columns:
        out = out.where("active")
    return out.join(exclude.select("id"), "id", "left_anti") if exclude is not None else out


def distance(q: list[float], mode: str, split: int | None = None, norm: Column | float = 0.5, query_norm: float = 0.5) -> Column:
    """Ascending distance of ``embedding`` to q: dual, poincare or cosine."""
    v, qv = F.col("embedding"), V.literal(q)
    if mode == "dual":
        return V.dual_space(qv, v, split or len(q) // 4, len(q))
    if mode == "poincare":
        return V.poincare_of(V.cosine(qv, v), query_norm, norm)
    return -V.dot(qv, v)


def capped(rows: DataFrame, k: int, cap: int = 3, order: str = "dist") -> DataFrame:
    """The first k in order with at most ``cap`` of one source; ``rank`` from 1."""
    w = Window.partitionBy("source_file").orderBy(order, "id")
    best = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn").orderBy(order, "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(order, "id")))


def retrieve(spheres: DataFrame, q: list[float], *, mode: str = "dual", fetch_k: int = 50, k: int = 10, cap: int = 3, exclude: DataFrame | None = None, norm: Column | float = 0.5) -> DataFrame:
    rows = candidates(spheres, q, fetch_k, exclude).withColumn("dist", distance(q, mode, norm=norm))
    return capped(rows, k, cap)


def valid_norm(norm: Column) -> Column:
    return F.when((norm > 0) & (norm < 1), norm).otherwise(F.lit(0.5))


def poincare_scan(spheres: DataFrame, q: list[float], k: int, norm: Column | float = 0.5, query_norm: float = 0.5) -> DataFrame:
    """Full scan by hyperbolic distance."""
    d = V.poincare_of(V.cosine(V.literal(q), F.col("embedding")), query_norm, norm)
    return spheres.select("id", d.alias("dist")).orderBy("dist", "id").limit(k)


def gravity_score(spheres: DataFrame, q: list[float], mass: Column) -> DataFrame:
    return spheres.select("id", (V.dot(V.literal(q), F.col("embedding")) * mass).alias("score"))


def poincare_score(spheres: DataFrame, q: list[float]) -> DataFrame:
    """Negative hyperbolic distance of the raw vectors, with floors under the denominators."""
    qv, v = V.literal(q), F.col("embedding")
    den = F.greatest(F.lit(V.EPS), 1 - V.squared(qv)) * F.greatest(F.lit(V.EPS), 1 - V.squared(v))
    return spheres.select("id", (-F.acosh(F.greatest(F.lit(1 + V.EPS), 1 + 2 * V.squared(V.minus(qv, v)) / den))).alias("score"))


def drifted(q: list[float], spheres: DataFrame, centroids: DataFrame, probe: int = 30, top: int = 5, need: int = 3, pull: float = 0.15) -> list[float]:
    """The query pulled towards the cluster that holds ``need`` of its ``top`` first hits."""
    hits = top_k(spheres, {"q": q}, probe).limit(top)
    won = hits.join(spheres.select("id", "cluster_id"), "id").groupBy("cluster_id").count().where(F.col("count") >= need)
    row = won.join(centroids.select("cluster_id", "centroid"), "cluster_id").orderBy(F.desc("count"), "cluster_id").first()
    if row is None:
        return q
    moved = [a + pull * b for a, b in zip(q, row.centroid)]
    n = sum(x * x for x in moved) ** 0.5
    return [x / n for x in moved] if n else moved


def routed(spheres: DataFrame, q: list[float], centroids: DataFrame, k: int = 10, clusters: int = 2) -> DataFrame:
    """Hits of the ``clusters`` nearest clusters first."""
    near = centroids.select("cluster_id", V.dot(V.literal(q), F.col("centroid")).alias("s")).orderBy(F.desc("s"), "cluster_id").limit(clusters).select("cluster_id", F.lit(0).alias("far"))
    hits = candidates(spheres, q).join(F.broadcast(near), "cluster_id", "left")
    return hits.select("id", "cluster_id", "ip", F.coalesce("far", F.lit(1)).alias("far")).orderBy("far", F.desc("ip"), "id").limit(k)


def fusion(semantic: Column, terms: Column, w: float = 0.7) -> Column:
    return w * semantic + (1 - w) * terms


def force(semantic: Column, term: Column, field: Column, social: Column, weights=(0.4, 0.2, 0.2, 0.2)) -> Column:
    return weights[0] * semantic + weights[1] * term + weights[2] * field + weights[3] * social


def with_feedback(cands: DataFrame, events: DataFrame, like: float = 0.05, dislike: float = 0.1, dormant: float = 0.98) -> DataFrame:
    """cands (id, score) adjusted by events (id, kind): likes raise, dislikes lower, ids without an event fade."""
    e = events.groupBy("id").agg(F.count_if(F.col("kind") == "like").alias("up"), F.count_if(F.col("kind") == "dislike").alias("down"))
    d = cands.join(e, "id", "left")
    moved = F.col("score") * (1 + like * F.coalesce("up", F.lit(0)) - dislike * F.coalesce("down", F.lit(0)))
    return d.select("id", F.when(F.col("up").isNull(), F.col("score") * dormant).otherwise(F.greatest(F.lit(0.0), moved)).alias("score"))


def expand_concepts(hits: DataFrame, spheres: DataFrame) -> DataFrame:
    """Hit concepts (level 1) also bring in their active children."""
    kids = hits.join(spheres.where("level = 1").select("id", "child_ids"), "id").select(F.explode("child_ids").alias("id"))
    active = spheres.where("active").select("id")
    return hits.select("id").unionByName(kids.join(active, "id")).distinct()


def diversity_sort(cands: DataFrame, q: list[float], *, k: int = 5, lam: float = 0.5, source: float = 0.15, field: float = 0.1, redundancy: float = 0.05, link: float = 0.1, affinities: dict[str, float] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Greedy selection: relevance against similarity to what is selected, with penalties for one source, one type and links.

    ``cands`` has query_id, id, embedding, source_file, source_type: at most some hundred rows a query, as
    each pick depends on all picks before.  Links among candidates travel as an array beside each row.
    """
    import numpy as np
    import pandas as pd

    aff = affinities or {}
    rows = cands.select("query_id", "id", "embedding", "source_file", "source_type")
    if edges is not None:
        e = edges.where("weight >= 0.15").join(rows.select(F.col("id").alias("src"), "query_id"), "src").join(rows.select(F.col("id").alias("dst"), "query_id"), ["dst", "query_id"])
        links = e.groupBy("query_id", F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("dst", "weight"))).alias("links"))
        rows = rows.join(links, ["query_id", "id"], "left")
    else:
        rows = rows.withColumn("links", F.lit(None).cast("map<string,double>"))
    qv = np.array(q)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        m = np.stack([np.asarray(x, float) for x in pdf.embedding])
        rel, sim = m @ qv, m @ m.T
        kinds = pdf.source_type.to_numpy(object)
        same = (kinds[:, None] == kinds[None, :]) & ~np.eye(len(pdf), dtype=bool) & pdf.source_type.notna().to_numpy()[:, None]
        dull = np.where(same.any(1), (sim * same).sum(1) / np.maximum(same.sum(1), 1), 0.0)
        bonus = field * np.array([aff.get(t, 0.0) for t in kinds])
        chosen: list[int] = []
        out = []
        for _ in range(min(k, len(pdf))):
            if chosen:
                score = lam * rel - (1 - lam) * sim[:, chosen].max(1) + bonus - redundancy * dull
                n = np.array([sum(pdf.source_file[c] == f for c in chosen) if f is not None else 0 for f in pdf.source_file])
                score = score - np.where(n > 0, source * 1.5 ** (n - 1.0), 0.0)
                score = score - link * np.array([sum((dict(x) if x is not None else {}).get(pdf.id[c], 0.0) for c in chosen) for x in pdf.links])
            else:
                score = rel + bonus
            score[chosen] = -np.inf
            best = int(np.argmax(score))
            chosen.append(best)
            out.append((pdf.query_id[0], len(chosen), pdf.id[best], round(float(score[best]), 4)))
        return pd.DataFrame(out, columns=["query_id", "rank", "id", "score"])

    return rows.groupBy("query_id").applyInPandas(pick, "query_id string, rank int, id string, score double")


def rerank_by_reply(cands: DataFrame, reply: Column, k: int = 20) -> DataFrame:
    """By a scorer's reply (1-5); if no reply has a score, all count 3 of 5."""
    from orrery.functions.text import score_of_reply

    w = Window.partitionBy("query_id")
    s = cands.withColumn("s", F.coalesce(score_of_reply(reply), F.lit(0.0)))
    s = s.withColumn("score", F.when(F.max("s").over(w) == 0, F.lit(0.6)).otherwise(F.col("s")))
    o = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(o)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
