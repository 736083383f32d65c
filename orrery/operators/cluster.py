"""Clusters, centres and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.functions import vectors as V
from orrery.operators.scan import against_all


def centroids(spheres: DataFrame, by: str = "cluster_id", normalize: bool = True) -> DataFrame:
    """by, centroid, n: mean vector of each group; sums and counts meet in partial aggregates."""
    p = spheres.where("embedding is not null").select(by, F.posexplode("embedding").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    c = p.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("l"), F.max("n").alias("n"))
    v = F.transform("l", lambda e: e["x"])
    return c.select(by, (V.unit(v) if normalize else v).alias("centroid"), "n")


def concept_centroids(concepts: DataFrame, spheres: DataFrame) -> DataFrame:
    """id, centroid: mean of the children's vectors, not normalised."""
    kids = concepts.select(F.col("id").alias("concept"), F.explode("child_ids").alias("id"))
    return centroids(kids.join(spheres.select("id", "embedding"), "id"), "concept", False)


def online_add(spheres: DataFrame, by: str = "source_type", order: str = "seq") -> DataFrame:
    """by, centroid, n: vectors added one by one, normalised after each."""
    l = spheres.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, V.doubles(F.col("embedding")).alias("v")))).alias("l"))
    first = F.struct(F.col("l")[0]["v"].alias("c"), F.lit(1.0).alias("n"))

    def step(acc, x):
        moved = F.zip_with(acc["c"], x["v"], lambda c, v: c + (v - c) / (acc["n"] + 1))
        return F.struct(V.unit(moved).alias("c"), (acc["n"] + 1).alias("n"))

    out = l.select(by, F.aggregate(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), first, step).alias("a"))
    return out.select(by, F.col("a.c").alias("centroid"), F.col("a.n").cast("long").alias("n"))


def online_remove(centre: DataFrame, removed: DataFrame, by: str = "source_type") -> DataFrame:
    """Centres (by, centroid, n) without one vector each (by, embedding); a group of one goes."""
    d = centre.join(removed.select(by, "embedding"), by, "left")
    v = F.zip_with("centroid", V.doubles(F.col("embedding")), lambda c, x: (c * F.col("n") - x) / (F.col("n") - 1))
    gone = F.col("embedding").isNotNull()
    return d.where(~gone | (F.col("n") > 1)).select(by, F.when(gone, V.unit(v)).otherwise(F.col("centroid")).alias("centroid"), F.when(gone, F.col("n") - 1).otherwise(F.col("n")).alias("n"))


def predict(spheres: DataFrame, centre: DataFrame) -> DataFrame:
    """id, cluster_id, score: nearest centre.  Centres are at most some thousands, so they travel in the task."""
    d = spheres.select("id", "embedding").crossJoin(F.broadcast(centre.select("cluster_id", "centroid"))).select("id", "cluster_id", V.dot(F.col("embedding"), F.col("centroid")).alias("s"))
    w = Window.partitionBy("id").orderBy(F.desc("s"), "cluster_id")
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "cluster_id", F.greatest(F.lit(0.0), F.col("s")).alias("score"))


def affinities(q: list[float], fields: DataFrame, threshold: float = 0.0) -> DataFrame:
    """field, affinity of a query, best first."""
    a = F.round(F.greatest(F.lit(0.0), V.dot(V.literal(q), F.col("centroid"))), 4)
    return fields.select("field", a.alias("affinity")).where(F.col("affinity") >= threshold).orderBy(F.desc("affinity"), "field")


def gravity_field(spheres: DataFrame, fields: DataFrame) -> DataFrame:
    """id, field, value: in rows; ``as_map`` makes the map column of it."""
    v = F.round(F.greatest(F.lit(0.0), V.dot(F.col("embedding"), F.col("centroid"))), 4)
    return spheres.select("id", "embedding").crossJoin(F.broadcast(fields.select("field", "centroid"))).select("id", "field", v.alias("value"))


def as_map(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("gravity_field"))


def top_fields(rows: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("value"), "field")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def focus(rows: DataFrame, affinity: DataFrame, top: int = 2, factor: float = 0.2) -> DataFrame:
    """id, factor: one plus the strongest fields' values weighted by affinity."""
    a = affinity.orderBy(F.desc("affinity"), "field").limit(top)
    return rows.join(F.broadcast(a), "field").groupBy("id").agg(F.round(1 + factor * F.sum(F.col("value") * F.col("affinity")), 4).alias("factor"))


def field_shares(spheres: DataFrame, rows: DataFrame, cluster_id: int, above: float = 0.3) -> DataFrame:
    s = spheres.where(F.col("cluster_id") == cluster_id).select("id")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    return rows.join(s, "id").where(F.col("value") > above).groupBy("field").count().crossJoin(F.broadcast(n)).select("field", F.round(F.col("count") / F.col("n"), 3).alias("share"))


def fields_of_clusters(centre: DataFrame) -> DataFrame:
    return centre.select(X.cluster_label(F.col("cluster_id")).alias("field"), "centroid", "n")


def migrate_fields(spheres: DataFrame, fields: DataFrame) -> DataFrame:
    """Ids whose map of fields is empty or has other keys than there are fields."""
    names = fields.agg(F.array_sort(F.collect_set("field")).alias("names"))
    return spheres.select("id", "gravity_field").crossJoin(F.broadcast(names)).where((F.size("gravity_field") == 0) | (F.array_sort(F.map_keys("gravity_field")) != F.col("names"))).select("id")


def kmeans(vectors: DataFrame, k: int | None = 5, seed: int = 42, runs: int = 3, weight_col: str | None = None):
    """(predictions id, cluster_id, score; normalised centres; training cost): the best of several seeded starts."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = vectors.withColumn("features", array_to_vector(V.doubles(F.col("embedding")))).persist()  # read once, for all starts
    n = d.count()
    k = auto_k(vectors, seed) if k is None else k
    k = min(k, max(2, n))
    best = None
    for r in range(runs):
        km = KMeans(k=k, seed=seed + r, maxIter=100, featuresCol="features", predictionCol="cluster_id")
        m = (km.setWeightCol(weight_col) if weight_col else km).fit(d)
        if best is None or m.summary.trainingCost < best.summary.trainingCost:
            best = m
    d.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())]
    centre = vectors.sparkSession.createDataFrame(rows, "cluster_id int, centroid array<double>").select("cluster_id", V.unit(F.col("centroid")).alias("centroid"))
    label = best.transform(d).select("id", "cluster_id", "embedding").join(F.broadcast(centre), "cluster_id")
    return label.select("id", "cluster_id", F.greatest(F.lit(0.0), V.dot(F.col("embedding"), F.col("centroid"))).alias("score")), centre, best.summary.trainingCost


def auto_k(vectors: DataFrame, seed: int = 42, least: int = 5, most: int = 20) -> int:
    """k with the best silhouette among least .. min(most, sqrt(n)); -1 where that range is empty."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    d = vectors.select("id", array_to_vector(V.doubles(F.col("embedding"))).alias("features")).persist()  # read once, for all k
    n = d.count()
    best = (-2.0, -1)
    for k in range(least, min(most, int(n**0.5)) + 1):
        m = KMeans(k=k, seed=seed).fit(d)
        best = max(best, (ClusteringEvaluator().evaluate(m.transform(d)), -k))
    d.unpersist()
    return -best[1]


def silhouette(vectors: DataFrame, labels: DataFrame, block: int = 16384, step: int = 512) -> DataFrame:
    """One row: mean Euclidean silhouette.  A block of vectors sums its distances to all others by cluster in one task."""
    import numpy as np
    import pyarrow as pa

    d = vectors.select("id", "embedding").join(labels.select("id", "cluster_id"), "id")

    def scan(m, ids, k, asks):
        left = np.flatnonzero(asks)
        own = np.array(m[left], np.float64)
        sq, order = (own * own).sum(1)[:, None], np.argsort(k, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], k[order][1:] != k[order][:-1]]))
        for lo, hi in zip(edges, np.append(edges[1:], len(order))):
            s = np.zeros(len(left))
            for at in range(lo, hi, step):
                b = np.array(m[order[at : min(at + step, hi)]], np.float64)
                s += np.sqrt(np.maximum(sq + (b * b).sum(1)[None] - 2 * own @ b.T, 0)).sum(1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), pa.array(k[left].astype(np.int32)), pa.array(np.full(len(left), k[order[lo]], np.int32)), pa.array(s)], names=["id", "own", "other", "s"])

    sums = against_all(d.select("id", F.col("cluster_id").cast("long").alias("k"), "embedding"), scan, "id string, own int, other int, s double", block)
    size = d.groupBy(F.col("cluster_id").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    r = sums.join(F.broadcast(size), "other")
    inner = F.max(F.when((F.col("own") == F.col("other")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)))
    per = r.groupBy("id").agg(inner.alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("s") / F.col("n"))).alias("b"))
    return per.agg(F.round(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))), 6).alias("silhouette"))
