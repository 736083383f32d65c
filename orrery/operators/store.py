"""Point look-ups, filters and changes of the sphere, vector and edge tables.

Tables are immutable: every change gives the new table, which the caller writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery import schema


def get(spheres: DataFrame, id_: str) -> DataFrame:
    return spheres.where(F.col("id") == id_)


def get_many(spheres: DataFrame, ids: list[str]) -> DataFrame:
    """In the order asked for; unknown ids are left out."""
    want = spheres.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string")
    return spheres.join(F.broadcast(want), "id").orderBy("pos")


def active(spheres: DataFrame) -> DataFrame:
    return spheres.where("active")


def by(spheres: DataFrame, column: str, value) -> DataFrame:
    """Active spheres of one source_file, source_type or level."""
    return spheres.where(F.col("active") & (F.col(column) == value))


def children(spheres: DataFrame, parent: str) -> DataFrame:
    kids = get(spheres, parent).select(F.explode("child_ids").alias("id"))
    return active(spheres).join(kids, "id", "left_semi")


def parent(spheres: DataFrame, child: str) -> DataFrame:
    return spheres.join(get(spheres, child).select(F.col("parent_id").alias("id")), "id", "left_semi")


def page(spheres: DataFrame, limit: int = 100, offset: int = 0, order: str = "seq") -> DataFrame:
    return active(spheres).orderBy(order).offset(offset).limit(limit).select("id")


def counts(spheres: DataFrame) -> DataFrame:
    return spheres.agg(F.count_if("active").alias("active"), F.count(F.lit(1)).alias("total"))


def insert(spheres: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` to append: one of each id that isn't there yet, deleted ones included."""
    w = Window.partitionBy("id").orderBy(*[c for c in ("chunk_index",) if c in new.columns] or ["id"])
    one = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return one.join(spheres.select("id"), "id", "left_anti")


def soft_delete(spheres: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select("id", F.lit(True).alias("_gone"))
    return spheres.join(gone, "id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone")


def delete(spheres: DataFrame, vectors: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spheres inactive with their norm reset, their vectors and edges gone."""
    i = ids.select("id")
    gone = i.withColumn("_gone", F.lit(True))
    s = spheres.join(gone, "id", "left")
    s = s.withColumn("active", F.col("active") & F.col("_gone").isNull())
    s = s.withColumn("poincare_norm", F.when(F.col("_gone"), 0.5).otherwise(F.col("poincare_norm"))).withColumn("poincare_norm_source", F.when(F.col("_gone"), "default").otherwise(F.col("poincare_norm_source"))).drop("_gone")
    e = edges.join(i.withColumnRenamed("id", "src"), "src", "left_anti").join(i.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return s, vectors.join(i, "id", "left_anti"), e


def update(spheres: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: id with new mass and/or diversity; effective_mass follows."""
    cols = [c for c in ("mass", "diversity") if c in changes.columns]
    d = spheres.join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in cols]), "id", "left")
    for c in cols:
        d = d.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return d.withColumn("effective_mass", schema.effective_mass(F.col("mass"), F.col("diversity"))).select(*spheres.columns)


def set_norm(spheres: DataFrame, norms: DataFrame, source: str) -> DataFrame:
    """norms (id, norm) checked against their range."""
    d = spheres.join(norms.select("id", schema.check_norm(F.col("norm")).alias("_n")), "id", "left")
    d = d.withColumn("poincare_norm_source", F.when(F.col("_n").isNotNull(), source).otherwise(F.col("poincare_norm_source")))
    return d.withColumn("poincare_norm", F.coalesce("_n", "poincare_norm")).select(*spheres.columns)


def upsert_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (src, dst, weight[, version]) replace; a negative weight inhibits."""
    key = ["src", "dst"]
    w = Window.partitionBy(*key).orderBy(F.desc("version") if "version" in changes.columns else F.desc("weight"))
    new = changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*key, F.col("weight").alias("_w"))
    d = edges.join(new, key, "full").withColumn("weight", F.coalesce("_w", "weight"))
    return d.withColumn("kind", F.coalesce("kind", F.lit("dendrite"))).select(*edges.columns)


def weight(edges: DataFrame, a: str, b: str) -> DataFrame:
    """One row; 0 without an edge."""
    return edges.where((F.col("src") == a) & (F.col("dst") == b)).agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"))


def neighbours(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where(F.col("src") == id_).select("dst", "weight")


def add_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors replace those of the same id."""
    return vectors.join(new.select("id"), "id", "left_anti").unionByName(new.select(*vectors.columns))


def orphans(registered: DataFrame, spheres: DataFrame) -> DataFrame:
    return registered.select("id").join(active(spheres).select("id"), "id", "left_anti")


def excluded(*parts: DataFrame) -> DataFrame:
    """Union of id sets."""
    out = parts[0].select("id")
    for p in parts[1:]:
        out = out.unionByName(p.select("id"))
    return out.distinct()


def keep_last(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stats(spheres: DataFrame, first: int = 1000) -> DataFrame:
    """Totals, and norms over the first active spheres."""
    n = active(spheres).orderBy("seq").limit(first).agg(F.round(F.avg("poincare_norm"), 6).alias("avg_norm"), F.min("poincare_norm").alias("min_norm"), F.max("poincare_norm").alias("max_norm"))
    return counts(spheres).crossJoin(n)


#: Write-ahead states and where each may go.
WAL_NEXT = {"ready": ("committing", "rolled_back"), "committing": ("done", "rolled_back"), "done": (), "rolled_back": ()}


def wal_advance(wal: DataFrame, changes: DataFrame) -> DataFrame:
    """wal (entry_id, status, updated_at) with changes (entry_id, status, updated_at); a step the states don't allow raises."""
    ok = F.lit(False)
    for a, nxt in WAL_NEXT.items():
        ok = ok | ((F.col("status") == a) & F.col("_s").isin(list(nxt))) if nxt else ok
    d = wal.join(changes.select("entry_id", F.col("status").alias("_s"), F.col("updated_at").alias("_u")), "entry_id", "left")
    bad = F.raise_error(F.concat(F.lit("no such step: "), "status", F.lit(" to "), "_s")).cast("string")
    return d.select("entry_id", F.when(F.col("_s").isNull(), F.col("status")).when(ok, F.col("_s")).otherwise(bad).alias("status"), F.coalesce("_u", "updated_at").alias("updated_at"))


def wal_recover(wal: DataFrame) -> DataFrame:
    """After a crash: what had not finished is rolled back."""
    return wal.withColumn("status", F.when(F.col("status").isin("ready", "committing"), "rolled_back").otherwise(F.col("status")))


def wal_clean(wal: DataFrame, now: float, hours: float = 24) -> DataFrame:
    return wal.where(~(F.col("status").isin("done", "rolled_back") & (F.col("updated_at") < now - hours * 3600)))
