"""Entities and the roles in which spheres mention them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery import schema
from orrery.functions import text as X
from orrery.functions.structure import attr_head_udf
from orrery.operators.together import partners

BASE = {"phrase": 1.0, "head": 0.6, "attributive": 0.4}


def mentions(spheres: DataFrame) -> DataFrame:
    """sphere_id, entity_id, entity_text, role, seq: of texts of five characters or more, every registration in order."""
    d = spheres.where(F.length("text") >= 5).select(F.col("id").alias("sphere_id"), F.posexplode(attr_head_udf("text")).alias("p", "pair"))
    s = lambda r, t, i: F.struct(F.lit(r).alias("role"), t.alias("text"), i.alias("i"))
    attrs = F.transform(F.col("pair.attributives"), lambda a, i: s("attributive", a, i + 2))
    one = F.concat(F.array(s("phrase", F.col("pair.full_phrase"), F.lit(0)), s("head", F.col("pair.head"), F.lit(1))), attrs)
    d = d.select("sphere_id", "p", F.explode(one).alias("m"))
    least = F.when(F.col("m.role") == "head", 2).otherwise(3)
    d = d.where(F.length("m.text") >= least)
    return from_rows(d.select("sphere_id", F.col("m.text").alias("text"), F.col("m.role").alias("role"), F.struct("p", "m.i").alias("order")))


def from_rows(rows: DataFrame) -> DataFrame:
    """The mention table from (sphere_id, text, role, order)."""
    seq = F.row_number().over(Window.partitionBy("sphere_id").orderBy("order"))
    return rows.select("sphere_id", schema.entity_id(F.col("text")).alias("entity_id"), F.substring("text", 1, 60).alias("entity_text"), "role", seq.cast("long").alias("seq"))


def entities(m: DataFrame) -> DataFrame:
    """entity_id, entity_text, occurrences, and the number of spheres in each role."""
    n = lambda r: F.countDistinct(F.when(F.col("role") == r, F.col("sphere_id")))
    return m.groupBy("entity_id").agg(F.min("entity_text").alias("entity_text"), F.count(F.lit(1)).alias("occurrences"), n("phrase").alias("n_phrase"), n("head").alias("n_head"), n("attributive").alias("n_attr"))


def cooccurrence(m: DataFrame, least: int = 1, top: int | None = None) -> DataFrame:
    """entity_id, other_id, cnt: times the other was registered in a sphere that held the entity already.

    Counts of ``least`` and more; the ``top`` most frequent others of an entity if given, ties by other_id.
    """
    return partners(m, least, top)


def stats(m: DataFrame) -> DataFrame:
    e = entities(m)
    return e.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.col("occurrences") >= 2).alias("active"), F.sum("occurrences").alias("occurrences")).crossJoin(m.agg(F.countDistinct("sphere_id").alias("spheres")))


def distribution(m: DataFrame) -> DataFrame:
    return m.groupBy("entity_id").pivot("role", ["phrase", "head", "attributive"]).agg(F.countDistinct("sphere_id")).na.fill(0)


def shared(m: DataFrame, a: str, b: str) -> DataFrame:
    """Texts of the entities of both spheres."""
    of = lambda s: m.where(F.col("sphere_id") == s).select("entity_id", "entity_text").distinct()
    return of(a).join(of(b).select("entity_id"), "entity_id").select("entity_text")


def expand(m: DataFrame, sources: DataFrame | None = None, least: float = 0.3, top: int = 10) -> DataFrame:
    """source, target, entity_id, role, confidence: spheres that hold an active entity in the same role.

    The confidence floor acts before the join: an entity that can't reach it joins nothing.  All spheres of an entity in a
    role have one confidence, so a source's best ``top`` hold none but the first ``top`` of them besides itself: no
    entity, however common, sends more targets to the join.
    """
    e = entities(m).where("occurrences >= 2")
    roles = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("n_phrase", "n_head", "n_attr")), F.lit(0))
    e = e.select("entity_id", X.jump_confidence(F.col("occurrences"), roles).alias("j"))
    base = F.when(F.col("role") == "phrase", 1.0).when(F.col("role") == "head", 0.6).otherwise(0.4)
    d = m.select("sphere_id", "entity_id", "role").distinct().join(e, "entity_id").withColumn("confidence", F.round(base * F.col("j"), 6)).where(F.col("confidence") >= least)
    s = d.select(F.col("sphere_id").alias("source"), "entity_id", "role", "confidence")
    if sources is not None:
        s = s.join(sources.select(F.col("id").alias("source")), "source", "left_semi")
    first = Window.partitionBy("entity_id", "role").orderBy("target")
    t = d.select(F.col("sphere_id").alias("target"), "entity_id", "role").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= top + 1).drop("rn")
    w = Window.partitionBy("source").orderBy(F.desc("confidence"), "target", "entity_id", "role")
    return s.join(t, ["entity_id", "role"]).where("source <> target").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("source", "target", "entity_id", "role", "confidence")


def expand_entities(m: DataFrame, texts: list[str], top: int = 10) -> DataFrame:
    """target, entity, confidence 0.5: spheres that hold one of the texts; the first text counts."""
    order = F.array_position(F.array(*[F.lit(t) for t in texts]), F.col("entity_text"))
    d = m.where(F.col("entity_text").isin(texts)).groupBy(F.col("sphere_id").alias("target")).agg(F.min_by("entity_text", order).alias("entity"), F.min(order).alias("o"))
    return d.orderBy("o", "target").limit(top).select("target", "entity", F.lit(0.5).alias("confidence"))


def expand_pool(m: DataFrame, hits: DataFrame, exclude: DataFrame | None = None, decay: float = 0.6, per_hit: int = 3, top: int = 20) -> DataFrame:
    """id, score: candidates for the hits (id, score): score x confidence x decay, the best of each; ``per_hit`` a hit."""
    x = expand(m, hits).join(hits.select(F.col("id").alias("source"), "score"), "source")
    x = x.join(hits.select(F.col("id").alias("target")), "target", "left_anti")
    if exclude is not None:
        x = x.join(exclude.select(F.col("id").alias("target")), "target", "left_anti")
    w = Window.partitionBy("source").orderBy(F.desc("confidence"), "target", "entity_id", "role")
    x = x.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_hit)
    return x.groupBy(F.col("target").alias("id")).agg(F.max(F.col("score") * F.col("confidence") * decay).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def expansion_stats(expanded: DataFrame, hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("hits")).crossJoin(expanded.agg(F.countDistinct("source").alias("with_jumps"), F.count(F.lit(1)).alias("jumps")))


def key_entities(m: DataFrame, top: int = 5) -> DataFrame:
    """sphere_id, entities: by occurrences x co-occurring entities; one that contains or is contained in a kept one is skipped."""
    e = entities(m).select("entity_id", "entity_text", "occurrences")
    c = partners(m, counts=True)
    d = m.select("sphere_id", "entity_id").distinct().join(e.join(c, "entity_id", "left"), "entity_id").where(F.length("entity_text") >= 2)
    d = d.groupBy("sphere_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("occurrences") * F.coalesce("c", F.lit(0))).alias("k"), F.col("entity_text").alias("t")))).alias("l"))
    take = lambda acc, x: F.when((F.size(acc) < top) & ~F.exists(acc, lambda y: y.contains(x["t"]) | x["t"].contains(y)), F.concat(acc, F.array(x["t"]))).otherwise(acc)
    return d.select("sphere_id", F.aggregate("l", F.array().cast("array<string>"), take).alias("entities"))
