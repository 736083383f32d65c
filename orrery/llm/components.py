"""Connected components by contraction; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id in an edge; comp is the smallest id of the component.

    A round lets every vertex point to the neighbour of the lowest hash (or itself), halves the
    pointer chains once, and contracts the edges to the vertices pointed at.  Hashes as priorities keep
    the chains short whatever the order of the ids; the number of rounds grows with the logarithm of
    the number of vertices.  A vertex of very many edges is met in partial minima, never gathered.
    """
    own = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    cur = scratch.put(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    member = None
    while not cur.isEmpty():
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(own("v")).alias("m")).select("u", F.least(own("u"), "m")["id"].alias("p"))
        best = scratch.put(best, "parent")
        jump = best.select(F.col("u").alias("p"), F.col("p").alias("q"))
        point = scratch.put(best.join(jump, "p").select("u", F.col("q").alias("p")), "point")
        left = point.select("u", F.col("p").alias("pu"))
        right = point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        new = scratch.put(cur.join(left, "u").join(right, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if member is None:
            nxt = point.select(F.col("u").alias("id"), F.col("p").alias("comp"))
        else:
            nxt = scratch.put(member.join(point.select(F.col("u").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), "member")
            scratch.drop(point)
        scratch.drop(best, cur)
        member, cur = nxt, new
    if member is None:
        return cur.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    low = member.groupBy("comp").agg(F.min("id").alias("low"))
    return scratch.put(member.join(low, "comp").select("id", F.col("low").alias("comp")), "components")
