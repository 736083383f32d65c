"""Properties and defined corner cases of the operators."""

import pytest
from pyspark.sql import functions as F

from orrery import fixtures as X
from orrery.operators import edges as E
from orrery.operators import graph as G
from orrery.operators import store as S


@pytest.fixture(scope="module")
def small(spark):
    rows = [("a", "b", 0.6), ("b", "c", 0.5), ("c", "d", 0.4), ("d", "e", 0.3), ("x", "y", 0.9)]
    return E.merge(spark.createDataFrame(rows, "src string, dst string, weight double").select("*", F.lit("dendrite").alias("kind"), F.lit(None).cast("string").alias("direction")))


def test_merge_is_symmetric(spark):
    rows = [("a", "b", 2.0, "dendrite", None), ("b", "a", 0.3, "axon", "forward"), ("a", "a", 1.0, "dendrite", None), ("b", "c", 0.01, "dendrite", None)]
    g = E.merge(spark.createDataFrame(rows, "src string, dst string, weight double, kind string, direction string"))
    assert sorted(map(tuple, g.collect())) == [("a", "b", 1.0, "axon", "forward"), ("b", "a", 1.0, "axon", "forward"), ("b", "c", 0.1, "dendrite", None), ("c", "b", 0.1, "dendrite", None)]


def test_bridge(small):
    get = lambda a, b: tuple(G.bridge(small, a, b).select("found", "path", "length", "kind").first())
    assert get("a", "a") == (True, ["a"], 0, "self")
    assert get("a", "b") == (True, ["a", "b"], 1, "direct")
    assert get("a", "e") == (True, ["a", "b", "c", "d", "e"], 4, "long")
    assert get("a", "x")[::3] == (False, "disconnected")


def test_navigate(small):
    assert sorted((r.id, r.depth) for r in G.navigate(small, "a", 2, 0.2).collect()) == [("b", 1), ("c", 2)]


def test_activation(small):
    got = {r.id: r.activation for r in G.activation(small, {"a": 1.0}).collect()}
    assert got == {"a": 1.0, "b": 0.3, "c": 0.075}
    assert "a" not in {r.id for r in G.activation(small, {"a": 1.0}, exclude_seeds=True).collect()}


def test_label_propagation_finds_components(small):
    lab = {r.id: r.label for r in G.label_propagation(small, 6).collect()}
    assert lab["x"] == lab["y"] or {lab["x"], lab["y"]} == {"x", "y"}


def test_insert_twice_adds_nothing(spark):
    a = spark.createDataFrame([("1",), ("2",)], "id string")
    new = S.insert(a, spark.createDataFrame([("2",), ("3",), ("3",)], "id string"))
    assert [r.id for r in new.collect()] == ["3"]
    assert S.insert(a.unionByName(new), new).count() == 0


def test_wal(spark):
    w = spark.createDataFrame([("a", "ready", 1.0), ("b", "committing", 1.0), ("c", "done", 1.0)], "entry_id string, status string, updated_at double")
    step = spark.createDataFrame([("a", "committing", 2.0)], "entry_id string, status string, updated_at double")
    assert {r.entry_id: r.status for r in S.wal_advance(w, step).collect()} == {"a": "committing", "b": "committing", "c": "done"}
    with pytest.raises(Exception, match="no such step"):
        S.wal_advance(w, spark.createDataFrame([("c", "ready", 2.0)], step.schema)).collect()
    assert {r.status for r in S.wal_recover(w).collect()} == {"rolled_back", "done"}
    assert S.wal_clean(w, 1e6).count() == 2


def test_partitioning_does_not_matter(spark, sf):
    s = X.spheres(spark, sf)
    a, b = (E.build(x, threshold=0.3, with_causal=False).select("src", "dst", F.round("weight", 9).alias("w")) for x in (s, s.repartition(7)))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()


def test_pushdown(spark, sf):
    plan = X.read(spark, sf, "documents").where("doc_id = 5").select("lang")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_incremental_cascade(spark):
    rows = [("n1", [1.0, 0.0], 1, "f"), ("e1", [0.9, 0.1], 1, "g"), ("e2", [0.8, 0.6], 2, "g"), ("e3", [0.0, 1.0], 2, "f"), ("e4", [0.0, -1.0], 3, "h")]
    s = spark.createDataFrame(rows, "id string, embedding array<float>, cluster_id int, source_file string")
    m = spark.createDataFrame([("n1", "x"), ("n1", "y"), ("e4", "x"), ("e4", "y"), ("e4", "z"), ("e3", "x")], "sphere_id string, entity_id string")
    got = {r.dst: round(r.weight, 6) for r in E.incremental(s.where("id = 'n1'"), s.where("id <> 'n1'"), mentions=m).collect()}
    cos = 0.9 / (0.82**0.5)
    assert got == {"e1": round(0.6 * (0.7 + 0.3 * cos), 6), "e2": round(0.3 * (0.6 + 0.4 * 0.8), 6), "e4": round(0.4 * (0.6 + 0.4 * 2 / 3), 6)}
