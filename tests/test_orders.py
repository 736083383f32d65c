"""Results that must not depend on how rows are dealt into levels, batches and blocks."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import cluster as C
from orrery.operators import derive as D
from orrery.operators import edges as E
from orrery.operators import graph as G
from orrery.operators import hierarchy as H
from orrery.operators import propagate as P
from orrery.operators import roles as O
from orrery.operators import scan
from orrery.operators.scan import closest
from orrery.operators.together import partners, sharing
from orrery.plans import q_stream as Q
from orrery.streaming import ingest as I
from orrery.streaming import sessions as N


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mass_of_a_deep_hierarchy(spark):
    """A chain of 24 levels, deeper than the bound of cycles, and a cycle, which ends."""
    chain = [(i, True, [i + 1] if i < 23 else []) for i in range(24)]
    assert {r.id: r.mass for r in D.hierarchy_mass(spark.createDataFrame(chain, "id long, active boolean, child_ids array<long>")).collect()} == {i: 24.0 - i for i in range(24)}
    ring = [(0, True, [1]), (1, True, [2]), (2, True, [1, 3]), (3, True, [])]
    got = {r.id: r.mass for r in D.hierarchy_mass(spark.createDataFrame(ring, "id long, active boolean, child_ids array<long>"), depth=4).collect()}
    assert got[3] == 1 and all(1 < got[i] < 20 for i in range(3))


def _streamed(spark, rows, schema, path):
    r = random.Random(1)
    r.shuffle(rows)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_exclusions_of_a_session_in_many_batches(spark, tmp_path, small_batches):
    rows = [(s, 100 * s + i, 1000 + i // 2) for s in range(3) for i in range(40)]
    e = _streamed(spark, rows, "session_id long, id long, t long", f"{tmp_path}/e").selectExpr("session_id", "id", "timestamp_seconds(t) AS ts")
    got = I.collect_stream(N.stream_exclusions(e, 10, None), Q._name("x"), "update").collect()
    assert {r.session_id: list(r.ids) for r in got} == {s: [100 * s + i for i in range(30, 40)] for s in range(3)}


def test_history_of_a_session_in_many_batches(spark, tmp_path, small_batches):
    e = _streamed(spark, [("a", i, "user" if i % 2 == 0 else "bot", str(i)) for i in range(30)], "session_id string, seq long, role string, content string", f"{tmp_path}/h")
    got = I.collect_stream(N.stream_history(e, 2, None), Q._name("h"), "update").collect()
    assert got[0].history == "Human: 26\n\nAssistant: 27\n\nHuman: 28\n\nAssistant: 29"


def test_online_centroid_in_many_batches(spark, tmp_path, small_batches):
    r = random.Random(2)
    vec = [(str(i % 2), i, [r.uniform(-1, 1) for _ in range(3)]) for i in range(50)]
    want = {}
    for k, _, v in vec:
        n, c = want.get(k, (0, None))
        c = np.array(v) if c is None else c + (np.array(v) - c) / (n + 1)
        want[k] = n + 1, c / np.linalg.norm(c) if n else c
    e = _streamed(spark, vec, "source_type string, seq long, embedding array<double>", f"{tmp_path}/v")
    got = {x.source_type: (x.n, x.centroid) for x in I.collect_stream(I.online_centroids(e), Q._name("c"), "update").collect()}
    assert all(got[k][0] == n and np.allclose(got[k][1], c, atol=1e-12) for k, (n, c) in want.items())


def _texts(n, words, seed):
    r = random.Random(seed)
    return [(f"s{i}", [r.choice(words) for _ in range(r.randint(0, 12))]) for i in range(n)]


def _mentioned(spark, lists):
    rows = [(s, hashlib.md5(w.encode()).hexdigest()[:8], w, "phrase" if len(w) > 2 else "head", k + 1) for s, l in lists for k, w in enumerate(l)]
    return spark.createDataFrame(rows, "sphere_id string, entity_id string, entity_text string, role string, seq long")


def _ident(w):
    return hashlib.md5(w.encode()).hexdigest()[:8]


def test_partners_make_no_rows_of_pairs(spark):
    """Counts against plain loops, in blocks, steps and lists of several sizes; no join makes pairs."""
    lists = _texts(40, [f"w{i}" for i in range(12)] + ["w0"] * 8, 3)
    m = _mentioned(spark, lists)
    co = Counter((_ident(w), _ident(o)) for _, l in lists for w in set(l) for o in l[l.index(w) + 1 :] if o != w)
    for blocks, pairs in ((1, 3), (5, 50), (None, None)):
        assert {(r.entity_id, r.other_id): r.cnt for r in partners(m, blocks=blocks, pairs=pairs).collect()} == co
    best = {}
    for (e, o), n in sorted(co.items(), key=lambda x: (-x[1], x[0])):
        if n >= 2 and len(best.setdefault(e, [])) < 3:
            best[e].append((o, n))
    got = {}
    for r in partners(m, 2, 3, pairs=9).collect():
        got.setdefault(r.entity_id, []).append((r.other_id, r.cnt))
    assert {e: sorted(x) for e, x in got.items()} == {e: sorted(x) for e, x in best.items() if x}
    assert {r.entity_id: r.c for r in partners(m, counts=True, pairs=9).collect()} == Counter(e for e, _ in co)
    plan = O.cooccurrence(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Join" not in E.entity_edges(m)._jdf.queryExecution().optimizedPlan().toString()


def test_partners_of_other_ids_are_an_error(spark):
    with pytest.raises(Exception, match="eight hex digits"):
        partners(spark.createDataFrame([("s", "word", 1)], "sphere_id string, entity_id string, seq long")).collect()


def test_shared_entities_in_blocks(spark):
    lists = [(s, set(l)) for s, l in _texts(50, [f"w{i}" for i in range(9)], 4)]
    m = _mentioned(spark, [(s, sorted(l)) for s, l in lists])
    sets = {s: l for s, l in lists if l}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    for block in (7, 2048):
        assert {(r.a, r.b): (r.c, r.na, r.nb) for r in sharing(m, block=block).collect()} == want


def test_bridges_of_all_partners(spark):
    """A phrase in more than 30 spheres, and one with more than five partners."""
    lists = [(f"s{i}", ["hub", *(f"part{k}" for k in range(8))]) for i in range(35)]
    m = _mentioned(spark, lists)
    words = ["hub", *(f"part{k}" for k in range(8))]
    two = sum(1 for k, a in enumerate(words) for b in words[k + 1 :] if _ident(a) < _ident(b))  # counted from the earlier word only
    assert E.role_bridge(O.cooccurrence(m), m, part=8).count() == two * 35 * 34 // 2


def test_closest_is_the_best_of_all_pairs(spark):
    """One scan of blocks against the windows over all pairs, with equal vectors, a null, and clusters of one and none."""
    r = random.Random(7)
    vec = [(str(i), [float(r.randint(-2, 2)) for _ in range(4)], r.choice([0, 1, 2]), "f") for i in range(120)]
    vec += [("x", None, 1, "f"), ("y", [1.0, 0.0, 0.0, 0.0], 9, "f"), ("z", [1.0, 0.0, 0.0, 1.0], None, "f")]
    s = spark.createDataFrame(vec, "id string, embedding array<double>, cluster_id int, source_file string")
    p = E.pairs(s, 0.3).withColumn("sim", F.round("sim", 12))  # equal cosines are equal, whichever product made them
    want = {(x.a, x.b, round(x.sim, 9)) for x in E._both_ways(p).withColumn("rn", F.row_number().over(Window.partitionBy("a", "b_cluster_id").orderBy(F.desc("sim"), "b"))).where("rn <= if(a_cluster_id = b_cluster_id, 3, 1)").where("a_cluster_id is not null and b_cluster_id is not null").collect()}
    for block, step in ((16, 8), (4096, 1024)):
        got = closest(s, 0.3, top=3, block=block, step=step).collect()
        by = lambda t: {(a, sim) for a, _, sim in t}  # noqa: E731  the sims of each row; equal ones may differ in the last digit
        assert len(got) == len(want) and by({(x.a, x.b, round(x.sim, 9)) for x in got}) == by(want)
    s = s.withColumn("chunk_index", F.lit(0))
    assert E.build(s, threshold=0.3, with_causal=False)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_silhouette_and_density_in_one_scan(spark):
    g = np.random.default_rng(8)
    v, c = g.normal(size=(90, 3)), np.arange(90) % 3
    s = spark.createDataFrame([(str(i), v[i].tolist(), int(c[i])) for i in range(90)], "id string, embedding array<double>, cluster_id int")
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    inner = np.array([d[i][c == c[i]].sum() / 29 for i in range(90)])
    outer = np.array([min(d[i][c == k].mean() for k in range(3) if k != c[i]) for i in range(90)])
    want = ((outer - inner) / np.maximum(inner, outer)).mean()
    for block in (16, 1024):
        sil, den = C.silhouette(s, s, block=block, step=7), D.density(s, 5, block=block, step=7)
        assert abs(sil.first()[0] - want) < 1e-5
        ip = -np.sort(-(v @ v.T), axis=1)[:, 1:5].mean(1)
        assert all(abs(r.mean_ip - ip[int(r.id)]) < 1e-9 for r in den.collect())
        # one row for each vector (and cluster) leaves the scan, not one for each pair of blocks
        assert not any("FlatMapGroups" in x._jdf.queryExecution().optimizedPlan().toString() for x in (sil, den))


def test_causes_and_sentences_in_small_blocks(spark, monkeypatch):
    """Blocks of a few spheres give the rows of one block; words are not rows, so no join is on them."""
    r = random.Random(11)
    words = "model data leads therefore to result 3.5% shows memory because use input of long".split()
    text = lambda: " ".join(" ".join(r.choice(words) for _ in range(r.randint(3, 14))) + r.choice(".!") for _ in range(4))
    rows = [(f"s{i:02}", f"f{i % 2}", text()) for i in range(28)] + [("same", "f0", "It therefore leads to long data and model."), ("again", "f0", "It therefore leads to long data and model."), ("none", "f1", None), (None, "f1", text()), ("nowhere", None, text())]
    s = spark.createDataFrame(rows, "id string, source_file string, text string")
    whole = {tuple(x) for x in E.causal(s).collect()}
    assert {("same", "again"), ("again", "same")} <= {x[:2] for x in whole} and not {None, "nowhere"} & {i for x in whole for i in x[:2]}
    monkeypatch.setattr(E, "ASKING", 3)
    monkeypatch.setattr(E, "ASKED", 2)
    parts = E.causal(s)
    got = [tuple(x) for x in parts.collect()]
    assert set(got) == whole and len(got) == len(whole)
    assert "explode(words" not in (plan := parts._jdf.queryExecution().optimizedPlan().toString()) and "explode(cw" not in plan


def test_output_of_a_stream_stays_on_executors(spark, tmp_path):
    """Several batches and none; the table is a scan of files, not rows that the driver holds."""
    for k in range(3):
        spark.range(4 * k, 4 * k + 4).selectExpr("id", "id % 2 AS k").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    e = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    n = lambda d: d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = I.collect_stream(n(e), Q._name("all"), "complete")
    assert {r.k: r.n for r in got.collect()} == {0: 6, 1: 6}
    assert sorted(r.n for r in I.collect_stream(n(e), Q._name("each"), "update").collect()) == [2, 2, 4, 4, 6, 6]
    assert sorted(r.id for r in I.collect_stream(e, Q._name("rows")).collect()) == list(range(12))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Memory" not in plan
    (tmp_path / "none").mkdir()
    none = I.collect_stream(n(spark.readStream.schema("id long, k long").parquet(f"{tmp_path}/none")), Q._name("none"), "complete")
    assert none.columns == ["k", "n"] and none.count() == 0


def test_blocks_of_vectors_in_many_batches(spark, small_batches):
    """A block's vectors come in several Arrow batches; each is kept (more than a file object holds back)."""
    g = np.random.default_rng(12)
    s = spark.createDataFrame([(str(i), x.tolist(), i % 2) for i, x in enumerate(g.normal(size=(120, 64)))], "id string, embedding array<double>, cluster_id int")
    p = E.pairs(s, 0.1)
    want = {(x.a, x.b): x.sim for x in E._both_ways(p).withColumn("rn", F.row_number().over(Window.partitionBy("a", "b_cluster_id").orderBy(F.desc("sim"), "b"))).where("rn <= if(a_cluster_id = b_cluster_id, 10, 1)").collect()}
    got = {(x.a, x.b): x.sim for x in closest(s, 0.1, block=64).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_labels_without_edges(spark, monkeypatch, small_batches):
    """Propagation in blocks and steps against the join with all edges; vectors or entities alone, equal vectors, isolated nodes."""
    g, r = np.random.default_rng(13), random.Random(13)
    v = [(str(i), None if i % 5 == 0 else g.normal(size=64).tolist()) for i in range(90)] + [("far", [0.0] * 64), ("one", [1.0] * 64), ("two", [2.0] * 64)]
    s = spark.createDataFrame(v, "id string, embedding array<double>")
    m = spark.createDataFrame([(str(i), f"{r.randint(0, 40):08x}") for i in range(60, 120) for _ in range(2)] + [("110", "no hex id"), ("111", "no hex id"), (None, "00000001")], "sphere_id string, entity_id string")
    seeds = s.selectExpr("id", "concat('c', ascii(id) % 3) AS label").where("id like '%2' or id like '1%'")
    shape = [(2048, 512, 16384), (5, 7, 20)]
    for ments, t, seed in ((m, 0.2, None), (None, 0.2, seeds), (m, 0.9, seeds)):
        want = {x.id: x.label for x in G.label_propagation(H.graph(s, m.where("sphere_id is not null") if ments is not None else None, t), 3, seed).collect()}
        for rows, step, block in shape:
            monkeypatch.setattr(P, "ROWS", rows)
            monkeypatch.setattr(P, "STEP", step)
            got = P.labels(s, ments, t, 3, seed, block)
            assert {x.id: x.label for x in got.collect()} == want and got.count() == len(want)
    assert "far" not in want and {"one", "two"} <= want.keys()
    old = s.where("id not like '%3'")
    both = H.graph(old, None, 0.2)
    labels = [{(x.id, x.label) for x in H.incremental_grow(s, old, e, seeds, None, threshold=0.2, rounds=2)[1].collect()} for e in (both, None)]
    assert labels[0] == labels[1]


def _nearest_of(m, ids, k, asks, threshold, top):
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    out = set()
    for a in np.flatnonzero(asks):
        s = np.einsum("ij,ij->i", np.repeat(u[a][None], len(u), 0), u)
        for c in np.unique(k):
            at = sorted((b for b in np.flatnonzero((k == c) & (s > threshold)) if b != a), key=lambda b: (-s[b], ids[b]))
            out |= {(ids[a], ids[b]) for b in at[: top if c == k[a] else 1]}
    return out


@pytest.mark.parametrize("case", ["equal", "too near for single precision", "apart"])
@pytest.mark.parametrize("waiting", [5, 1 << 21])
def test_closest_is_exact_in_single_precision(case, waiting, monkeypatch):
    """Equal vectors, and vectors whose cosines single precision can't tell apart, in tiles of few rows."""
    g = np.random.default_rng(13)
    m = g.normal(size=(300, 6))
    m = {"equal": m[g.integers(0, 9, 300)], "too near for single precision": 1 + 1e-6 * m, "apart": m}[case]
    k, ids, asks = g.integers(0, 3, 300), [str(i) for i in g.permutation(300)], g.random(300) < 0.6
    monkeypatch.setattr(scan, "ROWS", 64)
    monkeypatch.setattr(scan, "WAITING", waiting)
    got = [p for b in scan._closest(m, pa.array(ids), k, asks, 0.1, 4, 50) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert len(got) == len(set(got)) and set(got) == _nearest_of(m, ids, k, asks, 0.1, 4)


def test_closest_holds_a_tile_and_deals_few_blocks(spark):
    """What a task holds doesn't grow with its asking rows, nor do the blocks with the table."""
    g = np.random.default_rng(14)
    m, k, ids = g.normal(size=(20000, 8)).astype(np.float32), np.arange(20000) % 4, pa.array([str(i) for i in range(20000)])
    tracemalloc.start()
    for _ in scan._closest(m, ids, k, np.ones(20000, bool), 0.3, 3, 512):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6
    many = spark.range(200000).select(F.col("id").cast("string").alias("id"), F.array(F.lit(1.0), F.rand(1)).alias("embedding"), F.lit(0).alias("cluster_id"))
    plan = closest(many, 0.3)._jdf.queryExecution().optimizedPlan().toString()
    assert int(re.search(r"RepartitionByExpression .*\], (\d+)", plan)[1]) <= 2 * spark.sparkContext.defaultParallelism
