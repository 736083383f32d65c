"""Operators that SQL can't express, against plain loops."""

import random

from pyspark.sql import functions as F

from orrery.functions import structure as U
from orrery.operators import cluster as C
from orrery.operators import retrieve as R
from orrery.streaming.ingest import to_spheres


def test_greedy_diversity(spark):
    """Five picks, each scored against those before it."""
    r = random.Random(8)
    rows = [("q", f"c{i:02}", [r.uniform(-1, 1) for _ in range(4)], f"s{i % 3}", r.choice(["en", "fr"])) for i in range(20)]
    q, aff = [r.uniform(-1, 1) for _ in range(4)], {"en": 0.4}
    edges = [(f"c{i:02}", f"c{(i * 7 + 3) % 20:02}", r.uniform(0, 1)) for i in range(20)]
    d = spark.createDataFrame(rows, "query_id string, id string, embedding array<double>, source_file string, source_type string")
    got = R.diversity_sort(d, q, affinities=aff, edges=spark.createDataFrame(edges, "src string, dst string, weight double")).orderBy("rank").collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    link = {(a, b): w for a, b, w in edges if w >= 0.15}
    chosen, want = [], []
    for _ in range(5):
        best = None
        for x in rows:
            if x in chosen:
                continue
            score = dot(x[2], q) + 0.1 * aff.get(x[4], 0)
            if chosen:
                kin = [dot(x[2], y[2]) for y in rows if y[4] == x[4] and y is not x]
                n = sum(y[3] == x[3] for y in chosen)
                score = 0.5 * dot(x[2], q) - 0.5 * max(dot(x[2], y[2]) for y in chosen) + 0.1 * aff.get(x[4], 0) - 0.05 * (sum(kin) / len(kin) if kin else 0)
                score -= (0.15 * 1.5 ** (n - 1) if n else 0) + 0.1 * sum(link.get((x[1], y[1]), 0) for y in chosen)
            if best is None or score > best[0]:
                best = (score, x)
        chosen.append(best[1])
        want.append((best[1][1], round(best[0], 4)))
    assert [(x.id, x.score) for x in got] == want


def test_clusters_of_groups_apart(spark):
    r = random.Random(9)
    rows = [(f"v{i}", [float(i % 6 == k) * 5 + r.uniform(-0.1, 0.1) for k in range(6)]) for i in range(120)]
    v = spark.createDataFrame(rows, "id string, embedding array<double>")
    label, centre, _ = C.kmeans(v, 6)
    of = {x.id: x.cluster_id for x in label.collect()}
    assert len({of[f"v{i}"] for i in range(6)}) == 6 and all(of[f"v{i}"] == of[f"v{i % 6}"] for i in range(120))
    assert centre.count() == 6 and C.auto_k(v) == 6


def test_documents_as_chunks(spark):
    texts = ["word " * 900, "# A\nshort\n# B\n" + "x " * 2000, "one"]
    docs = [(t, f"f{i}.md", k) for i, t in enumerate(texts) for k in ("技术笔记", "other")]
    got = to_spheres(spark.createDataFrame(docs, "text string, source_file string, source_type string"))
    want = {(f, c) for t, f, k in docs for c in U.chunk(t, k)}
    assert {(x.source_file, x.text) for x in got.collect()} == want and got.select(F.countDistinct("id")).first()[0] == len(want)
