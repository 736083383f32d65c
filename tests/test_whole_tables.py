"""Queries over whole tables against brute force on a small one with high ids and several languages."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery import registry
from orrery.operators import edges as E
from orrery.operators import hierarchy as H
from orrery.operators import roles as O
from orrery.operators.scan import nearest

WORDS = "common anchorage village harbourmaster lantern meadows".split()


@pytest.fixture(scope="module")
def docs():
    text = lambda i: f"common {WORDS[i % 5 + 1]} {WORDS[i % 3 + 1]} unique{'abcdefghijklmnopqrstuvwxyz'[i % 26]}word common"
    return [(i, text(i), "en") for i in (0, 1, 2, 3, 8)] + [(5, text(5), "de")] + [(i, text(i), "fr" if i % 2 else "en") for i in range(400, 424)]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [1.0 if k == i % 4 else 0.0 for k in range(64)], i % 4) for i, _, _ in docs], "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def words(docs):
    return {str(i): re.findall("[a-z]{6,}", t.lower()) for i, t, _ in docs}


def rows(spark, folder, name):
    return registry.QUERIES[name](spark, folder).collect()


def test_mentions_of_all_documents(spark, folder, words):
    count = Counter(w for l in words.values() for w in l)
    e = rows(spark, folder, "entities")
    assert {r.entity_text: r.occurrences for r in e} == count
    text = {r.entity_id: r.entity_text for r in e}
    r = rows(spark, folder, "role_stats")[0]
    assert (r.entities, r.active, r.occurrences, r.spheres) == (len(count), sum(n > 1 for n in count.values()), sum(count.values()), len(words))
    co = Counter((w, o) for l in words.values() for w in set(l) for o in l[l.index(w) + 1 :] if o != w)
    assert {(text[r.entity_id], text[r.other_id]): r.cnt for r in rows(spark, folder, "cooccurrence")} == {k: n for k, n in co.items() if n > 1}
    assert {r.entity_text for r in rows(spark, folder, "shared_entities")} == set(words["3"]) & set(words["8"])
    roles = {text[r.entity_id]: (r.phrase, r.head, r.attributive) for r in rows(spark, folder, "role_distribution")}
    held = Counter(w for l in words.values() for w in set(l))
    assert roles == {w: tuple(n if role == k else 0 for k in range(3)) for w, n in held.items() for role in [0 if len(w) >= 9 else 1 if len(w) >= 7 else 2]}
    sizes = Counter(int(i) % 6 for i in words)
    freq = Counter((int(i) % 6, w) for i, l in words.items() for w in set(l) if len(w) >= 9)
    assert {(r.community, r.subject): (r.freq, r.size) for r in rows(spark, folder, "community_subjects")} == {k: (n, sizes[k[0]]) for k, n in freq.items() if n > 2 and sizes[k[0]] > 4}


@pytest.mark.parametrize("name, column", [("key_entities", "sphere_id"), ("role_expand", "source"), ("concept_parents", "id"), ("split_concepts", "id")])
def test_later_documents_are_there(spark, folder, name, column):
    assert max(int(r[column]) for r in rows(spark, folder, name)) >= 400


def test_pairs_of_common_entities(spark, folder, words, monkeypatch):
    """'common' is in all spheres, in three blocks of pairs."""
    monkeypatch.setattr(E._meetings, "__defaults__", (5,))
    sets = {i: set(l) for i, l in words.items()}
    pairs = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)}
    assert {(r.a, r.b) for r in rows(spark, folder, "entity_graph")} == {p for p, n in pairs.items() if n}
    weight = lambda a, b, n: round(0.4 * (0.6 + 0.4 * n / len(sets[a] | sets[b])), 6)
    got = rows(spark, folder, "edges_entity_overlap")
    assert {(r.src, r.dst): r.weight for r in got} == {p: weight(*p, n) for p, n in pairs.items() if n > 1} and len(got) == len({(r.src, r.dst) for r in got})


def test_concepts_of_common_entities(spark, tmp_path):
    """A phrase in more than eight spheres makes a concept."""
    d = str(tmp_path)
    spark.createDataFrame([(400 + i, "navigation of harbours", "de") for i in range(12)], "doc_id long, text string, lang string").withColumn("source", F.lit("s")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(400 + i, [float(i == k) for k in range(64)], 0) for i in range(12)], "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    assert [(r.text, r.freq) for r in rows(spark, d, "grow_hierarchy")] == [("navigation", 12)]


def test_nearest_in_blocks(spark):
    r = random.Random(3)
    vec = [(str(i), [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(90)] + [("none", None)]
    d = spark.createDataFrame(vec, "id string, embedding array<double>")
    got = {}
    for row in nearest(d.where("try_cast(id as int) % 9 = 0"), d, 7, block=16).collect():
        got.setdefault(row.query_id, []).append((-row.score, row.id))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for q, v in vec[:90:9]:
        assert sorted(got.pop(q)) == sorted((-dot(v, w), i) for i, w in vec[:90])[:7]
    assert not got


def test_expansion_keeps_the_best_of_a_common_entity(spark):
    """An entity that all spheres hold, against the join without any cut."""
    r = random.Random(4)
    m = [(str(i), w, w, role, k) for i in range(60) for k, (w, role) in enumerate([("all", "head"), (f"e{r.randint(0, 8)}", r.choice(["phrase", "attributive"])), (f"f{r.randint(0, 20)}", "phrase")])]
    t = spark.createDataFrame(m, "sphere_id string, entity_id string, entity_text string, role string, seq int")
    for top in (1, 3, 10):
        assert {tuple(x) for x in O.expand(t, top=top).collect()} == {tuple(x) for x in O.expand(t, top=10**6).withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("confidence"), "target", "entity_id", "role"))).where(f"rn <= {top}").drop("rn").collect()}


def test_incremental_pairs_are_those_with_a_new_end(spark):
    r = random.Random(5)
    s = spark.createDataFrame([(str(i), [r.uniform(-1, 1) for _ in range(3)]) for i in range(50)], "id string, embedding array<double>")
    m = spark.createDataFrame([(str(i), e) for i in range(50) for e in {"common", f"e{r.randint(0, 12)}"} if e != "common" or i % 3], "sphere_id string, entity_id string")
    new = s.where("cast(id as int) % 7 = 2")
    ids = {x.id for x in new.collect()}
    every = {(x.a, x.b) for x in E.vector_edges(s, 0.8).unionByName(E.entity_edges(m)).collect()}
    assert {(x.a, x.b) for x in H.incremental_edges(s, new, m, 0.8).collect()} == {p for p in every if ids & set(p)}
    assert sorted((x.src, x.dst) for x in E.meetings_with(m, new, block=4).collect()) == sorted((x.src, x.dst) for x in E.meetings_with(m, new).collect())


def test_causes_against_every_sentence(spark):
    """Joined over shared words and best sentences, as scored for each pair of sentences."""
    r = random.Random(6)
    words = "model data leads therefore to result 3.5% shows memory because use input of long".split()
    text = lambda: " ".join(" ".join(r.choice(words) for _ in range(r.randint(3, 14))) + r.choice(".!") for _ in range(4))
    s = spark.createDataFrame([(f"s{i:02}", f"f{i % 3}", text()) for i in range(30)], "id string, source_file string, text string")
    c = E.cause_sentences(s)
    e = E._paragraph_sentences(s, 20).select(F.col("id").alias("other"), "source_file", F.col("i").alias("j"), F.col("s").alias("effect"))
    d = c.join(e, "source_file").where("id <> other").withColumn("score", F.round(E.effect_score(F.col("cause"), F.col("effect")), 9)).where("score >= 0.3")
    want = {}
    for x in sorted(d.collect(), key=lambda x: (x.i, -x.score, x.j)):
        want.setdefault((x.id, x.other), round(min(0.6, max(0.1, 0.35 + 0.3 * x.score)), 9))
    got = {(x.src, x.dst): round(x.weight, 9) for x in E.causal(s).collect()}
    assert got == want and len(got) > 20


def test_explore_takes_texts_of_its_rows_alone(spark, folder, docs):
    """The text of a row that isn't shown never leaves the scan of documents."""
    q = registry.QUERIES["explore"](spark, folder)
    assert {r.id for r in q.collect()} == {str(i) for i, _, _ in docs if i % 4 == 3}
    plan = q._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scans = [" ".join(plan[i - 2 : i]) for i, x in enumerate(plan) if "Relation [" in x and "text#" in x]
    assert any("text#" in x for x in scans) and all(re.search(r" IN \(| INSET ", x) for x in scans if "text#" in x)


def test_upserted_graph_is_made_once(spark, folder):
    q = registry.QUERIES["edge_upsert"](spark, folder)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") < 2
    assert {r.weight for r in q.collect() if int(r.src) % 5 == 0} == {-0.5}
