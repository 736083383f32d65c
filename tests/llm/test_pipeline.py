"""The pipeline's stages take effect, keep clean documents and agree with run()."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    d = tmp_path_factory.mktemp("tables")
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bad = lambda: " ".join(r.choice(["zorkle", "vexim", "grumpfish"]) if r.random() < 0.2 else r.choice(vocab) for _ in range(80)) + " zorkle vexim"
    item = text(30)
    rows = [(i, text(80)) for i in range(300)] + [(300 + i, bad()) for i in range(100)]
    rows += [(500 + i, text(60) + f"\nPlease see notice number {i} for all the terms") for i in range(30)]
    rows += [(600 + i, rows[i][1] + " tail") for i in range(10)] + [(700, text(20) + " " + item)] + [(800, None), (801, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(300 <= i < 400)) for i in range(400)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    cols, seen = docs.columns, {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.cache()
        if name != "bpe":
            assert docs.columns == cols
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert len(ids["toxicity"] & set(range(300, 400))) <= 2 and len(ids["toxicity"] & set(range(300))) >= 295
    lines = seen["line_dedup"].where("doc_id between 500 and 529")
    assert ids["line_dedup"] == ids["toxicity"] and lines.where("text like '%notice%'").count() == 0 and lines.where("n_chars <> length(text)").count() == 0
    kept = ids["near_dedup"]
    assert not kept & set(range(600, 610)) and {i for i in range(10) if i in ids["toxicity"]} <= kept
    assert ids["near_dedup"] - ids["decontamination"] == {700} & ids["near_dedup"]
    assert {800, 801} <= ids["bpe"]
    whole = P.run(spark, folder)
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in seen["bpe"].collect()}


def _tables(spark, d, docs, extra=()):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_a_long_document_with_a_short_passage_leaves(spark, tmp_path):
    """However small its share is; and a document with twelve words of the passage stays."""
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = [f"item{k}" for k in range(20)]
    d = _tables(spark, tmp_path, [(1, words(3000) + " " + " ".join(passage[:13]) + " " + words(3000)), (2, words(200) + " " + " ".join(passage[:12])), (3, words(100))])
    assert sorted(x.doc_id for x in P.run(spark, d).collect()) == [2, 3]


def test_empty_tables(spark, tmp_path):
    assert P.run(spark, _tables(spark, tmp_path, [])).count() == 0


def test_odd_rows_go_through(spark, tmp_path):
    """Null ids and texts, repeats, clashing columns and a very long text."""
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long = words(150_000)
    rows = [(None, None), (None, words(30)), (1, None), (2, ""), (3, words(20)), (3, None), (4, long), (5, " \n \n")]
    rows[5] = rows[4]
    d = _tables(spark, tmp_path, rows, ("h", "t", "line", "_h", "shard", "score", "component_id", "n_hit"))
    got = P.run(spark, d).collect()
    assert sorted((x.doc_id or 0) for x in got) == [0, 0, 1, 2, 3, 3, 4, 5]
    assert max(x.n_tokens for x in got) > 150_000
