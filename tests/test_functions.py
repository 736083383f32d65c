"""Hand-computed cases and properties of the functions."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery import schema
from orrery.functions import structure as U
from orrery.functions import text as T
from orrery.functions import vectors as V


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_ids(spark):
    i = schema.sphere_id(F.lit("a.md"), F.lit("héllo"))
    assert one(spark, i) == "c5e86703a81a"
    assert one(spark, schema.index_id(i)) == 217601951377434
    assert one(spark, schema.id_of_index(schema.index_id(i))) == "c5e86703a81a"


def test_vectors(spark):
    u, v = V.literal([0.3, 0.0]), V.literal([0.0, 0.4])
    assert one(spark, V.poincare(u, u)) == 0
    d = math.acosh(1 + 2 * 0.25 / ((1 - 0.09) * (1 - 0.16)))
    assert abs(one(spark, V.poincare(u, v)) - d) < 1e-12
    assert one(spark, V.cosine(V.literal([0.0, 0.0]), v)) == 0
    assert one(spark, V.to_ball(V.literal([0.0, 0.0]), 0.5)) == [0, 0]
    assert abs(one(spark, V.norm(V.to_ball(V.literal([3.0, 4.0]), 0.5))) - 0.5) < 1e-12
    # adding the inverse gives the centre
    assert one(spark, V.norm(V.mobius_add(V.scaled(u, -1.0), u))) < 1e-12


def test_scalars(spark):
    assert [one(spark, T.norm_of_mass(F.lit(float(m)))) for m in (1, 2, 3)] == [0.6, 0.35, 0.1]
    assert abs(one(spark, T.jump_confidence(F.lit(5), F.lit(3))) - 0.94) < 1e-12
    assert one(spark, T.fused_radius(F.lit(0.5), F.lit(0.8), F.lit(0.5))) == 0.575
    assert one(spark, T.query_keywords(F.lit("foo foo bar"))) == {"foo": 0.5, "bar": 0.5}
    assert one(spark, T.json_of_reply(F.lit('x\n```json\n{"a": 1}\n```'))).strip() == '{"a": 1}'
    assert one(spark, T.json_of_reply(F.lit("none"))) is None


def test_norm_check(spark):
    import pytest

    assert one(spark, schema.check_norm(F.lit(0.05))) == 0.05
    with pytest.raises(Exception, match="norm out of range"):
        one(spark, schema.check_norm(F.lit(0.95)))


def test_complete(spark):
    r = schema.complete(spark.createDataFrame([("a", "t")], "id string, text string")).first()
    assert (r.mass, r.effective_mass, r.level, r.cluster_id, r.active, r.child_ids, r.poincare_norm) == (1.0, 1.0, 2, -1, True, [], 0.5)


words = st.lists(st.sampled_from(["alpha", "be", "c", ".", "\n", "\n\n", "! ", "长句", "，"]), max_size=200).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(words, st.integers(5, 60))
def test_recursive_chunks(text, most):
    chunks = U.chunk_recursive(text, most, 3)
    assert all(len(c) <= most + 3 for c in chunks)
    assert bool(chunks) == bool(text.strip())
    joined = chunks[0] + "".join(c[min(3, len(p)) :] for p, c in zip(chunks, chunks[1:])) if chunks else ""
    squeeze = lambda s: "".join(s.split())
    assert squeeze(joined) == squeeze(text)


def test_markdown_and_sections():
    assert U.chunk_markdown("intro\n# A\nx\n## B\ny") == ["intro", "# A\nx", "## B\ny"]
    assert U.chunk_sections([("H", "one"), ("H", "two"), ("I", "three")], 100, 5) == ["H\none\ntwo\n\nI\nthree"]
    assert U.chunk_sections([("H", "a" * 20), ("I", "b" * 20)], 30, 4) == ["H\n" + "a" * 20, "aaaa\nI\n" + "b" * 20]


def test_causal_chunks():
    chain = "We propose a method that works on long texts. Our results confirm that it improves accuracy."
    plain = "Nothing of interest happens in this paragraph at all today."
    assert U.has_causal_chain(chain) and not U.has_causal_chain(plain)
    assert U.chunk_causal("\n\n".join([chain, chain, plain])) == [chain, chain + "\n\n" + plain]


def test_attr_head():
    got = U.attr_head_pairs("基于注意力机制的神经网络模型。")
    assert got[0] == ("神经网络模型", ["基于注意力机制"], "基于注意力机制的神经网络模型", True)
    assert ("模型", ["神经网络"], "神经网络模型", False) in got
    assert U.discriminator(got[0]) == "基于注意力机制"
    assert U.attr_head_pairs("") == []


def test_triples():
    assert U.triples("冰川融化导致海平面上升很多。") == [("冰川融化", "导致", "海平面上升很多")]
    assert U.triples("The model is based on attention layers.") == [("The model", "is", "based on attention layers")]
    assert U.clean_subject("If it rains") == "" and U.clean_subject("path/to.x") == ""


def test_hybrid_triples():
    one_ = U.triples("研究者把模型部署在服务器上。")[0]
    assert U.hybrid_triples("研究者把模型部署在服务器上。")[0][1:] == one_[1:]
    assert U.hybrid_triples("我们提高了分类的精度很多。") == []
    parsed = lambda s: ("冰川研究表明", "", "海平面")
    assert U.hybrid_triples("冰川融化导致海平面上升很多。", parsed) == [("冰川", "", "海平面")]
    assert U.hybrid_triples("短。") == [] and U.hybrid_triples("") == []
    pronoun = lambda s: ("它们", "", "x")
    assert U.hybrid_triples("冰川融化导致海平面上升很多。", pronoun) == U.hybrid_triples("冰川融化导致海平面上升很多。")
