"""Empty tables, null ids and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, decontam, html_text, line_dedup, lm, media, neardup, substring_dedup, tokencount, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _media(spark, d):
    path = media.Scratch(spark).path("media")
    media.store_media(d, path)
    return media.media_features(media.read_media(spark, path))


def _labels(spark):
    return spark.createDataFrame([], "doc_id long, toxic int")


def _bench(spark):
    return spark.createDataFrame([(1, "a b c")], "item_id long, text string")


OPS = {
    "token counts": lambda s, d: tokencount.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "language model": lambda s, d: lm.score_documents(d, d),
    "lines": lambda s, d: line_dedup.drop_recurring_lines(d),
    "substrings": lambda s, d: substring_dedup.dedup_substrings(d),
    "near duplicates": lambda s, d: neardup.link(d),
    "bpe": lambda s, d: bpe.digests(d, RANKS),
    "media": _media,
    "toxicity": lambda s, d: toxicity.score_documents(d, _labels(s)),
    "decontamination": lambda s, d: decontam.match_benchmark(d, _bench(s)),
}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, docs_of, name):
    assert OPS[name](spark, docs_of([])).count() == 0


@pytest.mark.parametrize("name", OPS)
def test_null_ids_repeats_and_clashes(spark, docs_of, name):
    """Columns named as the operators' own don't matter; every row comes back, repeated ones included."""
    d = docs_of([(None, None), (None, "a b c d e f"), (7, "a b c"), (7, "a b c"), (8, "")])
    for c in ("a", "b", "n", "score", "line", "h", "key", "n_chars", "size", "frags", "cuts", "bucket", "p"):
        d = d.withColumn(c, F.lit("clash"))
    assert OPS[name](spark, d).count() == 5


def test_empty_pages(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_long_text(spark, docs_of):
    text = "some words of a very long text " * 60_000
    d = docs_of([(1, text), (2, "short")])
    for name in ("token counts", "language model", "near duplicates", "bpe", "decontamination", "toxicity", "media", "lines"):
        assert OPS[name](spark, d).count() == 2
    r = {x.doc_id: x for x in substring_dedup.dedup_substrings(docs_of([(1, text[:300_000]), (2, "short")])).collect()}
    assert r[1].n_removed == 300_000 - 31 and r[2].n_removed == 0
