"""The corpus pipeline: five stages over documents, each written and read again by who runs it in steps.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents.  Rows leave by a stage's decision only: toxic documents, near copies of a kept document, and
documents with a word inside a benchmark window, however long they are.  n_chars follows the text when lines
are dropped.

Defined results: null and empty texts go through every stage, as do rows with a null id; repeated rows of an id are
kept or leave together; empty tables give no rows; further columns of documents, whatever their names, are
kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.bpe import digests
from orrery.llm.common import Scratch, table
from orrery.llm.decontam import match_benchmark
from orrery.llm.line_dedup import drop_recurring_lines
from orrery.llm.neardup import link
from orrery.llm.toxicity import score_documents


def _keep(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose id isn't among the rejected ones; a null id stays."""
    return docs.join(rejected.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, score_documents(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, link(docs).where("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, match_benchmark(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
