"""Paper feeds that have been landed as Atom files, and papers as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as T

ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>"


def read_atom(spark: SparkSession, path: str, need_summary: bool = True) -> DataFrame:
    """paper_id, title, abstract, published, authors, categories."""
    e = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    out = e.select(F.element_at(F.split("id", "/"), -1).alias("paper_id"), one("title").alias("title"), one("summary").alias("abstract"), F.substring("published", 1, 10).alias("published"), F.transform("author", lambda a: a["name"]).alias("authors"), F.transform("category", lambda c: c["_term"]).alias("categories"))
    return out.where("coalesce(abstract, '') <> ''") if need_summary else out


def as_markdown(papers: DataFrame) -> DataFrame:
    """file_name, body."""
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n**Authors**: "), F.array_join("authors", ", "), F.lit("\n**Published**: "), F.col("published"), F.lit("\n**Categories**: "), F.array_join("categories", ", "), F.lit("\n\n## Abstract\n\n"), T.clean_references(F.col("abstract")), F.lit("\n"))
    return papers.select(F.concat(F.substring(F.md5("paper_id"), 1, 12), F.lit(".md")).alias("file_name"), T.file_name(F.col("title")).alias("title_name"), body.alias("body"))
