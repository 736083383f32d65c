"""Quality of ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(results: DataFrame) -> DataFrame:
    """results (query_id, rank, relevant) -> mrr, recall_5, recall_10, queries: by the first relevant rank."""
    first = results.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("r"))
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("double")), 6)
    return first.agg(F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), hit(5).alias("recall_5"), hit(10).alias("recall_10"), F.count(F.lit(1)).alias("queries"))


def source_precision(results: DataFrame, expected: Column) -> DataFrame:
    """query_id, precision: share of the returned rows whose file contains an expected name."""
    hit = F.exists(expected, lambda x: F.lower(F.col("source_file")).contains(F.lower(x)))
    return results.groupBy("query_id").agg(F.round(F.avg(hit.cast("double")), 6).alias("precision"))


def compare(a: DataFrame, b: DataFrame, band: float = 0.05) -> DataFrame:
    """win, lose, tie of b against a (query_id, precision)."""
    d = a.select("query_id", F.col("precision").alias("x")).join(b.select("query_id", F.col("precision").alias("y")), "query_id").select((F.col("y") - F.col("x")).alias("d"))
    return d.agg(F.count_if(F.col("d") > band).alias("win"), F.count_if(F.col("d") < -band).alias("lose"), F.count_if(F.abs("d") <= band).alias("tie"))


def displaced(a: DataFrame, b: DataFrame, more_than: int = 5) -> DataFrame:
    """Ids whose ranks in a and b (id, rank) differ by more."""
    d = a.select("id", F.col("rank").alias("x")).join(b.select("id", F.col("rank").alias("y")), "id")
    return d.agg(F.count_if(F.abs(F.col("x") - F.col("y")) > more_than).alias("moved"), F.count(F.lit(1)).alias("common"))


def spread(pairs: DataFrame, x: str, y: str) -> DataFrame:
    r = lambda c, n: F.round(c, 6).alias(n)
    return pairs.agg(r(F.avg(x), "mean_x"), r(F.stddev_pop(x), "std_x"), r(F.avg(y), "mean_y"), r(F.stddev_pop(y), "std_y"), r(F.corr(x, y), "corr"), F.count(F.lit(1)).alias("n"))


def ranked(rows: DataFrame, score: str, descending: bool = True) -> DataFrame:
    o = F.desc(score) if descending else F.asc(score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(o, "id")))
