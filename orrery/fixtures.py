"""Canonical tables from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, seq, text, source_file, source_type, cluster_id, chunk_index, embedding: documents that have a vector."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("cluster_id"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("source_file"), F.col("lang").alias("source_type"))
    w = Window.partitionBy("source_file").orderBy("doc_id")
    out = d.join(e, "doc_id").withColumn("chunk_index", F.row_number().over(w) - 1)
    return out.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), "text", "source_file", "source_type", "cluster_id", "chunk_index", "embedding")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector by id: a point look-up that brings one row to the driver, as a query arrives there."""
    row = read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]
