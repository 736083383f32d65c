"""Canonical tables and their identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPHERES = T.StructType(
    [
        T.StructField("id", T.StringType(), False), T.StructField("text", T.StringType()), T.StructField("source_file", T.StringType()),
        T.StructField("source_type", T.StringType()), T.StructField("mass", T.DoubleType()), T.StructField("diversity", T.DoubleType()),
        T.StructField("effective_mass", T.DoubleType()), T.StructField("gravity_field", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("term_weights", T.MapType(T.StringType(), T.DoubleType())), T.StructField("cluster_id", T.IntegerType()),
        T.StructField("active", T.BooleanType()), T.StructField("created_at", T.StringType()), T.StructField("level", T.IntegerType()),
        T.StructField("parent_id", T.StringType()), T.StructField("child_ids", T.ArrayType(T.StringType())), T.StructField("embedding_source", T.StringType()),
        T.StructField("doc_terms", T.ArrayType(T.StringType())), T.StructField("poincare_norm", T.DoubleType()), T.StructField("poincare_norm_source", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
    ]
)

#: Values of columns that an older or partial record lacks.
DEFAULTS: dict[str, object] = {
    "source_type": "", "mass": 1.0, "diversity": 0.0, "cluster_id": -1, "active": True, "created_at": "", "level": 2, "parent_id": "",
    "embedding_source": "sentence", "poincare_norm": 0.5, "poincare_norm_source": "default", "chunk_index": 0,
}

SPHERE_VERSION, REGISTRY_VERSION, ROLE_VERSION, CONNECTION_VERSION, GRAPH_VERSION, CLUSTER_VERSION = 4, 1, 1, 1, 1, 1


def sphere_id(source_file: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_file, F.lit(":"), text), 256), 1, 12)


def concept_id(text: Column) -> Column:
    return F.concat(F.lit("c_"), F.substring(F.md5(F.concat(F.lit("concept:"), F.lower(F.trim(text)))), 1, 8))


def entity_id(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def index_id(id_: Column) -> Column:
    """48-bit integer of a hexadecimal id."""
    return F.conv(id_, 16, 10).cast("long")


def id_of_index(index: Column) -> Column:
    return F.lpad(F.lower(F.hex(index)), 12, "0")


def effective_mass(mass: Column, diversity: Column, factor: float = 1.0) -> Column:
    return mass * (1 + factor * diversity)


def complete(df: DataFrame) -> DataFrame:
    """The table with every canonical column, typed, missing values filled with their defaults."""
    have = set(df.columns)
    cols = []
    for f in SPHERES.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name == "effective_mass":
            get = lambda n: F.coalesce(F.col(n), F.lit(DEFAULTS[n])) if n in have else F.lit(DEFAULTS[n])
            c = effective_mass(get("mass"), get("diversity"))
        elif f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]).cast(f.dataType))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif isinstance(f.dataType, T.MapType):
            c = F.coalesce(c, F.create_map().cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def check_norm(norm: Column, low: float = 0.05, high: float = 0.90) -> Column:
    """The norm, or an error outside [low, high]."""
    return F.when((norm >= low) & (norm <= high), norm).otherwise(F.raise_error(F.concat(F.lit("norm out of range: "), norm.cast("string"))).cast("double"))


def check_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the wrong length or with missing values raise."""
    bad = (F.size("embedding") != dim) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return vectors.withColumn("embedding", F.when(~bad, F.col("embedding")).otherwise(F.raise_error(F.lit("vector of the wrong shape")).cast("array<float>")))
