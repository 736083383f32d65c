"""Persisted tables: JSON files of other stores in, versioned Parquet directories in and out."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import schema


def _whole(spark: SparkSession, path: str, shape: str, newest: int) -> DataFrame:
    """The file's one JSON value; a version beyond ``newest`` raises."""
    v = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j")).select("j.*")
    if "version" in v.columns:
        bad = F.raise_error(F.concat(F.lit("newer version: "), F.col("version").cast("string"))).cast("int")
        v = v.withColumn("version", F.when(F.coalesce("version", F.lit(1)) <= newest, F.col("version")).otherwise(bad)).where("version is null or version >= 0")
    return v


_SPHERE = "struct<id:string,text:string,source_file:string,source_type:string,mass:double,diversity:double,effective_mass:double,connections:map<string,double>,gravity_field:map<string,double>,term_weights:map<string,double>,cluster_id:int,active:boolean,created_at:string,level:int,parent_id:string,child_ids:array<string>,embedding_source:string,doc_terms:array<string>,poincare_norm:double,poincare_norm_source:string>"


def read_spheres(spark: SparkSession, path: str) -> DataFrame:
    rows = _whole(spark, path, f"version int, spheres map<string,{_SPHERE}>", schema.SPHERE_VERSION).select(F.posexplode(F.map_entries("spheres")).alias("chunk_index", "e"))
    return schema.complete(rows.select(F.col("e.key").alias("id"), *[F.col(f"e.value.{f.name}") for f in schema.SPHERES.fields if f.name not in ("id", "chunk_index")], "chunk_index"))


def read_sphere_edges(spark: SparkSession, path: str) -> DataFrame:
    rows = _whole(spark, path, f"version int, spheres map<string,{_SPHERE}>", schema.SPHERE_VERSION).select(F.explode("spheres").alias("src", "v"))
    return _dendrites(rows.select("src", F.explode("v.connections").alias("dst", "weight")))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path, "version int, mapping array<struct<faiss_id:bigint,sphere_id:string>>", schema.REGISTRY_VERSION).select(F.inline("mapping"))


def _dendrites(rows: DataFrame) -> DataFrame:
    return rows.select("src", "dst", "weight", F.lit("dendrite").alias("kind"), F.lit(None).cast("string").alias("direction"))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """Edges; axon types as a map from printed pairs to directions, or in the old form as a list of pairs."""
    j = _whole(spark, path, "version int, connections map<string,map<string,double>>, axon_types string", schema.CONNECTION_VERSION)
    e = j.select(F.explode("connections").alias("src", "m")).select("src", F.explode("m").alias("dst", "weight"))
    key = lambda c: F.regexp_extract_all(c, F.lit("'([^']*)'"), 1)
    new = j.select(F.explode(F.from_json("axon_types", "map<string,string>")).alias("k", "direction")).select(key(F.col("k")).alias("p"), "direction")
    old = j.select(F.explode(F.from_json("axon_types", "array<array<string>>")).alias("p")).select("p", F.lit("bidirectional").alias("direction"))
    ax = new.unionByName(old).where("size(p) >= 2").select(F.least(F.col("p")[0], F.col("p")[1]).alias("a"), F.greatest(F.col("p")[0], F.col("p")[1]).alias("b"), "direction").dropDuplicates(["a", "b"])
    e = e.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).join(ax, ["a", "b"], "left")
    return e.select("src", "dst", "weight", F.when(F.col("direction").isNotNull(), "axon").otherwise("dendrite").alias("kind"), "direction")


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """(sphere_id, entity_id, entity_text, role) and counts per entity."""
    e = _whole(spark, path, "version int, entities map<string,struct<text:string,occurrences:bigint,as_phrase:array<string>,as_head:array<string>,as_attributive:array<string>>>", schema.ROLE_VERSION)
    e = e.select(F.explode("entities").alias("entity_id", "v"))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"v.as_{r}").alias("ids")) for r in ("phrase", "head", "attributive")])
    r = e.select("entity_id", F.col("v.text").alias("entity_text"), F.col("v.occurrences").alias("occurrences"), F.explode(roles).alias("r"))
    return r.select(F.explode("r.ids").alias("sphere_id"), "entity_id", "entity_text", "occurrences", "r.role")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    j = _whole(spark, path, "version int, adjacency map<string,array<string>>", schema.GRAPH_VERSION)
    return j.select(F.explode("adjacency").alias("src", "l")).select("src", F.explode("l").alias("dst"))


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    v = spark.read.text(path, wholetext=True)
    return v.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("id", "community"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    j = _whole(spark, path, "version int, centroids array<array<double>>", schema.CLUSTER_VERSION)
    return j.select(F.posexplode("centroids").alias("cluster_id", "centroid"))


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """WAL entries of a folder, by file name."""
    shape = "entry_id string, status string, file string, source_type string, chunks_total int, sphere_ids array<string>, faiss_ids array<bigint>, created_at double, updated_at double"
    return spark.read.schema(shape).option("multiLine", "true").option("pathGlobFilter", "*.wal").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, in parallel; absent values stay explicit so that a reader needs no defaults."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


class Store:
    """Versioned tables under a root: a version is a directory, and the newest of numbered pointer files names those that count.

    ``save_all`` writes every table of a change into a new version and a pointer of the next number last, by one rename, so
    that readers see all of a change or nothing of it, and a job that dies at any point leaves the pointer before it in
    force.  Of two writers at once the second raises.  A table may consist of several versions' directories: ``append``
    adds one and rewrites nothing, ``compact`` makes one of them.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, rel: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def _pointers(self) -> list[int]:
        if not self._fs().exists(self._path("")):
            return []
        names = (s.getPath().getName() for s in self._fs().listStatus(self._path("")))
        return sorted(int(n[len("current-") : -len(".json")]) for n in names if n.startswith("current-") and n.endswith(".json"))

    def _pointed(self, number: int) -> dict[str, list[str]]:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/current-{number:012d}.json", wholetext=True).collect()))

    def current(self) -> dict[str, list[str]]:
        """The directories of each table."""
        known = self._pointers()
        return self._pointed(known[-1]) if known else {}

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in self.current()[name]))

    def save_all(self, tables: dict[str, DataFrame], partition: dict[str, list[str]] | None = None) -> None:
        self._change(tables, partition or {}, False)

    def append(self, tables: dict[str, DataFrame], partition: dict[str, list[str]] | None = None) -> None:
        """The rows beside those that are there; a table that isn't there is made."""
        self._change(tables, partition or {}, True)

    def compact(self, name: str) -> None:
        if len(self.current().get(name, ())) > 1:
            self.save_all({name: self.load(name)})

    def _change(self, tables: dict[str, DataFrame], partition: dict[str, list[str]], beside: bool) -> None:
        version = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        known = self._pointers()
        now = self._pointed(known[-1]) if known else {}
        for name, df in tables.items():
            w = df.write
            if name in partition:
                w = w.partitionBy(*partition[name])
            w.parquet(f"{self.root}/{version}/{name}")
            now[name] = [*(now.get(name, ()) if beside else ()), f"{version}/{name}"]
        self._point(now, known[-1] + 1 if known else 0)
        self._sweep()

    def _point(self, now: dict[str, list[str]], number: int) -> None:
        fs, tmp, final = self._fs(), self._path(f"_{number}-{uuid.uuid4().hex}.json"), self._path(f"current-{number:012d}.json")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise RuntimeError(f"another writer has published change {number} of {self.root}")

    def _sweep(self) -> None:
        """Old pointers, and versions that neither of the two newest names; of those the last ``keep`` stay, as a writer may be at them."""
        known = self._pointers()
        for number in known[:-2]:
            self._fs().delete(self._path(f"current-{number:012d}.json"), False)
        live = {p.split("/")[0] for n in known[-2:] for paths in self._pointed(n).values() for p in paths}
        old = sorted(s.getPath().getName() for s in self._fs().listStatus(self._path("")) if s.isDirectory())
        for v in [v for v in old if v not in live][: -self.keep or None]:
            self._fs().delete(self._path(v), True)
