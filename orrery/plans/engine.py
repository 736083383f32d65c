"""The engine: named tables and the queries and jobs over them."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery import schema
from orrery.functions import text as T
from orrery.operators import cluster as C
from orrery.operators import derive as D
from orrery.operators import edges as E
from orrery.operators import graph as G
from orrery.operators import hierarchy as H
from orrery.operators import retrieve as R
from orrery.operators import roles as O
from orrery.operators import store as S
from orrery.plans import models as M
from orrery.sources.tables import Store, write_json
from orrery.streaming.ingest import to_spheres

MODES = {"hyperbolic": "dual", "poincare": "poincare", "gravity": "dual", "deep": "dual"}


class Engine:
    """spheres, vectors, edges, mentions and fields as DataFrames; changes give new tables, ``save`` publishes them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, store: Store | None = None, dim: int = 64):
        self.spark, self.store, self.dim = spark, store, dim
        self.embed_query = M.QueryEmbedder(dim)
        self.tables = dict(tables or {})
        if store is not None:
            for name in store.current():
                if name != "wal":
                    self.tables.setdefault(name, store.load(name))
        self.register()

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def register(self) -> None:
        """Temp views of all tables, so that plain SQL works on them."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def save(self) -> None:
        self.store.save_all(self.tables)
        self.tables = {n: self.store.load(n) for n in self.tables}
        self.register()

    # -- queries

    def _with_vectors(self) -> DataFrame:
        return self["spheres"].join(self["vectors"], "id")

    def hyde(self, query: str, k: int = 5, backend: str = "offline", **kw) -> DataFrame:
        """``query`` by the vector of a made-up answer."""
        return self.query(M.hypothetical(query, backend), k, **kw)

    def query(self, query: str | list[float], k: int = 5, fetch_k: int = 50, mode: str = "hyperbolic", exclude: DataFrame | None = None, focus: str | None = None) -> DataFrame:
        q = self.embed_query(query) if isinstance(query, str) else query
        s = self._with_vectors()
        if focus:
            s = s.where(F.col("source_type") == focus)
        return R.retrieve(s, q, mode=MODES.get(mode, "cosine"), fetch_k=fetch_k, k=k, exclude=exclude, norm=R.valid_norm(F.col("poincare_norm")))

    def ask(self, question: str, k: int = 5, backend: str = "offline", **kw) -> DataFrame:
        """One row: question, sources, reply, error."""
        hits = self.query(question, k, **kw).select("rank", "id", T.summary(F.col("text"), 250).alias("s"))
        l = hits.agg(F.array_sort(F.collect_list(F.struct("rank", "s", "id"))).alias("l"))
        p = l.select(F.transform("l", lambda x: x["id"]).alias("sources"), F.concat(T.prompt(F.transform("l", lambda x: x["s"])), F.lit(f"\n\nQuestion: {question}")).alias("prompt"))
        return p.withColumn("g", M.generate(F.col("prompt"), backend)).select(F.lit(question).alias("question"), "sources", "g.reply", "g.error")

    def multi(self, query: str | list[float], k: int = 5, mode: str = "gravity") -> DataFrame:
        """id, score.  simple: cosine; gravity: similarity x mass; poincare: similarity over hyperbolic distance; deep: activation
        over the graph, then greedy diversity.  Another mode raises."""
        q = self.embed_query(query) if isinstance(query, str) else query
        s = self._with_vectors().where("active")
        best = lambda d: d.orderBy(F.desc("score"), "id").limit(k)
        if mode == "gravity":
            return best(R.gravity_score(s, q, F.col("effective_mass")))
        if mode == "poincare":
            return best(R.poincare_score(s, q))
        c = R.candidates(s, q)
        if mode == "simple":
            return best(c.select("id", F.col("ip").alias("score")))
        if mode != "deep":
            raise ValueError(f"no such mode: {mode}")
        seeds = {r.id: r.ip for r in c.orderBy(F.desc("ip"), "id").limit(10).select("id", "ip").collect()}
        act = G.activation(self["edges"], seeds)
        pool = s.join(act.orderBy(F.desc("activation"), "id").limit(100), "id").withColumn("query_id", F.lit("q"))
        return R.diversity_sort(pool, q, k=k, edges=self["edges"]).select("id", "score")

    def status(self) -> DataFrame:
        n = self["spheres"].agg(F.count_if("active").alias("active"), F.count(F.lit(1)).alias("total"), F.countDistinct("cluster_id").alias("clusters"))
        return n.crossJoin(self["vectors"].agg(F.count(F.lit(1)).alias("vectors")))

    def document(self, id_: str) -> DataFrame:
        return S.get(self["spheres"], id_).drop("text", "gravity_field", "term_weights")

    def list_documents(self, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of active documents by id, without their texts."""
        ids = S.page(self["spheres"], limit, offset, "id")
        return self["spheres"].join(F.broadcast(ids), "id").drop("text", "gravity_field", "term_weights").orderBy("id")

    def stats(self) -> DataFrame:
        return S.stats(self["spheres"].withColumn("seq", F.col("id")))

    def backends(self) -> dict[str, bool]:
        return M.backends()

    def connections(self, id_: str) -> DataFrame:
        return S.neighbours(self["edges"], id_)

    def navigate(self, id_: str, hops: int = 2, least: float = 0.2) -> DataFrame:
        return G.navigate(self["edges"], id_, hops, least)

    def bridge(self, a: str, b: str) -> DataFrame:
        return G.bridge(self["edges"], a, b)

    def explore(self, cluster_id: int, by: str = "effective_mass", top: int = 30) -> DataFrame:
        s = self["spheres"]
        return G.explore(s if "seq" in s.columns else s.withColumn("seq", F.col("id")), self["edges"], cluster_id, by, top)

    def trace(self, source_file: str) -> tuple[DataFrame, DataFrame]:
        return G.trace(self["spheres"], self["edges"], source_file)

    # -- changes

    def upload(self, docs: DataFrame) -> DataFrame:
        """docs (text, source_file, source_type): what was added.  Ids decide, so a second upload adds nothing."""
        new = to_spheres(docs)
        if "spheres" in self.tables:
            new = S.insert(self["spheres"], new)
        vec = M.embed(new, self.dim)
        for name, rows in (("spheres", new), ("vectors", vec)):
            self.tables[name] = self.tables[name].unionByName(rows.select(*self.tables[name].columns)) if name in self.tables else rows
        self.register()
        return new

    def delete(self, ids: DataFrame) -> None:
        edges = self.tables.get("edges", self["vectors"].select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0))
        s, v, e = S.delete(self["spheres"], self["vectors"], edges, ids)
        self.tables |= {"spheres": s, "vectors": v} | ({"edges": e} if "edges" in self.tables else {})
        self.register()

    def add_connection(self, a: str, b: str, weight: float = 1.0) -> None:
        """An edge in both directions; a known one gets the weight.  Radii stay."""
        new = self.spark.createDataFrame([(a, b, float(weight)), (b, a, float(weight))], "src string, dst string, weight double")
        self.tables["edges"] = S.upsert_edges(self["edges"], new)
        self.register()

    def rewrite(self, docs: DataFrame, backend: str | None = None, **kw) -> DataFrame:
        """docs (id, text, source_file, source_type), by rule or by a model."""
        return M.rewrite_full(docs, backend, **kw) if backend else M.rewrite(docs, **kw)

    def migrate_texts(self, backend: str | None = None) -> None:
        """All active spheres rewritten in place; ids stay, as edges and vectors hang on them."""
        new = self.rewrite(S.active(self["spheres"]), backend).select("id", F.col("content").alias("_content"))
        d = self["spheres"].join(new, "id", "left").withColumn("text", F.coalesce("_content", "text"))
        self.tables["spheres"] = d.select(*self["spheres"].columns)
        self._publish("spheres")

    def rebuild_connections(self, threshold: float = 0.5, with_causal: bool = False) -> DataFrame:
        """All edges anew; their number and the mean degree."""
        sv = self._with_vectors().where("active")
        m = self.tables.get("mentions")
        self.tables["edges"] = E.build(sv, threshold=threshold, mentions=m, cooc=O.cooccurrence(m) if m is not None else None, with_causal=with_causal)
        self._publish("edges")
        return E.graph_stats(self["edges"])

    def rebuild_axon(self, id_: str | None = None) -> DataFrame:
        """Causal edges of all spheres, or of one, merged into the graph; how many there are."""
        found = E.causal(S.active(self["spheres"]), only=id_)
        old = self.tables.get("edges")
        self.tables["edges"] = E.merge(old, found) if old is not None else E.merge(found)
        self._publish("edges")
        return self["edges"].where("kind = 'axon' and src < dst").agg(F.count(F.lit(1)).alias("axons"))

    def calibrate(self) -> DataFrame:
        """Masses and diversities from the graph; their statistics."""
        new = D.calibrate(self._with_vectors().where("active"), self["edges"]).select("id", "mass", "diversity")
        self.tables["spheres"] = S.update(self["spheres"], new)
        self._publish("spheres")
        return D.mass_stats(self["spheres"].where("active"))

    def ingest(self, docs: DataFrame, entry: str | None = None) -> DataFrame:
        """What was added, under a write-ahead entry: ready, then committing, then the tables, then done.

        The new rows are appended to the stored tables by one pointer, so an entry that isn't done when the engine starts
        again (``recover``) has added all of its rows or none, and is rolled back: the next try adds what isn't there.
        """
        entry = entry or uuid.uuid4().hex
        self._log(entry, "ready")
        new = to_spheres(docs)
        new = S.insert(self["spheres"], new) if "spheres" in self.tables else new
        self._log(entry, "committing")
        self.store.append({"spheres": new, "vectors": M.embed(new, self.dim)})
        self.tables |= {n: self.store.load(n) for n in ("spheres", "vectors")}
        self.register()
        self._log(entry, "done")
        return self.spark.read.parquet(f"{self.store.root}/{self.store.current()['spheres'][-1]}")

    def _log(self, entry: str, status: str) -> None:
        now = time.time()
        row = self.spark.createDataFrame([(entry, status, now)], "entry_id string, status string, updated_at double")
        if status == "ready":
            self.store.append({"wal": row})
        else:
            self.store.save_all({"wal": S.wal_advance(self.store.load("wal"), row)})

    def recover(self, hours: float = 24) -> DataFrame:
        """At start: unfinished entries are rolled back, old finished ones forgotten; the entries that were rolled back now."""
        if self.store is None or "wal" not in self.store.current():
            return self.spark.createDataFrame([], "entry_id string")
        wal = self.store.load("wal")
        open_ = [r.entry_id for r in wal.where("status in ('ready', 'committing')").select("entry_id").collect()]
        self.store.save_all({"wal": S.wal_clean(S.wal_recover(wal), time.time(), hours)})
        self.tables = {n: self.store.load(n) for n in self.store.current() if n != "wal"}
        self.register()
        return self.spark.createDataFrame([(e,) for e in open_], "entry_id string")

    def export(self, path: str) -> None:
        """Every table as JSON lines, in parallel, with the schemas beside them; vectors and fields included."""
        for name, df in self.tables.items():
            write_json(df, f"{path}/{name}")
        schemas = [(name, df.schema.json()) for name, df in self.tables.items()]
        self.spark.createDataFrame(schemas, "name string, shape string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_schemas")

    def restore(self, path: str) -> None:
        """The tables of an export in place of those here; a bulk import that embeds and chunks nothing."""
        for r in self.spark.read.parquet(f"{path}/_schemas").collect():
            self.tables[r.name] = self.spark.read.schema(StructType.fromJson(json.loads(r.shape))).json(f"{path}/{r.name}")
        self._publish(*self.tables)

    def rebuild(self, *, full: bool = False, k: int | None = 5, threshold: float = 0.5, with_causal: bool = False) -> None:
        """Clusters, fields, roles, edges, calibration and radius, in this order; full also embeds anew and grows concepts.

        Each step's table is published before the next reads it, which cuts lineage and lets a job that stops resume.
        """
        if full:
            self.tables["vectors"] = M.embed(S.active(self["spheres"]), self.dim)
            self._publish("vectors")
        labels, centre, _ = C.kmeans(self["vectors"], k)
        s = self["spheres"].drop("cluster_id").join(labels.select("id", "cluster_id"), "id", "left")
        self.tables |= {"spheres": s.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).select(*self["spheres"].columns), "centroids": centre}
        self._publish("spheres", "centroids")
        fields = C.fields_of_clusters(self["centroids"].withColumn("n", F.lit(0)))
        self.tables["fields"] = C.gravity_field(self["vectors"], fields)
        self.tables["mentions"] = O.mentions(S.active(self["spheres"]))
        self._publish("fields", "mentions")
        sv = self._with_vectors().where("active")
        self.tables["edges"] = E.build(sv, threshold=threshold, mentions=self["mentions"], cooc=O.cooccurrence(self["mentions"]), with_causal=with_causal)
        self._publish("edges")
        new = D.calibrate(self._with_vectors().where("active"), self["edges"]).select("id", "mass", "diversity")
        self.tables["spheres"] = S.update(self["spheres"], new)
        self._publish("spheres")
        norms = D.radius(self._with_vectors().where("active"), self["edges"]).select("id", F.col("radius").alias("norm"))
        self.tables["spheres"] = S.set_norm(self["spheres"], norms, "derived")
        self._publish("spheres")
        if full:
            self.rebuild_hierarchy()

    def rebuild_hierarchy(self, least: int = 5) -> None:
        """Concepts from label propagation over similar spheres and shared entities."""
        base = H.reset(self["spheres"])
        _, con = H.grow(base.join(self["vectors"], "id"), self["mentions"], least=least)
        par = H.parents(con)
        kids = base.join(par.withColumnRenamed("parent_id", "_p"), "id", "left").withColumn("parent_id", F.coalesce("_p", "parent_id")).drop("_p")
        of = C.concept_centroids(con, base.join(self["vectors"], "id")).select(F.col("concept").alias("id"), F.col("centroid").cast(self["vectors"].schema["embedding"].dataType).alias("embedding"))
        self.tables["vectors"] = S.add_vectors(self["vectors"].join(con.select("id"), "id", "left_anti"), of)
        top = schema.complete(con.select("id", "text", F.lit("__concept__").alias("source_file"), F.lit(1).alias("level"), "child_ids", F.lit("subject").alias("embedding_source"), "mass"))
        self.tables["spheres"] = kids.select(*self["spheres"].columns).unionByName(top.select(*self["spheres"].columns))
        self._publish("spheres", "vectors")

    def _publish(self, *names: str) -> None:
        if self.store is not None:
            self.store.save_all({n: self.tables[n] for n in names})
            for n in names:
                self.tables[n] = self.store.load(n)
        self.register()
