"""Incremental ingest: a file stream whose batches go through the batch operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import schema
from orrery.functions.structure import chunk_by_type_udf
from orrery.operators import store as S
from orrery.sources.scratch import folder


def to_spheres(docs: DataFrame) -> DataFrame:
    """docs (text, source_file, source_type) as chunks with ids; equal chunks of a file are one."""
    c = docs.select("source_file", "source_type", F.posexplode(chunk_by_type_udf()("text", "source_type")).alias("chunk_index", "text"))
    return schema.complete(c.withColumn("id", schema.sphere_id(F.col("source_file"), F.col("text")))).dropDuplicates(["id"])


def upsert_into(store, name: str = "spheres", parts: int = 64) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends what isn't there; a batch that runs again adds nothing.

    A batch writes its own rows only; a table of more than ``parts`` directories is made one.
    """

    def batch(docs: DataFrame, _: int) -> None:
        new = to_spheres(docs)
        have = store.current()
        store.append({name: S.insert(store.load(name), new) if name in have else new})
        if len(have.get(name, ())) >= parts:
            store.compact(name)

    return batch


def run(stream: DataFrame, store, checkpoint: str):
    """Everything that is there now, then stop; the query to wait for."""
    return stream.writeStream.foreachBatch(upsert_into(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collect_stream(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All output of a bounded stream as a table: in mode ``complete`` that of the last batch, else of every batch.

    Executors write the rows to the shared folder, beside the state; none comes to the driver.
    """
    spark: SparkSession = df.sparkSession
    root, done = folder(spark, name), []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{k}")
        if k not in done:
            done.append(k)

    df.writeStream.foreachBatch(put).queryName(name).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{root}/out/{k}" for k in (done[-1:] if mode == "complete" else done)])


def online_centroids(stream: DataFrame, by: str = "source_type") -> DataFrame:
    """by, n, centroid as vectors arrive (by, seq, embedding): each normalised after every vector.

    A trigger's vectors of a key come in several Arrow batches and in no order; they are laid down in a local file
    and read in the order of ``seq``, so a task holds the order and one batch of them.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        n, c = (state.get[0], np.array(state.get[1])) if state.exists else (0, None)
        with tempfile.TemporaryFile() as f:
            order, dim = [], 0
            for b in batches:
                if len(b):
                    m = np.stack(b["embedding"].to_numpy()).astype(np.float64)
                    dim = m.shape[1]
                    f.write(m.tobytes())
                    order.append(b["seq"].to_numpy())
            f.flush()
            order = np.argsort(np.concatenate(order), kind="stable") if order else []
            rows = np.memmap(f, np.float64, "r", shape=(len(order), dim)) if len(order) else None
            for at in order:
                v = np.array(rows[at])
                c = v if c is None else c + (v - c) / (n + 1)
                norm = np.sqrt(c @ c)
                c = c / norm if n and norm else c
                n += 1
        if n:
            state.update((int(n), c.tolist()))
            yield pd.DataFrame({by: [key[0]], "n": [n], "centroid": [c.tolist()]})

    return stream.select(by, "seq", "embedding").groupBy(by).applyInPandasWithState(step, f"{by} string, n bigint, centroid array<double>", "n bigint, centroid array<double>", "update", GroupStateTimeout.NoTimeout)
