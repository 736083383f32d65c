"""Pluggable models: embedders, scorers, rewriters and answerers, with deterministic offline ones.

A backend is a function from a list of prompts to a list of replies; it runs in Arrow batches on the executors.
An unknown backend, or one that fails, gives an error row and never fails the query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T

REPLY = "reply string, error string"
Backend = Callable[[list[str]], list[str]]


def extractive(prompts: list[str]) -> list[str]:
    """Offline answerer: the first sentence of the prompt's first passage."""
    return [p.split("] ", 1)[-1].split(". ", 1)[0][:300] for p in prompts]


def lexical(prompts: list[str]) -> list[str]:
    """Offline scorer for 'query<TAB>text': 1 to 5 by the share of the query's words in the text."""
    out = []
    for p in prompts:
        q, _, t = p.partition("\t")
        words, body = set(q.lower().split()), set(t.lower().split())
        out.append(str(round(1 + 4 * len(words & body) / max(1, len(words)), 2)))
    return out


BACKENDS: dict[str, Backend] = {"offline": extractive, "lexical": lexical}


def backends() -> dict[str, bool]:
    """Every backend, and whether a probe of one prompt comes back."""
    return {name: available(name) for name in BACKENDS}


def available(backend: str) -> bool:
    try:
        return backend in BACKENDS and len(BACKENDS[backend](["ping"])) == 1
    except Exception:  # noqa: BLE001
        return False


def generate(prompt: Column, backend: str = "offline") -> Column:
    """struct(reply, error)."""
    fn = BACKENDS.get(backend)

    @F.pandas_udf(REPLY)
    def run(p: pd.Series) -> pd.DataFrame:
        if fn is None:
            return pd.DataFrame({"reply": [None] * len(p), "error": [f"unknown backend: {backend}"] * len(p)})
        try:
            return pd.DataFrame({"reply": fn(p.fillna("").tolist()), "error": [None] * len(p)})
        except Exception as e:  # noqa: BLE001
            return pd.DataFrame({"reply": [None] * len(p), "error": [f"{type(e).__name__}: {e}"] * len(p)})

    return run(prompt)


def embed_texts(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Offline embedder: signed feature hashing of words, of length 1; equal texts have equal vectors."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1 if h & 0x10000 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def embed(docs: DataFrame, dim: int = 64, fn: Callable[[list[str], int], list[list[float]]] = embed_texts) -> DataFrame:
    """id, embedding; equal texts are embedded once a batch."""

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        uniq = t.fillna("").drop_duplicates().tolist()
        by = dict(zip(uniq, fn(uniq, dim)))
        return t.fillna("").map(by)

    return docs.select("id", run("text").alias("embedding"))


class QueryEmbedder:
    """Query vectors with a bounded cache; when it is full its older quarter goes."""

    def __init__(self, dim: int = 64, fn: Callable[[list[str], int], list[list[float]]] = embed_texts, most: int = 1000, prefix: str = ""):
        self.dim, self.fn, self.most, self.prefix = dim, fn, most, prefix
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, list[float]] = {}
        self.hits = self.misses = 0

    def __call__(self, text: str) -> list[float]:
        if text in self.cache:
            self.hits += 1
            return self.cache[text]
        self.misses += 1
        vec = self.fn([self.prefix + text], self.dim)[0]
        if len(self.cache) >= self.most:
            for k in list(self.cache)[: max(1, self.most // 4)]:
                del self.cache[k]
        self.cache[text] = vec
        return vec

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "size": len(self.cache), "max": self.most}


def hypothetical(query: str, backend: str = "offline") -> str:
    """A made-up answer to look for instead of the query; the query itself where the backend has none."""
    if not available(backend):
        return query
    reply = BACKENDS[backend]([f"Write a short passage that answers: {query}"])[0]
    return reply.strip() or query


#: A structured reply: JSON with these keys.
REWRITTEN = "struct<title:string,summary:string,content:string,entities:array<string>,sections:array<struct<heading:string,content:string>>>"


def rewrite_full(docs: DataFrame, backend: str, *, tries: int = 3, most_chars: int = 6000, aliases: dict | None = None) -> DataFrame:
    """docs (id, text, source_file, source_type) by a model that answers in JSON, bare or in a fence.

    A reply that can't be read is asked for again, ``tries`` times in all; what has none then is rewritten by rule, as are
    all documents of an unknown backend.  rewrite_model says which path made a row.
    """
    d = docs.withColumn("_try", F.lit(None).cast(REWRITTEN))
    prompt = F.concat(F.lit("Rewrite as JSON with title, summary, content, entities and sections. Kind: "), F.coalesce("source_type", F.lit("")), F.lit("\n\n"), F.substring("text", 1, most_chars))
    for _ in range(tries if backend in BACKENDS else 0):
        reply = T.json_of_reply(generate(F.when(F.col("_try").isNull(), prompt), backend)["reply"])
        d = d.withColumn("_try", F.coalesce("_try", F.from_json(reply, REWRITTEN)))
    light = rewrite(docs.select("id", "text", "source_file", "source_type"), light=[], aliases=aliases).select("id", *[F.col(c).alias(f"_{c}") for c in ("title", "content", "summary", "entities")])
    d = d.select("id", "_try").join(light, "id")
    known = lambda e: F.transform(e, lambda x: T.canonical(x, aliases))
    entities = F.array_sort(F.array_distinct(F.concat(known(F.coalesce("_try.entities", F.array().cast("array<string>"))), "_entities")))
    has = F.col("_try").isNotNull()
    return d.select(
        "id", F.coalesce("_try.title", "_title").alias("title"), F.coalesce("_try.content", "_content").alias("content"),
        F.when(has, F.coalesce("_try.summary", F.lit(""))).otherwise(F.col("_summary")).alias("summary"),
        F.when(has, entities).otherwise(F.col("_entities")).alias("entities"),
        F.coalesce("_try.sections", F.array().cast("array<struct<heading:string,content:string>>")).alias("sections"),
        F.when(has, backend).otherwise("rule").alias("rewrite_model"),
    )


def rewrite(docs: DataFrame, full: list[str] = (), light: list[str] = (), aliases: dict | None = None) -> DataFrame:
    """Clean documents: title, content, summary, entities, and which path made them (light needs no model)."""
    clean = T.drop_noise(F.col("text"))
    how = T.rewrite_strategy(F.col("source_type"), list(full), list(light))
    return docs.select("id", T.title(F.col("source_file"), clean).alias("title"), clean.alias("content"), T.summary(clean).alias("summary"), T.alias_entities(clean, aliases).alias("entities"), how.alias("rewrite_model"))
