"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from mapped arrays.

Counting.  A map task counts the word pairs of about two million tokens at a time and sends them on as
blocks: sorted distinct contexts, run lengths, next words, small counts.  A bucket of contexts is merged in
one task, which writes sorted arrays of pair hashes and counts, and of context hashes with their totals and
numbers of pairs seen once, twice and more.  It also sends, for each next word, its number of distinct
contexts and its tokens to the word buckets, where they become sorted arrays the same way.

Hot contexts (a word may hold a third of all tokens) are spread over all buckets by pair; their partial
statistics, of at most ``HOT`` contexts, are summed by one aggregation.  Which contexts are spread is guessed from
about one document in 97; the guess balances the work and has no influence on any count.

The names of the buckets' arrays are arrays themselves, one for each ``SEGMENT`` buckets, so that neither the driver nor
a worker holds a list of all buckets: the driver sums nothing but a few totals and one name for each segment.

Scoring.  Workers map the arrays from the shared folder and look up each slice's distinct words and pairs by
binary search.  Only the pages they touch are read, so a model may exceed a worker's memory.  From a store that can't be
mapped a worker copies the arrays it looks into, ``NEAR_BYTES`` of them at most, the one used longest ago going first.

Tokens are words between ASCII white space, A-Z lower-cased, then one end; a start stands before the first word
and is never predicted.  Probability is shared out over the V known tokens and one unknown.

Defined results: null and empty texts are one end token; without training texts N and V are 0 and every token has
probability 1; a null id is trained on and not held out; repeated rows count and are scored each; further
columns are ignored.
"""

from __future__ import annotations

import io
import json
import math
import os
import pickle
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bytesops as B
from orrery.llm.archive_source import open_store
from orrery.llm.common import Scratch, arrow_map, table, texts

FLUSH = 2_000_000
BUCKET_ROWS = 1_000_000
HOT = 1000
#: Buckets whose names are one array, and partitions that merge buckets at most.
SEGMENT, MOST_PARTS = 4096, 100_000
NEAR_BYTES = 4 << 30
U = np.uint64
START, END = U(0x5354415254535441), U(0x454E44454E44454E)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def sequences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, the token before each, first token of each row); every row ends with END."""
    n = len(offs) - 1
    low = B.LOWER[data]
    s, e, row = B.spans(low, offs, B.NOT_SPACE)
    many = np.bincount(row, minlength=n) + 1
    last = np.cumsum(many) - 1
    tok = np.full(int(many.sum()), END, U)
    inner = np.ones(len(tok), bool)
    inner[last] = False
    if len(s):
        tok[inner] = B.span_hashes(B.prefix_sums(low), s, e)
    before = np.empty_like(tok)
    first = last - many + 1
    before[1:] = tok[:-1]
    before[first] = START
    return tok, before, first


def pair_keys(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return B.mix(before * U(0x9E3779B97F4A7C15) + tok)


def bucket_of(word: np.ndarray, n: int) -> np.ndarray:
    return ((word >> U(20)) % U(n)).astype(np.int64)


class Places:
    """Which bucket holds a pair."""

    def __init__(self, n: int, hot: np.ndarray):
        self.n, self.hot = n, np.sort(hot)

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(v), bool)
        k = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
        return self.hot[k] == v

    def of(self, v: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.where(self.is_hot(v), bucket_of(B.mix(key), self.n), bucket_of(v, self.n))


def _small(x: np.ndarray):
    big = np.flatnonzero(x > 255)
    return np.minimum(x, 255).astype(np.uint8), big.astype(np.uint32), x[big].astype(np.int64)


def _large(t) -> np.ndarray:
    out = t[0].astype(np.int64)
    out[t[1]] = t[2]
    return out


def pack_pairs(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """A block of pairs sorted by context."""
    first = np.flatnonzero(np.diff(v, prepend=~v[:1]))
    runs = np.diff(np.append(first, len(v)))
    return pickle.dumps((v[first], _small(runs), w, _small(c)), protocol=5)


def unpack_pairs(b: bytes):
    v, runs, w, c = pickle.loads(b)
    return np.repeat(v, _large(runs)), w, _large(c)


def _blocks_of_pairs(places: Places):
    def run(batches):
        toks, befores, size = [], [], 0

        def flush():
            v, w = np.concatenate(befores), np.concatenate(toks)
            key = pair_keys(v, w)
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            v, w = v[first], w[first]
            at = places.of(v, key[first])
            order = np.lexsort((v, at))
            v, w, c, at = v[order], w[order], count[order], at[order]
            ids, start = np.unique(at, return_index=True)
            stop = np.append(start[1:], len(at))
            blocks = [pack_pairs(v[a:z], w[a:z], c[a:z]) for a, z in zip(start, stop)]
            return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for _, data, offs in B.slices(batch):
                tok, before, _ = sequences(data, offs)
                toks.append(tok)
                befores.append(before)
                size += len(tok)
                if size >= FLUSH:
                    yield flush()
                    toks, befores, size = [], [], 0
        if size:
            yield flush()

    return run


def _save(store, path: str, x: np.ndarray) -> None:
    with store.open_output_stream(path) as f:
        buf = io.BytesIO()
        np.save(buf, x)
        f.write(buf.getbuffer())


def _merge_pairs(root: str, places: Places, n_words: int):
    """A bucket's blocks into sorted arrays; rows: what the next steps need of it."""
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.binary()), ("context", pa.int64()), ("nums", pa.list_(pa.int64()))])

    def run(key, tbl):
        bucket = key[0].as_py()
        parts = [unpack_pairs(b.as_py()) for b in tbl.column("block")]
        v, w, c = (np.concatenate(x) for x in zip(*parts))
        del parts
        k = pair_keys(v, w)
        k, first, inv = np.unique(k, return_index=True, return_inverse=True)
        c = np.bincount(inv, c, len(k)).astype(np.int64)
        v, w = v[first], w[first]
        order = np.argsort(v, kind="stable")
        vs, cs = v[order], c[order]
        at = np.flatnonzero(np.diff(vs, prepend=~vs[:1]))
        stat = np.stack([np.add.reduceat(x, at) for x in (cs, (cs == 1).astype(np.int64), (cs == 2).astype(np.int64), (cs > 2).astype(np.int64))], axis=1)
        ctx = vs[at]
        hot = places.is_hot(ctx)
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        name = f"pairs-{bucket}-{uuid.uuid4().hex}"
        for kind, x in (("key", k), ("count", c.astype(np.uint32) if c.max() < 1 << 32 else c), ("context", ctx[~hot]), ("stat", stat[~hot])):
            _save(store, f"{base}/{name}.{kind}.npy", x)
        rows = [("file", bucket, name.encode(), None, [int((c == i).sum()) for i in (1, 2, 3, 4)])]
        rows += [("hot", bucket, None, v, n.tolist()) for v, n in zip(B.signed(ctx[hot]).tolist(), stat[hot])]
        wu, inv = np.unique(w, return_inverse=True)
        kinds, tokens = np.bincount(inv), np.bincount(inv, c).astype(np.int64)
        to = bucket_of(wu, n_words)
        order = np.argsort(to, kind="stable")
        ids, start = np.unique(to[order], return_index=True)
        for b, part in zip(ids, np.split(order, start[1:])):
            rows.append(("words", int(b), pickle.dumps((wu[part], _small(kinds[part]), _small(tokens[part])), protocol=5), None, None))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _merge_words(root: str):
    def run(key, tbl):
        bucket = key[0].as_py()
        parts = [pickle.loads(b.as_py()) for b in tbl.column("block")]
        w = np.concatenate([p[0] for p in parts])
        wu, inv = np.unique(w, return_inverse=True)
        kinds = np.bincount(inv, np.concatenate([_large(p[1]) for p in parts])).astype(np.int64)
        tokens = np.bincount(inv, np.concatenate([_large(p[2]) for p in parts])).astype(np.int64)
        store, base = open_store(root)
        name = f"words-{bucket}-{uuid.uuid4().hex}"
        for kind, x in (("key", wu), ("kinds", kinds), ("tokens", tokens)):
            _save(store, f"{base}/{name}.{kind}.npy", x)
        stats = [len(wu), int(tokens.sum()), int(kinds.sum())] + [int((kinds == i).sum()) for i in (1, 2, 3, 4)] + [int((kinds > 2).sum())]
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "name": [name], "stats": pa.array([stats], pa.list_(pa.int64()))})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; halves where a count of counts is missing."""
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k) for d, k in zip((d1, d2, d3), (1.0, 2.0, 3.0)))


def build(train: DataFrame, scratch: Scratch) -> str:
    """Count the texts and write the model; its folder, whose meta.json lists the arrays."""
    root = scratch.path("model")
    spark = train.sparkSession
    hot, tokens = _hot_contexts(train)
    n = max(6, math.ceil(0.6 * tokens / BUCKET_ROWS))
    n_words = max(6, math.ceil(0.1 * tokens / BUCKET_ROWS))
    places = Places(n, hot)
    blocks = arrow_map(train.select("doc_id", "text"), _blocks_of_pairs(places), "bucket int, block binary")
    to = lambda df, n: df.repartition(min(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_PARTS), "bucket").groupBy("bucket")
    merged = scratch.put(to(blocks, n).applyInArrow(_merge_pairs(root, places, n_words), "kind string, bucket int, block binary, context long, nums array<long>"), "merged")
    words = scratch.put(to(merged.where("kind = 'words'").select("bucket", "block"), n_words).applyInArrow(_merge_words(root), "bucket int, name string, stats array<long>"), "words")
    sums = lambda df, col, k: [int(x or 0) for x in df.agg(*[F.sum(F.col(col)[i]) for i in range(k)]).first()]
    files = merged.where("kind = 'file'")
    counts, total = sums(files, "nums", 4), sums(words, "stats", 8)
    hot_sum = merged.where("kind = 'hot'").groupBy("context").agg(*[F.sum(F.col("nums")[i]).alias(f"n{i}") for i in range(4)]).collect()  # at most HOT rows
    meta = {"n": n, "n_words": n_words, "pairs": _directory(files.select("bucket", F.col("block").cast("string").alias("name")), root, "pairs"), "words": _directory(words.select("bucket", "name"), root, "words")}
    meta["hot"] = sorted([int(np.int64(r.context).view(U)), r.n0, r.n1, r.n2, r.n3] for r in hot_sum)
    meta |= {"places": [int(x) for x in places.hot], "v": total[0], "tokens": total[1], "kinds": total[2], "d2": discounts(*counts), "d1": discounts(*total[3:7])}
    d = meta["d1"]
    meta["left"] = d[0] * total[3] + d[1] * total[4] + d[2] * total[7]
    store, base = open_store(root)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/meta.json") as f:
        f.write(json.dumps(meta).encode())
    scratch.drop(merged, words)
    return root


def _directory(names: DataFrame, root: str, kind: str) -> dict[str, str]:
    """The arrays of names (bucket, name), one a segment: segment number -> array."""

    def run(key, tbl):
        segment = key[0].as_py()
        out = np.zeros(SEGMENT, "S48")
        out[np.array(tbl.column("bucket").to_pylist()) % SEGMENT] = [x.encode() for x in tbl.column("name").to_pylist()]
        store, base = open_store(root)
        name = f"{kind}-names-{segment}-{uuid.uuid4().hex}"
        _save(store, f"{base}/{name}.npy", out)
        return pa.table({"segment": pa.array([segment], pa.int32()), "name": [name]})

    rows = names.withColumn("segment", F.floor(F.col("bucket") / SEGMENT).cast("int")).groupBy("segment").applyInArrow(run, "segment int, name string")
    return {str(r.segment): r.name for r in rows.collect()}


def _hot_contexts(train: DataFrame) -> tuple[np.ndarray, float]:
    """(contexts to spread, at most HOT; about how many tokens there are), from a thin slice of the documents."""

    def count(batches):
        for batch in batches:
            for _, data, offs in B.slices(batch):
                tok, before, _ = sequences(data, offs)
                v, c = np.unique(before, return_counts=True)
                top = np.argsort(-c, kind="stable")[: 2 * HOT]
                yield pa.RecordBatch.from_arrays([pa.array(B.signed(v[top])), pa.array(c[top]), pa.array(np.where(np.arange(len(top)) == 0, len(tok), 0))], names=["v", "c", "t"])

    thin = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(97)) == 5)
    rows = arrow_map(thin.select("doc_id", "text"), count, "v long, c long, t long").groupBy("v").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    both = rows.agg(F.sum("t").alias("t")).first()
    tokens = float(both.t or 0)
    top = rows.where(F.col("c") > tokens / HOT).orderBy(F.desc("c"), "v").limit(HOT).collect()
    return np.array([r.v for r in top], np.int64).view(U), max(97 * tokens, 1.0)


class Model:
    """The arrays of a model, mapped."""

    def __init__(self, root: str):
        self.store, self.base = open_store(root)
        with self.store.open_input_stream(f"{self.base}/meta.json") as f:
            m = json.loads(f.read())
        self.m = m
        self.places = Places(m["n"], np.array(m["places"], U))
        hot = np.array([r[0] for r in m["hot"]], U)
        order = np.argsort(hot)
        self.hot, self.hot_stat = hot[order], np.array([r[1:] for r in m["hot"]], np.int64).reshape(-1, 4)[order]
        self.maps: OrderedDict[str, np.ndarray] = OrderedDict()
        self.folder, self.near = None, 0

    def array(self, name: str) -> np.ndarray:
        if name in self.maps:
            self.maps.move_to_end(name)
            return self.maps[name]
        from pyarrow import fs

        path = f"{self.base}/{name}.npy"
        if not isinstance(self.store, fs.LocalFileSystem):
            path = self._copy(path, name)
        self.maps[name] = np.load(path, mmap_mode="r")
        return self.maps[name]

    def _copy(self, path: str, name: str) -> str:
        self.folder = self.folder or tempfile.TemporaryDirectory()
        near = os.path.join(self.folder.name, f"{name}.npy")
        self.near += self.store.get_file_info(path).size
        while self.near > NEAR_BYTES and self.maps:
            old = os.path.join(self.folder.name, f"{self.maps.popitem(last=False)[0]}.npy")
            self.near -= os.path.getsize(old)
            os.remove(old)
        with self.store.open_input_stream(path) as f, open(near, "wb") as out:
            while chunk := f.read(8 << 20):
                out.write(chunk)
        return near

    def name_of(self, kind: str, bucket: int) -> str | None:
        """What the arrays of a bucket are called; None if it has none."""
        segment = self.m[kind].get(str(bucket // SEGMENT))
        return self.array(segment)[bucket % SEGMENT].decode() or None if segment else None

    @staticmethod
    def _find(keys: np.ndarray, q: np.ndarray):
        """(positions, found) of sorted queries."""
        k = np.searchsorted(keys, q)
        ok = k < len(keys)
        ok[ok] = keys[k[ok]] == q[ok]
        return k, ok

    def _by_bucket(self, bucket: np.ndarray, q: np.ndarray):
        order = np.lexsort((q, bucket))
        ids, start = np.unique(bucket[order], return_index=True)
        yield from zip(ids.tolist(), np.split(order, start[1:]))

    def words(self, w: np.ndarray):
        """(tokens, distinct contexts) of distinct words."""
        tokens, kinds = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        for b, at in self._by_bucket(bucket_of(w, self.m["n_words"]), w):
            name = self.name_of("words", b)
            if name:
                k, ok = self._find(self.array(f"{name}.key"), w[at])
                tokens[at[ok]] = self.array(f"{name}.tokens")[k[ok]]
                kinds[at[ok]] = self.array(f"{name}.kinds")[k[ok]]
        return tokens, kinds

    def contexts(self, v: np.ndarray) -> np.ndarray:
        """(total, seen once, twice, more) of distinct contexts."""
        out = np.zeros((len(v), 4), np.int64)
        for b, at in self._by_bucket(bucket_of(v, self.m["n"]), v):
            name = self.name_of("pairs", b)
            if name:
                k, ok = self._find(self.array(f"{name}.context"), v[at])
                out[at[ok]] = self.array(f"{name}.stat")[k[ok]]
        if len(self.hot):
            k, ok = self._find(self.hot, v)
            out[ok] = self.hot_stat[k[ok]]
        return out

    def pairs(self, v: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Counts of distinct pairs."""
        out = np.zeros(len(key), np.int64)
        for b, at in self._by_bucket(self.places.of(v, key), key):
            name = self.name_of("pairs", b)
            if name:
                k, ok = self._find(self.array(f"{name}.key"), key[at])
                out[at[ok]] = self.array(f"{name}.count")[k[ok]]
        return out

    def score(self, tok: np.ndarray, before: np.ndarray):
        """(training count, log10 of the base probability, log10 of the model's) of each token."""
        m = self.m
        uniq, inv = np.unique(np.concatenate([tok, before]), return_inverse=True)
        iw, iv = inv[: len(tok)], inv[len(tok) :]
        tokens, kinds = self.words(uniq)
        stat = self.contexts(uniq)
        base = np.log10((tokens + 1) / (m["tokens"] + m["v"] + 1))
        d1, d2 = np.array([0.0, *m["d1"]]), np.array([0.0, *m["d2"]])
        low = (np.maximum(kinds - d1[np.minimum(kinds, 3)], 0) + m["left"] / (m["v"] + 1)) / m["kinds"] if m["kinds"] else np.full(len(uniq), 1.0)
        key, first, back = np.unique(pair_keys(before, tok), return_index=True, return_inverse=True)
        c = self.pairs(before[first], key)
        s, p1 = stat[iv[first]], low[iw[first]]
        total = np.maximum(s[:, 0], 1)
        p = np.where(s[:, 0] > 0, (np.maximum(c - d2[np.minimum(c, 3)], 0) + (s[:, 1:] @ d2[1:]) * p1) / total, p1)
        return tokens[iw], base[iw], np.log10(p)[back]


_MODELS: dict[str, Model] = {}


def _score(root: str):
    def run(batches):
        if root not in _MODELS:
            _MODELS.clear()
            _MODELS[root] = Model(root)
        model = _MODELS[root]
        for batch in batches:
            for part, data, offs in B.slices(batch):
                tok, before, first = sequences(data, offs)
                c, base, score = model.score(tok, before)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        B.column(part, "doc_id"), pa.array(np.diff(np.append(first, len(tok)))), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                        pa.array(np.full(n, model.m["tokens"], np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first)),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, train: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Score ``docs`` with a model of ``train``: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    root = build(texts(train), scratch or Scratch(docs.sparkSession))
    return arrow_map(texts(docs), _score(root), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(col: str = "doc_id", mod: int = 7, rest: int = 2):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_documents(docs, docs.where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
