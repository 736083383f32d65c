"""Benchmark decontamination: a document-sharded positional inverted index.

The training documents are dealt into shards of about two million bytes.  A shard's postings (every term to the
numbers of its tokens, in term order, as differences) are stored as one row of the index table, beside its
documents and their lengths.  A test window is answered shard by shard: the posting list of its rarest term
in the shard is shifted by the term's offset, and the other terms' shifted lists are intersected from the
next rarest on; the positions that survive are exact phrase matches.  ``near_benchmark`` answers proximity
queries from the same lists: documents in which all words of a window stand close together, in any order.

Documents are the sharding key, so nothing is shuffled and no posting list, however common its term,
leaves its shard.  The tests travel in blocks of at most ``block_bytes`` (an item is never cut), one block at a
time: those beyond the first are searched in the stored index once more, and the hits of each document row are
united at the end.

Defined results: null and empty texts have no words and no hits; an item without words has no
window; items with a null id are left out, as a result couldn't name them; items with equal texts are both
reported; repeated rows of documents, with or without an id, are documents of their own and give repeated
results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bytesops as B
from orrery.llm.common import Scratch, arrow_map, table, texts

WINDOW = 13
BLOCK_BYTES = 1 << 20
GAP = 1 << 16
SPAN = 2 * WINDOW
INDEX = "docs array<long>, words array<long>, terms binary, starts binary, steps binary"
SCHEMA = "shard long, place int, doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, hit_spans array<struct<start:int,end:int>>"


def tokenize(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term hash, row) of every word, A-Z lower-cased."""
    low = B.LOWER[data]
    s, e, row = B.spans(low, offs, B.ALNUM)
    return (B.span_hashes(B.prefix_sums(low), s, e) if len(s) else np.zeros(0, np.uint64)), row


class ShardIndex:
    """Postings of one shard in term order; a posting is the token's number in the shard.

    Read for a search, numbers of adjacent words of a document are adjacent, and a gap between documents keeps a
    phrase from crossing them.
    """

    def __init__(self, terms: np.ndarray, starts: np.ndarray, post: np.ndarray, words: np.ndarray):
        self.terms, self.starts, self.words = terms, starts, words
        self.first = np.concatenate([[0], np.cumsum(words)])
        row = np.searchsorted(self.first[1:], post, side="right")
        self.post = post + row * GAP

    @classmethod
    def pack(cls, tokens: np.ndarray, row: np.ndarray, n: int) -> list:
        """The stored form of a shard's tokens: words of each document, terms, starts and steps of the lists."""
        terms, term = np.unique(tokens, return_inverse=True)
        post = np.argsort(term, kind="stable").astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
        steps = np.diff(post, prepend=0)
        steps[starts[:-1]] = post[starts[:-1]]
        return [np.bincount(row, minlength=n), terms, starts.astype(np.uint32), steps.astype(np.uint32)]

    @classmethod
    def unpack(cls, words: list[int], terms: bytes, starts: bytes, steps: bytes) -> ShardIndex:
        starts_ = np.frombuffer(starts, np.uint32).astype(np.int64)
        post = np.cumsum(np.frombuffer(steps, np.uint32).astype(np.int64))
        size = np.diff(starts_)
        before = np.where(starts_[:-1] > 0, post[np.maximum(starts_[:-1] - 1, 0)], 0) if len(post) else starts_[:-1]
        return cls(np.frombuffer(terms, np.uint64), starts_, post - np.repeat(before, size), np.array(words, np.int64))

    def document(self, pos: np.ndarray) -> np.ndarray:
        """The number in the shard of the document that has each position."""
        n = len(self.words)
        return np.searchsorted(self.first[1:] + np.arange(n, dtype=np.int64) * GAP, pos, side="right")

    def among(self, terms: np.ndarray) -> Postings:
        """The lists of the given (sorted) terms, by their number there."""
        k = np.searchsorted(self.terms, terms)
        has = k < len(self.terms)
        has[has] = self.terms[k[has]] == terms[has]
        k = np.where(has, k, 0)
        low = self.starts[k] if len(self.terms) else np.zeros(len(terms), np.int64)
        high = np.where(has, self.starts[np.minimum(k + 1, len(self.starts) - 1)], low)
        return Postings(self.post, low, high)


class Postings:
    """Posting lists by term number, for one block of tests in one shard."""

    def __init__(self, post: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.post, self.low, self.high, self.df = post, low, high, high - low

    def list(self, term: int) -> np.ndarray:
        return self.post[self.low[term] : self.high[term]]

    @staticmethod
    def _within(pos: np.ndarray, lst: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(lst, pos), len(lst) - 1)
        return lst[k] == pos

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase."""
        order = np.argsort(self.df[terms], kind="stable")
        if self.df[terms[order[0]]] == 0:
            return self.post[:0]
        pos = self.list(terms[order[0]]) - order[0]
        for j in order[1:]:
            if not len(pos):
                break
            pos = pos[self._within(pos + j, self.list(terms[j]))]
        return pos

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``slop`` words away, either side."""
        order = np.argsort(self.df[terms], kind="stable")
        if self.df[terms[order[0]]] == 0:
            return self.post[:0]
        pos = self.list(terms[order[0]])
        for j in order[1:]:
            if not len(pos):
                break
            lst = self.list(terms[j])
            k = np.searchsorted(lst, pos - slop)
            pos = pos[(k < len(lst)) & (lst[np.minimum(k, len(lst) - 1)] <= pos + slop)]
        return pos

    def together(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Those of ``near`` that stand with all other terms among some ``span`` words."""
        terms = np.unique(terms)
        found = []
        for p in self.near(terms, span - 1).tolist():
            near = [self._around(t, p, span) for t in terms.tolist()]
            at = np.concatenate(near)
            order = np.argsort(at, kind="stable")
            at, kind = at[order], np.repeat(np.arange(len(near)), [len(x) for x in near])[order]
            seen, left, have = np.zeros(len(near), np.int64), 0, 0
            for right in range(len(at)):
                have += seen[kind[right]] == 0
                seen[kind[right]] += 1
                while at[right] - at[left] >= span:
                    seen[kind[left]] -= 1
                    have -= seen[kind[left]] == 0
                    left += 1
                if have == len(near):
                    found.append(p)
                    break
        return np.array(found, np.int64)

    def _around(self, term: int, p: int, span: int) -> np.ndarray:
        lst = self.list(term)
        return lst[np.searchsorted(lst, p - span + 1) : np.searchsorted(lst, p + span)]


class Windows:
    """The distinct windows of a block of items, with the items of each."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.ids = [i for i, _ in items]
        enc = [t.encode("utf-8", "replace") for _, t in items]
        data = np.frombuffer(b"".join(enc), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in enc])]).astype(np.int64)
        tok, row = tokenize(data, offs)
        self.vocab = np.unique(tok)
        num = np.searchsorted(self.vocab, tok)
        words = np.bincount(row, minlength=len(items))
        size = np.minimum(words, width)
        many = np.where(words > 0, words - size + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        start = (np.cumsum(words) - words)[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        at = start[:, None] + np.arange(width)
        inside = np.arange(width) < size[item][:, None]
        every = np.where(inside, num[np.minimum(at, max(0, len(num) - 1))] if len(num) else -1, -1)
        self.matrix, which = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, item)
        self.size = (self.matrix >= 0).sum(1)
        pair = np.unique(np.stack([which.reshape(-1), item], 1), axis=0)
        self.first, self.item = np.searchsorted(pair[:, 0], np.arange(len(self.matrix) + 1)), pair[:, 1]

    def terms(self, k: int) -> np.ndarray:
        return self.matrix[k, : self.size[k]]

    def ids_of(self, k: int) -> list[str]:
        return [self.ids[i] for i in self.item[self.first[k] : self.first[k + 1]].tolist()]

    def present(self, index: Postings) -> np.ndarray:
        """The windows all of whose terms the shard has."""
        df = np.where(self.matrix >= 0, index.df[self.matrix] if len(index.df) else 0, np.iinfo(np.int64).max)
        return np.flatnonzero(df.min(1) > 0) if len(df) else np.zeros(0, np.int64)

    def search(self, index: Postings) -> list[tuple[int, np.ndarray]]:
        """(window, start positions) of the windows that occur in the shard."""
        found = ((k, index.phrase(self.terms(k))) for k in self.present(index).tolist())
        return [(k, pos) for k, pos in found if len(pos)]


def _index(batches):
    for batch in batches:
        for part, data, offs in B.slices(batch):
            tok, row = tokenize(data, offs)
            words, terms, starts, steps = ShardIndex.pack(tok, row, part.num_rows)
            one = lambda x, t: pa.array([x], t)
            yield pa.RecordBatch.from_arrays(
                [one(B.column(part, "doc_id").to_pylist(), pa.list_(pa.int64())), one(words.tolist(), pa.list_(pa.int64())), *(one(x.tobytes(), pa.binary()) for x in (terms, starts, steps))],
                names=["docs", "words", "terms", "starts", "steps"],
            )


def build_index(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The stored index of the documents: a row a shard, with a number of its own."""
    return scratch.put(arrow_map(texts(docs), _index, INDEX).withColumn("shard", F.monotonically_increasing_id()), "postings")


def _shards(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            yield r, ShardIndex.unpack(r["words"], r["terms"], r["starts"], r["steps"])


def _search(block, width: int, num: int, den: int):
    def run(batches):
        tests = Windows(block.value, width)
        for r, index in _shards(batches):
            first, n = index.first, len(index.words)
            cover = np.zeros(int(first[-1]) + 1, np.int64)
            hits: list[set[str]] = [set() for _ in range(n)]
            for k, pos in tests.search(index.among(tests.vocab)):
                doc = index.document(pos)
                at = pos - doc * GAP
                np.add.at(cover, at, 1)
                np.add.at(cover, at + tests.size[k], -1)
                for d in np.unique(doc):
                    hits[d].update(tests.ids_of(k))
            inside = np.cumsum(cover[:-1]) > 0
            n_hit = np.add.reduceat(np.append(inside, False).astype(np.int64), first[:-1]) if n else np.zeros(0, np.int64)
            n_hit[index.words == 0] = 0
            names = [sorted(h) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, r["shard"], np.int64)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(r["docs"], pa.int64()),
                    pa.array(index.words),
                    pa.array(n_hit),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                    pa.array((n_hit > 0) & (den * n_hit >= num * index.words)),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(_runs(inside, first), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["shard", "place", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_spans"],
            )

    return run


def _near(block, width: int, span: int):
    def run(batches):
        tests = Windows(block.value, width)
        for r, index in _shards(batches):
            lists, hits = index.among(tests.vocab), [set() for _ in index.words]
            for k in tests.present(lists).tolist():
                for d in np.unique(index.document(lists.together(tests.terms(k), span))):
                    hits[d].update(tests.ids_of(k))
            n, names = len(hits), [sorted(h) for h in hits]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, r["shard"], np.int64)), pa.array(np.arange(n, dtype=np.int32)), pa.array(r["docs"], pa.int64()), pa.array(names, pa.list_(pa.string()))],
                names=["shard", "place", "doc_id", "near_ids"],
            )

    return run


def _runs(inside: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """The runs of hit words of each document; a run of the shard may go on in the next document."""
    runs: list[list[dict]] = [[] for _ in range(len(first) - 1)]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        while s < e:
            d = int(np.searchsorted(first, s, side="right")) - 1
            stop = min(e, int(first[d + 1]))
            runs[d].append({"start": s - int(first[d]), "end": stop - int(first[d])})
            s = stop
    return runs


def _blocks(items: DataFrame, limit: int):
    """Blocks of (id, text) of at most ``limit`` bytes (one larger item makes its own block)."""
    block, size = [], 0
    for r in items.toLocalIterator():
        b = len(r.text.encode("utf-8", "replace")) + 64
        if block and size + b > limit:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += b
    if block:
        yield block


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where("item_id is not null")


def _by_block(index: DataFrame, benchmark: DataFrame, block_bytes: int, search, schema: str, scratch: Scratch, some: str) -> list[DataFrame]:
    """The search of each block; of several, what is found (``some``) is written before the next one is broadcast."""
    sc, parts = index.sparkSession.sparkContext, []
    blocks = _blocks(_items(benchmark), block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    while True:
        sent = sc.broadcast(block)
        part = arrow_map(index, search(sent), schema)
        if following is None and not parts:
            return [part]
        parts.append(scratch.put(part.where(some), "hits"))
        sent.unpersist()
        if following is None:
            return parts
        block, following = following, next(blocks, None)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, num: int = 1, den: int = 20, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: words, words inside occurring windows, items hit, hit word spans.

    A document is contaminated if it has hit words and den * n_hit >= num * n_words.  Tests that fit one block
    (the usual case) cost one pass over the index, larger ones a pass a block.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    index = build_index(docs, scratch)
    parts = _by_block(index, benchmark, block_bytes, lambda b: _search(b, width, num, den), SCHEMA, scratch, "n_hit > 0")
    return (parts[0] if len(parts) == 1 else _merge(index, parts, num, den)).drop("shard", "place")


def near_benchmark(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, span: int = SPAN, block_bytes: int = BLOCK_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, near_ids: the items, sorted, with a window all of whose words stand among some ``span`` words of the document, in any order."""
    if not 0 < span < GAP:
        raise ValueError(f"span must be from 1 to {GAP - 1}")
    scratch = scratch or Scratch(docs.sparkSession)
    index = build_index(docs, scratch)
    parts = _by_block(index, benchmark, block_bytes, lambda b: _near(b, width, span), "shard long, place int, doc_id long, near_ids array<string>", scratch, "size(near_ids) > 0")
    if len(parts) == 1:
        return parts[0].drop("shard", "place")
    found = functools.reduce(DataFrame.unionByName, parts).groupBy("shard", "place").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_ids")))).alias("near_ids"))
    return _rows(index).join(found, ["shard", "place"], "left").select("doc_id", F.coalesce("near_ids", F.array().cast("array<string>")).alias("near_ids"))


def _rows(index: DataFrame) -> DataFrame:
    """(shard, place, doc_id, n_words) of every row of the documents."""
    rows = index.select("shard", F.posexplode(F.arrays_zip("docs", "words")).alias("place", "x"))
    return rows.select("shard", "place", F.col("x.docs").alias("doc_id"), F.col("x.words").alias("n_words"))


def _merge(index: DataFrame, parts: list[DataFrame], num: int, den: int) -> DataFrame:
    """Results over several blocks: spans and items of each row united, then the digests anew."""
    merged = functools.reduce(DataFrame.unionByName, parts).groupBy("shard", "place").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("sp"),
    )
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    merged = merged.withColumn("hit_spans", F.aggregate("sp", F.slice(F.col("sp"), 1, 0), step)).drop("sp")
    empty = "array<struct<start:int,end:int>>"
    merged = _rows(index).join(merged, ["shard", "place"], "left").withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))).withColumn("hit_spans", F.coalesce("hit_spans", F.array().cast(empty)))
    merged = merged.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])))
    return merged.select(
        "shard", "place", "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (den * F.col("n_hit") >= num * F.col("n_words"))).alias("contaminated"), "item_ids", "hit_spans",
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
