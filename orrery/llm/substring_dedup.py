"""Exact substring deduplication over all documents, by suffix arrays of shards.

A byte goes if a 100-byte string that covers it also starts earlier (in a smaller doc_id, or earlier in the
same document).  Strings can meet only if they are equal, so suffixes are dealt to shards by content:

1. In every 100-byte window the smallest hash of the 40-byte strings inside it is the window's anchor
   (one anchor in about 31 bytes).  Equal windows have equal anchors at the same place.
2. Anchors that occur once hold no repeat.  For the others, a fragment is the anchor with the 60 bytes on
   either side that its windows can reach.  A fragment equal to an earlier one is wholly repeated.
3. Distinct fragments of one anchor differ somewhere and must be compared window by window: a shard's
   fragments are put into one string, its suffix array is induced, and neighbours whose common prefix
   reaches 100 bytes are one class; every member but the one that starts first is repeated.
4. An anchor of more than ``SPLIT`` distinct fragments (a passage in a third of all documents) is made longer: its
   windows are halved by where the anchor stands in them, and the windows of a half share a longer string, which takes the
   anchor's part in steps 2 and 3.  Strings that are still too frequent are halved again, at the last to single windows,
   whose fragments are equal.  So windows that are equal always meet, and no shard outgrows a task.

The marked bytes return to their documents as intervals, and the rest is joined.

Defined results: null and empty texts have 0 bytes; documents under 100 bytes are kept whole; rows of one id are
documents of their own, in the order of their texts' hashes, and of equal ones one comes first; rows with a null id
come after all others, in the same order; further columns are ignored.
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
from orrery.llm.suffix import permuted_prefixes, suffix_array

LENGTH, ANCHOR = 100, 40
SIDE = LENGTH - ANCHOR
#: Fragments of one string that may share a shard, and fragments a shard holds.
SPLIT, SHARD = 4096, 8192
#: Window starts of a long text that are handled at a time.
CHUNK = 4 << 20
SEPARATOR = 0xFF  # no byte of UTF-8
U = np.uint64


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def anchors(data: np.ndarray, offs: np.ndarray, first: int = 0, last: int | None = None):
    """(row, place in the row, anchor hash, fragment hash) of the anchors of all windows that start in [first, last)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(U), none.astype(U)
    sums = B.prefix_sums(data)
    h = (sums[ANCHOR:] - sums[:-ANCHOR]) * B.powers(n + 1)[1][: n - ANCHOR + 1]
    h ^= h >> U(31)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    windows = _slide(h, SIDE + 1, np.minimum)  # one for each start
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
        windows[max(lo, hi - LENGTH + 1) : hi] = 0  # those that leave their row
    windows[:first] = 0
    windows[last if last is not None else len(windows) :] = 0
    pad = np.zeros(SIDE, U)
    best = _slide(np.concatenate([pad, windows, pad]), SIDE + 1, np.maximum)
    pos = np.flatnonzero((h == best) & (best > 0))
    row = np.searchsorted(offs, pos, side="right") - 1
    lo, hi = np.maximum(offs[row], pos - SIDE), np.minimum(offs[row + 1], pos + LENGTH)
    frag = B.mix(B.span_hashes(sums, lo, hi) ^ ((pos - lo).astype(U) * U(0x9E3779B97F4A7C15)))
    return row, pos - offs[row], h[pos], frag


def pieces(data: np.ndarray, chunk: int):
    """Anchors of one long text, chunk by chunk; a piece reaches as far to either side as its fragments do.

    An anchor of windows on both sides of a cut comes twice, which changes nothing later on.
    """
    for c in range(0, max(1, len(data) - LENGTH + 1), chunk):
        lo = max(0, c - SIDE)
        part = data[lo : c + chunk + LENGTH + SIDE]
        _, at, a, f = anchors(part, np.array([0, len(part)]), c - lo, c - lo + chunk)
        yield at + lo, a, f


def _anchor_rows(chunk: int):
    def run(batches):
        for batch in batches:
            for part, data, offs in B.slices(batch, max_bytes=1 << 20):
                ids = B.column(part, "doc_id").to_numpy(zero_copy_only=False)
                if part.num_rows == 1 and len(data) > chunk:
                    found = ((np.zeros(len(at), np.int64), at, a, f) for at, a, f in pieces(data, chunk))
                else:
                    found = [anchors(data, offs)]
                for row, at, a, f in found:
                    yield pa.RecordBatch.from_arrays([pa.array(B.signed(a)), pa.array(B.signed(f)), pa.array(ids[row]), pa.array(at)], names=["a", "f", "doc_id", "at"])

    return run


def _cut(batches):
    """The bytes of the fragments of each document."""
    names = ["a", "doc_id", "at", "left", "body"]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for doc, text, frags in zip(*(B.column(batch, c).to_pylist() for c in ("doc_id", "text", "frags"))):
            raw = text.encode("utf-8", "replace")
            for x in frags:
                lo = max(0, x["at"] - SIDE)
                for c, v in zip(cols, (x["a"], doc, x["at"], x["at"] - lo, raw[lo : x["at"] + LENGTH])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=names)


HALVES = "a long, f long, doc_id long, at long, left int, lo int, hi int, body binary"


def _halve(batches):
    """Both halves of each fragment's windows.  A window is told by the bytes it has before the anchor; those of
    lo to hi such bytes all hold the string from lo bytes before the anchor to LENGTH - hi bytes after its start."""
    for batch in batches:
        data, offs = B.text_view(B.column(batch, "body"))
        at, left, lo, hi = (B.column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "left", "lo", "hi"))
        sums, mid = B.prefix_sums(data), (lo + hi) // 2
        for low, high in ((lo, mid), (mid + 1, hi)):
            first = np.maximum(low, left + LENGTH - np.diff(offs))  # of the windows that the fragment has
            last = np.minimum(high, left)
            k = np.flatnonzero((low <= high) & (first <= last))
            anchor = offs[k] + left[k]
            a = B.mix(B.span_hashes(sums, anchor - low[k], anchor + LENGTH - high[k]) ^ (low[k].astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
            start, stop = anchor - last[k], anchor + LENGTH - first[k]
            f = B.mix(B.span_hashes(sums, start, stop) ^ (last[k].astype(U) * U(0x9E3779B97F4A7C15)))
            body = [data[x:y].tobytes() for x, y in zip(start.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(B.signed(a)), pa.array(B.signed(f)), B.column(batch, "doc_id").take(pa.array(k)), pa.array(at[k]), *(pa.array(x[k].astype(np.int32)) for x in (last, low, high)), pa.array(body, pa.binary())],
                names=["a", "f", "doc_id", "at", "left", "lo", "hi", "body"],
            )


def _shard(tbl):
    """Suffix array of a shard's fragments; repeated windows as intervals."""
    doc, begin = (tbl.column(c).to_numpy() for c in ("doc_id", "start"))
    body, offs = B.text_view(tbl.column("body"))
    n = len(offs) - 1
    text = np.full(len(body) + n, SEPARATOR, np.uint8)
    start = offs[:-1] + np.arange(n)  # of each fragment in the text
    frag = np.repeat(np.arange(n), np.diff(offs))
    text[np.arange(len(body)) + frag] = body
    size = np.diff(offs)
    usable = np.zeros(len(text), bool)
    room = np.maximum(0, size - LENGTH + 1)
    of = np.repeat(np.arange(n), room)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(room) - room, room)
    usable[start[of] + inner] = True
    sa = suffix_array(text)
    _, reach = permuted_prefixes(text, sa, LENGTH, usable)
    order = sa[usable[sa]]
    cls = np.cumsum(~reach[order]) - 1
    where = np.empty(len(text), np.int64)
    where[start[of] + inner] = np.arange(len(of))
    many = np.bincount(cls)[cls] > 1  # windows of classes of one are done with
    cls = cls[many]
    cls = np.cumsum(np.diff(cls, prepend=cls[:1]) > 0)
    w = where[order[many]]  # windows in the order of the suffix array
    g_doc, g_at = doc[of[w]], begin[of[w]] + inner[w]
    by = np.lexsort((g_at, g_doc, cls))
    first = by[np.flatnonzero(np.diff(cls[by], prepend=-1))]  # of each class, the window that starts first
    repeated = np.ones(len(w), bool)
    repeated[first] = False
    # the same place of one document may stand in a class more than once, by way of neighbouring anchors
    repeated &= ~((g_doc == g_doc[first][cls]) & (g_at == g_at[first][cls]))
    r = np.lexsort((g_at[repeated], g_doc[repeated]))
    rd, ra = g_doc[repeated][r], g_at[repeated][r]
    begins = np.ones(len(rd), bool)
    begins[1:] = (rd[1:] != rd[:-1]) | (ra[1:] - ra[:-1] > LENGTH)
    cut = np.flatnonzero(begins)
    last = np.append(cut[1:], len(rd)) - 1 if len(rd) else cut
    return pa.table({"doc_id": pa.array(rd[cut]), "start": pa.array(ra[cut]), "stop": pa.array(ra[last] + LENGTH)})


def _keep(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(4)]
        spans_of = B.column(batch, "cuts").to_pylist()
        for text, cuts in zip(B.column(batch, "text").to_pylist(), spans_of):
            raw = text.encode("utf-8", "replace")
            out, at, gone, runs = hashlib.sha256(), 0, 0, 0
            merged: list[list[int]] = []
            for x in sorted(cuts or [], key=lambda c: c["start"]):
                if merged and x["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x["stop"])
                else:
                    merged.append([x["start"], x["stop"]])
            for a, z in merged:
                out.update(raw[at:a])
                at, gone, runs = z, gone + z - a, runs + 1
            out.update(raw[at:])
            for c, v in zip(cols, (len(raw), gone, runs, out.hexdigest())):
                c.append(v)
        yield pa.RecordBatch.from_arrays([B.column(batch, "doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def numbered(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, id, text): doc_id is a number of each row's own, in the order that the module states; the id itself if that will do."""
    docs = texts(documents)
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.select("doc_id", F.col("doc_id").alias("id"), "text")
    docs = scratch.put(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    order = docs.select("row", "doc_id", F.xxhash64("text").alias("h")).sort(F.asc_nulls_last("doc_id"), "h", "row")
    order = scratch.put(order.select("row", F.monotonically_increasing_id().alias("number")), "order")  # which rises over sorted partitions
    return docs.join(order, "row").select(F.col("number").alias("doc_id"), F.col("doc_id").alias("id"), "text")


def _distinct(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each fragment (a, f): where it stands first, how often, and what of it is the same everywhere."""
    return rows.groupBy("a", "f").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("c"), *(F.first(c).alias(c) for c in more))


def _again(rows: DataFrame, first: DataFrame) -> DataFrame:
    return rows.join(first.where("c > 1").select("a", "f", "first"), ["a", "f"]).where("struct(doc_id, at) <> first")


def _differ(first: DataFrame) -> DataFrame:
    """The fragments of strings that have several (nf)."""
    many = first.groupBy("a").agg(F.count(F.lit(1)).alias("nf")).where("nf > 1")
    return first.join(many, "a").withColumn("doc_id", F.col("first.doc_id")).withColumn("at", F.col("first.at")).drop("first", "c")


def _refined(hot: DataFrame, split: int, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """(repeated spans, fragments of at most ``split`` to a string), from fragments of strings that have more."""
    spans, parts = [], []
    while not hot.isEmpty():
        rows = scratch.put(arrow_map(hot, _halve, HALVES), "halves")
        first = scratch.put(_distinct(rows, "left", "lo", "hi", "body"), "fragments")
        start = F.col("at") - F.col("left")
        spans.append(_again(rows, first).select("doc_id", start.alias("start"), (start + F.length("body")).alias("stop")))
        differ = scratch.put(_differ(first), "differ")
        parts.append(differ.where(F.col("nf") <= split).select("a", "doc_id", start.alias("start"), "body"))
        hot = differ.where(F.col("nf") > split)
    return spans, parts


def repeated_spans(docs: DataFrame, scratch: Scratch, split: int = SPLIT, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, start, stop) byte intervals whose union is what repeats earlier; intervals may overlap.

    ``docs`` (doc_id, text) has no id twice and none that is null.
    """
    long = docs.where(F.octet_length("text") >= LENGTH)
    rows = arrow_map(long, _anchor_rows(chunk), "a long, f long, doc_id long, at long")
    often = scratch.put(rows.groupBy("a").count().where("count > 1").select("a"), "often")  # a table, so that a hot anchor's join can be split
    found = scratch.put(rows.join(often.hint("shuffle_hash"), "a"), "anchors")
    first = scratch.put(_distinct(found), "fragments")
    whole = _again(found, first).select("doc_id", F.greatest(F.lit(0).cast("long"), F.col("at") - SIDE).alias("start"), (F.col("at") + LENGTH).alias("stop"))
    whole = scratch.put(whole, "whole")
    scratch.drop(found, often)

    per_doc = scratch.put(_differ(first).groupBy("doc_id").agg(F.collect_list(F.struct("a", "nf", "at")).alias("frags")), "differ")
    scratch.drop(first)

    def cut(which) -> DataFrame:
        own = per_doc.select("doc_id", F.filter("frags", which).alias("frags")).where(F.size("frags") > 0)
        return arrow_map(docs.join(own, "doc_id"), _cut, "a long, doc_id long, at long, left int, body binary")

    hot = cut(lambda x: x["nf"] > split).select("*", F.lit(0).alias("lo"), F.lit(SIDE).alias("hi"))
    spans, parts = _refined(scratch.put(hot, "hot"), split, scratch)
    parts.append(cut(lambda x: x["nf"] <= split).select("a", "doc_id", (F.col("at") - F.col("left")).alias("start"), "body"))
    total = per_doc.agg(F.sum(F.size("frags")).alias("n")).first().n or 0
    shards = max(1, -(-int(total) // shard))
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    dealt = union(parts).select("doc_id", "start", "body", F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int").alias("shard")).groupBy("shard")
    marks = scratch.put(dealt.applyInArrow(_shard, "doc_id long, start long, stop long"), "marks")
    scratch.drop(per_doc)
    return union([whole, marks, *spans])


def dedup_substrings(documents: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    scratch = Scratch(documents.sparkSession)
    docs = numbered(documents, scratch)
    cuts = repeated_spans(docs.select("doc_id", "text"), scratch, **limits)
    per_doc = cuts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    clipped = docs.join(per_doc, "doc_id", "left").withColumn("size", F.octet_length("text").cast("long"))
    clipped = clipped.select(F.col("id").alias("doc_id"), "text", F.transform("cuts", lambda c: F.struct(c["start"].alias("start"), F.least(c["stop"], F.col("size")).alias("stop"))).alias("cuts"))
    return arrow_map(clipped, _keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
