"""Entities that occur together, and spheres that share entities, by blocks of arrays instead of rows of pairs.

A text of n mentions makes n * n / 2 pairs, and an entity of n spheres as many pairs of spheres.  As rows they would be
shuffled; here the lists of mentions are, once for each block of entities (``partners``) or of spheres (``sharing``),
and a task counts the pairs of its block in arrays of bounded size.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that a task counts at once: about 16 bytes each, two or three times over.
PAIRS = 2_000_000
#: Entities are dealt to this many blocks; every block's task receives the lists that hold one of its entities.
BLOCKS = 24
#: Spheres of a block; two blocks are counted in one matrix of that many rows and columns.
SPHERES = 2048


def _code(entity_id) -> object:
    """Eight hex digits (``schema.entity_id``) as a number of the same order; other ids raise an error."""
    c = F.col(entity_id)
    return F.when(c.rlike("^[0-9a-f]{8}$"), F.conv(c, 16, 10).cast("long")).otherwise(F.raise_error(F.concat(F.lit("no entity id of eight hex digits: "), c)).cast("long"))


def _number(entity_id) -> object:
    """The code of an id of eight hex digits, a hash of 64 bits of any other."""
    c = F.col(entity_id)
    return F.when(c.rlike("^[0-9a-f]{8}$"), F.conv(c, 16, 10).cast("long")).otherwise(F.xxhash64(c))


def _hex(codes: np.ndarray) -> pa.Array:
    """Numbers back as eight hex digits."""
    b = np.ascontiguousarray(codes.astype(">u4")).view(np.uint8).reshape(-1, 4)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    out = np.empty((len(b), 8), np.uint8)
    out[:, 0::2], out[:, 1::2] = digits[b >> 4], digits[b & 15]
    offsets = np.arange(0, 8 * len(b) + 1, 8, dtype=np.int32)
    return pa.StringArray.from_buffers(len(b), pa.py_buffer(offsets), pa.py_buffer(out))


def _dealt(blocks: int):
    """Lists of mentions (l, in order) as (block, tokens): what follows a block's first entity in each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                t = x.values.to_numpy(zero_copy_only=False).astype(np.uint32)
                own, first = np.unique(t % blocks, return_index=True)
                for lo in range(0, len(own), 64):
                    part = slice(lo, lo + 64)
                    yield pa.RecordBatch.from_arrays([pa.array(own[part].astype(np.int32)), pa.array([t[i:].tobytes() for i in first[part]], pa.binary())], names=["block", "tokens"])

    return run


def _lists(m: DataFrame) -> DataFrame:
    rows = m.select("sphere_id", F.struct("seq", _code("entity_id").alias("e")).alias("x"))
    return rows.groupBy("sphere_id").agg(F.array_sort(F.collect_list("x")).alias("l")).select(F.col("l.e").alias("l"))


def _counted(tok: np.ndarray, ends: np.ndarray, blocks: int, pairs: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(entity, others, counts) of the entities of the block that all lists are of, entity by entity."""
    starts = np.concatenate([[0], ends[:-1]])
    block = int(tok[0]) % blocks
    post = []  # first positions of the block's entities in each list
    for lo, hi in _spans(ends - starts, 1 << 20):
        a = int(starts[lo])
        t = np.array(tok[a : int(ends[hi - 1])])
        at = np.flatnonzero(t % blocks == block)
        doc = np.searchsorted(ends[lo:hi], at + a, side="right")
        order = np.lexsort((at, t[at], doc))
        at, doc = at[order], doc[order]
        new = np.ones(len(at), bool)
        new[1:] = (t[at[1:]] != t[at[:-1]]) | (doc[1:] != doc[:-1])
        at, doc = at[new], doc[new]
        post.append((t[at], at + a + 1, ends[lo:hi][doc]))
    ent, lo, hi = (np.concatenate(x) for x in zip(*post))
    order = np.argsort(ent, kind="stable")
    ent, lo, hi = ent[order], lo[order], hi[order]
    held, held_e = [], None  # a common entity's counts, of several steps
    for i, j in _spans(hi - lo, pairs):
        n = hi[i:j] - lo[i:j]
        total = int(n.sum())
        idx = np.arange(total) + np.repeat(lo[i:j] - (np.cumsum(n) - n), n)
        e = np.repeat(ent[i:j].astype(np.uint64), n)
        key = (e << np.uint64(32)) | np.asarray(tok[idx], np.uint64)
        key = np.sort(key[(key & np.uint64(0xFFFFFFFF)) != e])
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        cnt = np.diff(np.append(cut, len(key)))
        key = key[cut]
        e, o = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.zeros(0, np.int64)
        for s, t in zip(at, np.append(at[1:], len(e))):
            if held_e is not None and held_e != e[s]:
                yield (held_e, *_sum(held))
                held = []
            held_e = e[s]
            held.append((o[s:t], cnt[s:t]))
            if len(held) > 8:
                held = [_sum(held)]
    if held:
        yield (held_e, *_sum(held))


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items of about ``most`` in all, one item at least."""
    total, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    o, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(o, kind="stable")
    o, c = o[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    return o[at], np.add.reduceat(c, at)


def partners(m: DataFrame, least: int = 1, top: int | None = None, *, counts: bool = False, blocks: int | None = None, pairs: int | None = None) -> DataFrame:
    """entity_id, other_id, cnt: times the other was registered in a sphere that held the entity already.

    Of counts of ``least`` and more, the ``top`` most frequent of an entity if given (ties by other_id).  With
    ``counts``: entity_id, c, the number of its others, whatever their counts.
    """
    blocks, pairs = blocks or BLOCKS, pairs or PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            files, ends = {}, {}
            for b in batches:  # each block's lists one after another in a local file
                for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                    buf = v.as_buffer()
                    if k not in files:
                        files[k], ends[k] = open(f"{folder}/{k}", "wb"), []
                    files[k].write(buf)
                    ends[k].append((ends[k][-1] if ends[k] else 0) + buf.size // 4)
            for k, f in files.items():
                f.close()
                tok = np.memmap(f"{folder}/{k}", np.uint32, "r")
                out, size = [], 0
                for e, o, c in _counted(tok, np.array(ends[k], np.int64), blocks, pairs):
                    if counts:
                        out.append((np.array([e]), np.array([len(o)])))
                    else:
                        keep = c >= least
                        o, c = o[keep], c[keep]
                        if top is not None and len(o) > top:
                            best = np.lexsort((o, -c))[:top]
                            o, c = o[best], c[best]
                        out.append((np.repeat(e, len(o)), o, c))
                    size += len(out[-1][0])
                    if size > 1 << 16:
                        yield _batch(out)
                        out, size = [], 0
                if size:
                    yield _batch(out)

    lists = _lists(m).mapInArrow(_dealt(blocks), "block int, tokens binary")
    schema = "entity_id string, c bigint" if counts else "entity_id string, other_id string, cnt bigint"
    return lists.repartition(blocks, "block").mapInArrow(run, schema)


def _batch(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    *ids, n = (np.concatenate(x) for x in zip(*out))
    names = ["entity_id", "other_id", "cnt"] if len(ids) == 2 else ["entity_id", "c"]
    return pa.RecordBatch.from_arrays([*(_hex(x) for x in ids), pa.array(n.astype(np.int64))], names=names)


def sharing(m: DataFrame, least: int = 1, *, block: int | None = None) -> DataFrame:
    """a, b, c, na, nb: spheres a < b that share ``least`` entities and more, how many, and how many each has.

    From mentions (sphere_id, entity_id).  Spheres are dealt into blocks by a hash; every two blocks are the work of one
    task, which holds their lists of entities and one matrix of counts, a few rows at a time.  The lists of a sphere are
    shuffled once a block, so what is shuffled grows as the square of the spheres, as the result does, but a common
    entity's pairs are never rows.
    """
    block = block or SPHERES
    sets = m.groupBy("sphere_id").agg(F.array_sort(F.collect_set(_number("entity_id"))).alias("l")).where("sphere_id is not null")
    n = max(1, -(-m.agg(F.countDistinct("sphere_id")).first()[0] // block))
    d = sets.withColumn("blk", F.pmod(F.xxhash64("sphere_id"), F.lit(n)).cast("int"))
    two = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.least(F.col("blk"), j).alias("x"), F.greatest(F.col("blk"), j).alias("y")))
    d = d.withColumn("p", F.explode(two)).select("p.x", "p.y", "blk", "sphere_id", "l")

    def run(tbl: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y = tbl.column("x")[0].as_py(), tbl.column("y")[0].as_py()
        tbl = tbl.combine_chunks()
        blk, ids, lists = tbl.column("blk").to_numpy(), tbl.column("sphere_id").combine_chunks(), tbl.column("l").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists, ids = lists.chunk(0), ids.chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        ent = lists.flatten().to_numpy(zero_copy_only=False)
        name = np.array(ids.to_pylist(), object)
        left, right = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
        col = np.full(len(size), -1)
        col[right] = np.arange(len(right))
        mine = col[row] >= 0
        ye, yc = ent[mine], col[row[mine]]
        order = np.argsort(ye, kind="stable")
        ye, yc = ye[order], yc[order]
        start = np.concatenate([[0], np.cumsum(size)])
        for lo in range(0, len(left), 128):  # 128 rows of the matrix at a time
            rows = left[lo : lo + 128]
            e = np.concatenate([ent[start[r] : start[r + 1]] for r in rows])
            i = np.repeat(np.arange(len(rows)), size[rows])
            a, b = np.searchsorted(ye, e, side="left"), np.searchsorted(ye, e, side="right")
            c = np.zeros(len(rows) * len(right), np.int64)
            for s, t in _spans(b - a, PAIRS):
                k = (b - a)[s:t]
                at = np.arange(int(k.sum())) + np.repeat(a[s:t] - (np.cumsum(k) - k), k)
                c += np.bincount(np.repeat(i[s:t], k) * len(right) + yc[at], minlength=len(c))
            hit = np.flatnonzero(c >= max(1, least))
            p, q, c = rows[hit // max(1, len(right))], right[hit % max(1, len(right))], c[hit]
            if x == y:
                keep = p < q
                p, q, c = p[keep], q[keep], c[keep]
            swap = name[p] > name[q]
            p, q = np.where(swap, q, p), np.where(swap, p, q)
            for s in range(0, len(p), 1 << 16):
                z = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p[z])), ids.take(pa.array(q[z])), pa.array(c[z]), pa.array(size[p[z]].astype(np.int64)), pa.array(size[q[z]].astype(np.int64))], names=["a", "b", "c", "na", "nb"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.Table.from_batches(list(batches)))

    group.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return d.groupBy("x", "y").applyInArrow(group, "a string, b string, c bigint, na bigint, nb bigint")
