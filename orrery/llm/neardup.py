"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full sets confirm.

A document's set holds its distinct five-word shingles.  Documents of equal sets are one class, and
classes go on by their smallest id.  128 of 256 MinHash values make 32 bands of 4; all 256 are
folded into a 1024-bit odd sketch, a parity bitmap: the population count of two sketches' XOR estimates
how many MinHash values differ, and so the similarity, most precisely where it is high.

Links are found in steps that never expand a group into all its pairs:

1. In each band's bucket two members are pivots.  Each document takes the pivot it shares most bands
   with; pairs that their sketches don't rule out are confirmed on the full sets.  This joins large
   groups along few links.
2. Once more, of the pairs of a document and a pivot that still connect two components, the one that shares
   most bands is sifted and confirmed for each two components.
3. What is still apart is compared.  A shingle that no other document of such a bucket holds can't be in an
   intersection; counting them (exactly, by one aggregation) bounds each document's intersections, and
   one whose bound is below the threshold has no partner.  The others form families by their common buckets;
   a family is dealt into blocks of ``BLOCK`` documents, and each two blocks are one task's work: sketches sift
   the pairs of different components, a product of incidence matrices counts intersections exactly, and
   links alone leave the task.  A document may have any number of partners here.

A pair at the threshold shares no band with a probability of 5e-6 and is ruled out by its sketches with
about 1e-5; pairs above it less.  Confirmed links are exact.

Defined results: null and empty texts, and those of white space only, have an empty set and are linked
with nothing; texts of fewer than five words are one shingle; repeated rows of one id are one document and are
returned each; a null id is linked with nothing, has no component and is kept; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bytesops as B
from orrery.llm.common import Scratch, arrow_map, table, texts
from orrery.llm.components import components

WORDS = 5
HASHES, BANDS, ROWS, BITS = 256, 32, 4, 1024
ROUNDS = 2
BLOCK = 512
_R = np.random.default_rng(20240607)
_MUL = (_R.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _R.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_WORD_MUL = _R.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = "doc_id long, n long, s1 long, s2 long, bands array<long>, sketch array<long>"


def shingles(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct shingles, by row and hash."""
    n = len(offs) - 1
    low = B.LOWER[data]
    s, e, row = B.spans(low, offs, B.NOT_SPACE)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    tok = B.span_hashes(B.prefix_sums(low), s, e)
    count = np.bincount(row, minlength=n)
    rows, hashes = [], []
    if len(tok) >= words:
        h = np.zeros(len(tok) - words + 1, np.uint64)
        for j in range(words):
            h += tok[j : len(tok) - words + 1 + j] * _WORD_MUL[j]
        whole = row[: len(h)] == row[words - 1 :]
        rows.append(row[: len(h)][whole])
        hashes.append(B.mix(h[whole]))
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.cumsum(count) - count
        h = np.zeros(len(short), np.uint64)
        for j in range(words - 1):
            has = count[short] > j
            h[has] += tok[first[short[has]] + j] * _WORD_MUL[j]
        rows.append(short)
        hashes.append(B.mix(h + count[short].astype(np.uint64)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def signatures(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a set, their MinHash values)."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    x = (h >> np.uint64(32)).astype(np.uint32)
    sig = np.empty((len(first), HASHES), np.uint32)
    buf = np.empty_like(x)
    for i in range(HASHES if len(first) else 0):
        np.multiply(x, _MUL[i], out=buf)
        buf += _ADD[i]
        sig[:, i] = np.minimum.reduceat(buf, first)
    return row[first], sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    part = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(part.shape[:2], np.uint64)
    for j in range(ROWS):
        key = B.mix(key + part[:, :, j])
    return B.mix(key + np.arange(BANDS, dtype=np.uint64))


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """Parity bitmaps as rows of BITS/64 signed integers."""
    n = len(sig)
    bit = (B.mix(sig.astype(np.uint64) + (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount((bit + np.arange(n)[:, None] * BITS).reshape(-1), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def largest_xor(threshold: float = 0.75, sigmas: float = 4.25) -> int:
    """Population count of the XOR up to which a pair of at least this similarity is expected."""
    flips = 2 * HASHES * (1 - threshold)
    stay = (1 - 2 / BITS) ** flips
    mean = BITS / 2 * (1 - stay)
    by_hashes = 2 * np.sqrt(HASHES * threshold * (1 - threshold)) * stay
    by_folding = np.sqrt(BITS / 4 * (1 - stay * stay))
    return int(np.ceil(mean + sigmas * np.hypot(by_hashes, by_folding)))


def _features(batches):
    for batch in batches:
        for part, data, offs in B.slices(batch, max_bytes=1 << 20):
            n = part.num_rows
            row, h = shingles(data, offs)
            has, sig = signatures(row, h, n)
            size = np.bincount(row, minlength=n)
            s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            if len(has):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                s1[has] = np.add.reduceat(B.mix(h + np.uint64(1)), first)
                s2[has] = np.add.reduceat(B.mix(h ^ np.uint64(0xABCDEF0123456789)), first)
            full = lambda width, rows: _lists(width, rows, has, n)
            yield pa.RecordBatch.from_arrays(
                [B.column(part, "doc_id"), pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), full(BANDS, band_keys(sig).view(np.int64)), full(BITS // 64, odd_sketches(sig))],
                names=["doc_id", "n", "s1", "s2", "bands", "sketch"],
            )


def _lists(width: int, values: np.ndarray, has: np.ndarray, n: int) -> pa.Array:
    """A list column: ``width`` values for each row in ``has``, an empty list for the others."""
    size = np.zeros(n, np.int32)
    size[has] = width
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            step = 64
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                n = part.num_rows
                (ra, ha), (rb, hb) = (shingles(*B.text_view(B.column(part, c))) for c in ("ta", "tb"))
                fa, fb = np.searchsorted(ra, np.arange(n + 1)), np.searchsorted(rb, np.arange(n + 1))
                keep = []
                for k in range(n):
                    x, y = ha[fa[k] : fa[k + 1]], hb[fb[k] : fb[k + 1]]
                    if not len(x) or not len(y):
                        keep.append(False)
                        continue
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    both = int((x[at] == y).sum())
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([B.column(part, "a").filter(keep), B.column(part, "b").filter(keep)], names=["a", "b"])

    return run


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out and whose full sets have den * intersection >= num * union.

    ``docs`` and ``reps`` (doc_id, sketch) have an id once.
    """
    sk = lambda c: reps.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}"))
    differ = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(BITS // 64)), F.lit(0))
    pairs = pairs.join(sk("a"), "a").join(sk("b"), "b").where(differ <= largest_xor(num / den)).select("a", "b")
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), _confirm(num, den), "a long, b long")


def intersections(row: np.ndarray, h: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the rows in ``left`` with those in ``right``, by incidence matrices of shared shingles."""
    _, inv, count = np.unique(h, return_inverse=True, return_counts=True)
    keep = count[inv] > 1
    kinds, inv = np.unique(inv[keep], return_inverse=True)
    rows = row[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    at_left, at_right = np.full(n, -1), np.full(n, -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(inv, kind="stable")
    inv, rows = inv[order], rows[order]
    for lo in range(0, len(kinds), chunk):
        a, z = np.searchsorted(inv, (lo, lo + chunk))
        col, r = inv[a:z] - lo, rows[a:z]
        x, y = np.zeros((len(left), chunk), np.float32), np.zeros((len(right), chunk), np.float32)
        for m, at in ((x, at_left), (y, at_right)):
            here = at[r] >= 0
            m[at[r[here]], col[here]] = 1
        out += x @ y.T
    return out


def _family(num: int, den: int):
    limit = largest_xor(num / den)

    def run(tbl):
        x, y = tbl.column("x")[0].as_py(), tbl.column("y")[0].as_py()
        blk, comp, ids = (tbl.column(c).to_numpy() for c in ("blk", "comp", "id"))
        n = len(ids)
        left, right = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
        sk = np.asarray(tbl.column("sketch").combine_chunks().flatten()).reshape(n, -1).view(np.uint64)
        differ = np.zeros((len(left), len(right)), np.int64)
        for i in range(sk.shape[1]):
            differ += np.bitwise_count(sk[left, i][:, None] ^ sk[right, i][None])
        may = (differ <= limit) & (comp[left][:, None] != comp[right][None])
        if x == y:
            may &= ids[left][:, None] < ids[right][None]
        left, right, may = left[may.any(1)], right[may.any(0)], may[may.any(1)][:, may.any(0)]
        i = j = left[:0]
        if len(left):
            row, h = shingles(*B.text_view(tbl.column("text")))
            size = np.bincount(row, minlength=n)
            both = intersections(row, h, n, left, right).astype(np.int64)
            i, j = np.nonzero(may & (den * both >= num * (size[left][:, None] + size[right][None] - both)) & (both > 0))
        return pa.table({"a": pa.array(np.minimum(ids[left[i]], ids[right[j]])), "b": pa.array(np.maximum(ids[left[i]], ids[right[j]]))})

    return run


def family_links(members: DataFrame, reps: DataFrame, pool: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links between members (fam, id, comp) of one family and different components; sketches and texts come by id, not by family."""
    size = members.groupBy("fam").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    size = scratch.put(size, "sizes")  # a table, so that the join of a large family can be split
    d = members.join(size, "fam").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    d = d.join(reps.select(F.col("doc_id").alias("id"), "sketch"), "id").join(pool.select(F.col("doc_id").alias("id"), "text"), "id")
    meet = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: F.struct(F.least("blk", j).alias("x"), F.greatest("blk", j).alias("y")))
    d = d.withColumn("p", F.explode(meet)).select("fam", "p.x", "p.y", "blk", "id", "comp", "sketch", "text")
    return d.groupBy("fam", "x", "y").applyInArrow(_family(num, den), "a long, b long")


def _shingle_rows(batches):
    for batch in batches:
        for part, data, offs in B.slices(batch):
            row, h = shingles(data, offs)
            ids = B.column(part, "doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(B.signed(h)), pa.array(ids[row])], names=["h", "id"])


def _largest_intersections(docs: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, m): set size, and how many of its shingles another of these documents holds too; only where that allows a link."""
    rows = arrow_map(docs.select("doc_id", "text"), _shingle_rows, "h long, id long")
    own = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id"))
    # a shingle of one document counts there as lone; one of several counts nowhere
    lone = own.where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("u"))
    size = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    out = size.join(lone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m"))
    return out.where(F.lit(den) * F.col("m") >= F.lit(num) * F.col("n"))


def link(documents: DataFrame, *, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    docs = texts(documents)
    feats = scratch.put(arrow_map(docs, _features, FEATURES), "features")
    ids = feats.where("doc_id is not null")
    repeats = not ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = scratch.put(ids.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "classes")
    one = ids.join(classes.select(F.col("rep").alias("doc_id"), "n", "s1", "s2"), ["doc_id", "n", "s1", "s2"], "left_semi")
    one = one.dropDuplicates(["doc_id"]) if repeats else one
    reps = scratch.put(one.select("doc_id", "n", "bands", "sketch"), "reps")

    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    order = F.struct(F.xxhash64("id", "key").alias("h"), "id")
    pivots = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(order)["id"].alias("p1"), F.max(order)["id"].alias("p2")).where("c > 1").drop("c")
    live = scratch.put(rows.join(pivots, "key"), "live")

    pool = docs.join(live.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    pool = scratch.put(pool.dropDuplicates(["doc_id"]) if repeats else pool, "pool")

    star = live.select("id", F.explode(F.array("p1", "p2")).alias("p")).where("id <> p").groupBy("id", "p").count()
    star = scratch.put(star, "star")
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tried = scratch.put(star.groupBy("id").agg(F.max(F.struct("count", F.col("p")))["p"].alias("p")).select(*pair("id", "p")).distinct(), "tried")
    links = scratch.put(confirm(tried, pool, reps, num, den), "links")
    comp = components(links, scratch)
    for _ in range(1, ROUNDS):
        of = lambda c, name: comp.select(F.col("id").alias(c), F.col("comp").alias(name))  # noqa: E731, B023
        apart = star.join(of("id", "ci"), "id", "left").join(of("p", "cp"), "p", "left").select("id", "p", "count", F.coalesce("ci", "id").alias("ci"), F.coalesce("cp", "p").alias("cp")).where("ci <> cp")
        apart = apart.select(*pair("id", "p"), "count", F.least("ci", "cp").alias("x"), F.greatest("ci", "cp").alias("y")).join(tried, ["a", "b"], "left_anti")
        more = scratch.put(apart.groupBy("x", "y").agg(F.max(F.struct("count", "a", "b")).alias("m")).select("m.a", "m.b").distinct(), "more")
        if more.isEmpty():
            break
        found = scratch.put(confirm(more, pool, reps, num, den), "links")
        tried, links = tried.unionByName(more), links.unionByName(found)
        comp = components(links, scratch)

    placed = scratch.put(live.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), "placed")
    apart = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = scratch.put(placed.join(apart, "key"), "open")
    most = scratch.put(_largest_intersections(pool.join(open_.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), num, den), "bounds")
    near = open_.join(most.select("id"), "id")
    hub = near.groupBy("key").agg(F.min("id").alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "hub")
    fam = components(near.join(hub, "key").select("id", "hub"), scratch, "id", "hub")
    member = fam.select("id", F.col("comp").alias("fam")).join(near.select("id", "comp").distinct(), "id")
    member = scratch.put(member, "members")
    rest = scratch.put(family_links(member, reps, pool, num, den, scratch), "links")
    comp = components(links.unionByName(rest), scratch)

    final = classes.join(comp, F.col("rep") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("comp", "rep").alias("comp"))
    known = feats.where("doc_id is not null and n > 0").select("doc_id", "n", "s1", "s2").join(final, ["n", "s1", "s2"]).select("doc_id", "n", "comp")
    lone = feats.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("comp"))
    out = scratch.put(known.unionByName(lone), "out")
    scratch.drop(feats, classes, reps, live, pool, star, placed, open_, most, rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
