"""Line dedup by a log-template tree; lines of templates that recur across documents are dropped.

Parsing has a fixed depth: the number of tokens, then the two leading tokens lead to a leaf.  Tokens with
a digit are variable everywhere.  In a leaf a line belongs to its exact template and to generalised ones, in
which a field of the further tokens is variable: one half of them that starts at their beginning, in their
middle or ends at their end (so any run of up to a quarter of them is in one such half), or every third of
them.  Lines that differ in such a field alone meet in one template.  Templates are hashes, so the tree is
a key, its leaves are built by aggregation, and no leaf, however full, is held by one task.

A template is common if ``least`` different texts hold it.  A text is a witness if at least two fifths of its
lines that aren't blank are of no common template, so that most copies of a document, whose lines all have the same
company, are no witnesses however many they are.  A template recurs if ``least`` witnesses hold it; then its lines go from
every document, wherever they stand.  No group has a vote against: texts that are no witnesses don't count.

Defined results: null texts stay null and have 0 lines; empty texts are one blank line; blank lines are never
dropped; equal texts are one text and lose equal lines; repeated rows are returned each; lines of one or two
tokens have their exact template only; all other columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bytesops as B
from orrery.llm.common import Scratch, arrow_map, configure, table

LEAD, STRIDE, LEAST = 2, 3, 10
#: A witness has at least OWN / OF of its lines for itself.
OWN, OF = 2, 5
U = np.uint64
VARIABLE = U(0x5641524941424C45)
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1


def line_offsets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines, row of each); line feeds belong to no line."""
    feeds = np.flatnonzero(data == 10)
    edges = np.sort(np.concatenate([offs[:-1], feeds + 1]), kind="stable")
    row = np.searchsorted(offs, edges, side="right") - 1
    if len(feeds):  # a line feed that ends a row opens a line of that row, not of the next
        per = np.bincount(np.searchsorted(offs, feeds, side="right") - 1, minlength=len(offs) - 1) + 1
    else:
        per = np.ones(len(offs) - 1, np.int64)
    row = np.repeat(np.arange(len(offs) - 1), per)
    return np.append(edges, len(data)), row


def masks(place: np.ndarray, count: np.ndarray):
    """Which tokens are variable in each generalised template, by a token's place and its line's tokens."""
    rest = count - LEAD
    half = -(-rest // 2)
    for start in (0, -(-(rest - half) // 2), rest - half):
        yield (place - LEAD >= start) & (place - LEAD < start + half)
    for j in range(STRIDE):
        yield (place >= LEAD) & (place % STRIDE == j)


def parse(data: np.ndarray, offs: np.ndarray):
    """(row, number in the row, tokens, template keys, which of them exist) of each line."""
    lines, row = line_offsets(data, offs)
    n = len(row)
    s, e, line = B.spans(data, lines, B.NOT_SPACE)
    count = np.bincount(line, minlength=n)
    first = np.cumsum(count) - count
    keys = np.zeros((n, 4 + STRIDE), U)
    if len(s):
        tok = B.span_hashes(B.prefix_sums(data), s, e)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        tok[digits[e] > digits[s]] = VARIABLE
        place = np.arange(len(tok)) - first[line]
        step = place.astype(U) * U(0x9E3779B97F4A7C15)
        fixed, loose = B.mix(tok + step), B.mix(VARIABLE + step)
        full = np.flatnonzero(count)
        at = first[full]
        keys[full, 0] = np.add.reduceat(fixed, at)
        for j, mask in enumerate(masks(place, count[line])):
            keys[full, 1 + j] = np.add.reduceat(np.where(mask, loose, fixed), at)
    keys = B.mix(keys + count.astype(U)[:, None] * U(0xD6E8FEB86659FD93))
    has = np.zeros(keys.shape, bool)
    has[:, 0] = count > 0
    has[:, 1:] = (count > LEAD)[:, None] & (keys[:, 1:] != keys[:, :1])
    number = np.arange(n) - np.searchsorted(row, row)
    return row, number, count, keys, has


def _templates(lines: bool):
    """Rows (t, h) of the templates of each text, or (t, h, n, line) of those of each line; n: lines that aren't blank."""

    def run(batches):
        for batch in batches:
            for part, data, offs in B.slices(batch):
                row, number, count, keys, has = parse(data, offs)
                line, which = np.nonzero(has)
                h = B.column(part, "h").to_numpy(zero_copy_only=False)
                t, own = keys[line, which], row[line]
                order = np.lexsort((line, t, own))
                t, own, line = t[order], own[order], line[order]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (own[1:] != own[:-1]) | ((line[1:] != line[:-1]) & lines)
                t, own, line = t[new], own[new], line[new]
                cols = [pa.array(B.signed(t)), pa.array(h[own])]
                if lines:
                    full = np.bincount(row[count > 0], minlength=part.num_rows)
                    cols += [pa.array(full[own].astype(np.int32)), pa.array(number[line].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["t", "h", "n", "line"][: len(cols)])

    return run


def _drop(at: int, count_col: bool):
    def run(batches):
        for batch in batches:
            out, n, gone = [], [], []
            for text, lines in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if text is None:
                    out.append(None)
                    n.append(0)
                    gone.append(0)
                    continue
                parts = text.split("\n")
                drop = set(lines or ())
                out.append("\n".join(x for i, x in enumerate(parts) if i not in drop) if drop else text)
                n.append(len(parts))
                gone.append(len(drop))
            cols, names = list(batch.columns[:-1]), batch.schema.names[:-1]
            cols[at] = pa.array(out, pa.string())
            if count_col:
                cols += [pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
                names = [*names, "n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _often(rows: DataFrame, least: int) -> DataFrame:
    """The templates that ``least`` texts and more hold."""
    return rows.groupBy("t", "h").agg(F.lit(1).alias("x")).groupBy("t").count().where(F.col("count") >= least).select("t")


def recurring_lines(docs: DataFrame, scratch: Scratch, *, least: int = LEAST) -> DataFrame:
    """(h, lines): the numbers of the lines to drop of each text, by its hash."""
    src = docs.select(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    common = scratch.put(_often(arrow_map(src, _templates(False), "t long, h long"), least), "common")
    rows = arrow_map(src, _templates(True), "t long, h long, n int, line int")
    held = scratch.put(rows.join(common, "t", "left_semi").distinct(), "held")  # so that a text counts once, however many copies there are
    shared = held.select("h", "n", "line").distinct().groupBy("h", "n").count()
    witness = shared.where(OF * (F.col("n") - F.col("count")) >= OWN * F.col("n")).select("h")
    recur = scratch.put(_often(held.select("t", "h").join(witness, "h", "left_semi"), least), "recur")  # a table, so that the join of a hot template can be split
    return held.join(recur, "t", "left_semi").groupBy("h").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, *, least: int = LEAST, counts: bool = False) -> DataFrame:
    """The documents without lines of recurring templates; with ``counts`` also n_lines and n_dropped.

    Needs columns doc_id and text; all columns are kept in their order.
    """
    from pyspark.sql.types import LongType, StringType, StructType

    configure(docs.sparkSession)
    lines = recurring_lines(docs, Scratch(docs.sparkSession), least=least).toDF("_h", "_lines")
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no name clashes
    at = [c.lower() for c in docs.columns].index("text")
    own = docs.toDF(*names)
    own = own.join(lines, F.xxhash64(names[at]) == F.col("_h"), "left").select(*names, "_lines")
    schema = StructType()
    for f, c in zip(docs.schema.fields, names):
        schema = schema.add(c, StringType() if c == names[at] else f.dataType)
    if counts:
        schema = schema.add("n_lines", LongType()).add("n_dropped", LongType())
    out = arrow_map(own, _drop(at, counts), schema)
    return out.toDF(*docs.columns, *(["n_lines", "n_dropped"] if counts else []))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_recurring_lines(docs, counts=True).select("doc_id", "n_lines", "n_dropped", "text")
