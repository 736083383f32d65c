"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where the splitting pattern always ends a match: before a space or line feed
that follows a printable ASCII character other than a space.  No match goes over such a place (a
match takes a blank only as its first character), so the pieces' ids joined are the text's ids.
A piece may still hold a run of blanks that the library's matcher can't take; such runs are taken by a scan:
of a run before another character the pattern matches all blanks but the last, and of one at the end all, so
that much is one match, which is merged by itself, and the rest of the piece goes on with the last blank.

Defined results: null and empty texts have no ids (the digests of nothing); repeated rows give
repeated results; further columns are kept by ``encode_text`` only if ``keep`` asks for them.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm import bytesops as B
from orrery.llm.common import arrow_map, table, texts

PIECE = 1 << 16
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_SAFE = re.compile(r"(?<=[!-~])[ \n]")
#: A run of blanks (by the splitting pattern's white space) that is taken by a scan.
RUN = 1 << 12
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The rank file's encoding without special tokens, once a process."""
    if path not in _ENCODINGS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def pieces(text: str, size: int = PIECE):
    """The text in pieces of about ``size`` characters that end where a match must end."""
    i = 0
    while len(text) - i > size:
        m = _SAFE.search(text, i + size)
        if m is None:
            break
        yield text[i : m.start()]
        i = m.start()
    yield text[i:] if i else text


def _blank(enc, run: str) -> list[int]:
    """Ids of one match that is nothing but blanks, however long.

    The merges of a byte run depend on the whole run, and the library merges a long piece in n log n steps.
    """
    return enc._core_bpe.encode_single_piece(run.encode())


def _short(enc, text: str) -> list[int]:
    if len(text) < RUN:
        return enc.encode_ordinary(text)
    ids, i = [], 0
    for m in _runs().finditer(text):
        stop = m.end() - (m.end() < len(text))  # the last blank may begin the next match
        ids += enc.encode_ordinary(text[i : m.start()]) if m.start() > i else []
        ids += _blank(enc, text[m.start() : stop])
        i = stop
    return ids + enc.encode_ordinary(text[i:]) if i else enc.encode_ordinary(text)


@functools.cache
def _runs():
    import regex

    return regex.compile(rf"\s{{{RUN},}}+")


def encode(enc, text: str) -> list[int]:
    if len(text) <= PIECE:
        return _short(enc, text)
    ids: list[int] = []
    for p in pieces(text):
        ids += _short(enc, p)
    return ids


def _digest(path: str):
    import numpy as np

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            for part, _, _ in B.slices(batch):
                n, ids_hex, dec_hex = [], [], []
                for t in B.column(part, "text").to_pylist():
                    ids = encode(enc, t)
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                    dec_hex.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([B.column(part, "doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(dec_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, ranks: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes they decode to."""
    return arrow_map(texts(docs), _digest(ranks), SCHEMA)


def encode_text(docs: DataFrame, ranks: str, *, ids_col: str = "token_ids") -> DataFrame:
    """The documents with their ids as an array column; a column of that name is replaced."""

    def ids_of(batches):
        enc = encoding(ranks)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            ids = [encode(enc, t) if t is not None else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, ids_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    docs = docs.drop(ids_col)
    schema = StructType([*docs.schema.fields]).add(ids_col, ArrayType(IntegerType()))
    return arrow_map(docs, ids_of, schema)


def decode_ids(encoded: DataFrame, ranks: str, *, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Raw bytes of the ids; ids need not end on a character boundary, so the column is binary."""

    def bytes_of(batches):
        enc = encoding(ranks)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            dec = [enc.decode_bytes(x) if x is not None else None for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dec, pa.binary())], names=[*batch.schema.names, out])

    from pyspark.sql.types import BinaryType, StructType

    encoded = encoded.drop(out)
    return arrow_map(encoded, bytes_of, StructType([*encoded.schema.fields]).add(out, BinaryType()))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


__all__ = ["decode_ids", "digests", "encode", "encode_text", "encoding", "op7_bpe", "pieces"]
