"""Media columns: payloads stored as lossless 8-bit images in archives, read back by byte range.

A text's UTF-8 bytes, filled up with blanks to a positive multiple of 192, become the samples of a
grey 8-bit PNG of width 192; the image carries the unpadded length as a text chunk.  The images are
members of the archives that ``archive_source`` writes and reads.  Features come from the samples
read back: an 8 x 8 average hash, the mean and the standard deviation.

Defined results: null and empty texts are 192 blanks; equal texts have equal media and features;
repeated rows are stored and returned each; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm import archive_source
from orrery.llm import bytesops as B
from orrery.llm.common import Scratch, arrow_map, table, texts

WIDTH = 192
LEVEL = 4
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    size = max(WIDTH, -(-len(text) // WIDTH) * WIDTH)
    return text.ljust(size, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packed = zlib.compress(rows.tobytes(), LEVEL)
    idat = b"".join(_chunk(b"IDAT", packed[i : i + (1 << 20)]) for i in range(0, len(packed), 1 << 20))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\x00%d" % n_bytes) + idat + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """(samples by row, text chunks) of a grey 8-bit image without interlacing; every filter type."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, idat, notes, shape = 8, [], {}, None
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk doesn't match its CRC")
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only grey 8-bit images without interlacing")
            shape = (h, w)
        elif kind == b"tEXt":
            k, _, v = body.partition(b"\x00")
            notes[k.decode("latin-1")] = v.decode("latin-1")
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(shape[0], shape[1] + 1)
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if kinds.any():
        _unfilter(kinds, rows)
    return rows, notes


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> None:
    above = np.zeros(rows.shape[1], np.uint8)
    for y in range(len(rows)):
        r, k = rows[y], kinds[y]
        if k == 1:
            np.cumsum(r, dtype=np.uint8, out=r)
        elif k == 2:
            r += above
        elif k in (3, 4):
            left = corner = 0
            for x in range(len(r)):
                up = int(above[x])
                if k == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    guess = min((left, up, corner), key=lambda v, p=p: abs(p - v))
                    corner = up
                left = (int(r[x]) + guess) & 255
                r[x] = left
        above = r


def feature(samples: np.ndarray) -> str:
    """Average hash over 64 equal runs of samples, with mean and standard deviation."""
    flat = samples.reshape(-1)
    edges = np.arange(64) * len(flat) // 64
    sums = np.add.reduceat(flat.astype(np.int64), edges)
    means = sums / np.diff(np.append(edges, len(flat)))
    total = int(sums.sum())
    mean = total / len(flat)
    bits = int("".join("1" if m > mean else "0" for m in means), 2)
    square = int(np.dot(flat.astype(np.int64), flat.astype(np.int64)))
    var = max(0.0, square / len(flat) - mean * mean)
    return f"{bits:016x}:{mean:.3f}:{var**0.5:.3f}"


def _encode(batches):
    for batch in batches:
        for part, data, offs in B.slices(batch):
            ids, raw = B.column(part, "doc_id").to_pylist(), data.tobytes()
            media = []
            for i in range(part.num_rows):
                t = raw[offs[i] : offs[i + 1]]
                media.append(encode_png(payload_of(t), len(t)))
            yield pa.RecordBatch.from_arrays([pa.array(["" if i is None else str(i) for i in ids], pa.string()), pa.array(media, pa.binary())], names=["name", "payload"])


def _decode(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(8)]
        for name, media in zip(B.column(batch, "name").to_pylist(), B.column(batch, "payload")):
            stored = media.as_py()
            samples, notes = decode_png(stored)
            payload = samples.tobytes()
            row = (int(name) if name else None, int(notes["bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples))
            for c, v in zip(cols, row):
                c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def store_media(docs: DataFrame, path: str) -> None:
    """Write the documents' media to archives under ``path``."""
    archive_source.register(docs.sparkSession)
    arrow_map(texts(docs), _encode, "name string, payload binary").write.format("orrery_archive").mode("append").save(path)


def read_media(spark, path: str, **options: str) -> DataFrame:
    """The members of the archives under ``path``: name, archive, position, attempts, payload, error."""
    archive_source.register(spark)
    return spark.read.format("orrery_archive").options(**options).load(path)


def media_features(media: DataFrame) -> DataFrame:
    return arrow_map(media, _decode, SCHEMA)


def op8_media(spark, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("media")
    store_media(table(spark, sf_dir, "documents"), path)
    return media_features(read_media(spark, path))
