"""A Spark data source of archives: directories of ZIP files whose members are the rows.

Writing: every task streams its rows into archives of about ``roll_bytes`` each, under names no other
attempt uses, and reports them; the commit publishes one manifest that lists the archives of the
attempts that won and removes the others.  A lost executor or a second attempt leaves no row behind.

Reading: the driver plans partitions from the manifest as byte ranges of the archives, without
opening one.  A task reads an archive's directory, takes the members whose header starts in its
range, and streams their payloads as Arrow batches of about ``batch_bytes``.  Each member is read and
checked (CRC-32) by itself: a member that fails is read again from its own offset through a new
handle, up to ``attempts`` times, while the others are not touched.  What still fails raises, or
becomes a row with a null payload and its error when ``on_error`` is ``null``.

Paths are URIs of any store that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import io
import json
import re
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Manifests are numbered, and the newest counts: none is ever replaced, so a writer that dies leaves the last one in force.
MANIFEST = "_manifest-{:012d}.json"
_NUMBERED = re.compile(r"_manifest-(\d{12})\.json")
SCHEMA = "name string, archive string, position long, attempts int, payload binary, error string"
_ARROW = pa.schema([("name", pa.string()), ("archive", pa.string()), ("position", pa.int64()), ("attempts", pa.int32()), ("payload", pa.binary()), ("error", pa.string())])


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass
class ByteRange(InputPartition):
    archive: str
    size: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int, int]]


class _Counting(io.RawIOBase):
    """A write-only handle that counts, for streams that can't tell."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        self.n += len(data)
        return len(data)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.root = options["path"]
        self.roll = int(options.get("roll_bytes", 64 << 20))
        self.job = uuid.uuid4().hex[:12]

    def write(self, iterator):
        store, root = open_store(self.root)
        store.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        handle = archive = None
        name, members = "", 0

        def close():
            nonlocal archive
            if archive is not None:
                archive.close()
                handle.out.close()
                done.append((name, handle.n, members))
                archive = None

        for batch in iterator:
            names, payloads = batch.column(batch.schema.get_field_index("name")), batch.column(batch.schema.get_field_index("payload"))
            for i in range(batch.num_rows):
                if archive is not None and handle.n >= self.roll:
                    close()
                if archive is None:
                    name, members = f"{self.job}-{uuid.uuid4().hex}.zip", 0
                    handle = _Counting(store.open_output_stream(f"{root}/{name}"))
                    archive = zipfile.ZipFile(handle, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(f"{members}/{names[i].as_py()}")
                archive.writestr(info, payloads[i].as_py() or b"")
                members += 1
        close()
        return Written(done)

    def commit(self, messages):
        store, root = open_store(self.root)
        store.create_dir(root, recursive=True)
        new = sorted(a for m in messages if m is not None for a in m.archives)
        number, old = _manifest(store, root)
        draft, final = f"{root}/_draft-{self.job}.json", f"{root}/{MANIFEST.format(number + 1)}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps(old + new).encode())
        if store.get_file_info(final).type != fs.FileType.NotFound:
            raise OSError(f"another writer has committed {final}")
        store.move(draft, final)
        self._sweep(store, root, {a[0] for a in new})

    def abort(self, messages):
        store, root = open_store(self.root)
        self._sweep(store, root, set())

    def _sweep(self, store, root, keep):
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"{self.job}-") and info.base_name not in keep:
                store.delete_file(info.path)


def _manifest(store: fs.FileSystem, root: str) -> tuple[int, list]:
    """(number, archives) of the newest manifest; (-1, none) without one."""
    found = [int(m[1]) for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if (m := _NUMBERED.fullmatch(i.base_name))]
    if not found:
        return -1, []
    with store.open_input_stream(f"{root}/{MANIFEST.format(max(found))}") as f:
        return max(found), [tuple(x) for x in json.loads(f.read())]


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.range = int(options.get("range_bytes", 16 << 20))
        self.batch = int(options.get("batch_bytes", 4 << 20))
        self.attempts = int(options.get("attempts", 3))
        self.wait = float(options.get("retry_seconds", 0.2))
        self.keep = options.get("on_error", "raise") == "null"

    def partitions(self):
        store, root = open_store(self.root)
        out = []
        for name, size, _ in _manifest(store, root)[1]:
            n = max(1, -(-size // self.range))
            out += [ByteRange(name, size, size * k // n, size * (k + 1) // n) for k in range(n)]
        return out

    def read(self, partition):
        if partition is None:  # Spark's stand-in where nothing was planned
            return
        store, root = open_store(self.root)
        path = f"{root}/{partition.archive}"
        with store.open_input_file(path) as f, zipfile.ZipFile(_Seekable(f)) as z:
            infos = [i for i in z.infolist() if partition.start <= i.header_offset < partition.end]
        infos.sort(key=lambda i: i.header_offset)
        handle, rows, size = store.open_input_file(path), [], 0
        try:
            for info in infos:
                data, tries, error = None, 0, None
                while data is None and tries < self.attempts:
                    tries += 1
                    try:
                        data = self.member(handle, info)
                        error = None
                    except (OSError, ValueError, zlib.error, struct.error) as e:
                        error = f"{type(e).__name__}: {e}"[:200]
                        if tries < self.attempts:
                            time.sleep(self.wait * tries)
                            try:
                                handle.close()
                            except OSError:
                                pass
                            handle = store.open_input_file(path)
                if data is None and not self.keep:
                    raise OSError(f"member {info.filename} at {info.header_offset} of {path}: {error}")
                rows.append((info.filename.split("/", 1)[-1], partition.archive, info.header_offset, tries, data, error))
                size += len(data or b"")
                if size >= self.batch:
                    yield self.rows(rows)
                    rows, size = [], 0
        finally:
            handle.close()
        if rows:
            yield self.rows(rows)

    @staticmethod
    def rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_ARROW)], schema=_ARROW)

    @staticmethod
    def member(handle, info: zipfile.ZipInfo) -> bytes:
        """The member's payload, from its own offset."""
        handle.seek(info.header_offset)
        head = handle.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise ValueError("no member header here")
        name_len, extra_len = struct.unpack("<HH", head[26:30])
        handle.seek(info.header_offset + 30 + name_len + extra_len)
        data = handle.read(info.compress_size)
        if info.compress_type == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -15)
        elif info.compress_type != zipfile.ZIP_STORED:
            raise ValueError(f"compression {info.compress_type} isn't supported")
        if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
            raise ValueError("payload doesn't match its CRC")
        return data


class _Seekable(io.RawIOBase):
    """A pyarrow input file as zipfile wants it."""

    def __init__(self, f):
        self.f = f

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, at, whence=0):
        return self.f.seek(at, whence)

    def tell(self):
        return self.f.tell()

    def read(self, n=-1):
        return self.f.read() if n is None or n < 0 else self.f.read(n)


class ArchiveSource(DataSource):
    """format("orrery_archive"): columns name, archive, position, attempts, payload, error."""

    @classmethod
    def name(cls):
        return "orrery_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options)


def register(spark) -> None:
    spark.dataSource.register(ArchiveSource)
