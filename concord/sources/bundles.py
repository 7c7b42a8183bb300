"""Tar bundles as a data source: members are listed by their headers, and each is decoded from its own byte range.

Files are opened through Arrow's file systems (local, S3, GCS, HDFS), so a bundle may have any size: listing seeks over the
bodies, and decoding streams a member in batches of rows.
"""

from __future__ import annotations

import csv
import ctypes
import functools
import gzip
import hashlib
import io
import tarfile
from collections.abc import Callable, Iterator
from itertools import zip_longest

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 20_000  # cells in an Arrow batch
MEMBERS = "path string, member string, offset long, size long"
CELLS = pa.schema([("path", pa.string()), ("member", pa.string()), ("sample_id", pa.string()), ("row", pa.int64()),
    ("row_key", pa.string()), ("field", pa.string()), ("value", pa.string())])


def opened(path: str) -> pa.NativeFile:
    store, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(at)


def files_of(path: str) -> list[str]:
    """The tar files at ``path``: a file, or those in a folder, as URIs of the same scheme."""
    store, at = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    scheme = path[: path.index(at)] if at in path else ""
    found = store.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    each = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(scheme + x.path for x in each if x.type == fs.FileType.File and x.extension == "tar")


class BundleFile(InputPartition):
    """One tar file."""


class BundleMembers(DataSource):
    """path, member, offset and size of the regular files in tar bundles; a task lists a bundle without reading bodies."""

    @classmethod
    def name(cls) -> str:
        return "bundle_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return BundleReader(self.options["path"])


class BundleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[BundleFile]:
        return [BundleFile(f) for f in files_of(self.path)]

    def read(self, partition: BundleFile | None) -> Iterator[tuple]:
        if partition is None or partition.value is None:  # no bundle at all
            return
        with opened(partition.value) as data, tarfile.open(fileobj=data, mode="r:") as tar:
            for m in tar:
                if m.isfile():
                    yield partition.value, m.name, m.offset_data, m.size
                tar.members = []  # else the headers of a large bundle stay in memory


class _Range(io.RawIOBase):
    """``size`` bytes of a file from where it stands."""

    def __init__(self, data: pa.NativeFile, size: int):
        self.data, self.left = data, size

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.data.read(min(len(into), self.left))
        into[: len(got)] = got
        self.left -= len(got)
        return len(got)


def _lines(data: pa.NativeFile, offset: int, size: int) -> Iterator[list[str]]:
    data.seek(offset)
    zipped = data.read(min(2, size)) == b"\x1f\x8b"
    data.seek(offset)
    raw = io.BufferedReader(_Range(data, size), 1 << 20)
    return csv.reader(io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if zipped else raw, "utf-8", "replace", newline=""), delimiter="\t")


def _cells(path: str, member: str, sample_id: str, offset: int, size: int) -> Iterator[tuple]:
    """A row longer than the header has its further cells under '#' and their position; a shorter one has nulls."""
    with opened(path) as data:
        lines = _lines(data, offset, size)
        head = next(lines, [])
        for row, cells in enumerate((c for c in lines if c), 1):
            for k, (field, value) in enumerate(zip_longest(head[1:], cells[1:]), 1):
                yield path, member, sample_id, row, cells[0], f"#{k}" if field is None else field, value


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CELLS, strict=True)], schema=CELLS)


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of members (path, member, sample_id, offset, size)."""
    for batch in batches:
        for m in batch.to_pylist():
            rows = []
            for cell in _cells(m["path"], m["member"], m["sample_id"], m["offset"], m["size"]):
                rows.append(cell)
                if len(rows) == ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


BLOCK = 4 << 20


def ranges_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, chunk, size_bytes and SHA-256 of byte ranges (path, chunk, offset, size_bytes), read block by block."""
    for batch in batches:
        digests = []
        for r in batch.to_pylist():
            digest, left = hashlib.sha256(), r["size_bytes"]
            with opened(r["path"]) as data:
                data.seek(r["offset"])
                while left and (block := data.read(min(BLOCK, left))):
                    digest.update(block)
                    left -= len(block)
            digests.append(digest.hexdigest())
        kept = [batch.column(c) for c in ("path", "chunk", "size_bytes")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.string())], ["path", "chunk", "size_bytes", "sha256"])


class _Context(ctypes.Structure):
    """OpenSSL's SHA256_CTX (openssl/sha.h): all that a digest knows of the bytes it has seen."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16),
        ("num", ctypes.c_uint), ("length", ctypes.c_uint)]


class Sha256:
    """SHA-256 whose ``state`` can be put away and taken up by another process."""

    def __init__(self, openssl: ctypes.CDLL, state: bytes | None = None):
        self.openssl, self.context = openssl, _Context.from_buffer_copy(state) if state else _Context()
        if not state:
            openssl.SHA256_Init(ctypes.byref(self.context))

    def update(self, block: bytes) -> None:
        self.openssl.SHA256_Update(ctypes.byref(self.context), ctypes.c_char_p(block), ctypes.c_size_t(len(block)))

    @property
    def state(self) -> bytes:
        return bytes(self.context)

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.openssl.SHA256_Final(out, ctypes.byref(self.context))
        return out.raw.hex()


@functools.cache
def openssl() -> ctypes.CDLL | None:
    """The OpenSSL that Python's own hashlib is linked to, or None where a digest can't be taken up again through it."""
    try:
        import _hashlib

        found = ctypes.CDLL(_hashlib.__file__)
        begun = Sha256(found)
        begun.update(b"a" * 100)
        ended = Sha256(found, begun.state)
        ended.update(b"b" * 100)
        return found if ended.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest() else None
    except (ImportError, OSError, AttributeError):
        return None


def _fed(digest, path: str, offset: int, size: int):
    """``digest`` with ``size`` bytes of a file from ``offset``; a file that has become shorter is an error."""
    with opened(path) as data:
        data.seek(offset)
        while size:
            if not (block := data.read(min(BLOCK, size))):
                raise EOFError(path)
            digest.update(block)
            size -= len(block)
    return digest


HASHED = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("state", pa.binary()), ("sha256", pa.string())])


def range_taken_up(number: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes the digests of files (HASHED) through their range ``number`` of ``size`` bytes; a file's last range gives its
    sha256. Without such an OpenSSL nothing is put away, and the last range's task reads the file from its beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.to_pylist()
            for f in (f for f in files if f["sha256"] is None):
                at, last = number * size, (number + 1) * size >= f["size_bytes"]
                if openssl():
                    digest = _fed(Sha256(openssl(), f["state"]), f["path"], at, min(size, f["size_bytes"] - at))
                    f["state"], f["sha256"] = (None, digest.hexdigest()) if last else (digest.state, None)
                elif last:
                    f["sha256"] = _fed(hashlib.sha256(), f["path"], 0, f["size_bytes"]).hexdigest()
            yield pa.RecordBatch.from_pylist(files, schema=HASHED)

    return run
