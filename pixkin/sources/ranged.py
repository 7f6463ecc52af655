"""ZIP archives read by ranges: the end record, the directory, and the bytes of the entries asked for.

Archives of any size open, by whatever pyarrow's file systems reach (local and mounted folders, S3, GCS, HDFS). Only rows of directories
are shuffled; entries are read where they are dealt to, in runs of neighbouring bytes. The directory's format is parsed here because
it must be read without the file: the layouts below are the format's.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from pixkin.operators.skew import bounded_batches

#: Entries of one stretch of so many bytes are read by one task.
RANGE_BYTES = 64 << 20
PLACES = "method int, crc long, offset long"

# Records of the format, little-endian.
END, END64_PLACE, END64 = struct.Struct("<4s4H2LH"), struct.Struct("<4sLQL"), struct.Struct("<4sQ2H2L4Q")
ENTRY, LOCAL = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
MOST_COMMENT = 65_535

Read = Callable[[int, int], bytes]


class BadArchive(ValueError):
    pass


class Entry(NamedTuple):
    index: int
    filename: str
    directory: bool
    compressed_size: int
    uncompressed_size: int
    encrypted: bool
    last_modified: datetime | None
    method: int
    crc: int
    offset: int


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place, by a path as Spark gives it."""
    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]+:", path):
        system, inner = pafs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", path))


def reader_of(file: pa.NativeFile) -> Read:
    def read(at: int, n: int) -> bytes:
        data = file.read_at(n, at) if n else b""
        if len(data) != n:
            raise BadArchive("the file ends early")
        return data

    return read


def directory(read: Read, size: int) -> tuple[bytes, int, int]:
    """The directory's bytes, its number of entries, and how far the archive is moved by what stands before it."""
    tail_at = max(0, size - END.size - MOST_COMMENT)
    tail = read(tail_at, size - tail_at)
    places = [m.start() for m in re.finditer(b"PK\5\6", tail) if m.start() + END.size <= len(tail)]
    left = {p: len(tail) - p - END.size - END.unpack_from(tail, p)[7] for p in places}  # after the comment
    at = max((p for p in places if left[p] == 0), default=max((p for p in places if left[p] >= 0), default=-1))
    if at < 0:
        raise BadArchive("no end record")
    _, disk, first_disk, _, count, length, start, _ = END.unpack_from(tail, at)
    end = tail_at + at
    if 0xFFFF in (disk, count) or 0xFFFFFFFF in (length, start):
        place = end - END64_PLACE.size
        mark, _, big, _ = END64_PLACE.unpack(read(place, END64_PLACE.size)) if place >= 0 else (b"", 0, 0, 0)
        if mark == b"PK\6\7":
            record = END64.unpack(read(big, END64.size))
            if record[0] != b"PK\6\6":
                raise BadArchive("no ZIP64 end record")
            disk, first_disk, count, length, start, end = record[4], record[5], record[7], record[8], record[9], big
    moved = end - length - start
    if disk != first_disk or moved < 0:
        raise BadArchive("a part of a split archive, or a wrong directory size")
    return read(start + moved, length), count, moved


def entries(read: Read, size: int) -> Iterator[Entry]:
    data, count, moved = directory(read, size)
    at = 0
    for index in range(count):
        if at + ENTRY.size > len(data) or data[at : at + 4] != b"PK\1\2":
            raise BadArchive(f"no directory record {index}")
        _, _, _, flags, method, clock, day, crc, packed, unpacked, names, extras, comments, _, _, _, offset = ENTRY.unpack_from(data, at)
        raw = data[at + ENTRY.size : at + ENTRY.size + names]
        extra = data[at + ENTRY.size + names : at + ENTRY.size + names + extras]
        at += ENTRY.size + names + extras + comments
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            wide, extra = extra[4 : 4 + n], extra[4 + n :]
            if kind == 1:  # 64-bit values of those that don't fit, in this order
                values = iter(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))
                unpacked, packed, offset = (next(values, v) if v == 0xFFFFFFFF else v for v in (unpacked, packed, offset))
        try:
            name = raw.decode("utf-8" if flags & 0x800 else "cp437")
        except UnicodeDecodeError as e:
            raise BadArchive("a name that is no UTF-8") from e
        try:
            when = datetime((day >> 9) + 1980, day >> 5 & 15, day & 31, clock >> 11, clock >> 5 & 63, (clock & 31) * 2, tzinfo=timezone.utc)
        except ValueError:
            when = None
        yield Entry(index, name, name.endswith("/"), packed, unpacked, bool(flags & 1), when, method, crc, offset + moved)


def payload(read: Read, offset: int, packed: int, unpacked: int, method: int, crc: int) -> bytes | None:
    """The verified bytes of an entry; None if it can't be read, or its size or checksum is wrong. Nothing beyond the stated size is unpacked."""
    try:
        mark, *_, names, extras = LOCAL.unpack(read(offset, LOCAL.size))
        if mark != b"PK\3\4" or method not in (0, 8):
            return None
        data = read(offset + LOCAL.size + names + extras, packed)
        if method == 8:
            inflate = zlib.decompressobj(-15)
            data = inflate.decompress(data, unpacked + 1)
            if not inflate.eof:
                return None
    except (BadArchive, zlib.error, struct.error, OSError):
        return None
    return data if len(data) == unpacked and zlib.crc32(data) == crc else None


def read_directories(files: DataFrame, schema: str) -> DataFrame:
    """``schema`` (of archives' entries), PLACES and error (then index is null) of the archives at ``files``' paths; no payload is read."""
    names = [f.split()[0] for f in f"{schema}, {PLACES}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"index": pa.int32(), "filename": pa.string(), "directory": pa.bool_(), "encrypted": pa.bool_(), "last_modified": pa.timestamp("us", "UTC"), "method": pa.int32(), "archive": pa.string(), "error": pa.string()}
        for b in batches:
            for path in b.column(0).to_pylist():
                error, rows = None, []
                try:
                    with opened(path) as file:
                        rows = list(entries(reader_of(file), file.size()))
                except (BadArchive, struct.error, OSError) as e:
                    error, rows = str(e), [None]
                columns = {"archive": [path] * len(rows), **{n: [r and getattr(r, n) for r in rows] for n in names[1:]}, "error": [error] * len(rows)}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in columns.items()], list(columns))

    return files.select("path").mapInArrow(run, f"{schema}, {PLACES}, error string")


def read_payloads(wanted: DataFrame) -> DataFrame:
    """archive, index, content, error of entries with their places. Neighbouring entries of an archive are one task's, RANGE_BYTES at most with a first entry beyond."""
    keys = ["archive", "index", "offset", "compressed_size", "uncompressed_size", "method", "crc", "encrypted"]
    stretch = F.expr(f"offset div {RANGE_BYTES}")
    dealt = wanted.select(*keys).repartition("archive", stretch).sortWithinPartitions("archive", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = None, None
        for b in batches:
            for archive, index, offset, packed, unpacked, method, crc, encrypted in zip(*(c.to_pylist() for c in b.columns)):
                if archive != last:
                    last, file = archive, opened(archive)
                data = None if encrypted else payload(reader_of(file), offset, packed, unpacked, method, crc)
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([index], pa.int32()), pa.array([data], pa.binary()), pa.array([None if data is not None else "corrupt-entry"], pa.string())], ["archive", "index", "content", "error"])

    return bounded_batches(dealt).mapInArrow(run, "archive string, index int, content binary, error string")


def ends(files: DataFrame, chunk: int) -> DataFrame:
    """``files`` (path, modificationTime, length) with head and tail: the first and the last ``chunk`` bytes without overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with opened(row["path"]) as file:
                    head = file.read_at(min(chunk, row["length"]), 0)
                    start = max(len(head), row["length"] - chunk)
                    tail = file.read_at(row["length"] - start, start) if row["length"] > start else b""
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["modificationTime"]], b.schema.field(1).type), pa.array([row["length"]], pa.int64()), pa.array([head], pa.binary()), pa.array([tail], pa.binary())], ["path", "modificationTime", "length", "head", "tail"])

    return files.select("path", "modificationTime", "length").mapInArrow(run, "path string, modificationTime timestamp, length long, head binary, tail binary")


class OneArchive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.name = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A name asked for is looked up in the directory, so only its bytes are read; other filters are Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("filename",) and self.name is None:
                self.name = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        local = re.sub(r"^file:/*", "/", self.path)
        system, inner = (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(self.path)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.Directory:
            inners = sorted(f.path for f in system.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.type == pafs.FileType.File and f.path.lower().endswith(".zip"))
        else:
            inners = [inner]
        scheme = "" if local.startswith("/") else self.path.split(":", 1)[0] + "://"
        return [OneArchive(scheme + p) for p in inners]

    def read(self, partition: OneArchive) -> Iterator[tuple]:
        with opened(partition.path) as file:
            read = reader_of(file)
            for e in entries(read, file.size()):
                if not e.directory and (self.name is None or e.filename == self.name):
                    yield partition.path, e.index, e.filename, e.uncompressed_size, payload(read, e.offset, e.compressed_size, e.uncompressed_size, e.method, e.crc)


class ZipSource(DataSource):
    """spark.read.format("zip").load(path): an archive, or all in a folder. archive, index, filename, size, content (null if it fails its checks). Register it by spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return "archive string, index int, filename string, size long, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"])
