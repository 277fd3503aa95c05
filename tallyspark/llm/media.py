"""Media columns: payloads as lossless 8-bit images in archives, and a Spark data source that reads them by byte ranges.

An archive is a tar file of PNG images (8-bit grey, ``WIDTH`` samples a row). Behind the tar's own end stands an index of fixed-width
records (place and length of each member's body) and a footer, so a byte range's members are found without reading those before it. The
source plans ranges from file sizes alone; a task opens its archive once, looks up its slice of the index, and streams the members in Arrow batches,
one read for a run of neighbouring members. What such a read doesn't give whole is read again member by member, each by its offset and on its own.

Scale: writing is a map over documents, one archive for each task, renamed into place when whole (a task that runs again replaces its own archive
and no other). Planning lists files, not members. A task holds one run of members and its batch. Paths go through pyarrow's file systems
(local, hdfs, s3, ..), never through a machine-local folder.
"""

from __future__ import annotations

import hashlib
import math
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .storage import new_path

WIDTH = 192
PAD = b" "
SUFFIX = ".media"
#: Bytes of archive for a partition, members for an Arrow batch, and bodies' bytes for one.
RANGE_BYTES, BATCH_MEMBERS, BATCH_BYTES = 16 << 20, 512, 8 << 20
#: Records of the index that one probe reads.
INDEX_RECORDS = 4096
ATTEMPTS = 4

_PNG = b"\x89PNG\r\n\x1a\n"
_RECORD = struct.Struct("<QQ")
_FOOTER = struct.Struct("<QQ16s")
_MAGIC = b"media-index-v1\0\0"

SCHEMA = "member string, archive string, offset long, media binary, error string"


def padded(payload: bytes) -> bytes:
    """With blanks up to a positive multiple of WIDTH."""
    return payload + PAD * (-len(payload) % WIDTH if payload else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: bytes, level: int = 4) -> bytes:
    """A grey image of WIDTH columns, without filtering, that holds exactly these samples (their number is a multiple of WIDTH)."""
    rows = np.zeros((len(samples) // WIDTH, WIDTH + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an image that encode_png made; ValueError for anything else, wrong checksums included."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, data, size = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[0] != WIDTH or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of PNG image")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(size[1], WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered row")
    return rows[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Rows, mean, spread, entropy in bits, and an 8 x 8 brightness hash of the image, as text with fixed decimals."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(x))
    spread = math.sqrt(max(0.0, float((counts * values * values).sum() / len(x)) - mean * mean))
    entropy = max(0.0, float(-(p * np.log2(p)).sum()))
    image = x.reshape(-1, WIDTH)
    cuts = np.linspace(0, len(image), 9).astype(int)
    grid = np.array([image[a : max(b, a + 1)].reshape(-1, 8, WIDTH // 8).mean(axis=(0, 2)) if a < len(image) else np.zeros(8) for a, b in zip(cuts, cuts[1:])])
    bits = np.packbits((grid > grid.mean()).ravel()).tobytes().hex()
    return f"rows={len(image)};mean={mean:.4f};spread={spread:.4f};entropy={entropy:.4f};hash={bits}"


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Archive:
    """Writes one archive under a passing name; close() gives it its own."""

    def __init__(self, folder: str, name: str):
        self.files, at = _file_system(folder)
        self.path, self.draft = f"{at}/{name}{SUFFIX}", f"{at}/_{name}-{time.time_ns()}"
        self.out, self.at, self.index = self.files.open_output_stream(self.draft), 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, body: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(body)
        self._write(info.tobuf(tarfile.PAX_FORMAT))
        self.index.append(_RECORD.pack(self.at, len(body)))
        self._write(body)
        self._write(b"\0" * (-len(body) % 512))

    def close(self) -> None:
        self._write(b"\0" * 1024)
        start = self.at
        self._write(b"".join(self.index))
        self._write(_FOOTER.pack(start, len(self.index), _MAGIC))
        self.out.close()
        if self.files.get_file_info(self.path).type != fs.FileType.NotFound:  # a lost task's, with the same members
            self.files.delete_file(self.path)
        self.files.move(self.draft, self.path)


def write_archives(rows: DataFrame, folder: str) -> int:
    """Stores each row's ``payload`` (binary, padded here) as a member named by its ``member``; the number of archives."""
    files, at = _file_system(folder)
    files.create_dir(at, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n, size = None, 0, 0
        for batch in batches:
            for name, body in zip(*batch.columns, strict=True):
                archive = archive or Archive(folder, f"part-{TaskContext.get().partitionId():06d}")
                archive.add(name.as_py(), encode_png(padded(body.as_py())))
                n += 1
        if archive:
            archive.close()
            size = archive.at
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["members", "bytes"])

    done = rows.select("member", "payload").mapInArrow(run, "members long, bytes long")
    return done.where("members > 0").count()


class ArchiveRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, stop: int):
        self.path, self.size, self.start, self.stop = path, size, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, attempts: int, on_error: str):
        self.folder, self.range_bytes, self.attempts, self.on_error = folder, range_bytes, attempts, on_error

    def partitions(self) -> list[ArchiveRange]:
        """Byte ranges of every archive in the folder and below, by the sizes that the listing gives."""
        files, at = _file_system(self.folder)
        found = [x for x in files.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file and x.path.endswith(SUFFIX)]
        ranges = [ArchiveRange(x.path, x.size, a, a + self.range_bytes) for x in sorted(found, key=lambda x: x.path) for a in range(0, x.size, self.range_bytes)]
        return ranges or [ArchiveRange("", 0, 0, 0)]

    def _again(self, what, *args):
        """What it returns; after a failure it is tried again, up to the number of attempts."""
        for k in range(self.attempts):
            try:
                return what(*args)
            except (OSError, EOFError, ValueError, tarfile.TarError, zlib.error, struct.error):
                if k + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**k)

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("member", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
        if not partition.path:
            return
        files, _ = _file_system(self.folder)
        opened = []

        def bytes_at(offset: int, n: int) -> bytes:
            if not opened:
                opened.append(files.open_input_file(partition.path))
            try:
                found = opened[0].read_at(n, offset)
                if len(found) != n:
                    raise EOFError(f"{len(found)} of {n} bytes at {offset}")
            except (OSError, EOFError):
                opened.pop().close()  # the next read opens the archive anew
                raise
            return found

        try:
            rows, held = [], 0
            for run in self._runs(partition, bytes_at):
                for row in self._members(partition, run, bytes_at):
                    rows.append(row)
                    held += len(row[3] or b"")
                    if len(rows) >= BATCH_MEMBERS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            for source in opened:
                source.close()

    def _runs(self, partition: ArchiveRange, bytes_at) -> Iterator[list[tuple[int, int]]]:
        """(place, length) of the bodies that start in the range, in runs of neighbours of at most a batch's bytes (or one longer body)."""

        def footer() -> tuple[int, int]:
            start, n, magic = _FOOTER.unpack(bytes_at(partition.size - _FOOTER.size, _FOOTER.size))
            if magic != _MAGIC:
                raise ValueError(f"{partition.path} has no index")
            return start, n

        start, n = self._again(footer)

        def records(low: int, high: int) -> list[tuple[int, int]]:
            return list(_RECORD.iter_unpack(self._again(bytes_at, start + low * _RECORD.size, (high - low) * _RECORD.size))) if low < high else []

        low, high = 0, n
        while high - low > INDEX_RECORDS:  # the first member at or behind the range's start lies in [low, high]
            mid = (low + high) // 2
            if records(mid, mid + 1)[0][0] < partition.start:
                low = mid + 1
            else:
                high = mid
        run, end = [], False
        while low < n and not end:
            for offset, size in records(low, min(low + INDEX_RECORDS, n)):
                if offset >= partition.stop:
                    end = True
                    break
                if offset < partition.start:
                    continue
                if run and (len(run) >= BATCH_MEMBERS or offset + size - run[0][0] > BATCH_BYTES):
                    yield run
                    run = []
                run.append((offset, size))
            low += INDEX_RECORDS
        if run:
            yield run

    def _members(self, partition: ArchiveRange, run: list[tuple[int, int]], bytes_at) -> Iterator[tuple]:
        """A row for each member of the run, read at once; what that read doesn't give whole is read by itself."""
        failures = (OSError, EOFError, ValueError, tarfile.TarError, zlib.error, struct.error)

        def checked(head: bytes, offset: int, size: int) -> tuple[str, bytes]:
            """Name and body of a member; the header is the 512 bytes before the body, with a longer name in the blocks before those."""
            info = tarfile.TarInfo.frombuf(head[:512], "utf-8", "surrogateescape")
            if info.size != size:
                raise ValueError(f"the member at {offset} has {info.size} bytes, not {size}")
            decode_png(head[512:])  # a damaged body fails here and is read again
            return info.name, head[512:]

        def alone(offset: int, size: int) -> tuple[str, bytes]:
            return checked(bytes_at(offset - 512, 512 + size), offset, size)

        first = run[0][0] - 512
        try:
            whole = memoryview(bytes_at(first, run[-1][0] + run[-1][1] - first))
        except failures:
            whole = None
        for offset, size in run:
            try:
                try:
                    if whole is None:
                        raise EOFError("the run wasn't read")
                    name, body = checked(bytes(whole[offset - 512 - first : offset + size - first]), offset, size)
                except failures:
                    name, body = self._again(alone, offset, size)
                yield name, partition.path, offset, body, None
            except failures as error:
                if self.on_error != "record":
                    raise
                yield None, partition.path, offset, None, str(error)


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``; options rangeBytes, attempts, onError (``fail``, or ``record`` for a row with the error)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        o = self.options
        return ArchiveReader(o["path"], int(o.get("rangeBytes", RANGE_BYTES)), int(o.get("attempts", ATTEMPTS)), o.get("onError", "fail"))


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").options(**options).load(folder)


def described(media: DataFrame) -> DataFrame:
    """Of what read_archives gives: doc_id and n_bytes (from the member's name), sizes, digests and features of the stored and of the decoded bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def one(name: str, body: bytes) -> tuple:
        doc, n = name.removesuffix(".png").split("-n")
        samples = decode_png(body)
        return (
            int(doc) if doc != "null" else None, int(n), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]),
            len(body), hashlib.sha256(body).hexdigest(), features(samples),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = [one(name.as_py(), body.as_py()) for name, body in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    return media.select("member", "media").mapInArrow(run, schema)


def stored(docs: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """Every document's text as a member of archives in ``folder`` (a new one in the shared folder where None), as read_archives reads them back.

    A null or empty text is one row of blanks; repeated rows are members of their own; a null doc_id is named "null"; an empty table gives no rows.
    Other columns don't matter. Equal texts have equal media: what names a document stands in the member's name only.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.lit("-n"), F.octet_length(raw).cast("string"), F.lit(".png"))
    write_archives(docs.select(name.alias("member"), raw.cast("binary").alias("payload")), folder)
    return read_archives(spark, folder)
