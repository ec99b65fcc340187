"""Payloads as lossless 8-bit images in archives, behind a Spark data source."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import read, shared_path

#: Payloads are padded to a multiple of this many bytes, which are rows of this many pixels.
BLOCK, WIDTH = 576, 24
PAD = 255
#: An archive is closed after this many bytes; a reading task gets about this many; a batch holds about so many.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64_000_000, 16_000_000, 4_000_000
TRIES = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw, block: int = BLOCK):
    """SQL column of bytes with bytes PAD appended up to a positive multiple of block."""
    size = F.octet_length(raw)
    more = F.when(size == 0, F.lit(block)).otherwise(F.pmod(-size, F.lit(block)))
    return F.concat(raw, F.unhex(F.repeat(F.lit(f"{PAD:02X}"), more)))


def to_image(payload: bytes) -> bytes:
    """A grey 8-bit PNG, WIDTH pixels wide, whose pixels are the payload."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    pixels = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a row begins with its filter, 0
    pixels[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(pixels.tobytes(), 1)) + chunk(b"IEND", b"")


def from_image(image: bytes) -> bytes:
    """The payload of an image that to_image() made."""
    if image[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, packed, width = 8, b"", 0
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            packed += data
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the pixels, the mean step to the pixel below, and the counts of eight shades."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    steps = np.abs(np.diff(pixels.astype(np.int16), axis=0)).mean() if len(pixels) > 1 else 0.0
    shades = np.bincount((pixels >> 5).ravel(), minlength=8)
    return f"{pixels.mean():.6f} {pixels.std():.6f} {steps:.6f} " + ",".join(map(str, shades))


def _open(uri: str):
    """(file system, path) of a URI; s3a is what Hadoop calls s3."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + uri.removeprefix("s3a") if uri.startswith("s3a:") else uri)


@dataclass
class Written(WriterCommitMessage):
    archives: list[str]


@dataclass
class ByteRange(InputPartition):
    archive: str
    first: int
    after: int


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes archives under names of its own; those of failed tasks are left out of the list that commit
    writes, and a reader reads only what is on a list."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, path = _open(self.root)
        files.create_dir(path, recursive=True)
        done, archive, stream, size, n = [], None, None, 0, 0
        for batch in iterator:
            for key, n_bytes, payload in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "n_bytes", "payload")), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = files.open_output_stream(f"{path}/{name}")
                    archive, size = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0
                    done.append(name)
                image = to_image(payload)
                own = "" if key is None else "/" + quote(key, safe="")
                archive.writestr(zipfile.ZipInfo(f"{n}/{n_bytes}{own}.png"), image)
                n += 1
                size += len(image)
                if size >= ARCHIVE_BYTES:
                    archive.close()
                    stream.close()
                    archive = None
        if archive is not None:
            archive.close()
            stream.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, path = _open(self.root)
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/archives-{uuid.uuid4().hex}.list") as out:
            out.write("".join(f"{name}\n" for m in messages if m for name in m.archives).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, path = _open(self.root)
        for name in (name for m in messages if m for name in m.archives):
            files.delete_file(f"{path}/{name}")


class Opened:
    """A file that opens when something is read from it, again after close()."""

    def __init__(self, files, path: str):
        self.files, self.path, self.file = files, path, None

    def at(self, offset: int, size: int) -> bytes:
        if self.file is None:
            self.file = self.files.open_input_file(self.path)
        self.file.seek(offset)
        return self.file.read(size)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class ArchiveReader(DataSourceReader):
    def __init__(self, root: str, names: list[str]):
        self.root, self.names = root, names

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the listed archives. The driver sees archives' names and sizes, never their members."""
        from pyarrow import fs

        files, path = _open(self.root)
        lists = [x.path for x in files.get_file_info(fs.FileSelector(path)) if x.path.endswith(".list")]
        names = [name for x in sorted(lists) for name in files.open_input_stream(x).read().decode().split()]
        sizes = files.get_file_info([f"{path}/{n}" for n in names]) if names else []
        found = [ByteRange(i.path, at, at + RANGE_BYTES) for i in sizes for at in range(0, i.size, RANGE_BYTES)]
        return found or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """The members that begin in the range, by the archive's directory; only the columns of the schema are made."""
        if not partition.archive:
            return
        files, _ = _open(self.root)
        with files.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if partition.first <= m.header_offset < partition.after]
        rows: list[list] = [[] for _ in self.names]
        size, opened = 0, Opened(files, partition.archive)
        for m in members:
            image = self.member(opened, m.header_offset, m.file_size, m.CRC)
            payload = from_image(image)
            _, n_bytes, *own = m.filename.removesuffix(".png").split("/")
            key = unquote(own[0]) if own else None
            for column, name in zip(rows, self.names, strict=True):
                column.append(VALUES[name](key, int(n_bytes), payload, image))
            size += len(payload) + len(image)
            if size >= BATCH_BYTES:
                yield self.batch(rows)
                rows, size = [[] for _ in self.names], 0
        if rows and rows[0]:
            yield self.batch(rows)

    def batch(self, rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, TYPES[n]) for c, n in zip(rows, self.names, strict=True)], self.names)

    @staticmethod
    def member(opened: Opened, offset: int, size: int, crc: int) -> bytes:
        """One member by its offset, tried again on its own, with the archive opened anew, when it comes short or damaged."""
        last: Exception | None = None
        for _ in range(TRIES):
            try:
                head = opened.at(offset, 30)
                name, extra = struct.unpack("<HH", head[26:30])
                data = opened.at(offset + 30 + name + extra, size)
                if len(data) == size and zlib.crc32(data) == crc:
                    return data
                last = OSError(f"{opened.path} at {offset}: damaged member")
            except (OSError, struct.error) as e:
                last = e
            opened.close()
        raise last


TYPES = {
    "key": pa.string(), "n_bytes": pa.int64(), "payload": pa.binary(), "media": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
}
VALUES = {
    "key": lambda key, n, payload, image: key,
    "n_bytes": lambda key, n, payload, image: n,
    "payload": lambda key, n, payload, image: payload,
    "media": lambda key, n, payload, image: image,
    "payload_bytes": lambda key, n, payload, image: len(payload),
    "payload_sha256": lambda key, n, payload, image: hashlib.sha256(payload).hexdigest(),
    "tail_crc32": lambda key, n, payload, image: zlib.crc32(payload[-32:]),
    "media_bytes": lambda key, n, payload, image: len(image),
    "media_sha256": lambda key, n, payload, image: hashlib.sha256(image).hexdigest(),
    "feature": lambda key, n, payload, image: feature(payload),
}


class MediaArchives(DataSource):
    """Format `media_archives`: folders of archives whose members are images of payloads.

    Writes key (string), n_bytes (long) and payload (binary, a multiple of WIDTH bytes). Reads any of the columns of
    TYPES that the schema given names, `key, n_bytes, payload, media` without one. Null keys stay null; keys, rows and
    payloads may repeat. A folder without archives has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "key string, n_bytes long, payload binary, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def store(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Write each row's text, padded, as an image in archives under path. A null text is an empty one."""
    docs.sparkSession.dataSource.register(MediaArchives)
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).cast("string").alias("key"), F.octet_length(raw).cast("long").alias("n_bytes"), padded(raw).alias("payload"))
    rows.write.format("media_archives").mode("append").save(path)


def op7(spark, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "media")
    store(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", path)
    columns = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    media = spark.read.format("media_archives").schema(columns).load(path)
    return media.select(F.col("key").cast("long").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
