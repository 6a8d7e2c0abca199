"""Media columns: payloads stored as image members of archives, read back by a custom data source.

Writing: each task writes one ZIP archive of PNG members into a shared folder. A payload's bytes are the 8-bit grey samples
of an image 64 samples wide; PNG keeps them losslessly and deflated. The number of bytes before padding is in a text chunk
of the image, so the stored form depends on the payload alone; the row's id is in the member's name (as JSON, percent-encoded,
so ids can be of any integer or string type). A task without rows writes no archive.

Reading: the data source plans byte ranges over the archives from their sizes alone; a task opens the archive's directory,
takes the members that begin within its range, and streams Arrow batches. A directory or member that can't be read or fails its
checksum is read again on its own, a member by its offset; after `attempts` the task fails (and Spark tries it again), or with
`on_error=row` the member comes back with its error and no payload.

Defined results: a null text is empty; an empty text has 64 zero bytes; a null id is stored as such; repeated rows are
members of their own; an empty table or task has no archive; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import fresh_dir

WIDTH = 64
#: An archive of fewer bytes is read whole for its directory.
SMALL = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(data: bytes, level: int = 6) -> bytes:
    payload = padded(data)
    rows = len(payload) // WIDTH
    lines = b"".join(b"\0" + payload[i * WIDTH : (i + 1) * WIDTH] for i in range(rows))
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"bytes\0%d" % len(data)) + chunk(b"IDAT", zlib.compress(lines, level)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload, bytes before padding); a broken image raises ValueError."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, found, data = 8, {}, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"checksum of {kind!r}")
        data, found = (data + body if kind == b"IDAT" else data), found | {kind: body}
        at += 12 + n
    width, rows = struct.unpack(">II", found[b"IHDR"][:8])
    lines = zlib.decompress(data)
    if len(lines) != rows * (width + 1):
        raise ValueError("size of the samples")
    return b"".join(lines[i * (width + 1) + 1 : (i + 1) * (width + 1)] for i in range(rows)), int(found[b"tEXt"].split(b"\0")[1])


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy (bits) of the samples."""
    counts = [payload.count(bytes([b])) for b in set(payload)], sum(payload)
    n, mean = len(payload), counts[1] / len(payload)
    squares = sum(payload.count(bytes([b])) * b * b for b in set(payload)) / n
    entropy = -sum(c / n * math.log2(c / n) for c in sorted(counts[0]))
    return f"mean={mean:.3f};dev={math.sqrt(max(0.0, squares - mean * mean)):.3f};entropy={entropy:.3f}"


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes every row's text as a member; returns the number of members. A retried task overwrites its own archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (batch for batch in batches if len(batch))
        first = next(batches, None)
        if first is None:
            return
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"{path}/part-{context.partitionId():06d}"
        temporary, n = f"{name}.{context.taskAttemptId()}.tmp", 0
        with store.open_output_stream(temporary) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
            for batch in chain([first], batches):
                for key, text in zip(batch.column(0), batch.column(1)):
                    archive.writestr(zipfile.ZipInfo(member_name(n, key.as_py())), encode_png((text.as_py() or "").encode("utf-8", "surrogatepass")))
                    n += 1
        placed(store, temporary, f"{name}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def placed(store: pafs.FileSystem, temporary: str, name: str) -> None:
    """Moves an attempt's archive to its place. An earlier attempt's goes first: not every store's rename overwrites."""
    if store.get_file_info(name).type != pafs.FileType.NotFound:
        store.delete_file(name)
    store.move(temporary, name)


def member_name(n: int, key: int | str | None) -> str:
    return f"{n}/{quote(json.dumps(key), safe='')}.png"


def member_id(name: str) -> int | str | None:
    return json.loads(unquote(name.split("/")[-1][:-4]))


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", 32 << 20))
        self.attempts = int(options.get("attempts", 3))
        self.rows = int(options.get("batch_rows", 256))
        self.raises = options.get("on_error", "fail") != "row"
        self.id_type = pa.string() if options.get("id_type") == "string" else pa.int64()

    def partitions(self) -> list[InputPartition]:
        store, path = filesystem(self.folder)
        found = [f for f in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".zip")]
        return [ByteRange(f.path, at, min(f.size, at + self.range_bytes)) for f in sorted(found, key=lambda f: f.path) for at in range(0, f.size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def member(self, store: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> bytes:
        with store.open_input_file(path) as raw:
            head = raw.read_at(30, info.header_offset)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member at this offset")
            skip = 30 + sum(struct.unpack("<HH", head[26:30]))
            data = raw.read_at(info.compress_size, info.header_offset + skip)
        if zlib.crc32(data) != info.CRC:
            raise ValueError("checksum of the member")
        return data

    def tried(self, read: Callable[[], object]) -> object:
        """What `read` gives, after up to `attempts`; then its last error is raised."""
        for attempt in range(self.attempts):
            try:
                return read()
            except (OSError, ValueError, KeyError, struct.error, zlib.error, zipfile.BadZipFile):
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(0.05 * 2**attempt)

    def directory(self, store: pafs.FileSystem, path: str) -> list[zipfile.ZipInfo]:
        with store.open_input_file(path) as raw:
            return zipfile.ZipFile(io.BytesIO(raw.read()) if raw.size() < SMALL else raw).infolist()

    def row(self, store: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> tuple:
        key = member_id(info.filename)

        def read() -> tuple:
            media = self.member(store, path, info)
            payload, n = decode_png(media)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return key, n, len(payload), sha(payload), zlib.crc32(payload[-WIDTH:]), len(media), sha(media), feature(payload), None

        try:
            return self.tried(read)
        except (OSError, ValueError, KeyError, struct.error, zlib.error) as error:
            if self.raises:
                raise OSError(f"{path} at {info.header_offset}: {error}") from error
            return key, *[None] * 7, f"{info.header_offset}: {error}"

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = filesystem(self.folder)
        directory = self.tried(lambda: self.directory(store, partition.path))
        kinds = [self.id_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 3
        names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]
        rows: list[tuple] = []
        for info in directory:
            if partition.start <= info.header_offset < partition.stop:
                rows.append(self.row(store, partition.path, info))
                if len(rows) >= self.rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder); the option id_type is long or string."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return f"doc_id {'string' if self.options.get('id_type') == 'string' else 'long'}, {FIELDS}"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def media_columns(spark: SparkSession, docs: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or fresh_dir(spark, "media")
    write_archives(docs, folder)
    spark.dataSource.register(MediaArchives)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return spark.read.format("media_archives").option("path", folder).option("id_type", "string" if kind == "string" else "long").load()


def op2_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
