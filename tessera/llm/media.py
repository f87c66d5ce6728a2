"""Media columns: archives of images in a folder, written and read by a data source of their own.

``spark.read.format("media_archive").load(folder)`` plans byte ranges over the archives; a task takes the
members that begin in its range, reads each one by its offset and retries it alone, and streams what it
decoded through Arrow. The stored form of a payload is a PNG: 8-bit grey samples, 64 to a row, lossless.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.llm.shared import scratch, small_batches

FORMAT = "media_archive"
WIDTH = 64
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
RETRIES = 3
MANIFEST = "_archives.json"
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = (
    "archive string, member string, offset long, key string, n_bytes long, payload binary, "
    "media_bytes long, media_sha256 string, feature string, error string"
)


def payload_of(content: bytes) -> bytes:
    """``content`` with bytes 0 up to a positive multiple of the row width."""
    return content + bytes(max(WIDTH, -(-len(content) // WIDTH) * WIDTH) - len(content))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


#: Longest key that the comment of an archive's member holds.
COMMENT_BYTES = 65_534


def encode_png(content: bytes, key: bytes = b"") -> bytes:
    """The image whose samples are ``content``'s payload; its length stands in a text chunk, and so does a ``key`` if there is one."""
    rows = np.frombuffer(payload_of(content), np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row after its filter type, 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"".join([
        SIGNATURE, _chunk(b"IHDR", head), _chunk(b"tEXt", b"Length\0" + str(len(content)).encode()),
        *([_chunk(b"tEXt", b"Key\0" + key)] if key else []), _chunk(b"IDAT", zlib.compress(raw, 6)), _chunk(b"IEND", b""),
    ])


def decode_png(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (rows x width) of an image that ``encode_png`` made, and the content's length; ValueError for others."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, parts, shape, length = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (width, depth, colour, interlaced) != (WIDTH, 8, 0, 0):
                raise ValueError("other samples than 8-bit grey")
            shape = height, width + 1
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape)
    if raw[:, 0].any():
        raise ValueError("a row filter that is not written here")
    return np.ascontiguousarray(raw[:, 1:]), length


def key_of(data: bytes) -> str | None:
    """The key in an image's text chunk."""
    at = 8
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"tEXt" and data[at + 8 : at + 12] == b"Key\0":
            return data[at + 12 : at + 8 + size].decode("utf-8", "surrogatepass")
        at += 12 + size
    return None


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits and mean step between neighbours of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts[counts > 0] / samples.size
    flat = samples.ravel().astype(np.int16)
    values = np.arange(256)
    mean = (counts * values).sum() / samples.size
    deviation = np.sqrt(max(0.0, (counts * values * values).sum() / samples.size - mean * mean))
    return f"mean={mean:.4f};std={deviation:.4f};entropy={abs(-(share * np.log2(share)).sum()):.4f};step={np.abs(np.diff(flat)).mean():.4f}"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    archives: list[tuple[str, int]]


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (key string, content binary) into archives; only those of committed tasks are named in the manifest."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        made: list[tuple[str, int]] = []
        archive = out = None
        seen = 0
        for batch in iterator:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    out = store.open_output_stream(f"{folder}/{name}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                member = zipfile.ZipInfo(f"{seen:08d}.png")
                raw = None if key is None else key.encode("utf-8", "surrogatepass")
                long = raw is not None and len(raw) > COMMENT_BYTES  # such a key goes into the image
                member.comment = b"" if raw is None else b"+" if long else b"=" + raw  # the key, as it is
                archive.writestr(member, encode_png(content or b"", raw if long else b""))
                seen += 1
                if out.tell() >= ARCHIVE_BYTES:
                    archive.close()
                    made.append((name, out.tell()))
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            made.append((name, out.tell()))
            out.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        found = []
        if store.get_file_info(f"{folder}/{MANIFEST}").type == pafs.FileType.File:
            with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
                found = json.loads(f.read())
        with store.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps([*found, *(a for m in messages if m for a in m.archives)]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        for name, _ in (a for m in messages if m for a in m.archives):
            store.delete_file(f"{folder}/{name}")


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int, retries: int, schema) -> None:
        self.path, self.split, self.retries, self.kind = path, split, retries, schema

    def partitions(self) -> list[Range]:
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
            archives = json.loads(f.read())
        found = [Range(name, at, min(at + self.split, size)) for name, size in archives for at in range(0, size, self.split)]
        return found or [Range("", 0, 0)]

    def _member(self, store, path: str, info: zipfile.ZipInfo) -> bytes:
        """The member's bytes, read by its offset."""
        with store.open_input_file(path) as f:
            f.seek(info.header_offset)
            head = f.read(30)
            if len(head) < 30 or head[:4] != b"PK\x03\x04":
                raise OSError("no member begins here")
            name, extra = struct.unpack_from("<HH", head, 26)
            f.seek(info.header_offset + 30 + name + extra)
            data = f.read(info.compress_size)
        if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
            raise OSError("the member's bytes are cut or damaged")
        return data

    def _row(self, store, path: str, info: zipfile.ZipInfo) -> tuple:
        key = info.comment[1:].decode("utf-8", "surrogatepass") if info.comment[:1] == b"=" else None
        for left in range(self.retries, -1, -1):
            try:
                data = self._member(store, path, info)
                samples, length = decode_png(data)
                key = key_of(data) if info.comment == b"+" else key
                return key, length, samples.tobytes(), len(data), hashlib.sha256(data).hexdigest(), features(samples), None
            except (OSError, ValueError, TypeError, struct.error, zlib.error) as e:
                why = f"{type(e).__name__}: {e}"
                if left and isinstance(e, OSError):
                    time.sleep(0.05 * (self.retries - left))
        return key, None, None, None, None, None, why

    def read(self, part: Range):
        from pyspark.sql.pandas.types import to_arrow_schema

        if not part.archive:
            return
        schema, (store, folder) = to_arrow_schema(self.kind), _store(self.path)
        path = f"{folder}/{part.archive}"
        with store.open_input_file(path) as f:
            infos = [i for i in zipfile.ZipFile(f).infolist() if part.start <= i.header_offset < part.end]
        rows: list[tuple] = []
        size = 0
        for info in infos:
            row = (part.archive, info.filename, info.header_offset, *self._row(store, path, info))
            rows.append(row)
            size += len(row[5] or b"")
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class MediaArchive(DataSource):
    """Options: path; splitBytes (of a partition's range); retries (of a member)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), int(self.options.get("retries", RETRIES)), schema)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_media(rows: DataFrame, key_col: str, text_col: str, path: str) -> None:
    """Adds the texts (null: empty), as UTF-8, to the archives in ``path``."""
    rows.sparkSession.dataSource.register(MediaArchive)
    small_batches(rows.sparkSession)
    rows.select(F.col(key_col).cast("string").alias("key"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("content")).write.format(FORMAT).mode("append").save(path)


def read_media(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, retries: int = RETRIES) -> DataFrame:
    """Members of the archives in ``path``; one that stays unreadable has nulls and ``error``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format(FORMAT).option("splitBytes", split_bytes).option("retries", retries).load(path)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's text stored as media in the shared folder, read back and described.

    Null ids come back null, repeated rows each for themselves, null and empty texts as one row of zeros;
    an empty table gives no rows. A member that cannot be read fails the query.
    """
    path = scratch(docs.sparkSession, "media")
    write_media(docs, id_col, text_col, path)
    read = read_media(docs.sparkSession, path)
    ok = read.withColumn("payload", F.when(F.col("error").isNull(), F.col("payload")).otherwise(F.raise_error(F.concat("archive", F.lit(" "), "member", F.lit(": "), "error"))))
    return ok.withColumn(id_col, F.col("key").cast(docs.schema[id_col].dataType)).select(id_col, "n_bytes", "payload", "media_bytes", "media_sha256", "feature", "archive", "offset")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    size = F.length("payload").cast("long")
    return media.select(
        id_col, "n_bytes", size.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), F.lit(-64), F.lit(64))).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
