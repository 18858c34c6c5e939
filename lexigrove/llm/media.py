"""Media columns: payloads stored as 8-bit samples in archives, read through a Spark data source.

A payload is a text's UTF-8 bytes and zeros up to a positive multiple of 64. It is stored as a grey-scale PNG of 8-bit
samples, 64 wide, which is lossless and compressed; a text chunk holds the unpadded length. The images of a task are
members of ZIP archives in one folder, stored without a second compression.

The data source ``lexigrove_media`` plans partitions from the archives' names and sizes alone: byte ranges, however many
members there are. They come from the manifest, which lists what finished tasks wrote, so that archives left by failed,
repeated or killed tasks are not read; only where no manifest is given is every archive in the folder read. A task reads its archive's directory (the ZIP central directory), takes the members whose offsets lie
in its range, and streams them in record batches; a member whose read or checksum fails is opened and read again by its
offset, up to ``ATTEMPTS`` times, without touching the others.

Defined results: null text is an empty one (64 zero bytes); rows that repeat an id are members of their own; a null id
stays null; an empty table gives no archive and an empty result; equal texts have equal payloads, images and features.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexigrove.llm.common import open_shared, shared_dir, staged

WIDTH, ATTEMPTS, LEVEL = 64, 3, 4
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 128 << 20, 8 << 20, 2 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def encoded(raw: bytes) -> bytes:
    """The PNG of a payload that is padded from ``raw``."""
    samples = np.frombuffer(padded(raw), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each line begins with its filter, none
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    length = b"Length\0" + str(len(raw)).encode()
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", length) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def decoded(image: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image made by ``encoded``; checks every chunk."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, chunks = 8, {}
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("a chunk's checksum differs")
        chunks[kind] = chunks.get(kind, b"") + data
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(-1, WIDTH + 1)
    return lines[:, 1:].tobytes(), int(chunks[b"tEXt"].partition(b"\0")[2])


def feature(payload: bytes) -> str:
    """Mean, deviation, rate of sign changes about the middle, and shares of 8 bands of the samples, as JSON."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 5, minlength=8) / len(x)
    high = x >= 128
    turns = np.count_nonzero(high[1:] != high[:-1]) / len(x)
    numbers = {"mean": float(x.mean(dtype=float)), "std": float(x.std(dtype=float)), "turns": turns}
    return json.dumps({k: round(v, 6) for k, v in numbers.items()} | {"bands": [round(float(b), 6) for b in bands]})


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a member for each row into archives in ``folder``; the manifest: (path, members, bytes)."""

    def write(batches):
        files, root = open_shared(folder)
        files.create_dir(root, recursive=True)
        out, path, members = None, "", 0

        def closed():
            size = sink.tell()
            out.close()
            sink.close()
            return pa.RecordBatch.from_pylist([{"path": path, "members": members, "bytes": size}])

        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
                if out is None:
                    path, members = f"{root}/{uuid.uuid4().hex}.zip", 0
                    sink = files.open_output_stream(path)
                    out = zipfile.ZipFile(_Forward(sink), "w", zipfile.ZIP_STORED)
                image = encoded(raw.to_pybytes() if raw is not None else b"")
                out.writestr(zipfile.ZipInfo(f"{members}/{'' if doc_id is None else doc_id}.png"), image)
                members += 1
                if sink.tell() >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    rows = docs.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return staged(rows.mapInArrow(write, "path string, members long, bytes long"), "media-manifest")


class _Forward:
    """A sink that only goes forward, as the zip writer wants it."""

    def __init__(self, sink):
        self.sink = sink

    def write(self, data) -> int:
        self.sink.write(data)
        return len(data)

    def flush(self) -> None:
        pass


class _Range(InputPartition):
    def __init__(self, path: str, size: int, begin: int, end: int):
        self.path, self.size, self.begin, self.end = path, size, begin, end


class MediaReader(DataSourceReader):
    def __init__(self, folder: str, span: int, archives: list[list] | None = None):
        self.folder, self.span, self.archives = folder, span, archives

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        found = self.archives
        if found is None:
            files, root = open_shared(self.folder)
            found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            found = sorted((x.path, x.size) for x in found if x.path.endswith(".zip"))
        return [_Range(p, n, a, min(n, a + self.span)) for p, n in found for a in range(0, n, self.span)]

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one task where there are no partitions
            return
        files, _ = open_shared(self.folder)
        with files.open_input_file(partition.path) as source:
            members = [x for x in zipfile.ZipFile(source).infolist() if partition.begin <= x.header_offset < partition.end]
        rows, size = [], 0
        for member in members:
            rows.append(self._row(files, partition.path, member))
            size += len(rows[-1]["payload"]) + len(rows[-1]["media"])
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    @staticmethod
    def _row(files, path: str, member: zipfile.ZipInfo) -> dict:
        for attempt in range(ATTEMPTS):
            try:
                image = read_member(files, path, member)
                payload, n = decoded(image)
                doc_id = member.filename.rpartition("/")[2].removesuffix(".png")
                return {"doc_id": int(doc_id) if doc_id else None, "n_bytes": n, "payload": payload, "media": image}
            except (OSError, ValueError, zlib.error):
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError


def read_member(files, path: str, member: zipfile.ZipInfo) -> bytes:
    """A stored member, opened anew and read at its own offset; its checksum is verified."""
    with files.open_input_file(path) as source:
        head = source.read_at(30, member.header_offset)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{path}: no member at {member.header_offset}")
        names = sum(struct.unpack_from("<HH", head, 26))
        data = source.read_at(member.file_size, member.header_offset + 30 + names)
    if zlib.crc32(data) != member.CRC:
        raise ValueError(f"{path}: {member.filename} has another checksum")
    return data


ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary())])


class MediaSource(DataSource):
    """``spark.read.format("lexigrove_media").option("range_bytes", n).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "lexigrove_media"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, payload binary, media binary"

    def reader(self, schema) -> MediaReader:
        archives = json.loads(self.options.get("archives", "null"))
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), archives)


def read_media(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """The members of the manifest's archives (a row for each, of about ``ARCHIVE_BYTES``), or of all in the folder."""
    spark.dataSource.register(MediaSource)
    source = spark.read.format("lexigrove_media")
    if manifest is not None:
        source = source.option("archives", json.dumps(sorted([r["path"], r["bytes"]] for r in manifest.select("path", "bytes").collect())))
    return source.load(folder)


def features(media: DataFrame) -> DataFrame:
    """Digests and features of what ``read_media`` gives."""

    @F.pandas_udf("string")
    def make(payloads: pd.Series) -> pd.Series:
        return payloads.map(feature)

    return media.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        make("payload").alias("feature"),
    )


def new_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "media")

