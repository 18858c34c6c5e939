"""WARC archives whose records are Zstandard frames with a dictionary of their own archive.

Layout of a file: a skippable frame (magic 0x184D2A5D) with the dictionary, then one frame for each record, compressed
with it, so that any record can be read on its own given its offset. The dictionary is trained on the first
``SAMPLE_BYTES`` of the archive's records, which arrive in the order of a digest; where that gives none (few or equal
records) the sample itself is the dictionary.

A payload that several records share is stored once: the record with the largest page id is a ``response``, others are
``revisit`` records, which name it and repeat length and digest, but have no payload.

Defined results: a null html is an empty payload; rows with the same id and payload as the response are responses too;
a null page id is smaller than any other and is kept as null; a null url gives a record without a target; an empty table
gives no archive and an empty result. Writes go to names of their own and the manifest lists what finished tasks wrote,
so a lost executor or a repeated task leaves no trace in the result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.common import open_shared, shared_dir, staged

MAGIC = 0x184D2A5D
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1 << 20, 1 << 15, 3
#: About so many payload bytes go into one archive.
ARCHIVE_BYTES = 256 << 20


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def record(page_id, url, payload: bytes, digest: str, length: int, refers_to) -> bytes:
    """An uncompressed WARC record. ``refers_to``: the response's id, for a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("X-Payload-Length", str(length)),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        fields += [
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}')}>"),
            ("X-Refers-To-Page-ID", str(refers_to)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    fields.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record; checks its length and block digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if "sha1:" + base32(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
        raise ValueError("block digest differs")
    return fields, block


def dictionary(samples: list[bytes]):
    import zstandard as z

    if sum(map(len, samples)) >= 16 * DICTIONARY_BYTES and len(samples) >= 16:
        try:
            return z.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
        except z.ZstdError:  # too few or too equal
            pass
    return z.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b" "), dict_type=z.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes one archive. Records wait until the sample is full; then the dictionary and they go out."""

    def __init__(self, sink):
        self.sink, self.waiting, self.size, self.frames = sink, [], 0, None
        self.records = self.bytes = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.frames is None:
            self.waiting.append(data)
            self.size += len(data)
            if self.size >= SAMPLE_BYTES:
                self.start()
        else:
            self._put(self.frames.compress(data))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def start(self) -> None:
        import zstandard as z

        made = dictionary(self.waiting)
        raw = made.as_bytes()
        self._put(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.frames = z.ZstdCompressor(level=LEVEL, dict_data=made)
        for data in self.waiting:
            self._put(self.frames.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.frames is None:
            self.start()
        self.sink.close()


def read_archive(source) -> Iterator[bytes]:
    """The records of an open archive, one frame at a time."""
    import zstandard as z

    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("the archive has no dictionary frame")
    raw = source.read(size)
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    known = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT)
    frames, rest = z.ZstdDecompressor(dict_data=known), b""
    frame, parts = frames.decompressobj(), []
    while True:
        data = rest or source.read(1 << 18)
        if not data:
            if parts:
                raise ValueError("the last record is cut off")
            return
        parts.append(frame.decompress(data))
        rest = b""
        if frame.eof:
            rest = frame.unused_data
            yield b"".join(parts)
            frame, parts = frames.decompressobj(), []


def with_responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, keep): ``keep`` is the id of the response for the payload, if it is shared.

    Only ids and digests are grouped, and only shared digests are joined; a hot digest's rows can be split.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    shared = rows.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    return rows.join(shared.where("n > 1").drop("n"), "sha1", "left").select("page_id", "url", "payload", "sha1", "keep")


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into archives; the manifest: (path, records, bytes)."""
    folder = folder or shared_dir(pages.sparkSession, "warc")

    def write(batches):
        files, root = open_shared(folder)
        files.create_dir(root, recursive=True)
        out, written = None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, sha1, keep = (batch.column(c)[i].as_py() for c in range(5))
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, written = ArchiveWriter(files.open_output_stream(path)), 0
                first = keep is None or keep == page_id
                out.add(record(page_id, url, payload if first else b"", base32(bytes.fromhex(sha1)), len(payload), None if first else keep))
                written += len(payload)
                if written >= ARCHIVE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": out.records, "bytes": out.bytes}])
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": out.records, "bytes": out.bytes}])

    return staged(with_responses(pages, min_bytes).mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of every record; payload null for revisits."""
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(path, files, count):
        seen = 0
        with files.open_input_stream(path) as source:
            for data in read_archive(source):
                fields, block = parsed(data)
                seen += 1
                own = lambda k: int(fields[k]) if k in fields else None  # noqa: B023,E731
                digest, size, payload = fields["warc-payload-digest"].removeprefix("sha1:"), own("x-payload-length"), None
                if fields["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if base32(hashlib.sha1(payload).digest()) != digest or len(payload) != size:
                        raise ValueError(f"{path}: payload digest differs")
                yield own("x-page-id"), fields.get("warc-target-uri"), fields["warc-type"], digest, size, own("x-refers-to-page-id"), payload
        if seen != count:
            raise ValueError(f"{path}: {seen} records, the manifest has {count}")

    def read(batches):
        files, _ = open_shared(folder)
        for batch in batches:
            for path, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block, size = [], 0
                for row in rows(path, files, count):
                    block.append(row)
                    size += len(row[-1] or b"") + 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in block], schema=kinds)
                        block, size = [], 0
                if block:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in block], schema=kinds)

    text, whole = pa.string(), pa.int64()
    kinds = pa.schema(list(zip(names, [whole, text, text, text, whole, whole, pa.binary()], strict=True)))
    # with a number, so that a small manifest is not put together into one task
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.count() // 16)
    return manifest.select("path", "records").repartition(tasks, "path").mapInArrow(read, schema)

