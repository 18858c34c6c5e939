"""Shared folder, staged tables and other plumbing of the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is unset (single machine, tests) is a temporary folder used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="lexigrove-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: lineage ends here.

    Spark's commit protocol makes the write safe against lost executors and repeated tasks.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: So many keys of a few bytes are broadcast at most; beyond it, they are joined by shuffling.
BROADCAST_IDS = 2_000_000


def by_ids(rows: DataFrame, ids: DataFrame, on: list[str], how: str, most: int = BROADCAST_IDS) -> DataFrame:
    """Join with a staged table of small rows, which is broadcast if it has ``most`` rows at most."""
    return rows.join(F.broadcast(ids) if ids.count() <= most else ids, on, how)


def free_name(taken: list[str], name: str) -> str:
    """``name``, made longer until no column in ``taken`` has it (names do not differ by case alone)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: a Python worker outlives it, and so would its peak."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batch, column: int, most: int = 1 << 21, rows: int = 1024):
    """Slices of an Arrow batch with at most so many rows and, but for single rows, so many bytes in a string column: what a
    task turns into Python objects at once is bounded, however long the texts are."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def string_buffers(column):
    """Bytes and offsets of a string column without copying; nulls have no bytes."""
    import numpy as np
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    found = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(1, np.uint8)), found


def open_shared(url: str):
    """(file system, path) of a shared folder or file, for executors that read and write whole files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))
