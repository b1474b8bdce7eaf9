"""What the operators of this subpackage share: shared storage, Arrow batches, word rules."""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import prepare

#: A text row is a few KB, and some are very long: Python workers take a batch in small slices, which bounds their memory.
ARROW_ROWS = 256
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session in one process (local mode, as in tests) gets a temporary folder; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(path)
    return path


class Tables:
    """A scope: tables written inside `with` belong to it, and release() deletes them (and no others)."""

    _open: list[Tables] = []

    def __init__(self):
        self.paths: dict[str, SparkSession] = {}

    def __enter__(self) -> Tables:
        Tables._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Tables._open.remove(self)

    def release(self) -> None:
        for path, spark in self.paths.items():
            _delete(path, spark)
        self.paths = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: the lineage is cut, and a lost executor loses nothing.

    The job's shuffle files go when it ends. free() deletes the table when it is used up; others stay until the scope
    that they were written in is released.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was) if was is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if Tables._open:
        Tables._open[-1].paths[path] = spark
    return out


def _delete(path: str, spark: SparkSession) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for frame in frames:
        _delete(frame._written, frame.sparkSession)
        for scope in Tables._open:
            scope.paths.pop(frame._written, None)


def whole(docs: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns, null texts as they are; extra columns of any name don't matter."""
    return docs.select(*[F.col(f"`{c}`") for c in cols])


def texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The texts of a batch as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def table_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, rows: int = ARROW_ROWS) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows."""
    prepare(df.sparkSession)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(batch.slice(i, rows) for batch in batches for i in range(0, batch.num_rows, rows))

    return df.mapInArrow(sliced, schema)


def bundle(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    out = []
    for x in arrays:
        data = zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1)
        out.append(struct.pack("<4sqq", x.dtype.str.encode(), len(x), len(data)) + data)
    return b"".join(out)


def unbundle(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<4sqq", data, at)
        at += 20
        kind = np.dtype(kind.rstrip(b"\0").decode())
        planes = np.frombuffer(zstandard.decompress(data[at : at + size]) if n else b"", np.uint8).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def ascii_lower(text):
    """Lower case for A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (public constants of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PRIMES = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: tuple = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def span_hashes(x: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [at, end) of x, never 0; equal bytes have equal hashes, wherever they stand."""
    global _powers
    if len(_powers[0]) < len(x):
        size = 1 << len(x).bit_length()
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)])) for p in _PRIMES)
    sums = np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(x)])
    h = (sums[end - 1] - np.where(at > 0, sums[at - 1], np.uint64(0))) * _powers[1][at]
    h = mix64(h + (end - at).astype(np.uint64) * _PRIMES[0])
    h[h == 0] = 1
    return h


def in_parts(data: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in lists of at most `most` bytes, as far as their own length lets."""
    part, size = [], 0
    for x in data:
        if part and size + len(x) > most:
            yield part
            part, size = [], 0
        part.append(x)
        size += len(x)
    if part:
        yield part
