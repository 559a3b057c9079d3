"""Shared plumbing: table access, shared-folder tables, Arrow text buffers, hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Text handled at once by vectorised code, in bytes; one longer text is handled alone.
SLICE_BYTES = 1 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches bound the Python workers' memory; workers find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on one machine, a folder is made, set, and deleted when the driver ends.

    On a cluster an unset folder is an error: what one executor writes to its own disk the others don't see.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
        folder = tempfile.mkdtemp(prefix="pitchlake-")
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; whatever is there when the driver ends is deleted then."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    p, fs = file_system(spark, path)
    fs.mkdirs(p)  # only what exists can be marked
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p, fs = file_system(df.sparkSession, f)
        fs.delete(p, True)


def bucketed(df: DataFrame, key: str, n: int, label: str) -> DataFrame:
    """df in files by n buckets of key, so that joins by key don't shuffle it. The files go when the driver ends, the catalogue's entry at once."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() * n > 20_000:  # each task writes a file per bucket
        df = df.repartition(n, key)
    name = f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).mode("append").option("compression", "zstd").option("path", scratch(spark, label)).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now: the plan keeps the files and their buckets, the catalogue needn't
    spark.sql(f"DROP TABLE {name}")
    return out


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(run: Run) -> Run:
    """run, which at the end of a task gives the worker's free memory back: idle workers stay, and stages follow one another.

    What this names of the module goes to the tasks by value, unless it is a function: no table may be among it, as
    PySpark writes functions of over 1 MB to the disk of the driver and of every executor, for each stage anew.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column one after another, and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        yield batch.slice(start)


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@lru_cache(4)
def byte_codes(seed: int, lower: bool = False) -> np.ndarray:
    """A random odd 64-bit code for each byte; with lower, A-Z have those of a-z."""
    codes = np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


#: Kept by a worker from task to task: some 21 MB for each base.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(n + 1, SLICE_BYTES + (SLICE_BYTES >> 2))
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        if n > 8 * SLICE_BYTES:
            return out[0], out[1]
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


#: Odd multipliers of the two rolling polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def prefix_sums(raw: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """Prefix sums from which spans() hashes any run of bytes."""
    acc = np.empty(len(raw) + 1, np.uint64)
    acc[0] = 0
    np.cumsum(byte_codes(71 + which, lower)[raw] * powers(BASES[which], len(raw))[0][: len(raw)], out=acc[1:])
    return acc


def spans(acc: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes from start to end."""
    inverse = powers(BASES[which], len(acc))[1]
    return mix((acc[end] - acc[start]) * inverse[start])


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def binary_column(blob: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows follow one another in blob."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    blob = np.ascontiguousarray(blob).tobytes() if isinstance(blob, np.ndarray) else blob
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(blob)])
