"""What the operators share: staged tables, table access, and word arrays over Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_BYTES = 2 << 20  # text that one round of numpy arrays covers; a longer text makes a round of its own
_scratches: list[list[str]] = []  # paths made inside the open ``scratch`` blocks
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read columns of a standard table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package, and bound the bytes of a batch, so that long texts come in small ones."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * BATCH_BYTES))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder, deleted when the application ends."""
    prepare(spark)
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, target = _files(spark, path)
    files.deleteOnExit(target)
    if _scratches:
        _scratches[-1].append(path)
    return path


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def drop(spark: SparkSession, path: str) -> None:
    """Delete a shared path that nothing reads any more."""
    files, target = _files(spark, path)
    files.delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the shared paths made inside when it ends; what is to stay must be written to a path made before."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            drop(spark, path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Compute a table once into the shared folder and go on from its files: any executor can read them again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """The shared folder as the workers' file system shows it; memory mapping and flat files need such a mount."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"a shared folder mounted on every machine is needed, not {path}")
    return parsed.path


def save_array(path: str, values: np.ndarray) -> None:
    """Write an array so that a repeated task attempt replaces it whole."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(np.ascontiguousarray(values).data)
    os.replace(part, path)


def load_array(path: str, dtype) -> np.ndarray:
    """Memory-map an array; an empty file gives an empty array."""
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows with about BATCH_BYTES of text; nulls count as empty."""
    texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BATCH_BYTES:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(text)
    if len(texts) > start:
        yield batch.slice(start), texts[start:]


class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of several texts as arrays: ``hashes``, and ``first[i]:first[i + 1]`` of text i."""

    def __init__(self, texts: list[bytes], lower: bool):
        joined = b" " + b" ".join(texts) + b" " * 9
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        inside = ~_SPACES[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([1], 1 + np.cumsum(sizes + 1)))
        self.first = np.searchsorted(starts, begins)
        self.hashes = hash_spans(data, starts, ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time; ``data`` needs eight spare bytes at its end."""
    eights = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, done = np.arange(len(starts)), 0
    while len(live):
        left = lengths[live] - done
        loaded = eights[starts[live] + done]
        cut = (8 - np.minimum(left, 8)).astype(np.uint64) << np.uint64(3)
        hashes[live] = mix(hashes[live] ^ (loaded << cut))
        done += 8
        live = live[left > 8]
    return hashes


@dataclass(frozen=True)
class HashSet:
    """64-bit values as sorted arrays in the shared folder, cut into parts by remainder."""

    folder: str
    parts: int

    def reader(self) -> list[np.ndarray]:
        return [load_array(f"{self.folder}/{p:06d}", np.int64) for p in range(self.parts)]

    def contains(self, reader: list[np.ndarray], values: np.ndarray) -> np.ndarray:
        found = np.zeros(len(values), bool)
        for p in np.unique(values % self.parts).tolist():
            table, own = reader[p], np.flatnonzero(values % self.parts == p)
            if len(table):
                at = np.minimum(np.searchsorted(table, values[own]), len(table) - 1)
                found[own] = table[at] == values[own]
        return found


def hash_set(df: DataFrame, column: str, name: str, part_rows: int = 4_000_000) -> HashSet:
    """Write the distinct values of a long column as a set that tasks can map; tables of any size are cut into parts."""
    spark = df.sparkSession
    values = keep(df.select(F.col(column).alias("value")).distinct(), name)
    parts = max(1, -(-values.count() // part_rows))
    made = HashSet(mounted(shared_path(spark, name)), parts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), *(b.column("value").to_numpy() for b in batches)]
        everything = np.sort(np.concatenate(held))
        for p in np.unique(everything % parts).tolist():
            save_array(f"{made.folder}/{p:06d}", everything[everything % parts == p])
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32())], ["part"])

    written = values.repartitionById(parts, F.pmod("value", F.lit(parts)).cast("int")).mapInArrow(write, "part int").collect()
    for p in set(range(parts)) - {r.part for r in written}:
        save_array(f"{made.folder}/{p:06d}", np.zeros(0, np.int64))
    return made
