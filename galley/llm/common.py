"""Helpers that several operators of this subpackage share.

Texts travel as Arrow batches. A batch is cut into chunks of about ``CHUNK``
bytes (never inside a text), and a chunk is handled as one byte array with a
single space after every text, so no word can span two texts.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at once in a Python worker.
CHUNK = 1 << 18
#: Bytes of an Arrow batch, so that a batch of very long texts stays small.
ARROW_BYTES = 8 << 20
#: Settings of the workers' allocators.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def prepare(spark: SparkSession) -> None:
    """Lets workers import this package and bounds the size of Arrow batches."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    # large arrays of workers go back to the system as soon as they are freed
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where it is unset a session in one process (a test) gets a folder of its own; a
    cluster raises, since its machines share no local folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='galley-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/galley-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a path of the shared folder, and the path there; one that Arrow doesn't know raises."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


def open_file(path: str, mode: str):
    """Opens a file of the shared folder for binary reading ("rb") or writing ("wb")."""
    fs, inner = _file_system(path)
    if mode == "rb":
        return fs.open_input_file(inner)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    return fs.open_output_stream(inner)


def rename_file(old: str, new: str) -> None:
    fs, inner = _file_system(old)
    fs.move(inner, _file_system(new)[1])


def read_parquet(path: str, columns: list[str]) -> pa.Table:
    """The rows of a Parquet folder in the shared folder; none if the folder isn't there."""
    fs, inner = _file_system(path)
    found = fs.get_file_info(pa.fs.FileSelector(inner, allow_not_found=True))
    files = sorted(f.path for f in found if f.path.endswith(".parquet"))
    if not files:
        return pa.table({c: pa.array([], pa.string()) for c in columns})
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=fs, partitioning=None) for f in files])


def as_bytes(column) -> list[bytes]:
    """A string column's values as UTF-8; null becomes empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds (first, last) of runs of texts of about ``most`` bytes, or one longer text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table: which of the 256 bytes lie in one of the ranges (ends included)."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of texts whose A-Z are lower-cased.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Maps A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93


class Words:
    """Words of a chunk of texts.

    data: the bytes, a space after each text; start, end: bounds of each word in
    data; first: index of each text's first word, and at last the number of words.
    """

    def __init__(self, texts: list[bytes], inside: np.ndarray):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.text_end = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text_start = np.concatenate([[0], self.text_end[:-1]]).astype(np.int64)
        word = inside[self.data]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.inside = word
        self.first = np.searchsorted(self.start, np.concatenate([self.text_start, [len(self.data)]]))

    def __len__(self) -> int:
        return len(self.start)

    def joined(self, fold: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and each word's bounds there."""
        keep = self.inside.copy()
        keep[self.end] = True
        data = self.data if fold is None else fold[self.data]
        out = np.where(self.inside, data, np.uint8(32))[keep]
        size = self.end - self.start
        end = np.cumsum(size + 1) - 1
        return out.tobytes(), end - size, end

    def hashes(self, seed: int, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(loads(self.data if fold is None else fold[self.data]), self.start, self.end, seed)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MUL
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def loads(data: np.ndarray) -> np.ndarray:
    """At each place of a byte array the eight bytes from there on, as one number; zeros follow the array."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


#: Keeps the first 0 .. 8 bytes of a number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Spans up to so many bytes are hashed and compared by numpy, eight bytes at a time; longer ones one by one.
SHORT = 64


def span_hashes(eights: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; eights: as ``loads`` gives them.

    It spreads words well but isn't proof against chosen ones: whoever needs equal bytes compares them.
    """
    size = end - start
    h = mixed((eights[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _MUL + np.uint64(seed))
    live, at = np.flatnonzero((size > 8) & (size <= SHORT)), 8
    while len(live):
        left = size[live] - at
        h[live] = mixed(h[live] * np.uint64(_ODD) ^ (eights[start[live] + at] & _FIRST[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    data = None
    for i in np.flatnonzero(size > SHORT).tolist():
        data = memoryview(eights.base) if data is None else data
        h[i] = int.from_bytes(hashlib.blake2b(data[int(start[i]) : int(end[i])], digest_size=8, salt=seed.to_bytes(16, "little")).digest(), "little")
    return h


def spans_equal(eights: np.ndarray, start: np.ndarray, size: np.ndarray, others: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether pairs of spans hold the same bytes; the second ones: in ``others``."""
    same = size == sizes
    for i in np.flatnonzero(same & (size > 16 * SHORT)).tolist():
        one, other = memoryview(eights.base)[int(start[i]) :], memoryview(others.base)[int(at[i]) :]
        same[i] = one[: int(size[i])] == other[: int(size[i])]
    live, k = np.flatnonzero(same & (size <= 16 * SHORT)), 0
    while len(live):
        left = size[live] - k
        same[live] = ((eights[start[live] + k] ^ others[at[live] + k]) & _FIRST[np.clip(left, 0, 8)]) == 0
        live, k = live[(left > 8) & same[live]], k + 8
    return same


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes, at the run's first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * np.uint64(_ODD) + words[j : j + n]
    return mixed(out)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def plain(column) -> pa.Array:
    """A batch's column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
