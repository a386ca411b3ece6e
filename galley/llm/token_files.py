"""Token-id files of independent zstandard frames with a trailing seek table.

One file holds the ids of a range of documents, in ascending doc_id order:

* a frame for each document: its ids as little-endian unsigned 32-bit integers, with
  the frame's own content checksum;
* a skippable frame with the documents' ids (64-bit) and the files' layout version;
* the seek table of the zstandard seekable format, itself a skippable frame: compressed
  size, size and checksum (low 32 bits of XXH64) of each frame, and a footer.

A reader loads the table, and then seeks to and inflates the frames that it wants only.

A null text is empty and holds the end id alone. Null doc_ids sort first and come back
null; repeated rows are kept, each with its own frame; rows with one doc_id are in order of a
hash of their text. Extra columns are ignored. An empty table makes no file and gives an empty
table. ``write`` runs jobs and makes files when it is called, not when its result is read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pretokens import PieceCache, binaries

# Fixed values of the zstandard and seekable formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_FOOTER = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

VERSION = 1
#: Stands for a null doc_id in a file.
NULL_ID = -(1 << 63)
END_ID = 0
#: Bytes of text in one file, at least where there are many.
TEXT_BYTES = 64 << 20


class BadFile(ValueError):
    """A file is cut short or a checksum fails."""


class Encoder:
    """Encodes with a tokenizers file; pieces that come again aren't encoded again.

    The library splits a text into pieces and encodes each by itself, so the ids of a
    text are those of its pieces. Pieces go to the library many at once, a line each: a
    line feed before or after a piece without one is always a piece of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # as the library does, texts are cut at added tokens before they are split into pieces
        self.added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        longest = sorted(self.added, key=lambda t: (-len(t), t))
        self.cut = re.compile(b"(" + (b"|".join(map(re.escape, longest)) or b"(?!)") + b")")
        (self.line_feed,) = self._ids(["\n"])[0]
        self.cache = PieceCache(self.encode_pieces)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and the number of ids of each."""
        cut = [self.cut.split(t) for t in texts]  # every second part is an added token
        parts = [p for c in cut for p in c[::2]]
        ids, counts = self.cache.texts(parts)
        if len(parts) == len(texts):
            return ids, counts
        end, k, out, n = np.cumsum(counts), 0, [], np.zeros(len(texts), np.int64)
        for i, c in enumerate(cut):
            for j, p in enumerate(c):
                if j % 2:
                    out.append(np.array([self.added[p]], np.uint32))
                else:
                    out.append(ids[end[k] - counts[k] : end[k]])
                    k += 1
                n[i] += len(out[-1])
        return np.concatenate(out), n

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in parts]
        lined = np.array([p == p.rstrip() and not p[1:2].isspace() and p != "" for p in texts], bool)
        lines = [p for p, own in zip(texts, lined.tolist(), strict=True) if own]
        single = self._ids([p for p, own in zip(texts, lined.tolist(), strict=True) if not own])
        coded = self._ids(["".join([f"{p}\n" for p in lines[i : i + 500]]) for i in range(0, len(lines), 500)])
        flat = np.concatenate(coded) if coded else np.zeros(0, np.uint32)
        feed = flat == self.line_feed
        end = np.flatnonzero(feed)
        counts = np.empty(len(parts), np.int64)
        counts[lined] = np.diff(end, prepend=-1) - 1
        counts[~lined] = [len(x) for x in single]
        out = np.empty(int(counts.sum()), np.uint32)
        own = np.repeat(lined, counts)
        out[own] = flat[~feed]
        out[~own] = np.concatenate([np.zeros(0, np.uint32), *single])
        return out, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Writes one file; it appears under its name only when complete."""

    def __init__(self, path: str, level: int = 3):
        self.path, self.temporary = path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.out = common.open_file(self.temporary, "wb")
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries, self.ids = bytearray(), []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        self.out.write(frame)
        self.entries += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.ids.append(NULL_ID if doc_id is None else doc_id)

    def close(self) -> None:
        index = struct.pack("<I", VERSION) + np.array(self.ids, "<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        body = bytes(self.entries) + struct.pack("<III", 8 + len(index), 0, 0)
        footer = struct.pack("<IBI", len(body) // 12, HAS_CHECKSUMS, SEEKABLE_FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body) + len(footer)) + body + footer)
        self.out.close()
        common.rename_file(self.temporary, self.path)


class Reader:
    """Reads documents of one file by their place in it."""

    def __init__(self, path: str):
        self.file = common.open_file(path, "rb")
        self.file.seek(0, 2)
        length = self.file.tell()
        if length < 17:
            raise BadFile(path)
        n, flags, magic = struct.unpack("<IBI", self._at(length - 9, 9))
        start = length - 9 - 12 * n - 8
        if magic != SEEKABLE_FOOTER or flags != HAS_CHECKSUMS or n < 1 or start < 0:
            raise BadFile(path)
        head = self._at(start, 8 + 12 * n)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE_TABLE, 12 * n + 9):
            raise BadFile(path)
        table = np.frombuffer(head, "<u4", offset=8).reshape(n, 3).astype(np.int64)
        self.packed, self.sizes, self.checks = table[:-1].T
        self.offsets = np.concatenate([[0], np.cumsum(self.packed)]).astype(np.int64)
        index = self._at(int(self.offsets[-1]), int(table[-1, 0]))
        if struct.unpack_from("<I", index)[0] != SKIPPABLE_INDEX or struct.unpack_from("<I", index, 8)[0] != VERSION:
            raise BadFile(path)
        self.doc_ids = np.frombuffer(index, "<i8", offset=12)
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(size)
        if len(data) != size:
            raise BadFile("cut short")
        return data

    def __len__(self) -> int:
        return len(self.doc_ids)

    def read(self, i: int) -> np.ndarray:
        """The ids of the i-th document; inflates its frame only."""
        try:
            ids = self.unpack.decompress(self._at(int(self.offsets[i]), int(self.packed[i])), max_output_size=int(self.sizes[i]))
        except zstandard.ZstdError as e:
            raise BadFile(str(e)) from e
        if len(ids) != self.sizes[i] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.checks[i]:
            raise BadFile("checksum")
        return np.frombuffer(ids, "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all documents with this doc_id."""
        first, last = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])
        return [self.read(i) for i in range(first, last)]

    def close(self) -> None:
        self.file.close()


@dataclass
class TokenFiles:
    """The files that one ``write`` made. manifest: file, part (its place among them), first_id, last_id, n_docs, n_tokens of each."""

    spark: SparkSession
    manifest: DataFrame

    def documents(self) -> DataFrame:
        """doc_id, start, ids (binary) of every document, read from the files, one task for each file."""
        # a row for each file: some thousands a terabyte
        bases = self.manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, start in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                    reader, rows = Reader(path), []
                    for i in range(len(reader)):
                        ids = reader.read(i)
                        doc_id = int(reader.doc_ids[i])
                        rows.append((None if doc_id == NULL_ID else doc_id, start, ids.tobytes()))
                        start += len(ids)
                        if len(rows) == 500:
                            yield common.batch(schema, list(zip(*rows, strict=True)))
                            rows = []
                    reader.close()
                    if rows:
                        yield common.batch(schema, list(zip(*rows, strict=True)))

        files = max(1, self.manifest.count())
        return bases.select("file", "base").repartition(files, "file").mapInArrow(run, "doc_id long, start long, ids binary")

    def lookup(self, doc_ids: list[int]) -> dict[int, list[np.ndarray]]:
        """The ids of a few documents; opens only the files whose range holds them."""
        out: dict[int, list[np.ndarray]] = {d: [] for d in doc_ids}
        if not doc_ids:
            return out
        held = self.manifest.where((F.col("first_id") <= max(doc_ids)) & (F.col("last_id") >= min(doc_ids)))
        for row in held.orderBy("part").collect():
            wanted = [d for d in out if row.first_id <= d <= row.last_id]
            if wanted:
                reader = Reader(row.file)
                for d in wanted:
                    out[d] += reader.find(d)
                reader.close()
        return out


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID, text_bytes: int = TEXT_BYTES) -> TokenFiles:
    """Encodes texts with a tokenizers file and writes them in ascending doc_id order.

    The documents are dealt out by ranges of doc_id, and each range becomes a file: one for
    about ``text_bytes`` of text, and as many as the session has shuffle partitions at least.
    Rows with one doc_id may lie in several files. An attempt that is lost leaves a file that
    no manifest names.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    folder = common.new_path(spark, "tokens")
    names = ("part", "first_id", "last_id", "n_docs", "n_tokens")
    schema = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in names)])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, tokens, part = encoder(path), None, 0, TaskContext.get().partitionId()
        name = f"{folder}/{uuid.uuid4().hex}.ids.zst"
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for doc_id, coded in zip(ids, binaries(*coder.texts(common.as_bytes(b.column("text")))), strict=True):
                writer = writer or Writer(name)
                writer.add(doc_id, coded + end)
                tokens += len(coded) // 4 + 1
        if writer:
            writer.close()
            yield common.batch(schema, [[name], [part], [writer.ids[0]], [writer.ids[-1]], [len(writer.ids)], [tokens]])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // text_bytes))
    # a doc_id may be that of a third of all rows, and so may a text under it
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order, F.rand(1)).sortWithinPartitions(*order)
    manifest = common.stored(ordered.mapInArrow(run, "file string, " + ", ".join(f"{x} long" for x in names)), "token-manifest")
    return TokenFiles(spark, manifest)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """Encodes and writes every document, then digests what the files hold."""
    files = write(common.table(spark, sf_dir, "documents"))
    return files.documents().select("doc_id", "start", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
