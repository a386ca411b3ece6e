"""PNG media columns.

``store`` turns texts into 8-bit greyscale PNG files in a binary column, 64
samples a row; ``features`` reads such files back (chunk by chunk with CRC tests,
inflated and unfiltered with numpy) and derives a perceptual hash from the low
frequencies of a cosine transform.

A null or empty text is one row of 64 zero samples. Texts of any length work: the
number of rows grows. Equal texts give equal files. Null doc_ids and repeated rows are
kept as they are. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Side of the picture that is transformed and of the corner of low frequencies that is kept.
SIDE, CORNER = 32, 8
_COSINE = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5) * np.arange(CORNER)[:, None])


class BadPicture(ValueError):
    """The bytes aren't a PNG file of the supported kind, or a checksum fails."""


def payload(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(samples: bytes, level: int = 4) -> bytes:
    """An 8-bit greyscale PNG, 64 samples a row; all rows with the filter (none, sub or up) that leaves the least differences."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    sub = rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    forms = {0: rows, 1: sub, 2: up}
    # text compresses best unfiltered unless differences are very small
    cost = {k: int(np.abs(f.view(np.int8).astype(np.int16)).sum()) for k, f in forms.items()}
    best = min((1, 2), key=cost.get)
    best = best if 4 * cost[best] < cost[0] else 0
    raw = np.empty((len(rows), WIDTH + 1), np.uint8)
    raw[:, 0] = best
    raw[:, 1:] = forms[best]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray) -> np.ndarray:
    """Undoes the filter of each row; runs of rows with filter none, sub or up at once."""
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    bounds = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *bounds], [*bounds, len(raw)], strict=True):
        kind = kinds[a]
        if kind == 1:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == 2:
            if a:
                out[a] += out[a - 1]
            np.cumsum(out[a:b], axis=0, dtype=np.uint8, out=out[a:b])
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].astype(int) if y else np.zeros(out.shape[1], int)
                left = corner = 0
                line = out[y].astype(int)
                for x in range(len(line)):
                    if kind == 3:
                        guess = (left + above[x]) // 2
                    else:
                        p = left + above[x] - corner
                        far = (abs(p - left), abs(p - above[x]), abs(p - corner))
                        guess = (left, above[x], corner)[far.index(min(far))]
                    line[x] = left = (line[x] + guess) & 255
                    corner = above[x]
                out[y] = line
        elif kind:
            raise BadPicture(f"filter {kind}")
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlace, a row each."""
    if data[:8] != SIGNATURE:
        raise BadPicture("signature")
    at, head, parts, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BadPicture(f"checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise BadPicture("header or end")
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise BadPicture(str(e)) from e
    if len(raw) != head[1] * (head[0] + 1):
        raise BadPicture("number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def _means(a: np.ndarray, n: int) -> np.ndarray:
    """n means over equal parts of the rows; fewer rows than n are repeated."""
    if len(a) < n:
        return a[np.arange(n) * len(a) // n].astype(float)
    edges = np.arange(n + 1) * len(a) // n
    return np.add.reduceat(a, edges[:-1], axis=0, dtype=np.float64) / np.diff(edges)[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: for each of the 64 lowest frequencies, whether it exceeds their median."""
    small = _means(_means(samples, SIDE).T, SIDE).T
    low = np.rint(_COSINE @ small @ _COSINE.T * 1e6) + 0.0
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_bytes", "payload_bytes")]
    + [("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = common.as_bytes(b.column("text"))
        ids = b.column("doc_id")
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            yield common.batch(MEDIA, [ids[i : i + 500], [len(t) for t in part], [write_png(payload(t)) for t in part]])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for data in b.column("media").to_pylist():
            samples = read_png(data)
            kept = samples.tobytes()
            rows.append((len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-64:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
        yield common.batch(FEATURES, [b.column("doc_id"), b.column("n_bytes"), *(zip(*rows, strict=True) if rows else [[]] * 6)])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a PNG file in a binary column."""
    common.prepare(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back; a damaged file raises BadPicture."""
    common.prepare(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_png_media(spark, sf_dir: str) -> DataFrame:
    """Stores every document as PNG in a table of the shared folder, reads it back and computes the features."""
    docs = common.table(spark, sf_dir, "documents")
    return features(common.stored(store(docs), "media"))
