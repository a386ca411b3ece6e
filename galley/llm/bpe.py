"""Byte-level BPE encoding and decoding.

The encoder keeps the pairs that may merge in buckets, one for each merge rank,
and the ranks of non-empty buckets in a bitmap of three levels of 64-bit words.
Find-first-set on each level gives the lowest rank; its bucket holds left
positions that are still valid merge from the left. Symbols form a linked list; an
entry whose pair has changed since is stale and skipped. A piece of n bytes takes
O(n log n) steps, however long it is. All pieces that a batch meets for the first time
share one queue, so that a bucket holds many positions and numpy merges it at once.

A null text is empty: no ids. Repeated rows and null doc_ids are kept, other columns
ignored, and an empty table gives an empty table. A long text is encoded in parts; one long
piece (a run without a place to split) takes some fifty bytes of memory for each of its own.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .pretokens import PieceCache, binaries, ragged


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


#: Pairs whose ranks are looked up at once.
STEP = 1 << 20


class RankQueue:
    """Left positions of pairs in a bucket for each merge rank."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.low: dict[int, int] = {}  # 64 ranks a word
        self.mid: dict[int, int] = {}  # 64 words of low a word
        self.top = 0

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Adds positions, each to the bucket of its rank (-1: to none)."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edge = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, first, last in zip(ranks[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(ranks)], strict=False):
            bucket = self.buckets.get(rank)
            if bucket is None:
                self.buckets[rank] = [positions[first:last]]
                word, group = rank >> 6, rank >> 12
                self.low[word] = self.low.get(word, 0) | 1 << (rank & 63)
                self.mid[group] = self.mid.get(group, 0) | 1 << (word & 63)
                self.top |= 1 << group
            else:
                bucket.append(positions[first:last])

    def first(self) -> int:
        """The lowest rank with entries, or -1."""
        if not self.top:
            return -1
        group = (self.top & -self.top).bit_length() - 1
        bits = self.mid[group]
        word = group << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[word]
        return word << 6 | (bits & -bits).bit_length() - 1

    def pop(self, rank: int) -> np.ndarray:
        """Takes a bucket out; its positions in ascending order."""
        word, group = rank >> 6, rank >> 12
        self.low[word] ^= 1 << (rank & 63)
        if not self.low[word]:
            self.mid[group] ^= 1 << (word & 63)
            if not self.mid[group]:
                self.top ^= 1 << group
        bucket = self.buckets.pop(rank)
        return np.unique(bucket[0] if len(bucket) == 1 else np.concatenate(bucket))


class Codec:
    """Encodes and decodes with the ranks of one vocabulary file."""

    def __init__(self, path: str):
        self.ranks = ranks = load_ranks(path)
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)])
        self.cache = PieceCache(self.encode_pieces)
        # all tokens joined, and where each lies
        self.spelled = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length = np.array([len(t) for t in self.tokens])
        self.offset = np.cumsum(self.length) - self.length

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of ids that make a token, in order, and the tokens' ranks (a decoder doesn't need them)."""
        keys, made = array("q"), array("q")
        ranks = self.ranks
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys))
        return np.array(keys)[order], np.array(made)[order]

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of ids make, or -1."""
        known, ranks = self.pairs
        if len(left) <= STEP:
            keys = left.astype(np.int64, copy=False) << 20 | right
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            return np.where(known[at] == keys, ranks[at], -1)
        return np.concatenate([self.pair_rank(left[a : a + STEP], right[a : a + STEP]) for a in range(0, len(left), STEP)])

    def merge(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many of each, by one queue for all.

        Links don't cross from piece to piece, so each merges as it would alone. A
        bucket merges at once; if two of its pairs share a symbol, or a merge makes a
        pair of a lower rank, it merges pair by pair from the left.
        """
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        n, lengths = len(data), np.array([len(p) for p in parts])
        end = np.cumsum(lengths)
        kind = np.int64 if n < 4 * STEP else np.int32  # narrow numbers take half the memory and more time
        after, before = np.arange(1, n + 1, dtype=kind), np.arange(-1, n - 1, dtype=kind)
        after[end - 1] = before[end - lengths] = -1
        ids = self.byte_id[data].astype(kind)
        now = np.full(n, -1, kind)  # the rank of the pair that starts here
        at = np.flatnonzero(after >= 0).astype(kind)
        now[at] = self.pair_rank(ids[at], ids[after[at]])
        queue = RankQueue()
        queue.push(now[at], at)
        while (rank := queue.first()) >= 0:
            i = queue.pop(rank)
            i = i[now[i] == rank]  # the others are stale
            if not len(i):
                continue
            j = after[i]
            if (now[j] == rank).any():
                self._merge_each(rank, i, ids, after, before, now, queue)
                continue
            k = after[j]
            was = ids[i], ids[j], now[j]
            ids[i], ids[j], now[i], now[j], after[i] = rank, -1, -1, -1, k
            more = k >= 0
            before[k[more]] = i[more]
            h = before[i]
            less = h >= 0
            right = self.pair_rank(ids[i[more]], ids[k[more]])
            left = self.pair_rank(ids[h[less]], ids[i[less]])
            ranks, starts = np.concatenate([right, left]), np.concatenate([i[more], h[less]])
            if ((ranks >= 0) & (ranks < rank)).any():
                ids[i], ids[j], now[j] = was
                now[i], after[i] = rank, j
                before[k[more]] = j[more]
                self._merge_each(rank, i, ids, after, before, now, queue)
                continue
            now[starts] = ranks
            queue.push(ranks, starts)
        kept = ids >= 0
        return ids[kept].astype(np.uint32), np.add.reduceat(kept, end - lengths, dtype=np.int64)

    def _merge_each(self, rank, positions, ids, after, before, now, queue) -> None:
        """Merges a bucket's pairs one by one, until one makes a pair of a lower rank."""
        ranks, tokens = self.ranks, self.tokens
        fresh: list[tuple[int, int]] = []
        for n, i in enumerate(positions.tolist()):
            if now[i] != rank:
                continue  # stale
            j = int(after[i])
            k = int(after[j])
            ids[i], ids[j], now[i], now[j], after[i] = rank, -1, -1, -1, k
            made = []
            if k >= 0:
                before[k] = i
                made.append((ranks.get(tokens[rank] + tokens[ids[k]], -1), i))
            if (h := int(before[i])) >= 0:
                made.append((ranks.get(tokens[ids[h]] + tokens[rank], -1), h))
            for new, at in made:
                now[at] = new
            fresh += made
            if any(0 <= new < rank for new, _ in made):
                rest = positions[n + 1 :]
                queue.push(np.full(len(rest), rank), rest)
                break
        if fresh:
            queue.push(*(np.array(x) for x in zip(*fresh, strict=True)))

    def encode_pieces(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many of each: its own if it is a token, else those that merging leaves."""
        own = np.array([self.ranks.get(p, -1) for p in parts], np.int64)
        whole = own >= 0
        ids, size = self.merge([p for p, w in zip(parts, whole.tolist(), strict=True) if not w])
        counts = np.ones(len(parts), np.int64)
        counts[~whole] = size
        out = np.empty(int(counts.sum()), np.uint32)
        single = np.repeat(whole, counts)
        out[single], out[~single] = own[whole], ids
        return out, counts

    def encode(self, text: str) -> list[int]:
        return self.cache.texts([text.encode()])[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        ids = np.asarray(ids, np.int64)
        return ragged(self.spelled, self.offset[ids], self.length[ids]).tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


SCHEMA = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids: each text's ids, little-endian unsigned 32-bit, in a binary column."""
    common.prepare(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids, counts = c.cache.texts(common.as_bytes(b.column("text")))
            yield common.batch(schema, [b.column("doc_id"), counts, binaries(ids, counts)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The columns of ``encode`` and text_bytes: the bytes that the ids stand for."""
    common.prepare(encoded.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text_bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = b.column("ids").to_pylist()
            yield common.batch(schema, [b.column("doc_id"), b.column("n_tokens"), ids, [c.decode(np.frombuffer(x, "<u4")) for x in ids]])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, SCHEMA + ", text_bytes binary")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    from pyspark.sql import functions as F

    out = decode(encode(common.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text_bytes", 256).alias("decoded_sha256"))
