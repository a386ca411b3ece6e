"""Removal of repeated passages through a log-structured fingerprint index.

A window is a number of consecutive words of one document. The index is a list of runs:
immutable, each the windows of the documents of one range of doc_id, sorted by a 56-bit
hash and cut into buckets by the hashes' top bits. A new batch becomes runs of its own, in
ascending order of doc_id. In every bucket they are merge-joined with the historical runs,
oldest first, and a match of hashes is verified by a 128-bit BLAKE2b digest of the words:
an entry that an earlier run holds too is repeated. What goes back to a run is a bit for
each of its entries. ``commit`` adds the batch's runs to the history and ``compact`` merges
the runs of each bucket into one.

A batch that meets an empty index and isn't kept screens its windows first: runs hold
hashes alone, and digests are made only of entries whose hash two runs hold. Inside a run
windows of one hash are compared word by word; those that differ from the first of them are
entries of their own.

So a window counts as seen if a document with a smaller doc_id of the same batch, or any
document of an earlier batch, has it. Feed batches in ascending order of doc_id; ``removed``
does that where the documents are more than one batch.

The work is dealt out by run and by bucket; both numbers follow the bytes of the batch. Runs
are cut by bytes and rows; rows of one doc_id may fill several runs. A window that a third of
all documents share enters a bucket once for each run.

A null text has no words. Documents with equal doc_ids don't count as earlier than one
another; null doc_ids count as the smallest. Repeated rows are kept. Other columns are
ignored; an empty table gives an empty table. A text shorter than a window keeps all words.
Texts may be of any length; a task holds about thirty bytes for each byte of its longest.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a window; bytes of text in one run, for each bucket, and in one batch.
WINDOW, RUN_BYTES, BUCKET_BYTES, BATCH_BYTES = 13, 12 << 20, 8 << 20, 256 << 30
#: Run number of what an index held before the batch.
HISTORY = -1
#: Stands for a null doc_id: the smallest.
NULL_ID = -(1 << 63)
#: Bits of a window's hash, and bytes of its digest.
BITS, DIGEST = 56, 16


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences in byte planes, as many as the largest needs."""
    gaps = np.diff(hashes, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :width] = np.frombuffer(blob, np.uint8, width * n, 1).reshape(width, n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


class Windows:
    """The windows of a run's documents, in ascending order of doc_id.

    data, start, end: all words with a space after each, and their bounds. hashes: the
    distinct ones, sorted; group: which of them each window has; word: the window's first
    word; rank: dense rank of its document's doc_id; lead: the first window of each group.
    """

    def __init__(self, ids: list, texts: list[bytes], window: int):
        self.window = window
        keys = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], [ids[i] for i in order.tolist()]
        sorted_texts = [texts[i] for i in order.tolist()]
        data, start, end, hashes, counts, base = [], [], [], [], [], 0
        for i, j in common.chunks(sorted_texts):
            w = common.Words(sorted_texts[i:j], common.NOT_SPACE)
            own, a, b = w.joined()
            joined = np.frombuffer(own, np.uint8)
            hashes.append(common.span_hashes(common.loads(joined), a, b, 1))
            data.append(joined)
            start.append(a + base)
            end.append(b + base)
            counts.append(np.diff(w.first))
            base += len(own)
        whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        self.data, self.start, self.end = whole(data, np.uint8), whole(start, np.int64), whole(end, np.int64)
        self.first = np.concatenate([[0], np.cumsum(whole(counts, np.int64))]).astype(np.int64)
        every = common.window_hashes(whole(hashes, np.uint64), window) >> np.uint64(64 - BITS)
        left = np.repeat(self.first[1:], np.diff(self.first))[: len(every)] - np.arange(len(every))  # words from here to the text's end
        self.word = np.flatnonzero(left >= window)
        every = every[self.word]
        self.doc = (np.searchsorted(self.first, self.word, side="right") - 1).astype(np.int32)
        dense = np.cumsum(np.diff(self.keys, prepend=self.keys[:1]) != 0).astype(np.int32)
        self.rank = dense[self.doc]
        # stable: in each group the window of the first document comes first
        by = np.argsort(every, kind="stable")
        fresh = np.diff(every[by], prepend=every[by[:1]] ^ np.uint64(1)) != 0
        self.lead = by[fresh]
        self.hashes = every[self.lead]
        self.group = np.empty(len(by), np.int32)
        self.group[by] = np.cumsum(fresh) - 1

    def verify(self, salt: bytes) -> None:
        """Sets entry, which entry each window is, and of: the group of each entry.

        The first entries are the groups; windows that differ in words from the first of
        their group are further ones.
        """
        self.salt, self.entry, self.of = salt, self.group.copy(), np.arange(len(self.lead))
        eights = common.loads(self.data)
        others = np.flatnonzero(self.lead[self.group] != np.arange(len(self.group)))
        odd = []
        for i in range(0, len(others), 1 << 18):
            mine = others[i : i + (1 << 18)]
            theirs = self.lead[self.group[mine]]
            a, x, b, y = *self._bounds(mine), *self._bounds(theirs)
            odd += mine[~common.spans_equal(eights, a, x - a, eights, b, y - b)].tolist()
        more: dict[tuple[int, bytes], int] = {}
        for w in odd:
            self.entry[w] = more.setdefault((int(self.group[w]), self._digest(w)), len(self.lead) + len(more))
        self.of = np.concatenate([self.of, np.array([g for g, _ in more], np.int64)])
        self.least = np.full(len(self.of), np.iinfo(np.int32).max, np.int32)
        np.minimum.at(self.least, self.entry[odd], self.rank[odd])
        self.least[: len(self.lead)] = self.rank[self.lead]
        self.sample = np.concatenate([self.lead, np.zeros(len(more), np.int64)])  # a window of each entry
        self.sample[self.entry[odd]] = odd

    def _bounds(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.word[windows]
        return self.start[first], self.end[first + self.window - 1]

    def _digest(self, w: int) -> bytes:
        first = int(self.word[w])
        return hashlib.blake2b(self.data[self.start[first] : self.end[first + self.window - 1]], digest_size=DIGEST, salt=self.salt).digest()

    def digests(self, entries: np.ndarray) -> bytes:
        """The digests of entries, joined."""
        a, b = self._bounds(self.sample[entries])
        raw, salt, make = memoryview(self.data), self.salt, hashlib.blake2b
        return b"".join([make(raw[x:y], digest_size=DIGEST, salt=salt).digest() for x, y in zip(a.tolist(), b.tolist(), strict=True)])

    def buckets(self, bits: int) -> np.ndarray:
        """Bounds of the buckets in the groups."""
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(BITS - bits)
        return np.concatenate([np.searchsorted(self.hashes, edges), [len(self.hashes)]])

    def chosen(self, first: int, last: int, packed: bytes | None = None) -> np.ndarray:
        """The entries of the groups from first to last, or of those of them that the bits name, in order of group."""
        marks = np.ones(last - first, bool) if packed is None else _bits(packed, last - first)
        groups = first + np.flatnonzero(marks)
        odd = self.of[len(self.lead) :]
        more = np.flatnonzero((odd >= first) & (odd < last))
        more = more[marks[odd[more] - first]]
        entries = np.concatenate([groups, len(self.lead) + more])
        return entries[np.argsort(self.of[entries], kind="stable")] if len(more) else entries

    def edges(self, entries: np.ndarray) -> bytes:
        """Of each entry a bit whether its first document has the run's first doc_id, and whether the last one."""
        least = self.least[entries]
        return np.packbits(least == self.rank_of(0)).tobytes() + np.packbits(least == self.rank_of(-1)).tobytes()

    def rank_of(self, row: int) -> int:
        return int((np.diff(self.keys) != 0).sum()) if row else 0

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """Which words a repeated window covers; earlier: which entries an earlier run holds."""
        start = self.word[earlier[self.entry] | (self.rank > self.least[self.entry])]
        edge = np.zeros(int(self.first[-1]) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.window, -1)
        return np.cumsum(edge[:-1]) > 0

    def kept_texts(self, covered: np.ndarray):
        """Each text without the covered words: doc_id, words, words removed, the rest joined by one space."""
        size = np.where(covered, 0, self.end - self.start + 1)
        left = self.data[np.repeat(~covered, self.end - self.start + 1)].tobytes()
        stop = np.concatenate([[0], np.cumsum(size)])
        removed = np.concatenate([[0], np.cumsum(covered)])
        for i, a, b in zip(self.ids, self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            yield i, b - a, int(removed[b] - removed[a]), left[stop[a] : max(stop[a], stop[b] - 1)]


def shared_hashes(runs: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """runs: (entries, hashes) of one bucket. Which hashes of each run another run holds."""
    opened = [unpack(blob, n) for n, blob in runs]
    hashes = np.concatenate(opened)
    order = np.argsort(hashes, kind="stable")
    same = np.concatenate([[False], np.diff(hashes[order]) == 0, [False]])
    shared = np.empty(len(order), bool)
    shared[order] = same[1:] | same[:-1]
    return np.split(shared, np.cumsum([n for n, _ in runs])[:-1])


def _both(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests as two numbers each."""
    two = digests.view("<u8").reshape(-1, 2)
    return two[:, 0], two[:, 1]


def earlier_entries(runs: list[tuple[int, int, bytes, bytes, int, int]]) -> list[np.ndarray]:
    """runs: (number, entries, digests, edges, first and last doc_id) of one bucket. Which entries of each run were in a document with a smaller doc_id."""
    numbers = np.array([r[0] for r in runs])
    sizes = np.array([r[1] for r in runs])
    one, two = _both(np.frombuffer(b"".join(r[2] for r in runs), np.uint8))
    run = np.repeat(np.arange(len(runs)), sizes)
    order = np.lexsort((numbers[run], two, one))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    flags = [np.unpackbits(np.frombuffer(r[3], np.uint8).reshape(2, -1), axis=1, count=r[1]).astype(bool) if r[1] and r[3] else np.zeros((2, r[1]), bool) for r in runs]
    low, high = (np.concatenate([f[k] for f in flags]) for k in (0, 1))
    begin, stop = (np.array([r[k] for r in runs]) for k in (4, 5))
    # runs are in order of doc_id: the first holder's document is earlier, or has the doc_id where both runs meet
    tie = high[first] & low[order] & (stop[run[first]] == begin[run[order]]) & (numbers[run[first]] != HISTORY)
    seen = np.empty(len(order), bool)
    seen[order] = (numbers[run[first]] < numbers[run[order]]) & ~tie
    return np.split(seen, np.cumsum(sizes)[:-1])


def merge_sorted(blobs: list[tuple[int, bytes, bytes]]) -> tuple[int, bytes, bytes]:
    """One run of the distinct entries of several; blobs: (entries, hashes, digests)."""
    hashes = np.concatenate([unpack(blob, n) for n, blob, _ in blobs])
    digests = np.frombuffer(b"".join(d for _, _, d in blobs), np.uint8).reshape(-1, DIGEST)
    one, two = _both(digests.ravel())
    order = np.lexsort((two, one, hashes))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)
    kept = order[fresh]
    return len(kept), pack(hashes[kept]), digests[kept].tobytes()


def partition_keys(n: int) -> list[int]:
    """Keys 0.. such that the i-th falls into the i-th of n hash partitions: a shuffle on them gives every task one run or bucket."""
    keys, left, low = np.full(n, -1), n, 0
    while left:
        some = np.arange(low, low + 4 * n + 64)
        at = murmur3(some).astype(np.int64) % n
        first, where = np.unique(at, return_index=True)
        fresh = keys[first] < 0
        keys[first[fresh]] = some[where[fresh]]
        left -= int(fresh.sum())
        low += len(some)
    return keys.tolist()


def _keys(n: int) -> Column:
    return F.array(*[F.lit(k).cast("long") for k in partition_keys(n)])


def murmur3(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of longs (32-bit Murmur3 over two halves), signed."""
    turned = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    wide = values.astype(np.uint64)
    h = np.full(len(values), seed, np.uint32)
    for half in ((wide & np.uint64(0xFFFFFFFF)).astype(np.uint32), (wide >> np.uint64(32)).astype(np.uint32)):
        k = turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


RUNS = "bucket long, run long, n long, hashes binary, digests binary, edges binary, low long, high long, shared binary"
_RUNS = pa.schema([(n, pa.int64()) for n in ("bucket", "run", "n")] + [(n, pa.binary()) for n in ("hashes", "digests", "edges")] + [("low", pa.int64()), ("high", pa.int64()), ("shared", pa.binary())])
ANSWERS = "run long, bucket long, n long, shared binary, seen binary"
_ANSWERS = pa.schema([("run", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("shared", pa.binary()), ("seen", pa.binary())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([common.batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * len(schema))])


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def cuts_by_bytes(docs: DataFrame, parts: int, mean: float) -> list[int]:
    """parts - 1 doc_ids in ascending order, repeats included, that cut the rows into parts of about equal weight: a row weighs 1 and its bytes over the mean."""
    weight = 1 + F.coalesce(F.octet_length("text") / max(mean, 1.0), F.lit(0.0))
    each = docs.select(F.explode(F.array_repeat("doc_id", weight.cast("int"))).alias("doc_id"))
    return each.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()[0] or [] if parts > 1 else []


def _below(cuts: list[int], doc_id: Column) -> Column:
    """How many cuts are doc_id at most; cuts in two levels, so about twice the root of their number is compared."""
    side = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    inner = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    outer = F.size(F.filter(heads, lambda x: x <= doc_id))
    return F.when(outer == 0, F.lit(0)).otherwise((outer - 1) * side + F.size(F.filter(F.get(inner, outer - 1), lambda x: x <= doc_id)))


def run_of(cuts: list[int], doc_id: Column, salt: Column) -> Column:
    """The run of each row. A doc_id that is cut several times fills as many runs, which the salt deals out."""
    if not cuts:
        return F.lit(0).cast("long")
    high = _below(cuts, doc_id)
    if len(set(cuts)) == len(cuts):
        return high.cast("long")
    low = _below(cuts, F.greatest(doc_id, F.lit(NULL_ID + 1)) - 1)
    low = F.when(doc_id == NULL_ID, F.lit(0)).otherwise(low)
    return F.when(high - low > 1, low + 1 + F.pmod(salt, high - low)).otherwise(high).cast("long")


@dataclass
class FingerprintIndex:
    """bits: of a hash that name its bucket (fixed once the index holds runs). history: tables of runs. salt: up to 16 bytes for the digests."""

    spark: SparkSession
    bits: int | None = None
    window: int = WINDOW
    salt: bytes = b""
    run_bytes: int = RUN_BYTES
    history: list[DataFrame] = field(default_factory=list)
    _pending: DataFrame | None = None

    def ingest(self, docs: DataFrame, keep: bool = True, measured: tuple[int, int] | None = None) -> DataFrame:
        """doc_id, n_words, n_removed, text (the words left, joined by one space) of every row.

        keep: the batch's runs are written, for ``commit``. measured: bytes of text and rows, if known.
        """
        common.prepare(self.spark)
        docs = _plain(docs)
        size, rows = measured or _measure(docs)
        if self.bits is None:
            self.bits = max(5, int(size // BUCKET_BYTES).bit_length())
        n_runs = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // self.run_bytes))
        run = run_of(cuts_by_bytes(docs, n_runs, size / max(rows, 1)), F.col("doc_id"), F.monotonically_increasing_id())
        slot, slot_of = F.get(_keys(n_runs), F.col("run").cast("int")).alias("slot"), lambda df: df.groupBy("slot")
        # all uses below read this one exchange; each of its partitions is one run
        dealt = docs.withColumn("run", run).select("*", slot).repartition(n_runs, "slot")
        screen = not keep and not self.history
        runs = dealt.groupBy("slot").applyInArrow(self._to_runs(digests=not screen), RUNS)
        if screen:
            shared = self._by_bucket(runs, _screen)
            runs = slot_of(dealt).cogroup(slot_of(shared.select("*", slot))).applyInArrow(self._to_digests(), RUNS)
        elif keep:
            self._pending = runs = common.stored(runs, "runs")
        for old in self.history:
            runs = runs.union(old)
        answers = self._by_bucket(runs, _verify)
        return slot_of(dealt).cogroup(slot_of(answers.select("*", slot))).applyInArrow(self._to_kept(), "doc_id long, n_words long, n_removed long, text string")

    def _by_bucket(self, runs: DataFrame, merge) -> DataFrame:
        place = F.get(_keys(1 << self.bits), F.col("bucket").cast("int")).alias("place")
        return runs.select("*", place).repartition(1 << self.bits, "place").groupBy("place").applyInArrow(merge, ANSWERS)

    def _to_runs(self, digests: bool):
        bits, window, salt = self.bits, self.window, self.salt

        def run(table: pa.Table) -> pa.Table:
            w = Windows(*_columns(table), window)
            number = table.column("run")[0].as_py()
            bounds, rows = w.buckets(bits).tolist(), []
            if digests:
                w.verify(salt)
            for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if y > x and not digests:
                    rows.append((b, number, y - x, pack(w.hashes[x:y]), None, None, None, None, None))
                elif y > x:
                    rows.append(_blob(w, b, number, w.chosen(x, y), None))
            return _table(_RUNS, rows)

        return run

    def _to_digests(self):
        bits, window, salt = self.bits, self.window, self.salt

        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _table(_RUNS, [])
            w = Windows(*_columns(table), window)
            w.verify(salt)
            number, bounds, rows = table.column("run")[0].as_py(), w.buckets(bits), []
            for bucket, packed in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist(), strict=True):
                rows.append(_blob(w, bucket, number, w.chosen(bounds[bucket], bounds[bucket + 1], packed), packed, hashes=False))
            return _table(_RUNS, rows)

        return run

    def _to_kept(self):
        bits, window, salt = self.bits, self.window, self.salt

        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            w = Windows(*_columns(table), window)
            w.verify(salt)
            bounds, earlier = w.buckets(bits), np.zeros(len(w.of), bool)
            for bucket, n, shared, seen in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "shared", "seen")), strict=True):
                earlier[w.chosen(bounds[bucket], bounds[bucket + 1], shared)] = _bits(seen, n)
            return _table(_KEPT, [(i, n, removed, text.decode()) for i, n, removed, text in w.kept_texts(w.covered(earlier))])

        return run

    def commit(self) -> None:
        """Adds the last batch's runs to the history."""
        if self._pending is not None:
            self.history.append(self._pending.withColumn("run", F.lit(HISTORY).cast("long")))
            self._pending = None

    def compact(self) -> None:
        """Merges the runs of each bucket into one."""
        if not self.history:
            return
        every = self.history[0]
        for old in self.history[1:]:
            every = every.union(old)

        def merge(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
            n, hashes, digests = merge_sorted(list(zip(*(table.column(c).to_pylist() for c in ("n", "hashes", "digests")), strict=True)))
            return _table(_RUNS, [(key[0].as_py(), HISTORY, n, hashes, digests, None, None, None, None)])

        self.history = [common.stored(every.groupBy("bucket").applyInArrow(merge, RUNS), "runs")]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs["text"].cast("string").alias("text"))


def _measure(docs: DataFrame) -> tuple[int, int]:
    """Bytes of text, and rows."""
    return tuple(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first())


def _columns(table: pa.Table) -> tuple[list, list[bytes]]:
    return [None if i == NULL_ID else i for i in table.column("doc_id").to_pylist()], common.as_bytes(table.column("text"))


def _blob(w: Windows, bucket: int, number: int, entries: np.ndarray, shared: bytes | None, hashes: bool = True) -> tuple:
    return bucket, number, len(entries), pack(w.hashes[w.of[entries]]) if hashes else None, w.digests(entries), w.edges(entries), int(w.keys[0]), int(w.keys[-1]), shared


def _screen(table: pa.Table) -> pa.Table:
    bucket, runs = table.column("bucket")[0].as_py(), table.column("run").to_pylist()
    found = shared_hashes(list(zip(*(table.column(c).to_pylist() for c in ("n", "hashes")), strict=True)))
    return _table(_ANSWERS, [(r, bucket, len(x), np.packbits(x).tobytes(), None) for r, x in zip(runs, found, strict=True) if x.any()])


def _verify(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    held = [(r, n, d, e or b"", NULL_ID if a is None else a, NULL_ID if z is None else z) for r, n, d, e, a, z in zip(*(table.column(c).to_pylist() for c in ("run", "n", "digests", "edges", "low", "high")), strict=True)]
    shared = table.column("shared").to_pylist()
    return _table(_ANSWERS, [(h[0], bucket, h[1], s, np.packbits(x).tobytes()) for h, s, x in zip(held, shared, earlier_entries(held), strict=True) if h[0] != HISTORY and x.any()])


def removed(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, text of every row, in batches of about ``batch_bytes`` of text, each a range of doc_id.

    One batch is planned as a whole. More are written to the shared folder one after the
    other when this is called, each merged with the compacted index of those before it.
    """
    spark = docs.sparkSession
    docs = _plain(docs)
    size, rows = _measure(docs)
    n = -(-size // batch_bytes)
    if n <= 1:
        return FingerprintIndex(spark).ingest(docs, keep=False, measured=(size, rows))
    index = FingerprintIndex(spark, bits=max(5, int(size // BUCKET_BYTES).bit_length()))
    bounds = [None, *sorted(set(cuts_by_bytes(docs, n, size / rows))), None]
    out = None
    for low, high in zip(bounds, bounds[1:], strict=False):
        batch = docs if low is None else docs.where(F.col("doc_id") >= low)
        batch = batch if high is None else batch.where(F.col("doc_id") < high)
        done = common.stored(index.ingest(batch), "kept")
        out = done if out is None else out.union(done)
        index.commit()
        index.compact()
    return out


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    found = removed(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
