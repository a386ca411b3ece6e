"""Benchmark decontamination with an FM-index for each training shard.

A shard is what a task has read, cut at about ``SHARD`` bytes and never inside a text.
Words that no benchmark phrase has can't be part of an occurrence; they end a stretch.
So do texts. Stretches shorter than every phrase can't hold one and aren't indexed. The
index of the other stretches is a Burrows-Wheeler transform over word ids with a wavelet
tree for ranks and every ``SAMPLE``-th suffix position. All phrases search backwards at
once; occurrences are located by walking to a sampled position, compared with the text,
and merged into spans.

The documents aren't shuffled. The benchmark is dealt out by a hash into blocks of about
``BLOCK`` bytes, written to the shared folder; a task reads one block after another and
searches its shards, ``GROUP`` at a time, for it. So nothing of the benchmark goes through
the driver or a broadcast, and no index of phrases grows with it. A single block stays in
the worker.

A null text has no words: nothing is hit. A benchmark item without words has no phrase.
Repeated rows and null doc_ids are kept; items with equal ids count as one, and one without
an id has the id "". Other columns are ignored; an empty table on either side gives no hits
or no rows. ``scan`` and ``keep_clean`` write the blocks when they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a phrase; bytes of text under one index, and of benchmark text in one block; shards that are searched for a block together.
WINDOW, SHARD, BLOCK, GROUP = 13, 6 << 20, 4 << 20, 8
#: Every so many positions of a stretch are kept with their rows.
SAMPLE = 8


class WaveletTree:
    """Ranks of symbols in a sequence: a level for each bit, the symbols ordered by the bits above."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.n = len(symbols)
        self.ones = []
        now = symbols
        for level in range(self.bits):
            shift = self.bits - 1 - level
            one = (now >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]).astype(np.int32))
            now = now[np.argsort(now >> shift, kind="stable")]

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol comes before the position ``end``."""
        low, high, at = np.zeros_like(end), np.full_like(end, self.n), end.copy()
        for level, ones in enumerate(self.ones):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            base = ones[low]
            inside = ones[low + at] - base
            zeros = high - low - (ones[high] - base)
            at = np.where(bit == 1, inside, at - inside)
            middle = low + zeros
            low, high = np.where(bit == 1, middle, low), np.where(bit == 1, high, middle)
        return at


class FMIndex:
    """Over stretches of symbols 1.. , each with a terminator 0 that is less than all symbols and than later terminators."""

    def __init__(self, text: np.ndarray, top: int):
        """text: the stretches, each followed by a 0."""
        n = len(text)
        ends = text == 0
        rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()) - 1).astype(np.int64)
        step = 1
        while True:  # prefix doubling; terminators differ, so it ends with the longest repeat
            key = rank * (int(rank.max()) + 2)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1 or 2 * step > n:
                break
            step *= 2
        self.last = text[order - 1].astype(np.int64)
        self.last[order == 0] = 0
        self.tree = WaveletTree(self.last, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        # positions at the start of a stretch and every SAMPLE-th after it
        start = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
        inside = np.arange(n) - np.repeat(start, np.diff([*start, n]))
        kept = (inside % SAMPLE == 0)[order]
        self.sampled = kept
        self.place = np.cumsum(kept) - 1
        self.position = order[kept]
        self.n = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each phrase; phrases: a row each, of equal lengths."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        last = phrases[:, -1]
        a, b = self.first[last], self.first[last + 1]
        live = np.flatnonzero(a < b)
        a, b = a[live], b[live]
        for j in range(phrases.shape[1] - 2, -1, -1):
            symbol = phrases[live, j]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([a, b]))
            a, b = self.first[symbol] + both[: len(live)], self.first[symbol] + both[len(live) :]
            some = a < b
            live, a, b = live[some], a[some], b[some]
            if not len(live):
                break
        low[live], high[live] = a, b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        for steps in range(SAMPLE):
            done = self.sampled[rows[live]]
            at = live[done]
            out[at] = self.position[self.place[rows[at]]] + steps
            live = live[~done]
            if not len(live):
                break
            symbol = self.last[rows[live]]
            rows[live] = self.first[symbol] + self.tree.rank(symbol, rows[live])
        return out


class Block:
    """Phrases of some benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        """items: (item_id, text as UTF-8)."""
        words = common.Words([t for _, t in items], common.ALNUM)
        data, start, end = words.joined(common.LOWER)
        hashes = words.hashes(1, common.LOWER)
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes) + 1
        self.items = [i for i, _ in items]
        phrases: dict[tuple[int, bytes], set[int]] = defaultdict(set)
        where: dict[tuple[int, bytes], int] = {}
        for n, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            size = min(window, b - a)
            for i in range(a, b - size + 1 if size else a):
                key = (size, data[start[i] : end[i + size - 1]])
                phrases[key].add(n)
                where.setdefault(key, i)
        self.groups: list[tuple[int, np.ndarray, list[bytes], list[list[int]]]] = []
        for size in sorted({size for size, _ in phrases}):
            keys = [k for k in phrases if k[0] == size]
            at = np.array([where[k] for k in keys])
            self.groups.append((size, ids[at[:, None] + np.arange(size)], [k[1] for k in keys], [sorted(phrases[k]) for k in keys]))
        self.least = min((g[0] for g in self.groups), default=0)
        # a table by a hash's top bits in front of the sorted vocabulary
        self.shift = np.uint64(64 - 16)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary >> self.shift).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each word, or 0 if no phrase has it."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.near[(hashes >> self.shift).astype(np.int64)])
        if len(maybe):
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == h, at + 1, 0)
        return out


class Shard:
    """Texts of about SHARD bytes: the words, the words that phrases hit and the items they belong to."""

    def __init__(self, texts: list[bytes]):
        self.parts = [common.Words(texts[i:j], common.ALNUM) for i, j in common.chunks(texts)]
        self.hashes = np.concatenate([w.hashes(1, common.LOWER) for w in self.parts])
        counts = np.concatenate([np.diff(w.first) for w in self.parts])
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.part_first = np.concatenate([[0], np.cumsum([len(w) for w in self.parts])]).astype(np.int64)
        self.hit = np.zeros(len(self.hashes) + 1, np.int64)
        self.found: list[set] = [set() for _ in texts]

    def bytes_at(self, word: int, size: int) -> bytes:
        """The words from ``word`` on, lower-cased, with one space between."""
        part = int(np.searchsorted(self.part_first, word, side="right")) - 1
        w, i = self.parts[part], word - int(self.part_first[part])
        return b" ".join(common.LOWER[w.data[a:b]].tobytes() for a, b in zip(w.start[i : i + size].tolist(), w.end[i : i + size].tolist(), strict=True))

    def search(self, block: Block) -> None:
        if not block.groups or not len(self.hashes):
            return
        symbols = block.symbols(self.hashes)
        inside = symbols > 0
        breaks = np.zeros(len(symbols), bool)  # a text starts here
        breaks[self.first[:-1][self.first[:-1] < len(symbols)]] = True
        begin = np.flatnonzero(inside & (breaks | ~np.concatenate([[False], inside[:-1]])))
        stop = np.flatnonzero(inside & np.concatenate([breaks[1:] | ~inside[1:], [True]])) + 1
        long = stop - begin >= block.least
        begin, stop = begin[long], stop[long]
        if not len(begin):
            return
        size = stop - begin + 1
        end = np.cumsum(size)
        where = np.arange(end[-1]) + np.repeat(begin - (end - size), size)  # of each symbol in the shard
        text = symbols[np.minimum(where, len(symbols) - 1)]
        text[end - 1] = 0
        index = FMIndex(text, len(block.vocabulary))
        for length, phrases, spelled, owners in block.groups:
            low, high = index.search(phrases)
            some = np.flatnonzero(low < high)
            count = (high - low)[some]
            if not len(some):
                continue
            which = np.repeat(some, count)
            rows = np.arange(len(which)) + np.repeat(low[some] - (np.cumsum(count) - count), count)
            words = where[index.locate(rows)]
            docs = np.searchsorted(self.first, words, side="right") - 1
            for word, doc, phrase in zip(words.tolist(), docs.tolist(), which.tolist(), strict=True):
                if self.bytes_at(word, length) == spelled[phrase]:
                    self.hit[word] += 1
                    self.hit[word + length] -= 1
                    self.found[doc].update(block.items[i] for i in owners[phrase])

    def results(self) -> Iterator[tuple[int, int, list[str], list[dict]]]:
        """For each text: words, words hit, items as sorted strings, and merged spans of words."""
        hit = np.cumsum(self.hit[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(hit)])
        for n, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            hits = int(total[b] - total[a])
            spans = []
            if hits:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
                spans = [{"first": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
            yield b - a, hits, sorted(map(str, self.found[n])), spans


SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,end:long>>, contaminated boolean"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))]
    + [("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("contaminated", pa.bool_())]
)


def write_blocks(benchmark: DataFrame, most: int = BLOCK) -> tuple[str, int]:
    """Writes the items to the shared folder, dealt into blocks of about ``most`` bytes (or one longer item): the folder and the number of blocks."""
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n, path = max(1, -(-size // most)), common.new_path(benchmark.sparkSession, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).repartition(n, "block").write.partitionBy("block").parquet(path)
    return path, n


#: The single block of a benchmark, by its folder and window, in a worker.
_single: dict[tuple[str, int], Block] = {}


class _Search:
    """Searches shards for all blocks of a benchmark, in a task."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int, most: int = BLOCK):
        common.prepare(docs.sparkSession)
        self.window, (self.path, self.blocks) = window, write_blocks(benchmark, most)

    def block(self, k: int) -> Block:
        key = self.path, self.window
        if key in _single:
            return _single[key]
        items = common.read_parquet(f"{self.path}/block={k}", ["item_id", "text"])
        block = Block(list(zip(items.column("item_id").to_pylist(), common.as_bytes(items.column("text")), strict=True)), self.window)
        if self.blocks == 1:
            _single.clear()
            _single[key] = block
        return block

    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple]]]:
        """Rows of a shard, and the columns of SCHEMA but the first for each of its texts."""
        held: list[tuple[pa.Table, Shard]] = []

        def found() -> Iterator[tuple[pa.Table, list[tuple]]]:
            for k in range(self.blocks):
                block = self.block(k)
                for _, shard in held:
                    shard.search(block)
            for table, shard in held:
                yield table, [(n, hits, items, spans, hits > 0 and 20 * hits >= n) for n, hits, items, spans in shard.results()]
            held.clear()

        for table, texts in _shards(batches):
            held.append((table, Shard(texts)))
            if self.blocks == 1 or len(held) == GROUP:
                yield from found()
        yield from found()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows of about SHARD bytes of text, and their texts."""
    parts, texts, size = [], [], 0
    for b in batches:
        own = common.as_bytes(b.column(b.schema.get_field_index("text")))
        for first, last in common.chunks(own, SHARD):
            more = sum(len(t) for t in own[first:last])
            if parts and size + more > SHARD:
                yield pa.Table.from_batches(parts), texts
                parts, texts, size = [], [], 0
            parts.append(b.slice(first, last - first))
            texts = texts + own[first:last]
            size += more
    if parts:
        yield pa.Table.from_batches(parts), texts


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """For each row of docs: words, words hit, the items hit, spans of hit words and whether it is contaminated.

    A document is contaminated if at least a twentieth of its words is hit.
    """
    search = _Search(docs, benchmark, window, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in search.groups(batches):
            yield common.batch(_SCHEMA, [common.plain(table.column("doc_id")), *zip(*rows, strict=True)])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """The rows of docs that aren't contaminated, unchanged."""
    search = _Search(docs, benchmark, window, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, rows in search.groups(batches):
            yield from table.filter(pa.array([not row[-1] for row in rows])).to_batches()

    return docs.mapInArrow(run, docs.schema)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )
