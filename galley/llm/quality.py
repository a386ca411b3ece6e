"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts over the whole text, computed from byte arrays. Each is cut into bins
at quantiles of the training rows. Training goes round the features; in each turn a
shallow tree over one feature's bins is fitted to the gradient of the logistic loss and
added to that feature's lookup table. Then the pairs of features whose joint bins explain
most of what is left get tables of their own in the same way. A score is the sum of one
entry of each table, through the logistic function.

A null text is empty; it has a score like any other. Labels whose document is missing,
or that are null, are not used; with labels of one class only (or none) the score is
constant. Repeated rows are kept. Rows with a null doc_id aren't held out. Other columns
are ignored by ``score`` and kept by ``keep_good``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that are fitted at most (those with the least hashes), bins of a feature,
#: rounds over the features, pairs of features with a table, and the step of a round.
MOST_ROWS, BINS, ROUNDS, PAIRS, RATE = 12_000, 32, 120, 6, 0.15

_SIGNS = {name: common.byte_class(*((ord(c), ord(c)) for c in chars)) for name, chars in (("marks", "%*$#&"), ("calls", "!?"), ("bars", "|"), ("commas", ",;:"), ("stops", "."), ("lines", "\n"))}
_UPPER, _LOWER, _DIGIT = common.byte_class((0x41, 0x5A)), common.byte_class((0x61, 0x7A)), common.byte_class((0x30, 0x39))
_HIGH = common.byte_class((0xC0, 0xFF))

FEATURES = [
    *(f"share_{n}" for n in _SIGNS), "share_upper", "share_digit", "share_high", "log_bytes", "log_words", "mean_word", "spread_word",
    "repeats_one", "repeats_two", "distinct", "distinct_pairs", "top_share", "short_words", "long_words", "line_words", "capital_words",
]


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each UTF-8 text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in common.chunks(texts):
        out[a:b] = _chunk(texts[a:b])
    return out


def _chunk(texts: list[bytes]) -> np.ndarray:
    w = common.Words(texts, common.NOT_SPACE)
    data, n = w.data, len(texts)
    cuts = np.concatenate([w.text_start, [len(data)]])
    size = np.maximum(np.diff(cuts) - 1, 1)

    def share(inside: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(inside[data], dtype=np.int64)])
        return np.diff(total[cuts]) / size

    columns = [share(t) for t in (*_SIGNS.values(), _UPPER, _DIGIT, _HIGH)]
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=float)])[w.first])
    length = w.end - w.start
    mean = sums(length) / some
    columns += [np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(sums(length**2) / some - mean**2, 0))]
    h = w.hashes(1, common.LOWER)
    text = np.repeat(np.arange(n), words)

    def again(lag: int) -> np.ndarray:
        same = np.zeros(len(h), bool)
        if len(h) > lag:
            same[lag:] = (h[lag:] == h[:-lag]) & (text[lag:] == text[:-lag])
        return same

    columns += [sums(again(1)) / some, sums(again(2)) / some]
    own = common.mixed(h + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    pairs = own.copy()
    pairs[1:] = common.mixed(own[:-1] * np.uint64(31) + own[1:])
    for x in (own, pairs):
        order = np.argsort(x)
        fresh = np.ones(len(x), bool)
        fresh[1:] = np.diff(x[order]) != 0
        columns.append(np.bincount(text[order[fresh]], minlength=n) / some)
        if x is own:
            most = np.zeros(n)
            if len(x):
                at = np.flatnonzero(fresh)
                np.maximum.at(most, text[order[at]], np.diff([*at, len(x)]))
            top = most / some
    columns += [top, sums(length <= 3) / some, sums(length >= 12) / some, np.log1p(words / (1 + share(_SIGNS["lines"]) * size)), sums(_UPPER[data[w.start]]) / some]
    return np.stack(columns, 1)


@dataclass
class Model:
    edges: list[np.ndarray]
    start: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int]]
    tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.start)
        for table, b in zip(self.single, bins, strict=True):
            total += table[b]
        for (i, j), table in zip(self.pairs, self.tables, strict=True):
            total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return g.sum() / (h.sum() + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, least: float) -> np.ndarray:
    """The step of each bin: a tree of this depth over sums of gradients and curvatures."""
    if depth:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        right_g, right_h = g.sum() - left_g, h.sum() - left_h
        gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
        gain[(left_h < least) | (right_h < least)] = -1
        if len(gain) and gain.max() > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            k = int(gain.argmax()) + 1
            return np.concatenate([_tree(g[:k], h[:k], depth - 1, least), _tree(g[k:], h[k:], depth - 1, least)])
    return np.full(len(g), _leaf(g, h))


def _tree2(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """Four leaves over the bins of two features: a cut of one, then of the other on either side. And its gain."""
    best, found = -np.inf, None
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        cut_g, cut_h = np.cumsum(gg, 0), np.cumsum(hh, 0)
        for k in range(1, len(gg)):
            parts = []
            for side_g, side_h in ((cut_g[k - 1], cut_h[k - 1]), (cut_g[-1] - cut_g[k - 1], cut_h[-1] - cut_h[k - 1])):
                a, b = np.cumsum(side_g)[:-1], np.cumsum(side_h)[:-1]
                c, d = side_g.sum() - a, side_h.sum() - b
                gain = np.where((b < least) | (d < least), -1, a**2 / (b + 1) + c**2 / (d + 1))
                whole = side_g.sum() ** 2 / (side_h.sum() + 1)
                m = int(gain.argmax()) if len(gain) else -1
                parts.append((gain[m], m + 1) if m >= 0 and gain[m] > whole else (whole, 0))
            total = parts[0][0] + parts[1][0]
            if total > best:
                best, found = total, (axis, k, parts[0][1], parts[1][1])
    out = np.zeros_like(g)
    axis, k, one, two = found
    view, gg, hh = (out, g, h) if axis == 0 else (out.T, g.T, h.T)
    for rows, m in ((slice(0, k), one), (slice(k, None), two)):
        for columns in (slice(0, m), slice(m, None)) if m else (slice(None),):
            view[rows, columns] = _leaf(gg[rows, columns], hh[rows, columns])
    return out, best - g.sum() ** 2 / (h.sum() + 1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, bins: int = BINS) -> Model:
    """Fits the model; the same rows in the same order give the same model."""
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) if len(x) else np.zeros(0) for j in range(n_features)]
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Model(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.start)
    least = max(2.0, 0.0005 * len(y) * rate * (1 - rate))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(n_features):
            g, h = slopes()
            size = len(model.single[j])
            step = RATE * _tree(np.bincount(b[j], g, size), np.bincount(b[j], h, size), 2, least)
            model.single[j] += step
            total += step[b[j]]
    # interactions: coarse joint bins of every pair against the gradient that is left
    g, h = slopes()
    gains = []
    for i in range(n_features):
        for j in range(i + 1, n_features):
            shape = len(model.single[i]), len(model.single[j])
            if min(shape) > 1:
                flat = b[i] * shape[1] + b[j]
                joint = [np.bincount(flat, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
                fold = [np.add.reduceat(np.add.reduceat(v, np.arange(0, shape[0], 4), 0), np.arange(0, shape[1], 4), 1) for v in joint]
                gains.append((float((fold[0] ** 2 / (fold[1] + 1)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    model.tables = [np.zeros((len(model.single[i]), len(model.single[j]))) for i, j in model.pairs]
    for _ in range(rounds // 8):
        for (i, j), table in zip(model.pairs, model.tables, strict=True):
            g, h = slopes()
            flat = b[i] * table.shape[1] + b[j]
            step, _ = _tree2(np.bincount(flat, g, table.size).reshape(table.shape), np.bincount(flat, h, table.size).reshape(table.shape), least)
            table += RATE * step
            total += RATE * step[b[i], b[j]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its doc_id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Model:
    """Fits to at most ``most`` labelled rows that aren't held out, whatever the tables' sizes."""
    common.prepare(docs.sparkSession)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("label"))
    sample = usable.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.batch(schema, [b.column("doc_id"), features(common.as_bytes(b.column("text"))).tolist()])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # the sample is bounded, so it can be broadcast; the rows it finds are bounded by dropDuplicates
    small = F.broadcast(sample)
    found = rows.join(small, F.col("doc_id") == F.col("label_id"), "left_semi").mapInArrow(run, "doc_id long, x array<double>").dropDuplicates(["doc_id"])
    got = found.join(small, F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "x").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("label").to_pylist(), float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of at most BINS x BINS entries
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score(features(common.as_bytes(b.column("text"))))
            yield common.batch(schema, [b.column("doc_id"), b.column("held_out"), p, (p >= 0.5).astype(np.int32)])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model predicts to be good, unchanged."""
    common.prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = shared.value.score(features(common.as_bytes(b.column(b.schema.get_field_index("text")))))
            yield b.filter(pa.array(p >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Scores every document with a model learnt from the labels that aren't held out."""
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
