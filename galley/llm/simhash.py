"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits meet in a third that differs from
either in at most one. So every distinct fingerprint emits itself and its 64 one-bit
variants; the shuffle is on variants; all fingerprints in a variant's bucket (65 at most,
by construction) lie within two bits of each other and are linked to the least of them.
Links that several buckets find are made distinct and verified by counting bits, and
components of links are the groups. Exact copies share a fingerprint and enter once.

A null text is empty: it has the fingerprint zero and is linked like any other. Repeated
rows and null doc_ids are kept (a null never names a group unless all its doc_ids are
null). Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints whose variants a task makes: some 30 MB of rows.
BALLS = 1 << 14


def fingerprint_many(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each UTF-8 text, unsigned."""
    words = common.Words(texts, common.NOT_SPACE)
    data, start, end = words.joined(common.LOWER)
    first = words.first
    count = np.diff(first)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    out = np.zeros(len(texts), np.uint64)
    total = int(shingles.sum())
    if not total:
        return out
    begin = np.cumsum(shingles) - shingles
    left = np.arange(total) + np.repeat(first[:-1] - begin, shingles)
    right = left + np.repeat(np.minimum(count, SHINGLE) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(start[left].tolist(), end[right].tolist(), strict=True)), "<u8", total)
    some = np.flatnonzero(shingles)
    step = 1 << 17  # shingles whose bits are unpacked at once
    ones = np.zeros((len(some), 64), np.int64)
    owner = np.repeat(np.arange(len(some)), shingles[some])
    for a in range(0, total, step):
        bits = np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[a : a + step]
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    most = (2 * ones > shingles[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, fp, others: each text's fingerprint as a signed long of the same bits, and further columns of longs."""
    common.prepare(docs.sparkSession)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "fp", *others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = common.as_bytes(b.column("text"))
            parts = [fingerprint_many(texts[i:j]) for i, j in common.chunks(texts)]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield common.batch(schema, [b.column("doc_id"), fp.view(np.int64), *(b.column(n) for n in others)])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *others)
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in ("doc_id", "fp", *others)))


def links(nodes: DataFrame) -> DataFrame:
    """a, b: pairs of distinct fingerprints within the radius, enough of them to connect every group."""
    # 65 rows come of each: spread them over tasks first, whatever a coalesced shuffle left
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // BALLS))
    nodes = nodes.select("fp").repartition(parts, "fp")
    variant = F.when(F.col("i") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, i)")))
    balls = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select("fp", variant.alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    pairs = balls.select("fp", least.alias("m")).where("fp <> m").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))) <= RADIUS).select(F.col("fp").alias("a"), F.col("m").alias("b"))


def _rooted(prints: DataFrame, least: Column) -> DataFrame:
    """fp, least, root of each distinct fingerprint: the aggregate of its rows, and the fingerprint that stands for its group."""
    nodes = common.stored(prints.groupBy("fp").agg(least.alias("least")), "nodes")
    roots = components(links(nodes))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the least doc_id of the row's group."""
    prints = common.stored(fingerprints(docs), "simhash")
    rooted = _rooted(prints, F.min("doc_id"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    # a fingerprint may hold a third of all rows: this join is one that Spark can split
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_survivors(docs: DataFrame) -> DataFrame:
    """One row of every group, whatever its doc_id: the least doc_id, nulls last, then the least hash of its text.

    Rows that share a doc_id but lie in different groups all stay.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # two hashes of the text, 128 bits, stand for it beside the doc_id
    keyed = docs.withColumns({"_id": docs["doc_id"].cast("long"), "_h": F.xxhash64(text), "_k": F.xxhash64(F.lit(1), text)})
    prints = common.stored(fingerprints(keyed, "_h", "_k"), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_h").alias("h"), F.col("_k").alias("k")))
    kept = _rooted(prints, first).groupBy("root").agg(F.min("least").alias("s")).select("s.id", "s.h", "s.k")
    same = keyed["_id"].eqNullSafe(kept["id"]) & (keyed["_h"] == kept["h"]) & (keyed["_k"] == kept["k"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_id", "_h", "_k"]).select(*docs.columns)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
