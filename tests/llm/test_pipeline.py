import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import __spark_entry__
import corpus_pipeline
from galley.llm import bpe, pii, quality

from .test_bpe_and_files import thue_morse
from .test_text_operators import DOCS, brute_groups, brute_hits, brute_print


def test_pipeline_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = model.score(quality.features([t.encode() for t in docs.values()]))
    good = {d: t for (d, t), s in zip(docs.items(), scores, strict=True) if s >= 0.5}
    groups = brute_groups({d: brute_print(t) for d, t in good.items()})
    single = {d: t for d, t in good.items() if groups[d] == d}
    hits = brute_hits(list(single.items()), bench)
    clean = {d: t for d, t in single.items() if not hits[d][3]}
    assert len(docs) > len(good) > len(single) > len(clean) > 0
    field = pii.model()
    masked = {d: pii.masked(t, pii.find_many([t.encode()], field)[0][1]) for d, t in clean.items()}
    codec = bpe.codec(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in masked.items()}


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Nulls in every column, shared doc_ids, repeated rows, extra columns and texts with equal polynomial hashes: a stage drops only what it judges."""
    one, other = thue_morse(11, "a", "b")
    rows = [
        (1, "good words of the first kind", "en", "s", 28, 1), (1, "good words of the first kind", "en", "s", 28, 1), (None, "quite other words without an id", None, None, None, None), (None, None, "en", "s", 0, 1),
        (3, f"mail a.b@example.org about {one}", "en", "s", 9, 1), (3, f"{other} and one more", "en", "s", 9, 1), (4, "", "en", "s", 0, 1), (5, "the benchmark asks this question", "en", "s", 9, 1), (None, "two of them", "en", "s", 9, 1),
    ]
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "Benchmark asks this"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, None), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")], name
        steps.append(sorted((str(r.doc_id), str(r.text)[:20]) for r in docs.collect()))
    key = lambda some: sorted((str(d), str(t)[:20]) for d, t, *_ in some)
    single = [rows[0], *rows[2:3], *rows[4:]]  # the null text is like the empty one, which has a doc_id
    assert steps[0] == key(rows) and steps[1] == key(single) and steps[2] == key(r for r in single if r[0] != 5)
    assert [t for d, t in steps[3] if t.startswith("mail")] == ["mail <EMAIL> about a"]
    out = {(r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    texts = [(d, t.replace("a.b@example.org", "<EMAIL>")) for d, t, *_ in single if d != 5]
    assert out == {(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in texts}
    for name in ("documents", "benchmark", "labels"):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        table.limit(0).write.parquet(f"{folder}/empty/{name}.parquet")
    empty = corpus_pipeline.run(spark, f"{folder}/empty")
    assert empty.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and empty.count() == 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
