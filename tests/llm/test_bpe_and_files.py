import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from galley.llm import bpe, common, pretokens, token_files

SIGNS = ["a", "b", " ", "\n", "é", "日", "'s", "😀", "aa", "the", "1", "  ", "\x85", "-", "\t", "×", "٣", "\x1c", "\xa0", "ɐ", "!", "<|endoftext|>", "x", " ", "ü"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def texts(n, seed=1):
    r = random.Random(seed)
    plain = ["", " ", "\n\n", "a" * 500, "ab" * 700, "  x  ", "don't  stop"]
    return plain + ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_pieces_from_byte_classes_are_the_patterns():
    for text in texts(1500):
        data, start, first = pretokens.split([text.encode()])
        raw, bounds = data.tobytes(), [*start.tolist(), len(data)]
        assert [raw[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)] == pretokens.pieces(text)


def test_ids_equal_the_librarys_and_decode(codec, reference):
    for text in texts(800):
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_many_texts_at_once_and_a_full_cache(codec, reference):
    cache = pretokens.PieceCache(codec.encode_pieces, most=50)
    many = texts(300, 2)
    ids, counts = cache.texts([t.encode() for t in many])
    assert pretokens.binaries(ids, counts) == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in many]


def test_a_very_long_piece(codec, reference):
    for piece in ("ab" * 40_000, "a" * 30_000, "".join(random.Random(4).choice("abcdefgh") for _ in range(50_000))):
        assert codec.encode(piece) == reference.encode_ordinary(piece)


def thue_morse(steps, a, b):
    """Two texts with equal polynomial hashes modulo 2^64, whatever the odd base."""
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


TWINS = [t for n in (3, 5, 10, 11, 12) for pair in (("a", "b"), ("é", "ü")) for t in thue_morse(n, *pair)]


def test_texts_with_equal_hashes(codec, reference, monkeypatch):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = [*TWINS, *texts(300, 3), "word don't  \n x. " * 80_000, "x" * 70 + " " + "x" * 71]
    plain = common.span_hashes
    for fewer in (None, 500, 1):  # then with few different hashes
        if fewer:
            monkeypatch.setattr(common, "span_hashes", lambda e, a, b, seed: plain(e, a, b, seed) % np.uint64(fewer))  # noqa: B023
        ids, counts = pretokens.PieceCache(codec.encode_pieces).texts([t.encode() for t in some])
        assert pretokens.binaries(ids, counts) == [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in some]
        ids, counts = token_files.Encoder(P.path("byte_bpe_50k.json")).texts([t.encode() for t in some])
        assert pretokens.binaries(ids, counts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_parts_of_long_texts():
    r = random.Random(7)
    for text in texts(400, 8):
        many = text * r.randint(1, 30)
        parts = pretokens.parts_of(many.encode(), 16)
        assert b"".join(parts) == many.encode()
        assert [x for p in parts for x in pretokens.pieces(p.decode())] == pretokens.pieces(many)
    assert len(pretokens.parts_of(b"one two " * 100, 16)) > 30


def test_queue_order():
    q = bpe.RankQueue()
    q.push(np.array([70_000, 5, -1, 5, 64]), np.array([1, 9, 2, 3, 4]))
    assert q.first() == 5 and q.pop(5).tolist() == [3, 9]
    assert q.first() == 64 and q.pop(64).tolist() == [4]
    assert q.first() == 70_000 and q.pop(70_000).tolist() == [1] and q.first() == -1


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


ROWS = [(3, "hello world", 1), (1, None, 2), (2, "", 3), (2, "ab" * 5000, 4), (None, "x", 5), (7, "hello world", 6)]


def test_encode_and_decode_frames(spark):
    out = bpe.decode(bpe.encode(documents(spark, ROWS))).collect()
    assert sorted((r.text_bytes.decode(), r.n_tokens) for r in out) == sorted((t or "", len(bpe.codec(P.path("byte_bpe_50k.tiktoken")).encode(t or ""))) for _, t, _ in ROWS)
    assert bpe.encode(documents(spark, [])).count() == 0


def test_files_round_trip(spark, tmp_path):
    files = token_files.write(documents(spark, ROWS))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = files.documents().collect()
    expected = sorted(([*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in ROWS), key=str)
    assert sorted((np.frombuffer(r.ids, "<u4").tolist() for r in got), key=str) == expected
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, 1, 2, 2, 3, 7]
    starts = np.cumsum([0, *(len(r.ids) // 4 for r in order)])[:-1]
    assert [r.start for r in order] == starts.tolist()
    found = files.lookup([3, 7, 99])
    assert found[3][0].tolist() == found[7][0].tolist() and found[99] == []
    assert token_files.write(documents(spark, [])).documents().count() == 0


def test_added_tokens_are_recognised(spark):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert 50256 in library.encode("a<|endoftext|>b", add_special_tokens=False).ids
    some = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|", "", *texts(200, 5)]
    files = token_files.write(documents(spark, [(i, t, 1) for i, t in enumerate(some)]))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in files.documents().collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(some)}


def test_query_equals_the_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, expected = 0, {}
    for d in sorted(docs):
        ids = [*library.encode(docs[d], add_special_tokens=False).ids, 0]
        expected[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op3_token_files(spark, sf_dir).collect()} == expected


def test_op10_equals_the_library(spark, sf_dir, reference):
    import hashlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in bpe.op10_byte_bpe(spark, sf_dir).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_equal_doc_ids_have_one_order(spark):
    rows = [(5, f"text {i % 7}", 0) for i in range(60)] + [(None, "same", 0)] * 30 + [(d, "same", 0) for d in range(9)]
    expected = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        files = token_files.write(documents(spark, rows).repartition(3), text_bytes=40)
        assert files.manifest.count() > 1
        got = sorted((r.start, -1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in files.documents().collect())
        assert [d for _, d, _ in got] == sorted(d for _, d, _ in got) and [s for s, _, _ in got] == np.cumsum([0, *(len(x) // 4 for _, _, x in got)])[:-1].tolist()
        assert expected in (None, got)
        expected = got
        assert len(files.lookup([5])[5]) == 61


def test_damage_is_found(tmp_path):
    path = str(tmp_path / "f.zst")
    w = token_files.Writer(path)
    for i in range(5):
        w.add(i, struct.pack("<4I", i, 1, 2, 3))
    w.close()
    reader = token_files.Reader(path)
    assert len(reader) == 5 and reader.read(3).tolist() == [3, 1, 2, 3] and reader.find(4)[0].tolist() == [4, 1, 2, 3]
    data = bytearray(open(path, "rb").read())
    import zstandard

    # any zstandard tool reads the frames and skips the rest
    assert zstandard.ZstdDecompressor().stream_reader(bytes(data), read_across_frames=True).read()[:16] == struct.pack("<4I", 0, 1, 2, 3)
    data[int(reader.offsets[2]) + 10] ^= 1
    (tmp_path / "g.zst").write_bytes(data)
    bad = token_files.Reader(str(tmp_path / "g.zst"))
    assert bad.read(1).tolist() == [1, 1, 2, 3]
    with pytest.raises(token_files.BadFile):
        bad.read(2)
    (tmp_path / "h.zst").write_bytes(data[:-5])
    with pytest.raises(token_files.BadFile):
        token_files.Reader(str(tmp_path / "h.zst"))
