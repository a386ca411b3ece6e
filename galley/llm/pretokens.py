"""Splits texts into the pieces that a byte-level BPE encodes separately, and remembers their ids.

Most texts hold only ASCII and Latin letters; their pieces follow from byte classes and
are found by numpy. Texts with an apostrophe (contractions) or any other character are
split by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex

from . import common

_pattern = regex.compile(public_tokenizers.PATTERN)

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[common.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = _LETTER
_CLASS[common.byte_class((0x30, 0x39))] = _NUMBER
_CLASS[common.byte_class((0x09, 0x0D), (0x20, 0x20))] = _SPACE
#: Bytes of texts that are left to the pattern: an apostrophe, and first bytes of
#: characters from U+0080 to U+00BF and from U+0240 on.
_LEAVE = common.byte_class((0x27, 0x27), (0xC2, 0xC2), (0xC9, 0xFF))


def pieces(text: str) -> list[str]:
    """All pieces of a text, in order; joined they are the text."""
    return _pattern.findall(text)


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, each piece's start there, and for each text the index of its first piece (and at last their number)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))
    begin = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(texts) else end
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    kind = _CLASS[data]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[begin] = True
    # the last of a run of white space stands alone, or if it is a space before the next piece
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _SPACE) & start[1:n]
    last[end[end > 0] - 1] = False  # at the end of a text the run stays whole
    start[:n] |= last
    join = np.flatnonzero(last & (data == 0x20)) + 1
    start[join] = False
    start[begin] = True
    # signs among the letters: multiplication and division
    odd = _LEAVE[data]
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    at = np.flatnonzero(odd)
    if len(at):
        for i in np.unique(np.searchsorted(end, at, side="right")).tolist():
            a, b = int(begin[i]), int(end[i])
            start[a:b] = False
            sizes = [len(p.encode()) for p in pieces(texts[i].decode())]
            start[a + np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)] = True
    where = np.flatnonzero(start[:n])
    return data, where, np.searchsorted(where, np.concatenate([begin, [n]]))


def ragged(flat: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[offset : offset + size] of every pair, joined."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    return flat[np.arange(total) + np.repeat(offset - (end - size), size)]


#: Texts over so many bytes are split in parts, cut before white space after a printable ASCII sign:
#: there the pattern always ends a piece, whatever follows, and it never looks back.
PART = 1 << 20
_CUT = re.compile(rb"[\x21-\x7E](?=[ \n])")


def parts_of(text: bytes, most: int = PART) -> list[bytes]:
    """The text in parts of about ``most`` bytes whose pieces are those of the text; a part without a place to cut is longer."""
    out, at = [], 0
    while len(text) - at > most and (cut := _CUT.search(text, at + most)):
        out.append(text[at : cut.end()])
        at = cut.end()
    return [*out, text[at:]] if out else [text]


class PieceCache:
    """Encodes texts; a piece goes to the encoder only when it isn't remembered.

    encode: pieces -> (ids of all, number of ids of each). Pieces are looked up by a 64-bit
    hash, and their bytes are compared with the remembered ones; those that differ, and pieces
    over ``common.SHORT`` bytes, are encoded for themselves. When more than ``most`` are
    remembered, all are forgotten.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 500_000):
        self.encode, self.most = encode, most
        none = np.zeros(0, np.int64)
        #: Of each remembered piece, in order of hash: hash, place and number of its ids, place and number of its bytes.
        self.keys = np.zeros(0, np.uint64)
        self.offset, self.size, self.at, self.length = none, none, none, none
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.eights = common.loads(self.bytes)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and the number of ids of each."""
        cut = [parts_of(t) for t in texts]
        parts = [p for c in cut for p in c]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, b in common.chunks(parts, PART):
            i, n = self._chunk(parts[a:b])
            ids.append(i)
            counts.append(n)
        sums = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        last = np.cumsum([0, *map(len, cut)])
        return np.concatenate(ids), np.diff(sums[last])

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data, start, first = split(texts)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        length = np.diff(start, append=len(data))
        eights = common.loads(data)
        entry = np.full(len(start), -1)  # which remembered piece each is
        brief = np.flatnonzero(length <= common.SHORT)
        h = common.span_hashes(eights, start[brief], start[brief] + length[brief], 3)
        order = np.argsort(h)
        fresh = np.ones(len(h), bool)
        fresh[1:] = np.diff(h[order]) != 0
        head = brief[order[fresh]]
        keys = h[order[fresh]]
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(fresh) - 1
        self._remember(data, start[head], length[head], keys)
        at = np.searchsorted(self.keys, keys)[group]
        same = common.spans_equal(eights, start[brief], length[brief], self.eights, self.at[at], self.length[at])
        entry[brief[same]] = at[same]
        alone = np.flatnonzero(entry < 0)
        if not len(alone):
            offset, size, ids = self.offset[entry], self.size[entry], self.ids
        else:
            raw = data.tobytes()
            number: dict[bytes, int] = {}
            own = np.array([number.setdefault(raw[a : a + n], len(number)) for a, n in zip(start[alone].tolist(), length[alone].tolist(), strict=True)])
            more, count = self.encode(list(number))
            place = len(self.ids) + np.cumsum(count) - count
            offset, size = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
            held = entry >= 0
            offset[held], size[held] = self.offset[entry[held]], self.size[entry[held]]
            offset[alone], size[alone] = place[own], count[own]
            ids = np.concatenate([self.ids, more])
        sums = np.concatenate([[0], np.cumsum(size)])
        return ragged(ids, offset, size), sums[first[1:]] - sums[first[:-1]]

    def _remember(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray) -> None:
        """Encodes the pieces of which no hash is remembered. keys: the pieces' hashes, distinct and sorted."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if not len(new):
            return
        raw = data.tobytes()
        ids, size = self.encode([raw[a : a + n] for a, n in zip(start[new].tolist(), length[new].tolist(), strict=True)])
        if len(self.keys) > self.most:
            # what this chunk needs stays
            kept = at[np.setdiff1d(np.arange(len(keys)), new)]
            self.ids, self.bytes = ragged(self.ids, self.offset[kept], self.size[kept]), ragged(self.bytes, self.at[kept], self.length[kept])
            self.size, self.length, self.keys = self.size[kept], self.length[kept], self.keys[kept]
            self.offset, self.at = np.cumsum(self.size) - self.size, np.cumsum(self.length) - self.length
        place = np.searchsorted(self.keys, keys[new])
        own = length[new]
        self.offset = np.insert(self.offset, place, len(self.ids) + np.cumsum(size) - size)
        self.at = np.insert(self.at, place, len(self.bytes) + np.cumsum(own) - own)
        self.size, self.length = np.insert(self.size, place, size), np.insert(self.length, place, own)
        self.keys = np.insert(self.keys, place, keys[new])
        self.ids, self.bytes = np.concatenate([self.ids, ids]), np.concatenate([self.bytes, ragged(data, start[new], own)])
        self.eights = common.loads(self.bytes)


def binaries(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    raw = ids.astype("<u4").tobytes()
    end = 4 * np.cumsum(counts)
    return [raw[a:b] for a, b in zip((end - 4 * counts).tolist(), end.tolist(), strict=True)]
