"""A linear-chain conditional random field over word shapes, in numpy.

A token is a word between white space without the punctuation around it. Its class is a
cue word, a shape met in the training table (letters folded to runs, digits one by one),
or a coarse description of any other shape. A label's score at a token is a sum of
weights for the classes of the token, of the two tokens before it and of the one after it;
pairs of labels have weights too.
Training maximises the penalised likelihood of a small labelled table with
forward-backward over padded batches; decoding is Viterbi over batches of documents.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np

from . import common

LABELS = ["O", "email", "ip", "phone", "phone+", "card", "card+", "secret", "id"]
#: The kind of span that a label belongs to; a label with + continues one.
KINDS = [x.rstrip("+") for x in LABELS]
CUES = [
    "call", "phone", "tel", "fax", "mobile", "token", "key", "secret", "password", "ssn", "passport", "card", "mail", "ip", "api", "apikey", "credential", "bearer", "auth", "text", "dial", "reach",
    "hash", "checksum", "digest", "commit", "md5", "sha", "signature", "revision", "order", "invoice", "tracking", "isbn", "version", "build", "item", "part", "serial", "page",
]
LONGEST_CUE = max(map(len, CUES))

_DIGIT = common.byte_class((0x30, 0x39))
_UPPER, _LOWER_CASE, _HIGH = common.byte_class((0x41, 0x5A)), common.byte_class((0x61, 0x7A)), common.byte_class((0x80, 0xFF))
_LETTER = _UPPER | _LOWER_CASE | _HIGH
_HEX = common.byte_class((0x30, 0x39), (0x41, 0x46), (0x61, 0x66))
#: Signs before the first letter or digit that belong to a token.
_OPEN = common.byte_class((0x2B, 0x2B), (0x28, 0x28))
#: Signs between a name and a value in one word.
_GLUE = common.byte_class((0x3D, 0x3D), (0x3A, 0x3A), (0x22, 0x22), (0x27, 0x27))
#: Byte to the sign that stands for it in a shape.
_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[_LETTER] = ord("a")
_SIGN[_DIGIT] = ord("9")

PLAIN, EDGE, CUE = 0, 1, 2
COARSE = CUE + len(CUES)
#: Coarse classes: number of digits (0, 1-2, 3-6, 7-15, more), any letters, 20 bytes or more, and signs:
#: hexadecimal only; letters, digits and _ + = / - with upper and lower case; with upper case; with lower case; others.
N_COARSE = 5 * 2 * 2 * 5
_KEY = _DIGIT | _UPPER | _LOWER_CASE | common.byte_class((0x5F, 0x5F), (0x2B, 0x2B), (0x3D, 0x3D), (0x2F, 0x2F), (0x2D, 0x2D))
SHAPES = COARSE + N_COARSE


class Tokens:
    """Classes and bounds of all words of a chunk of texts."""

    def __init__(self, texts: list[bytes], shapes: np.ndarray, cues: np.ndarray):
        """shapes, cues: sorted hashes that have classes of their own."""
        self.words = w = common.Words(texts, common.NOT_SPACE)
        data, n = w.data, len(w.data)
        self.start, self.end = w.start, w.end
        solid = (_LETTER | _DIGIT)[data]
        at = np.arange(n, dtype=np.int32)  # narrow: arrays as long as the text
        last = np.maximum.accumulate(np.where(solid, at, -1))[w.end - 1] if len(w) else w.start
        some = last >= w.start  # tokens with a letter or digit
        self.cls = np.full(len(w), PLAIN, np.int32)
        digits = np.concatenate([np.zeros(1, np.int32), np.cumsum(_DIGIT[data], dtype=np.int32)])
        special = digits[w.end] > digits[w.start]
        del digits
        signs = np.concatenate([np.zeros(1, np.int32), np.cumsum(data == 0x40, dtype=np.int32)])
        special = some & (special | (signs[w.end] > signs[w.start]))
        del signs
        plain_hashes = None
        # cue words: letters only between the outer punctuation
        ahead = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1]
        first = ahead[w.start] if len(w) else w.start
        lengths = last + 1 - first
        short = np.flatnonzero(some & ~special & (lengths >= 2) & (lengths <= LONGEST_CUE))
        if len(short):
            plain_hashes = _span_hashes(data, first[short], last[short] + 1, common.LOWER)
            k = np.minimum(np.searchsorted(cues, plain_hashes), len(cues) - 1)
            self.cls[short] = np.where(cues[k] == plain_hashes, CUE + k, PLAIN)
        pick = np.flatnonzero(special)
        self.first, self.last = w.start.copy(), w.end.copy()
        if len(pick):
            a, b = first[pick], last[pick] + 1
            for _ in range(2):  # + and ( in front
                more = (a > w.start[pick]) & _OPEN[data[np.maximum(a - 1, 0)]]
                a = a - more
            # what follows a name and its = or : counts alone
            glue = np.maximum.accumulate(np.where(_GLUE[data], at, -1))[b - 1]
            a = np.where((glue >= a) & (b - glue > 16), glue + 1, a)
            self.first[pick], self.last[pick] = a, b
            self.cls[pick] = self._special(data, a, b, shapes)

    def _special(self, data, a, b, shapes) -> np.ndarray:
        size = b - a
        end = np.cumsum(size)
        at = np.arange(end[-1]) + np.repeat(a - (end - size), size)
        own = data[at]
        sign = _SIGN[own]
        begin = end - size
        fresh = np.ones(len(sign), bool)
        fresh[1:] = (sign[1:] != sign[:-1]) | (sign[1:] != ord("a"))
        fresh[begin] = True
        kept = np.cumsum(fresh)
        stop = kept[end - 1]
        start = np.concatenate([[0], stop[:-1]])
        hashes = _span_hashes(sign[fresh], start, stop)
        k = np.minimum(np.searchsorted(shapes, hashes), max(0, len(shapes) - 1))
        known = shapes[k] == hashes if len(shapes) else np.zeros(len(a), bool)
        n_digits = np.add.reduceat(_DIGIT[own], begin, dtype=np.int64)
        letters = np.add.reduceat(_LETTER[own], begin, dtype=np.int64) > 0
        hexes = np.add.reduceat(_HEX[own], begin, dtype=np.int64) == size
        bucket = np.searchsorted([1, 3, 7, 16], n_digits, side="right")
        count = lambda some: np.add.reduceat(some[own], begin, dtype=np.int64)
        upper, lower = count(_UPPER) > 1, count(_LOWER_CASE) > 1
        signs = np.where(hexes, 0, np.where(count(_KEY) < size, 4, np.where(upper & lower, 1, np.where(upper, 2, 3))))
        coarse = COARSE + ((bucket * 2 + letters) * 2 + (size >= 20)) * 5 + signs
        # what is long and has letters has its coarse class: keys of one kind have many shapes
        return np.where(known & (letters | (n_digits > 0)) & ~((size >= 20) & letters & (signs < 4)), SHAPES + k, coarse)


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return common.span_hashes(common.loads(data if fold is None else fold[data]), start, end, 7)


def shape(token: str) -> str:
    """The shape of a token, as text."""
    return re.sub("a+", "a", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", token)))


_MARK = re.compile(r"\{(\w+):([^{}]*)\}")


def labelled_table(rows: int = 1300, seed: int = 5) -> list[str]:
    """The labelled table: sentences in which personal data are marked as {kind:value}.

    Sentence frames and ways of writing each kind are fixed; words and digits are drawn
    with a fixed seed. Half of the sentences hold no personal data, but what looks alike:
    numbers, dates, versions, amounts, checksums, revisions, orders and addresses of sites.
    """
    r = random.Random(seed)
    ends = "!#$%&*?;:.,"

    def word() -> str:
        w = "".join(r.choice(["an", "the", "ou", "er", "in", "ti", "re", "st", "l", "qu", "é", "sch", "ción", "ar"]) for _ in range(r.randint(1, 4)))
        return r.choice([w, w, w, w.capitalize(), w.upper()]) + tail(0.75)

    def tail(plain: float) -> str:
        return "" if r.random() < plain else r.choice(ends) * r.choice([1, 1, 1, 2, 3])

    def digits(form: str) -> str:
        return re.sub("9", lambda _: str(r.randint(0, 9)), form)

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(r.randint(low, high)))

    def checked(number: str) -> str:
        """The number with a last digit that checks the others, as cards have."""
        total = sum(int(d) if i % 2 else int(d) * 2 % 10 + int(d) // 5 for i, d in enumerate(re.sub("[^0-9]", "", number)[-2::-1]))
        return number[:-1] + str(-total % 10)

    def some(signs: str, n: int) -> str:
        ends = [c for c in signs if c.isalnum()]
        out = r.choice(ends) + "".join(r.choice(signs) for _ in range(n - 2)) + r.choice(ends)
        return out if any(c.isdigit() for c in out) else out[:-1] + str(r.randint(0, 9))

    low, number = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every, hexes = low + low.upper() + number, number + "abcdef"
    phones = [
        "+9 (999) 999-9999", "+99 999 999999", "(999) 999-9999", "+99 (99) 9999-9999", "999-999-9999", "999.999.9999", "+9-999-999-9999", "+9.999.999.9999", "(999)999-9999", "999 999 9999",
        "099 9999 9999", "09 99 99 99 99", "+99 9 99 99 99 99", "9-999-999-9999", "(099) 999 9999",
        "999-999-9999", "(999) 999-9999",
    ]
    kinds = {
        "email": lambda: digits(r.choice(["an.99@mail9.example.com", "ou@ther.example.org", "re_st@in-the.example.net", "er.ou@post.example.com"])),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "phone": lambda: digits(r.choice(phones)),
        "card": lambda: checked(digits(r.choice(["9999999999999999", "9999 9999 9999 9999", "9999-9999-9999-9999"]))),
        "secret": lambda: r.choice(
            [lambda: some(hexes, r.choice([32, 36, 40, 48, 64])), lambda: some(hexes, 40).upper(), lambda: r.choice(["sk_live_", "pk_test_", "ghp_", "xoxb-", "key-", "tok_"]) + some(every, r.randint(20, 40)),
             lambda: "AK" + some(low.upper() + number * r.randint(0, 2), r.randint(18, 22)), lambda: some(every + "+/", r.choice([32, 40, 43, 44])) + r.choice(["", "=", "=="]), lambda: some(every + "-_", r.randint(24, 48))]
        )(),
        "id": lambda: digits("999-99-9999"),
    }
    frames = {
        "secret": ['token = "{}"', "token = {}", 'key: "{}"', 'password = "{}"', "secret {}", "api key {}", "the token is {}", "api key = {}", "api_key={}", 'api_key="{}"', "bearer {}", "key {}", "credential: {}", 'apikey "{}"', "{}"],
        "id": ["ssn {}", "SSN: {}", "passport {}", "{}"],
        "phone": ["{}", "{}", "call {}", "tel {}", "phone: {}", "text {}", "fax {}", "dial {}", "reach me at {}"],
    }
    plain = [
        "1999", "2024-05-17", "3.14", "v2.0.1", "12", "99%", "$9.99", "10:30", "9999999", "12345678901", "999.999", "3rd", "A4", "www.example.com/9", "x@", "555-12", "(1999)", "(12)", "1 2 3 4", "version 3.", "4.0.", "99-99",
        "order 999-9999999-99", "order no. 99999999", "invoice 9999-99", "tracking 9Z999W99999999999", "ISBN 978-9-999-99999-9", "build 20240517.9", "https://www.example.com/2024/05/some-long-title-of-a-page-99", "17.05.2024",
        "1,999,999", "99.99.9999", "page 99-999", "item 99999-99", "10.9999/abc.999", "999.99 999.99", "9999 9999", "part 99-999-99", "1999-2024", "serial 999999", "9.9e99", "99x99", "some-long-name-of-a-file-2024-05-17",
    ]
    sums = ["sha256 {}", "SHA-256: {}", "md5 {}", "checksum {}", "the checksum is {}", "hash {}", "commit {}", "digest {}", "revision {}", "{} is the checksum", "commit: {}", "signature {} of the file", "hash {} is the checksum", "build {}"]
    out = []
    for n in range(rows):
        if n % 2:
            kind = r.choice([*kinds, "phone", "secret"])
            inner = f"{{{kind}:{kinds[kind]()}}}"
            frame = r.choice(frames.get(kind, ["{}"]))
            out.append(f"{words(0, 8)} {frame.format(inner) if '{}' in frame else inner}{tail(0.6)} {words(0, 8)}".strip())
        else:
            kind = r.random()
            if kind < 0.25:
                extra = r.choice(sums).format(some(hexes, r.choice([32, 40, 56, 64])))
            else:
                extra = digits(r.choice(plain)) if kind < 0.75 else r.choice([r.choice(CUES), words(1, 3)])
            out.append(f"{words(0, 8)} {extra} {words(0, 8)}".strip())
    return out


def parsed(row: str) -> tuple[bytes, list[tuple[int, int, str]]]:
    """A row's text, and the marked spans: first and last byte, kind."""
    text, marks, at = "", [], 0
    for m in _MARK.finditer(row):
        text += row[at : m.start()]
        marks.append((len(text.encode()), len((text + m[2]).encode()), m[1]))
        text += m[2]
        at = m.end()
    return (text + row[at:]).encode(), marks


def split_table(table: list[str]) -> tuple[list[str], list[str]]:
    """Rows to train on, and every fifth pair of rows, which is kept out."""
    return [x for n, x in enumerate(table) if n // 2 % 5 != 4], [x for n, x in enumerate(table) if n // 2 % 5 == 4]


@dataclass
class Model:
    shapes: np.ndarray
    cues: np.ndarray
    cue_order: np.ndarray
    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    second: np.ndarray
    step: np.ndarray
    begin: np.ndarray
    finish: np.ndarray
    #: Of a run of plain tokens among plain tokens, this many decide; 0: all are decoded.
    memory: int = 0

    def tokens(self, texts: list[bytes]) -> Tokens:
        return Tokens(texts, self.shapes, self.cues)

    def emissions(self, cls: np.ndarray, before: np.ndarray, after: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.own[cls] + self.left[before] + self.right[after] + self.second[second]


def _neighbours(cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes before and after each token of its text, and of the second before it; EDGE outside."""
    before, after = np.full(len(cls), EDGE, np.int32), np.full(len(cls), EDGE, np.int32)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    heads = first[:-1][first[:-1] < first[1:]]
    before[heads] = EDGE
    after[first[1:][first[:-1] < first[1:]] - 1] = EDGE
    second = np.full(len(cls), EDGE, np.int32)
    second[1:] = before[:-1]
    second[heads] = EDGE
    return before, after, second


def train(table: list[str] | None = None, rounds: int = 100, penalty: float = 0.02) -> Model:
    """Fits the weights to a labelled table by gradient steps with running moments (deterministic)."""
    texts, marks = zip(*map(parsed, table or split_table(labelled_table())[0]), strict=True)
    cue_hashes = _span_hashes(np.frombuffer("".join(CUES).encode(), np.uint8), *_bounds(CUES))
    cues = np.sort(cue_hashes)
    shape_hashes = []
    for text, spans in zip(texts, marks, strict=True):
        for token in text.decode().split():
            core = re.search(r"[+(]*[^\W_].*[^\W_]|[+(]*[^\W_]", token)
            if core and re.search("[0-9@]", core[0]):
                shape_hashes.append(shape(core[0]))
    forms = sorted(set(shape_hashes))
    shapes = np.sort(_span_hashes(np.frombuffer("".join(forms).encode(), np.uint8), *_bounds(forms)))
    n_cls, n_lab = SHAPES + len(shapes), len(LABELS)
    rows, gold = [], []
    for text, spans in zip(texts, marks, strict=True):
        t = Tokens([text], shapes, cues)
        labels = np.zeros(len(t.cls), int)
        for a, b, kind in spans:
            inside = np.flatnonzero((t.start < b) & (t.end > a))
            labels[inside] = LABELS.index(kind)
            if kind + "+" in LABELS:
                labels[inside[1:]] = LABELS.index(kind + "+")
        rows.append(t)
        gold.append(labels)
    length = max(len(g) for g in gold)
    size = len(gold)
    mask = np.zeros((size, length), bool)
    y = np.zeros((size, length), int)
    cls, before, after, second = (np.full((size, length), EDGE) for _ in range(4))
    for i, (t, g) in enumerate(zip(rows, gold, strict=True)):
        n = len(g)
        mask[i, :n], y[i, :n], cls[i, :n] = True, g, t.cls
        before[i, :n], after[i, :n], second[i, :n] = _neighbours(t.cls, np.array([0, n]))
    lens = mask.sum(1)
    w = {**{k: np.zeros((n_cls, n_lab)) for k in ("own", "left", "right", "second")}, "step": np.zeros((n_lab, n_lab)), "begin": np.zeros(n_lab), "finish": np.zeros(n_lab)}
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    one = np.eye(n_lab)
    at = np.arange(size)
    for turn in range(1, rounds + 1):
        emit = w["own"][cls] + w["left"][before] + w["right"][after] + w["second"][second]
        # forward and backward sums of each token, scaled to one
        e = np.exp(emit - emit.max(2, keepdims=True)).transpose(1, 0, 2)
        s, finish = np.exp(w["step"]), np.exp(w["finish"])
        alpha, beta = np.zeros((length, size, n_lab)), np.zeros((length, size, n_lab))
        alpha[0] = e[0] * np.exp(w["begin"])
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for t in range(1, length):
            new = np.where(mask[:, t, None], (alpha[t - 1] @ s) * e[t], alpha[t - 1])
            alpha[t] = new / new.sum(1, keepdims=True)
        beta[:] = finish
        for t in range(length - 2, -1, -1):
            new = np.where(mask[:, t + 1, None], (e[t + 1] * beta[t + 1]) @ s.T, finish)
            beta[t] = new / new.sum(1, keepdims=True)
        node = alpha * beta
        node = (node / node.sum(2, keepdims=True)).transpose(1, 0, 2) * mask[:, :, None]
        wrong = node - one[y] * mask[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        off = wrong[mask]
        for k, c in (("own", cls), ("left", before), ("right", after), ("second", second)):
            grad[k] += np.stack([np.bincount(c[mask], off[:, j], n_cls) for j in range(n_lab)], 1)
        for t in range(1, length):
            ahead = e[t] * beta[t]
            share = mask[:, t] / ((alpha[t - 1] @ s) * ahead).sum(1)
            grad["step"] += s * ((alpha[t - 1] * share[:, None]).T @ ahead)
            np.add.at(grad["step"], (y[:, t - 1][mask[:, t]], y[:, t][mask[:, t]]), -1)
        grad["begin"] = wrong[:, 0].sum(0)
        grad["finish"] = (node[at, lens - 1] - one[y[at, lens - 1]]).sum(0)
        for k in w:
            g = grad[k] + penalty * w[k]
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            w[k] = w[k] - 0.15 * (m1[k] / (1 - 0.9**turn)) / (np.sqrt(m2[k] / (1 - 0.99**turn)) + 1e-6)
    # labels that can't follow: a continuation without a beginning of its kind
    for k, label in enumerate(LABELS):
        if label.endswith("+"):
            w["begin"][k] = -1e4
            for j, other in enumerate(LABELS):
                if other.rstrip("+") != label.rstrip("+"):
                    w["step"][j, k] = -1e4
    order = np.argsort(cue_hashes)
    model = Model(shapes, cues, order, w["own"], w["left"], w["right"], w["second"], w["step"], w["begin"], w["finish"])
    model.memory = _memory(model)
    return model


def _bounds(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    end = np.cumsum([len(p.encode()) for p in parts])
    return end - [len(p.encode()) for p in parts], end


def _memory(model: Model, most: int = 64) -> int:
    """After how many plain tokens one more only adds a constant to the best score between any two labels.

    From there on a longer run has the same best paths, with O in its middle, so it can
    be cut to this length without a change of any other label.
    """
    plain = np.array([PLAIN])
    step = model.step + model.emissions(plain, plain, plain, plain)
    constant = step[0, 0]
    power = step.copy()
    for k in range(1, most):
        longer = (power[:, :, None] + step[None]).max(1)
        if np.allclose(longer, power + constant, rtol=0, atol=1e-9):
            # the middle of a path through 2k tokens is O
            both = power[:, :, None] + power[None]
            if (both.argmax(1) == 0).all():
                return 2 * k
        power = longer
    return 0


def decode(model: Model, tokens: Tokens) -> np.ndarray:
    """The best label of every token (Viterbi over all texts of the chunk at once)."""
    cls, first = tokens.cls, tokens.words.first
    labels = np.zeros(len(cls), np.int8)
    if not len(cls):
        return labels
    before, after, second = _neighbours(cls, first)
    keep = np.ones(len(cls), bool)
    if model.memory:
        idle = (cls == PLAIN) & (before == PLAIN) & (after == PLAIN) & (second == PLAIN)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], idle, [False]]).astype(np.int8)))
        run, stop = edge[::2], edge[1::2]
        half = model.memory // 2
        long = stop - run > model.memory
        for a, b in ((run[long] + half, stop[long] - half),):
            cut = np.zeros(len(cls) + 1, np.int64)
            cut[a] += 1
            cut[b] -= 1
            keep = np.cumsum(cut[:-1]) == 0
    at = np.flatnonzero(keep)
    firsts = np.searchsorted(at, first)
    sizes = np.diff(firsts)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    begin, sizes = firsts[:-1][order], sizes[order]
    n_lab = len(LABELS)
    back = []
    score = None
    for t in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t
        here = at[begin[:live] + t]
        emit = model.emissions(cls[here], before[here], after[here], second[here])
        if t == 0:
            score = emit + model.begin
            final = score.copy()
            continue
        paths = score[:live, :, None] + model.step
        best = paths.argmax(1)
        score = np.take_along_axis(paths, best[:, None, :], 1)[:, 0] + emit
        final[:live] = score
        back.append(best.astype(np.int8))
    state = (final + model.finish).argmax(1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -t, side="left"))
        labels[at[begin[:live] + t]] = state[:live]
        if t:
            best = back[t - 1]
            state[: len(best)] = best[np.arange(len(best)), state[: len(best)]]
    assert n_lab == model.step.shape[0]
    return labels


def spans(tokens: Tokens, labels: np.ndarray) -> list[tuple[int, str, int, int]]:
    """text, kind, start, end (bytes in the chunk) of each run of labelled tokens."""
    out: list[tuple[int, str, int, int]] = []
    hit = np.flatnonzero(labels)
    text = np.searchsorted(tokens.words.first, hit, side="right") - 1
    for i, n in zip(hit.tolist(), text.tolist(), strict=True):
        label = int(labels[i])
        a, b = int(tokens.first[i]), int(tokens.last[i])
        if LABELS[label].endswith("+") and out and out[-1][0] == n and out[-1][1] == KINDS[label]:
            out[-1] = (n, KINDS[label], out[-1][2], b)
        else:
            out.append((n, KINDS[label], a, b))
    return out
