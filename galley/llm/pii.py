"""Finds and masks personal data.

Base patterns (e-mail, IPv4, card, phone) are exact; a conditional random field over word
shapes adds spans that they miss, such as phone numbers without a country code, secrets
and identity numbers. A span that the field adds must hold what its kind needs (digits of
a phone, Luhn's check of a card) and must not meet a base span; base spans always stay.

A null text is empty: no spans. Repeated rows and null doc_ids are kept, other columns
are ignored by ``find`` and kept by ``mask``, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, crf

#: Kinds in the order in which spans are listed; the last two come from the field alone.
KINDS = ["email", "ip", "card", "phone", "secret", "id"]
BASE = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't start inside a run of digits: the run's first digit would have matched
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NOT_DIGITS = re.compile("[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Goes from @ to @, so that a long word without one is not tried from each of its characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
        else:
            # the characters before this @ can't be part of a later match
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns in code points, by kind as listed and then by start."""
    if not _ANY.search(text):
        return []
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def _holds(kind: str, value: str) -> bool:
    """Whether a value that the field found has what its kind needs."""
    digits = _NOT_DIGITS.sub("", value)
    if kind == "email":
        return bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", value))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value)) and all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return bool(re.fullmatch(r"[+(]?[0-9][0-9().\s-]*[0-9]", value)) and 9 <= len(digits) <= 15 and len(digits) < len(value)
    if kind == "secret":
        return len(value) >= 18 and bool(re.fullmatch("[0-9A-Za-z_+/=-]+", value)) and bool(digits) and len(digits) < len(value)
    return bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", value))


def _padded(data: np.ndarray, end: int) -> int:
    """A secret's end with the = that fill it up."""
    for _ in range(2):
        end += int(data[end] == 0x3D)
    return end


_models: dict[str, crf.Model] = {}


def model() -> crf.Model:
    """The trained field of this process (training is deterministic)."""
    if "m" not in _models:
        _models["m"] = crf.train()
    return _models["m"]


def find_many(texts: list[bytes], field: crf.Model) -> list[tuple[list[Span], list[Span]]]:
    """For each UTF-8 text: the base spans, and all spans."""
    out: list[tuple[list[Span], list[Span]]] = []
    for first, last in common.chunks(texts):
        part = texts[first:last]
        tokens = field.tokens(part)
        extra: dict[int, list[tuple[str, int, int]]] = {}
        for n, kind, a, b in crf.spans(tokens, crf.decode(field, tokens)):
            extra.setdefault(n, []).append((kind, a, b))
        chars = None
        for n, data in enumerate(part):
            base = base_spans(data.decode())
            every = base
            if n in extra:
                if chars is None:
                    chars = np.concatenate([np.zeros(1, np.int32), np.cumsum((tokens.words.data & 0xC0) != 0x80, dtype=np.int32)])
                origin = int(chars[tokens.words.text_start[n]])
                added = []
                for kind, a, b in extra[n]:
                    b = _padded(tokens.words.data, b) if kind == "secret" else b
                    x, y = int(chars[a]) - origin, int(chars[b]) - origin
                    value = tokens.words.data[a:b].tobytes().decode()
                    if _holds(kind, value) and not any(x < q and p < y for _, p, q in base):
                        added.append((kind, x, y))
                if added:
                    every = sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))
            out.append((base, every))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (of overlapping ones, their union) replaced by its kind."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, spans that the field added by kind (n_secret, n_id), a digest of the base spans and all spans."""
    common.prepare(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(model())  # some hundred kB whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for base, every in find_many(common.as_bytes(b.column("text")), field.value):
                count = dict.fromkeys(KINDS, 0)
                for kind, _, _ in base:
                    count[kind] += 1
                for kind, _, _ in every:
                    count[kind] += kind not in BASE
                rows.append((*count.values(), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            yield common.batch(_FOUND, [b.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 8)])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """The documents with all spans replaced by their kinds, and n_chars (if there) to match. A null text stays null."""
    common.prepare(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(model())
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = common.as_bytes(b.column(at))
            nulls = b.column(at).is_null().to_pylist()
            new = [None if null else masked(t.decode(), every) for t, null, (_, every) in zip(texts, nulls, find_many(texts, field.value), strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType))
    return out.select(*names)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = find(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_id")
