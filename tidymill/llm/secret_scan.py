"""Secrets in texts: fixed rules, and character Markov models for random strings no rule names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymill.llm.common import slices, text_bytes, texts

# fixed values: the three rules, in the order their spans are listed
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run of these characters cannot hold a match
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = (b"passw", b"secret", b"token", b"api")

TOKEN = np.zeros(256, bool)  # characters of keys and identifiers
TOKEN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8)] = True
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

Span = tuple[int, int, int]  # start, place of its kind in KINDS, end


def rule_spans(text: str, raw: bytes) -> list[Span]:
    """Matches of the three rules in code points, leftmost and not overlapping within a kind."""
    spans: list[Span] = []
    lower = raw.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _in_bytes(text: str, raw: bytes, spans: list[Span]) -> list[tuple[int, int]]:
    if len(raw) == len(text):
        return [(s, e) for s, _, e in spans]
    return [(len(text[:s].encode()), len(text[:e].encode())) for s, _, e in spans]


def _pairs(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For each byte inside a token, its predecessor (0 at a token's start) and itself as one number."""
    before = np.zeros(len(data), np.int64)
    before[1:] = np.where(inside[:-1], data[:-1], 0)
    return (before * 256 + data)[inside]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of characters in rule matches (1) and in all other tokens (0), summed over the task."""
    totals = np.zeros((2, 65536), np.int64)
    for part in slices(batches):
        data, offsets = text_bytes(part.column("text"))
        token, labelled = TOKEN[data], np.zeros(len(data), bool)
        for row, text in enumerate(part.column("text").to_pylist()):
            at = int(offsets[row])
            raw = text.encode()
            for start, end in _in_bytes(text, raw, rule_spans(text, raw)):
                labelled[at + start : at + end] = True
        ends = offsets[1:-1]
        edge = ends[(ends > 0) & (ends < len(data))]
        if len(data):
            token[edge] &= ~token[edge - 1]  # a token does not go on in the next document
        totals[1] += np.bincount(_pairs(data, token & labelled), minlength=65536)
        totals[0] += np.bincount(_pairs(data, token & ~labelled), minlength=65536)
    kind, pair = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays(
        [pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(totals[kind, pair])], ["label", "pair", "n"]
    )


def train_markov(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, random over ordinary, as a table of 65,536 numbers.

    Two first-order models are counted over every document: strings that the rules label as secrets, and
    all other tokens. The driver receives at most 131,072 sums, whatever the size of the table.
    """
    rows = texts(docs, id_col, text_col).mapInArrow(_count, "label int, pair int, n bigint")
    sums = rows.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()  # bounded: 2 x 65,536 rows
    counts = np.zeros((2, 256, 256))
    for row in sums:
        counts[row["label"], row["pair"] >> 8, row["pair"] & 255] = row["n"]
    counts[:, :, TOKEN] += prior
    logs = np.log(counts / np.maximum(counts.sum(axis=2, keepdims=True), 1e-9) + 1e-300)
    return np.where(TOKEN[None, :], logs[1] - logs[0], 0.0).astype(np.float32).ravel()


def _token_runs(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    inside = TOKEN[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    long = ends - starts >= min_chars
    return starts[long], ends[long]


def random_spans(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray, min_chars: int, per_char: float, total: float):
    """Byte spans of tokens that the random model explains better by the two thresholds."""
    starts, ends = _token_runs(data, offsets, min_chars)
    if not len(starts):
        return starts, ends
    pairs = np.zeros(len(data), np.int64)
    pairs[1:] = data[:-1].astype(np.int64) * 256
    pairs += data
    pairs[starts] = data[starts]
    sums = np.concatenate([[0.0], np.cumsum(ratios[pairs], dtype=np.float64)])
    ratio = sums[ends] - sums[starts]
    hit = (ratio >= total) & (ratio >= per_char * (ends - starts))
    return starts[hit], ends[hit]


def _spans_of(part: pa.RecordBatch, column: str, ratios: np.ndarray, min_chars: int, per_char: float, total: float) -> list[list[Span]]:
    texts_, (data, offsets) = part.column(column).to_pylist(), text_bytes(part.column(column))
    starts, ends = random_spans(data, offsets, ratios, min_chars, per_char, total)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    more: dict[int, list[tuple[int, int]]] = {}
    for row, start, end in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
        more.setdefault(row, []).append((start - int(offsets[row]), end - int(offsets[row])))
    out = []
    for row, text in enumerate(texts_):
        raw = text.encode()
        spans = rule_spans(text, raw)
        for start, end in more.get(row, ()):
            start, end = len(raw[:start].decode()), len(raw[:end].decode())
            if all(e <= start or s >= end for s, _, e in spans):
                spans.append((start, 3, end))
        out.append(sorted(spans))
    return out


def find_secrets(
    docs: DataFrame,
    ratios: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    per_char: float = 1.0,
    total: float = 25.0,
) -> DataFrame:
    """``doc_id, spans`` for every row; spans are (kind, start, end) in code points, ordered by start and kind.

    Spans of the rules (assign, access, hex) always stay. A token of at least ``min_chars`` characters that
    touches none of them is a ``random`` span when its log-likelihood ratio reaches ``total`` and
    ``per_char`` times its length.

    Defined cases: null and empty texts have no spans; texts of any length are read whole; each row is
    judged alone, so repeated rows and null ids are returned as they come.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in slices(batches):
            found = _spans_of(part, "text", ratios, min_chars, per_char, total)
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def redact_secrets(
    docs: DataFrame,
    ratios: np.ndarray,
    text_col: str = "text",
    mark: str = "[secret]",
    min_chars: int = 20,
    per_char: float = 1.0,
    total: float = 25.0,
) -> DataFrame:
    """All rows and columns of ``docs``; in the texts each span is replaced by ``mark`` (overlapping spans by one)."""

    def hidden(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for start, _, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            place = part.schema.get_field_index(text_col)
            known = part.column(place)
            filled = part.set_column(place, text_col, known.fill_null(""))
            found = _spans_of(filled, text_col, ratios, min_chars, per_char, total)
            new = [hidden(t, s) if s else t for t, s in zip(known.to_pylist(), found, strict=True)]
            yield part.set_column(place, text_col, pa.array(new, known.type))

    return docs.mapInArrow(run, docs.schema)
