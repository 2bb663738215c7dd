"""A quality classifier: averaged subword vectors with a softmax, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymill.llm.common import mixed, seeded, slices, text_bytes, texts

BUCKETS = 1 << 16
SIZES = (2, 3, 4)  # characters of an n-gram
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE = seeded(256, 7)


def _characters(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of all characters, and a hash of each."""
    lead = ((data & 0xC0) != 0x80) | first
    at = np.flatnonzero(lead)
    if len(at) == len(data):
        return at, BYTE[data]
    inside = np.arange(len(data)) - at[np.cumsum(lead) - 1]
    whole = np.add.reduceat(data.astype(np.uint64) << (8 * inside).astype(np.uint64), at)
    return at, np.where(whole < 128, BYTE[data[at]], mixed(whole))


def features(data: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words and character n-grams, as (places of their first bytes, buckets) per kind.

    ``first`` marks the first byte of each document; nothing crosses into the next one.
    """
    places, codes = _characters(data, first)
    boundary = np.cumsum(first)[places]
    grams = codes
    for size in range(2, max(SIZES) + 1):
        grams = mixed(grams[:-1] + (codes[size - 1 :] << np.uint64(1)) + np.uint64(size))
        if size in SIZES:
            at = np.flatnonzero(boundary[: len(grams)] == boundary[size - 1 :])
            yield places[at], (grams[at] & np.uint64(BUCKETS - 1)).astype(np.int64)
    word = ~SPACE[data]
    starts = np.flatnonzero(word & (np.concatenate([[True], ~word[:-1]]) | first))
    if len(starts):
        ends = np.flatnonzero(word & np.concatenate([~word[1:] | first[1:], [True]])) + 1
        size = ends - starts
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        letters = BYTE[data[word]]
        placed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(letters + inside.astype(np.uint64)))])
        last = np.cumsum(size)
        yield starts, (mixed(placed[last] - placed[last - size]) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _document_sums(part: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document the sum of its features' weights, and their number."""
    data, offsets = text_bytes(part.column("text"))
    sums, counts = np.zeros(part.num_rows), np.zeros(part.num_rows)
    if not len(data):
        return sums, counts
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    for at, buckets in features(data, first):
        cuts = np.searchsorted(at, offsets)
        total = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
        sums += total[cuts[1:]] - total[cuts[:-1]]
        counts += np.diff(cuts)
    return sums, counts


@dataclass(frozen=True)
class Model:
    """Each bucket's vector is only used by its two products with the softmax, whose difference is kept."""

    weights: np.ndarray
    bias: float

    def scores(self, part: pa.RecordBatch) -> np.ndarray:
        sums, counts = _document_sums(part, self.weights)
        margin = np.where(counts > 0, sums / np.maximum(counts, 1), 0.0) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def _histograms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=1 << 20):
        for row in range(part.num_rows):
            data, _ = text_bytes(part.column("text").slice(row, 1))
            counts = used = np.zeros(0, np.int64)
            if len(data):
                first = np.zeros(len(data), bool)
                first[0] = True
                counts = np.bincount(np.concatenate([b for _, b in features(data, first)]), minlength=BUCKETS)
                used = np.flatnonzero(counts)
                counts = counts[used]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").slice(row, 1), part.column("label").slice(row, 1)]
                + [pa.array([used.astype("<u4").tobytes()]), pa.array([counts.astype("<u4").tobytes()])],
                ["doc_id", "label", "buckets", "counts"],
            )


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]], dims: int = 8, epochs: int = 6, rate: float = 0.3, seed: int = 11) -> Model:
    """Train vectors and softmax on (label, buckets, counts); plain stochastic gradient descent."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, dims)).astype(np.float32) / dims
    output, bias = rng.uniform(-0.1, 0.1, (dims, 2)).astype(np.float32), np.zeros(2, np.float32)
    totals = np.bincount([label for label, _, _ in rows], minlength=2)
    share = len(rows) / (2 * np.maximum(totals, 1))  # both labels weigh the same
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for index in rng.permutation(len(rows)):
            label, buckets, counts = rows[index]
            step = rate * (1 - done / steps) * min(share[label], 3.0)
            done += 1
            part = counts / max(counts.sum(), 1)
            hidden = part @ vectors[buckets] if len(buckets) else np.zeros(dims, np.float32)
            logits = hidden @ output + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[label] -= 1
            back = output @ wrong
            output -= step * np.outer(hidden, wrong)
            bias -= 0.1 * step * wrong
            if len(buckets):
                # a document's features are many and small: scaled so that its mean moves by one step
                vectors[buckets] -= (step / (part @ part)) * part[:, None] * back
    difference = (output[:, 1] - output[:, 0]).astype(np.float32)
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on whole texts of at most ``sample`` labelled rows, those with the smallest hashes of their id.

    ``labels`` has ``doc_id`` and ``label`` (0 or 1). ``sample`` bounds what the driver and the join hold; scoring is
    not limited by it. Of rows that repeat an id one is taken, whose histogram is first in byte order, so neither copies nor
    different texts under one id add to what is collected. Without any labelled text every score is 0.5.
    """
    chosen = (
        labels.filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    found = (
        texts(docs, id_col, text_col)
        .join(F.broadcast(chosen), "doc_id")  # at most `sample` rows
        .mapInArrow(_histograms, "doc_id bigint, label int, buckets binary, counts binary")
        .groupBy("doc_id", "label")
        .agg(F.min(F.struct("buckets", "counts")).alias("_one"))  # an id may have many rows; one of them is learned from
        .select("doc_id", "label", "_one.buckets", "_one.counts")
        .collect()  # at most `sample` rows
    )
    rows = sorted(found, key=lambda r: (r["doc_id"], bytes(r["buckets"])))
    unpack = lambda x: np.frombuffer(bytes(x), "<u4").astype(np.int64)
    return descend([(r["label"], unpack(r["buckets"]), unpack(r["counts"]).astype(np.float32)) for r in rows])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: the probability of label 1, from the whole text alone.

    Defined cases: null and empty texts get the score of no evidence (the model's bias); repeated rows and null
    ids are scored like others; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part))], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns whose text scores at least ``threshold`` (null text: as empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, 1 << 20):
            plain = pa.RecordBatch.from_arrays([part.column(text_col).fill_null("")], ["text"])
            yield part.filter(pa.array(model.scores(plain) >= threshold))

    return docs.mapInArrow(run, docs.schema)

