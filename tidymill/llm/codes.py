"""Codes of vectors over small codebooks, with distances looked up for each distinct value of a dimension."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymill.llm.common import pin

BLOCK_ROWS = 4096
LARGEST = 1 << 24  # integers beyond it count as it, so that all sums stay in 64 bits
SALTS = 16


def _blocks(dim: int, scale: int, block_rows: int) -> Callable:
    """Vectors as blocks: per dimension the distinct integers of the block, and each row's place among them."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                rows = part.num_rows
                values = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(rows, dim)
                ints = np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)
                found = [np.unique(ints[:, d], return_inverse=True) for d in range(dim)]
                edges = pa.array([0, rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(edges, part.column("vec_id")),
                        pa.ListArray.from_arrays(edges, part.column("label")),
                        pa.array([[len(d) for d, _ in found]], pa.list_(pa.int32())),
                        pa.array([np.concatenate([d for d, _ in found]).astype(np.int32).tobytes()], pa.binary()),
                        pa.array([np.concatenate([c for _, c in found]).astype(np.uint16).tobytes()], pa.binary()),
                    ],
                    ["vec_id", "label", "sizes", "dictionary", "codes"],
                )

    return encode


def _decoded(block: dict) -> tuple[list[np.ndarray], np.ndarray]:
    dictionary = np.frombuffer(block["dictionary"], np.int32).astype(np.int64)
    cuts = np.cumsum(block["sizes"])
    return np.split(dictionary, cuts[:-1]), np.frombuffer(block["codes"], np.uint16).reshape(len(cuts), -1)


def _nearest(dictionaries: list[np.ndarray], codes: np.ndarray, book: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals) and squared distance to it, for one part of a block's vectors.

    Squared differences are formed once for each distinct integer and entry; a row only gathers and adds them.
    """
    width = book.shape[2]
    total = np.zeros((codes.shape[1], book.shape[1]), np.int64)
    for j in range(width):
        d = part * width + j
        table = (dictionaries[d][:, None] - book[part, :, j][None, :]) ** 2
        total += table[codes[d]]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def _sums(shared) -> Callable:
    """Per task one row for each part, entry and place: how many parts an entry has, and the sum of their integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        parts, entries, width = book.shape
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(book.shape, np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                dictionaries, codes = _decoded(block)
                for p in range(parts):
                    best, _ = _nearest(dictionaries, codes, book, p)
                    counts[p] += np.bincount(best, minlength=entries)
                    for j in range(width):
                        d = p * width + j
                        # exact: a block's sums stay far below 2^53
                        sums[p, :, j] += np.bincount(best, dictionaries[d][codes[d]], entries).astype(np.int64)
        p, e, j = (x.ravel() for x in np.indices(book.shape))
        used = counts[p, e] > 0
        columns = [p[used], e[used], j[used], counts[p, e][used], sums.ravel()[used]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "n", "total"])

    return run


def _coded(shared) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            labels = batch.column("label")
            for i, block in enumerate(batch.to_pylist()):
                dictionaries, codes = _decoded(block)
                found = [_nearest(dictionaries, codes, book, p) for p in range(book.shape[0])]
                picks = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["vec_id"], pa.int64()),
                        labels.slice(i, 1).flatten(),
                        pa.array([row.tobytes().hex() for row in picks], pa.string()),
                        pa.array(sum(far for _, far in found), pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return run


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each vector as ``parts`` codebook indices; ``vec_id, code, error, label_error, codebooks_sha256``.

    A component becomes ``floor(scale * x)``, a vector ``parts`` equal parts. Codebooks start as the parts of the
    ``entries`` smallest ids; each round assigns all parts to their nearest entry and moves an entry to the floor
    of its parts' mean. ``error`` is the squared distance left, ``label_error`` its sum over the rows of a label.

    Vectors are written once as blocks with a dictionary of values per dimension; every round reads the codes, forms
    the table of squared differences of a dictionary to all entries, and gathers and adds. A task returns one
    sum for each component of an entry, so what is shuffled and what comes to the driver is as large as a codebook.

    Defined cases: vectors that are null or hold null, NaN or infinite components are dropped. The vector length is
    that of the smallest id whose length is a positive multiple of ``parts``; vectors of another length stay,
    with null ``code`` and ``error``. Rows that repeat an id are rows of their own (ordered by components among the
    first ones); null ids come last. Integers beyond 2^24 in size count as 2^24. Fewer rows than ``entries``
    give shorter codebooks; a table without usable rows has no result rows with a code, and the digest of nothing.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part, hence 1 to 256 entries")
    if not 0 < block_rows <= 1 << 16:
        raise ValueError("places in a dictionary take 16 bits, hence 1 to 65536 rows a block")
    spark = vectors.sparkSession
    kept = vectors.select(
        vectors[id_col].cast("bigint").alias("vec_id"),
        vectors[label_col].alias("label"),
        vectors[vec_col].cast("array<double>").alias("vector"),
    ).filter(
        F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    usable = kept.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = usable.orderBy(*order).select(F.size("vector")).first()
    dim = first[0] if first else parts
    seeds = [r[0] for r in usable.filter(F.size("vector") == dim).orderBy(*order).select("vector").limit(entries).collect()]
    ints = np.clip(np.floor(np.array(seeds, float).reshape(len(seeds), dim) * scale), -LARGEST, LARGEST).astype(np.int64)
    book = ints.reshape(len(seeds), parts, dim // parts).transpose(1, 0, 2).copy()

    label = kept.schema["label"].dataType.simpleString()
    blocks = pin(
        kept.filter(F.size("vector") == dim).mapInArrow(
            _blocks(dim, scale, block_rows), f"vec_id array<bigint>, label array<{label}>, sizes array<int>, dictionary binary, codes binary"
        )
    )
    for _ in range(rounds if seeds else 0):
        shared = spark.sparkContext.broadcast(book)
        moved = blocks.select("sizes", "dictionary", "codes").mapInArrow(
            _sums(shared), "part bigint, entry bigint, place bigint, n bigint, total bigint"
        )
        book = book.copy()
        # one row for each component of an entry
        for r in moved.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            book[r.part, r.entry, r.place] = r.total // r.n
    coded = pin(
        blocks.mapInArrow(_coded(spark.sparkContext.broadcast(book)), f"vec_id bigint, label {label}, code string, error bigint")
    )
    none = F.lit(None)
    other = kept.filter(F.size("vector") != dim).select("vec_id", "label", none.cast("string").alias("code"), none.cast("bigint").alias("error"))
    rows = coded.unionByName(other).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    # a label may have a third of all rows, so each of its totals is dealt SALTS times
    totals = (
        coded.groupBy("label")
        .agg(F.sum("error").alias("label_error"))
        .select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("dealt"))
    )
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return rows.join(totals, rows["label"].eqNullSafe(totals["of"]) & (rows["salt"] == totals["dealt"]), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
