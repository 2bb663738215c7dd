"""Removal of repeated word windows: a count-min prefilter, then exact grouping of what may repeat."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymill.llm.common import mixed, pin, seeded, slices, text_bytes, texts
from tidymill.llm.shingles import Words, lowest, sequences

ROWS = 2  # of the sketch
COLUMNS = 1 << 40  # cells per row; few fall together, and a cell takes no room until it is counted
ANCHOR = 10  # words of the run that stands for a window in the sketch
_ORDERS = seeded(ROWS, 31)
PACK = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("doc", "<i8"), ("start", "<i8"), ("shard", "<i8")])


def _window_cells(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside one document: its first word, its document, and its cell in each row.

    In row r a window counts in the cell of the least of its ten-word runs in the r-th order of hashes. Equal windows
    share their runs, so no cell's count is below the number of documents that hold the window.
    """
    hashes, owners = words.hashes(41), words.owners()
    if len(hashes) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((ROWS, 0), np.int64)
    at = np.flatnonzero(owners[: len(owners) - size + 1] == owners[size - 1 :])
    run = min(ANCHOR, size)
    runs = sequences(hashes, run)
    cells = np.stack([lowest(mixed(runs ^ order), size - run + 1)[at] for order in _ORDERS])
    return at, owners[at], (mixed(cells + _ORDERS[:, None]) % np.uint64(COLUMNS)).astype(np.int64)


def _sketch(size: int):
    """A task's partial sketch: how many documents count in each cell, 2 standing for more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, owners, cells = _window_cells(Words.of(*text_bytes(part.column("text"))), size)
            for row in range(ROWS):
                new = np.ones(len(owners), bool)
                new[1:] = (cells[row, 1:] != cells[row, :-1]) | (owners[1:] != owners[:-1])
                pairs = np.unique(np.stack([cells[row, new], owners[new]], axis=1), axis=0) if new.any() else np.zeros((0, 2), np.int64)
                found, counts = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), row, np.int8)), pa.array(found), pa.array(np.minimum(counts, 2).astype(np.int32))],
                    ["row", "cell", "n"],
                )

    return run


def _own_cells(size: int):
    """Each document's different cells, by row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, owners, cells = _window_cells(Words.of(*text_bytes(part.column("text"))), size)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            for row in range(ROWS):
                new = np.ones(len(owners), bool)
                new[1:] = (cells[row, 1:] != cells[row, :-1]) | (owners[1:] != owners[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(new.sum()), row, np.int8)), pa.array(cells[row, new])]
                    + [pa.array(ids[owners[new]].astype(np.int64))],
                    ["row", "cell", "doc_id"],
                )

    return run


def _hot_mask(packed: list[bytes | None], owners: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Windows whose cells are hot in every row, judged with each document's own hot cells."""
    lists = [np.frombuffer(p, np.int64) if p else np.zeros(0, np.int64) for p in packed]
    ends = np.searchsorted(owners, np.arange(len(packed) + 1))
    hot = np.zeros(len(owners), bool)
    for i, own in enumerate(lists):
        if len(own):
            span = slice(ends[i], ends[i + 1])
            # the row is kept in the cells' highest bits
            hot[span] = np.logical_and.reduce([np.isin(cells[r, span] | (r << 48), own) for r in range(ROWS)])
    return hot


def _candidates(size: int, shards: int):
    """Windows that may repeat. A window already held by a smaller id in the slice is settled; the rest go to shards.

    Rows are either (document, settled starts) or (shard, packed windows).
    """
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("starts", pa.binary()), ("packed", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = pc.is_valid(part.column("hot"))
            part = part.filter(found)
            if not part.num_rows:
                continue
            words = Words.of(*text_bytes(part.column("text")))
            at, owners, cells = _window_cells(words, size)
            hot = _hot_mask(part.column("hot").to_pylist(), owners, cells)
            at, owners = at[hot], owners[hot]
            if not len(at):
                continue
            ids = part.column("doc_id").to_numpy().astype(np.int64)
            rows = np.zeros(len(at), PACK)
            rows["hi"], rows["lo"] = (sequences(words.hashes(seed), size)[at] for seed in (43, 47))
            rows["doc"], rows["start"] = ids[owners], at - words.bounds[owners]
            rows["shard"] = cells[0, hot] % shards  # neighbours mostly share it
            yield from _settled(rows, schema, shards)

    return run


def _settled(rows: np.ndarray, schema: pa.Schema, shards: int) -> Iterator[pa.RecordBatch]:
    """Starts of windows that a smaller id holds among these rows, by document; the smallest holders by shard."""
    order = np.lexsort((rows["start"], rows["doc"], rows["lo"], rows["hi"]))
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["hi"][1:] != rows["hi"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1])
    group = np.cumsum(new) - 1
    owner = rows["doc"][new][group]
    covered, open_ = rows[rows["doc"] > owner], rows[rows["doc"] == owner]
    out: list[tuple] = []
    covered = covered[np.lexsort((covered["start"], covered["doc"]))]
    cuts = np.flatnonzero(np.concatenate([[True], covered["doc"][1:] != covered["doc"][:-1]])) if len(covered) else []
    for start, end in zip(cuts, [*cuts[1:], len(covered)], strict=False):
        doc, starts = int(covered["doc"][start]), covered["start"][start:end].astype("<u4").tobytes()
        out.append((doc % max(shards, 1), doc, starts, None))
    if shards:
        open_ = open_[np.argsort(open_["shard"], kind="stable")]
        cuts = np.searchsorted(open_["shard"], np.arange(shards + 1))
        for s in np.unique(open_["shard"]):
            out.append((int(s), None, None, _pack(open_[cuts[s] : cuts[s + 1]])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema, strict=True)], schema=schema)


def _pack(rows: np.ndarray) -> bytes:
    """Column by column, so that equal high bytes lie together for the compressor."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in ("hi", "lo")) + rows["doc"].astype("<i8").tobytes() + rows["start"].astype("<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    count = len(raw) // 28
    rows = np.zeros(count, PACK)
    for place, (name, kind, width) in enumerate((("hi", "<u8", 8), ("lo", "<u8", 8), ("doc", "<i8", 8), ("start", "<u4", 4))):
        at = 8 * place * count
        rows[name] = np.frombuffer(raw[at : at + width * count], kind)
    return rows


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle the windows of each shard; what is settled already passes through. Rows come ordered by shard."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("starts", pa.binary()), ("packed", pa.binary())])
    held: list[bytes] = []
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            for batch in _settled(np.concatenate([_unpack(x) for x in held]), schema, 0):
                yield batch.select(["doc_id", "starts"])
            held.clear()

    for batch in batches:
        done = batch.filter(pc.is_valid(batch.column("starts")))
        if done.num_rows:
            yield done.select(["doc_id", "starts"])
        for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if packed is None:
                continue
            if shard != last:
                yield from flush()
                last = shard
            held.append(packed)
    yield from flush()


def _cut(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple] = []
            for doc_id, text, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
                words = text.encode().split()
                if found:
                    cover = np.zeros(len(words) + 1, np.int32)
                    starts = np.unique(np.frombuffer(b"".join(found), "<u4"))
                    starts = starts[starts + size <= len(words)]
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + size, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    kept = words
                out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema, strict=True)], schema=schema)

    return run


def repeated_windows(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by ``size`` consecutive words that also start in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, kept`` (the words that stay, joined by spaces) for every row.

    First pass: each task's partial count-min sketch, merged in one aggregation; cells count documents and are
    bounded by shuffle partitions, not by one task's memory. A window counts in one cell per row, that of its least
    ten-word run in the row's order, so neighbours share cells and estimates are never too low. Second pass: only
    windows whose cells all count two documents are hashed to 128 bits. Each slice settles those that a
    smaller id in the slice holds and sends one row per window and document left, packed; shards of the hash find the
    smallest id. A window in a third of all documents thus reaches its shard once per slice.

    Defined cases: null texts and texts below ``size`` words lose nothing. Windows repeated within one document only
    stay. Rows that repeat an id are one document to each other: they lose what any of them loses, at the
    same places. Rows with a null id are left as they are and do not count. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    known = rows.filter("doc_id IS NOT NULL")
    counted = known.mapInArrow(_sketch(size), "row tinyint, cell bigint, n int")
    hot = pin(counted.groupBy("row", "cell").agg(F.sum("n").alias("n")).filter("n > 1").select("row", "cell"))
    own = known.mapInArrow(_own_cells(size), "row tinyint, cell bigint, doc_id bigint")
    marked = F.col("cell").bitwiseOR(F.shiftleft(F.col("row").cast("bigint"), 48))
    hot_cells = own.join(hot, ["row", "cell"]).groupBy("doc_id").agg(F.collect_set(marked).alias("cells"))
    # the same exchange of the texts serves both joins
    with_hot = rows.join(hot_cells, "doc_id", "left").mapInArrow(_with_packed, "doc_id bigint, text string, hot binary")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 1 << max(6, (4 * partitions - 1).bit_length())  # a power of two; follows the size set for shuffles
    found = with_hot.mapInArrow(_candidates(size, shards), "shard int, doc_id bigint, starts binary, packed binary")
    settled = found.repartition("shard").sortWithinPartitions("shard").mapInArrow(_resolve, "doc_id bigint, starts binary")
    removed = settled.groupBy("doc_id").agg(F.collect_list("starts").alias("starts"))
    return rows.join(removed, "doc_id", "left").mapInArrow(
        _cut(size), "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    )


def _with_packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.array(x, np.int64).tobytes() if x else None for x in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(packed, pa.binary())], ["doc_id", "text", "hot"]
        )
