"""Packing of documents into token sequences of one length: concatenate and cut."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidymill.llm.common import pin, slices, texts

Encode = Callable[[str], list[int]]


@cache
def byte_bpe(ranks_path: str, pattern: str, end_name: str = "<|endoftext|>", end_id: int = 50256) -> Encode:
    """The byte-level vocabulary behind a file of ranks, loaded once per Python worker.

    Gives the ids of the same vocabulary in the tokenizers library, which needs four times the time; there,
    too, the end mark's own name in a text is its one id.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={end_name: end_id})
    allowed = {end_name}

    def encode(text: str) -> list[int]:
        if end_name in text:
            return model.encode(text, allowed_special=allowed, disallowed_special=())
        return model.encode_ordinary(text)

    return encode


def _tokenized(load: Callable[[], Encode], separator: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, before = load(), TaskContext.get().partitionId(), 0
        for part in slices(batches, limit=1 << 20):
            ids = [np.array([*encode(text), separator], "<u4") for text in part.column("text").to_pylist()]
            counts = np.array([len(x) for x in ids], np.int64)
            ends = before + np.cumsum(counts)
            narrow = [(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.full(len(ids), task, np.int32)), pa.array(ends - counts)]
                + [pa.array(counts), pa.array(narrow, pa.binary())],
                ["doc_id", "task", "task_start", "doc_tokens", "ids"],
            )
            before = int(ends[-1])

    return run


def _pieces(length: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ids", 1 << 20):
            out: list[tuple] = []
            rows = zip(*(part.column(c).to_pylist() for c in ("doc_id", "at", "doc_tokens", "ids")), strict=True)
            for doc_id, at, count, raw in rows:
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4").astype("<u4")
                start = 0
                while start < count:
                    sequence, offset = divmod(at + start, length)
                    size = min(count - start, length - offset)
                    piece = ids[start : start + size].tobytes()
                    out.append((doc_id, start, size, zlib.crc32(piece), count, sequence, offset, piece))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema, strict=False)], schema=schema)

    return run


def packed_pieces(
    docs: DataFrame,
    load: Callable[[], Encode],
    length: int = 2048,
    separator: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Concatenate the documents' ids, each followed by ``separator``, and cut every ``length`` ids.

    Returns one row per piece: ``doc_id, start`` (ids of its document before it), ``length, ids_crc32,
    doc_tokens, sequence_id, offset``, and the piece's little-endian 32-bit ``ids`` on request. Only the
    last sequence can be shorter than ``length``.

    First pass: tokenize, number the ids within each task, write both down. The task totals, one row per
    task, are summed up and give each task its global offset; the second pass adds the offsets and cuts. A
    document across a window's end gives one piece per window. Nothing depends on a global order by key.

    Defined cases: null and empty texts are the separator alone. Long documents span as many sequences as
    they need. Repeated rows and null ids are packed like all others. An empty table gives no pieces.
    """
    tokens = pin(
        texts(docs, id_col, text_col).mapInArrow(
            _tokenized(load, separator), "doc_id bigint, task int, task_start bigint, doc_tokens bigint, ids binary"
        )
    )
    totals = tokens.groupBy("task").agg(F.sum("doc_tokens").alias("n"))
    # one row per task of the first pass
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    fields = [pa.field(x.split()[0], pa.int64()) for x in schema.split(", ")]
    if with_ids:
        schema, fields = schema + ", ids binary", [*fields, pa.field("ids", pa.binary())]
    return (
        tokens.join(F.broadcast(bases), "task")  # one row per task of the first pass, 16 bytes each
        .select("doc_id", (F.col("base") + F.col("task_start")).alias("at"), "doc_tokens", "ids")
        .mapInArrow(_pieces(length, pa.schema(fields)), schema)
    )


def padded_length(tokens: int, length: int = 2048) -> int:
    """The length a sequence is stored with: ``length``, unless it holds a power of two already."""
    return tokens if tokens and tokens & (tokens - 1) == 0 else length
