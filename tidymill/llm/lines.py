"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymill.llm.common import pin, slices, texts

KEY_SCHEMA = "hi bigint, lo bigint, doc_id bigint"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line without white space at its ends and with A-Z lower-cased, None below the length."""
    line = line.strip(b" \t\n\r\x0b\x0c").lower()
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line)


def _keys_of(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found: list[bytes] = []
            ids: list[int] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if doc_id is None:
                    continue
                keys = {k for x in text.encode().split(b"\n") if (k := _key(x, min_chars)) is not None}
                found += keys
                ids += [doc_id] * len(keys)
            pairs = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(ids, pa.int64())], ["hi", "lo", "doc_id"]
            )

    return run


def _cut(min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple] = []
            for doc_id, text, drop in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "drop")), strict=True):
                lines = text.encode().split(b"\n")
                if drop:
                    gone = {np.array([x["hi"], x["lo"]], np.int64).tobytes() for x in drop}
                    kept = [x for x in lines if _key(x, min_chars) not in gone]
                else:
                    kept = lines
                out.append((doc_id, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema, strict=True)], schema=schema)

    return run


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Drop lines found in at least ``min_docs`` documents, except in the largest id that holds them.

    Returns ``doc_id, n_lines, n_dropped, kept`` (the text that stays) for every row. Lines end at line
    feeds and are compared without white space at their ends and with A-Z lower-cased; keys below
    ``min_chars`` code points always stay. The largest id keeps every occurrence it has.

    Each document sends a 128-bit hash per different line, counted per task before the shuffle; the
    frequent ones are written down, then meet the lines in a join that adaptive execution may split.
    A document's own list of dropped hashes is as long as the document at most.

    Defined cases: a null or empty text is one empty line. Rows that repeat an id count as one document and
    get the same treatment. Rows with a null id are left as they are and do not count. Documents whose
    lines all go keep the empty text. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)
    keys = rows.mapInArrow(_keys_of(min_chars), KEY_SCHEMA)
    frequent = pin(
        keys.groupBy("hi", "lo")
        .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keep_id"))
        .filter(F.col("n_docs") >= min_docs)
        .select("hi", "lo", "keep_id")
    )
    dropped = (
        keys.join(frequent, ["hi", "lo"])
        .filter("doc_id < keep_id")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("drop"))
    )
    return rows.join(dropped, "doc_id", "left").mapInArrow(
        _cut(min_chars), "doc_id bigint, n_lines bigint, n_dropped bigint, kept string"
    )
