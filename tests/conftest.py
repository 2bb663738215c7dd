from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidymill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def table(spark) -> Callable:
    """Text table from rows: ``table("a b", [("1", "x"), ...])`` with row numbers."""

    def make(columns: str, rows: list[tuple]):
        names = columns.split()
        schema = "row_no bigint, " + ", ".join(f"`{n}` string" for n in names)
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], schema)

    return make


@pytest.fixture
def rows() -> Callable:
    """Rows of a frame as tuples in row order (or as a sorted list)."""

    def read(df, *columns: str) -> list:
        if "row_no" in df.columns:
            df = df.orderBy("row_no")
        out = df.select(*columns) if columns else df
        listed = [tuple(r) for r in out.collect()]
        listed = listed if "row_no" in df.columns else sorted(listed, key=repr)
        return [r[0] for r in listed] if len(columns) == 1 else listed

    return read
