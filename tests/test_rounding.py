"""Prices halfway between two cents: the text depends on the binary value, not on its shortest decimal form."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import compare
from tidymill.functions.text import cents
from tidymill.operators.health import anomaly_list

# a thousandth of the first five lies just below the half of a cent, of the last two right on it
PRICES = (127445.0, 224975.0, 309755.0, 77195.0, 64235.0, 500125.0, 12375.0)
QUERIES = (
    "f7_format_date h16_suggestions_to_actions h8_anomaly_list k10_normalize_date k15_sort_numeric_desc k15_sort_text"
    " k17_anomaly_drop k17_anomaly_drop_listed k1_fill_drop_row k21_affected_rows k24_preset_orders k2_fill_mean"
    " k3_fill_median k4_fill_fixed"
).split()


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Orders in which every hundredth price is divided by 1,000, and events that list the first few rows."""
    folder = str(tmp_path_factory.mktemp("halves"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(
        f"""COPY (SELECT i AS o_orderkey, i * 7 AS o_custkey, 'O' AS o_orderstatus,
            {list(PRICES)}[i // 100 % {len(PRICES)} + 1]::DOUBLE AS o_totalprice,
            TIMESTAMP '2024-01-01' + to_days(i::INT % 300) AS o_orderdate, i % 5 + 1 || '-LEVEL' AS o_orderpriority
        FROM range(2000) r(i)) TO '{folder}/orders.parquet' (FORMAT parquet)"""
    )
    con.execute(f"COPY (SELECT i AS event_id FROM range(3) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)")
    for name in ("orders", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    yield folder, con
    con.close()


@pytest.mark.parametrize("name", QUERIES)
def test_halves_of_cents(spark, halves, name):
    folder, con = halves
    assert compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], folder) is None


def test_mean_on_a_half(spark, table):
    """A mean of 2.125 (exact in binary) is shown as 2.12 by printf, and 1.005 (below the half) as 1.00."""
    values = [0.0] * 39 + [85.0]
    listed = anomaly_list(table("weight", [(str(v),) for v in values])).collect()
    mean = sum(values) / len(values)
    std = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    assert mean == 2.125
    assert [r.rules for r in listed] == [f"超出 3σ 正常范围（均值 {mean:.2f}，参考区间 [{mean - 3 * std:.2f}, {mean + 3 * std:.2f}]）"]
    shown = spark.createDataFrame([(1.005,), (-0.001,), (1234567.125,)], "x double").select(cents(F.col("x"))).collect()
    assert [r[0] for r in shown] == ["1.00", "-0.00", "1234567.12"]
