"""The three published stages on 1,000,000 orders as CSV: import, health profile, cleaning run.

998,000 orders with known dirt and 2,000 exact copies are generated with Spark into a new temporary
folder (or under BENCH_STAGE_DIR). Prints one JSON line with seconds per stage.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from tidymill.operators import health as H
from tidymill.operators.fields import field_catalog
from tidymill.plans.cleaning import ORDERS_PRESET, PRESETS
from tidymill.session import local_session
from tidymill.sources.text_tables import read_text_table
from tidymill.sources.versions import read_version, write_version


def orders(spark, rows: int, copies: int):
    """Orders as text, the dirt spread by hashes of the id."""
    pick = F.pmod(F.xxhash64("id"), F.lit(1000))
    day = F.date_add(F.lit("2026-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(240)).cast("int"))
    price = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(499_000)) / 100 + 10
    style = F.col("id") % 3
    base = spark.range(1, rows + 1).select(
        F.col("id").cast("string").alias("order_id"),
        (10_000 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(90_000))).cast("string").alias("user_id"),
        F.when(style == 0, F.date_format(day, "y/M/d"))
        .when(style == 1, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "y年M月d日"))
        .alias("order_date"),
        F.when(pick < 10, F.concat(F.lit("-"), F.format_string("%.2f", price)))
        .when(pick < 60, F.format_number(price + 10_000, 1))
        .otherwise(F.format_string("%.2f", price))
        .alias("amount"),
        F.when(pick % 200 == 5, "-3").when(pick % 200 == 9, "130").otherwise((18 + pick % 48).cast("string")).alias("age"),
        F.concat(F.lit("city"), pick % 10).alias("city"),
        F.when(pick % 20 == 0, "").otherwise(F.concat(F.lit("c"), pick % 4)).alias("channel"),
    )
    return base.union(base.where(F.col("order_id").cast("bigint") <= copies))


def main() -> None:
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    folder = os.environ.get("BENCH_STAGE_DIR") or tempfile.mkdtemp(prefix="tidymill-stages-")
    spark = local_session(cores, shuffle_partitions=int(cores))
    path = f"{folder}/orders_csv"
    orders(spark, 998_000, 2_000).coalesce(1).write.option("header", True).csv(path)
    seconds: dict[str, float] = {}

    def timed(stage: str, run):
        started = time.perf_counter()
        out = run()
        seconds[stage] = round(time.perf_counter() - started, 2)
        return out

    def load():
        df = read_text_table(spark, path)
        return df, field_catalog(df).collect()

    df, catalog = timed("import", load)

    def profile():
        facts = H.field_profile(df).persist()  # one row per column
        sections = {
            "summary": H.profile_summary(df, facts).collect(),
            "missing": H.missing_report(df).collect(),
            "duplicates": H.duplicate_samples(df).collect(),
            "anomalies": H.anomaly_list(df, facts).collect(),
            "dates": H.date_format_mix(df).collect(),
            "spaces": H.bad_format_items(df, "space").collect(),
            "suggestions": H.type_suggestions(df, facts).collect(),
        }
        facts.unpersist()
        return sections

    report = timed("profile", profile)
    version = timed(
        "clean", lambda: write_version(df, PRESETS[ORDERS_PRESET], f"{folder}/store", "orders.csv")
    )
    print(
        json.dumps(
            {
                "seconds": seconds,
                "summary": {k: v for k, v in report["summary"][0].asDict().items()},
                "columns": len(catalog),
                "rows_after": read_version(spark, f"{folder}/store", version).count(),
                "cores": cores,
            },
            ensure_ascii=False,
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
