"""The event log: summary, flattened parameters and the product metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymill.plans.analytics import next_period_retention, percent


def event_summary(events: DataFrame) -> DataFrame:
    """Count per event."""
    return events.groupBy("event").agg(F.count("*").alias("cnt"))


def event_params(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parameters as a map, with chosen keys as columns; unreadable JSON gives an empty map."""
    params = F.coalesce(
        F.from_json("params_json", "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    parsed = events.withColumn("params", params)
    return parsed.select(
        "id", "event", "params", *[F.try_element_at("params", F.lit(k)).alias(k) for k in keys]
    )


def preset_usage_rate(records: DataFrame) -> DataFrame:
    """Cleaning runs that used a preset, among all runs."""
    counted = records.agg(
        F.count("*").alias("runs"), F.count("preset_id").alias("preset_runs")
    )
    return counted.withColumn("usage_pct", percent(F.col("preset_runs"), F.col("runs")))


def rework_rate(requests: DataFrame, reworks: DataFrame) -> DataFrame:
    """Requests that were sent back at least once, per delivered request."""
    marked = requests.join(reworks.select(F.col("ticket_id").alias("id")), "id", "left_semi")
    delivered = requests.agg(F.count_if(F.col("status") == "delivered")).scalar()
    counted = marked.agg(F.count("*").alias("reworked")).withColumn("delivered", delivered)
    return counted.withColumn("rework_pct", percent(F.col("reworked"), F.col("delivered")))


def weekly_retention(df: DataFrame, user: str, at: str) -> DataFrame:
    """Users active in a week who are active in the next one too."""
    return next_period_retention(df, user, at, grain="week")
