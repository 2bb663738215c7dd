"""Cleaning results as immutable versions with an append-only ledger, and exports.

Layout under a base folder: ``v=<version>/`` holds what one run wrote, ``_log/<number>.json`` one commit each, a run or
an undo. A version exists once its commit does, so a run that dies half way leaves nothing visible. A commit
is put under the next free number only if nothing is there yet; of two writers one goes first, the other looks at
the new state and tries the number after it. A reader sees the commits that exist when it lists them.
Sources are never written to.

The put is atomic where the file system renames atomically without replacing (HDFS) or links files (a local
disk); object stores without either need a single writer.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidymill.operators.actions import GONE, live
from tidymill.operators.fields import field_catalog
from tidymill.plans.cleaning import Stretch, accounted, run_result, stats_of
from tidymill.plans.events import event_summary
from tidymill.sources.numbering import HIDDEN, ROW_NO, data_columns, renumber

FIELDS_SCHEMA = (
    "array<struct<position: bigint, field_name: string, inferred_type: string, hint: string,"
    " missing_cnt: bigint, missing_rate: double, sample_values: array<string>>>"
)
LEDGER_SCHEMA = (
    "seq bigint, version string, kind string, source string, product string, preset_id bigint,"
    f" actions_json string, stats map<string,string>, fields {FIELDS_SCHEMA}, created_at timestamp"
)


def cleaned_name(source: str, at: dt.datetime) -> str:
    """``orders.csv`` -> ``orders_cleaned_20260901_1230.csv``."""
    path = PurePosixPath(source)
    return f"{path.stem}_cleaned_{at:%Y%m%d_%H%M}{path.suffix or '.csv'}"


# --- commits ----------------------------------------------------------------------------------


def _files(spark: SparkSession, folder: str):
    """The folder's path and file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _next_number(spark: SparkSession, base: str) -> int:
    path, system = _files(spark, f"{base}/_log")
    if not system.exists(path):
        return 0
    numbers = [int(n.split(".")[0]) for n in (s.getPath().getName() for s in system.listStatus(path)) if n[0].isdigit()]
    return max(numbers, default=-1) + 1


def put_if_absent(spark: SparkSession, target: str, text: str) -> bool:
    """Write a small file as a whole unless something has its name; whether it was written."""
    path, system = _files(spark, target)
    # hidden from listings until it has its name
    draft = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":
            try:
                os.link(*(unquote(urlparse(system.makeQualified(p).toString()).path) for p in (draft, path)))
            except FileExistsError:
                return False
            return True
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
        options = spark._jvm.java.lang.reflect.Array.newInstance(
            spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
        )
        try:
            context.rename(draft, path, options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass().getName()):
                raise
            return False
        return True
    finally:
        system.delete(draft, False)


def commit(spark: SparkSession, base: str, record: Callable[[DataFrame], dict]) -> int:
    """Add a record to the ledger; ``record`` makes it from the state it is going to follow, or refuses.

    When another writer takes the number first, it is made again from the state that includes the other's commit.
    """
    while True:
        number = _next_number(spark, base)
        row = {"seq": number, **record(_ledger_to(spark, base, number))}
        if put_if_absent(spark, f"{base}/_log/{number:020d}.json", json.dumps(row, ensure_ascii=False, default=str)):
            return number


def _ledger_to(spark: SparkSession, base: str, number: int) -> DataFrame:
    if not number:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    names = [f"{base}/_log/{n:020d}.json" for n in range(number)]
    return spark.read.schema(LEDGER_SCHEMA).option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").json(names)


def ledger(spark: SparkSession, base: str) -> DataFrame:
    """All runs and undos committed so far; later commits do not appear in this frame."""
    return _ledger_to(spark, base, _next_number(spark, base))


# --- versions ---------------------------------------------------------------------------------


def write_version(
    df: DataFrame,
    actions: Sequence[dict],
    base: str,
    source: str,
    *,
    preset_id: int | None = None,
    at: dt.datetime | None = None,
) -> str:
    """Run a chain, write its product as a new version, record the run; returns the version id.

    The source is read once: what is written holds the rows that are left and, without their cells, those that went.
    Statistics and field catalog are taken from it and are part of the same commit.
    """
    spark, at = df.sparkSession, at or dt.datetime.now()
    version = f"{at:%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"
    target = f"{base}/v={version}"
    stretches = accounted(df, actions)
    frame = stretches[-1].frame
    hidden = [c for c in frame.columns if c.startswith(HIDDEN)]
    shown = [F.when(live(frame), F.col(f"`{c}`")).alias(c) for c in data_columns(frame)]
    frame.select(ROW_NO, *hidden, *shown).write.mode("errorifexists").parquet(target)
    written = spark.read.parquet(target)
    stats = stats_of([*stretches[:-1], Stretch(written, stretches[-1].steps)], len(data_columns(df)), actions).first()
    fields = field_catalog(run_result(written)).orderBy("position").collect()  # a row per column
    row = {
        "version": version,
        "kind": "run",
        "source": source,
        "product": cleaned_name(source, at),
        "preset_id": preset_id,
        "actions_json": json.dumps(list(actions), ensure_ascii=False, default=str),
        "stats": {
            k: json.dumps(v, ensure_ascii=False) if isinstance(v, list) else str(v) for k, v in stats.asDict().items()
        },
        "fields": [f.asDict() for f in fields],
        "created_at": f"{at:%Y-%m-%d %H:%M:%S.%f}",
    }
    commit(spark, base, lambda _: row)
    return version


def read_version(spark: SparkSession, base: str, version: str) -> DataFrame:
    """A product as a text table whose row numbers are positions in the product."""
    return renumber(run_result(spark.read.parquet(f"{base}/v={version}").where(F.col(GONE).isNull())))


def version_fields(spark: SparkSession, base: str, version: str) -> DataFrame:
    """The field catalog of a product, as it was committed."""
    run = ledger(spark, base).where((F.col("version") == version) & (F.col("kind") == "run"))
    return run.select(F.inline("fields"))


def live_versions(records: DataFrame) -> DataFrame:
    """Runs that were not undone: the last commit of each version decides."""
    newest = F.row_number().over(Window.partitionBy("version").orderBy(F.desc("seq")))
    return records.withColumn("_n", newest).where((F.col("_n") == 1) & (F.col("kind") == "run")).drop("_n")


def rollback(spark: SparkSession, base: str, version: str, at: dt.datetime | None = None) -> None:
    """Withdraw a version: record it first, then remove its files. The source is as it was."""

    def undo(records: DataFrame) -> dict:
        row = live_versions(records.where(F.col("version") == version)).first()
        if row is None:
            raise ValueError(f"no run has the version {version}")
        known = {c: row[c] for c in ("version", "source", "product", "preset_id", "actions_json")}
        return {**known, "kind": "undo", "created_at": f"{at or dt.datetime.now():%Y-%m-%d %H:%M:%S.%f}"}

    commit(spark, base, undo)
    path, system = _files(spark, f"{base}/v={version}")
    system.delete(path, True)


def source_states(records: DataFrame, before: str = "imported") -> DataFrame:
    """State of every source: cleaned while it has a live version, else what it was before; its latest live version."""
    newest = F.max_by("version", "seq").alias("version")
    left = live_versions(records).groupBy("source").agg(F.count("*").alias("live_cnt"), newest)
    return records.select("source").distinct().join(left, "source", "left").select(
        "source",
        _status(F.col("live_cnt"), before).alias("status"),
        F.coalesce("live_cnt", F.lit(0)).cast("bigint").alias("live_cnt"),
        "version",
    )


def source_status(records: DataFrame, source: str, before: str = "imported") -> DataFrame:
    """State of one source, which need not be in the ledger."""
    count = live_versions(records.where(F.col("source") == source)).agg(F.count("*").alias("n"))
    return count.select(_status(F.col("n"), before).alias("status"))


def _status(live_count: Column, before: str) -> Column:
    return F.when(live_count > 0, "cleaned").otherwise(before)


def timeline(records: DataFrame, presets: DataFrame, products: DataFrame) -> DataFrame:
    """Cleaning records with preset and product names, newest first."""
    named = presets.select(F.col("id").alias("preset_id"), F.col("name").alias("preset_name"))
    made = products.select(
        F.col("id").alias("output_file_id"), F.col("origin_name").alias("output_name")
    )
    return (
        records.join(named, "preset_id", "left")
        .join(made, "output_file_id", "left")
        .orderBy(F.desc("id"))
    )


def export_events(events: DataFrame, path: str) -> None:
    """All events with parsed parameters as JSON lines, and the count per event beside them."""
    params = F.coalesce(
        F.from_json("params_json", "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    events.select("id", "event", params.alias("params"), "created_at").write.mode(
        "errorifexists"
    ).json(f"{path}/events")
    event_summary(events).coalesce(1).write.mode("errorifexists").json(f"{path}/summary")


def export_table(df: DataFrame, path: str) -> None:
    """A text table as CSV with header, in row order inside and across files."""
    df.orderBy(ROW_NO).select(*data_columns(df)).write.mode("errorifexists").option(
        "header", True
    ).option("emptyValue", "").csv(path)
