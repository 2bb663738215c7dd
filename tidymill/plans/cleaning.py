"""Chains of cleaning actions: checking, running, previewing and accounting."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidymill.functions import text as T
from tidymill.operators.actions import ACTIONS, COPIES, GONE, JUST_NOW, live, live_rows
from tidymill.sources.numbering import HIDDEN, ROW_NO, data_columns
from tidymill.sources.text_tables import head_rows

PREVIEW_ROWS = 1000
SAMPLE_PAIRS = 5

# The symbolic field of presets and the two built-in presets.
ALL_TEXT = "__all_text__"
PRESETS = {
    "活动订单数据标准清洗": [
        {"type": "drop_duplicates", "params": {"columns": None}},
        {"type": "normalize_date", "params": {"field": "order_date", "output_format": "YYYY-MM-DD"}},
        {"type": "convert_type", "params": {"field": "amount", "target": "number"}},
        {"type": "fill_missing", "params": {"field": "channel", "strategy": "fixed", "value": "未知"}},
        {"type": "handle_anomaly", "params": {"field": "age", "mode": "drop", "anomaly_rows": []}},
    ],
    "用户数据基础清洗": [
        {"type": "strip_text", "params": {"field": ALL_TEXT}},
        {"type": "handle_anomaly", "params": {"field": "phone", "mode": "mark", "anomaly_rows": []}},
        {"type": "fill_missing", "params": {"field": "name", "strategy": "drop_row"}},
    ],
}
ORDERS_PRESET, USERS_PRESET = PRESETS


def _type_of(action: dict) -> str:
    name = str(action.get("type") or "").strip()
    if name not in ACTIONS:
        raise ValueError(f"no action is called {name!r}")
    return name


def check_actions(columns: Sequence[str], actions: Sequence[dict]) -> list[str]:
    """Columns after the whole chain; ``ValueError`` names the first thing that is wrong."""
    out = list(columns)
    for action in actions:
        out = ACTIONS[_type_of(action)].check(out, action.get("params") or {})
    return out


def run_action(df: DataFrame, action: dict) -> DataFrame:
    known, params = ACTIONS[_type_of(action)], action.get("params") or {}
    known.check(data_columns(df), params)
    return known.run(df, params)


def run_actions(df: DataFrame, actions: Sequence[dict]) -> DataFrame:
    """Apply the actions in order as one plan; nothing runs if any action is invalid."""
    check_actions(data_columns(df), actions)
    for action in actions:
        df = run_action(df, action)
    return df


# --- presets ----------------------------------------------------------------------------------


def expand_all_text(actions: Sequence[dict], types: dict[str, str]) -> list[dict]:
    """Replace the symbolic field by one strip per text column (per column if none is text)."""
    texts = [name for name, label in types.items() if label.startswith("text")] or list(types)
    out: list[dict] = []
    for action in actions:
        if action.get("type") == "strip_text" and action["params"].get("field") == ALL_TEXT:
            out += [{"type": "strip_text", "params": {"field": name}} for name in texts]
        else:
            out.append(action)
    return out


def apply_preset(name: str, types: dict[str, str], presets: dict[str, list] | None = None) -> list[dict]:
    """The actions of a preset, ready to run on a table with these column types."""
    known = PRESETS if presets is None else presets
    if name not in known:
        raise ValueError(f"no preset is called {name!r}")
    actions = known[name]
    if not isinstance(actions, list) or not actions:
        raise ValueError("the preset holds no usable list of actions")
    return expand_all_text(actions, types)


def column_types(fields: DataFrame) -> dict[str, str]:
    """Field catalog to ``{name: label}`` in column order: one small row per column."""
    rows = fields.select("position", "field_name", "inferred_type").collect()
    return {r.field_name: r.inferred_type for r in sorted(rows, key=lambda r: r.position)}


# --- comparing two states ---------------------------------------------------------------------


def affected_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the difference in row count, else the rows with any changed cell.

    Rows are aligned by ``row_no``, compared over the common columns.
    """
    common = [c for c in data_columns(before) if c in after.columns]
    old = before.select(ROW_NO, *[F.col(c).alias(f"_b{i}") for i, c in enumerate(common)])
    new = after.select(ROW_NO, *[F.col(c).alias(f"_a{i}") for i, c in enumerate(common)])
    changed = F.lit(not common)
    for i in range(len(common)):
        changed = changed | ~F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}"))
    both = old.join(new, ROW_NO).agg(F.count_if(changed).alias("changed"))
    rows_before = before.agg(F.count("*")).scalar()
    rows_after = after.agg(F.count("*")).scalar()
    counted = both.withColumns({"rows_before": rows_before, "rows_after": rows_after})
    return counted.select(
        "rows_before",
        "rows_after",
        F.when(
            F.col("rows_before") != F.col("rows_after"),
            F.abs(F.col("rows_before") - F.col("rows_after")),
        )
        .otherwise(F.col("changed"))
        .alias("affected_rows"),
    )


def _first_rows(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    position = F.row_number().over(Window.orderBy(ROW_NO))  # over the five rows kept
    return (
        df.orderBy(ROW_NO)
        .limit(SAMPLE_PAIRS)
        .select(
            position.alias("position"),
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(prefix + c) for c in columns],
        )
    )


def sample_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """The first five rows of both states side by side over the common columns."""
    common = [c for c in data_columns(before) if c in after.columns]
    return _first_rows(before, common, "before_").join(
        _first_rows(after, common, "after_"), "position"
    )


def _refusal(error: Exception) -> str | None:
    """Why an action or its data refused to run; None for failures of the cluster, which are no one's report."""
    text, mark = str(error).strip(), "[USER_RAISED_EXCEPTION]"
    if isinstance(error, Py4JJavaError):  # what a scalar subquery raises comes unconverted
        if mark not in text:
            return None
        text = text[text.index(mark) :]
    return text.removeprefix(mark).strip().splitlines()[0]


def preview(df: DataFrame, actions: Sequence[dict]) -> DataFrame:
    """Try the chain on the first 1,000 rows: one report row per action.

    A failing action is reported and skipped. The sample is small by definition, so every step is
    run at once and its verdict read back.
    """
    held = [head_rows(df, PREVIEW_ROWS).persist()]
    try:
        return df.sparkSession.createDataFrame(_reports(held, actions), PREVIEW_SCHEMA)
    finally:
        for frame in held:
            frame.unpersist()


PREVIEW_SCHEMA = (
    "step int, type string, ok boolean, error string, rows_before bigint, rows_after bigint,"
    " affected_rows bigint, samples array<map<string,string>>"
)


def _reports(held: list[DataFrame], actions: Sequence[dict]) -> list[dict]:
    """What each action does to the state the last successful one left; every state that is kept is added to ``held``."""
    current, reports = held[0], []
    for step, action in enumerate(actions, start=1):
        rows = current.count()
        report = {"step": step, "type": action.get("type"), "rows_before": rows}
        try:
            after = run_action(current, action).persist()
            held.append(after)
            verdict = affected_rows(current, after).first()
            pairs = [r.asDict() for r in sample_pairs(current, after).orderBy("position").collect()]
            report |= {
                "ok": True,
                "error": None,
                "rows_after": verdict.rows_after,
                "affected_rows": verdict.affected_rows,
                "samples": [{k: str(v) for k, v in p.items()} for p in pairs],
            }
            current = after
        except (ValueError, AnalysisException, SparkRuntimeException, Py4JJavaError) as error:
            reason = _refusal(error)
            if reason is None:
                raise
            report |= {
                "ok": False,
                "error": reason,
                "rows_after": rows,
                "affected_rows": 0,
                "samples": [],
            }
        reports.append(report)
    return reports


# --- accounting -------------------------------------------------------------------------------


def _cell_measure(action: dict) -> tuple[str, Column] | None:
    """Which cells an action is going to change, as a 0/1 column of the frame before it."""
    params = action.get("params") or {}
    field = F.col(str(params.get("field")))
    if action["type"] == "fill_missing" and params.get("strategy") != "drop_row":
        return "missing_filled", T.is_missing(field).cast("int")
    if action["type"] == "strip_text":
        return "strip_count", (field != T.strip(field)).cast("int")
    return None


def _row_measure(action: dict) -> str | None:
    """The counter that takes the rows an action drops."""
    params = action.get("params") or {}
    if action["type"] == "drop_duplicates":
        return "rows_dropped_dedup"
    if action["type"] == "filter_rows":
        return "rows_dropped_filter"
    if action["type"] == "handle_anomaly" and (params.get("mode") or "drop") == "drop":
        return "rows_dropped_anomaly"
    if action["type"] == "fill_missing" and params.get("strategy") == "drop_row":
        return "rows_dropped_missing"
    return None


@dataclass(frozen=True)
class Stretch:
    """A part of a chain that ran as one accounted frame: its first step, and the frame at its end."""

    frame: DataFrame
    steps: Sequence[int]


def accounted(df: DataFrame, actions: Sequence[dict]) -> list[Stretch]:
    """Run a chain so that its result says what happened to every row.

    The frame holds the rows that are left and those that went (``GONE`` is the step that dropped them), with counts of
    changed cells and of copies as hidden columns. So one scan of the source gives product and statistics.
    An action registered elsewhere does not know such rows: it gets the rows that are left and a new stretch begins.
    """
    check_actions(data_columns(df), actions)
    stretches: list[Stretch] = []
    current, steps = df.withColumn(GONE, F.lit(None).cast("int")), []
    for i, action in enumerate(actions):
        known = ACTIONS[_type_of(action)]
        if not known.tracked:
            stretches.append(Stretch(current, steps))
            rest = run_action(run_result(current), action)
            current, steps = rest.withColumn(GONE, F.lit(None).cast("int")), []
            continue
        measure = _cell_measure(action)
        if measure:
            current = current.withColumn(f"{HIDDEN}cells{i}", F.when(live(current), measure[1]).otherwise(0).cast("bigint"))
        current = run_action(current, action)
        if known.changes_rows:
            current = current.withColumn(GONE, F.when(F.col(GONE) == JUST_NOW, F.lit(i)).otherwise(F.col(GONE)))
            current = current.withColumnRenamed(COPIES, f"{HIDDEN}copies{i}")
        steps.append(i)
    return [*stretches, Stretch(current, steps)]


def run_result(frame: DataFrame) -> DataFrame:
    """The rows of an accounted frame that are left, as a plain text table."""
    return live_rows(frame).drop(*(c for c in frame.columns if c.startswith(HIDDEN)))


def change_stats(df: DataFrame, actions: Sequence[dict]) -> DataFrame:
    """One row of exact change counts for a chain."""
    return stats_of(accounted(df, actions), len(data_columns(df)), actions)


def stats_of(stretches: Sequence[Stretch], cols_before: int, actions: Sequence[dict]) -> DataFrame:
    """The change counts of an accounted run: one aggregate for each stretch.

    They are plain aggregates rather than accumulators because a recomputed task must not count twice.
    """
    filled: dict[str, list[Column]] = {"missing_filled": [], "strip_count": []}
    dropped: dict[str, list[Column]] = {f"rows_dropped_{cause}": [] for cause in ("dedup", "anomaly", "filter", "missing")}
    first = last = after_filter = F.lit(None).cast("bigint")
    for stretch in stretches:
        frame = stretch.frame

        def total(name: str) -> Column:
            return F.coalesce(F.sum(f"{HIDDEN}{name}"), F.lit(0)) if f"{HIDDEN}{name}" in frame.columns else F.lit(0)

        counts = F.struct(
            F.count("*").alias("rows"),
            *(total(f"copies{i}").alias(f"copies{i}") for i in stretch.steps),
            *(total(f"cells{i}").alias(f"cells{i}") for i in stretch.steps),
            *(F.count_if(F.col(GONE) == i).alias(f"gone{i}") for i in stretch.steps),
        )
        found = frame.agg(counts.alias("c")).scalar()
        rows = _total([found["rows"], *(found[f"copies{i}"] for i in stretch.steps)])
        first = rows if stretch is stretches[0] else first
        for i in stretch.steps:
            lost, cause, measure = found[f"gone{i}"] + found[f"copies{i}"], _row_measure(actions[i]), _cell_measure(actions[i])
            rows = rows - lost
            if cause:
                dropped[cause].append(lost)
            if cause == "rows_dropped_filter":
                after_filter = rows
            if measure:
                filled[measure[0]].append(found[f"cells{i}"])
        last = rows

    def names(kind: str) -> Column:
        listed = dict.fromkeys(a["params"]["field"] for a in actions if a["type"] == kind)
        return F.array(*[F.lit(n) for n in listed]).cast("array<string>")

    return stretches[-1].frame.sparkSession.range(1).select(
        first.alias("rows_before"),
        last.alias("rows_after"),
        (first - last).alias("rows_removed"),
        F.lit(cols_before).cast("bigint").alias("cols_before"),
        F.lit(len(data_columns(stretches[-1].frame))).cast("bigint").alias("cols_after"),
        F.lit(len(actions)).cast("bigint").alias("actions_count"),
        *[_total(parts).alias(name) for name, parts in (filled | dropped).items()],
        after_filter.alias("rows_after_filter"),
        names("convert_type").alias("fields_converted"),
        names("normalize_date").alias("dates_normalized"),
    )


def _total(parts: Sequence[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for part in parts:
        out = out + part
    return out
