"""Health profile of a text table: missing values, duplicates, anomalies, formats, wrong types.

Each function returns one section as a frame. ``field_profile`` is the single aggregate pass the
per-column sections share; its result has one row per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidymill.functions import dates as D
from tidymill.functions import text as T
from tidymill.operators.cells import cells, field_position, first_k, samples, small_side
from tidymill.sources.numbering import ROW_NO, data_columns, renumber

# Thresholds.
MISSING_WARN_RATE = 0.20
DUP_GROUPS = 20
DUP_ROWS_PER_GROUP = 6
NUMERIC_RATIO = 0.80
NUMERIC_MIN_ROWS = 20
DATE_RATIO = 0.80
STYLE_SAMPLES = 3

# Words in column names.
ID_WORDS = ("phone", "mobile", "idcard", "id", "code", "手机", "身份证", "编号", "序号", "工号", "单号")
AGE_WORDS = ("age", "年龄")
AMOUNT_WORDS = ("amount", "price", "金额", "收入")
PHONE_WORDS = ("phone", "手机")
IDCARD_WORDS = ("idcard", "身份证")


def named_like(column: str, words: Sequence[str]) -> bool:
    return any(w in column.lower() for w in words)


def columns_like(df: DataFrame, words: Sequence[str]) -> list[str]:
    return [c for c in data_columns(df) if named_like(c, words)]


def _in(columns: Sequence[str]) -> Column:
    return F.col("field").isin(*columns) if columns else F.lit(False)


# --- the shared aggregate pass ----------------------------------------------------------------


def field_profile(df: DataFrame) -> DataFrame:
    """One row per column with every count and moment the sections below need."""
    columns = data_columns(df)
    if not columns:
        raise ValueError("a profile needs at least one column")
    text, there = F.col("text"), ~F.col("missing")
    number = F.when(there, T.parse_number(text))
    dated = there & D.date_shaped(text)
    long = cells(df).withColumns({"number": number, "dated": dated})
    bad_phone = _in(columns_like(df, PHONE_WORDS)) & there & ~text.rlike(T.PHONE)
    bad_idcard = _in(columns_like(df, IDCARD_WORDS)) & there & ~text.rlike(T.IDCARD)
    styles, first_rows = [], []
    for style, mark in D.DATE_STYLES.items():
        hit = F.col("dated") & text.contains(mark)
        styles.append(F.count_if(hit).alias(f"{style}_cnt"))
        first_rows.append(F.min(F.when(hit, F.col(ROW_NO))).alias(f"{style}_row"))
    thousands = there & T.thousands_shaped(text)
    return (
        long.groupBy("field")
        .agg(
            F.count("*").alias("total"),
            F.count_if("missing").alias("missing"),
            F.count("number").alias("number_cnt"),
            F.avg("number").alias("mean"),
            F.stddev_pop("number").alias("std"),
            F.count_if(thousands).alias("thousands_cnt"),
            F.min(F.when(thousands, F.col(ROW_NO))).alias("thousands_row"),
            F.count_if("dated").alias("date_cnt"),
            *styles,
            *first_rows,
            F.count_if(there & (F.col("value") != text)).alias("space_cnt"),
            F.count_if(bad_phone).alias("phone_cnt"),
            F.count_if(bad_idcard).alias("idcard_cnt"),
        )
        .withColumn("filled", F.col("total") - F.col("missing"))
        .withColumn("position", field_position(columns))
    )


# --- missing values ----------------------------------------------------------------------------


def missing_report(df: DataFrame) -> DataFrame:
    """Missing cells per column with rate and warning, highest rate first."""
    counted = cells(df).groupBy("field").agg(
        F.count_if("missing").alias("missing"), F.count("*").alias("total")
    )
    rate = F.col("missing") / F.col("total")
    return counted.select(
        "field",
        "missing",
        "total",
        F.round(rate, 4).alias("rate"),
        (rate > MISSING_WARN_RATE).alias("warn"),
    ).orderBy(F.desc("rate"), field_position(data_columns(df)))


# --- duplicates --------------------------------------------------------------------------------


def _dup_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    everything = data_columns(df)
    if columns is None:
        return everything
    unknown = [c for c in columns if c not in everything]
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return list(columns)


def _filled(columns: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]


def duplicate_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Surplus rows and groups that occur more than once, on raw text (exact, not hashed)."""
    keys = _dup_columns(df, columns)
    groups = df.select(*_filled(keys)).groupBy(*keys).agg(F.count("*").alias("_n"))
    return groups.where(F.col("_n") > 1).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("dup_rows"),
        F.count("*").alias("dup_groups"),
    )


def duplicates_by(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """Duplicates on chosen columns; None when they are all columns (that is the full report)."""
    keys = _dup_columns(df, columns)
    return None if set(keys) == set(data_columns(df)) else duplicate_counts(df, keys)


def duplicate_samples(
    df: DataFrame, columns: Sequence[str] | None = None, *, groups: int = DUP_GROUPS, rows: int = DUP_ROWS_PER_GROUP
) -> DataFrame:
    """The first duplicate groups: up to six row numbers, how many more, and the values.

    Groups are found with plain counters; row numbers are then read for those 20 groups only, so a
    group that covers a third of the table never ends up in one place. ``duplicate_rows`` has them all.
    """
    keys = _dup_columns(df, columns)
    base = df.select(ROW_NO, *_filled(keys))
    first = _dup_groups(base, keys).orderBy("first_row").limit(groups)
    rank = F.row_number().over(Window.partitionBy("first_row").orderBy(ROW_NO))
    ranked = base.join(F.broadcast(first), keys).withColumn("rank", rank).where(F.col("rank") <= rows)
    listed = ranked.groupBy("first_row", "cnt", *keys).agg(
        F.array_sort(F.collect_list(ROW_NO)).alias("row_nos")  # as many as asked for at most
    )
    extra = F.greatest(F.col("cnt") - rows, F.lit(0)).alias("extra")
    return listed.select("first_row", "row_nos", extra, *keys)


def _dup_groups(base: DataFrame, keys: Sequence[str]) -> DataFrame:
    counted = base.groupBy(*keys).agg(F.count("*").alias("cnt"), F.min(ROW_NO).alias("first_row"))
    return counted.where(F.col("cnt") > 1)


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every row that has a copy: ``row_no``, the first row of its group and the group's size."""
    keys = _dup_columns(df, columns)
    base = df.select(ROW_NO, *_filled(keys))
    return base.join(_dup_groups(base, keys), keys).select(ROW_NO, "first_row", "cnt")


# --- anomalies ---------------------------------------------------------------------------------


def numeric_stats(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """n, mean, population deviation and mean ± 3σ of the columns that are measures.

    Without a ready profile only the candidate columns are scanned, for these figures alone.
    """
    measured = [c for c in data_columns(df) if not named_like(c, ID_WORDS)]
    if profile is None:
        number = F.when(~F.col("missing"), T.parse_number(F.col("text")))
        profile = (
            cells(df, measured)
            .groupBy("field")
            .agg(
                F.count_if(~F.col("missing")).alias("filled"),
                F.count(number).alias("number_cnt"),
                F.avg(number).alias("mean"),
                F.stddev_pop(number).alias("std"),
            )
        )
    return profile.where(
        _in(measured)
        & (F.col("filled") >= NUMERIC_MIN_ROWS)
        & (F.col("number_cnt") / F.col("filled") >= NUMERIC_RATIO)
    ).select(
        "field",
        F.col("number_cnt").alias("n"),
        "mean",
        "std",
        (F.col("mean") - 3 * F.col("std")).alias("lo"),
        (F.col("mean") + 3 * F.col("std")).alias("hi"),
    )


def flagged_cells(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Every anomalous cell with its two verdicts ``rule`` and ``sigma``; nothing is capped."""
    columns = data_columns(df)
    ages, amounts = columns_like(df, AGE_WORDS), columns_like(df, AMOUNT_WORDS)
    bounds = numeric_stats(df, profile)
    # only columns that can be flagged are unpivoted
    candidates = [c for c in columns if c in ages or c in amounts or not named_like(c, ID_WORDS)]
    ruled = _in(ages) | _in(amounts)
    # cells of columns that are no measures are gone before anything is parsed
    measured = (
        cells(df, candidates)
        .where(~F.col("missing"))
        .join(small_side(bounds, len(columns)), "field", "left")
        .where(ruled | F.col("lo").isNotNull())
    )
    number = F.col("number")
    rule = (
        F.when(_in(ages), (number < 0) | (number > 120))
        .when(_in(amounts), number < 0)
        .otherwise(F.lit(False))
    )
    sigma = (number < F.col("lo")) | (number > F.col("hi"))
    verdicts = {
        "is_age": _in(ages),
        "rule": F.coalesce(rule, F.lit(False)),
        "sigma": F.coalesce(sigma, F.lit(False)),
    }
    # a generator of one row: the filter below would form the number again at each comparison
    parsed = measured.select("*", F.explode(F.array(T.parse_number(F.col("text")))).alias("number"))
    return parsed.withColumns(verdicts).where(F.col("rule") | F.col("sigma"))


def _reasons() -> Column:
    shown = T.short_number(F.col("number"))
    by_rule = F.when(
        F.col("rule"),
        F.when(F.col("is_age"), F.concat(F.lit("年龄应在 0~120 之间，当前值 "), shown)).otherwise(
            F.concat(F.lit("金额/价格不应为负，当前值 "), shown)
        ),
    )
    by_sigma = F.when(
        F.col("sigma"),
        F.format_string(
            "超出 3σ 正常范围（均值 %s，参考区间 [%s, %s]）", *(T.cents(F.col(c)) for c in ("mean", "lo", "hi"))
        ),
    )
    return F.concat_ws("；", by_rule, by_sigma)


def anomaly_list(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """All anomalies in (row, field) order, numbered without a global window, with their reasons."""
    listed = flagged_cells(df, profile).select(
        F.col(ROW_NO).alias("_at"), "field", F.col("text").alias("value"), _reasons().alias("rules")
    )
    numbered = renumber(listed, "_at", then=["field"])
    return numbered.select(
        F.col("_at").alias(ROW_NO), "field", "value", "rules", F.col(ROW_NO).alias("id"), F.lit(False).alias("confirmed")
    )


def anomaly_totals(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """The number of anomalies."""
    return flagged_cells(df, profile).agg(F.count("*").alias("anomaly_cnt"))


def confirm_anomalies(anomalies: DataFrame, ids: DataFrame) -> DataFrame:
    """Mark the anomalies whose ``id`` is listed; ``newly`` tells which were not marked before."""
    chosen = ids.select("id").distinct().withColumn("_chosen", F.lit(True))
    hit = F.coalesce("_chosen", F.lit(False))
    return anomalies.join(chosen, "id", "left").select(
        *[c for c in anomalies.columns if c != "confirmed"],
        (F.col("confirmed") | hit).alias("confirmed"),
        (hit & ~F.col("confirmed")).alias("newly"),
    )


# --- formats -----------------------------------------------------------------------------------


def _styled(df: DataFrame) -> DataFrame:
    """Date-text cells once per style they contain."""
    marks = F.array(
        *[F.when(F.col("text").contains(m), F.lit(s)) for s, m in D.DATE_STYLES.items()]
    )
    return (
        cells(df)
        .where(~F.col("missing") & D.date_shaped(F.col("text")))
        .select(ROW_NO, "field", "text", F.explode(F.array_compact(marks)).alias("style"))
    )


def date_format_mix(df: DataFrame) -> DataFrame:
    """Columns that mix date styles: count and first three samples per style."""
    styled = _styled(df)
    groups = len(data_columns(df)) * len(D.DATE_STYLES)
    counts = styled.groupBy("field", "style").agg(F.count("*").alias("cnt"))
    mixed = counts.withColumn(
        "_styles", F.count("*").over(Window.partitionBy("field"))
    ).where(F.col("_styles") >= 2).drop("_styles")
    first = first_k(styled, ["field", "style"], STYLE_SAMPLES, groups)
    shown = samples(first, ["field", "style"], "text", "samples")
    return mixed.join(small_side(shown, groups), ["field", "style"]).select(
        "field", "style", "cnt", "samples"
    )


def _bad_cells(df: DataFrame, kind: str) -> DataFrame:
    there, text = ~F.col("missing"), F.col("text")
    if kind == "phone":
        return cells(df, columns_like(df, PHONE_WORDS)).where(there & ~text.rlike(T.PHONE))
    if kind == "idcard":
        return cells(df, columns_like(df, IDCARD_WORDS)).where(there & ~text.rlike(T.IDCARD))
    if kind == "space":
        return cells(df).where(there & (F.col("value") != text)).withColumn("text", F.col("value"))
    raise ValueError(f"no format check is called {kind!r}")


def bad_format_counts(df: DataFrame, kind: str) -> DataFrame:
    """``(field, bad_count)`` for phone, idcard or space."""
    return _bad_cells(df, kind).groupBy("field").agg(F.count("*").alias("bad_count"))


def bad_format_items(df: DataFrame, kind: str) -> DataFrame:
    """All bad cells."""
    return _bad_cells(df, kind).select("field", ROW_NO, F.col("text").alias("value"))


# --- types -------------------------------------------------------------------------------------


def type_suggestions(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Columns that should be numbers or dates, numbered in field order, number before date."""
    columns = data_columns(df)
    facts = profile if profile is not None else field_profile(df)
    # the date sample is the first slash date, else the first dash date, else the first CJK date
    wanted = facts.where(F.col("filled") > 0).withColumn(
        "date_row", F.coalesce(*[F.col(f"{s}_row") for s in D.DATE_STYLES])
    )
    places = wanted.select(
        "field", F.explode(F.array_compact(F.array("thousands_row", "date_row"))).alias(ROW_NO)
    ).distinct()
    # two rows a column at most are looked at cell by cell
    near = df.join(small_side(places.select(ROW_NO).distinct(), 2 * len(columns)), ROW_NO, "left_semi")
    shown = cells(near).join(small_side(places, 2 * len(columns)), ["field", ROW_NO])
    picked = shown.select("field", ROW_NO, "text")
    wide = wanted
    for kind in ("thousands", "date"):
        found = picked.select(
            "field", F.col(ROW_NO).alias(f"{kind}_row"), F.col("text").alias(f"_{kind}")
        )
        wide = wide.join(small_side(found, 2 * len(columns)), ["field", f"{kind}_row"], "left")
    share = F.col("date_cnt") / F.col("filled")
    number_sample = F.col("_thousands")
    percent = F.format_string("%.1f", F.round(share * 100, 1))
    number = F.struct(
        F.lit(1).alias("rank"),
        F.lit("number").alias("kind"),
        F.lit("convert_number").alias("action"),
        F.concat(
            F.lit("含 "), F.col("thousands_cnt").cast("string"),
            F.lit(" 个千分位格式数字文本（如 "), number_sample, F.lit("），去逗号后可转为数值"),
        ).alias("reason"),
        number_sample.alias("sample"),
    )
    date = F.struct(
        F.lit(2).alias("rank"),
        F.lit("date").alias("kind"),
        F.lit("convert_date").alias("action"),
        F.concat(
            percent, F.lit("% 的值匹配日期格式（如 "), F.col("_date"), F.lit("），建议转为日期类型")
        ).alias("reason"),
        F.col("_date").alias("sample"),
    )
    advice = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("thousands_cnt") > 0, number), F.when(share >= DATE_RATIO, date)
            )
        )
    )
    listed = wide.select("position", "field", advice.alias("a")).select(
        "position", "field", "a.rank", "a.kind", "a.action", "a.reason", "a.sample"
    )
    # at most two rows per column are numbered
    number_all = F.row_number().over(Window.orderBy("position", "rank"))
    return listed.withColumn("id", number_all.cast("bigint")).select(
        "id", "field", "kind", "action", "reason", "sample"
    )


def suggestions_to_actions(suggestions: DataFrame) -> list[dict]:
    """Cleaning actions for suggestions (two per column at most, so they fit the driver)."""
    rows = suggestions.select("id", "field", "kind").orderBy("id").collect()
    return [
        {"type": "convert_type", "params": {"field": r.field, "target": "number"}}
        if r.kind == "number"
        else {
            "type": "normalize_date",
            "params": {"field": r.field, "output_format": "YYYY-MM-DD"},
        }
        for r in rows
    ]


# --- summary -----------------------------------------------------------------------------------


def profile_summary(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """One row with the headline counts of all sections."""
    columns = data_columns(df)
    facts = profile if profile is not None else field_profile(df)
    styles_used = sum((F.col(f"{s}_cnt") > 0).cast("int") for s in D.DATE_STYLES)
    bad_cells = F.sum(F.col("space_cnt") + F.col("phone_cnt") + F.col("idcard_cnt"))
    suggested = (F.col("thousands_cnt") > 0).cast("int") + (
        (F.col("filled") > 0) & (F.col("date_cnt") / F.col("filled") >= DATE_RATIO)
    ).cast("int")
    from_fields = facts.agg(
        F.max("total").alias("row_count"),
        F.count_if(F.col("missing") > 0).alias("missing_fields_cnt"),
        F.count_if(F.col("missing") / F.col("total") > MISSING_WARN_RATE).alias("missing_warn_cnt"),
        (F.count_if(styles_used >= 2) + bad_cells).alias("format_issue_cnt"),
        F.sum(suggested).alias("type_suggest_cnt"),
    )
    # two one-row results joined in as scalar subqueries
    dups = duplicate_counts(df).select(F.struct("dup_rows", "dup_groups")).scalar()
    odd = anomaly_totals(df, facts).select(F.struct("anomaly_cnt")).scalar()
    return from_fields.withColumns({"_d": dups, "_a": odd}).select(
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.lit(len(columns)).cast("bigint").alias("col_count"),
        "missing_fields_cnt",
        "missing_warn_cnt",
        F.col("_d.dup_rows").alias("dup_rows"),
        F.col("_d.dup_groups").alias("dup_groups"),
        F.col("_a.anomaly_cnt").alias("anomaly_cnt"),
        F.coalesce("format_issue_cnt", F.lit(0)).alias("format_issue_cnt"),
        F.coalesce("type_suggest_cnt", F.lit(0)).alias("type_suggest_cnt"),
    )


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """Newest profile per file."""
    newest = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("id")))
    return profiles.withColumn("_n", newest).where(F.col("_n") == 1).drop("_n")
