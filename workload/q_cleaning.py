"""Cleaning actions, chains, presets and their accounting."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidymill.functions.markup import mask_fields
from tidymill.operators import fields as C
from tidymill.operators.actions import anomaly_test
from tidymill.operators.health import anomaly_list
from tidymill.plans import cleaning as P
from tidymill.session import checkpoint_dir
from tidymill.sources import versions as V
from tidymill.sources.versions import timeline
from workload import fixtures as X
from workload.fixtures import Tables, duck
from workload.q_functions import ORDER_COLUMNS
from workload.registry import query

ORDERS = ", ".join(ORDER_COLUMNS)


def _action(key: str, action: dict, sql: str, table: str = "dirty_orders") -> None:
    """Register one action over a whole messy table."""
    query(key, duck(sql, table))(lambda t: P.run_action(getattr(t, table), action))


def _do(kind: str, **params: object) -> dict:
    return {"type": kind, "params": params}


def _replaced(field: str, sql: str, columns: list[str] | None = None) -> str:
    parts = [f"{sql} AS {c}" if c == field else c for c in columns or ORDER_COLUMNS]
    return f"SELECT row_no, {', '.join(parts)} FROM dirty_orders"


# --- columns and row tests ---------------------------------------------------------------------

_action(
    "p1_rename_field",
    _do("rename_field", old_name="channel", new_name=" source_channel "),
    f"SELECT row_no, {ORDERS.replace('channel', 'channel AS source_channel')} FROM dirty_orders",
)
_action(
    "p2_drop_field",
    _do("drop_field", field="age"),
    f"SELECT row_no, {ORDERS.replace('age, ', '')} FROM dirty_orders",
)
_ALL = f"SELECT row_no, {ORDERS} FROM dirty_orders WHERE "
_num = X.number
_action(
    "p3_filter_rows_and",
    _do(
        "filter_rows",
        combiner="and",
        conditions=[
            {"field": "amount", "operator": ">", "value": 100000},
            {"field": "age", "operator": "<=", "value": "40"},
            {"field": "order_date", "operator": "contains", "value": "年"},
        ],
    ),
    f"{_ALL} coalesce({_num('amount')} > 100000, false) AND coalesce({_num('age')} <= 40, false)"
    " AND contains(order_date, '年')",
)
_action(
    "p3_filter_rows_or",
    _do(
        "filter_rows",
        combiner="or",
        conditions=[
            {"field": "amount", "operator": "<", "value": 0},
            {"field": "age", "operator": ">=", "value": 120},
            {"field": "channel", "operator": "=", "value": ""},
        ],
    ),
    f"{_ALL} coalesce({_num('amount')} < 0, false) OR coalesce({_num('age')} >= 120, false)"
    " OR trim(channel) = ''",
)
_action(
    "p3a_equals",
    _do("filter_rows", field="city", operator="=", value=" HOUSEHOLD "),
    "SELECT * FROM dirty_users WHERE trim(city) = 'HOUSEHOLD'",
    "dirty_users",
)
_action(
    "p3b_in_list",
    _do("filter_rows", field="channel", operator="in", value="1-URGENT, 2-HIGH ,"),
    f"{_ALL} trim(channel) IN ('1-URGENT', '2-HIGH')",
)
_action(
    "p3c_numeric_test",
    _do("filter_rows", field="amount", operator=">=", value="250,000".replace(",", "")),
    f"{_ALL} coalesce({_num('amount')} >= 250000, false)",
)
_action(
    "p3d_contains",
    _do("filter_rows", field="city", operator="contains", value="  A"),
    "SELECT * FROM dirty_users WHERE contains(city, '  A')",
    "dirty_users",
)
_action(
    "p4_strip_text",
    _do("strip_text", field="city"),
    "SELECT row_no, id, name, trim(city) AS city, phone, idcard FROM dirty_users",
    "dirty_users",
)


@query(
    "p5_expand_all_text",
    duck(
        "SELECT row_no, id, trim(name) AS name, trim(city) AS city, phone, idcard FROM dirty_users",
        "dirty_users",
    ),
)
def p5(t: Tables):
    types = P.column_types(C.infer_types(t.dirty_users))
    actions = P.expand_all_text([_do("strip_text", field=P.ALL_TEXT)], types)
    return P.run_actions(t.dirty_users, actions)


_MASKED = ["tion", "the", "ation"]


@query(
    "p6_mask_fields",
    """SELECT doc_id, replace(replace(replace(text, 'ation', '[已脱敏字段]'), 'tion', '[已脱敏字段]'),
        'the', '[已脱敏字段]') AS masked FROM documents""",
)
def p6(t: Tables):
    return t.documents.select("doc_id", mask_fields(F.col("text"), _MASKED).alias("masked"))


# --- missing values ----------------------------------------------------------------------------

_action(
    "k1_fill_drop_row",
    _do("fill_missing", field="channel", strategy="drop_row"),
    f"{_ALL} NOT {X.missing('channel')}",
)


def _gaps(t: Tables):
    """Orders whose ages have gaps: texts that are not ages count as missing."""
    return t.dirty_orders.withColumn(
        "age", F.when(F.col("age").isin("-3", "130"), F.lit("N/A")).otherwise(F.col("age"))
    )


_GAPS = "gaps AS (SELECT * REPLACE (CASE WHEN age IN ('-3', '130') THEN 'N/A' ELSE age END AS age) FROM dirty_orders)"


def _fill(key: str, strategy: str, value_sql: str) -> None:
    sql = f"WITH {_GAPS} " + _replaced(
        "age", f"CASE WHEN {X.missing('age')} THEN {value_sql} ELSE age END"
    ).replace("FROM dirty_orders", "FROM gaps")
    query(key, duck(sql, "dirty_orders"))(
        lambda t: P.run_action(_gaps(t), _do("fill_missing", field="age", strategy=strategy))
    )


_AGE = f"CASE WHEN NOT {X.missing('age')} THEN {_num('age')} END"
_fill("k2_fill_mean", "mean", f"(SELECT {X.number_text('v')} FROM (SELECT avg({_AGE}) AS v FROM gaps))")
_fill(
    "k3_fill_median", "median", f"(SELECT {X.number_text('v')} FROM (SELECT median({_AGE}) AS v FROM gaps))"
)
_action(
    "k4_fill_fixed",
    _do("fill_missing", field="channel", strategy="fixed", value="未知"),
    _replaced("channel", f"CASE WHEN {X.missing('channel')} THEN '未知' ELSE channel END"),
)
_VALUE = f"CASE WHEN NOT {X.missing('channel')} THEN channel END"
_action(
    "k5_fill_ffill",
    _do("fill_missing", field="channel", strategy="ffill"),
    _replaced(
        "channel",
        f"coalesce(last_value({_VALUE} IGNORE NULLS) OVER (ORDER BY row_no"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')",
    ),
)
_action(
    "k6_fill_bfill",
    _do("fill_missing", field="channel", strategy="bfill"),
    _replaced(
        "channel",
        f"coalesce(first_value({_VALUE} IGNORE NULLS) OVER (ORDER BY row_no"
        " ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '')",
    ),
)

# --- duplicates, types, dates ------------------------------------------------------------------

_action(
    "k7_drop_duplicates",
    _do("drop_duplicates", columns=None),
    f"SELECT min(row_no) AS row_no, {ORDERS} FROM dirty_orders GROUP BY {ORDERS}",
)
_action(
    "k7_drop_duplicates_by",
    _do("drop_duplicates", columns=["user_id", "channel"]),
    f"""SELECT row_no, {ORDERS} FROM (SELECT *, row_number() OVER (PARTITION BY user_id, channel
        ORDER BY row_no) AS k FROM dirty_orders) WHERE k = 1""",
)
_AMOUNT_TEXT = f"coalesce({X.number_text(_num('amount'))}, amount)"
_action(
    "k8_convert_number",
    _do("convert_type", field="amount", target="number"),
    _replaced("amount", _AMOUNT_TEXT),
)
_action(
    "k8_convert_number_typed",
    _do("convert_type", field="amount", target="number", mode="typed"),
    _replaced("amount", _num("amount")),
)
_ISO = f"coalesce(strftime({X.date_value('order_date')}, '%Y-%m-%d'), order_date)"
_action(
    "k9_convert_date",
    _do("convert_type", field="order_date", target="date"),
    _replaced("order_date", _ISO),
)
_action(
    "k10_normalize_date",
    _do("normalize_date", field="order_date", output_format="YYYY/MM/DD"),
    _replaced("order_date", _ISO.replace("%Y-%m-%d", "%Y/%m/%d")),
)

# --- sorting -----------------------------------------------------------------------------------


def _sorted(order: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) AS row_no, {ORDERS} FROM dirty_orders"


_action(
    "k15_sort_numeric_desc",
    _do("sort_rows", field="amount", order="desc"),
    _sorted(f"{_num('amount')} DESC, row_no DESC"),
)
_action(
    "k15_sort_text",
    _do("sort_rows", field="channel", order="asc"),
    _sorted("encode(channel), row_no"),
)

@query(
    "k10_normalize_any_date",
    """SELECT o_orderkey + 1 AS row_no, strftime(o_orderdate::DATE, '%Y-%m-%d') AS day FROM orders""",
)
def k10_any(t: Tables):
    """The same days written in seven ways; the days beyond the twelfth say that the day comes first."""
    day, style = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 7
    patterns = ("yyyyMMdd", "y.M.d", "MMM d, yyyy", "d/M/yyyy", "d MMMM yyyy", "dd.MM.yyyy", "yyyy-MM-dd")
    written = F.coalesce(*(F.when(style == i, F.date_format(day, p)) for i, p in enumerate(patterns)))
    df = t.orders.select((F.col("o_orderkey") + 1).alias("row_no"), written.alias("day"))
    return P.run_action(df, _do("normalize_date", field="day", output_format="YYYY-MM-DD", day_first="auto"))


# --- anomalies ---------------------------------------------------------------------------------


def _sigma(field: str, table: str) -> str:
    n = _num(field)
    return f"""coalesce((SELECT stddev_samp({n}) > 0 FROM {table}) AND
        ({n} < (SELECT avg({n}) - 3 * stddev_samp({n}) FROM {table})
         OR {n} > (SELECT avg({n}) + 3 * stddev_samp({n}) FROM {table})), false)"""


def _bad(field: str) -> str:
    n = _num(field)
    return f"coalesce({n} < 0{f' OR {n} > 120' if field == 'age' else ''}, false)"


_ANY = " OR ".join(
    [_bad("age"), _bad("amount")]
    + [_sigma(c, "dirty_orders") for c in ("order_id", "user_id", "order_date", "channel")]
)


@query(
    "k16_detect_anomalies",
    duck(f"SELECT row_no, {_ANY} AS hit FROM dirty_orders", "dirty_orders"),
)
def k16(t: Tables):
    return t.dirty_orders.select("row_no", anomaly_test(t.dirty_orders).alias("hit"))


_action(
    "k17_anomaly_drop", _do("handle_anomaly", field="age", mode="drop"), f"{_ALL} NOT {_bad('age')}"
)
_action(
    "k18_anomaly_mark",
    _do("handle_anomaly", field="phone", mode="mark"),
    f"SELECT *, CASE WHEN {_sigma('phone', 'dirty_users')} THEN '1' ELSE '0' END AS is_anomaly FROM dirty_users",
    "dirty_users",
)


@query(
    "k17_anomaly_drop_listed",
    duck(
        f"""WITH p AS (SELECT row_number() OVER (ORDER BY row_no) AS place, * FROM dirty_orders)
        SELECT row_no, {ORDERS} FROM p WHERE place NOT IN (SELECT event_id + 1 FROM events)""",
        "dirty_orders",
    ),
)
def k17_listed(t: Tables):
    listed = t.events.select((F.col("event_id") + 1).alias("row_no"))
    return P.run_action(t.dirty_orders, _do("handle_anomaly", mode="drop", anomaly_rows=listed))


# --- chains and presets ------------------------------------------------------------------------

_DEDUP = f"d AS (SELECT min(row_no) AS row_no, {ORDERS} FROM dirty_orders GROUP BY {ORDERS})"
_CLEANED = f"""SELECT row_no, order_id, user_id, {_ISO} AS order_date, {_AMOUNT_TEXT} AS amount, age,
    CASE WHEN {X.missing('channel')} THEN '未知' ELSE channel END AS channel
    FROM d WHERE NOT {_bad('age')}"""
_KEPT_USERS = f"""SELECT row_no, id, trim(name) AS name, trim(city) AS city, trim(phone) AS phone, idcard,
    CASE WHEN {_sigma('phone', 'dirty_users')} THEN '1' ELSE '0' END AS is_anomaly
    FROM dirty_users WHERE NOT {X.missing('name')}"""

CHAIN = [
    _do("filter_rows", field="amount", operator=">", value=0),
    _do("convert_type", field="amount", target="number"),
    _do("fill_missing", field="channel", strategy="fixed", value="other"),
    _do("rename_field", old_name="channel", new_name="source"),
    _do("drop_duplicates", columns=["user_id", "source"]),
    _do("drop_field", field="age"),
]


@query(
    "k19_run_actions",
    duck(
        f"""WITH c AS (SELECT row_no, order_id, user_id, order_date, {_AMOUNT_TEXT} AS amount,
                CASE WHEN {X.missing('channel')} THEN 'other' ELSE channel END AS source
            FROM dirty_orders WHERE coalesce({_num('amount')} > 0, false))
        SELECT row_no, order_id, user_id, order_date, amount, source FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY row_no) AS k FROM c)
        WHERE k = 1""",
        "dirty_orders",
    ),
)
def k19(t: Tables):
    return P.run_actions(t.dirty_orders, CHAIN)


@query(
    "k20_preview",
    duck(
        f"""WITH s AS (SELECT * FROM dirty_orders ORDER BY row_no LIMIT 1000),
        f AS (SELECT *, {_AMOUNT_TEXT} <> amount AS shown, {X.missing('channel')} AS gap FROM s WHERE {_num('amount')} > 0),
        n AS (SELECT (SELECT count(*) FROM s) AS a, count(*) AS b, count(*) FILTER (shown) AS c, count(*) FILTER (gap) AS d,
            count(DISTINCT (user_id, CASE WHEN gap THEN 'other' ELSE channel END)) AS e FROM f)
        SELECT unnest(range(1, 7)) AS step,
            unnest(['filter_rows', 'convert_type', 'fill_missing', 'rename_field', 'drop_duplicates', 'drop_field']) AS type,
            true AS ok, NULL::VARCHAR AS error, unnest([a, b, b, b, b, e]) AS rows_before,
            unnest([b, b, b, b, e, e]) AS rows_after, unnest([a - b, c, d, 0, b - e, 0]) AS affected_rows FROM n""",
        "dirty_orders",
    ),
)
def k20(t: Tables):
    return P.preview(t.dirty_orders, CHAIN).drop("samples")


@query(
    "k21_affected_rows",
    duck(
        f"""SELECT count(*) AS rows_before, count(*) AS rows_after,
            count(*) FILTER ({_AMOUNT_TEXT} <> amount) AS affected_rows FROM dirty_orders""",
        "dirty_orders",
    ),
)
def k21(t: Tables):
    after = P.run_action(t.dirty_orders, _do("convert_type", field="amount", target="number"))
    return P.affected_rows(t.dirty_orders, after)


@query(
    "k21_affected_rows_dropped",
    duck(
        """SELECT count(*) AS rows_before, count(DISTINCT order_id) AS rows_after,
            count(*) - count(DISTINCT order_id) AS affected_rows FROM dirty_orders""",
        "dirty_orders",
    ),
)
def k21_dropped(t: Tables):
    after = P.run_action(t.dirty_orders, _do("drop_duplicates", columns=None))
    return P.affected_rows(t.dirty_orders, after)


@query(
    "k22_sample_pairs",
    duck(
        f"""SELECT row_number() OVER (ORDER BY row_no) AS position,
            {', '.join(f'{c} AS before_{c}' for c in ORDER_COLUMNS)},
            {', '.join(f'{_ISO if c == "order_date" else c} AS after_{c}' for c in ORDER_COLUMNS)}
        FROM dirty_orders ORDER BY row_no LIMIT 5""",
        "dirty_orders",
    ),
)
def k22(t: Tables):
    after = P.run_action(t.dirty_orders, _do("normalize_date", field="order_date"))
    return P.sample_pairs(t.dirty_orders, after)


@query(
    "k23_change_stats",
    duck(
        f"""WITH {_DEDUP}, r AS (SELECT (SELECT count(*) FROM dirty_orders) AS rows_before,
                (SELECT count(*) FROM d) AS deduped,
                (SELECT count(*) FROM d WHERE NOT {_bad('age')}) AS rows_after,
                (SELECT count(*) FROM d WHERE {X.missing('channel')}) AS missing_filled)
        SELECT rows_before, rows_after, rows_before - rows_after AS rows_removed,
            6::BIGINT AS cols_before, 6::BIGINT AS cols_after, 5::BIGINT AS actions_count, missing_filled,
            0::BIGINT AS strip_count, rows_before - deduped AS rows_dropped_dedup,
            deduped - rows_after AS rows_dropped_anomaly, 0::BIGINT AS rows_dropped_filter,
            0::BIGINT AS rows_dropped_missing, NULL::BIGINT AS rows_after_filter,
            'amount' AS fields_converted, 'order_date' AS dates_normalized
        FROM r""",
        "dirty_orders",
    ),
)
def k23(t: Tables):
    return P.change_stats(t.dirty_orders, P.PRESETS[P.ORDERS_PRESET])


@query(
    "k23_change_stats_users",
    duck(
        f"""SELECT count(*) AS rows_before, count(*) FILTER (NOT {X.missing('name')}) AS rows_after,
            count(*) FILTER ({X.missing('name')}) AS rows_removed, 5::BIGINT AS cols_before,
            6::BIGINT AS cols_after, 4::BIGINT AS actions_count, 0::BIGINT AS missing_filled,
            count(*) FILTER (trim(city) <> city) + count(*) FILTER (trim(name) <> name) AS strip_count,
            0::BIGINT AS rows_dropped_dedup, 0::BIGINT AS rows_dropped_anomaly,
            0::BIGINT AS rows_dropped_filter,
            count(*) FILTER ({X.missing('name')}) AS rows_dropped_missing,
            NULL::BIGINT AS rows_after_filter, '' AS fields_converted, '' AS dates_normalized
        FROM dirty_users""",
        "dirty_users",
    ),
)
def k23_users(t: Tables):
    types = P.column_types(C.infer_types(t.dirty_users))
    return P.change_stats(t.dirty_users, P.apply_preset(P.USERS_PRESET, types))


@query("k24_preset_orders", duck(f"WITH {_DEDUP} {_CLEANED}", "dirty_orders"))
def k24(t: Tables):
    return P.run_actions(t.dirty_orders, P.PRESETS[P.ORDERS_PRESET])


@query("k25_preset_users", duck(_KEPT_USERS, "dirty_users"))
def k25(t: Tables):
    types = P.column_types(C.infer_types(t.dirty_users))
    return P.run_actions(t.dirty_users, P.apply_preset(P.USERS_PRESET, types))


@query(
    "k27_ledger_timeline",
    duck(
        """SELECT r.id, r.file_id, r.preset_id, r.output_file_id, p.name AS preset_name,
            f.origin_name AS output_name
        FROM clean_records r LEFT JOIN presets p ON p.id = r.preset_id
        LEFT JOIN files f ON f.id = r.output_file_id""",
        "clean_records", "presets", "files",
    ),
)
def k27(t: Tables):
    return timeline(t.clean_records, t.presets, t.files)


@query(
    "h16_suggestions_to_actions",
    duck(
        _replaced("amount", _AMOUNT_TEXT).replace("order_date", f"{_ISO} AS order_date", 1),
        "dirty_orders",
    ),
)
def h16(t: Tables):
    from tidymill.operators.health import suggestions_to_actions, type_suggestions

    return P.run_actions(t.dirty_orders, suggestions_to_actions(type_suggestions(t.dirty_orders)))


@query(
    "j7_drop_listed_anomalies",
    duck(
        f"""WITH p AS (SELECT row_number() OVER (ORDER BY row_no) AS row_no, {ORDERS} FROM dirty_orders)
        SELECT * FROM p WHERE NOT ({_bad('age')} OR {_bad('amount')})""",
        "dirty_orders",
    ),
)
def j7(t: Tables):
    from tidymill.sources.numbering import renumber

    # positions come from the profile of the same frame
    numbered = renumber(t.dirty_orders)
    rule_hits = anomaly_list(numbered).where(F.col("rules").contains("当前值"))
    return P.run_action(numbered, _do("handle_anomaly", mode="drop", anomaly_rows=rule_hits))


# --- versions ----------------------------------------------------------------------------------

_LIVE = """live AS (SELECT seq, version, kind, source FROM (
    SELECT *, row_number() OVER (PARTITION BY version ORDER BY seq DESC) AS n FROM ledger) WHERE n = 1 AND kind = 'run')"""


@query("s7_live_versions", duck(f"WITH {_LIVE} SELECT * FROM live", "ledger"))
def s7_live(t: Tables):
    return V.live_versions(t.ledger)


@query(
    "s8_source_states",
    duck(
        f"""WITH {_LIVE}, c AS (SELECT source, count(*) AS n, arg_max(version, seq) AS version FROM live GROUP BY source)
        SELECT DISTINCT l.source, CASE WHEN n > 0 THEN 'cleaned' ELSE 'imported' END AS status,
            coalesce(n, 0) AS live_cnt, c.version FROM ledger l LEFT JOIN c ON l.source = c.source""",
        "ledger",
    ),
)
def s8_states(t: Tables):
    return V.source_states(t.ledger)


def _stored(t: Tables) -> tuple[str, str]:
    """A version of the messy orders, below the shared folder."""
    base = f"{checkpoint_dir(t.spark)}/versions-{uuid.uuid4().hex}"
    return base, V.write_version(t.dirty_orders, P.PRESETS[P.ORDERS_PRESET], base, "orders.csv")


@query(
    "s7_version_rows",
    duck(f"WITH {_DEDUP}, p AS ({_CLEANED}) SELECT * REPLACE (row_number() OVER (ORDER BY row_no) AS row_no) FROM p", "dirty_orders"),
)
def s7_rows(t: Tables):
    return V.read_version(t.spark, *_stored(t))


@query(
    "s7_version_record",
    duck(
        f"""WITH {_DEDUP}, p AS ({_CLEANED})
        SELECT 'run' AS kind, 'orders.csv' AS source, (SELECT count(*) FROM dirty_orders)::VARCHAR AS rows_before,
            (SELECT count(*) FROM p)::VARCHAR AS rows_after,
            ((SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM d))::VARCHAR AS rows_dropped_dedup,
            6::BIGINT AS fields""",
        "dirty_orders",
    ),
)
def s7_record(t: Tables):
    base, _ = _stored(t)
    names = ("rows_before", "rows_after", "rows_dropped_dedup")
    return V.ledger(t.spark, base).select(
        "kind", "source", *(F.col("stats")[n].alias(n) for n in names), F.size("fields").cast("bigint").alias("fields")
    )
