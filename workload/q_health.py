"""Health profile over messy orders and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymill.operators import health as H
from workload import fixtures as X
from workload.fixtures import Tables, duck
from workload.q_functions import LONG_ORDERS, LONG_USERS, ORDER_COLUMNS
from workload.registry import query

_MISSING = f"""SELECT field, count(*) FILTER ({X.missing('value')}) AS missing, count(*) AS total,
    round(count(*) FILTER ({X.missing('value')}) / count(*), 4) AS rate,
    count(*) FILTER ({X.missing('value')}) / count(*) > 0.2 AS warn FROM long GROUP BY field"""


@query("h1_missing_report", duck(f"WITH {LONG_ORDERS} {_MISSING}", "dirty_orders"))
def h1(t: Tables):
    return H.missing_report(t.dirty_orders)


def _dups(keys: str) -> str:
    return f"""SELECT coalesce(sum(n - 1), 0)::BIGINT AS dup_rows, count(*) AS dup_groups
        FROM (SELECT count(*) AS n FROM dirty_orders GROUP BY {keys}) WHERE n > 1"""


@query("h2_duplicates_full", duck(_dups(", ".join(ORDER_COLUMNS)), "dirty_orders"))
def h2(t: Tables):
    return H.duplicate_counts(t.dirty_orders)


@query("h3_duplicates_by", duck(_dups("user_id, channel"), "dirty_orders"))
def h3(t: Tables):
    return H.duplicates_by(t.dirty_orders, ["user_id", "channel"])


def _dup_samples(keys: list[str]) -> str:
    listed = ", ".join(keys)
    return f"""SELECT min(row_no) AS first_row,
        array_to_string(list(row_no ORDER BY row_no)[1:6], '|') AS row_nos,
        greatest(count(*) - 6, 0) AS extra, {listed}
    FROM dirty_orders GROUP BY {listed} HAVING count(*) > 1 ORDER BY first_row LIMIT 20"""


@query("h4_duplicate_samples", duck(_dup_samples(ORDER_COLUMNS), "dirty_orders"))
def h4(t: Tables):
    return H.duplicate_samples(t.dirty_orders)


@query("h4_duplicate_samples_by", duck(_dup_samples(["channel", "age"]), "dirty_orders"))
def h4_by(t: Tables):
    return H.duplicate_samples(t.dirty_orders, ["channel", "age"])


@query(
    "h4_duplicate_rows",
    duck(
        """SELECT row_no, first_row, cnt FROM (SELECT row_no, min(row_no) OVER w AS first_row, count(*) OVER w AS cnt
            FROM dirty_orders WINDOW w AS (PARTITION BY channel, age, order_date)) WHERE cnt > 1""",
        "dirty_orders",
    ),
)
def h4_rows(t: Tables):
    return H.duplicate_rows(t.dirty_orders, ["channel", "age", "order_date"])


_BOUNDS = f"""num AS (SELECT row_no, field, {X.strip('value')} AS v,
        CASE WHEN NOT {X.missing('value')} THEN {X.number('value')} END AS x,
        NOT {X.missing('value')} AS there FROM long),
bounds AS (SELECT field, count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std,
        avg(x) - 3 * stddev_pop(x) AS lo, avg(x) + 3 * stddev_pop(x) AS hi
    FROM num WHERE field NOT IN ('order_id', 'user_id', 'id', 'phone', 'idcard') GROUP BY field
    HAVING count(*) FILTER (there) >= 20 AND count(x) / count(*) FILTER (there) >= 0.8)"""


@query(
    "h5_numeric_stats",
    duck(
        f"""WITH {LONG_ORDERS}, {_BOUNDS} SELECT field, n, round(mean, 4) AS mean, round(std, 4) AS std,
            round(lo, 4) AS lo, round(hi, 4) AS hi FROM bounds""",
        "dirty_orders",
    ),
)
def h5(t: Tables):
    return H.numeric_stats(t.dirty_orders).select(
        "field", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "lo", "hi")]
    )


_RULE = """CASE WHEN field = 'age' THEN x < 0 OR x > 120 WHEN field = 'amount' THEN x < 0
           ELSE false END"""
_FLAGS = f"""flags AS (SELECT num.*, {_RULE} AS rule, coalesce(x < lo OR x > hi, false) AS sigma,
        mean, lo, hi FROM num LEFT JOIN bounds USING (field) WHERE x IS NOT NULL)"""


@query(
    "h6_anomaly_rule",
    duck(
        f"WITH {LONG_ORDERS}, {_BOUNDS}, {_FLAGS} SELECT row_no, field, x AS number FROM flags WHERE rule",
        "dirty_orders",
    ),
)
def h6(t: Tables):
    return H.flagged_cells(t.dirty_orders).where("rule").select("row_no", "field", "number")


@query(
    "h7_anomaly_sigma",
    duck(
        f"""WITH c AS (SELECT row_no, unnest({ORDER_COLUMNS[2:]}) AS field,
                unnest([{', '.join(ORDER_COLUMNS[2:])}]) AS value FROM dirty_orders),
        n AS MATERIALIZED (SELECT row_no, field, NOT {X.missing('value')} AS there,
                CASE WHEN NOT {X.missing('value')} THEN {X.number('value')} END AS x FROM c),
        b AS MATERIALIZED (SELECT field, avg(x) - 3 * stddev_pop(x) AS lo, avg(x) + 3 * stddev_pop(x) AS hi
            FROM n GROUP BY field HAVING count(*) FILTER (there) >= 20 AND count(x) / count(*) FILTER (there) >= 0.8)
        SELECT row_no, n.field, x AS number FROM n JOIN b ON n.field = b.field WHERE x < lo OR x > hi""",
        "dirty_orders",
    ),
)
def h7(t: Tables):
    return H.flagged_cells(t.dirty_orders).where("sigma").select("row_no", "field", "number")


def _six_digits(x: str) -> str:
    """Plain six significant digits; all numbers here lie between 1e-4 and 1e6 in size."""
    scale = f"power(10.0, 5 - floor(log10(abs({x}))))"
    return f"rtrim(rtrim((round({x} * {scale}) / {scale})::DECIMAL(38, 12)::VARCHAR, '0'), '.')"


_LISTED = f"""listed AS (
    SELECT row_no, field, v AS value, concat_ws('；',
        CASE WHEN rule THEN CASE WHEN field = 'age' THEN '年龄应在 0~120 之间，当前值 '
             ELSE '金额/价格不应为负，当前值 ' END || {_six_digits('x')} END,
        CASE WHEN sigma THEN printf('超出 3σ 正常范围（均值 %.2f，参考区间 [%.2f, %.2f]）', mean, lo, hi) END)
        AS rules FROM flags WHERE rule OR sigma),
numbered AS (SELECT *, row_number() OVER (ORDER BY row_no, field) AS id FROM listed)"""


@query(
    "h8_anomaly_list",
    duck(
        f"""WITH {LONG_ORDERS}, {_BOUNDS}, {_FLAGS}, {_LISTED}
        SELECT *, false AS confirmed FROM numbered""",
        "dirty_orders",
    ),
)
def h8(t: Tables):
    return H.anomaly_list(t.dirty_orders)


@query(
    "h8_anomaly_totals",
    duck(
        f"""WITH {LONG_ORDERS}, {_BOUNDS}, {_FLAGS}
        SELECT count(*) AS anomaly_cnt FROM flags
        WHERE rule OR sigma""",
        "dirty_orders",
    ),
)
def h8_totals(t: Tables):
    return H.anomaly_totals(t.dirty_orders)


_STYLES = " UNION ALL ".join(
    f"SELECT row_no, field, {X.strip('value')} AS v, '{s}' AS style FROM long"
    f" WHERE NOT {X.missing('value')} AND {X.date_text('value')} AND contains(value, '{m}')"
    for s, m in (("slash", "/"), ("dash", "-"), ("cn", "年"))
)


@query(
    "h9_date_format_mix",
    duck(
        f"""WITH {LONG_ORDERS}, styled AS ({_STYLES}),
        g AS (SELECT field, style, count(*) AS cnt,
                     array_to_string(list(v ORDER BY row_no)[1:3], '|') AS samples
              FROM styled GROUP BY field, style)
        SELECT field, style, cnt, samples FROM g
        WHERE field IN (SELECT field FROM g GROUP BY field HAVING count(*) >= 2)""",
        "dirty_orders",
    ),
)
def h9(t: Tables):
    return H.date_format_mix(t.dirty_orders)


_BAD = {
    "phone": f"field = 'phone' AND NOT {X.missing('value')}"
    f" AND NOT regexp_matches({X.strip('value')}, '^[0-9]{{11}}$')",
    "idcard": f"field = 'idcard' AND NOT {X.missing('value')}"
    f" AND NOT regexp_matches({X.strip('value')}, '^[0-9]{{17}}[0-9Xx]$')",
    "space": f"NOT {X.missing('value')} AND value <> {X.strip('value')}",
}


def _register_bad(key: str, kind: str) -> None:
    shown = "value" if kind == "space" else X.strip("value")
    items = f"SELECT field, row_no, {shown} AS value FROM long WHERE {_BAD[kind]}"
    query(f"{key}_items", duck(f"WITH {LONG_USERS} {items}", "dirty_users"))(
        lambda t: H.bad_format_items(t.dirty_users, kind)
    )
    counts = f"SELECT field, count(*) AS bad_count FROM long WHERE {_BAD[kind]} GROUP BY field"
    query(key, duck(f"WITH {LONG_USERS} {counts}", "dirty_users"))(
        lambda t: H.bad_format_counts(t.dirty_users, kind)
    )


_register_bad("h10_bad_phones", "phone")
_register_bad("h11_bad_idcards", "idcard")
_register_bad("h12_edge_spaces", "space")


_FACTS = f"""facts AS (SELECT field, position, count(*) FILTER (NOT {X.missing('value')}) AS filled,
    count(*) FILTER (NOT {X.missing('value')} AND {X.thousands('value')}) AS th,
    min_by({X.strip('value')}, row_no) FILTER (NOT {X.missing('value')} AND {X.thousands('value')}) AS ths,
    count(*) FILTER (NOT {X.missing('value')} AND {X.date_text('value')}) AS d
    FROM long GROUP BY field, position),
styled AS ({_STYLES}),
firsts AS (SELECT field, coalesce(min_by(v, row_no) FILTER (style = 'slash'),
    min_by(v, row_no) FILTER (style = 'dash'), min_by(v, row_no) FILTER (style = 'cn')) AS ds
    FROM styled GROUP BY field),
advice AS (
  SELECT position, 1 AS k, field, 'number' AS kind, 'convert_number' AS action,
    '含 ' || th || ' 个千分位格式数字文本（如 ' || ths || '），去逗号后可转为数值' AS reason, ths AS sample
  FROM facts WHERE th > 0
  UNION ALL
  SELECT position, 2, field, 'date', 'convert_date',
    printf('%.1f', round(d / filled * 100, 1)) || '% 的值匹配日期格式（如 ' || ds || '），建议转为日期类型', ds
  FROM facts JOIN firsts USING (field) WHERE filled > 0 AND d / filled >= 0.8)"""


@query(
    "h13_type_suggestions",
    duck(
        f"""WITH {LONG_ORDERS}, {_FACTS} SELECT row_number() OVER (ORDER BY position, k) AS id,
            field, kind, action, reason, sample FROM advice""",
        "dirty_orders",
    ),
)
def h13(t: Tables):
    return H.type_suggestions(t.dirty_orders)


def _summary_sql(long: str, table: str, columns: list[str]) -> str:
    listed = ", ".join(columns)
    return duck(
        f"""WITH {long}, {_BOUNDS}, {_FLAGS}, {_FACTS},
        miss AS ({_MISSING}),
        dup AS (SELECT count(*) AS n FROM {table} GROUP BY {listed} HAVING count(*) > 1),
        mixed AS (SELECT field FROM (SELECT DISTINCT field, style FROM styled) GROUP BY field
                  HAVING count(*) >= 2)
        SELECT (SELECT count(*) FROM {table}) AS row_count, {len(columns)}::BIGINT AS col_count,
            (SELECT count(*) FROM miss WHERE missing > 0) AS missing_fields_cnt,
            (SELECT count(*) FROM miss WHERE warn) AS missing_warn_cnt,
            (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM dup) AS dup_rows,
            (SELECT count(*) FROM dup) AS dup_groups,
            (SELECT count(*) FROM flags WHERE rule OR sigma) AS anomaly_cnt,
            (SELECT count(*) FROM mixed)
              + (SELECT count(*) FROM long WHERE {_BAD['phone']})
              + (SELECT count(*) FROM long WHERE {_BAD['idcard']})
              + (SELECT count(*) FROM long WHERE {_BAD['space']}) AS format_issue_cnt,
            (SELECT count(*) FROM advice) AS type_suggest_cnt""",
        table,
    )


@query("h14_profile_summary", _summary_sql(LONG_ORDERS, "dirty_orders", ORDER_COLUMNS))
def h14(t: Tables):
    return H.profile_summary(t.dirty_orders)


@query(
    "h14_profile_summary_users",
    _summary_sql(LONG_USERS, "dirty_users", ["id", "name", "city", "phone", "idcard"]),
)
def h14_users(t: Tables):
    return H.profile_summary(t.dirty_users)


@query(
    "h15_confirm_anomalies",
    duck(
        f"""WITH {LONG_ORDERS}, {_BOUNDS}, {_FLAGS}, {_LISTED},
        chosen AS (SELECT DISTINCT user_id AS id FROM events)
        SELECT n.id, row_no, field, c.id IS NOT NULL AS confirmed, c.id IS NOT NULL AS newly
        FROM numbered n LEFT JOIN chosen c USING (id)""",
        "dirty_orders",
    ),
)
def h15(t: Tables):
    chosen = t.events.select(F.col("user_id").alias("id"))
    done = H.confirm_anomalies(H.anomaly_list(t.dirty_orders), chosen)
    return done.select("id", "row_no", "field", "confirmed", "newly")


@query(
    "h17_latest_profile",
    """SELECT user_id AS file_id, max(event_id) AS id, arg_max(props, event_id) AS report_json
    FROM events GROUP BY user_id""",
)
def h17(t: Tables):
    profiles = t.events.selectExpr("event_id AS id", "user_id AS file_id", "props AS report_json")
    return H.latest_profiles(profiles)
