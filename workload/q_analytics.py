"""Analytic query library and report aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymill.functions import text as T
from tidymill.operators.calc import calc
from tidymill.plans import analytics as A
from tidymill.plans.catalog import count_by
from tidymill.session import pin
from workload.fixtures import Tables, duck, missing, number, number_text, pct
from workload.registry import query

_DAYS = "u AS (SELECT DISTINCT user_id, ts::DATE AS dt FROM events)"


@query(
    "l1_next_day_retention",
    f"""WITH {_DAYS}
    SELECT a.dt::VARCHAR AS dt, count(DISTINCT a.user_id) AS active_users,
           count(DISTINCT b.user_id) AS retained_users,
           {pct('count(DISTINCT b.user_id)', 'count(DISTINCT a.user_id)')} AS retention_pct
    FROM u a LEFT JOIN u b ON a.user_id = b.user_id AND b.dt = a.dt + 1 GROUP BY a.dt""",
)
def l1(t: Tables):
    return A.next_period_retention(t.events, "user_id", "ts")


@query(
    "l2_retention_matrix_7d",
    f"""WITH {_DAYS}, r AS (SELECT user_id, min(dt) AS reg_dt FROM u GROUP BY user_id)
    SELECT r.reg_dt::VARCHAR AS reg_dt, count(DISTINCT r.user_id) AS new_users,
           {', '.join(f"count(DISTINCT CASE WHEN u.dt = r.reg_dt + {k} THEN r.user_id END) AS d{k}"
                      for k in range(1, 8))},
           {pct("count(DISTINCT CASE WHEN u.dt = r.reg_dt + 7 THEN r.user_id END)",
                "count(DISTINCT r.user_id)")} AS d7_rate_pct
    FROM r LEFT JOIN u ON u.user_id = r.user_id AND u.dt > r.reg_dt AND u.dt <= r.reg_dt + 7
    GROUP BY r.reg_dt""",
)
def l2(t: Tables):
    registered = t.events.groupBy("user_id").agg(F.min(F.col("ts").cast("date")).alias("reg_dt"))
    return A.retention_matrix(registered, t.events, "user_id", "reg_dt", "ts")


_STEPS = ["view", "click", "signup", "purchase"]


def _funnel_sql(source: str, user: str, event: str, steps: list[str]) -> str:
    n = len(steps)
    flags = ", ".join(
        f"max(CASE WHEN {event} = '{s}' THEN 1 ELSE 0 END) AS s{k}" for k, s in enumerate(steps, 1)
    )
    sums = ", ".join(f"sum(s{k})::BIGINT AS s{k}" for k in range(1, n + 1))
    rates = ", ".join(
        f"{pct(f'sum(s{k})', f'sum(s{k - 1})')} AS s{k - 1}_s{k}_pct" for k in range(2, n + 1)
    )
    return f"""SELECT count(*) AS users, {sums}, {rates}, {pct(f'sum(s{n})', 'sum(s1)')} AS overall_pct
        FROM (SELECT {user}, {flags} FROM {source} GROUP BY {user})"""


@query("l3_funnel", _funnel_sql("events", "user_id", "event_type", _STEPS))
def l3(t: Tables):
    return A.funnel(t.events, "user_id", "event_type", "ts", _STEPS)


@query("l3_funnel_order_status", _funnel_sql("orders", "o_custkey", "o_orderstatus", ["O", "F", "P"]))
def l3_orders(t: Tables):
    return A.funnel(t.orders, "o_custkey", "o_orderstatus", "o_orderdate", ["O", "F", "P"])


@query(
    "l3b_funnel_strict",
    f"""SELECT count(*) AS users, sum(a)::BIGINT AS s1, sum(b)::BIGINT AS s2, sum(c)::BIGINT AS s3,
        {pct('sum(b)', 'sum(a)')} AS s1_s2_pct, {pct('sum(c)', 'sum(b)')} AS s2_s3_pct,
        {pct('sum(c)', 'sum(a)')} AS overall_pct
    FROM (SELECT CASE WHEN t1 IS NOT NULL THEN 1 ELSE 0 END AS a,
                 CASE WHEN t2 >= t1 THEN 1 ELSE 0 END AS b,
                 CASE WHEN t2 >= t1 AND t3 >= t2 THEN 1 ELSE 0 END AS c
          FROM (SELECT o_custkey, min(o_orderdate) FILTER (o_orderstatus = 'O') AS t1,
                       min(o_orderdate) FILTER (o_orderstatus = 'F') AS t2,
                       min(o_orderdate) FILTER (o_orderstatus = 'P') AS t3
                FROM orders GROUP BY o_custkey))""",
)
def l3b(t: Tables):
    return A.funnel_strict(t.orders, "o_custkey", "o_orderstatus", "o_orderdate", ["O", "F", "P"])


_TOP = "o_orderpriority, o_orderkey, o_totalprice, rn"


@query(
    "l4_group_top_n",
    f"""SELECT {_TOP} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
        ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""",
)
def l4(t: Tables):
    top = A.group_top_n(t.orders, "o_orderpriority", "o_totalprice", 3, tiebreak=["o_orderkey"])
    return top.select(*_TOP.split(", "))


def _ties_sql(rank: str, n: int) -> str:
    # whole days have many orders, so ties are common
    return f"""SELECT o_orderpriority, o_orderkey, o_orderdate::VARCHAR AS o_orderdate, rn
        FROM (SELECT *, {rank}() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC) AS rn
              FROM orders) WHERE rn <= {n}"""


@query("l4b_group_top_n_rank", _ties_sql("rank", 5).replace("::VARCHAR", "::DATE::VARCHAR"))
def l4b_rank(t: Tables):
    return _ties(t, 5, False)


@query("l4b_group_top_n_dense", _ties_sql("dense_rank", 3).replace("::VARCHAR", "::DATE::VARCHAR"))
def l4b_dense(t: Tables):
    return _ties(t, 3, True)


def _ties(t: Tables, n: int, dense: bool):
    top = A.group_top_n_ties(t.orders, "o_orderpriority", "o_orderdate", n, dense=dense)
    return top.select(
        "o_orderpriority", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "rn"
    )


@query(
    "l5_streaks",
    f"""WITH {_DAYS}
    SELECT user_id AS user, min(dt)::VARCHAR AS start_dt, max(dt)::VARCHAR AS end_dt, count(*) AS days
    FROM (SELECT *, dt - (row_number() OVER (PARTITION BY user_id ORDER BY dt))::INTEGER AS g FROM u)
    GROUP BY user_id, g HAVING count(*) >= 3""",
)
def l5(t: Tables):
    return A.streaks(t.events, "user_id", "ts", 3)


def _growth_sql(grain: str, year: int) -> str:
    def change(base: str) -> str:
        return f"round((total - {base}) / nullif({base}, 0) * 100, 2)"

    return f"""SELECT period::DATE::VARCHAR AS period, round(total, 2) AS total,
        round(p, 2) AS prev_total, round(y, 2) AS year_ago_total,
        {change('p')} AS prev_growth_pct, {change('y')} AS year_growth_pct
    FROM (SELECT *, lag(total, 1) OVER (ORDER BY period) AS p, lag(total, {year}) OVER (ORDER BY period) AS y
          FROM (SELECT date_trunc('{grain}', o_orderdate) AS period, sum(o_totalprice) AS total
                FROM orders GROUP BY 1))"""


@query("l6_mom_yoy", _growth_sql("month", 12))
def l6(t: Tables):
    return A.growth(t.orders, "o_orderdate", "o_totalprice")


@query("l6b_growth_week", _growth_sql("week", 52))
def l6_week(t: Tables):
    return A.growth(t.orders, "o_orderdate", "o_totalprice", "week")


@query("l6b_growth_quarter", _growth_sql("quarter", 4))
def l6_quarter(t: Tables):
    return A.growth(t.orders, "o_orderdate", "o_totalprice", "quarter")


@query(
    "l6_mom_yoy_calendar",
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS total
                  FROM orders GROUP BY 1)
    SELECT m.period::VARCHAR AS period, round(m.total, 2) AS total, round(p.total, 2) AS prev_total,
           round(y.total, 2) AS year_ago_total,
           round((m.total - p.total) / nullif(p.total, 0) * 100, 2) AS prev_growth_pct,
           round((m.total - y.total) / nullif(y.total, 0) * 100, 2) AS year_growth_pct
    FROM m LEFT JOIN m p ON p.period = m.period - INTERVAL 1 MONTH
           LEFT JOIN m y ON y.period = m.period - INTERVAL 12 MONTH""",
)
def l6_calendar(t: Tables):
    return A.growth(t.orders, "o_orderdate", "o_totalprice", calendar=True)


@query(
    "l7_pv_uv",
    """SELECT ts::DATE::VARCHAR AS dt, event_type AS channel, count(*) AS pv,
        count(DISTINCT user_id) AS uv, round(count(*) / count(DISTINCT user_id), 2) AS pv_per_uv
    FROM events GROUP BY ts::DATE, event_type""",
)
def l7(t: Tables):
    return A.pv_uv(t.events, "user_id", "ts", "event_type")


@query(
    "a11_approximate_uv",
    """SELECT ts::DATE::VARCHAR AS dt, event_type AS channel, count(*) AS pv, true AS near
    FROM events GROUP BY 1, 2""",
)
def a11(t: Tables):
    """Approximate counts beside exact ones: within 5 %."""
    close = A.pv_uv(t.events, "user_id", "ts", "event_type", approximate=True)
    exact = A.pv_uv(t.events, "user_id", "ts", "event_type").select("dt", "channel", F.col("uv").alias("users"))
    near = F.abs(F.col("uv") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.05)
    return close.join(exact, ["dt", "channel"]).select("dt", "channel", "pv", near.alias("near"))


@query(
    "a11_weekly_uv_of_sketches",
    "SELECT date_trunc('week', ts)::DATE::VARCHAR AS week, count(*) AS pv, true AS near FROM events GROUP BY 1",
)
def a11_weeks(t: Tables):
    """Stored daily sketches merged to weeks, beside the exact weekly counts."""
    daily = pin(A.daily_sketches(t.events, "user_id", "ts"))
    weeks = A.weekly_users(daily)
    week = F.to_date(F.date_trunc("week", F.col("ts").cast("timestamp")))
    exact = t.events.groupBy(week.alias("week")).agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("uv") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.05)
    return weeks.join(exact, "week").select("week", "pv", near.alias("near"))


@query(
    "l8_running_total",
    """WITH d AS (SELECT o_orderdate::DATE AS dt, sum(o_totalprice) AS amount,
                         count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1)
    SELECT dt::VARCHAR AS dt, round(amount, 2) AS amount, buyers,
           round(sum(amount) OVER (ORDER BY dt), 2) AS running_amount,
           (sum(buyers) OVER (ORDER BY dt))::BIGINT AS running_buyers FROM d""",
)
def l8(t: Tables):
    return A.running_total(t.orders, "o_orderdate", "o_totalprice", "o_custkey")


@query(
    "l8b_running_unique_users",
    """WITH f AS (SELECT o_custkey, min(o_orderdate::DATE) AS dt FROM orders GROUP BY 1),
         d AS (SELECT DISTINCT o_orderdate::DATE AS dt FROM orders),
         n AS (SELECT d.dt, count(f.o_custkey) AS new_users FROM d LEFT JOIN f USING (dt) GROUP BY d.dt)
    SELECT dt::VARCHAR AS dt, new_users,
           (sum(new_users) OVER (ORDER BY dt))::BIGINT AS running_users FROM n""",
)
def l8b(t: Tables):
    return A.running_unique_users(t.orders, "o_orderdate", "o_custkey")


@query(
    "l9_group_median",
    "SELECT o_orderpriority, median(o_totalprice) AS median FROM orders GROUP BY o_orderpriority",
)
def l9(t: Tables):
    return A.group_median(t.orders, "o_orderpriority", "o_totalprice")


@query(
    "l9_group_median_many_groups",
    "SELECT l_partkey, median(l_quantity) AS median FROM lineitem GROUP BY l_partkey",
)
def l9_parts(t: Tables):
    return A.group_median(t.lineitem, "l_partkey", "l_quantity")


@query(
    "l10_repurchase_rate",
    f"""SELECT count(*) AS buyers, count(*) FILTER (n >= 2) AS repeat_buyers,
        {pct('count(*) FILTER (n >= 2)', 'count(*)')} AS repurchase_pct
    FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)""",
)
def l10(t: Tables):
    return A.repurchase_rate(t.orders, "o_custkey", "o_orderkey")


@query(
    "l10b_repurchase_within_days",
    f"""WITH n AS (SELECT o_custkey, o_orderdate::DATE AS dt,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS k
                   FROM orders),
      f AS (SELECT a.dt AS d1, b.dt AS d2 FROM (SELECT * FROM n WHERE k = 1) a
            LEFT JOIN (SELECT * FROM n WHERE k = 2) b USING (o_custkey))
    SELECT count(*) AS buyers, count(*) FILTER (d2 - d1 <= 30) AS repeat_buyers,
        {pct('count(*) FILTER (d2 - d1 <= 30)', 'count(*)')} AS repurchase_pct FROM f""",
)
def l10b(t: Tables):
    return A.repurchase_within(t.orders, "o_custkey", "o_orderkey", "o_orderdate", 30)


# --- aggregates for reports --------------------------------------------------------------------

_LABELS = {
    "count": "计数", "count_nonnull": "非空计数", "sum": "合计",
    "mean": "平均值", "max": "最大值", "min": "最小值",
}


def _calc_sql(field: str, agg: str) -> str:
    value = {
        "count": "count(*)::DOUBLE",
        "count_nonnull": f"(count(*) FILTER (NOT {missing(field)}))::DOUBLE",
        "sum": f"sum({number(field)})",
        "mean": f"avg({number(field)})",
        "max": f"max({number(field)})",
        "min": f"min({number(field)})",
    }[agg]
    return duck(
        f"""SELECT '{field}' AS field, '{agg}' AS agg, '{_LABELS[agg]}' AS agg_label,
            CASE WHEN v = floor(v) AND abs(v) < 1e15 THEN v ELSE round(v, 6) END AS value,
            {number_text('v')} AS value_text, rows_used
        FROM (SELECT {value} AS v, count(*) AS rows_used FROM dirty_orders)""",
        "dirty_orders",
    )


def _register_calc(key: str, field: str, agg: str) -> None:
    # sums of doubles depend on the order of addition: compare six significant decimals less
    def run(t: Tables):
        out = calc(t.dirty_orders, field, agg)
        return out if agg not in ("sum", "mean") else _rounded(out)

    text = _calc_sql(field, agg)
    if agg in ("sum", "mean"):
        text = (
            "SELECT field, agg, agg_label, round(value, 2) AS value, rows_used FROM (" + text + ")"
        )
    query(key, text)(run)


def _rounded(out):
    return out.withColumn("value", F.round("value", 2)).drop("value_text")


_register_calc("a1_calc_count", "channel", "count")
_register_calc("a2_calc_count_nonnull", "channel", "count_nonnull")
_register_calc("a3_calc_sum", "amount", "sum")
_register_calc("a4_calc_mean", "amount", "mean")
_register_calc("a5_calc_max", "amount", "max")
_register_calc("a6_calc_min", "amount", "min")


@query(
    "a7_tidy_number",
    f"""SELECT o_orderkey, {number_text('v')} AS value_text,
        CASE WHEN v = floor(v) THEN v ELSE round(v, 6) END AS value
    FROM (SELECT o_orderkey, o_totalprice / 4 AS v FROM orders)""",
)
def a7(t: Tables):
    v = F.col("o_totalprice") / 4
    return t.orders.select("o_orderkey", T.number_text(v).alias("value_text"), T.tidy_number(v).alias("value"))


@query(
    "a8_format_value",
    """SELECT o_orderkey, CASE WHEN v = floor(v) THEN format('{:,}', v::BIGINT)
        ELSE format('{:,.4f}', v) END AS shown
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice)
                             ELSE o_totalprice END AS v FROM orders)""",
)
def a8(t: Tables):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).otherwise(
        F.col("o_totalprice")
    )
    return t.orders.select("o_orderkey", T.format_value(v).alias("shown"))


@query(
    "a9_count_by_type",
    duck(
        """SELECT k.file_type, count(f.id) AS cnt
        FROM (SELECT unnest(['excel', 'csv', '数据库表', 'json']) AS file_type) k
        LEFT JOIN files f USING (file_type) GROUP BY k.file_type""",
        "files",
    ),
)
def a9_types(t: Tables):
    return count_by(t.files, "file_type", ["excel", "csv", "数据库表", "json"])


@query(
    "a9_count_by_snippet_category",
    duck("SELECT category, count(*) AS cnt FROM snippets GROUP BY category", "snippets"),
)
def a9_snippets(t: Tables):
    return count_by(t.snippets, "category")


@query(
    "a12_conditional_aggregates",
    """SELECT o_orderpriority, max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS any_open,
        sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS filled,
        count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS large,
        count(DISTINCT o_custkey) AS buyers
    FROM orders GROUP BY o_orderpriority""",
)
def a12(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        F.max(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("any_open"),
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"),
        F.count_if(F.col("o_totalprice") > 100000).alias("large"),
        F.count_distinct("o_custkey").alias("buyers"),
    )
