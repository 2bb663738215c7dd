"""The analytic query library: retention, funnels, top-N, streaks, growth, UV, totals, medians.

Every function takes frames and column names and returns a lazy frame. Detail rows are reduced to
the grain that matters (user and day, user, month) by aggregation with map-side combining before
anything is joined or windowed, so one very active user or one huge channel is not one big task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidymill.operators.medians import exact_median


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent with two decimals; null when there is nothing to divide by."""
    return F.round(F.try_divide(part, whole) * 100, 2)


def _user_days(df: DataFrame, user: str, day: Column | str) -> DataFrame:
    at = F.col(day) if isinstance(day, str) else day
    return df.select(F.col(user).alias("user"), at.cast("date").alias("dt")).distinct()


def next_period_retention(df: DataFrame, user: str, day: str, grain: str = "day") -> DataFrame:
    """Per day (or week): active users, those active in the next one too, and the rate.

    On distinct (user, period) rows the next active period of a user is one ``lead`` away, which
    replaces the self join.
    """
    step = {"day": 1, "week": 7}[grain]
    period = F.col(day).cast("date") if grain == "day" else F.date_trunc("week", F.col(day))
    active = _user_days(df, user, period)
    following = F.lead("dt").over(Window.partitionBy("user").orderBy("dt"))
    kept = active.withColumn("_next", following)
    return kept.groupBy("dt").agg(
        F.count("*").alias("active_users"),
        F.count_if(F.col("_next") == F.date_add("dt", step)).alias("retained_users"),
    ).withColumn("retention_pct", percent(F.col("retained_users"), F.col("active_users")))


def retention_matrix(
    registered: DataFrame,
    active: DataFrame,
    user: str,
    reg_day: str,
    day: str,
    days: int = 7,
) -> DataFrame:
    """Per registration day: new users and how many came back on day 1..N after it."""
    joined_on = _user_days(registered, user, reg_day).withColumnRenamed("dt", "reg_dt")
    seen = _user_days(active, user, day)
    gap = F.datediff("dt", "reg_dt")
    # rows are distinct (user, registration day, active day): flags per user replace the distincts
    per_user = (
        joined_on.join(
            seen,
            (joined_on["user"] == seen["user"])
            & (F.col("dt") > F.col("reg_dt"))
            & (F.col("dt") <= F.date_add("reg_dt", days)),
            "left",
        )
        .groupBy(joined_on["user"], "reg_dt")
        .agg(*[F.max((gap == k).cast("int")).alias(f"d{k}") for k in range(1, days + 1)])
    )
    counted = per_user.groupBy("reg_dt").agg(
        F.count("*").alias("new_users"),
        *[F.coalesce(F.sum(f"d{k}"), F.lit(0)).alias(f"d{k}") for k in range(1, days + 1)],
    )
    return counted.withColumn(f"d{days}_rate_pct", percent(F.col(f"d{days}"), F.col("new_users")))


def _funnel_rates(reached: DataFrame, steps: int) -> DataFrame:
    """``users, s1..sN`` to step-to-step and overall rates."""
    rates = {
        f"s{k - 1}_s{k}_pct": percent(F.col(f"s{k}"), F.col(f"s{k - 1}")) for k in range(2, steps + 1)
    }
    return reached.withColumns({**rates, "overall_pct": percent(F.col(f"s{steps}"), F.col("s1"))})


def _between(day: str, start: str | None, end: str | None) -> Column:
    at = F.col(day).cast("date")
    inside = F.lit(True)
    if start:
        inside = inside & (at >= F.lit(start).cast("date"))
    if end:
        inside = inside & (at <= F.lit(end).cast("date"))
    return inside


def funnel(
    df: DataFrame,
    user: str,
    event: str,
    day: str,
    steps: Sequence[str],
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Users who did each step at all within the dates, with conversion rates."""
    did = df.where(_between(day, start, end)).groupBy(user).agg(
        *[
            F.max((F.col(event) == step).cast("int")).alias(f"s{k}")
            for k, step in enumerate(steps, start=1)
        ]
    )
    reached = did.agg(
        F.count("*").alias("users"),
        *[F.coalesce(F.sum(f"s{k}"), F.lit(0)).alias(f"s{k}") for k in range(1, len(steps) + 1)],
    )
    return _funnel_rates(reached, len(steps))


def funnel_strict(
    df: DataFrame,
    user: str,
    event: str,
    at: str,
    steps: Sequence[str],
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """As ``funnel``, but a step counts only if its first time is not before the previous step's."""
    firsts = df.where(_between(at, start, end)).groupBy(user).agg(
        *[
            F.min(F.when(F.col(event) == step, F.col(at))).alias(f"t{k}")
            for k, step in enumerate(steps, start=1)
        ]
    )
    done: list[Column] = [F.col("t1").isNotNull()]
    for k in range(2, len(steps) + 1):
        done.append(done[-1] & F.coalesce(F.col(f"t{k}") >= F.col(f"t{k - 1}"), F.lit(False)))
    reached = firsts.agg(
        F.count("*").alias("users"),
        *[F.count_if(hit).alias(f"s{k}") for k, hit in enumerate(done, start=1)],
    )
    return _funnel_rates(reached, len(steps))


def group_top_n(
    df: DataFrame, group: str, metric: str, n: int = 3, *, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The N highest rows per group; Spark's group limit drops the rest before the shuffle."""
    order = [F.desc(metric), *tiebreak]
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rn", rank).where(F.col("rn") <= n)


def group_top_n_ties(
    df: DataFrame, group: str, metric: str, n: int = 3, *, dense: bool = False
) -> DataFrame:
    """Top N with RANK (or DENSE_RANK): equal values share a rank, so ties are all kept; nulls rank last.

    Values are counted first; a group's N best distinct values are a handful of rows even when one
    value fills a third of the table. Detail rows then join those cut-offs.
    """
    counted = df.groupBy(group, metric).agg(F.count("*").alias("_n"))
    best_first = Window.partitionBy(group).orderBy(F.desc(metric))
    # the N best distinct values hold every row whose rank is at most N
    top = counted.withColumn("_dense", F.dense_rank().over(best_first)).where(F.col("_dense") <= n)
    ahead = F.sum("_n").over(best_first.rowsBetween(Window.unboundedPreceding, -1))
    rank = F.col("_dense") if dense else (F.coalesce(ahead, F.lit(0)) + 1).cast("int")
    ranked = top.withColumn("rn", rank).where(F.col("rn") <= n)
    cuts = ranked.select(F.col(group).alias("_g"), F.col(metric).alias("_m"), "rn")
    same = F.col(group).eqNullSafe(F.col("_g")) & F.col(metric).eqNullSafe(F.col("_m"))
    return df.join(cuts, same).drop("_g", "_m")


def streaks(df: DataFrame, user: str, day: str, at_least: int = 3) -> DataFrame:
    """Runs of consecutive active days: day minus its number within the user is constant in a run."""
    active = _user_days(df, user, day)
    number = F.row_number().over(Window.partitionBy("user").orderBy("dt"))
    return (
        active.withColumn("_run", F.date_sub("dt", number))
        .groupBy("user", "_run")
        .agg(
            F.min("dt").alias("start_dt"),
            F.max("dt").alias("end_dt"),
            F.count("*").alias("days"),
        )
        .where(F.col("days") >= at_least)
        .drop("_run")
    )


# Grain -> periods in a year.
_PERIODS = {"month": 12, "week": 52, "quarter": 4}


def growth(
    df: DataFrame, day: str, amount: str, grain: str = "month", *, calendar: bool = False
) -> DataFrame:
    """Sum per period against the previous one and the same one a year ago.

    By default the previous row counts as the previous period. ``calendar=True`` compares with the
    period that lies exactly one step (or one year) back, so a gap yields null.
    """
    start = F.date_trunc(grain, F.col(day)).cast("date")
    totals = df.groupBy(start.alias("period")).agg(F.sum(amount).alias("total"))
    year = _PERIODS[grain]
    if calendar:
        def back(steps: int) -> Column:
            return (
                F.date_sub("period", 7 * steps)
                if grain == "week"
                else F.add_months("period", -steps * (3 if grain == "quarter" else 1))
            )

        prev = totals.select(F.col("period").alias("_p1"), F.col("total").alias("prev_total"))
        last = totals.select(F.col("period").alias("_p2"), F.col("total").alias("year_ago_total"))
        wide = totals.join(prev, back(1) == F.col("_p1"), "left").join(
            last, back(year) == F.col("_p2"), "left"
        )
    else:
        in_time = Window.orderBy("period")  # one row per period
        wide = totals.withColumns(
            {
                "prev_total": F.lag("total", 1).over(in_time),
                "year_ago_total": F.lag("total", year).over(in_time),
            }
        )

    def change(base: str) -> Column:
        return percent(F.col("total") - F.col(base), F.nullif(F.col(base), F.lit(0.0)))

    return wide.select(
        "period",
        F.round("total", 2).alias("total"),
        F.round("prev_total", 2).alias("prev_total"),
        F.round("year_ago_total", 2).alias("year_ago_total"),
        change("prev_total").alias("prev_growth_pct"),
        change("year_ago_total").alias("year_growth_pct"),
    )


SKETCH_ERROR = 0.01  # standard deviation of approximate counts: practically all within 5 %


def pv_uv(df: DataFrame, user: str, day: str, channel: str, *, approximate: bool = False) -> DataFrame:
    """Visits, distinct users and visits per user by day and channel."""
    users = F.approx_count_distinct(user, SKETCH_ERROR) if approximate else F.count_distinct(user)
    counted = df.groupBy(F.col(day).cast("date").alias("dt"), F.col(channel).alias("channel")).agg(
        F.count("*").alias("pv"), users.alias("uv")
    )
    return counted.withColumn("pv_per_uv", F.round(F.col("pv") / F.col("uv"), 2))


def daily_sketches(df: DataFrame, user: str, day: str) -> DataFrame:
    """Visits and a sketch of the users of each day; kept, it answers for any longer time without the detail rows."""
    return df.groupBy(F.col(day).cast("date").alias("dt")).agg(
        F.count("*").alias("pv"), F.hll_sketch_agg(user).alias("users")
    )


def weekly_users(daily: DataFrame) -> DataFrame:
    """Visits and approximate distinct users of each week (from Monday), from daily sketches alone."""
    week = F.to_date(F.date_trunc("week", F.col("dt")))
    merged = daily.groupBy(week.alias("week")).agg(F.sum("pv").alias("pv"), F.hll_union_agg("users").alias("users"))
    return merged.select("week", "pv", F.hll_sketch_estimate("users").alias("uv"))


def running_total(df: DataFrame, day: str, amount: str, user: str) -> DataFrame:
    """Daily amount and buyers with running sums; the window sees one row per day."""
    daily = df.groupBy(F.col(day).cast("date").alias("dt")).agg(
        F.sum(amount).alias("amount"), F.count_distinct(user).alias("buyers")
    )
    in_time = Window.orderBy("dt")
    return daily.select(
        "dt",
        F.round("amount", 2).alias("amount"),
        "buyers",
        F.round(F.sum("amount").over(in_time), 2).alias("running_amount"),
        F.sum("buyers").over(in_time).alias("running_buyers"),
    )


def running_unique_users(df: DataFrame, day: str, user: str) -> DataFrame:
    """Distinct users up to each day: count users by their first day, then add up.

    Days without a new user are kept.
    """
    days = df.select(F.col(day).cast("date").alias("dt"), F.col(user).alias("user"))
    new = (
        days.groupBy("user").agg(F.min("dt").alias("dt")).groupBy("dt").agg(F.count("*").alias("new"))
    )
    every = days.select("dt").distinct().join(new, "dt", "left")
    new_users = F.coalesce("new", F.lit(0))
    return every.select(
        "dt",
        new_users.alias("new_users"),
        F.sum(new_users).over(Window.orderBy("dt")).alias("running_users"),  # one row per day
    )


def group_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median per group, however large the group."""
    return exact_median(df, value, [group], name="median")


def repurchase_rate(df: DataFrame, user: str, order: str) -> DataFrame:
    """Buyers, buyers with at least two different orders, and their share.

    Two different orders exist exactly when the smallest and the largest order id differ, so no
    distinct count per user is needed.
    """
    per_user = df.groupBy(user).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    counted = per_user.agg(
        F.count("*").alias("buyers"), F.count_if(F.col("_lo") < F.col("_hi")).alias("repeat_buyers")
    )
    return counted.withColumn("repurchase_pct", percent(F.col("repeat_buyers"), F.col("buyers")))


def repurchase_within(
    df: DataFrame,
    user: str,
    order: str,
    day: str,
    days: int = 30,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Of the users whose first order lies in the dates, those with a second one within N days."""
    orders = df.groupBy(user, order).agg(F.min(F.col(day).cast("date")).alias("dt"))
    number = F.row_number().over(Window.partitionBy(user).orderBy("dt", order))
    firsts = (
        orders.withColumn("_n", number)
        .where(F.col("_n") <= 2)
        .groupBy(user)
        .agg(
            F.min("dt").alias("first_dt"),
            F.max(F.when(F.col("_n") == 2, F.col("dt"))).alias("second_dt"),
        )
        .where(_between("first_dt", start, end))
    )
    counted = firsts.agg(
        F.count("*").alias("buyers"),
        F.count_if(F.datediff("second_dt", "first_dt") <= days).alias("repeat_buyers"),
    )
    return counted.withColumn("repurchase_pct", percent(F.col("repeat_buyers"), F.col("buyers")))
