from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidymill.operators import actions as A
from tidymill.operators import fields as C
from tidymill.operators.actions import carry
from tidymill.operators.medians import exact_median, middle_values
from tidymill.plans import cleaning as P
from tidymill.sources import numbering
from tidymill.sources.numbering import Key, number_in_order, renumber


def do(kind, **params):
    return {"type": kind, "params": params}


def test_fill_strategies(table, rows):
    df = table("v w", [("", "a"), ("1", "b"), ("NA", ""), ("1,000", "c"), (" - ", "d"), ("2", "--")])

    def filled(strategy, **more):
        return rows(P.run_action(df, do("fill_missing", field="v", strategy=strategy, **more)), "v")

    assert filled("drop_row") == ["1", "1,000", "2"]
    assert filled("mean") == ["334.333333", "1", "334.333333", "1,000", "334.333333", "2"]
    assert filled("median") == ["2", "1", "2", "1,000", "2", "2"]
    assert filled("fixed", value=0) == ["0", "1", "0", "1,000", "0", "2"]
    assert filled("ffill") == ["", "1", "1", "1,000", "1,000", "2"]
    assert filled("bfill") == ["1", "1", "1,000", "1,000", "2", "2"]


def test_fill_without_numbers_is_an_error(table):
    df = table("v", [("",), ("x",)])
    for strategy in ("mean", "median"):
        with pytest.raises(Exception, match="has no numbers"):
            P.run_action(df, do("fill_missing", field="v", strategy=strategy)).collect()


@pytest.mark.parametrize("forward", [True, False])
def test_carry_equals_a_sequential_fill(table, rows, forward):
    rng = random.Random(7)
    values = [rng.choice(["", "", "", "a", "b", "N/A"]) for _ in range(300)]
    want, last = [], ""
    for v in values if forward else reversed(values):
        last = last if v in ("", "N/A") else v
        want.append(last)
    df = A.carry(table("v", [(v,) for v in values]), "v", forward=forward, block_rows=16)
    assert rows(df, "v") == (want if forward else want[::-1])


def test_drop_duplicates_keeps_first(table, rows):
    df = table("a b", [("1", "x"), ("1", "y"), ("2", "x"), ("1", "x"), ("2", "x")])
    assert rows(P.run_action(df, do("drop_duplicates", columns=None)), "row_no") == [1, 2, 3]
    once = P.run_action(df, do("drop_duplicates", columns=["a"]))
    assert rows(once, "row_no") == [1, 3]
    assert rows(P.run_action(once, do("drop_duplicates", columns="a")), "row_no") == [1, 3]


def test_convert_keeps_what_does_not_parse(table, rows):
    df = table("v", [("1,200",), ("3000.50",), ("x",), ("",), (" 7 ",)])
    number = do("convert_type", field="v", target="number")
    assert rows(P.run_action(df, number), "v") == ["1200", "3000.5", "x", "", "7"]
    number["params"]["mode"] = "typed"
    assert rows(P.run_action(df, number), "v") == [1200.0, 3000.5, None, None, 7.0]


def test_sort_numeric_text_and_reverse(table, rows):
    df = table("v k", [("10", "a"), ("9", "b"), ("1,000", "c"), ("9", "d")])
    assert rows(P.run_action(df, do("sort_rows", field="v")), "row_no", "k") == [
        (1, "b"), (2, "d"), (3, "a"), (4, "c"),
    ]
    assert rows(P.run_action(df, do("sort_rows", field="v", order="desc")), "k") == list("cadb")
    texts = df.withColumn("v", F.when(F.col("k") == "a", "").otherwise(F.col("v")))
    assert rows(P.run_action(texts, do("sort_rows", field="v")), "k") == list("acbd")


def test_anomalies_by_rule_sigma_and_position(table, rows):
    df = table("age amount score", [(str(30 + i % 3), "5", str(i % 2)) for i in range(40)])
    df = df.withColumn("age", F.when(F.col("row_no") == 3, "130").otherwise(F.col("age")))
    df = df.withColumn("amount", F.when(F.col("row_no") == 5, "-1").otherwise(F.col("amount")))
    df = df.withColumn("score", F.when(F.col("row_no") == 7, "99").otherwise(F.col("score")))
    marked = P.run_action(df, do("handle_anomaly", mode="mark"))
    assert rows(marked.where("is_anomaly = '1'"), "row_no") == [3, 5, 7]
    assert rows(P.run_action(df, do("handle_anomaly", field="age")).where("row_no < 5"), "row_no") == [1, 2, 4]
    # positions refer to the frame as it is then: rows 1 and 2 are gone, so 1 means old row 3
    kept = P.run_action(df.where("row_no > 2"), do("handle_anomaly", anomaly_rows=[1]))
    assert kept.count() == 37
    assert kept.where("age = '130'").count() == 0


def test_equal_values_have_no_sigma_anomalies(table):
    df = table("v", [("5",)] * 30)
    assert P.run_action(df, do("handle_anomaly", field="v")).count() == 30


def test_filters_fold_left_and_nulls_are_false(table, rows):
    df = table("a b", [("1", "x"), ("5", "y"), ("x", "x"), ("9", "z")])
    both = [{"field": "a", "operator": ">", "value": 3}, {"field": "b", "operator": "in", "value": ["x", "z"]}]
    assert rows(P.run_action(df, do("filter_rows", conditions=both)), "row_no") == [4]
    either = do("filter_rows", conditions=both, combiner="xor")
    assert rows(P.run_action(df, either), "row_no") == [1, 2, 3, 4]


@pytest.mark.parametrize(
    ("action", "message"),
    [
        (do("fly"), "no action is called 'fly'"),
        (do("strip_text", field="zz"), "no field 'zz'"),
        (do("fill_missing", field="a", strategy="guess"), "no fill strategy"),
        (do("fill_missing", field="a", strategy="fixed"), "needs a value"),
        (do("rename_field", old_name="a", new_name=" "), "is blank"),
        (do("rename_field", old_name="a", new_name="b"), "already"),
        (do("convert_type", field="a", target="blob"), "cannot convert to"),
        (do("filter_rows"), "needs conditions"),
        (do("filter_rows", field="a", operator="~", value=1), "no operator"),
        (do("handle_anomaly", field="a", mode="hide"), "drop or mark"),
    ],
)
def test_bad_actions_are_refused_before_anything_runs(table, action, message):
    df = table("a b", [("1", "2")])
    with pytest.raises(ValueError, match=message):
        P.run_actions(df, [do("strip_text", field="a"), action])


def test_chain_is_checked_against_the_changing_schema(table):
    df = table("a b", [("1", "2")])
    chain = [do("rename_field", old_name="a", new_name="c"), do("drop_field", field="b")]
    assert P.check_actions(["a", "b"], [*chain, do("strip_text", field="c")]) == ["c"]
    with pytest.raises(ValueError, match="no field 'b'"):
        P.run_actions(df, [*chain, do("strip_text", field="b")])


def test_registered_action_runs_in_a_chain(table, rows):
    A.register_action("shout", lambda df, p: df.withColumn(p["field"], F.upper(p["field"])))
    df = table("a", [("x",)])
    assert rows(P.run_actions(df, [do("shout", field="a")]), "a") == ["X"]
    del A.ACTIONS["shout"]


# --- presets, previews, accounting -------------------------------------------------------------

ORDERS = [
    ("1", "2026/9/1", "1,200.5", "30", "APP"),
    ("2", "2026年9月2日", "-3", "30", ""),
    ("1", "2026/9/1", "1,200.5", "30", "APP"),
    ("3", "2026-09-03", "x", "130", "APP"),
]


def orders(table):
    return table("order_id order_date amount age channel", ORDERS)


def test_orders_preset_and_its_statistics(table, rows):
    df, preset = orders(table), P.PRESETS[P.ORDERS_PRESET]
    assert rows(P.run_actions(df, preset)) == [
        (1, "1", "2026-09-01", "1200.5", "30", "APP"),
        (2, "2", "2026-09-02", "-3", "30", "未知"),
    ]
    stats = P.change_stats(df, preset).first().asDict()
    assert stats == {
        "rows_before": 4, "rows_after": 2, "rows_removed": 2, "cols_before": 5, "cols_after": 5,
        "actions_count": 5, "missing_filled": 1, "strip_count": 0, "rows_dropped_dedup": 1,
        "rows_dropped_anomaly": 1, "rows_dropped_filter": 0, "rows_dropped_missing": 0,
        "rows_after_filter": None, "fields_converted": ["amount"], "dates_normalized": ["order_date"],
    }


def test_statistics_account_for_every_row(table):
    df = table("a b", [(str(i % 7), " x" if i % 3 else "") for i in range(60)])
    chain = [
        do("strip_text", field="b"),
        do("filter_rows", field="a", operator="<", value=6),
        do("fill_missing", field="b", strategy="drop_row"),
        do("sort_rows", field="a"),
        do("drop_duplicates", columns=["a"]),
        do("fill_missing", field="b", strategy="fixed", value="y"),
    ]
    s = P.change_stats(df, chain).first()
    lost = s.rows_dropped_filter + s.rows_dropped_missing + s.rows_dropped_dedup + s.rows_dropped_anomaly
    assert s.rows_before - lost == s.rows_after == P.run_actions(df, chain).count() == 6
    assert (s.strip_count, s.rows_after_filter, s.missing_filled) == (40, 52, 0)


def test_users_preset_expands_text_columns(table, rows):
    df = table("id name city phone", [("1", "", " b ", "138"), ("2", "ann ", "c", "139")])
    types = P.column_types(C.infer_types(df))
    actions = P.apply_preset(P.USERS_PRESET, types)
    assert [a["params"].get("field") for a in actions] == ["name", "city", "phone", "name"]
    assert rows(P.run_actions(df, actions), "name", "city", "is_anomaly") == [("ann", "c", "0")]
    assert P.expand_all_text([do("strip_text", field=P.ALL_TEXT)], {"x": "integer"}) == [
        do("strip_text", field="x")
    ]
    for broken in ({}, {"p": []}, {"p": "junk"}):
        with pytest.raises(ValueError, match="preset"):
            P.apply_preset("p", types, broken)


def test_preview_reports_errors_and_goes_on(table):
    chain = [
        do("convert_type", field="amount", target="number"),
        do("strip_text", field="nope"),
        do("fill_missing", field="channel", strategy="mean"),
        do("drop_duplicates", columns=None),
    ]
    reports = P.preview(orders(table), chain).orderBy("step").collect()
    assert [(r.ok, r.rows_before, r.rows_after, r.affected_rows) for r in reports] == [
        (True, 4, 4, 2), (False, 4, 4, 0), (False, 4, 4, 0), (True, 4, 3, 1),
    ]
    assert reports[1].error == "there is no field 'nope'"
    assert "has no numbers to take the mean of" in reports[2].error
    assert reports[0].samples[0]["before_amount"] == "1,200.5"
    assert reports[0].samples[0]["after_amount"] == "1200.5"


# --- numbering and medians ---------------------------------------------------------------------


def test_renumber_closes_gaps_whatever_the_partitions(spark, rows):
    keys = [3, 5, 8, 900, 901, 100000, 100002, 7000000000]
    for parts in (1, 4, 16):
        df = spark.createDataFrame([(k, str(k)) for k in keys], "row_no bigint, v string")
        out = renumber(df.repartition(parts), block_rows=4)
        assert rows(out, "row_no", "v") == [(i, str(k)) for i, k in enumerate(keys, 1)]


def test_number_in_order_is_a_total_order(spark, rows):
    df = spark.range(200).select(F.col("id").alias("row_no"), (F.col("id") % 3).cast("string").alias("v"))
    out = number_in_order(df.repartition(7), [Key(F.col("v")), Key(F.col("row_no"), down=True)])
    assert rows(out, "row_no") == list(range(1, 201))
    assert rows(out, "v") == ["0"] * 67 + ["1"] * 67 + ["2"] * 66


def test_positions_do_not_change_from_run_to_run(spark, rows):
    draw = random.Random(5)
    # two thirds of the rows have one value; nulls on both ends
    data = [(i, draw.choice(["hot", "hot", None, f"v{draw.randrange(9)}"]), draw.choice([1.5, 1.5, None, draw.random()])) for i in range(3000)]
    df = spark.createDataFrame(data, "row_no bigint, t string, n double")

    def placed(keys):
        out = number_in_order(df.withColumn("id", F.col("row_no")).repartition(9, "n"), keys)
        again = number_in_order(df.withColumn("id", F.col("row_no")).repartition(3), keys)
        assert rows(out) == rows(again)
        assert rows(out, "row_no") == list(range(1, 3001))
        return rows(out, "id")

    got = placed([Key(F.col("t")), Key(F.col("n"), down=True), Key(F.col("row_no"))])
    want = sorted(data, key=lambda r: (r[1] is not None, r[1] or "", r[2] is None, -(r[2] or 0), r[0]))
    assert got == [r[0] for r in want]
    got = placed([Key(F.col("n"), nulls_last=True), Key(F.col("t"), down=True, nulls_last=False), Key(F.col("row_no"), down=True)])
    order = {t: -i for i, t in enumerate(sorted({r[1] for r in data if r[1]}))}
    want = sorted(data, key=lambda r: (r[2] is None, r[2] or 0, r[1] is not None, order.get(r[1], 0), -r[0]))
    assert got == [r[0] for r in want]
    assert number_in_order(df.limit(1), [Key(F.col("t"))]).count() == 1 and number_in_order(df.limit(0), [Key(F.col("t"))]).count() == 0


def test_fill_and_numbers_across_groups_of_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(numbering, "GROUP_BLOCKS", 3)
    draw = random.Random(8)
    cells = {i: draw.choice(["", "", "", str(i)]) for i in draw.sample(range(400), 150)}
    df = spark.createDataFrame(list(cells.items()), "row_no bigint, v string").repartition(5)
    for forward in (True, False):
        order, last, want = sorted(cells, reverse=not forward), "", {}
        for i in order:
            last = cells[i] or last
            want[i] = last
        assert rows(carry(df, "v", forward=forward, block_rows=4), "row_no", "v") == sorted(want.items())
    assert rows(renumber(df, block_rows=4), "row_no") == list(range(1, 151))
    twice = df.select((F.col("row_no") / 2).cast("bigint").alias("at"), F.col("row_no").alias("then"))
    assert rows(renumber(twice, "at", then=["then"], block_rows=4), "then") == sorted(cells)


def test_large_groups_leave_little_to_order(spark):
    n = 1_000_000
    # different values over many sizes, in one group; half of another group is one value
    value = F.when(F.col("id") % 2 == 0, F.exp(F.col("id") / n * 40 - 20)).otherwise(-F.col("id") / 7)
    hot = spark.range(n).select(F.lit("hot").alias("g"), value.alias("v"))
    df = hot.unionByName(spark.range(1000).select(F.lit("half").alias("g"), F.greatest(F.col("id"), F.lit(500)).cast("double").alias("v")))
    assert middle_values(df, "v", ["g"]).groupBy("g").count().agg(F.max("count")).first()[0] <= 64
    got = {r.g: r.m for r in exact_median(df, "v", ["g"], name="m").collect()}
    assert got == {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}


def test_exact_median_of_extreme_values(spark):
    for values in (
        [0.0, -0.0, 5e-324, -5e-324], [1e308, 1.7e308, -1e308], [float("inf"), 1.0, float("-inf")], [float("inf"), float("inf")],
        [float("nan"), 1.0, 2.0], [0.1, 0.1, 0.1 + 1e-17, 0.3], [2.0**k for k in range(-500, 500)],
    ):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert exact_median(df, "v").first()[0] == df.select(F.median("v")).first()[0], values


def test_exact_median_with_hot_groups_ties_and_nulls(spark):
    rng = random.Random(3)
    data = [("hot", rng.gauss(0, 1)) for _ in range(4001)] + [("tied", 5.0)] * 1000
    data += [("even", float(v)) for v in range(10)] + [("one", 3.0), ("none", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {r.g: r.m for r in exact_median(df, "v", ["g"], name="m").collect()}
    hot = sorted(v for g, v in data if g == "hot")
    assert got == {"hot": hot[2000], "tied": 5.0, "even": 4.5, "one": 3.0, None: 3.0}
    every = sorted(v for _, v in data if v is not None)
    n = len(every)
    whole = exact_median(df, "v", name="m").first().m
    assert whole == (every[(n - 1) // 2] + every[n // 2]) / 2
