from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidymill.operators.calc import calc
from tidymill.plans import analytics as A
from tidymill.plans import catalog as G
from tidymill.plans import events as E
from tidymill.plans import tickets as Q


def test_calc_on_the_known_four_rows(table):
    df = table("amount city", [("1,200", "北京"), ("3000", "上海"), ("", "北京"), ("4500.5", "深圳")])
    got = {a: calc(df, "amount", a).first() for a in ("count", "count_nonnull", "sum", "mean", "max", "min")}
    assert {a: r.value_text for a, r in got.items()} == {
        "count": "4", "count_nonnull": "3", "sum": "8700.5", "mean": "2900.166667",
        "max": "4500.5", "min": "1200",
    }
    assert got["sum"].agg_label == "合计"
    for agg in ("sum", "mean"):
        with pytest.raises(Exception, match="not a number"):
            calc(df, "city", agg).collect()
    with pytest.raises(ValueError, match="not one of the aggregates"):
        calc(df, "amount", "median")
    with pytest.raises(ValueError, match="has no field"):
        calc(df, "nope", "sum")


def _acts(spark, rows):
    df = spark.createDataFrame(rows, "u bigint, d string, e string")
    return df.withColumn("d", F.col("d").cast("timestamp"))


def test_retention_on_a_hand_made_log(spark):
    log = _acts(
        spark,
        [(1, "2026-01-01", "a"), (1, "2026-01-01", "a"), (1, "2026-01-02", "a"), (2, "2026-01-01", "a"),
         (2, "2026-01-03", "a"), (1, "2026-01-08", "a")],
    )
    got = {str(r.dt)[-2:]: (r.active_users, r.retained_users) for r in A.next_period_retention(log, "u", "d").collect()}
    assert got == {"01": (2, 1), "02": (1, 0), "03": (1, 0), "08": (1, 0)}
    registered = log.groupBy("u").agg(F.min("d").alias("r"))
    row = A.retention_matrix(registered, log, "u", "r", "d").first()
    assert (row.new_users, row.d1, row.d2, row.d3, row.d7, row.d7_rate_pct) == (2, 1, 1, 0, 1, 50.0)


def test_funnel_in_order_and_empty_steps(spark):
    log = _acts(spark, [(1, "2026-01-01", "a"), (1, "2026-01-02", "b"), (2, "2026-01-03", "a"), (2, "2026-01-01", "b")])
    loose = A.funnel(log, "u", "e", "d", ["a", "b", "z"]).first()
    assert (loose.s1, loose.s2, loose.s3, loose.s1_s2_pct, loose.s2_s3_pct) == (2, 2, 0, 100.0, 0.0)
    strict = A.funnel_strict(log, "u", "e", "d", ["a", "b"]).first()
    assert (strict.s1, strict.s2, strict.overall_pct) == (2, 1, 50.0)
    nobody = A.funnel(log, "u", "e", "d", ["z", "a"], "2026-01-01", "2026-01-31").first()
    assert nobody.s1_s2_pct is None


def test_top_n_with_ties(spark):
    df = spark.createDataFrame(
        [("g", 9), ("g", 9), ("g", 8), ("g", 7), ("h", 1), (None, 5)], "g string, m int"
    )
    rank = sorted((r.g or "", r.m, r.rn) for r in A.group_top_n_ties(df, "g", "m", 3).collect())
    assert rank == [("", 5, 1), ("g", 8, 3), ("g", 9, 1), ("g", 9, 1), ("h", 1, 1)]
    dense = sorted((r.g or "", r.m, r.rn) for r in A.group_top_n_ties(df, "g", "m", 2, dense=True).collect())
    assert dense == [("", 5, 1), ("g", 8, 2), ("g", 9, 1), ("g", 9, 1), ("h", 1, 1)]
    gaps = spark.createDataFrame([("g", None), ("g", 2), ("h", None), ("h", None)], "g string, m int")
    assert sorted((r.g, r.m or 0, r.rn) for r in A.group_top_n_ties(gaps, "g", "m", 2).collect()) == [
        ("g", 0, 2), ("g", 2, 1), ("h", 0, 1), ("h", 0, 1)
    ]


def test_growth_by_row_and_by_calendar(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (date'2026-01-05', 10.0D), (date'2026-02-01', 15.0D), (date'2026-04-01', 30.0D) t(d, a)"
    )
    by_row = [r.prev_growth_pct for r in A.growth(df, "d", "a").orderBy("period").collect()]
    assert by_row == [None, 50.0, 100.0]
    by_date = [r.prev_growth_pct for r in A.growth(df, "d", "a", calendar=True).orderBy("period").collect()]
    assert by_date == [None, 50.0, None]


def test_repurchase(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 1, date'2026-01-01'), (1, 1, date'2026-01-05'), (2, 2, date'2026-01-01'),"
        " (2, 3, date'2026-01-31'), (3, 4, date'2026-01-01'), (3, 5, date'2026-02-02') t(u, o, d)"
    )
    assert tuple(A.repurchase_rate(df, "u", "o").first()) == (3, 2, 66.67)
    assert tuple(A.repurchase_within(df, "u", "o", "d", 30).first()) == (3, 1, 33.33)


# --- requests ----------------------------------------------------------------------------------

NOW = dt.datetime(2026, 9, 1, 12)


def _requests(spark):
    def at(hours):
        return (NOW + dt.timedelta(hours=hours)).strftime("%Y-%m-%d %H:%M:%S")

    data = [(1, "高", at(10)), (2, "低", at(-48)), (3, "中", at(50)), (4, "高", ""), (5, "中", at(240))]
    return spark.createDataFrame(
        [(*r, "pending", 0) for r in data], "id bigint, urgency string, deadline string, status string, sort_order bigint"
    )


def test_scores_and_board_order(spark):
    requests = _requests(spark)
    scored = Q.score_requests(requests, NOW)
    assert [r.score for r in scored.orderBy("id").collect()] == [2.7, 2.0, 1.9, 2.1, 1.6]
    assert [r.id for r in Q.rank_requests(scored).collect()] == [1, 4, 2, 3, 5]
    by_hand = Q.score_requests(Q.set_manual_order(requests, [5, 2]), NOW)
    assert [r.id for r in Q.rank_requests(by_hand).collect()] == [5, 2, 1, 4, 3]
    assert {r.sort_order for r in Q.set_manual_order(requests, []).collect()} == {0}
    with pytest.raises(ValueError, match="listed twice"):
        Q.set_manual_order(requests, [1, 1])
    with pytest.raises(Exception, match="without a request"):
        Q.set_manual_order(requests, [1, 99]).collect()
    places = requests.sparkSession.createDataFrame([(5, 1), (2, 2)], "id bigint, place int")
    from_frame = Q.set_manual_order(requests, places)
    assert {r.id: r.sort_order for r in from_frame.collect()} == {1: 0, 2: 2, 3: 0, 4: 0, 5: 1}
    with pytest.raises(Exception, match="listed twice"):
        Q.set_manual_order(requests, places.union(places)).collect()


def test_weights():
    assert Q.read_weights({"w_urgency": 2, "w_deadline": True, "w_requester": 0.1}) == {
        "w_urgency": 0.5, "w_deadline": 0.3, "w_requester": 0.1,
    }
    assert Q.read_weights("junk") == Q.WEIGHTS
    with pytest.raises(ValueError, match="w_deadline"):
        Q.check_weights({"w_urgency": 0.5, "w_deadline": -1, "w_requester": 0.2})


def test_status_history(spark):
    history = spark.createDataFrame(
        [(1, 1, "pending", None), (1, 2, "confirmed", None), (1, 3, "delivered", None),
         (2, 1, "pending", None), (2, 2, "rework", " "), (2, 3, "in_progress", None), (3, 1, "done", None),
         (4, 1, "confirmed", None), (4, 2, "confirmed", None)],
        "ticket_id bigint, seq bigint, status string, note string",
    )
    for block in (1, 2, 1000):
        found = Q.audit_transitions(history, seq_block=block).collect()
        assert {(r.ticket_id, r.seq): r.reason for r in found} == {
            (1, 3): "not allowed", (2, 2): "note missing", (3, 1): "unknown status",
            (4, 1): "bad start", (4, 2): "same status",
        }
    with pytest.raises(ValueError, match="no such state"):
        Q.status_list(history, "lost")


# --- catalog -----------------------------------------------------------------------------------


def test_closure_of_a_long_chain(spark):
    cats = spark.range(1, 31).selectExpr("id", "id - 1 AS parent_id", "'x' AS name")
    assert {(r.id, r.depth) for r in G.category_closure(cats, 1).collect()} == {(i, i - 1) for i in range(1, 31)}


def test_closure_of_a_deep_tree_with_a_cycle(spark):
    edges = [(1, None), (2, 1), (3, 2), (4, 3), (5, 1), (6, 9), (7, 8), (8, 7)]
    cats = spark.createDataFrame(edges, "id bigint, parent_id bigint")
    assert {(r.id, r.depth) for r in G.category_closure(cats, 1).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 1)}
    assert {r.id for r in G.category_closure(cats, 7).collect()} == {7, 8}


def test_removing_a_source_takes_its_products(spark):
    files = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, None), (5, 4)], "id bigint, parent_file_id bigint")
    def gone(i):
        return sorted(r.id for r in G.cascade_set(files, spark.sql(f"SELECT {i}L AS id")).collect())

    assert (gone(1), gone(2), gone(9)) == ([1, 2, 3], [2], [])
    records = spark.createDataFrame([(1, 4, 5), (2, 1, 2), (3, 4, 3)], "id bigint, file_id bigint, output_file_id bigint")
    left = G.without(records, G.cascade_set(files, spark.sql("SELECT 1L AS id")), "file_id", "output_file_id")
    assert [r.id for r in left.collect()] == [1]


def test_keyword_search_is_ascii_case_insensitive(spark):
    df = spark.createDataFrame([("Straße A_1",), ("straSSe",), ("É",), (None,)], "t string")
    def hits(word):
        return [r.t for r in df.where(G.matches(F.col("t"), word)).collect()]

    assert hits("a_1") == ["Straße A_1"]
    assert hits("STRAss") == ["straSSe"]
    assert hits("é") == []
    assert len(hits("%")) == 3


def test_paging_bounds(spark):
    df = spark.range(25)
    assert [r.id for r in G.page(df, [F.desc("id")], 3, 10).collect()] == [4, 3, 2, 1, 0]
    assert [r.id for r in G.page_after(df, "id", 5, 2).collect()] == [4, 3]
    for number, size in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError, match="page counts from 1"):
            G.page(df, [F.col("id")], number, size)


def test_empty_keyword_finds_nothing(spark):
    files = spark.createDataFrame([(1, "a", "b", "c")], "id bigint, origin_name string, note string, tags string")
    fields = spark.createDataFrame([(1, "x")], "file_id bigint, field_name string")
    assert G.search_files(files, fields, "  ").count() == 0
    assert G.search_docs(files.withColumnsRenamed({"origin_name": "name", "note": "summary"}), "").count() == 0


def test_event_metrics(spark):
    log = spark.createDataFrame(
        [(1, "ticket_confirm", '{"ticket_id": 7, "confirm_result": "rework"}'), (2, "ticket_confirm", "{broken"),
         (3, "x", None)],
        "id bigint, event string, params_json string",
    )
    assert [tuple(r) for r in Q.rework_counts(log).collect()] == [(7, 1)]
    got = {r.id: r.ticket_id for r in E.event_params(log, ["ticket_id"]).collect()}
    assert got == {1: "7", 2: None, 3: None}
    requests = spark.createDataFrame([(7, "delivered"), (8, "delivered"), (9, "pending")], "id bigint, status string")
    assert tuple(E.rework_rate(requests, Q.rework_counts(log)).first()) == (1, 2, 50.0)
