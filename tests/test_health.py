from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidymill.operators import health as H
from tidymill.operators.cells import cells, first_k
from tidymill.plans import cleaning as P


def test_missing_report_warns_above_a_fifth(table):
    df = table("a b c", [("", "1", "-"), ("1", "1", "1"), ("1", "1", "1"), ("1", "1", "1")])
    got = [(r.field, r.missing, r.rate, r.warn) for r in H.missing_report(df).collect()]
    assert got == [("a", 1, 0.25, True), ("c", 1, 0.25, True), ("b", 0, 0.0, False)]


def test_duplicates_and_their_samples(table):
    df = table("a b", [("1", "x")] * 9 + [("2", "y"), ("3", "z"), ("3", "z"), ("2", "q")])
    assert tuple(H.duplicate_counts(df).first()) == (9, 2)
    assert tuple(H.duplicates_by(df, ["a"]).first()) == (10, 3)
    assert H.duplicates_by(df, ["b", "a"]) is None
    with pytest.raises(ValueError, match="no such columns: c"):
        H.duplicates_by(df, ["c"])
    got = {r.first_row: (r.row_nos, r.extra, r.a) for r in H.duplicate_samples(df).collect()}
    assert got == {1: ([1, 2, 3, 4, 5, 6], 3, "1"), 11: ([11, 12], 0, "3")}


def test_numeric_columns_need_rows_ratio_and_no_id_name(table):
    rows = [(str(i), str(i), str(i) if i < 16 else "x", str(i) if i < 5 else "") for i in range(20)]
    stats = H.numeric_stats(table("good user_id mostly few", rows)).collect()
    assert [r.field for r in stats] == ["good", "mostly"]
    assert [r.n for r in stats] == [20, 16]
    assert abs(stats[0]["std"] - 5.766281297335398) < 1e-12  # population deviation


def test_anomalies_name_their_reasons(table):
    rows = [(str(20 + i % 5), str(100 + i % 3)) for i in range(60)]
    rows[3] = ("130", "100")
    rows[7] = ("20", "-1,000")
    df = table("age amount", rows)
    got = {(r.row_no, r.field): r for r in H.anomaly_list(df).collect()}
    assert set(got) == {(4, "age"), (8, "amount")}
    assert got[(4, "age")].rules.startswith("年龄应在 0~120 之间，当前值 130；超出 3σ 正常范围（均值 ")
    assert got[(8, "amount")].rules.startswith("金额/价格不应为负，当前值 -1000；")
    assert [r.id for r in H.anomaly_list(df).orderBy("row_no").collect()] == [1, 2]
    assert tuple(H.anomaly_totals(df).first()) == (2,)
    done = H.confirm_anomalies(H.anomaly_list(df), df.sparkSession.sql("SELECT 2L AS id UNION ALL SELECT 2L"))
    assert {(r.id, r.confirmed, r.newly) for r in done.collect()} == {(1, False, False), (2, True, True)}


def test_anomaly_list_is_whole(table):
    df = table("price", [("-1",)] * 6000 + [("2",)] * 4000)
    listed = H.anomaly_list(df)
    assert sorted(r.id for r in listed.select("id").collect()) == list(range(1, 6001))
    assert tuple(H.anomaly_totals(df).first()) == (6000,)


def test_formats_and_suggestions(table):
    df = table(
        "day phone note",
        [
            ("2026/9/1", "13800000000", " a"),
            ("2026-09-02", "1380000", "b"),
            ("2026年9月3日", "", "1,000"),
            ("2026-09-04", "138x", "c "),
            ("x", "13900000000", ""),
        ],
    )
    mixed = {r["style"]: (r.cnt, r["samples"]) for r in H.date_format_mix(df).collect()}
    assert mixed == {
        "slash": (1, ["2026/9/1"]),
        "dash": (2, ["2026-09-02", "2026-09-04"]),
        "cn": (1, ["2026年9月3日"]),
    }
    assert [tuple(r) for r in H.bad_format_counts(df, "phone").collect()] == [("phone", 2)]
    spaces = sorted((r.row_no, r["value"]) for r in H.bad_format_items(df, "space").collect())
    assert spaces == [(1, " a"), (4, "c ")]
    advice = H.type_suggestions(df).orderBy("id").collect()
    assert [(r.field, r.kind, r["sample"]) for r in advice] == [
        ("day", "date", "2026/9/1"),
        ("note", "number", "1,000"),
    ]
    assert advice[0].reason == "80.0% 的值匹配日期格式（如 2026/9/1），建议转为日期类型"
    actions = H.suggestions_to_actions(H.type_suggestions(df))
    assert [a["type"] for a in actions] == ["normalize_date", "convert_type"]
    assert P.run_actions(df, actions).orderBy("row_no").first().day == "2026-09-01"
    summary = H.profile_summary(df).first()
    assert (summary.row_count, summary.col_count, summary.missing_fields_cnt) == (5, 3, 2)
    assert (summary.format_issue_cnt, summary.type_suggest_cnt) == (1 + 2 + 2, 2)


def test_fixture_with_known_dirt(spark):
    """50,000 orders, 200 of them exact copies, as the order fixture is described."""
    base = spark.range(49_800).select(
        (F.col("id") + 1).alias("row_no"),
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") % 200 == 5, "-3").when(F.col("id") % 200 == 9, "130").otherwise("30").alias("age"),
        F.when(F.col("id") % 100 == 3, "-9.5").otherwise("2,000.5").alias("amount"),
    )
    copies = base.where("row_no <= 200").withColumn("row_no", F.col("row_no") + 49_800)
    summary = H.profile_summary(base.union(copies)).first()
    assert (summary.row_count, summary.dup_rows, summary.dup_groups) == (50_000, 200, 200)
    assert summary.anomaly_cnt == 249 * 2 + 498 + 2 + 2  # ages, amounts, and those among the copies


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_first_k_is_exact_for_any_partitioning(table, parts):
    rng = random.Random(parts)
    values = [(rng.choice(["", "", "a", "b"]), "") for _ in range(700)]
    values[650] = ("a", "late")
    df = table("v w", values).repartition(parts)
    found = first_k(cells(df).where(~F.col("missing")), ["field"], 9, 2)
    got = sorted((r.field, r["rank"], r.row_no) for r in found.collect())
    want = [i for i, (v, _) in enumerate(values, 1) if v][:9]
    assert got == [("v", k, n) for k, n in enumerate(want, 1)] + [("w", 1, 651)]
