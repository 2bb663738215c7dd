from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidymill.functions import dates as D
from tidymill.functions import markup as M
from tidymill.functions import text as T
from tidymill.functions.tokens import canon_token, number_tokens
from tidymill.operators import provenance as N


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_strip_removes_what_python_strips(spark):
    texts = ["  a b ", "　x　", "\xa0y\x1f", " z ", "\x85", "", None]
    assert apply(spark, T.strip, texts) == [t.strip() if t is not None else None for t in texts]


def test_missing_texts(spark):
    texts = [None, "", "  ", "NA", "n/a", "Null", "none", "--", "-", "0", "nan", "x"]
    assert apply(spark, T.is_missing, texts) == [True] * 9 + [False] * 3


def test_to_number(spark):
    texts = ["1", " 1,200.5 ", "1,2,3", "-.5", "5.", "1e3", "1d", "inf", "NaN", "", None, "12a", "+7"]
    want = [1.0, 1200.5, 123.0, -0.5, 5.0, 1000.0, None, None, None, None, None, None, 7.0]
    assert apply(spark, T.to_number, texts) == want


def test_number_text_has_no_exponent(spark):
    numbers = [1200.0, 12345678.25, 0.1, 2900.1666666667, -3.0, 1e15, 0.0]
    want = ["1200", "12345678.25", "0.1", "2900.166667", "-3", "1000000000000000", "0"]
    assert apply(spark, T.number_text, numbers, "double") == want


def test_short_number_is_percent_g(spark):
    numbers = [130.0, -3.0, -113.25, 0.5, 1234567.0, -0.00001234, 123456.7, 0.0, 100000.0, 999999.6]
    assert apply(spark, T.short_number, numbers, "double") == [f"{n:g}" for n in numbers]


def test_format_value(spark):
    numbers = [1200.0, 1234567.5, -0.25]
    assert apply(spark, T.format_value, numbers, "double") == ["1,200", "1,234,567.5000", "-0.2500"]


@pytest.mark.parametrize(
    ("text", "is_date", "day"),
    [
        ("2026/9/1", True, "2026-09-01"),
        ("2026-09-01", True, "2026-09-01"),
        ("2026年9月1日", True, "2026-09-01"),
        ("2026年9月1", True, "2026-09-01"),
        (" 2026-9-1 7:05 ", True, "2026-09-01"),
        ("2026-09-01T23:59:59", True, "2026-09-01"),
        ("2026-02-31", True, None),
        ("2026-13-01", False, None),
        ("2026-09-32", False, None),
        ("2026-09-01 24:00", False, None),
        ("20260901", False, "2026-09-01"),
        ("soon", False, None),
    ],
)
def test_dates(spark, text, is_date, day):
    assert apply(spark, D.is_date_text, [text]) == [is_date]
    assert apply(spark, D.format_date, [text]) == [day or text]


def test_date_patterns(spark):
    assert apply(spark, lambda c: D.format_date(c, "%Y年%m月%d日"), ["2026/9/1"]) == ["2026年09月01日"]
    assert apply(spark, lambda c: D.format_date(c, "DD.MM.YYYY"), ["2026/9/1"]) == ["01.09.2026"]
    assert apply(spark, lambda c: D.format_date(c, "at %H:%M"), ["2026/9/1 7:05"]) == ["at 07:05"]
    with pytest.raises(ValueError, match="date format"):
        D.spark_pattern("%j")


def test_deadline(spark):
    texts = ["2026-09-01", "2026/09/01", "2026-09-01 10:30", "2026-9-1", "", "soon", None]
    got = apply(spark, D.parse_deadline, texts)
    shown = [g.isoformat(sep=" ") if g else None for g in got]
    assert shown == ["2026-09-01 23:59:59"] * 2 + ["2026-09-01 10:30:00", "2026-09-01 00:00:00"] + [None] * 3


def test_number_tokens_and_canon(spark):
    text = "2026年9月1日 与 2026 年 9 月 1 日，2026-9-1，12,345.60 元，87%，3倍，007，1.50"
    found = apply(spark, number_tokens, [text])[0]
    assert found == [
        "2026年9月1日", "2026 年 9 月 1 日", "2026-9-1", "12,345.60", "87%", "3倍", "007", "1.50",
    ]
    assert apply(spark, canon_token, found) == [
        "num:2026年9月1日", "date:202691", "date:202691", "num:12345.6", "num:87", "num:3", "num:7", "num:1.5",
    ]
    twins = ["2026-1-11", "2026-11-1"]
    assert apply(spark, canon_token, twins) == ["date:2026111"] * 2
    padded = apply(spark, lambda c: canon_token(c, padded_dates=True), twins)
    assert padded == ["date:20260111", "date:20261101"]


def test_long_digit_strings_keep_apart(spark):
    long = ["123456789012345678901234567890", "123456789012345678901234567891"]
    assert len(set(apply(spark, canon_token, long))) == 2


def test_tags(spark):
    texts = ['["a", "b"]', "x, y ,, z", "", None, '{"a": 1}', "7"]
    assert apply(spark, M.tags_parse, texts) == [["a", "b"], ["x", "y", "z"], [], [], [], []]


def test_snippet(spark):
    long = "a" * 100 + "KEY" + "b\n" * 50
    want = "…" + (long[40:100] + "KEY" + long[103:163]).replace("\n", " ")
    shown = apply(spark, lambda c: M.snippet_around(c, "KEY"), [long, "no hit" * 40, "KEY", None])
    assert shown == [want, ("no hit" * 40)[:120], "KEY", ""]


def test_strip_tags_decodes_once(spark):
    texts = ["<b>a</b> &amp;lt; &#39;q&#x4e2d;&nbsp;", None, "&unknown; &lt;p&gt;"]
    assert apply(spark, M.strip_tags, texts) == ["a &lt; 'q中", "", "&unknown; <p>"]


def test_json_lenient(spark):
    texts = ['{"a": 1}', '```json\n{"a": 1}\n```', 'so: {"a": 1} ok', "nothing", "", None]
    got = apply(spark, lambda c: M.parse_json_lenient(c).cast("string"), texts)
    assert got == ['{"a":1}'] * 3 + [None] * 3


def test_mask_prefers_long_names(spark):
    masked = apply(spark, lambda c: M.mask_fields(c, ["amount", "amount_total", ""]), ["amount_total, amount"])
    assert masked == ["[已脱敏字段], [已脱敏字段]"]


def test_summary_text_utf8_then_gbk(spark):
    raw = ["  中文摘要 ".encode(), "中文摘要".encode("gbk"), ("x" * 3000).encode()]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, v binary")
    got = [r[0] for r in df.orderBy("i").select(M.summary_text(F.col("v"))).collect()]
    assert got == ["中文摘要", "中文摘要", "x" * 3000]
    assert df.where("i = 2").select(M.summary_text(F.col("v"), 2000)).first()[0] == "x" * 2000
    neither = spark.createDataFrame([(bytes([0x41, 0xFF, 0xFF]),)], "v binary")
    assert neither.select(M.summary_text(F.col("v"))).first()[0].startswith("A\ufffd")


def test_character_references_of_every_kind(spark):
    raw = ["&copy;&eacute;&hellip;", "&#9999999;", "&#xD800;", "&#128;", "&#0;", "&#00000065;&#x41;", "&nosuch; &amp", "&#99999999999999999999;"]
    assert apply(spark, M.unescape_html, raw) == [
        "©é…", "\ufffd", "\ufffd", "€", "\ufffd", "AA", "&nosuch; &amp", "\ufffd"
    ]


# --- provenance --------------------------------------------------------------------------------

TOPIC = "双11 大促复盘，活动 2026-09-01 启动，GMV 目标 12,345 万元"
REFS = '[{"file_id": 77, "field": "amount", "agg_label": "合计", "value": 8700.5}]'


def _docs(spark, generated):
    return spark.createDataFrame(
        [(1, TOPIC, ["amount"], REFS, generated)],
        "doc_id bigint, text string, fields array<string>, refs string, generated string",
    )


def test_invented_number_is_flagged(spark):
    docs = _docs(spark, "增长 35.7%，目标 12,345 万，2026-09-01 起，合计 8700.5，编号 77")
    allowed = N.whitelist(docs, "text", fields="fields", refs="refs")
    flagged = N.unsourced_numbers(docs, "generated", allowed)
    assert [r.token for r in flagged.collect()] == ["35.7%"]
    strict = N.whitelist(docs, "text", fields="fields", refs="refs", strict=True)
    flagged = N.unsourced_numbers(docs, "generated", strict)
    assert sorted(r.token for r in flagged.collect()) == ["35.7%", "77"]


def test_highlight_and_guard(spark):
    docs = _docs(spark, "a<b & 12345 又 42.0%、2025 和 5,000")
    shown = N.highlight(docs, "generated", "text", fields="fields", refs="refs")
    html = shown.first().html
    span = lambda t: N.SPAN_OPEN + t + N.SPAN_CLOSE
    assert html == f"a&lt;b &amp; 12345 又 {span('42.0%')}、{span('2025')} 和 {span('5,000')}"
    assert N.export_guard(shown, "html").first().unsourced_cnt == 3


def test_dropped_numbers_keep_first_occurrence_order(spark):
    docs = spark.createDataFrame(
        [(1, "本期 GMV 为 12,345 万元，转化率 87%，87% 与 9", "GMV 12345 万元")],
        "doc_id bigint, text string, polished string",
    )
    gone = N.dropped_numbers(docs, "text", docs, "polished").orderBy("rank").collect()
    assert [(r.rank, r.token) for r in gone] == [(1, "87%"), (2, "9")]


def test_refs_and_outline(spark):
    reports = spark.createDataFrame(
        [(1, REFS), (2, "{broken"), (3, None), (4, "{}")], "id bigint, refs_json string"
    )
    got = {(r.id, r.refs_cnt, r.field, r.value) for r in N.explode_refs(reports).collect()}
    assert got == {(1, 1, "amount", 8700.5), (2, 0, None, None), (3, 0, None, None), (4, 0, None, None)}
    page = spark.createDataFrame(
        [(1, '<h1 class="a">One <b>x</b></h1><h2> </h2><H2>T&amp;C</H2>\n<p class="q template-hint">h</p>k')],
        "id bigint, html string",
    )
    heads = N.report_outline(page, "html", "id").orderBy("pos").collect()
    assert [(r.level, r.title) for r in heads] == [("h1", "One x"), ("h2", "T&C")]
    assert page.select(N.without_hints(F.col("html"))).first()[0].endswith("\nk")


def test_framework_sections_drop_blanks(spark):
    content = '```json\n{"sections": [{"title": " A ", "points": ["p", " "]}, {"title": ""}, {"title": "B"}]}\n```'
    made = spark.createDataFrame([(1, content)], "id bigint, content string")
    rows = N.framework_sections(made, "content", "id").orderBy("section", "point_no").collect()
    assert [(r.title, r.point) for r in rows] == [("A", "p"), ("B", None)]


def test_dates_in_more_ways(spark):
    cases = {
        "20260901": "2026-09-01", "20261301": None, "2026.9.1": "2026-09-01", " 2026.9.1 08:05": "2026-09-01", "Sep 1, 2026": "2026-09-01",
        "september 1 2026": "2026-09-01", "1 Sept. 2026": "2026-09-01", "31/12/2026": "2026-12-31", "12/31/2026": "2026-12-31",
        "3/4/2026": "2026-03-04", "3-4-2026 7:00": "2026-03-04", "31/31/2026": None, "Foo 1, 2026": None, "3/4-2026": None,
        "2026-02-31": None, "2026/2/3": "2026-02-03", "12345": None, "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    day = D.parse_any_date(F.col("v")).cast("date").cast("string")
    assert {r.v: r.d for r in df.select("v", day.alias("d")).collect()} == cases
    turned = df.where("v = '3/4/2026'").select(D.parse_any_date(F.col("v"), F.lit(True)).cast("date").cast("string"))
    assert turned.first()[0] == "2026-04-03"

    def vote(*values):
        return spark.createDataFrame([(v,) for v in values], "v string").select(D.day_first(F.col("v"))).first()[0]

    assert vote("3/4/2026", "31/12/2026", "x") and not vote("3/4/2026", "12/31/2026") and not vote("1/2/2026", None)
