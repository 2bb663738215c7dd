"""Scalar rules, field catalog and sources, row by row over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymill.functions import dates as D
from tidymill.functions import markup as M
from tidymill.functions import text as T
from tidymill.functions.tokens import canon_token
from tidymill.operators import fields as C
from tidymill.operators.provenance import tokens
from tidymill.session import checkpoint_dir
from tidymill.sources.encodings import detect_encodings
from tidymill.sources.guard import guarded_select
from tidymill.sources.numbering import renumber
from tidymill.sources.text_tables import head_rows, read_text_table
from tidymill.sources.versions import export_events
from workload import fixtures as X
from workload.fixtures import Tables, duck
from workload.registry import query


def _per_row(
    name: str, table: str, spark_cols: Callable[[], dict[str, Column]], duck_cols: dict[str, str]
) -> None:
    """Register expressions evaluated on every row of a derived table."""
    listed = ", ".join(f"{sql} AS {alias}" for alias, sql in duck_cols.items())

    def run(t: Tables):
        return getattr(t, table).select("row_no", *[c.alias(a) for a, c in spark_cols().items()])

    query(name, duck(f"SELECT row_no, {listed} FROM {table}", table))(run)



def _c(name: str) -> Column:
    return F.col(name)


_per_row(
    "f1_strip", "dirty_users",
    lambda: {"city": T.strip(_c("city")), "name": T.strip(_c("name"))},
    {"city": "trim(city)", "name": "trim(name)"},
)
_per_row(
    "f2_is_missing", "dirty_orders",
    lambda: {"channel": T.is_missing(_c("channel")), "amount": T.is_missing(_c("amount"))},
    {"channel": X.missing("channel"), "amount": X.missing("amount")},
)
_per_row(
    "f3_to_number", "dirty_orders",
    lambda: {"amount": T.to_number(_c("amount")), "order_date": T.to_number(_c("order_date"))},
    {"amount": X.number("amount"), "order_date": X.number("order_date")},
)
_per_row(
    "f4_shape_tests", "dirty_orders",
    lambda: {
        "ints": T.is_integer(_c("age")), "floats": T.is_float(_c("amount")),
        "thousands": T.is_thousands(_c("amount")), "bools": T.is_boolean(_c("channel")),
    },
    {
        "ints": "regexp_matches(age, '^[+-]?[0-9]+$')",
        "floats": r"regexp_matches(amount, '^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$')",
        "thousands": X.thousands("amount"),
        "bools": "lower(channel) IN ('true', 'false', 'yes', 'no', 'y', 'n', '是', '否')",
    },
)
_per_row(
    "f5_is_date_text", "dirty_orders",
    lambda: {"order_date": D.is_date_text(_c("order_date")), "amount": D.is_date_text(_c("amount"))},
    {"order_date": X.date_text("order_date"), "amount": X.date_text("amount")},
)
_per_row(
    "f6_parse_date", "dirty_orders",
    lambda: {"parsed": D.parse_date(_c("order_date")), "none": D.parse_date(_c("amount"))},
    {"parsed": f"{X.date_value('order_date')}::VARCHAR", "none": f"{X.date_value('amount')}::VARCHAR"},
)
_per_row(
    "f7_format_date", "dirty_orders",
    lambda: {
        "iso": D.format_date(_c("order_date")),
        "cn": D.format_date(_c("order_date"), "%d.%m.%Y"),
        "kept": D.format_date(_c("amount")),
    },
    {
        "iso": f"coalesce(strftime({X.date_value('order_date')}, '%Y-%m-%d'), order_date)",
        "cn": f"coalesce(strftime({X.date_value('order_date')}, '%d.%m.%Y'), order_date)",
        "kept": "amount",
    },
)
_per_row(
    "f8_is_phone", "dirty_users", lambda: {"phone": T.is_phone(_c("phone"))},
    {"phone": "regexp_matches(phone, '^[0-9]{11}$')"},
)
_per_row(
    "f9_is_idcard", "dirty_users", lambda: {"idcard": T.is_idcard(_c("idcard"))},
    {"idcard": "regexp_matches(idcard, '^[0-9]{17}[0-9Xx]$')"},
)
_per_row(
    "f10_date_style", "dirty_orders",
    lambda: {s: D.date_style(_c("order_date"), s) for s in D.DATE_STYLES},
    {s: f"contains(order_date, '{m}')" for s, m in (("slash", "/"), ("dash", "-"), ("cn", "年"))},
)

# --- tokens ------------------------------------------------------------------------------------

_W = r"[\s\x{a0}\x{3000}]"
TOKEN = (
    rf"[0-9]{{4}}{_W}*年{_W}*[0-9]{{1,2}}{_W}*月{_W}*[0-9]{{1,2}}{_W}*日?"
    r"|[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?"
    r"|[0-9]+(?:\.[0-9]+)?(?:%|％|倍)?"
)


def canon(tok: str) -> str:
    bare = f"regexp_replace(replace({tok}, ',', ''), '{_W}*(%|％|倍){_W}*$', '')"
    value = f"TRY_CAST({bare} AS DOUBLE)"
    return f"""(CASE
        WHEN regexp_matches({tok}, '^[0-9]{{4}}([-/]|{_W}+年)')
            THEN 'date:' || regexp_replace({tok}, '[^0-9]', '', 'g')
        WHEN NOT regexp_matches({bare}, '^[0-9]+(\\.[0-9]+)?$') THEN 'num:' || {bare}
        WHEN abs({value}) < 1e15 THEN 'num:' || {X.number_text(value)}
        ELSE 'num:' || regexp_replace(regexp_replace({bare}, '\\.0+$', ''), '^0+([0-9])', '\\1') END)"""


def token_rows(source: str, text: str) -> str:
    """SELECT doc_id, pos, token of every number token of a text column."""
    hits = f"regexp_extract_all({text}, '{TOKEN}')"
    return f"""SELECT doc_id, pos - 1 AS pos, trim(hits[pos]) AS token
        FROM (SELECT doc_id, hits, unnest(range(1, len(hits) + 1)) AS pos
              FROM (SELECT doc_id, {hits} AS hits FROM {source}))"""


@query("f11_number_tokens", duck(token_rows("texts", "generated"), "texts"))
def f11(t: Tables):
    return tokens(t.texts, "generated").select("doc_id", "pos", "token")


@query(
    "f12_canon_token",
    duck(
        f"WITH k AS ({token_rows('texts', 'generated')}) SELECT doc_id, pos, {canon('token')} AS canon FROM k",
        "texts",
    ),
)
def f12(t: Tables):
    return tokens(t.texts, "generated").select("doc_id", "pos", "canon")


_PARTS = "regexp_extract_all(token, '[0-9]+')"
_PADDED = f"""CASE WHEN regexp_matches(token, '^[0-9]{{4}}([-/]|{_W}+年)')
    THEN 'date:' || {_PARTS}[1] || lpad({_PARTS}[2], 2, '0') || lpad({_PARTS}[3], 2, '0')
    ELSE {canon('token')} END"""


@query(
    "f12_canon_token_padded",
    duck(
        f"WITH k AS ({token_rows('texts', 'generated')}) SELECT doc_id, pos, {_PADDED} AS canon FROM k",
        "texts",
    ),
)
def f12_padded(t: Tables):
    found = tokens(t.texts, "generated")
    return found.select("doc_id", "pos", canon_token(F.col("token"), padded_dates=True).alias("canon"))


# --- markup ------------------------------------------------------------------------------------

_TAG_LIST = """CASE WHEN tags IS NULL OR tags = '' THEN ''
    WHEN json_valid(tags) THEN array_to_string(from_json(tags, '["VARCHAR"]'), '|')
    ELSE array_to_string(list_filter(list_transform(string_split(tags, ','), x -> trim(x)), x -> x <> ''), '|')
    END"""
_TAG_LIST = _TAG_LIST.replace("x -> trim(x)", "lambda x: trim(x)").replace(
    "x -> x <> ''", "lambda x: x <> ''"
)


@query("f13_tags_parse", duck(f"SELECT id, {_TAG_LIST} AS tags FROM files", "files"))
def f13(t: Tables):
    return t.files.select("id", M.tags_parse(F.col("tags")).alias("tags"))


def snippet_sql(text: str, word: str) -> str:
    at, n = f"strpos({text}, '{word}')", len(word)
    start = f"greatest({at} - 60, 1)"
    body = f"substring({text}, {start}, {at} - {start} + {n + 60})"
    return f"""replace(CASE WHEN {at} > 0 THEN CASE WHEN {start} > 1 THEN '…' ELSE '' END || {body}
        ELSE substring({text}, 1, 120) END, chr(10), ' ')"""


@query("f14_snippet_around", f"SELECT doc_id, {snippet_sql('text', 'tion')} AS shown FROM documents")
def f14(t: Tables):
    return t.documents.select("doc_id", M.snippet_around(F.col("text"), "tion").alias("shown"))


def _entities(x: str) -> str:
    named = [("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&apos;", "''''")]
    named += [("&#39;", "''''"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&amp;", "'&'")]
    for ref, char in named:
        x = f"replace({x}, '{ref}', {char})"
    return x


def strip_tags_sql(x: str) -> str:
    return X.strip(_entities(f"regexp_replace({x}, '<[^>]+>', '', 'g')"))


@query("f17_strip_tags", f"SELECT page_id, {strip_tags_sql('html')} AS content FROM pages")
def f17(t: Tables):
    return t.pages.select("page_id", M.strip_tags(F.col("html")).alias("content"))


def deadline_sql(x: str) -> str:
    iso = f"replace(trim({x}), '/', '-')"
    at = f"TRY_CAST({iso} AS TIMESTAMP)"
    return f"(CASE WHEN length({iso}) = 10 THEN {at} + INTERVAL '23:59:59' ELSE {at} END)"


@query(
    "f18_parse_deadline",
    duck(f"SELECT id, {deadline_sql('deadline')}::VARCHAR AS due FROM tickets", "tickets"),
)
def f18(t: Tables):
    return t.tickets.select("id", D.parse_deadline(F.col("deadline")).alias("due"))


@query(
    "f19_date_functions",
    """SELECT o_orderkey, (o_orderdate::DATE + 1)::VARCHAR AS next_day,
        (o_orderdate::DATE - 7)::VARCHAR AS week_before, strftime(o_orderdate, '%Y-%m') AS month,
        floor(o_totalprice)::BIGINT AS low, ceil(o_totalprice)::BIGINT AS high,
        o_totalprice / nullif(o_custkey, 0) AS ratio,
        round(o_totalprice / 7, 2) AS seventh
    FROM orders""",
)
def f19(t: Tables):
    day = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        F.date_add(day, 1).alias("next_day"),
        F.date_sub(day, 7).alias("week_before"),
        F.date_format(day, "yyyy-MM").alias("month"),
        F.floor("o_totalprice").alias("low"),
        F.ceil("o_totalprice").alias("high"),
        F.try_divide("o_totalprice", "o_custkey").alias("ratio"),
        F.round(F.col("o_totalprice") / 7, 2).alias("seventh"),
    )


@query("f15_summary_text", f"SELECT doc_id, {X.strip('text')}[1:300] AS summary FROM documents WHERE text IS NOT NULL")
def f15(t: Tables):
    held = t.documents.where("text IS NOT NULL").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return held.select("doc_id", M.summary_text(F.col("content"), 300).alias("summary"))


# --- sources -----------------------------------------------------------------------------------

_SELECT = """SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderkey) AS last_key
    FROM {orders} GROUP BY o_orderstatus, o_orderpriority -- per state"""


@query("s3_guarded_select", _SELECT.replace("{orders}", "orders"))
def s3(t: Tables):
    return guarded_select(t.spark, _SELECT, orders=t.orders)


@query("s6_head_rows", duck("SELECT * FROM dirty_orders ORDER BY row_no LIMIT 100", "dirty_orders"))
def s6(t: Tables):
    return head_rows(t.dirty_orders, 100)


@query(
    "s1_row_numbers",
    duck(
        "SELECT row_number() OVER (ORDER BY row_no) AS row_no, order_id FROM dirty_orders",
        "dirty_orders",
    ),
)
def s1_rows(t: Tables):
    return renumber(t.dirty_orders, block_rows=1024).select("row_no", "order_id")


def _document_files(t: Tables) -> str:
    """Documents as CSV files of three kinds, with other columns in another order, below the shared folder."""
    folder = f"{checkpoint_dir(t.spark)}/documents-{uuid.uuid4().hex}"
    for kind, columns in enumerate((["doc_id", "text", "lang"], ["lang", "source", "doc_id", "text"], ["text", "doc_id", "source"])):
        part = t.documents.where(F.col("doc_id") % 3 == kind).select(*columns)
        part.write.mode("append").options(
            header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(folder)
    return folder


@query(
    "s1_text_table",
    """SELECT doc_id::VARCHAR AS doc_id, coalesce(replace(text, chr(13), chr(10)), '') AS text,
        CASE WHEN doc_id % 3 = 2 THEN '' ELSE coalesce(lang, '') END AS lang,
        CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(source, '') END AS source
    FROM documents""",
)
def s1_table(t: Tables):
    out = read_text_table(t.spark, _document_files(t), multi_line=True, numbered=False)
    return out.select("doc_id", "text", "lang", "source")


@query(
    "s1_text_table_numbers",
    """SELECT count(*) AS n, count(*) AS numbers, 1::BIGINT AS first_no, count(*) AS last_no, sum(doc_id)::BIGINT AS ids
    FROM documents""",
)
def s1_numbers(t: Tables):
    out = read_text_table(t.spark, _document_files(t), multi_line=True)
    return out.agg(
        F.count("*").alias("n"),
        F.countDistinct("row_no").alias("numbers"),
        F.min("row_no").alias("first_no"),
        F.max("row_no").alias("last_no"),
        F.sum(F.col("doc_id").cast("bigint")).alias("ids"),
    )


_PARAMS = """CASE WHEN json_valid(params_json) THEN params_json ELSE '{}' END"""


@query(
    "s9_export_events",
    duck(
        f"""SELECT id, event, json_extract_string({_PARAMS}, '$.ticket_id') AS ticket_id,
            json_extract_string({_PARAMS}, '$.confirm_result') AS confirm_result, count(*) OVER (PARTITION BY event) AS cnt
        FROM event_log""",
        "event_log",
    ),
)
def s9(t: Tables):
    """Both exported files, read back."""
    folder = f"{checkpoint_dir(t.spark)}/export-{uuid.uuid4().hex}"
    export_events(t.event_log, folder)
    schema = "id bigint, event string, params map<string,string>"
    events = t.spark.read.schema(schema).json(f"{folder}/events")
    counts = t.spark.read.schema("event string, cnt bigint").json(f"{folder}/summary")
    return events.join(counts, "event").select(
        "id", "event", F.col("params")["ticket_id"].alias("ticket_id"), F.col("params")["confirm_result"].alias("confirm_result"), "cnt"
    )


@query(
    "s2_detect_encodings",
    """SELECT DISTINCT doc_id % 4 AS kind, CASE doc_id % 4 WHEN 1 THEN 'gbk' WHEN 2 THEN NULL ELSE 'utf-8' END AS encoding,
        doc_id % 4 <> 2 AS ok FROM documents""",
)
def s2(t: Tables):
    """Documents as text files: UTF-8, GBK at the end of lines only, neither, and plain ASCII."""
    kind, plain = F.col("doc_id") % 4, F.regexp_replace("text", "[^\\x00-\\x7f]", "")
    tail = F.when(kind == 1, F.unhex(F.lit("D6D0B9FA"))).when(kind == 2, F.unhex(F.lit("D6FF")))
    body = F.when(kind == 0, F.col("text")).when(kind == 3, plain).otherwise(F.concat(plain, tail.cast("string")))
    folder = f"{checkpoint_dir(t.spark)}/encodings-{uuid.uuid4().hex}"
    t.documents.select(kind.alias("kind"), F.coalesce(body, F.lit("")).alias("value")).write.partitionBy("kind").text(folder)
    found = detect_encodings(t.spark, folder)
    of = F.regexp_extract("path", r"kind=(\d)", 1).cast("bigint")
    return found.select(of.alias("kind"), "encoding", "ok").distinct()


# --- field catalog -----------------------------------------------------------------------------


def _unpivot(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT row_no, {i} AS position, '{c}' AS field, {c} AS value FROM {table}"
        for i, c in enumerate(columns, 1)
    )


ORDER_COLUMNS = ["order_id", "user_id", "order_date", "amount", "age", "channel"]
USER_COLUMNS = ["id", "name", "city", "phone", "idcard"]
LONG_ORDERS = f"long AS ({_unpivot('dirty_orders', ORDER_COLUMNS)})"
LONG_USERS = f"long AS ({_unpivot('dirty_users', USER_COLUMNS)})"

_STATS = f"""SELECT position, field AS field_name,
    count(*) FILTER ({X.missing('value')}) AS missing_cnt,
    round(count(*) FILTER ({X.missing('value')}) / count(*), 4) AS missing_rate,
    array_to_string((list(value ORDER BY row_no) FILTER (NOT {X.missing('value')}))[1:3], '|') AS sample_values
FROM long GROUP BY position, field"""


@query("c1_field_stats", duck(f"WITH {LONG_ORDERS} {_STATS}", "dirty_orders"))
def c1(t: Tables):
    return C.field_stats(t.dirty_orders)


@query("c1_field_stats_users", duck(f"WITH {LONG_USERS} {_STATS}", "dirty_users"))
def c1_users(t: Tables):
    return C.field_stats(t.dirty_users)


_TYPES = f"""seen AS (
    SELECT position, field, {X.strip('value')} AS v
    FROM long WHERE NOT {X.missing('value')}),
shapes AS (
    SELECT position, field, count(*) AS n,
      count(*) FILTER (regexp_matches(v, '^[+-]?[0-9]+$')) AS i,
      count(*) FILTER (regexp_matches(v, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)$')) AS f,
      count(*) FILTER ({X.thousands('v')}) AS th,
      count(*) FILTER (lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', '是', '否')) AS b,
      count(*) FILTER ({X.date_text('v')}) AS d
    FROM seen GROUP BY position, field),
labels AS (
    SELECT *, CASE WHEN b = n THEN 'boolean' WHEN d = n THEN 'date'
        WHEN i + f = n THEN CASE WHEN f > 0 THEN 'decimal' ELSE 'integer' END
        WHEN th = n THEN 'text' WHEN i + f > 0 AND n - i - f - b - d > 0 THEN 'mixed'
        WHEN d > 0 AND i + f + th = 0 THEN 'date' ELSE 'text' END AS inferred_type FROM shapes)
SELECT position, field AS field_name, inferred_type,
    CASE WHEN th = n THEN 'suspected number'
         WHEN inferred_type = 'mixed' AND th > 0 THEN 'contains thousands text'
         WHEN inferred_type = 'date' THEN 'suspected date' ELSE '' END AS hint
FROM labels"""


@query("c2_infer_types", duck(f"WITH {LONG_ORDERS}, {_TYPES}", "dirty_orders"))
def c2(t: Tables):
    return C.infer_types(t.dirty_orders)


@query("c2_infer_types_users", duck(f"WITH {LONG_USERS}, {_TYPES}", "dirty_users"))
def c2_users(t: Tables):
    return C.infer_types(t.dirty_users)


@query(
    "c3_table_stats",
    duck("SELECT count(*) AS row_count, 6::BIGINT AS col_count FROM dirty_orders", "dirty_orders"),
)
def c3(t: Tables):
    return C.table_stats(t.dirty_orders)


@query(
    "c4_display_type",
    duck(
        """WITH o AS (SELECT * FROM (VALUES ('age', 'decimal'), ('channel', 'bogus')) v(f, m)
                      WHERE m IN ('integer', 'decimal', 'date', 'boolean', 'text', 'mixed')),"""
        f"{LONG_ORDERS}, {_TYPES}".replace("SELECT position, field AS field_name, inferred_type,",
        "SELECT position, field AS field_name, inferred_type, o.m AS manual_type, "
        "coalesce(o.m, inferred_type) AS display_type,") + " LEFT JOIN o ON o.f = field",
        "dirty_orders",
    ),
)
def c4(t: Tables):
    chosen = t.spark.createDataFrame(
        [("age", "decimal"), ("channel", "bogus")], "field_name string, manual_type string"
    )
    return C.display_types(C.infer_types(t.dirty_orders), chosen)
