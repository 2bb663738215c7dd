"""Input frames: the given tables, and messy or application tables derived from all their rows.

Every derived table exists twice, as Spark expressions and as DuckDB SQL, with the same rows. Dirt
is placed by rules on the key; no row of a given table is left out.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy access to the given and the derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    # --- messy text tables -------------------------------------------------------------------

    @cached_property
    def dirty_orders(self) -> DataFrame:
        """Orders as text: three date styles, thousands texts, negatives, bad ages, gaps, copies.

        ``format_number`` rounds the binary value, as printf does in SQL; ``format_string`` rounds its shortest decimal form.
        """
        return (
            self.read("orders")
            .selectExpr(
                "*",
                "explode(CASE WHEN o_orderkey % 250 = 0 THEN array(0, 1) ELSE array(0) END) AS copy",
            )
            .selectExpr(
                "o_orderkey + 1 + copy * 1000000000000L AS row_no",
                "CAST(o_orderkey AS STRING) AS order_id",
                "CAST(o_custkey AS STRING) AS user_id",
                """CASE o_orderkey % 3
                     WHEN 0 THEN date_format(o_orderdate, 'y/M/d')
                     WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd')
                     ELSE date_format(o_orderdate, 'y年M月d日') END AS order_date""",
                """CASE WHEN o_orderkey % 100 = 3
                          THEN concat('-', format_number(o_totalprice / 1000, '0.00'))
                        WHEN o_orderkey % 20 = 7 THEN format_number(o_totalprice, 1)
                        ELSE format_number(o_totalprice, '0.00') END AS amount""",
                """CASE WHEN o_orderkey % 200 = 5 THEN '-3' WHEN o_orderkey % 200 = 9 THEN '130'
                        ELSE CAST(18 + o_custkey % 48 AS STRING) END AS age""",
                "CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE o_orderpriority END AS channel",
            )
        )

    @cached_property
    def dirty_users(self) -> DataFrame:
        """Customers as text: padded cities, empty names, phones and ids of wrong length."""
        return self.read("customer").selectExpr(
            "c_custkey + 1 AS row_no",
            "CAST(c_custkey AS STRING) AS id",
            "CASE WHEN c_custkey % 40 = 1 THEN '' ELSE c_name END AS name",
            """CASE WHEN c_custkey % 3 = 0 THEN concat('  ', c_mktsegment, ' ')
                    ELSE c_mktsegment END AS city""",
            """concat(CASE WHEN c_custkey % 50 = 10 THEN '13' WHEN c_custkey % 50 = 20 THEN '13999'
                           ELSE '138' END, format_string('%08d', c_custkey)) AS phone""",
            """concat(CASE WHEN c_custkey % 70 = 7 THEN '3101' ELSE '310115' END,
                      format_string('%011d', c_custkey),
                      CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE '5' END) AS idcard""",
        )

    # --- application tables ------------------------------------------------------------------

    @cached_property
    def files(self) -> DataFrame:
        """A catalog of data files: one per part; every fourth one is a product of an earlier one."""
        return self.read("part").selectExpr(
            "p_partkey AS id",
            "concat(replace(p_name, ' ', '_'), '_', p_partkey, '.csv') AS origin_name",
            """CASE p_partkey % 3 WHEN 0 THEN 'excel' WHEN 1 THEN 'csv' ELSE '数据库表' END
               AS file_type""",
            "CASE p_partkey % 3 WHEN 2 THEN '数据库导入' ELSE 'upload' END AS source",
            """CASE p_partkey % 5
                 WHEN 0 THEN concat('["', p_brand, '", "', p_type, '"]')
                 WHEN 1 THEN concat(p_brand, ', ', p_type, ' ,')
                 WHEN 2 THEN ''
                 ELSE concat('["', p_type, '"]') END AS tags""",
            "concat('size ', p_size, ' ', p_type) AS note",
            "CASE WHEN p_size % 9 = 0 THEN NULL ELSE 101L + p_size % 25 END AS category_id",
            "CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 3 END AS parent_file_id",
        )

    @cached_property
    def file_fields(self) -> DataFrame:
        """Field names per file, from the line items of its part."""
        return self.read("lineitem").selectExpr(
            "l_partkey AS file_id",
            """concat(CASE l_returnflag WHEN 'A' THEN 'Amount' WHEN 'R' THEN 'return_flag'
                      ELSE 'order_date' END, '_', l_linenumber) AS field_name""",
        )

    @cached_property
    def categories(self) -> DataFrame:
        """Categories in three levels: regions, nations, suppliers."""
        top = self.read("region").selectExpr(
            "CAST(r_regionkey + 1 AS BIGINT) AS id", "r_name AS name", "CAST(NULL AS BIGINT) AS parent_id"
        )
        middle = self.read("nation").selectExpr(
            "CAST(101 + n_nationkey AS BIGINT)", "n_name", "CAST(n_regionkey + 1 AS BIGINT)"
        )
        leaf = self.read("supplier").selectExpr(
            "1001 + s_suppkey", "s_name", "CAST(101 + s_nationkey AS BIGINT)"
        )
        return top.union(middle).union(leaf)

    @cached_property
    def docs(self) -> DataFrame:
        """The document library: whole texts as summaries."""
        return self.read("documents").selectExpr(
            "doc_id AS id",
            "concat(source, '_', lang, '_', doc_id) AS name",
            "text AS summary",
            "CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 101 + doc_id % 25 END AS category_id",
        )

    @cached_property
    def snippets(self) -> DataFrame:
        """Saved queries, one per conversation turn."""
        return self.read("conversations").selectExpr(
            "conv_id * 100 + turn AS id",
            "concat(role, ' ', conv_id) AS title",
            "text AS sql_body",
            "concat('turn ', turn) AS note",
            "CASE turn % 3 WHEN 0 THEN '留存' WHEN 1 THEN '漏斗' ELSE '汇总' END AS category",
            "CASE conv_id % 2 WHEN 0 THEN 'mysql' ELSE 'hive' END AS dialect",
            "(conv_id * 7 + turn) % 13 AS use_count",
        )

    @cached_property
    def tickets(self) -> DataFrame:
        """Data requests, one per order."""
        return self.read("orders").selectExpr(
            "o_orderkey AS id",
            "concat('request ', o_orderkey) AS title",
            """CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN '高'
                    WHEN o_orderpriority LIKE '3%' THEN '中' WHEN o_orderpriority LIKE '4%' THEN '低'
                    END AS urgency""",
            """CASE o_orderkey % 5
                 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd')
                 WHEN 1 THEN date_format(o_orderdate, 'yyyy/MM/dd')
                 WHEN 2 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 09:30')
                 WHEN 3 THEN ''
                 ELSE 'soon' END AS deadline""",
            """element_at(array('pending', 'confirmed', 'scheduled', 'in_progress', 'delivered',
                                'rework', 'canceled'), CAST(o_custkey % 7 + 1 AS INT)) AS status""",
            "CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey DIV 50 + 1 ELSE 0 END AS sort_order",
        )

    @cached_property
    def status_changes(self) -> DataFrame:
        """A status history per request, from the line items of its order."""
        return self.read("lineitem").selectExpr(
            "l_orderkey AS ticket_id",
            "CAST(l_linenumber AS BIGINT) * 1000000000L + l_partkey * 100 + CAST(l_quantity AS BIGINT)"
            " AS seq",
            """element_at(array('pending', 'confirmed', 'scheduled', 'in_progress', 'delivered',
                                'rework', 'canceled', 'lost'),
                          CAST((l_linenumber + l_partkey) % 8 + 1 AS INT)) AS status""",
            "CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE 'see comment' END AS note",
        )

    @cached_property
    def event_log(self) -> DataFrame:
        """An application event log, one entry per event."""
        return self.read("events").selectExpr(
            "event_id AS id",
            """CASE event_type WHEN 'click' THEN 'snippet_copy' WHEN 'purchase' THEN 'clean_execute'
                    WHEN 'view' THEN 'data_profile_view' WHEN 'signup' THEN 'file_import'
                    ELSE 'ticket_confirm' END AS event""",
            """CASE WHEN event_id % 97 = 0 THEN '{broken'
                    ELSE concat('{"ticket_id": ', user_id, ', "snippet_id": ',
                                (event_id % 50) * 100, ', "preset_id": ', user_id % 3,
                                ', "confirm_result": "',
                                CASE WHEN event_id % 2 = 0 THEN 'rework' ELSE 'confirmed' END, '"}')
                    END AS params_json""",
            "ts AS created_at",
        )

    @cached_property
    def clean_records(self) -> DataFrame:
        """A ledger of cleaning runs, one per event; some used a preset."""
        return self.read("events").selectExpr(
            "event_id AS id",
            "user_id AS file_id",
            "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 END AS preset_id",
            "CASE WHEN event_id % 7 = 0 THEN -1 ELSE user_id END AS output_file_id",
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Commits of a version store, one per event: runs, some undone, some of these run again."""
        return self.read("events").selectExpr(
            "event_id AS seq",
            "concat('v', event_id - event_id % 3) AS version",
            "CASE WHEN event_id % 3 = 1 AND event_id % 4 < 2 OR event_id % 3 = 2 AND event_id % 5 = 0 THEN 'undo' ELSE 'run' END AS kind",
            "concat('user_', (event_id - event_id % 3) % 97, '.csv') AS source",
        )

    @cached_property
    def presets(self) -> DataFrame:
        """Named presets: one per region."""
        return self.read("region").selectExpr("CAST(r_regionkey AS BIGINT) AS id", "r_name AS name")

    @cached_property
    def texts(self) -> DataFrame:
        """Source texts with field names and citations, and generated text with invented numbers."""
        return self.read("documents").selectExpr(
            "doc_id",
            "text",
            "array(lang, concat(source, '_2024')) AS fields",
            """concat('[{"file_id": ', 900000 + doc_id, ', "field": "n_chars", "agg_label": "合计", ',
                      '"value": ', n_chars, '}]') AS refs""",
            """concat(text, '\n本文共 ', format_number(n_chars, 0), ' 字，占比 ', doc_id % 97,
                      '.5%，环比 ', doc_id % 13, '倍，统计于 2024-01-', 1 + doc_id % 28,
                      '，2024年1月', 1 + doc_id % 28, '日 <复核>') AS generated""",
            "translate(text, '7', '8') AS polished",
        )

    @cached_property
    def reports(self) -> DataFrame:
        """Reports with citation lists of different quality."""
        return self.read("documents").selectExpr(
            "doc_id AS id",
            """CASE doc_id % 5
                 WHEN 0 THEN '[]'
                 WHEN 1 THEN '{broken'
                 WHEN 2 THEN NULL
                 ELSE concat('[{"file_id": ', doc_id, ', "field": "n_chars", "agg": "sum",',
                             ' "agg_label": "合计", "value": ', n_chars, '.5},',
                             ' {"file_id": ', doc_id + 1, ', "field": "', lang, '", "agg": "count",',
                             ' "agg_label": "计数", "value": ', doc_id, '}]') END AS refs_json""",
        )


# The same tables in DuckDB SQL.
DUCK: dict[str, str] = {
    "dirty_orders": """
        SELECT o_orderkey + 1 + copy * 1000000000000 AS row_no,
               o_orderkey::VARCHAR AS order_id, o_custkey::VARCHAR AS user_id,
               CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y/%-m/%-d')
                    WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
                    ELSE strftime(o_orderdate, '%Y年%-m月%-d日') END AS order_date,
               CASE WHEN o_orderkey % 100 = 3 THEN '-' || printf('%.2f', o_totalprice / 1000)
                    WHEN o_orderkey % 20 = 7 THEN format('{:,.1f}', o_totalprice)
                    ELSE printf('%.2f', o_totalprice) END AS amount,
               CASE WHEN o_orderkey % 200 = 5 THEN '-3' WHEN o_orderkey % 200 = 9 THEN '130'
                    ELSE (18 + o_custkey % 48)::VARCHAR END AS age,
               CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE o_orderpriority END AS channel
        FROM (SELECT *, unnest(CASE WHEN o_orderkey % 250 = 0 THEN [0, 1] ELSE [0] END) AS copy
              FROM orders)""",
    "dirty_users": """
        SELECT c_custkey + 1 AS row_no, c_custkey::VARCHAR AS id,
               CASE WHEN c_custkey % 40 = 1 THEN '' ELSE c_name END AS name,
               CASE WHEN c_custkey % 3 = 0 THEN '  ' || c_mktsegment || ' ' ELSE c_mktsegment END AS city,
               CASE WHEN c_custkey % 50 = 10 THEN '13' WHEN c_custkey % 50 = 20 THEN '13999'
                    ELSE '138' END || printf('%08d', c_custkey) AS phone,
               CASE WHEN c_custkey % 70 = 7 THEN '3101' ELSE '310115' END
                    || printf('%011d', c_custkey)
                    || CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE '5' END AS idcard
        FROM customer""",
    "files": """
        SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || p_partkey || '.csv' AS origin_name,
               CASE p_partkey % 3 WHEN 0 THEN 'excel' WHEN 1 THEN 'csv' ELSE '数据库表' END AS file_type,
               CASE p_partkey % 3 WHEN 2 THEN '数据库导入' ELSE 'upload' END AS source,
               CASE p_partkey % 5 WHEN 0 THEN '["' || p_brand || '", "' || p_type || '"]'
                    WHEN 1 THEN p_brand || ', ' || p_type || ' ,' WHEN 2 THEN ''
                    ELSE '["' || p_type || '"]' END AS tags,
               'size ' || p_size || ' ' || p_type AS note,
               CASE WHEN p_size % 9 = 0 THEN NULL ELSE 101 + p_size % 25 END::BIGINT AS category_id,
               CASE WHEN p_partkey % 4 = 3 THEN p_partkey - 3 END AS parent_file_id
        FROM part""",
    "file_fields": """
        SELECT l_partkey AS file_id,
               CASE l_returnflag WHEN 'A' THEN 'Amount' WHEN 'R' THEN 'return_flag'
                    ELSE 'order_date' END || '_' || l_linenumber AS field_name
        FROM lineitem""",
    "categories": """
        SELECT (r_regionkey + 1)::BIGINT AS id, r_name AS name, NULL::BIGINT AS parent_id FROM region
        UNION ALL SELECT 101 + n_nationkey, n_name, n_regionkey + 1 FROM nation
        UNION ALL SELECT 1001 + s_suppkey, s_name, 101 + s_nationkey FROM supplier""",
    "docs": """
        SELECT doc_id AS id, source || '_' || lang || '_' || doc_id AS name, text AS summary,
               CASE WHEN doc_id % 6 = 5 THEN NULL ELSE 101 + doc_id % 25 END AS category_id
        FROM documents""",
    "snippets": """
        SELECT conv_id * 100 + turn AS id, role || ' ' || conv_id AS title, text AS sql_body,
               'turn ' || turn AS note,
               CASE turn % 3 WHEN 0 THEN '留存' WHEN 1 THEN '漏斗' ELSE '汇总' END AS category,
               CASE conv_id % 2 WHEN 0 THEN 'mysql' ELSE 'hive' END AS dialect,
               (conv_id * 7 + turn) % 13 AS use_count
        FROM conversations""",
    "tickets": """
        SELECT o_orderkey AS id, 'request ' || o_orderkey AS title,
               CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN '高'
                    WHEN o_orderpriority LIKE '3%' THEN '中'
                    WHEN o_orderpriority LIKE '4%' THEN '低' END AS urgency,
               CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                    WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
                    WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 09:30'
                    WHEN 3 THEN '' ELSE 'soon' END AS deadline,
               ['pending', 'confirmed', 'scheduled', 'in_progress', 'delivered', 'rework',
                'canceled'][o_custkey % 7 + 1] AS status,
               CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey // 50 + 1 ELSE 0 END AS sort_order
        FROM orders""",
    "status_changes": """
        SELECT l_orderkey AS ticket_id,
               l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT AS seq,
               ['pending', 'confirmed', 'scheduled', 'in_progress', 'delivered', 'rework',
                'canceled', 'lost'][(l_linenumber + l_partkey) % 8 + 1] AS status,
               CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE 'see comment' END AS note
        FROM lineitem""",
    "event_log": """
        SELECT event_id AS id,
               CASE event_type WHEN 'click' THEN 'snippet_copy' WHEN 'purchase' THEN 'clean_execute'
                    WHEN 'view' THEN 'data_profile_view' WHEN 'signup' THEN 'file_import'
                    ELSE 'ticket_confirm' END AS event,
               CASE WHEN event_id % 97 = 0 THEN '{broken'
                    ELSE '{"ticket_id": ' || user_id || ', "snippet_id": ' || (event_id % 50) * 100
                         || ', "preset_id": ' || user_id % 3 || ', "confirm_result": "'
                         || CASE WHEN event_id % 2 = 0 THEN 'rework' ELSE 'confirmed' END || '"}'
                    END AS params_json,
               ts AS created_at
        FROM events""",
    "clean_records": """
        SELECT event_id AS id, user_id AS file_id,
               CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 END AS preset_id,
               CASE WHEN event_id % 7 = 0 THEN -1 ELSE user_id END AS output_file_id
        FROM events""",
    "ledger": """
        SELECT event_id AS seq, 'v' || (event_id - event_id % 3) AS version,
               CASE WHEN event_id % 3 = 1 AND event_id % 4 < 2 OR event_id % 3 = 2 AND event_id % 5 = 0
                    THEN 'undo' ELSE 'run' END AS kind,
               'user_' || (event_id - event_id % 3) % 97 || '.csv' AS source
        FROM events""",
    "presets": "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region",
    "texts": """
        SELECT doc_id, text, [lang, source || '_2024'] AS fields,
               '[{"file_id": ' || (900000 + doc_id) || ', "field": "n_chars", "agg_label": "合计", '
                   || '"value": ' || n_chars || '}]' AS refs,
               text || chr(10) || '本文共 ' || format('{:,}', n_chars) || ' 字，占比 ' || doc_id % 97
                   || '.5%，环比 ' || doc_id % 13 || '倍，统计于 2024-01-' || (1 + doc_id % 28)
                   || '，2024年1月' || (1 + doc_id % 28) || '日 <复核>' AS generated,
               translate(text, '7', '8') AS polished
        FROM documents""",
    "reports": """
        SELECT doc_id AS id,
               CASE doc_id % 5 WHEN 0 THEN '[]' WHEN 1 THEN '{broken' WHEN 2 THEN NULL
                    ELSE '[{"file_id": ' || doc_id || ', "field": "n_chars", "agg": "sum",'
                         || ' "agg_label": "合计", "value": ' || n_chars || '.5},'
                         || ' {"file_id": ' || (doc_id + 1) || ', "field": "' || lang
                         || '", "agg": "count", "agg_label": "计数", "value": ' || doc_id || '}]'
                    END AS refs_json
        FROM documents""",
}

# Scalar rules in DuckDB SQL, as macros over an expression.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
_MONTH, _DAY = "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
_TIME = "([ T]([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?)?"


def strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def missing(x: str) -> str:
    return f"({x} IS NULL OR lower({strip(x)}) IN ('', 'na', 'n/a', 'null', 'none', '--', '-'))"


def number(x: str) -> str:
    bare = f"replace({strip(x)}, ',', '')"
    shape = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return f"(CASE WHEN regexp_matches({bare}, '{shape}') THEN TRY_CAST({bare} AS DOUBLE) END)"


def thousands(x: str) -> str:
    return rf"regexp_matches({strip(x)}, '^[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?$')"


def date_text(x: str) -> str:
    shape = f"^[0-9]{{4}}([/-]{_MONTH}[/-]|年{_MONTH}月){_DAY}日?{_TIME}$"
    return f"regexp_matches({strip(x)}, '{shape}')"


def date_value(x: str) -> str:
    iso = f"replace(replace(replace(replace({strip(x)}, '/', '-'), '年', '-'), '月', '-'), '日', '')"
    return f"(CASE WHEN {date_text(x)} THEN TRY_CAST({iso} AS TIMESTAMP) END)"


def number_text(v: str) -> str:
    fixed = f"rtrim(rtrim(TRY_CAST(round({v}, 6) AS DECIMAL(38, 6))::VARCHAR, '0'), '.')"
    whole = f"{v} = floor({v}) AND abs({v}) < 1e15"
    return f"(CASE WHEN {whole} THEN {v}::BIGINT::VARCHAR ELSE {fixed} END)"


def pct(part: str, whole: str) -> str:
    return f"round({part} / nullif({whole}, 0) * 100, 2)"


def duck(body: str, *tables: str) -> str:
    """A DuckDB statement with the named derived tables in front."""
    ctes = ", ".join(f"{name} AS ({DUCK[name]})" for name in tables)
    body = body.strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
