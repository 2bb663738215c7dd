"""Number provenance over document texts, and outlines of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidymill.functions.markup import parse_json_lenient
from tidymill.operators import provenance as N
from workload.fixtures import Tables, duck
from workload.q_functions import TOKEN, canon, strip_tags_sql, token_rows
from workload.registry import query


def _canons(name: str, text: str, source: str = "texts") -> str:
    return f"""{name}_t AS ({token_rows(source, text)}),
        {name} AS (SELECT doc_id, pos, token, {canon('token')} AS canon FROM {name}_t)"""


# one text per document with everything whose numbers are allowed
_ALLOWED = (
    "parts AS (SELECT doc_id, text AS part FROM texts"
    " UNION ALL SELECT doc_id, unnest(fields) FROM texts {refs}),"
    + _canons("allowed", "part", "parts")
)
_WHOLE_REFS = "UNION ALL SELECT doc_id, refs FROM texts"
_VALUES = "UNION ALL SELECT doc_id, json_extract_string(refs, '$[0].value') FROM texts"


def _allowed(refs: str) -> str:
    return _ALLOWED.replace("{refs}", refs)


def _whitelist(t: Tables, strict: bool = False):
    return N.whitelist(t.texts, "text", fields="fields", refs="refs", strict=strict)


@query(
    "n1_whitelist",
    duck(f"WITH {_allowed(_WHOLE_REFS)} SELECT DISTINCT doc_id, canon FROM allowed", "texts"),
)
def n1(t: Tables):
    return _whitelist(t)


@query(
    "n1_whitelist_strict",
    duck(f"WITH {_allowed(_VALUES)} SELECT DISTINCT doc_id, canon FROM allowed", "texts"),
)
def n1_strict(t: Tables):
    return _whitelist(t, strict=True)


_UNSOURCED = f"""{_allowed(_WHOLE_REFS)}, {_canons('made', 'generated')},
    flagged AS (SELECT * FROM made WHERE NOT EXISTS (
        SELECT 1 FROM allowed a WHERE a.doc_id = made.doc_id AND a.canon = made.canon))"""


@query(
    "n2_unsourced_numbers",
    duck(f"WITH {_UNSOURCED} SELECT doc_id, canon, pos, token FROM flagged", "texts"),
)
def n2(t: Tables):
    return N.unsourced_in_rows(t.texts, "generated", "text", fields="fields", refs="refs")


@query("n2_unsourced_numbers_joined", duck(f"WITH {_UNSOURCED} SELECT doc_id, canon, pos, token FROM flagged", "texts"))
def n2_joined(t: Tables):
    return N.unsourced_numbers(t.texts, "generated", _whitelist(t))


def _highlighted(t: Tables):
    return N.highlight(t.texts, "generated", "text", fields="fields", refs="refs")


_ESCAPED = "replace(replace(replace(generated, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_SPAN = '<span class="unsourced" title="无数据来源，请核对或删除">'


@query(
    "n3_highlight",
    duck(
        f"""WITH {_allowed(_WHOLE_REFS)},
        cut AS (SELECT doc_id, string_split_regex({_ESCAPED}, '{TOKEN}') AS parts,
                       regexp_extract_all({_ESCAPED}, '{TOKEN}') AS toks FROM texts),
        toks AS (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM cut),
        named AS (SELECT doc_id, i, parts, toks, toks[i] AS tok, {canon('trim(toks[i])')} AS canon FROM toks),
        known AS (SELECT DISTINCT doc_id, canon, true AS ok FROM allowed),
        marked AS (SELECT n.doc_id, i, parts[len(toks) + 1] AS tail,
                          parts[i] || CASE WHEN ok THEN tok ELSE '{_SPAN}' || tok || '</span>' END AS piece
                   FROM named n LEFT JOIN known k ON k.doc_id = n.doc_id AND k.canon = n.canon)
        SELECT doc_id, array_to_string(list(piece ORDER BY i), '') || max(tail) AS html
        FROM marked GROUP BY doc_id""",
        "texts",
    ),
)
def n3(t: Tables):
    return _highlighted(t).select("doc_id", "html")


@query(
    "n4_export_guard",
    duck(
        f"WITH {_UNSOURCED} SELECT doc_id, count(*) AS unsourced_cnt FROM flagged GROUP BY doc_id",
        "texts",
    ),
)
def n4(t: Tables):
    return N.export_guard(_highlighted(t), "html").select("doc_id", "unsourced_cnt")


@query(
    "n5_dropped_numbers",
    duck(
        f"""WITH {_canons('src', 'text')}, {_canons('out', 'polished')},
        first AS (SELECT doc_id, canon, min(pos) AS pos, arg_min(token, pos) AS token FROM src
                  GROUP BY doc_id, canon),
        gone AS (SELECT * FROM first f WHERE NOT EXISTS (
            SELECT 1 FROM out o WHERE o.doc_id = f.doc_id AND o.canon = f.canon)),
        ranked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank, token FROM gone)
        SELECT * FROM ranked""",
        "texts",
    ),
)
def n5(t: Tables):
    return N.dropped_in_rows(t.texts, "text", "polished")


@query(
    "n6_explode_refs",
    duck(
        """WITH r AS (SELECT id, CASE WHEN json_valid(refs_json) THEN
                from_json(refs_json, '[{"field":"VARCHAR","agg":"VARCHAR","agg_label":"VARCHAR","value":"DOUBLE"}]')
                END AS refs FROM reports),
        e AS (SELECT id, refs, unnest(CASE WHEN coalesce(len(refs), 0) = 0 THEN [0]
                                      ELSE range(1, len(refs) + 1) END) AS k FROM r)
        SELECT id, coalesce(len(refs), 0) AS refs_cnt, CASE WHEN k > 0 THEN k - 1 END AS pos,
            refs[k].field AS field, refs[k].agg AS agg, refs[k].agg_label AS agg_label,
            refs[k].value AS value FROM e""",
        "reports",
    ),
)
def n6(t: Tables):
    return N.explode_refs(t.reports)


_HEADS = r"regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1>|<h2\b[^>]*>.*?</h2>')"


@query(
    "n7_report_outline",
    f"""WITH h AS (SELECT page_id, {_HEADS} AS heads FROM pages),
    e AS (SELECT page_id, unnest(range(1, len(heads) + 1)) AS k, heads FROM h)
    SELECT page_id, k - 1 AS pos, lower(heads[k][2:3]) AS level, {strip_tags_sql('heads[k]')} AS title
    FROM e WHERE {strip_tags_sql('heads[k]')} <> ''""",
)
def n7(t: Tables):
    return N.report_outline(t.pages, "html", "page_id")


def _frameworks(t: Tables):
    """Generated frameworks around page headings: bare, fenced or inside prose."""
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.col("url").alias("title"),
                    F.array(F.lit(" check "), F.lit("  "), F.col("page_id").cast("string")).alias("points"),
                )
            ).alias("sections")
        )
    )
    shape = F.col("page_id") % 3
    content = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.concat(F.lit("Here: "), body, F.lit(" done")))
    )
    return t.pages.select("page_id", content.alias("content"))


@query(
    "n8_framework_sections",
    """SELECT page_id, 0::BIGINT AS section, trim(url) AS title, k - 1 AS point_no,
        CASE k WHEN 1 THEN 'check' ELSE page_id::VARCHAR END AS point
    FROM (SELECT page_id, url, unnest([1, 2]) AS k FROM pages)""",
)
def n8(t: Tables):
    return N.framework_sections(_frameworks(t), "content", "page_id")


@query(
    "f16_parse_json_lenient",
    "SELECT page_id, url AS title FROM pages",
)
def f16(t: Tables):
    parsed = parse_json_lenient(F.col("content"))
    title = F.call_function("variant_get", parsed, F.lit("$.sections[0].title"), F.lit("string"))
    return _frameworks(t).select("page_id", title.alias("title"))
