"""Catalog, document, snippet, request and event questions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidymill.plans import catalog as G
from tidymill.plans import events as E
from tidymill.plans import tickets as Q
from tidymill.sources.numbering import number_in_order
from workload.fixtures import Tables, duck, pct
from workload.q_functions import deadline_sql, snippet_sql
from workload.registry import query

_FILES = "id, origin_name, file_type, source, note, category_id, parent_file_id"


@query(
    "g1_search_files",
    duck(
        """WITH h AS (SELECT file_id, array_to_string(list_sort(list(DISTINCT field_name)), '|') AS hit_fields
                      FROM file_fields WHERE lower(field_name) LIKE '%amount%' GROUP BY file_id)
        SELECT f.id, f.origin_name, coalesce(h.hit_fields, '') AS hit_fields
        FROM files f LEFT JOIN h ON h.file_id = f.id
        WHERE h.file_id IS NOT NULL OR lower(origin_name) LIKE '%amount%' OR lower(note) LIKE '%amount%'
           OR lower(coalesce(tags, '')) LIKE '%amount%'""",
        "files", "file_fields",
    ),
)
def g1(t: Tables):
    return G.search_files(t.files, t.file_fields, " amount ").select("id", "origin_name", "hit_fields")


@query(
    "g1_search_files_wildcard",
    duck(
        """SELECT id, origin_name FROM files WHERE lower(origin_name) LIKE '%red%7_.csv%'
           OR lower(note) LIKE '%red%7_.csv%' OR lower(tags) LIKE '%red%7_.csv%'""",
        "files",
    ),
)
def g1_wildcard(t: Tables):
    return G.search_files(t.files, t.file_fields, "ReD%7_.csv").select("id", "origin_name")


@query(
    "g2_type_tree",
    duck(
        """SELECT count(*) FILTER (parent_file_id IS NULL AND file_type = 'excel') AS excel,
            count(*) FILTER (parent_file_id IS NULL AND file_type = 'csv') AS csv,
            count(*) FILTER (parent_file_id IS NULL AND source LIKE '%数据库%') AS database,
            count(*) FILTER (parent_file_id IS NOT NULL) AS cleaned FROM files""",
        "files",
    ),
)
def g2(t: Tables):
    return G.type_tree(t.files)


_TREE = """SELECT c.id, c.name, c.parent_id, p.name AS parent_name, count(f.id) AS cnt
    FROM categories c LEFT JOIN (SELECT * FROM categories WHERE parent_id IS NULL) p ON p.id = c.parent_id
    LEFT JOIN files f ON f.category_id = c.id
    WHERE c.parent_id IS NULL OR p.id IS NOT NULL GROUP BY ALL"""


@query("g3_category_tree", duck(_TREE, "categories", "files"))
def g3(t: Tables):
    return G.category_tree(t.categories, t.files)


@query(
    "g3_uncategorized",
    duck(
        "SELECT count(*) FILTER (category_id IS NULL) AS uncategorized, count(*) AS total FROM files",
        "files",
    ),
)
def g3_rest(t: Tables):
    return G.tree_totals(t.files)


@query(
    "g4_list_files",
    duck(
        f"""SELECT {_FILES} FROM files WHERE file_type = 'csv' AND (
            (json_valid(tags) AND list_contains(from_json(tags, '["VARCHAR"]'), 'ECONOMY'))
            OR (NOT json_valid(tags) AND list_contains(
                list_transform(string_split(tags, ','), lambda x: trim(x)), 'ECONOMY')))""",
        "files",
    ),
)
def g4(t: Tables):
    found = G.list_files(t.files, tag="ECONOMY", file_type="csv")
    return found.select(*_FILES.split(", "))


@query(
    "g5_lineage",
    duck(
        """SELECT f.id, f.origin_name, f.parent_file_id, p.origin_name AS parent_name
        FROM files f LEFT JOIN files p ON p.id = f.parent_file_id WHERE f.parent_file_id IS NOT NULL""",
        "files",
    ),
)
def g5(t: Tables):
    return G.lineage(t.files)


_REMOVED = """SELECT f.id FROM files f JOIN (SELECT DISTINCT s_suppkey AS id FROM supplier) r USING (id)
    UNION SELECT f.id FROM files f WHERE f.parent_file_id IN (
        SELECT id FROM files WHERE parent_file_id IS NULL AND id IN (SELECT s_suppkey FROM supplier))"""


def _removed(t: Tables):
    return G.cascade_set(t.files, t.supplier.select(F.col("s_suppkey").alias("id")))


@query("g6_cascade_set", duck(_REMOVED, "files"))
def g6(t: Tables):
    return _removed(t)


@query(
    "g6_records_left",
    duck(
        f"""WITH gone AS ({_REMOVED}) SELECT id, file_id, output_file_id FROM clean_records
        WHERE file_id NOT IN (SELECT id FROM gone) AND output_file_id NOT IN (SELECT id FROM gone)""",
        "files", "clean_records",
    ),
)
def g6_left(t: Tables):
    left = G.without(t.clean_records, _removed(t), "file_id", "output_file_id")
    return left.select("id", "file_id", "output_file_id")


@query(
    "g7_search_docs",
    duck(
        f"""SELECT id, name, {snippet_sql('summary', 'tion')} AS summary_snippet FROM docs
        WHERE lower(name) LIKE '%tion%' OR lower(summary) LIKE '%tion%'""",
        "docs",
    ),
)
def g7(t: Tables):
    return G.search_docs(t.docs, "tion")


@query(
    "g7_list_docs",
    duck(
        """SELECT d.id, d.name, d.category_id, c.name AS category_name FROM docs d
        LEFT JOIN categories c ON c.id = d.category_id""",
        "docs", "categories",
    ),
)
def g7_list(t: Tables):
    return G.list_docs(t.docs, t.categories).select("id", "name", "category_id", "category_name")


_CLOSURE = """below AS (
    SELECT id, 0 AS depth FROM categories WHERE id = 2
    UNION ALL SELECT c.id, b.depth + 1 FROM categories c JOIN below b ON c.parent_id = b.id)"""


@query(
    "g8_category_closure",
    duck(
        f"WITH {_CLOSURE} SELECT id, min(depth)::BIGINT AS depth FROM below GROUP BY id", "categories"
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def g8(t: Tables):
    return G.category_closure(t.categories, 2)


@query(
    "g9_doc_category_tree",
    duck(
        """SELECT c.id, c.name, c.parent_id, count(d.id) AS cnt FROM categories c
        LEFT JOIN docs d ON d.category_id = c.id GROUP BY ALL""",
        "categories", "docs",
    ),
)
def g9(t: Tables):
    return G.category_counts(t.categories, t.docs)


@query(
    "g10_search_snippets",
    duck(
        """SELECT id, title, use_count FROM snippets WHERE category = '留存' AND dialect = 'mysql'
        AND (lower(title) LIKE '%ent%' OR lower(sql_body) LIKE '%ent%' OR lower(note) LIKE '%ent%')""",
        "snippets",
    ),
)
def g10(t: Tables):
    return G.search_snippets(t.snippets, "ENT", "留存", "mysql").select("id", "title", "use_count")


@query(
    "t2_page",
    duck(
        "SELECT id, title, use_count FROM snippets ORDER BY use_count DESC, id LIMIT 20 OFFSET 40",
        "snippets",
    ),
)
def t2(t: Tables):
    return G.page(t.snippets, G.snippet_order(), 3, 20).select("id", "title", "use_count")


@query(
    "t2_page_with_total",
    duck(
        """SELECT id, name, (SELECT count(*) FROM docs WHERE category_id = 103) AS total FROM docs
        WHERE category_id = 103 ORDER BY id DESC LIMIT 5 OFFSET 5""",
        "docs",
    ),
)
def t2_total(t: Tables):
    """Newest first."""
    return G.page_with_total(t.docs.where("category_id = 103"), [F.desc("id")], 2, 5).select("id", "name", "total")


@query(
    "t2_page_after",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1000 ORDER BY o_orderkey DESC LIMIT 50",
)
def t2_after(t: Tables):
    return G.page_after(t.orders, "o_orderkey", 1000, 50).select("o_orderkey", "o_totalprice")


@query("t5_distinct", "SELECT DISTINCT user_id, ts::DATE::VARCHAR AS dt FROM events")
def t5(t: Tables):
    return t.events.select("user_id", F.col("ts").cast("date").alias("dt")).distinct()


@query(
    "g11_use_counts",
    duck(
        """WITH k AS (SELECT (json_extract_string(params_json, '$.snippet_id'))::BIGINT AS id
                      FROM event_log WHERE event = 'snippet_copy' AND json_valid(params_json))
        SELECT s.id, count(k.id) AS use_count FROM snippets s LEFT JOIN k USING (id) GROUP BY s.id""",
        "snippets", "event_log",
    ),
)
def g11(t: Tables):
    return G.use_counts(t.snippets, t.event_log)


# --- requests ----------------------------------------------------------------------------------

NOW = dt.datetime(1998, 6, 15, 12, 0, 0)
_DUE = deadline_sql("deadline")
_SCORED = f"""scored AS (SELECT *, round(u_score * 0.5 + d_score * 0.3 + 1.5 * 0.2, 4) AS score FROM (
    SELECT *, CASE urgency WHEN '高' THEN 3 WHEN '中' THEN 2 ELSE 1 END AS u_score,
        CASE WHEN {_DUE} < TIMESTAMP '1998-06-15 12:00:00' THEN 4
             WHEN {_DUE} <= TIMESTAMP '1998-06-16 12:00:00' THEN 3
             WHEN {_DUE} <= TIMESTAMP '1998-06-18 12:00:00' THEN 2 ELSE 1 END AS d_score FROM tickets))"""


@query(
    "q1_score_requests",
    duck(
        f"""WITH {_SCORED} SELECT id, u_score::BIGINT AS u_score, d_score::BIGINT AS d_score,
            1.5::DOUBLE AS r_score, score::DOUBLE AS score FROM scored""",
        "tickets",
    ),
)
def q1(t: Tables):
    scored = Q.score_requests(t.tickets, NOW)
    return scored.select(
        "id", "u_score", "d_score", F.col("r_score").cast("double").alias("r_score"), "score"
    )


@query(
    "q2_rank_requests",
    duck(
        f"""WITH {_SCORED} SELECT row_number() OVER (ORDER BY CASE WHEN sort_order > 0 THEN 0 ELSE 1 END,
            sort_order, score DESC, id) AS place, id FROM scored WHERE status <> 'canceled'""",
        "tickets",
    ),
)
def q2(t: Tables):
    ranked = Q.rank_requests(Q.score_requests(t.tickets, NOW))
    # the place on the board, to make the order visible in an unordered comparison
    placed = number_in_order(ranked.select("id", "sort_order", "score"), Q.board_order())
    return placed.select(F.col("row_no").alias("place"), "id")


_TOP = [70, 3, 1200, 11]


@query(
    "q3_set_manual_order",
    duck(f"SELECT id, coalesce(list_position({_TOP}, id), 0)::BIGINT AS sort_order FROM tickets", "tickets"),
)
def q3(t: Tables):
    return Q.set_manual_order(t.tickets, _TOP).select("id", "sort_order")


_MOVES = " OR ".join(
    f"(f = '{a}' AND status IN ({', '.join(repr(b) for b in targets)}))"
    for a, targets in {
        "pending": ["confirmed", "rework", "canceled"],
        "confirmed": ["scheduled", "in_progress", "canceled"],
        "scheduled": ["in_progress", "canceled"],
        "in_progress": ["delivered", "rework"],
        "rework": ["in_progress", "canceled"],
        "delivered": ["rework"],
    }.items()
)


@query(
    "q5_audit_transitions",
    duck(
        f"""WITH h AS (SELECT *, lag(status) OVER (PARTITION BY ticket_id ORDER BY seq) AS f
                       FROM status_changes),
        r AS (SELECT *, CASE WHEN status = 'lost' THEN 'unknown status'
            WHEN f IS NULL THEN CASE WHEN status <> 'pending' THEN 'bad start' END
            WHEN status = f THEN 'same status' WHEN NOT ({_MOVES}) THEN 'not allowed'
            WHEN status = 'rework' AND trim(note) = '' THEN 'note missing' END AS reason FROM h)
        SELECT ticket_id, seq, f AS from_status, status, reason FROM r WHERE reason IS NOT NULL""",
        "status_changes",
    ),
)
def q5(t: Tables):
    return Q.audit_transitions(t.status_changes, seq_block=10_000_000)


_REWORK = """SELECT json_extract_string(params_json, '$.ticket_id')::BIGINT AS ticket_id, count(*) AS rework_cnt
    FROM event_log WHERE event = 'ticket_confirm' AND json_valid(params_json)
    AND json_extract_string(params_json, '$.confirm_result') = 'rework' GROUP BY 1"""


@query("q6_rework_counts", duck(_REWORK, "event_log"))
def q6(t: Tables):
    return Q.rework_counts(t.event_log)


@query(
    "q7_status_list",
    duck("SELECT id, title, urgency, status FROM tickets WHERE status = 'rework'", "tickets"),
)
def q7(t: Tables):
    return Q.status_list(t.tickets, "rework").select("id", "title", "urgency", "status")


@query(
    "q7_status_counts", duck("SELECT status, count(*) AS cnt FROM tickets GROUP BY status", "tickets")
)
def q7_counts(t: Tables):
    return G.count_by(t.tickets, "status")


# --- events ------------------------------------------------------------------------------------


@query(
    "e1_event_summary", duck("SELECT event, count(*) AS cnt FROM event_log GROUP BY event", "event_log")
)
def e1(t: Tables):
    return E.event_summary(t.event_log)


@query(
    "e2_event_params",
    duck(
        """SELECT id, event,
            CASE WHEN json_valid(params_json) THEN json_extract_string(params_json, '$.ticket_id') END AS ticket_id,
            CASE WHEN json_valid(params_json) THEN json_extract_string(params_json, '$.confirm_result') END
                AS confirm_result
        FROM event_log""",
        "event_log",
    ),
)
def e2(t: Tables):
    return E.event_params(t.event_log, ["ticket_id", "confirm_result"]).drop("params")


@query(
    "e3_preset_usage_rate",
    duck(
        f"""SELECT count(*) AS runs, count(preset_id) AS preset_runs,
            {pct('count(preset_id)', 'count(*)')} AS usage_pct FROM clean_records""",
        "clean_records",
    ),
)
def e3(t: Tables):
    return E.preset_usage_rate(t.clean_records)


@query(
    "e4_rework_rate",
    duck(
        f"""WITH w AS ({_REWORK}), n AS (
            SELECT count(*) FILTER (id IN (SELECT ticket_id FROM w)) AS reworked,
                   count(*) FILTER (status = 'delivered') AS delivered FROM tickets)
        SELECT reworked, delivered, {pct('reworked', 'delivered')} AS rework_pct FROM n""",
        "event_log", "tickets",
    ),
)
def e4(t: Tables):
    return E.rework_rate(t.tickets, Q.rework_counts(t.event_log))


@query(
    "e5_weekly_retention",
    f"""WITH u AS (SELECT DISTINCT user_id, date_trunc('week', ts)::DATE AS dt FROM events)
    SELECT a.dt::VARCHAR AS dt, count(DISTINCT a.user_id) AS active_users,
        count(DISTINCT b.user_id) AS retained_users,
        {pct('count(DISTINCT b.user_id)', 'count(DISTINCT a.user_id)')} AS retention_pct
    FROM u a LEFT JOIN u b ON a.user_id = b.user_id AND b.dt = a.dt + 7 GROUP BY a.dt""",
)
def e5(t: Tables):
    return E.weekly_retention(t.events, "user_id", "ts")
