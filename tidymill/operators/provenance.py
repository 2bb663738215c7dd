"""Where numbers in text come from: whitelists, unsourced and dropped numbers, citations, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymill.functions.markup import (
    escape_html,
    parse_json_lenient,
    replace_matches,
    strip_tags,
)
from tidymill.functions.text import strip
from tidymill.functions.tokens import NUMBER_SCAN, canon_token, number_tokens


# How a flagged number is wrapped and how flags are counted.
SPAN_OPEN = '<span class="unsourced" title="无数据来源，请核对或删除">'
SPAN_CLOSE = "</span>"
SPAN_MARK = 'class="unsourced"'

# Shape of a citation.
REF_SCHEMA = (
    "array<struct<file_id:bigint,file_name:string,field:string,agg:string,agg_label:string,"
    "value:string,ts:string>>"
)


def tokens(docs: DataFrame, text: str) -> DataFrame:
    """``(doc_id, pos, token, canon)``: one row per number token of each text."""
    found = number_tokens(F.col(text))
    return docs.select("doc_id", F.posexplode(found).alias("pos", "token")).select(
        "doc_id", "pos", F.trim("token").alias("token"), canon_token(F.col("token")).alias("canon")
    )


def _allowed_texts(text: str, fields: str | None, refs: str | None, strict: bool) -> Column:
    """All texts of a row whose numbers are allowed, as one array."""
    parts = [F.array(F.coalesce(F.col(text), F.lit("")))]
    if fields:
        parts.append(F.coalesce(F.col(fields), F.array().cast("array<string>")))
    if refs and strict:
        values = F.from_json(F.col(refs), "array<struct<value:string>>")
        listed = F.filter(F.transform(values, lambda r: r["value"]), lambda v: v.isNotNull())
        parts.append(F.coalesce(listed, F.array().cast("array<string>")))
    elif refs:
        parts.append(F.array(F.coalesce(F.col(refs), F.lit(""))))
    return F.concat(*parts)


def _allowed_tokens(text: str, fields: str | None, refs: str | None, strict: bool) -> Column:
    """The different number tokens of all allowed texts of a row, as they are written."""
    return F.array_distinct(F.flatten(F.transform(_allowed_texts(text, fields, refs, strict), number_tokens)))


def _held(df: DataFrame, name: str, expression: Column) -> DataFrame:
    """Adds a column that is formed once a row: a generator of one row is where filters and later uses stop."""
    return df.select("*", F.explode(F.array(expression)).alias(name))


def _unknown(docs: DataFrame, asked: str, given: str, name: str) -> DataFrame:
    """Adds the tokens of the array ``asked`` whose canonical form no token of ``given`` has, each once, in order.

    A token written like a given one is known without its canonical form, so that is formed only for the few others
    and once for each different given one.
    """
    odd = _held(_held(docs, "_odd", F.array_except(asked, given)), "_known", F.transform(given, lambda t: canon_token(t)))
    strange = _held(odd, "_strange", F.array_except(F.transform("_odd", lambda t: canon_token(t)), "_known"))
    found = F.filter("_odd", lambda t: F.array_contains("_strange", canon_token(t)))
    return _held(strange, name, found).drop("_odd", "_known", "_strange")


def whitelist(
    docs: DataFrame,
    text: str,
    *,
    fields: str | None = None,
    refs: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Distinct ``(doc_id, canon)`` of the numbers a text may use.

    They come from the source text, field names and the citation JSON as a whole; ``strict`` takes
    only the cited values, not ids and timestamps.
    """
    allowed = F.array_distinct(F.transform(_allowed_tokens(text, fields, refs, strict), lambda t: canon_token(t)))
    # distinct inside a row already; doc_id is the key of ``docs``
    return docs.select("doc_id", F.explode(allowed).alias("canon"))


def unsourced_numbers(generated: DataFrame, text: str, allowed: DataFrame) -> DataFrame:
    """Tokens of generated text that no allowed number accounts for."""
    return tokens(generated, text).join(allowed, ["doc_id", "canon"], "left_anti")


def unsourced_in_rows(
    docs: DataFrame,
    generated: str,
    text: str,
    *,
    fields: str | None = None,
    refs: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """The same where a row has the generated text beside all it may use: nothing is shuffled."""
    rows = docs.select(
        "doc_id",
        number_tokens(F.col(generated)).alias("_made"),
        _allowed_tokens(text, fields, refs, strict).alias("_given"),
    )
    flagged = _unknown(rows, "_made", "_given", "_flagged").select("doc_id", "_flagged", F.posexplode("_made").alias("pos", "_token"))
    return flagged.where(F.array_contains("_flagged", F.col("_token"))).select(
        "doc_id", canon_token(F.col("_token")).alias("canon"), "pos", F.trim("_token").alias("token")
    )


def dropped_numbers(source: DataFrame, source_text: str, polished: DataFrame, text: str) -> DataFrame:
    """Numbers of the source missing from the polished text, in the order of their first occurrences."""
    both = source.select("doc_id", F.col(source_text).alias("_text")).join(
        polished.select("doc_id", F.col(text).alias("_polished")), "doc_id", "left"
    )
    return dropped_in_rows(both, "_text", "_polished")


def dropped_in_rows(docs: DataFrame, text: str, polished: str) -> DataFrame:
    """The same where a row has both texts: nothing is shuffled."""
    rows = docs.select(
        "doc_id",
        F.array_distinct(number_tokens(F.col(text))).alias("_had"),
        F.array_distinct(number_tokens(F.col(polished))).alias("_has"),
    )
    gone = _held(_unknown(rows, "_had", "_has", "_gone"), "_canons", F.transform("_gone", lambda t: canon_token(t)))
    # of two ways to write a number the first counts
    first = F.filter("_gone", lambda t, i: F.array_position("_canons", F.get("_canons", i)) == i + 1)
    return gone.select("doc_id", F.posexplode(first).alias("_i", "_token")).select(
        "doc_id", (F.col("_i") + 1).alias("rank"), F.trim("_token").alias("token")
    )


def highlight(
    docs: DataFrame,
    generated: str,
    text: str,
    *,
    fields: str | None = None,
    refs: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Escaped generated text with unsourced numbers wrapped, all inside one row: no shuffle."""

    def mark(tok: Column) -> Column:
        return F.when(F.array_contains("_flagged", tok), F.concat(F.lit(SPAN_OPEN), tok, F.lit(SPAN_CLOSE))).otherwise(tok)

    escaped = _held(docs, "_escaped", escape_html(F.coalesce(F.col(generated), F.lit(""))))
    made = _held(escaped, "_made", number_tokens(F.col("_escaped")))
    flagged = _unknown(_held(made, "_given", _allowed_tokens(text, fields, refs, strict)), "_made", "_given", "_flagged")
    marked = _held(flagged, "html", replace_matches(F.col("_escaped"), NUMBER_SCAN, mark, F.col("_made")))
    return marked.drop("_escaped", "_made", "_given", "_flagged")


def export_guard(reports: DataFrame, html: str) -> DataFrame:
    """Reports that must not be exported, with the number of flagged spans."""
    spans = F.regexp_count(F.col(html), F.lit(SPAN_MARK)).cast("bigint")
    return reports.withColumn("unsourced_cnt", spans).where(F.col("unsourced_cnt") > 0)


def _refs(col: str) -> Column:
    """Citations of a report; anything that is not a JSON array counts as none."""
    return F.coalesce(
        F.when(strip(F.col(col)).startswith("["), F.from_json(col, REF_SCHEMA)),
        F.array().cast(REF_SCHEMA),
    )


def explode_refs(reports: DataFrame, refs: str = "refs_json") -> DataFrame:
    """One row per citation of each report, and one with nulls for a report without any."""
    listed = reports.select("id", _refs(refs).alias("_r"))
    return listed.select(
        "id", F.size("_r").cast("bigint").alias("refs_cnt"), F.posexplode_outer("_r").alias("pos", "ref")
    ).select("id", "refs_cnt", "pos", "ref.field", "ref.agg", "ref.agg_label", F.col("ref.value").try_cast("double").alias("value"))


def _pieces(html: Column, tag: str) -> Column:
    """The parts of a page between opening tags; all but the first begin with the tag's name."""
    return F.split(F.coalesce(html, F.lit("")), rf"<(?={tag}[\s>])")


def _closing(piece: Column, name: Column | str) -> Column:
    """Where the closing tag starts in a part, 0 if it has none."""
    return F.instr(F.lower(piece), F.concat(F.lit("</"), F.lit(name) if isinstance(name, str) else name))


def report_outline(reports: DataFrame, html: str, key: str) -> DataFrame:
    """h1 and h2 headings in order, as text; empty ones and those that are not closed are skipped."""
    parts = _pieces(F.col(html), "[hH][12]")
    named = F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(F.lower(F.substring(p, 1, 2)).alias("level"), p.alias("rest")),
    )
    closed = F.filter(named, lambda h: _closing(h["rest"], h["level"]) > 0)
    opened, end = F.instr("h.rest", F.lit(">")), _closing(F.col("h.rest"), F.col("h.level"))
    title = strip_tags(F.substring("h.rest", opened + 1, F.greatest(end - opened - 1, F.lit(0))))
    return (
        reports.select(key, F.posexplode(closed).alias("pos", "h"))
        .select(key, "pos", F.col("h.level").alias("level"), title.alias("title"))
        .where(F.col("title") != "")
    )


# Fixed value: the class of a template's hints.
HINT_CLASS = "template-hint"


def without_hints(html: Column) -> Column:
    """Report body without the template's hint paragraphs."""
    parts = _pieces(html, "[pP]")

    def rest(piece: Column, i: Column) -> Column:
        named = F.regexp_extract(F.substring_index(piece, ">", 1), r'(?i)class="([^"]*)"', 1).contains(HINT_CLASS)
        end = _closing(piece, "p>")
        after = F.substring(piece, end + 4, F.length(piece))
        return F.when(i == 0, piece).when(named & (end > 0), after).otherwise(F.concat(F.lit("<"), piece))

    return F.when(html.isNotNull(), F.array_join(F.transform(parts, rest), ""))


_SECTIONS = "struct<sections:array<struct<title:string,points:array<string>>>>"


def framework_sections(outputs: DataFrame, content: str, key: str) -> DataFrame:
    """Titles and writing points of a generated framework; blank ones are dropped.

    A section without points stays as one row with a null point.
    """
    parsed = F.from_json(parse_json_lenient(F.col(content)).cast("string"), _SECTIONS)
    sections = outputs.select(key, F.posexplode(parsed["sections"]).alias("section", "s")).select(
        key,
        "section",
        strip(F.col("s.title")).alias("title"),
        F.filter(F.transform("s.points", strip), lambda p: p != "").alias("points"),
    )
    return (
        sections.where(F.col("title") != "")
        .select(key, "section", "title", F.posexplode_outer("points").alias("point_no", "point"))
    )
