"""Tags, JSON lists, lenient JSON, HTML text and search snippets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidymill.functions.text import strip

# named character references, those that end in a semicolon
ENTITIES = {name.removesuffix(";"): text for name, text in html5.items() if name.endswith(";")}
_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
# numbers of the C1 block stand for what Windows-1252 has there
_C1 = {n: text for n in range(0x80, 0xA0) if (text := bytes([n]).decode("cp1252", "ignore"))}


def replace_matches(
    text: Column, pattern: str, change: Callable[[Column], Column], hits: Column | None = None
) -> Column:
    """Replace every match of ``pattern`` by ``change(match)``; ``hits`` are the matches where they are known."""
    parts = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if hits is None else hits
    pairs = F.zip_with(
        parts, hits, lambda part, hit: F.concat(part, F.coalesce(change(hit), F.lit("")))
    )
    return F.when(F.size(hits) == 0, text).otherwise(F.array_join(pairs, ""))


def escape_html(text: Column) -> Column:
    """Escape ``& < >`` (quotes are left alone)."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _code_point(number: Column) -> Column:
    """The character of a number; U+FFFD for what is none (zero, surrogates, beyond U+10FFFF)."""
    n = number.try_cast("bigint")
    valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    c1 = F.create_map(*[F.lit(x) for kv in _C1.items() for x in kv])
    return F.when(n.between(0x80, 0x9F), F.coalesce(F.try_element_at(c1, n.cast("int")), plain)).otherwise(plain)


def unescape_html(text: Column) -> Column:
    """Decode named and numeric references in a single pass; names that are none stay as they are."""
    names = F.from_json(F.lit(json.dumps(ENTITIES)), "map<string,string>")  # folded to one literal

    def decode(ref: Column) -> Column:
        body = F.substring(ref, F.lit(2), F.length(ref) - 2)
        # more digits than any number has, leading zeros apart, are no character
        digits = F.regexp_replace(body, "^#[xX]?0*", "")
        short = F.when(F.length(digits) <= 8, digits)
        return (
            F.when(body.rlike("^#[xX]"), _code_point(F.conv(short, 16, 10)))
            .when(body.startswith("#"), _code_point(short))
            .otherwise(F.coalesce(F.try_element_at(names, body), ref))
        )

    return replace_matches(text, _ENTITY, decode)


def strip_tags(text: Column) -> Column:
    """Text content of an HTML fragment: tags dropped, references decoded, trimmed."""
    return strip(unescape_html(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", "")))


def tags_parse(text: Column) -> Column:
    """Tag list from a JSON array, or from comma separated text when it is not JSON."""
    listed = F.filter(F.transform(F.split(text, ","), strip), lambda t: t != "")
    empty = F.array().cast("array<string>")
    is_json = F.call_function("try_parse_json", text)
    return (
        F.when(text.isNull() | (text == ""), empty)
        .when(
            is_json.isNotNull(),
            F.coalesce(F.from_json(text, "array<string>"), empty),
        )
        .otherwise(listed)
    )


FENCE = "```"


def parse_json_lenient(text: Column) -> Column:
    """VARIANT from model output: as is, else without code fences, else first ``{`` to last ``}``."""
    body = strip(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(F.concat(body, F.lit("\n")), "\n"), lambda line: ~F.startswith(F.ltrim(line), F.lit(FENCE)))
    text = F.rtrim(F.array_join(lines, "\n"))
    # a fence may also close the last line
    unfenced = strip(F.when(F.endswith(text, F.lit(FENCE)), F.substring(text, F.lit(1), F.length(text) - len(FENCE))).otherwise(text))
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    tried = [
        F.when(candidate != "", F.call_function("try_parse_json", candidate))
        for candidate in (body, unfenced, braces)
    ]
    return F.coalesce(*tried)


def snippet_around(text: Column, keyword: str, width: int = 60, fallback: int = 120) -> Column:
    """Context of the first literal hit: ``width`` characters each side, cut front marked with …."""
    body = F.coalesce(text, F.lit(""))
    at = F.instr(body, F.lit(keyword)) if isinstance(keyword, str) else F.instr(body, keyword)
    start = F.greatest(at - F.lit(width), F.lit(1))
    window = F.substring(body, start, at - start + F.lit(len(keyword) + width))
    cut = F.when(start > 1, F.lit("…")).otherwise(F.lit(""))
    hit = F.concat(cut, F.translate(window, "\n", " "))
    return F.when(at > 0, hit).otherwise(F.translate(F.substring(body, 1, fallback), "\n", " "))


def mask_fields(text: Column, names: Iterable[str], placeholder: str = "[已脱敏字段]") -> Column:
    """Replace field names in text by a placeholder, longest name first."""
    out = F.coalesce(text, F.lit(""))
    for name in sorted({n for n in names if n}, key=lambda n: (-len(n), n)):
        out = F.replace(out, F.lit(name), F.lit(placeholder))
    return out


def summary_text(content: Column, limit: int | None = None) -> Column:
    """A text file held as BINARY, trimmed: UTF-8, else GBK; at most ``limit`` characters if given.

    Bytes that are neither become U+FFFD where ``spark.sql.legacy.codingErrorAction`` is set (``local_session``).
    """
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    gbk = F.decode(content, "GBK")
    text = strip(F.coalesce(utf8, gbk))
    return text if limit is None else F.substring(text, 1, limit)
