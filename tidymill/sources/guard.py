"""Read-only SQL: one SELECT statement passes, anything that could write is refused."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Refused words.
REFUSED_WORDS = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE",
)

# what a statement is made of; quoted parts and comments are one token each
_TOKEN = re.compile(
    r"""(?P<comment>--[^\n]*|/\*.*?\*/)
      | (?P<quoted>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)
      | (?P<word>\w+)
      | (?P<open>['"`]|/\*)
      | (?P<other>\s+|.)""",
    re.S | re.X,
)


def check_select(sql: str, limit: int | None = None, max_chars: int | None = None) -> str:
    """The statement without comments; ``ValueError`` says why it is refused.

    Words inside literals and quoted names are never looked at. With ``limit`` the result is wrapped
    to at most that many rows, whatever the statement itself says.
    """
    text = sql or ""
    if max_chars is not None and len(text) > max_chars:
        raise ValueError(f"statement is longer than {max_chars} characters")
    kept, words = [], []
    for token in _TOKEN.finditer(text):
        kind, part = token.lastgroup, token.group()
        if kind == "open":
            raise ValueError(f"nothing closes the {part} at position {token.start()}")
        if kind == "word":
            words.append(part.upper())
        kept.append(" " if kind == "comment" else part)
    statement = "".join(kept).strip().removesuffix(";").rstrip()
    if words[:1] != ["SELECT"] or not statement[:6].isalpha():
        raise ValueError("only a statement that starts with SELECT can run here")
    writes = sorted(set(words) & set(REFUSED_WORDS))
    if writes:
        raise ValueError(f"a read-only statement cannot use {', '.join(writes)}")
    return statement if limit is None else f"SELECT * FROM ({statement}) AS bounded LIMIT {int(limit)}"


def guarded_select(spark: SparkSession, sql: str, limit: int | None = None, **views: DataFrame) -> DataFrame:
    """Run a checked SELECT; frames given by name can be used as ``{name}`` in the text."""
    return spark.sql(check_select(sql, limit), **views)
