"""Text tables: every cell stays the text it was in the source."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidymill.session import pin
from tidymill.sources.numbering import ROW_NO, data_columns

# Encodings that are accepted.
ENCODINGS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "gbk": "GBK", "gb2312": "GBK"}

_RECORD = "_record"
# a cell after its comma: quoted text with doubled quotes inside, or anything up to the next comma
_CELL = r',("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*)'


def read_text_table(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    encoding: str = "utf-8",
    multi_line: bool = False,
    numbered: bool = True,
    surplus: str | None = None,
) -> DataFrame:
    """CSV files with a header row each to one table of strings; blank lines are skipped, empty cells become ''.

    Columns are matched by name: files may order them differently, and a column that a file lacks is '' in its rows.
    Columns come in the order of the first file (paths ascending), others after it as they appear. Names are compared
    without case; a repeated one gets ``_2``, a blank one its position. A record with more cells than its header
    stops the read, unless ``surplus`` names a text column that takes the extra cells as a JSON list.

    ``multi_line`` allows quoted line breaks but reads a file in one task. With ``numbered`` the rows get
    ``row_no`` in file order, paths ascending.

    The header and the number of records of every split come from one pass when this is called; its result has a row for
    each split. The table itself is lazy and read without a copy: a row knows its split and its place in it. Should
    the splits ever differ from the counted ones, the job stops instead of numbering wrongly.
    """
    if encoding.lower() not in ENCODINGS:
        raise ValueError(f"encoding {encoding!r} is not one of {', '.join(ENCODINGS)}")
    paths = path if isinstance(path, str) else list(path)

    def scan(width: int) -> DataFrame:
        schema = ", ".join([*(f"_c{i} string" for i in range(width)), f"{_RECORD} string"])
        return (
            spark.read.options(header=False, encoding=ENCODINGS[encoding.lower()], multiLine=multi_line, escape='"')
            .option("columnNameOfCorruptRecord", _RECORD)
            .schema(schema)
            .csv(paths)
            .select(
                *(f"_c{i}" for i in range(width)),
                _RECORD,
                F.col("_metadata.file_path").alias("_path"),
                F.col("_metadata.file_block_start").alias("_start"),
                F.col("_metadata.file_block_length").alias("_length"),
                F.monotonically_increasing_id().alias("_mid"),
            )
        )

    splits = _splits(scan(1))
    headers = [
        (r["_head"], _names(r["_head"]))
        for r in splits.where("_head IS NOT NULL").groupBy("_head").agg(F.min("_path").alias("p")).orderBy("p", "_head").collect()
    ]  # one row for each different header
    if not headers:
        raise ValueError(f"no header row in {path}")
    columns: dict[str, str] = {}
    for _, names in headers:
        for name in names:
            columns.setdefault(name.lower(), name)
    return _table(scan(max(len(names) for _, names in headers)), splits, headers, list(columns.values()), numbered, surplus)


def _splits(records: DataFrame) -> DataFrame:
    """A row for each split of each file: its first id and count, the data rows before it, and the header of its file."""
    first = F.min_by(F.struct("_c0", _RECORD), "_mid")
    counted = pin(
        records.groupBy("_path", "_start", "_length").agg(
            F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"), first.alias("_top")
        )
    )
    in_file = Window.partitionBy("_path").orderBy("_start")
    top = F.when(F.row_number().over(in_file) == 1, F.coalesce(F.col(f"_top.{_RECORD}"), F.col("_top._c0"), F.lit("")))
    headed = counted.select("_path", "_start", "_length", "_first", "_n", top.alias("_head"))
    rows = F.col("_n") - F.col("_head").isNotNull().cast("bigint")
    before = F.sum(rows).over(Window.orderBy("_path", "_start")) - rows
    return pin(
        headed.select("*", before.alias("_before"), F.max("_head").over(Window.partitionBy("_path")).alias("_of"))
    )


def _names(header: str) -> list[str]:
    """Column names of a raw header record."""
    cells = next(csv.reader([header.removeprefix("\ufeff")], strict=False), [])
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name, copies = cell or f"_c{i}", 1
        while name.lower() in taken:
            copies += 1
            name = f"{cell or f'_c{i}'}_{copies}"
        taken.add(name.lower())
        names.append(name)
    return names or ["_c0"]


def _table(
    records: DataFrame, splits: DataFrame, headers: list[tuple[str, list[str]]], columns: list[str], numbered: bool, surplus: str | None
) -> DataFrame:
    def by_header(value: Callable[[list[str]], int], column: Callable[[int], Column]) -> Column:
        """What ``column`` makes of a number each header has; plain when they all have the same."""
        heads: dict[int, list[str]] = {}
        for head, names in headers:
            heads.setdefault(value(names), []).append(head)
        chain = F.lit(None)
        for number, of in heads.items():
            chain = column(number) if len(heads) == 1 else F.when(F.col("_of").isin(of), column(number)).otherwise(chain)
        return chain

    def cell(name: str) -> Column:
        def place(names: list[str]) -> int:
            return next((i for i, n in enumerate(names) if n.lower() == name.lower()), -1)

        return by_header(place, lambda i: F.coalesce(F.col(f"_c{i}"), F.lit("")) if i >= 0 else F.lit(""))

    keys = ["_path", "_start", "_length"]
    known = records.join(splits.select(*keys, "_first", "_n", "_head", "_before", "_of"), keys, "left")
    place = F.col("_mid") - F.col("_first")
    stray = F.raise_error(F.concat(F.lit("splits changed while reading "), F.col("_path"))).cast("boolean")
    # every row passes this check, whatever columns are asked for
    is_data = F.when((place >= 0) & (place < F.col("_n")), F.col("_head").isNull() | (place > 0)).otherwise(stray)
    rows = known.where(is_data)
    row_no = F.col("_before") + place + F.col("_head").isNull().cast("bigint")

    width = by_header(len, F.lit)
    listed = F.array(*(F.coalesce(c, F.lit("")) for c in records.columns if c.startswith("_c")))
    raw = F.regexp_replace(F.col(_RECORD), r"[\r\n]+$", "")
    found = F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(_CELL), 1)
    quoted = F.transform(
        found,
        lambda c: F.when(c.rlike(r'^"[\s\S]*"$') & (F.length(c) > 1), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c),
    )
    # a record of the widest kind has no raw text beside it
    cells = F.when(F.col(_RECORD).isNull(), listed).otherwise(quoted)
    extra = F.slice(cells, width + 1, F.greatest(F.size(cells) - width, F.lit(0)))
    more = F.exists(extra, lambda c: c != "")
    if len(headers) == 1:
        more = F.col(_RECORD).isNotNull() & more
    out = [row_no.alias(ROW_NO)] if numbered else []
    out += [cell(c).alias(c) for c in columns]
    if surplus is not None:
        return rows.select(*out, F.when(more, F.to_json(extra)).otherwise("").alias(surplus))
    problem = F.raise_error(F.concat(F.lit("more cells than the header names in row "), row_no.cast("string"), F.lit(", "), F.col("_path")))
    return rows.where(F.when(more, problem.cast("boolean")).otherwise(True)).select(*out)


def as_text_table(df: DataFrame) -> DataFrame:
    """Any frame as a text table: values cast to text, null becomes ''."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in data_columns(df)]
    keep = [ROW_NO] if ROW_NO in df.columns else []
    return df.select(*keep, *cells)


def head_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows as text (5 for a file, 100 for a table, 1000 for a cleaning preview)."""
    return as_text_table(df).orderBy(ROW_NO).limit(n)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Sorted table names of a database."""
    shown = spark.sql(f"SHOW TABLES IN `{database}`" if database else "SHOW TABLES")
    return shown.select(F.col("tableName").alias("table_name")).orderBy("table_name")
