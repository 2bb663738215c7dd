"""The catalog of tables, documents and saved queries: search, trees, lists, lineage, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymill.functions.markup import snippet_around, tags_parse
from tidymill.session import pin

MAX_PAGE_SIZE = 100
LEVELS_TOGETHER = 20  # levels read one by one before they are written as one table


def matches(col: Column, keyword: str) -> Column:
    """LIKE '%keyword%' that ignores ASCII case; % and _ in the keyword are wildcards."""
    folded = "".join(c.lower() if c.isascii() else c for c in keyword)
    lower = F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.like(lower, F.lit(f"%{folded}%"), F.lit("\x00")), F.lit(False))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 10) -> DataFrame:
    """One page of a list in a fixed order."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page counts from 1 and page_size lies between 1 and 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int = 1, size: int = 10) -> DataFrame:
    """One page with the number of all rows beside each of its own; the count reads no column."""
    total = df.agg(F.count("*")).scalar()
    return page(df, order, number, size).withColumn("total", total)


def page_after(df: DataFrame, key: str, last: object, size: int = 10) -> DataFrame:
    """The page that follows a known key, newest first: a filter instead of a deep offset."""
    return df.where(F.col(key) < F.lit(last)).orderBy(F.desc(key)).limit(size)


# --- tables -----------------------------------------------------------------------------------


def search_files(files: DataFrame, fields: DataFrame, keyword: str) -> DataFrame:
    """Files whose name, note, tags or any field name contains the keyword, with the hit fields.

    Hit fields are reduced to one row per file before the join.
    """
    word = (keyword or "").strip()
    if not word:
        return files.withColumn("hit_fields", F.array().cast("array<string>")).limit(0)
    hits = (
        fields.where(matches(F.col("field_name"), word))
        .groupBy(F.col("file_id").alias("id"))
        .agg(F.array_sort(F.collect_set("field_name")).alias("hit_fields"))
    )
    direct = _any([matches(F.col(c), word) for c in ("origin_name", "note", "tags")])
    return (
        files.join(hits, "id", "left")
        .where(direct | F.col("hit_fields").isNotNull())
        .withColumn("hit_fields", F.coalesce("hit_fields", F.array().cast("array<string>")))
    )


def type_tree(files: DataFrame) -> DataFrame:
    """Counts of source files per kind, and of products."""
    source = F.col("parent_file_id").isNull()
    return files.agg(
        F.count_if(source & (F.col("file_type") == "excel")).alias("excel"),
        F.count_if(source & (F.col("file_type") == "csv")).alias("csv"),
        F.count_if(source & F.col("source").contains("数据库")).alias("database"),
        F.count_if(~source).alias("cleaned"),
    )


def lineage(files: DataFrame) -> DataFrame:
    """Products with the name of the file they were made from."""
    parents = files.select(
        F.col("id").alias("parent_file_id"), F.col("origin_name").alias("parent_name")
    )
    return (
        files.where(F.col("parent_file_id").isNotNull())
        .select("id", "origin_name", "parent_file_id")
        .join(parents, "parent_file_id", "left")
    )


def category_counts(categories: DataFrame, items: DataFrame, key: str = "category_id") -> DataFrame:
    """Every category with its own item count, zero included."""
    counts = items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.count("*").alias("cnt")
    )
    return categories.join(counts, "id", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def tree_totals(items: DataFrame, key: str = "category_id") -> DataFrame:
    """Items without category, and all items."""
    return items.agg(
        F.count_if(F.col(key).isNull()).alias("uncategorized"), F.count("*").alias("total")
    )


def category_tree(categories: DataFrame, items: DataFrame) -> DataFrame:
    """Two-level tree as rows: top categories, their children, and the name of the parent."""
    counted = category_counts(categories, items)
    tops = categories.where(F.col("parent_id").isNull()).select(
        F.col("id").alias("parent_id"), F.col("name").alias("parent_name")
    )
    return counted.join(tops, "parent_id", "left").where(
        F.col("parent_id").isNull() | F.col("parent_name").isNotNull()
    ).select("id", "name", "parent_id", "parent_name", "cnt")


def list_files(
    files: DataFrame,
    *,
    category_id: int | None = None,
    tag: str | None = None,
    file_type: str | None = None,
) -> DataFrame:
    """Files filtered by category, exact tag and type, tags parsed; page it newest first."""
    out = files
    if category_id is not None:
        out = out.where(F.col("category_id") == category_id)
    if file_type:
        out = out.where(F.col("file_type") == file_type)
    out = out.withColumn("tags", tags_parse(F.col("tags")))
    return out.where(F.array_contains("tags", tag)) if tag else out


def cascade_set(files: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids that go when files are removed: the files and the products made from removed sources."""
    roots = removed.select("id").distinct()
    own = files.join(roots, "id", "left_semi").select("id", "parent_file_id")
    sources = own.where(F.col("parent_file_id").isNull()).select(F.col("id").alias("parent_file_id"))
    products = files.join(sources, "parent_file_id", "left_semi").select("id")
    return own.select("id").union(products).distinct()


def without(table: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """A table without the rows that refer to a removed id through any of the keys."""
    for key in keys:
        table = table.join(ids.select(F.col("id").alias(key)), key, "left_anti")
    return table


# --- documents --------------------------------------------------------------------------------


def search_docs(docs: DataFrame, keyword: str) -> DataFrame:
    """Documents with the keyword in name or summary, with the context of the first hit."""
    word = (keyword or "").strip()
    if not word:
        return docs.select("id", "name", F.lit("").alias("summary_snippet")).limit(0)
    return docs.where(_any([matches(F.col(c), word) for c in ("name", "summary")])).select(
        "id", "name", snippet_around(F.col("summary"), word).alias("summary_snippet")
    )


def list_docs(docs: DataFrame, categories: DataFrame, category_id: int | None = None) -> DataFrame:
    """Documents with category names; -1 stands for documents without category."""
    if category_id == -1:
        docs = docs.where(F.col("category_id").isNull())
    elif category_id is not None:
        docs = docs.where(F.col("category_id") == category_id)
    names = categories.select(
        F.col("id").alias("category_id"), F.col("name").alias("category_name")
    )
    return docs.join(names, "category_id", "left")


def category_closure(categories: DataFrame, root: int) -> DataFrame:
    """A category and all its descendants, any depth, with the depth at which each is first met.

    Each level is one join of the categories with those met last; it ends when a level brings no new id, so a chain
    of any length is followed to its end and cycles stop by themselves. Levels are written to the shared folder.
    """
    tree = categories.select("id", "parent_id")
    level = pin(tree.where(F.col("id") == int(root)).select("id").distinct().withColumn("depth", F.lit(0)))
    met, depth = level, 0
    while not level.isEmpty():
        depth += 1
        children = tree.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").distinct()
        level = pin(children.join(met, "id", "left_anti").withColumn("depth", F.lit(depth)))
        met = met.union(level)
        if depth % LEVELS_TOGETHER == 0:
            met = pin(met)
    return met


# --- saved queries ----------------------------------------------------------------------------


def search_snippets(
    snippets: DataFrame, keyword: str = "", category: str = "", dialect: str = ""
) -> DataFrame:
    """Keyword in title, body or note AND category AND dialect; page it by ``SNIPPET_ORDER``."""
    word, out = keyword.strip(), snippets
    if word:
        out = out.where(_any([matches(F.col(c), word) for c in ("title", "sql_body", "note")]))
    if category.strip():
        out = out.where(F.col("category") == category.strip())
    if dialect.strip():
        out = out.where(F.col("dialect") == dialect.strip())
    return out


def snippet_order() -> list[Column]:
    return [F.desc("use_count"), F.asc("id")]


def use_counts(snippets: DataFrame, events: DataFrame) -> DataFrame:
    """Copies per saved query, counted from ``snippet_copy`` events."""
    copied = F.get_json_object("params_json", "$.snippet_id").try_cast("bigint")
    counts = (
        events.where(F.col("event") == "snippet_copy")
        .groupBy(copied.alias("id"))
        .agg(F.count("*").alias("use_count"))
    )
    return snippets.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("use_count", F.lit(0)).alias("use_count")
    )


def count_by(df: DataFrame, key: str, values: list[str] | None = None) -> DataFrame:
    """Rows per key; with a fixed list of values, those that do not occur show zero."""
    counts = df.groupBy(key).agg(F.count("*").alias("cnt"))
    if values is None:
        return counts
    every = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(key))
    return every.join(counts, key, "left").select(key, F.coalesce("cnt", F.lit(0)).alias("cnt"))
