"""Reading from MySQL or PostgreSQL through Spark's JDBC source, read only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidymill.sources.guard import check_select

_DRIVERS = {
    "mysql": ("jdbc:mysql://{host}:{port}/{db}", "com.mysql.cj.jdbc.Driver", 3306, "`"),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{db}", "org.postgresql.Driver", 5432, '"'),
}


def _kind(config: dict) -> tuple[str, str, int, str]:
    name = str(config.get("type", "")).lower()
    if name not in _DRIVERS:
        raise ValueError(f"no JDBC settings for {name!r}; known: {', '.join(_DRIVERS)}")
    return _DRIVERS[name]


def quote_name(config: dict, name: str) -> str:
    """Quote an identifier in the database's own style."""
    mark = _kind(config)[3]
    return f"{mark}{name.replace(mark, mark * 2)}{mark}"


def connection_options(config: dict) -> dict[str, str]:
    url, driver, port, _ = _kind(config)
    return {
        "url": url.format(
            host=config["host"], port=config.get("port") or port, db=config["db_name"]
        ),
        "driver": driver,
        "user": config["username"],
        "password": config["password"],
        "fetchsize": str(config.get("fetchsize", 10_000)),
    }


def query_options(config: dict, sql: str, limit: int | None = None) -> dict[str, str]:
    """Options for one guarded SELECT, which the database runs; all its rows unless ``limit`` is given."""
    return {**connection_options(config), "query": check_select(sql, limit)}


def table_options(
    config: dict,
    table: str,
    *,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int = 1,
) -> dict[str, str]:
    """Options for a whole table, read in parallel ranges when a partition column is given."""
    options = {**connection_options(config), "dbtable": quote_name(config, table)}
    if partition_column:
        if lower is None or upper is None or partitions < 1:
            raise ValueError("a partition column needs lower, upper and at least one partition")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Load what the options describe; an empty result is an error."""
    df = spark.read.format("jdbc").options(**options).load()
    if df.isEmpty():
        raise ValueError("the query has no rows to import")
    return df
