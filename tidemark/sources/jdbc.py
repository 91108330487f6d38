"""JDBC tables: option sets per dialect, partitioned scans, previews.

Credentials go into the reader's options, never into the URL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import rules

DRIVERS = {
    "postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "oracle": "oracle.jdbc.OracleDriver",
}


def jdbc_options(dialect: str, database: str, host: str = "localhost", port: int | None = None,
                 username: str | None = None, password: str | None = None, **extra) -> dict[str, str]:
    """Reader options for one of the known dialects."""
    if dialect not in DRIVERS:
        raise ValueError(f"unsupported database type: {dialect}")
    port = port or rules.JDBC_PORTS.get(dialect)
    url = {
        "sqlite": f"jdbc:sqlite:{database}",
        "mssql": f"jdbc:sqlserver://{host}:{port};databaseName={database}",
        "oracle": f"jdbc:oracle:thin:@//{host}:{port}/{database}",
    }.get(dialect, f"jdbc:{dialect}://{host}:{port}/{database}")
    opts = {"url": url, "driver": DRIVERS[dialect], **{k: str(v) for k, v in extra.items()}}
    if username:
        opts["user"] = username
    if password:
        opts["password"] = password
    return opts


def scan(spark: SparkSession, options: dict[str, str], table: str, partition_column: str | None = None,
         bounds: tuple | None = None, partitions: int = 16, fetch_size: int = 10000) -> DataFrame:
    """Table scan; with a numeric or date column and its bounds, ``partitions`` parallel range reads.

    Filters, column choice and limits on the result are pushed to the database.
    """
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
                                numPartitions=str(partitions))
    return reader.option("pushDownLimit", True).load()


def preview(spark: SparkSession, options: dict[str, str], table: str, n: int = 100) -> DataFrame:
    return scan(spark, options, table).limit(n)


def information_schema(spark: SparkSession, options: dict[str, str], schema: str) -> DataFrame:
    """(table, column, pos, data_type, is_nullable) from the database's information schema."""
    safe = schema.replace("'", "''")
    query = ("SELECT table_name, column_name, ordinal_position, data_type, is_nullable FROM information_schema.columns "
             f"WHERE table_schema = '{safe}'")
    raw = spark.read.format("jdbc").options(**options).option("query", query).load()
    return raw.toDF("table", "column", "pos", "data_type", "is_nullable")
