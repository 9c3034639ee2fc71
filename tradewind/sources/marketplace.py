"""Typed load of the marketplace tables."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema


def load_marketplace(spark: SparkSession, path: str, format: str = "parquet", tables: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """All tables below one folder (or those named), each with its declared schema (no inference pass over the data).

    format is any file source: parquet, orc, json or csv. Snapshots keep orders in month folders; the month stays
    as an extra column of orders, where it prunes the monthly reports. Folders by key leave no column.
    """
    loaded = {}
    for table in schema.TABLES if tables is None else tables:
        declared = schema.ddl(table)
        if table == "orders":
            declared += ", month string"
        reader = spark.read.schema(declared).format(format)
        if format == "csv":
            reader = reader.option("header", True)
        loaded[table] = reader.load(f"{path.rstrip('/')}/{table}").drop("part")
    return loaded


def read_database(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
                  bounds: tuple[str, str] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """One table over JDBC, split into range reads on partition_column. Needs the driver jar on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1],
                                numPartitions=partitions)
    declared = {field.name: field.type for field in schema.TABLES.get(table, [])}
    df = reader.load()
    return df.select(*[F.col(c).cast(declared[c]) if c in declared else F.col(c) for c in df.columns])
