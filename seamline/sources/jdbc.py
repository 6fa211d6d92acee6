"""Tables of a relational database. Addresses and credentials come from the caller's configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, split: str | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A table, or a query in brackets with an alias; filters and columns are pushed to the database.

    With ``split``, a whole-number column, ``partitions`` tasks read ranges of
    it between its ends, which the database is asked for. Rows without it go to
    the first range. An empty table is read by one task.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if split:
        # Spark writes column names in quotes, so the name keeps its case
        name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(split)
        low, high = spark.read.format("jdbc").options(url=url, dbtable=f"(select min({name}) as low, max({name}) as high from {table}) ends", **options).load().first()
        if low is not None:
            reader = reader.options(partitionColumn=split, lowerBound=low, upperBound=high + 1, numPartitions=partitions)
    return reader.load()


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", connections: int = 16, **options: str) -> None:
    """Write rows in batches over at most ``connections`` connections; overwriting empties the table and keeps its definition."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize="10000", numPartitions=connections, truncate="true", **options).mode(mode).save()
