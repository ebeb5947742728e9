"""Tables of a relational database through Spark's JDBC source and sink."""

from __future__ import annotations

from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession

from keepsake import schema

#: Rows that the driver program fetches or sends at a time, and connections at most.
ROWS, CONNECTIONS = 10_000, 16


def url(host: str, database: str, port: int = 5432, kind: str = "postgresql", **more: str) -> str:
    """The JDBC address of a server; more are parameters of the connection, none of them a password."""
    return f"jdbc:{kind}://{host}:{port}/{database}" + (f"?{urlencode(sorted(more.items()))}" if more else "")


def read(spark: SparkSession, address: str, table: str, options: dict[str, str] | None = None, by: str | None = None, bounds: tuple[object, object] | None = None, parts: int = CONNECTIONS) -> DataFrame:
    """A table or a subquery in parentheses. Filters and columns are pushed to the database; with by (a number, date or time column) and its bounds, parts
    connections read a range each, rows outside the bounds and nulls included."""
    reader = spark.read.format("jdbc").options(url=address, dbtable=table, fetchsize=str(ROWS), **(options or {}))
    if by is not None:
        if bounds is None:
            raise ValueError("a column to read by needs its bounds")
        reader = reader.options(partitionColumn=by, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def write(df: DataFrame, address: str, table: str, mode: str = "append", options: dict[str, str] | None = None, parts: int = CONNECTIONS) -> None:
    """Appends (or overwrites, keeping the table's definition) by at most parts connections. A task that runs again may send rows twice: the table's key decides."""
    df.write.format("jdbc").options(url=address, dbtable=table, batchsize=str(ROWS), numPartitions=str(parts), truncate="true", **(options or {})).mode(mode).save()


def read_declared(spark: SparkSession, address: str, table: str, **more) -> DataFrame:
    """A declared table with its columns as the model has them, whatever case and types the database gives."""
    raw = read(spark, address, table, **more)
    own = {c.lower(): c for c in raw.columns}
    return raw.select(*(raw[own[c.name]].cast(c.type).alias(c.name) for c in schema.columns(table)))
