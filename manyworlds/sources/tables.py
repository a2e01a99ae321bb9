"""Sources and sinks. Parquet is the storage format; the rest is for exchange with other systems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root` (one file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: str, *, sep: str = "\t", null: str = "\\N", header: bool = False, quote: str = '"', escape: str = '"') -> DataFrame:
    """Delimited text with an explicit schema, so no pass is spent on inference. Malformed lines fail the read; use
    :func:`manyworlds.operators.lenient.load_lines` to separate them instead."""
    return spark.read.csv(path, schema=schema, sep=sep, nullValue=null, header=header, quote=quote, escape=escape, mode="FAILFAST")


def write_delimited(df: DataFrame, path: str, *, sep: str = "\t", null: str = "\\N", header: bool = False, quote: str = '"', escape: str = '"') -> None:
    """The sink that mirrors :func:`delimited`."""
    df.write.mode("overwrite").csv(path, sep=sep, nullValue=null, header=header, quote=quote, escape=escape, emptyValue="")


def jdbc(spark: SparkSession, url: str, query: str, *, properties: dict[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A remote query. `partition` = (column, lower, upper, count) splits the read over that many connections."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) remote").options(**(properties or {}))
    if partition:
        column, lower, upper, count = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=count)
    return reader.load()


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A literal row list."""
    return spark.createDataFrame(list(rows), schema)


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "generate_series") -> DataFrame:
    """The integers from `start` to `stop` inclusive; empty if the step leads away from `stop`. Step 0 is an error."""
    if step == 0:
        raise ValueError("step size cannot equal zero")
    return spark.range(start, stop + (1 if step > 0 else -1), step).toDF(name)
