"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_CLASSES = {"double": "double", "character": "string", "integer": "bigint", "logical": "boolean", "date": "date"}


def read_table(spark: SparkSession, path: str, sep: str = " ", classes: Sequence[str | None] = ("double",), names: Sequence[str] | None = None) -> DataFrame:
    """Delimited text without header or quotes.  A class None skips its column, so that it is never parsed.

    A row that is short, or a field that doesn't parse, is an error.  Dates are YYYY-MM-DD.
    """
    names = list(names or [f"V{i + 1}" for i in range(len(classes))])
    schema = ", ".join(f"`{n}` {_CLASSES[c] if c else 'string'}" for n, c in zip(names, classes, strict=True))
    df = spark.read.csv(path, sep=sep, schema=schema, mode="FAILFAST", header=False, quote="", dateFormat="yyyy-MM-dd", enforceSchema=True)
    return df.select(*[n for n, c in zip(names, classes, strict=True) if c])


def write_table(df: DataFrame, path: str, sep: str = " ") -> None:
    """The same format, one file a partition."""
    df.write.mode("overwrite").csv(path, sep=sep, header=False, quote="", nullValue="NA", dateFormat="yyyy-MM-dd")


def read(spark: SparkSession, path: str, form: str = "parquet", **options: str) -> DataFrame:
    """Any format of Spark's: parquet, orc, json, csv, text, jdbc."""
    return spark.read.format(form).options(**options).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists", **options: str) -> None:
    df.write.format(form).mode(mode).partitionBy(*partition_by).options(**options).save(path)


def show(df: DataFrame, rows: int = 100) -> None:
    """Prints the first rows, as an interactive session does."""
    df.show(rows, truncate=False)
