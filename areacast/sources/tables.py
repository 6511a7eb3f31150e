"""CSV and Parquet readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areacast.functions.recode import clean_names


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Read declared columns from a (possibly very wide) CSV by their cleaned names.

    Only the header line is looked at up front; there is no pass to infer types.
    Columns outside ``schema`` are never parsed, and a cell that is not a valid
    value of its declared type is missing.  Quoted cells may hold commas, doubled
    quotes and line breaks; a record with more or fewer cells than the header fails
    the job.  ``multi_line=False`` lets large files be split among tasks, for files
    without line breaks in cells.
    """
    if not header:
        raise ValueError("columns are matched by name, so the file needs a header")
    reader = spark.read.options(
        header=True, quote='"', escape='"', multiLine=multi_line, mode="FAILFAST"
    )
    raw = clean_names(reader.csv(path))
    absent = [f.name for f in schema if f.name not in raw.columns]
    if absent:
        raise ValueError(f"columns missing from {path}: {absent}")
    cells = {f.name: F.trim(F.col(f.name)) for f in schema}
    return raw.select(
        *[
            F.when(cells[f.name] != "NA", cells[f.name]).try_cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = None
) -> None:
    """Write Parquet; ``partition_by`` enables pruning on a column such as the area.

    Rows are then rebalanced by that column first, which gives a small area one
    file instead of one per task and splits a hot area into files of normal size.
    """
    if partition_by:
        df.hint("rebalance", partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def shape(df: DataFrame) -> DataFrame:
    """One row with the number of rows and columns."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")
    )
