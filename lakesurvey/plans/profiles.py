"""Profiles of the facts from sketches kept beside them by year, of which a batch refreshes its years alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakesurvey.operators.sketches import level_sketch, levels_of_sketch, number_sketch, profile_of_sketch
from lakesurvey.sources import read_table

NUMBERS, LEVELS = "sketch_numbers", "sketch_levels"


def _write_years(sketch: DataFrame, path: str) -> None:
    rows = sketch.hint("rebalance", F.col("year"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def store_sketches(df: DataFrame, folder: str, numbers: Sequence[str], levels: Sequence[str] = (), *, years: Sequence[int] | None = None) -> None:
    """Write the sketches of a table that has a ``year``, replacing the years that occur in it.

    With ``years``, those that new sheets touched, only these are read and replaced. Rows without a year make a group of their own,
    which ``years`` leaves out. A year of which no row is left keeps its old sketch.
    """
    if years is not None:
        df = df.filter(F.col("year").isin(list(years)))
    if numbers:
        _write_years(number_sketch(df, ["year"], numbers), f"{folder}/{NUMBERS}")
    if levels:
        _write_years(level_sketch(df, ["year"], levels), f"{folder}/{LEVELS}")


def _of_years(df: DataFrame, years: Sequence[int] | None) -> DataFrame:
    return df if years is None else df.filter(F.col("year").isin(list(years)))


def stored_profile(df: DataFrame, folder: str, columns: Sequence[str], *, years: Sequence[int] | None = None) -> DataFrame:
    """Missing values, minimum, exact quartiles, mean and maximum of all or some years: sketches, and one pass over the rows of these years."""
    sketch = read_table(df.sparkSession, f"{folder}/{NUMBERS}")
    return profile_of_sketch(_of_years(sketch, years), _of_years(df, years), columns)


def stored_levels(spark: SparkSession, folder: str, columns: Sequence[str], *, years: Sequence[int] | None = None, top: int = 100) -> DataFrame:
    """The commonest levels of text columns in all or some years, without reading the table."""
    sketch = _of_years(read_table(spark, f"{folder}/{LEVELS}"), years)
    return levels_of_sketch(sketch.filter(F.col("column").isin(list(columns))), top=top)
