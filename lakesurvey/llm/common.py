"""Tables, working folders and ragged arrays shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lakesurvey.session import shared_folder

#: Text handled at a time inside a task, in characters: bounds what a batch of long texts needs.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows that Spark hands to Python at once; a row may be a very long text.

    Also lets Python workers find this package where it was not installed or shipped, but lies at the same path.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about ``limit`` characters each, one row at least."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run begins when runs of these lengths lie one after another."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def gather_runs(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]`` one after another."""
    lengths = lengths.astype(np.int64, copy=False)
    if not len(lengths) or not (total := int(lengths.sum())):
        return flat[:0]
    return flat[np.repeat(starts - starts_of(lengths), lengths) + np.arange(total)]


def sums_of(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run; runs may be empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def grown(array: np.ndarray, used: int, more: Iterable | np.ndarray) -> np.ndarray:
    """``array`` with ``more`` put in at ``used``, enlarged by doubling where needed."""
    more = np.asarray(more, array.dtype)
    need = used + len(more)
    if need > len(array):
        array = np.concatenate([array, np.empty(max(need, 2 * len(array)) - len(array), array.dtype)])
    array[used:need] = more
    return array
