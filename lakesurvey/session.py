"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every plan relies on. All of them can be changed on a live session.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles keep all cores busy; large ones are cut by the advisory size as usual.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # A side whose measured size is under this is broadcast at run time, whatever was estimated.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # A sample, taxon or site may hold a large share of the facts: split its join tasks even
    # where that costs one more exchange before the aggregate that follows.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Skip the sorts of a merge join when each partition of one side turns out to fit this map.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # The JVM never compiles a method beyond 8000 bytes of bytecode; a wider generated stage is better
    # run as separate operators, whose expressions are split into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows that lie by sheet are joined and grouped by sheet and taxon as they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table, in the folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset (local runs and
    tests) a temporary folder takes its place. On a cluster, a folder of one machine's own file system is refused. The path
    is new on every call.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not local and (not root or root.startswith("file:")):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{(root or tempfile.gettempdir()).rstrip('/')}/lakesurvey-{label}-{uuid.uuid4().hex}"


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a stored table's files, in whatever file system they lie."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a working folder that is no longer read, in whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
