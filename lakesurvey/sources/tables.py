"""Table reads by column list, the SQL star query, and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(
    spark: SparkSession, name: str, columns: Sequence[str] = (), *, fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Chosen columns of a stored table.

    ``name`` is a path for file formats, a catalog name for ``fmt="table"`` and a remote table for
    ``fmt="jdbc"`` (the caller supplies url and driver in ``options``; without partitioning options
    a remote read is one task, so large tables need ``partitionColumn`` and bounds).
    """
    if fmt == "table":
        frame = spark.table(name)
    elif fmt == "jdbc":
        frame = spark.read.format("jdbc").options(dbtable=name, **(options or {})).load()
    else:
        frame = spark.read.format(fmt).options(**(options or {})).load(name)
    return frame.select(*columns) if columns else frame


# The date filter is a range on the typed column, so it reaches the Parquet scan; the text search
# "date LIKE '%2020%'" it stands for would not.
STAR = """
SELECT f.Sample_ID, s.Sample_date, s.Sample_site, f.Genus_sp_lifestage, f.Life_stage,
       f.Number_counted, f.Zoop_density, f.Zoop_biomass, f.Zoop_len_avg, {extra}
       s.Project, s.Subsampled_vol_mL, s.Diluted_vol_mL
FROM {{final}} f
LEFT JOIN {{sample_info}} s ON f.Sample_ID = s.Sample_ID
LEFT JOIN {{taxa}} t ON f.Genus_sp_lifestage = t.Genus_sp_lifestage
WHERE s.Sample_date >= :first AND s.Sample_date < :after AND s.Project = :project
"""


def sql_star_query(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, *, year: int, project: str,
    taxa_columns: Sequence[str] = ("Order1",), allow_fanout: bool = False,
) -> DataFrame:
    """Final counts of one year and project with sample and taxon columns, stated in SQL.

    A taxon listed several times in the dimension (once per life stage) would repeat its facts;
    it is reduced to distinct rows first unless ``allow_fanout``.
    """
    import datetime

    dim = taxa.select("Genus_sp_lifestage", *taxa_columns)
    text = STAR.format(extra="".join(f"t.{c}, " for c in taxa_columns))
    return final.sparkSession.sql(
        text,
        args={
            "first": datetime.date(year, 1, 1), "after": datetime.date(year + 1, 1, 1), "project": project,
        },
        final=final, sample_info=sample_info, taxa=dim if allow_fanout else dim.distinct(),
    )


def write_csv(df: DataFrame, path: str, *, null: str = "NA", mode: str = "overwrite", compressed: bool = False) -> None:
    """Export with a header row and a text for missing values, one file per task; quotes in quoted cells are doubled.

    ``compressed`` files end in ``.csv.gz``; they are packed quickly rather than tightly.
    """
    writer = df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", null).option("emptyValue", "")
    if compressed:
        writer = writer.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
    writer.csv(path)


def append_table(df: DataFrame, path: str, *, partition: str | None = None, batch: str | None = None) -> None:
    """Append to a Parquet table, optionally partitioned.

    ``rebalance`` gathers each partition value into few well-sized files and splits a value that
    holds much of the data over several tasks. With a ``batch`` the rows lie in a partition of their own, which is
    replaced when the same batch is written again: a load that failed half-way is repeated without doubling any row.
    """
    if partition is not None:
        df = df.hint("rebalance", F.col(partition))
    by = [c for c in ("batch" if batch else None, partition) if c]
    if batch:
        df = df.withColumn("batch", F.lit(batch))
    writer = df.write.mode("overwrite" if batch else "append")
    if batch:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_bucketed(
    df: DataFrame, table: str, *, key: str = "Sample_ID", buckets: int = 1024, path: str | None = None,
    partition: str | None = None, batch: str | None = None, replace: bool = False,
) -> None:
    """Append to a catalog table stored in buckets of a key, optionally partitioned as well.

    Facts and samples bucketed alike join, and then group, by that key without a shuffle. Rows are
    sent to their bucket first, so that a bucket is a few files and not one per task. A ``batch`` is replaced when it is written
    again, as in :func:`append_table`; ``replace`` replaces the partitions that the rows belong to, and leaves the others as they are.
    """
    spark = df.sparkSession
    by = [c for c in ("batch" if batch else None, partition) if c]
    if batch:
        df = df.withColumn("batch", F.lit(batch))
    rows = df.repartition(buckets, key)

    def created(frame: DataFrame):
        writer = frame.write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key)
        writer = writer.partitionBy(*by) if by else writer
        (writer.option("path", path) if path else writer).saveAsTable(table)

    if not by:
        return created(rows)
    if not spark.catalog.tableExists(table):
        created(df.limit(0))
    if not (batch or replace):
        return created(rows)
    # Writes into a catalog table take this setting from the session alone.
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.select(*spark.table(table).columns).write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)
