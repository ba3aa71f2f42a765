"""Reconciliation of sheets with what was derived from them, and volume and density checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.functions import parse_date, ratio
from lakesurvey.operators.aggregates import group_count, row_nonnull_count
from lakesurvey.operators.datasheet import KEY, TAXON
from lakesurvey.operators.joins import join_within, left_join
from lakesurvey.schemas import HEADER, LENGTH_CELLS

# Relative volume difference that counts as different, and the density difference
# (individuals per litre) worth chasing.
RATIO_LOW, RATIO_HIGH = 0.99, 1.01
DENSITY_TOLERANCE = 0.1


def qa_measured_counts(sheets: DataFrame, lengths: DataFrame, key: str = KEY) -> DataFrame:
    """Filled length cells per taxon row against length rows produced for that sheet and taxon."""
    cells = row_nonnull_count(sheets.select(key, TAXON, *LENGTH_CELLS), LENGTH_CELLS, "sheet_measured")
    made = group_count(lengths, key, TAXON, name="entered_measured")
    joined = join_within(cells.drop(*LENGTH_CELLS), made.hint("shuffle_hash"), key, [TAXON]).fillna(0, ["entered_measured"])
    return joined.withColumn("difference", F.col("sheet_measured") - F.col("entered_measured"))


def qa_species_counts(sheets: DataFrame, counts: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct taxa counted on the sheet against distinct taxa with a non-zero final count."""
    raw = sheets.groupBy(key).agg(F.countDistinct(F.when(F.col("Number_counted").isNotNull(), F.col(TAXON))).alias("sheet_taxa"))
    final = counts.groupBy(key).agg(F.countDistinct(F.when(F.col("Number_counted") != 0, F.col(TAXON))).alias("final_taxa"))
    joined = left_join(raw, final.hint("shuffle_hash"), key, null_keys=False, split_hot=False).fillna(0, ["final_taxa"])
    return joined.withColumn("difference", F.col("sheet_taxa") - F.col("final_taxa"))


def header_faults(sheets: DataFrame, key: str = KEY) -> DataFrame:
    """What is wrong with each sheet's header pairs, or null: no pairs, a name with several values, no readable date.

    :func:`header_spread` takes one value of a repeated name; here the sheet is named for it. Where the scan reported on columns, missing
    ones are a fault too, and unknown ones, which do no harm, come as ``notes``.
    """
    name, value = F.col("Information"), F.col("Value")
    parts = [F.count(F.when(name.isin(HEADER.names), 1)).alias("__pairs"), F.max(F.when(name == "Sample_date", parse_date(value))).alias("__date")]
    for field in HEADER.names:
        own = F.when(name == field, value)
        parts.append(F.when(F.min(own) < F.max(own), F.lit(field)).alias(f"__{field}"))
    reported = [c for c in ("missing_columns", "unknown_columns") if c in sheets.columns]
    found = sheets.select(key, "Information", "Value", *reported).groupBy(key).agg(*parts, *[F.max(c).alias(c) for c in reported])
    repeated = F.concat_ws(", ", *[f"__{field}" for field in HEADER.names])
    missing = [F.concat(F.lit("no column "), "missing_columns")] if "missing_columns" in reported else []
    text = F.concat_ws(
        "; ", *missing, F.when(F.col("__pairs") == 0, "no header rows"), F.when(repeated != "", F.concat(F.lit("several values for "), repeated)),
        F.when((F.col("__pairs") > 0) & F.col("__date").isNull(), "no readable Sample_date"),
    )
    notes = [F.concat(F.lit("Unknown columns: "), "unknown_columns", F.lit(".")).alias("notes")] if "unknown_columns" in reported else []
    return found.select(key, F.nullif(text, F.lit("")).alias("faults"), *notes)


def qa_status(measured: DataFrame, species: DataFrame, key: str = KEY, *, faults: DataFrame | None = None) -> DataFrame:
    """One status text per sheet from both checks, and from the faults of its header where they are given."""
    by_sheet = measured.groupBy(key).agg(F.sum("difference").alias("measured_diff"))
    joined = left_join(by_sheet, species.select(key, F.col("difference").alias("species_diff")).hint("shuffle_hash"), key, null_keys=False, split_hot=False)
    ok_m, ok_s = F.col("measured_diff") == 0, F.coalesce(F.col("species_diff") == 0, F.lit(False))
    text = (
        F.when(ok_m & ok_s, "Number measured OK. Species counts OK.")
        .when(ok_m, "Species counts NOT OK")
        .when(ok_s, "Number measured NOT OK")
        .otherwise("Number measured NOT OK. Species counts NOT OK.")
    )
    if faults is None:
        return joined.select(key, (ok_m & ok_s).alias("ok"), text.alias("status"))
    joined = left_join(joined, faults.hint("shuffle_hash"), key, null_keys=False, split_hot=False)
    header = F.when(F.col("faults").isNotNull(), F.concat(F.lit("Header NOT OK: "), "faults", F.lit(".")))
    return joined.select(key, (ok_m & ok_s & F.col("faults").isNull()).alias("ok"), F.concat_ws(" ", text, header, *[c for c in ("notes",) if c in faults.columns]).alias("status"))


def qa_volume_agreement(df: DataFrame, *, computed: str = "Vol_sampled_L2", stored: str = "Vol_sampled_L") -> DataFrame:
    """Ratio of computed to stored volume and whether they differ by one percent or more."""
    r = F.col("V1toV2ratio")
    flag = F.when((r <= RATIO_LOW) | (r >= RATIO_HIGH), "dif").when(r.isNotNull(), "same")
    return df.withColumn("V1toV2ratio", ratio(computed, stored)).withColumn("V1equalsV2", flag)


def qa_density_discrepancy(df: DataFrame, *, recomputed: str, stored: str = "Zoop_density", tolerance: float = DENSITY_TOLERANCE) -> DataFrame:
    """Rows whose recomputed density is off by more than the tolerance, with the signed difference."""
    return df.withColumn("density_diff", F.col(recomputed) - F.col(stored)).filter(F.abs("density_diff") > tolerance)


def discrepant_samples(rows: DataFrame, sample: str = "Sample_ID") -> DataFrame:
    """Affected sample ids by direction, with their row counts."""
    side = F.when(F.col("density_diff") > 0, "above").otherwise("below")
    return rows.groupBy(sample, side.alias("direction")).agg(F.count(F.lit(1)).alias("n"))
