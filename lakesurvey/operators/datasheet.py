"""From raw count sheets to headers, counts, lengths and eggs.

All functions take every sheet at once. ``key`` names the column that tells sheets apart; it is
the source file by default, because a hand-typed sample id may be wrong or repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesurvey.functions import (
    ADULT_MARK, ALWAYS_YOUNGER, half_even, has_any, initial_stage, ratio, round_nearest, stage_by_length, sum0, to_number,
)
from lakesurvey.operators.joins import attach_cutoffs, attach_scalars, join_within, left_join
from lakesurvey.operators.reshape import header_spread, unpivot_measurements
from lakesurvey.schemas import LENGTH_CELLS

KEY = "source_file"
TAXON = "Genus_sp_lifestage"

# Rotor constant and counter scale of the flow meter, and the litres one turn stands
# for with the standard 0.5 m net.
ROTOR_CONSTANT = 26873
COUNTER_SCALE = 999999
LITRES_PER_TURN = 5.2765
LITRES_PER_M3 = 1000
DENSITY_DIGITS = 10


def sheet_headers(sheets: DataFrame, key: str = KEY) -> DataFrame:
    """One typed row per sheet."""
    return header_spread(sheets.select(key, "Information", "Value"), key)


def initial_life_stage(df: DataFrame, *, taxon: str = TAXON, into: str = "Life_stage") -> DataFrame:
    return df.withColumn(into, initial_stage(taxon))


def sampled_volume_m3(net_diameter: Column, meter_1: Column, meter_2: Column) -> Column:
    """Water volume through the net: opening area times distance travelled."""
    area = F.pi() * F.pow(net_diameter, F.lit(2)) / 4
    return area * ((meter_2 - meter_1) * ROTOR_CONSTANT / COUNTER_SCALE)


def sampled_volume(df: DataFrame, *, into: str = "Vol_sampled_m3") -> DataFrame:
    return df.withColumn(into, sampled_volume_m3(F.col("Net_diameter_m"), F.col("Meter_1"), F.col("Meter_2")))


def sampled_volume_litres(df: DataFrame, *, into: str = "Vol_sampled_L2") -> DataFrame:
    """Shortcut for the standard net: meter turns times litres per turn."""
    return df.withColumn(into, (F.col("Meter_2") - F.col("Meter_1")) * LITRES_PER_TURN)


def density_of(number: Column, diluted: Column, subsampled: Column, litres: Column) -> Column:
    """Individuals per litre; null where the subsample or the water volume is zero."""
    return ratio(number * diluted, subsampled * litres)


def count_to_density(
    df: DataFrame, *, volume: str, number: str = "Number_counted", into: str = "Zoop_density",
    per_litre: float = 1, digits: int | None = None,
) -> DataFrame:
    """Density from a count; ``per_litre`` converts the volume column to litres."""
    litres = F.col(volume) if per_litre == 1 else F.col(volume) * per_litre
    d = density_of(F.col(number), F.col("Diluted_vol_mL"), F.col("Subsampled_vol_mL"), litres)
    return df.withColumn(into, d if digits is None else round_nearest(d, digits))


def sheet_counts(sheets: DataFrame, key: str = KEY, *, keep: Sequence[str] = ()) -> DataFrame:
    """One row per taxon row of a sheet; an empty count is 0."""
    number = F.coalesce(to_number("Number_counted"), F.lit(0.0))
    rows = sheets.select(*dict.fromkeys([key, "Sample_ID", TAXON]), number.alias("Number_counted"), *keep)
    return initial_life_stage(rows)


def length_to_mm(rows: DataFrame, *, units: str = "Length_OU", scale: str = "mm_per_ocular_unit") -> DataFrame:
    return rows.withColumn("Length_mm", F.col(units) * F.col(scale))


def sheet_lengths(sheets: DataFrame, headers: DataFrame, cutoffs: DataFrame, key: str = KEY, *, always_younger: Sequence[str] = ALWAYS_YOUNGER) -> DataFrame:
    """One row per measured individual, in millimetres, with its stage.

    The header scale and the cutoff are joined to the wide rows, before each becomes up to twenty.
    """
    ids = list(dict.fromkeys([key, "Sample_ID", TAXON]))
    wide = attach_scalars(sheets.select(*ids, *LENGTH_CELLS), headers, ["mm_per_ocular_unit"], on=key)
    wide = attach_cutoffs(wide, cutoffs)
    long = unpivot_measurements(
        wide, [*ids, "mm_per_ocular_unit", "Length_cutoff"], LENGTH_CELLS, name="Measured_number", value="Length_OU", parse=to_number
    )
    long = initial_life_stage(length_to_mm(long))
    stage = stage_by_length(TAXON, "Life_stage", "Length_mm", "Length_cutoff", always_younger)
    return long.withColumn("Life_stage", stage).drop("mm_per_ocular_unit", "Length_cutoff")


def split_eggs(lengths: DataFrame, *, by_name: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lengths proper, and the Egg rows, whose measurement is a number of eggs.

    With ``by_name``, for lengths as :func:`sheet_lengths` gives them, only names of eggs are looked at for Egg rows: cutoffs and young names may
    take the stage Egg away, nothing else gives it. What isn't stored is then worked out for these taxa a second time, not for all.
    """
    eggs = lengths.filter(initial_stage(TAXON) == "Egg") if by_name else lengths
    eggs = eggs.filter(F.col("Life_stage") == "Egg").withColumnRenamed("Length_OU", "Number_eggs").drop("Length_mm", "Life_stage")
    return lengths.filter(F.col("Life_stage") != "Egg"), eggs


def stage_proportions(
    sheets: DataFrame, headers: DataFrame, cutoffs: DataFrame, key: str = KEY, *,
    always_younger: Sequence[str] = ALWAYS_YOUNGER, measured_only: bool = False,
) -> DataFrame:
    """Share of measured individuals at or over the cutoff, per sheet and unstaged taxon.

    An unmeasured taxon has null shares; ``measured_only`` leaves its row out, which is most of a
    sheet and means the same to a left join.

    Cells become rows, as lengths do, and are counted as they come: what is kept, or shuffled where sheets don't lie by the key, is one
    row per taxon row and not one per individual.
    """
    rows = initial_life_stage(sheets.select(key, TAXON, *LENGTH_CELLS)).filter(F.col("Life_stage") == "Other").drop("Life_stage")
    rows = attach_cutoffs(attach_scalars(rows, headers, ["mm_per_ocular_unit"], on=key), cutoffs)
    long = unpivot_measurements(
        rows, [key, TAXON, "mm_per_ocular_unit", "Length_cutoff"], LENGTH_CELLS, name="Measured_number", value="Length_OU", keep_null=not measured_only)
    mm = (to_number("Length_OU") * F.col("mm_per_ocular_unit")).alias("mm")
    long = long.select(key, TAXON, mm, F.coalesce("Length_cutoff", F.lit(0.0)).alias("cutoff"))
    older = ratio(F.count(F.when(F.col("mm") >= F.col("cutoff"), 1)), F.count("mm"))
    by_name = has_any(TAXON, *always_younger)
    return (
        long.groupBy(key, TAXON).agg(older.alias("Prop_O"))
        .withColumn("Prop_O", F.when(by_name & F.col("Prop_O").isNotNull(), 0.0).otherwise(F.col("Prop_O")))
        .withColumn("Prop_Y", F.lit(1.0) - F.col("Prop_O"))
    )


def allocate_counts(
    counts: DataFrame, proportions: DataFrame, key: str = KEY, *, always_younger: Sequence[str] = ALWAYS_YOUNGER, null_keys: bool = True,
) -> DataFrame:
    """Split each count into older and younger by the measured shares, rounding halves to even."""
    n, young = F.col("Number_counted"), has_any(TAXON, *always_younger)
    fill = lambda c: F.when(c.isNull() & (F.col("Life_stage") == "Other"), 0.0).otherwise(c)
    # Rows without a sheet have no shares, so the sheet key is matched plainly.
    joined = left_join(counts, proportions.hint("shuffle_hash"), [key, TAXON], null_keys=[TAXON] if null_keys else False, split_hot=False)
    return joined.withColumns({
        "older_count": fill(F.when(young, 0.0).otherwise(half_even(n * F.col("Prop_O")))),
        "younger_count": fill(F.when(young, n).otherwise(half_even(n * F.col("Prop_Y")))),
    }).drop("Prop_O", "Prop_Y")


def expand_stage_rows(allocated: DataFrame, cutoffs: DataFrame, *, always_younger: Sequence[str] = ALWAYS_YOUNGER) -> DataFrame:
    """Rows per stage: Younger and Older for taxa that are split, one row for the others.

    A taxon with a cutoff gives both; a young-by-name one gives Younger, an adult one Older.
    Whether a taxon is split depends on its name only, so the rows are built in place by exploding
    a short array rather than by filtering the frame three times.
    """
    listed = cutoffs.select(TAXON).distinct().withColumn("__listed", F.lit(True))
    rows = left_join(allocated, listed, TAXON)
    has_cutoff = F.coalesce("__listed", F.lit(False))
    to_young = has_cutoff | has_any(TAXON, *always_younger)
    to_old = has_cutoff | has_any(TAXON, ADULT_MARK)

    def row(stage, number):
        return F.struct(stage.alias("stage"), number.alias("number"))

    own = F.when(F.col("Life_stage") == "Other", "Older").otherwise(F.col("Life_stage"))
    parts = F.array(
        F.when(to_young, row(F.lit("Younger"), F.coalesce("younger_count", F.lit(0.0)))),
        F.when(to_old, row(F.lit("Older"), F.coalesce("older_count", F.lit(0.0)))),
        F.when(~to_young & ~to_old, row(own, F.col("Number_counted"))),
    )
    others = [c for c in allocated.columns if c not in ("Life_stage", "Number_counted", "older_count", "younger_count")]
    return (
        rows.select(*others, F.explode(parts).alias("part")).filter(F.col("part").isNotNull())
        .select(*others, F.col("part.stage").alias("Life_stage"), F.col("part.number").alias("Number_counted"))
        .distinct()
    )


def staged_counts(sheets: DataFrame, headers: DataFrame, cutoffs: DataFrame, key: str = KEY, *, always_younger: Sequence[str] = ALWAYS_YOUNGER) -> DataFrame:
    """Counts by sheet, taxon and stage with densities (individuals per litre).

    A missing taxon is an empty one until the end, so that the join to the shares can use plain
    equality: its partitioning then serves the removal of repeated rows, without another shuffle.
    """
    named = sheets.withColumn(TAXON, F.coalesce(TAXON, F.lit("")))
    shares = stage_proportions(named, headers, cutoffs, key, always_younger=always_younger, measured_only=True)
    split = allocate_counts(sheet_counts(named, key), shares, key, always_younger=always_younger, null_keys=False)
    rows = expand_stage_rows(split, cutoffs, always_younger=always_younger)
    rows = rows.withColumn(TAXON, F.nullif(F.col(TAXON), F.lit("")))
    scalars = sampled_volume(headers).select(key, "Subsampled_vol_mL", "Diluted_vol_mL", "Vol_sampled_m3")
    rows = attach_scalars(rows, scalars, ["Subsampled_vol_mL", "Diluted_vol_mL", "Vol_sampled_m3"], on=key)
    dense = count_to_density(rows, volume="Vol_sampled_m3", per_litre=LITRES_PER_M3, digits=DENSITY_DIGITS)
    return dense.drop("Subsampled_vol_mL", "Diluted_vol_mL", "Vol_sampled_m3")


def stage_residuals(counts: DataFrame, staged: DataFrame, key: str = KEY) -> DataFrame:
    """Sheet and taxon totals whose staged rows do not add up to the count entered."""
    before = counts.groupBy(key, TAXON).agg(sum0("Number_counted").alias("entered"))
    after = staged.groupBy(key, TAXON).agg(sum0("Number_counted").alias("staged"))
    both = join_within(before, after.hint("shuffle_hash"), key, [TAXON])
    return both.withColumn("residual", F.col("entered") - F.col("staged")).filter("residual <> 0")
